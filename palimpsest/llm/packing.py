"""Best-fit packing by a linear grouping scheme (operator 9).

A plan is made from the counts of lengths alone, of which there are at most ``capacity``, so
it is as large for a hundred documents as for 10**11. Pieces longer than ``small`` are sorted
and cut into groups of equal cardinality; every length counts as the largest of its group; a
configuration programme over these few sizes (column generation, then rounding down) says how
often each combination is used. Actual lengths then replace the rounded ones, and what
rounding left open, with all small pieces, is filled best fit, longest first. The plan says
in which sequence and where the r-th piece of a length goes; a piece's rank is its place in
its task plus what earlier tasks have of that length.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, doc_id, small_batches, written
from .tokens import Encoder, public_vocabulary

CAPACITY = 1024
END = 2


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path, spaced=True)


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The combination of sizes that fits and is worth most."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    least = int(sizes.min())
    for c in range(least, capacity + 1):
        left = c - sizes
        worth = np.where(left >= 0, best[np.maximum(left, 0)] + value, -1.0)
        k = int(worth.argmax())
        best[c], took[c] = (worth[k], k) if worth[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    out, c = np.zeros(len(sizes), int), capacity
    while c >= least:
        if took[c] < 0:
            c -= 1
        else:
            out[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[capacity]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Column generation for the fewest bins that hold ``demand`` of each size: (pattern, how often), as the linear programme has it."""
    fits = capacity // sizes
    basis, x = np.diag(fits).astype(float), demand / fits
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, pattern = best_pattern(sizes, dual, capacity)
        if worth <= 1 + 1e-7:
            break
        way = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        k = int(ratio.argmin())
        step = ratio[k]
        x = np.maximum(x - step * way, 0)
        basis[:, k], x[k] = pattern, step
    return [(basis[:, i].round().astype(int), float(x[i])) for i in range(len(sizes))]


class _Plan:
    def __init__(self, counts: np.ndarray, capacity: int):
        self.left = counts.astype(np.int64).copy()
        self.rank = np.zeros_like(self.left)
        self.capacity, self.bins = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, number, first sequence, offset
        self.open: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, number)

    def put(self, length: int, n: int, base: int, offset: int) -> None:
        self.runs.append((length, int(self.rank[length]), n, base, offset))
        self.rank[length] += n
        self.left[length] -= n

    def new(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def keep(self, base: int, n: int, room: int) -> None:
        if n and room:
            self.open.setdefault(room, []).append((base, n))

    def configured(self, pattern: list[tuple[list[int], int]], n: int, waste: int) -> None:
        """Up to n new sequences with so many pieces of each group's lengths; those that leave more room than ``waste`` give their pieces back."""
        free = {x: int(self.left[x]) for lengths, _ in pattern for x in lengths}
        parts: list[tuple[int, list[int]]] = [(n, [])]
        for lengths, times in pattern:
            for _ in range(times):
                done = []
                for many, have in parts:
                    for length in lengths:
                        k = min(many, free[length])
                        if k:
                            free[length] -= k
                            done.append((k, [*have, length]))
                            many -= k
                    if many:
                        done.append((many, have))
                parts = done
        for many, have in parts:
            room = self.capacity - sum(have)
            if have and room <= waste:
                base, fill = self.new(many), 0
                for length in have:
                    self.put(length, many, base, fill)
                    fill += length
                self.keep(base, many, room)

    def best_fit(self, length: int) -> None:
        """All that is left of a length, each piece where it leaves the least room; new sequences only where none has room."""
        while self.left[length]:
            room = min((r for r in self.open if r >= length), default=0)
            if room:
                base, n = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room]
            else:
                room = self.capacity
                n = -(-int(self.left[length]) // (room // length))
                base = self.new(n)
            times = room // length
            full = int(min(n, self.left[length] // times))
            for t in range(times if full else 0):
                self.put(length, full, base, self.capacity - room + t * length)
            self.keep(base, full, room - times * length)
            rest = int(self.left[length]) if full < n else 0
            if rest:  # fewer than fill one sequence
                for t in range(rest):
                    self.put(length, 1, base + full, self.capacity - room + t * length)
                self.keep(base + full, 1, room - rest * length)
                full += 1
            self.keep(base + full, n - full, room)


def grouped(counts: np.ndarray, capacity: int, groups: int, small: int) -> list[tuple[list[tuple[list[int], int]], int]]:
    """Combinations of groups of lengths, (lengths, how many) each, and how often each is used; counts[l]: pieces of length l."""
    large = [x for x in range(capacity - 1, small, -1) if counts[x]]
    if not large:
        return []
    cut = counts[large].sum() / groups
    number = np.minimum(((np.cumsum(counts[large]) - counts[large]) // max(cut, 1)).astype(int), groups - 1)
    own = [[x for x, g in zip(large, number) if g == k] for k in sorted(set(number))]
    sizes, demand = np.array([x[0] for x in own]), np.array([counts[x].sum() for x in own], float)
    found = sorted(configurations(sizes, demand, capacity), key=lambda x: -x[1])
    return [([(own[i], int(t)) for i, t in enumerate(pattern) if t], int(n + 1e-6)) for pattern, n in found if int(n + 1e-6)]


def plan(counts: np.ndarray, capacity: int, used: list, waste: int) -> _Plan:
    """used: what :func:`grouped` gives; waste: the most room that a configured sequence may leave."""
    p = _Plan(counts, capacity)
    if counts[capacity]:
        p.put(capacity, int(counts[capacity]), p.new(int(counts[capacity])), 0)
    for pattern, n in used:
        p.configured(pattern, n, waste)
    for length in range(capacity, 0, -1):
        p.best_fit(length)
    return p


#: (groups, capacity / bound of small), and the most room that a sequence may be left with, of the plans that are made and compared.
SCHEMES = {(24, 4): (CAPACITY,), (64, 8): (CAPACITY, 16, 4, 1), (128, 8): (4,)}


def best_plan(counts: np.ndarray, capacity: int) -> _Plan:
    """The plan with the fewest sequences of :data:`SCHEMES`."""
    used = {k: grouped(counts, capacity, k[0], capacity // k[1]) for k in SCHEMES}
    return min((plan(counts, capacity, used[k], waste) for k, wastes in SCHEMES.items() for waste in wastes), key=lambda p: p.bins)


def _pieces(path: str, capacity: int, end: int, keep_ids: bool):
    def of(batches):
        encode = _encoder(path)
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out = []
                for i, raw in zip(batch.column("id").to_pylist(), encode(batch.column("text").to_pylist())):
                    ids = np.append(np.frombuffer(raw, encode.dtype), encode.dtype.type(end)).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        own = ids[a:b].tobytes()
                        out.append((i, k, a, b - a, zlib.crc32(own), task, seen[b - a], own if keep_ids else None))
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _TYPES.values())], list(_TYPES))

    return of


_TYPES = {"id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "task": pa.int32(), "nth": pa.int64(), "ids": pa.binary()}


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), and ids if kept, of every piece of every row of ``docs`` (doc_id, text; others are ignored).

    A document is its ids and ``end``; a null or empty text is ``end`` alone. Only documents
    of more than ``capacity`` ids are cut, the short piece first. Repeated rows are packed as
    often as they come; an empty table gives none. vocabulary: a file of the tokenizers library.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or public_vocabulary("byte_bpe_50k.json")
    rows = docs.select(F.coalesce(docs["doc_id"], F.lit(NULL_ID)).alias("id"), docs["text"].alias("text"))
    pieces = written(rows.mapInArrow(_pieces(path, capacity, end, keep_ids), "id long, piece int, start long, length long, ids_crc32 long, task int, nth long, ids binary"), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    runs = np.array(sorted(best_plan(counts, capacity).runs), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(((runs[:, 0] << 44) + runs[:, 1], runs))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(by_task.select("task", "length", before.alias("before")), ["task", "length"])

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, runs = shared.value
        k = np.searchsorted(keys, (length.to_numpy() << 44) + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": runs[k, 3] + rank.to_numpy() - runs[k, 1], "offset": runs[k, 4]})

    at = ranked.withColumn("at", placed("length", F.col("nth") + F.col("before")))
    return at.select(doc_id(), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *["ids"] * keep_ids)


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
