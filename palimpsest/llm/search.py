"""Ranked lexical search over a two-level quantised index (operator 13).

The index is cut into blocks of documents where they lie; nothing is shuffled to build it. A block
is one row with its postings term by term: at the first level one byte for each, the term's
impact in the document rounded upward; at the second the exact count, beside each document's
length norm. A search adds up bytes, weighted by what the terms are worth, for a cheap upper bound of every
document's score. The exact scores of the highest bounds so far give a lower bound of the k-th best score; every document whose
bound reaches it is scored again in integers, all others can't be among the first k. So results are exact.

Items are searched in blocks of bounded size, each against all rows. A task holds one block of the index, one of
items, and k documents for each item; tasks send those on, and the first k of all are ranked at the end.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, doc_id, new_path, small_batches, written

TOP = 10
#: Postings of an index block, some 8 bytes each, and terms of a block of items: it ends with the document, or the item, that reaches them. A block has 65,536 documents at most.
POSTINGS, ITEM_TERMS = 200_000, 100_000
DOCUMENTS = 1 << 16
#: An impact is less than MOST; a byte stands for so many of its units.
MOST = 1_000_000
STEP = -(-MOST // 255)
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: A block: its documents and their norms, terms parted by spaces and how many postings each has; of each posting the document's place, the impact byte and the count.
_INDEX = "ids binary, norms binary, terms binary, sizes binary, places binary, impacts binary, counts binary"


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of digits and letters of ASCII and characters beyond it, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def impacts(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What a term adds to a score for each unit of its weight."""
    return (1_000_000_000 * counts) // (1000 * counts + 8 * norms)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all, with repeats."""

    def of(batches):
        for batch in batches:
            sizes = [len(terms(x)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(map(bool, sizes))], pa.int64()), "l": pa.array([sum(sizes)], pa.int64())})

    one = docs.select(docs["text"].alias("text")).mapInArrow(of, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return one.n or 0, one.l or 0


class _Building:
    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.clear()

    def clear(self) -> None:
        self.ids, self.norms, self.of_term, self.have = [], [], {}, 0

    def add(self, i: int, own: list[bytes]) -> bool:
        """Whether the block is full."""
        place = len(self.ids)
        self.ids.append(i)
        self.norms.append(100 - 90 + 90 * len(own) * self.n_docs // self.n_terms)
        counts = Counter(own)
        self.have += len(counts)
        for term, n in counts.items():
            held = self.of_term.get(term)
            if held is None:
                self.of_term[term] = [place, n]
            else:
                held += (place, n)
        return self.have >= POSTINGS or len(self.ids) == DOCUMENTS

    def row(self) -> pa.RecordBatch:
        names = sorted(self.of_term)
        sizes = np.fromiter((len(self.of_term[t]) // 2 for t in names), np.int64, len(names))
        both = np.fromiter((x for t in names for x in self.of_term[t]), np.int64, 2 * int(sizes.sum())).reshape(-1, 2)
        places, counts = both[:, 0], both[:, 1]
        norms = np.array(self.norms, np.int64)
        raised = -(-impacts(counts, norms[places]) // STEP)
        columns = np.array(self.ids, np.int64), norms, b" ".join(names), sizes.astype(np.int32), places.astype(np.uint16), raised.astype(np.uint8), counts.astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in columns], names=[x.split()[0] for x in _INDEX.split(", ")])


class Index:
    """An index of ``docs`` (doc_id, text; others are ignored) as a table in the shared folder. A null text has no terms, and a null doc_id counts as the smallest; repeated rows are documents of their own."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        small_batches(self.spark)
        own = docs.select(F.coalesce(docs["doc_id"], F.lit(NULL_ID)).alias("id"), docs["text"].alias("text"))
        self.n_docs, self.n_terms = n_docs, n_terms = totals(own)

        def of(batches):
            block = _Building(n_docs, n_terms)
            for batch in batches:
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    if (found := terms(text)) and block.add(i, found):
                        yield block.row()
                        block.clear()
            if block.ids:
                yield block.row()

        path = new_path(self.spark, "index")
        own.mapInArrow(of, _INDEX).write.option("compression", "zstd").parquet(path)
        self.blocks = self.spark.read.schema(_INDEX).parquet(path)

    def frequencies(self, wanted: list[bytes]) -> dict[bytes, int]:
        """Documents that hold each of the terms."""
        shared = self.spark.sparkContext.broadcast(frozenset(wanted))

        def of(batches):
            for batch in batches:
                for names, sizes in zip(batch.column("terms").to_pylist(), batch.column("sizes").to_pylist()):
                    found = [(t, n) for t, n in zip(names.split(), np.frombuffer(sizes, np.int32).tolist()) if t in shared.value]
                    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["term", "n"])

        rows = self.blocks.select("terms", "sizes").mapInArrow(of, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        return {bytes(r.term): r.n for r in rows}

    def search(self, items: DataFrame, top: int = TOP) -> DataFrame:
        """(item_id, rank, doc_id, score): for each row of ``items`` (item_id, text; others are ignored) its ``top`` documents with a score above 0, equal scores by ascending doc_id.

        Repeated items are items of their own; one without terms, or a null text, has no rows.
        """

        def sized(batches):
            for batch in batches:
                own = [sorted(set(terms(x))) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([b" ".join(t) for t in own], pa.binary()), pa.array(map(len, own), pa.int64())], names=["item_id", "terms", "n"])

        kind = items.schema["item_id"].dataType.simpleString()
        asked = items.select(items["item_id"].alias("item_id"), items["text"].alias("text")).mapInArrow(sized, f"item_id {kind}, terms binary, n long").where("n > 0")
        asked = written(asked.withColumn("item", F.monotonically_increasing_id()), "items")
        blocks = -(-(asked.agg(F.sum("n")).first()[0] or 0) // ITEM_TERMS)
        found = []
        for k in range(blocks):
            part = {r.item: bytes(r.terms).split() for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).select("item", "terms").collect()}
            found.append(self._best(part, top))
        if not found:
            return items.select(items["item_id"].alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
        rows = found[0]
        for more in found[1:]:
            rows = rows.union(more)
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= top)
        return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", doc_id(), "score")

    def _best(self, part: dict[int, list[bytes]], top: int) -> DataFrame:
        """(item, id, score): of each item of a block the ``top`` documents of each task."""
        df = self.frequencies(sorted(set().union(*part.values())))
        worth = {t: w for t, n in df.items() if (w := weight(n, self.n_docs)) > 0}
        shared = self.spark.sparkContext.broadcast([(i, [(t, worth[t]) for t in own if t in worth]) for i, own in part.items()])

        def of(batches):
            best: dict[int, list[tuple[int, int]]] = {i: [] for i, _ in shared.value}  # heaps of (score, -id)
            for batch in batches:
                for row in batch.to_pylist():
                    _Block(row).into(best, shared.value, top)
            found = [(i, -d, s) for i, heap in best.items() for s, d in heap]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["item", "id", "score"])

        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "8")  # rows are blocks here
        try:
            return written(self.blocks.mapInArrow(of, "item long, id long, score long"), "best")
        finally:
            self.spark.conf.set(name, before)


class _Block:
    def __init__(self, row: dict):
        self.ids, self.norms = (np.frombuffer(row[c], np.int64) for c in ("ids", "norms"))
        self.places, self.impacts, self.counts = (np.frombuffer(row[c], t) for c, t in (("places", np.uint16), ("impacts", np.uint8), ("counts", np.int32)))
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int32))
        self.at = dict(zip(row["terms"].split(), zip((ends - np.frombuffer(row["sizes"], np.int32)).tolist(), ends.tolist())))

    def into(self, best: dict[int, list[tuple[int, int]]], items: list, top: int) -> None:
        """Take this block's documents into the heaps of the first ``top``."""
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        get, at = held.get, self.at.get
        bound = np.zeros(len(self.ids), np.int64)
        for i, own in items:
            present = [(x, w) for t, w in own if (x := at(t))]
            if not present:
                continue
            bound[:] = 0
            for x, w in present:
                pair = get(x)
                if pair is None:
                    held[x] = pair = self.places[x[0] : x[1]].astype(np.intp), self.impacts[x[0] : x[1]].astype(np.int64)
                bound[pair[0]] += w * pair[1]
            heap = best[i]
            if len(heap) < top:  # the documents of the highest bounds give the first lower bound
                first = np.argpartition(bound, -top)[-top:] if len(bound) > top else np.arange(len(bound))
                self._rescored(heap, first[bound[first] > 0], present, top)
                bound[first] = 0
            least = heap[0][0] if len(heap) == top else 1
            reach = np.flatnonzero(bound * STEP >= least)
            if len(reach) > 4 * top:  # the highest first, so that the lower bound rises before the others are looked at
                first = reach[np.argpartition(bound[reach], -top)[-top:]]
                self._rescored(heap, first, present, top)
                bound[first] = 0
                reach = np.flatnonzero(bound * STEP >= max(1, heap[0][0]))
            self._rescored(heap, reach, present, top)

    def _rescored(self, heap: list[tuple[int, int]], docs: np.ndarray, present: list, top: int) -> None:
        """Exact scores of documents, kept if they are among the first ``top`` so far."""
        if not len(docs):
            return
        docs = np.sort(docs)
        score, norms = np.zeros(len(docs), np.int64), self.norms[docs]
        for (a, b), w in present:
            own = self.places[a:b]
            place = np.searchsorted(own, docs.astype(np.uint16))
            hit = np.flatnonzero(own[np.minimum(place, b - a - 1)] == docs)
            if len(hit):
                score[hit] += w * impacts(self.counts[a + place[hit]].astype(np.int64), norms[hit])
        for s, d in zip(score.tolist(), self.ids[docs].tolist()):
            if s > 0 and (len(heap) < top or (s, -d) > heap[0]):
                (heapq.heappush if len(heap) < top else heapq.heapreplace)(heap, (s, -d))


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return Index(docs).search(items)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), s AS (
  SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0
), p AS (
  SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY r, doc_id, term
), i AS (
  SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), q AS (
  SELECT q, item_id, unnest(t) AS term FROM i
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs
), x AS (
  SELECT q, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY q, item_id, doc_id, r HAVING score > 0
)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x) WHERE rank <= 10
"""
