"""SimHash near-duplicates by the generalised pigeonhole principle (operator 7).

Fingerprints of 64 bits are cut into partitions of correlated bits. Two fingerprints within
``max_bits`` of each other must, for thresholds T_i that sum to ``max_bits - m + 1``, differ by
at most T_i bits in some partition i (T_i = -1 leaves a partition out). A dynamic programme
gives every partition its own threshold, by candidate counts estimated from statistics of all
fingerprints; the cheapest of several numbers of partitions is taken. A bucket holds what has
a partition's bits, or is up to T_i flips away from them; pairs in a bucket are verified.

Copies collapse to one row per fingerprint before anything is paired. A bucket with more than
``BUCKET`` rows is not paired: its members send themselves and their one-flip neighbours, and
what meets at a neighbour is within two bits, so links cost 65 rows a member, not a square.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, components, doc_id, with_key, words, written

SEED = 42
BITS = 64
#: Rows of a bucket that are paired directly; larger buckets take the way by neighbours.
BUCKET = 64
_OFFSET = (np.arange(8, dtype=np.uint16) * 256)[None, :]
_BIT = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """Hashes of all runs of ``shingle`` words, repeats included, A-Z in lower case; a shorter text is one run, one without words has none."""
    w = [x.lower() for x in words(text)]
    if not w:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) > shingle else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(w) - shingle + 1))


def majority(own: np.ndarray) -> int:
    """Unsigned fingerprint: bit i is set if over half of the hashes have it; 0 for none."""
    n = len(own)
    counts = np.bincount((own.view(np.uint8).reshape(n, 8) + _OFFSET).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits(2 * (counts @ _BIT) > n, axis=1, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(id, mark, fp) of every row, mark a hash of its text; A-Z are lower-cased, other characters stay."""

    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(x, shingle) for x in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return with_key(docs, "text").select("id", F.xxhash64("text").alias("mark"), F.pandas_udf(of, "long")("text").alias("fp"))


def _bits(values: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j: 2,080 sums, whatever the input."""
    upper = np.triu_indices(BITS)

    def of(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = _bits(batch["fp"].to_numpy()).astype(np.float64)
            total += bits.T @ bits
        yield pd.DataFrame({"i": upper[0], "j": upper[1], "n": total[upper].astype(np.int64)})

    rows = distinct.select("fp").mapInPandas(of, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect()
    both = np.zeros((BITS, BITS))
    for i, j, n in rows:
        both[i, j] = both[j, i] = n
    return distinct.count(), both


def correlated(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` partitions of nearly equal width: each takes the bits most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    rho = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(rho, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        free = sorted(left)
        own = [max(free, key=lambda b: (rho[b, free].sum(), -b))]
        while len(own) < width:
            rest = [b for b in free if b not in own]
            own.append(max(rest, key=lambda b: (rho[b, own].sum(), -b)))
        left -= set(own)
        out.append(sorted(own))
    return out


def _signed(bits) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """cost[i][e]: of partition i with threshold e - 1; the cheapest e that sum to ``total``."""
    best = {0: (0.0, [])}
    for row in cost:
        found: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for e in range(min(len(row) - 1, total - used) + 1):
                now = (c + row[e], [*chosen, e])
                if used + e not in found or now < found[used + e]:
                    found[used + e] = now
        best = found
    return best[total]


def plan(distinct: DataFrame, max_bits: int, choices=(2, 3, 4)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition to probe, from statistics of all fingerprints."""
    n, both = bit_counts(distinct)
    cuts = {m: correlated(n, both, m) for m in choices if m <= max_bits + 1}
    keyed = [(m, i, bits) for m, cut in cuts.items() for i, bits in enumerate(cut)]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(bits))).alias("key")) for k, (_, _, bits) in enumerate(keyed)))).alias("x")
    sizes = distinct.select(rows).groupBy("x.k", "x.key").count()
    pairs = {k: float(s or 0) for k, s in sizes.groupBy("k").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).collect()}
    p = np.diag(both) / max(n, 1)
    same = p * p + (1 - p) ** 2
    best = (float("inf"), [])
    for m, cut in cuts.items():
        cost = []
        for k, (_, _, bits) in [(k, x) for k, x in enumerate(keyed) if x[0] == m]:
            odds = np.array([1.0])  # odds[r]: pairs that differ in r bits, for each that agrees in all
            for b in bits:
                odds = np.convolve(odds, [1.0, (1 - same[b]) / same[b]])[: max_bits + 1]
            probes = np.cumsum([comb(len(bits), r) for r in range(max_bits + 1)])
            cost.append([0.0, *(max(pairs.get(k, 0), 1e-9) * np.cumsum(odds)[: len(probes)] + float(n) * probes)[: max_bits + 1]])
        c, chosen = allocate(cost, max_bits + 1)
        best = min(best, (c, [(bits, e - 1) for bits, e in zip(cut, chosen) if e]))
    return best[1]


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): representatives of fingerprints (fp, rep) that connect all that is within ``max_bits``, directly or by steps of at most that.

    Supports 0 to 2 bits: the way for large buckets rests on what one flip can reach.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    if max_bits == 0:
        return distinct.selectExpr("rep AS a", "rep AS b").limit(0)
    signatures = []
    for i, (bits, threshold) in enumerate(plan(distinct, max_bits)):
        key = F.col("fp").bitwiseAND(F.lit(_signed(bits)))
        for r in range(threshold + 1):
            for flips in combinations(bits, r):
                signatures.append(F.struct(F.lit(i).alias("part"), key.bitwiseXOR(F.lit(_signed(flips))).alias("key"), F.lit(r > 0).alias("probe")))
    rows = distinct.select("fp", "rep", F.explode(F.array(*signatures)).alias("s")).select("fp", "rep", "s.part", "s.key", "s.probe")
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n"), F.count_if(~F.col("probe")).alias("own")).where("n > 1 AND own > 0")
    shared = written(rows.join(sizes, ["part", "key"]), "buckets")
    small = shared.where(F.col("n") <= BUCKET).groupBy("part", "key").agg(F.collect_list(F.struct("fp", "rep", "probe")).alias("x"))
    pairs = small.selectExpr(
        f"explode(flatten(transform(filter(x, p -> NOT p.probe), p -> transform(filter(x, q -> (q.probe OR q.fp > p.fp) AND q.fp <> p.fp AND bit_count(p.fp ^ q.fp) <= {max_bits}), q -> struct(p.rep AS a, q.rep AS b))))) AS l"
    ).select("l.a", "l.b")
    member = shared.where(F.col("n") > BUCKET).select("fp", "rep").distinct()
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed([b]))) for b in range(BITS)))
    # what meets at a neighbour is at most 65 fingerprints, all within two bits of each other
    met = member.select("fp", "rep", F.explode(near).alias("at")).groupBy("at").agg(F.collect_list(F.struct("fp", "rep")).alias("x")).where("size(x) > 1")
    if max_bits == 2:
        star = met.selectExpr("array_min(x.rep) AS a", "explode(x.rep) AS b")
    else:
        star = met.selectExpr("get(filter(x, p -> p.fp = at), 0).rep AS a", "explode(x.rep) AS b").where("a IS NOT NULL")
    return pairs.union(star.where("a <> b"))


def near(texts: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b), a before b, once each: texts (mark, fp) whose fingerprints are linked, each by way of the text that stands for its fingerprint."""
    own = written(texts.groupBy("fp").agg(F.min("mark").alias("rep")), "distinct")
    same = texts.join(own, "fp").selectExpr("rep AS a", "mark AS b")
    return links(own, max_bits).union(same).where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()


def clusters(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, mark, fp, component_id) of every row of ``docs`` (doc_id, text; others are ignored).

    Null and blank texts have fingerprint 0 and link like any other; a null id counts as the
    smallest; repeated rows come back as often as they came. An empty table gives none.
    """
    own = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    found = components(links(distinct, max_bits))
    roots = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return own.join(roots, "fp").select("id", "mark", "fp", "component_id")


def near_dedup(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id, and of several such the one with the smallest hash of its text.

    All columns of the input are kept. Texts are shuffled once, to drop what loses; the
    count among repeated rows then needs no other exchange.
    """
    first = clusters(docs, shingle, max_bits).groupBy("component_id").agg(F.min(F.struct("id", "mark")).alias("x")).select(F.col("x.id").alias("__plm_id"), F.col("x.mark").alias("__plm_mark"))
    keyed = docs.withColumns({"__plm_id": F.coalesce(docs["doc_id"], F.lit(NULL_ID)), "__plm_mark": F.xxhash64(docs["text"])})
    kept = keyed.join(first, ["__plm_id", "__plm_mark"], "left_semi")
    same = Window.partitionBy("__plm_id", "__plm_mark").orderBy("__plm_id")
    return kept.withColumn("__plm_row", F.row_number().over(same)).where("__plm_row = 1").select(*(kept[c] for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    found = clusters(docs)
    return found.select(doc_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif("component_id", F.lit(NULL_ID)).alias("component_id"))
