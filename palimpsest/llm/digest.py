"""Document fingerprints: quartile bucket digests (operator 8).

Hashed byte triplets are counted in 128 buckets. The digest holds a logarithm of the length,
the ratios of the counts' quartiles, and for each bucket in which quartile it lies; two
digests differ by a bounded score, and likeness is its complement. Texts are read once, where
they lie in ascending order of doc_id: rows are dealt to ranges of ids and streamed, and the
first document of each range also goes to the range before, so that every document meets the
next one without a join.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, doc_id, partitions, small_batches

BUCKETS = 128
#: Triplets of a window of four bytes, as offsets.
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Score from which two digests count as wholly unlike.
BOUND = 256
#: Ids drawn for each range, on average, to cut ranges of like size.
DRAWN = 60
#: Most that lengths and one ratio add to the score.
_LENGTH, _RATIO = 60, 15


def counts(raw: bytes) -> np.ndarray:
    """Triplets in each bucket; bytes are taken in blocks, so a long text needs no more memory."""
    out = np.zeros(BUCKETS, np.int64)
    data = np.frombuffer(raw, np.uint8)
    block = 1 << 20
    for at in range(0, max(len(data) - 2, 0), block):
        b = data[at : at + block + 3].astype(np.uint32)
        for k, (i, j, m) in enumerate(_TRIPLETS):
            n = min(block, len(b) - m)
            if n <= 0:
                continue
            x = b[i : i + n] * np.uint32(0x9E3779B1)
            x += b[j : j + n] * np.uint32(0x85EBCA77)
            x += b[m : m + n] * np.uint32(0xC2B2AE3D)
            x += np.uint32((k + 1) * 0x27D4EB2F & 0xFFFFFFFF)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x >>= np.uint32(25)
            out += np.bincount(x, minlength=BUCKETS)
    return out


def fingerprint(text: str | None) -> str:
    """70 hex digits: length, two quartile ratios, 128 quartiles. Equal texts have equal ones; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = counts(raw)
    q1, q2, q3 = np.sort(n)[[31, 63, 95]]
    length = min(255, round(8 * math.log2(len(raw) + 1)))
    ratios = [int(255 * q // max(q3, 1)) for q in (q1, q2)]
    level = ((n > q1).astype(np.uint8) + (n > q2) + (n > q3)).reshape(-1, 4)
    body = (level * np.array([1, 4, 16, 64], np.uint8)).sum(1, dtype=np.uint8)
    return bytes([length, *ratios]).hex() + body.tobytes().hex()


def difference(a: str, b: str) -> int:
    """0 to BOUND: 1, 2 or 6 for a bucket that lies one, two or three quartiles off, and bounded terms for length and ratios."""
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    head = np.abs(x[:3].astype(int) - y[:3])
    own, other = ((s[3:, None] >> np.array([0, 2, 4, 6])) & 3 for s in (x, y))
    off = np.bincount(np.abs(own.astype(int) - other).ravel(), minlength=4)
    score = int(off[1] + 2 * off[2] + 6 * off[3]) + min(_LENGTH, 2 * int(head[0])) + sum(min(_RATIO, int(h) // 4) for h in head[1:])
    return min(BOUND, score)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / BOUND


def edited(text: str, other: str) -> str:
    """``text`` with its last half replaced by as much of ``other``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches):
    """Rows by range, tails last: each document with the one after it."""
    held, here, out = None, None, []
    for batch in batches:
        for r, tail, i, text in zip(batch["r"], batch["tail"], batch["id"], batch["text"]):
            text = text or ""
            if r != here:
                here, held = r, None
            elif held is None:
                continue  # a second tail
            own = fingerprint(text)
            if held:
                j, before, mark = held
                changed = edited(before, text)
                other = fingerprint(changed)
                out.append((j, len(before), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mark, other, likeness(mark, other), likeness(mark, own)))
            held = None if tail else (i, text, own)
            if len(out) >= 500:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in _OUT.split(", ")])
                out = []
    if out:
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _OUT.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs`` (doc_id, text; others are ignored).

    The next document is the one with the next doc_id, after the last the first; a null id is
    the smallest, and rows that repeat an id follow by the hash of their text. A null text
    counts as empty. A single row is its own next one; an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.coalesce(docs["doc_id"], F.lit(NULL_ID)).alias("id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("mark"))
    ids = docs.select(F.coalesce(docs["doc_id"], F.lit(NULL_ID)).alias("id")).withColumn("x", F.col("id").cast("double"))
    n = 4 * partitions(spark)
    # as Spark's own range partitioning does: cuts from a sample of a fixed size for each range; any cuts give the same result
    drawn = sorted(x for (x,) in ids.select("x").sample(min(1.0, DRAWN * n / max(1, docs.count())), 42).collect())
    cuts = sorted({drawn[k * len(drawn) // n] for k in range(1, n)}) if drawn else []
    ranged = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="x", outputCol="r") if cuts else None

    def with_range(rows: DataFrame) -> DataFrame:
        return ranged.transform(rows).drop("x") if ranged else rows.withColumn("r", F.lit(0.0)).drop("x")

    first = sorted((r, i) for r, i in with_range(ids).groupBy("r").agg(F.min("id")).collect())  # a row for each range
    before = [(i, first[k - 1][0]) for k, (_, i) in enumerate(first)]
    heads = spark.createDataFrame(before, "id long, before double") if before else spark.createDataFrame([], "id long, before double")
    rows = with_range(own.withColumn("x", F.col("id").cast("double"))).join(F.broadcast(heads), "id", "left")
    here, there = F.struct("r", F.lit(False).alias("tail")), F.struct(F.col("before").alias("r"), F.lit(True).alias("tail"))
    dealt = rows.select("id", "mark", "text", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("e")).select("e.r", "e.tail", "id", "mark", "text")
    streamed = dealt.repartitionById(partitions(spark), F.pmod(F.col("r").cast("int"), F.lit(partitions(spark)))).sortWithinPartitions("r", "tail", "id", "mark").select("r", "tail", "id", "text")
    return streamed.mapInPandas(_pairs, _OUT)


def query(docs: DataFrame) -> DataFrame:
    return fingerprints(docs).select(doc_id(), *(x.split()[0] for x in _OUT.split(", ")[1:]))
