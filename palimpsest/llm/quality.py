"""Quality rules and a hashed n-gram likelihood ratio (operator 10), in DataFrame functions alone.

Words and pairs of words are hashed to ``BUCKETS`` buckets. One multinomial counts them over
trusted documents (a bounded sample of the rows labelled good, ``TRUSTED`` at most), the other
over all documents; both count a text once, however many rows repeat it. A document's score is the mean over its n-grams of log p(trusted) /
p(raw); below ``THRESHOLD`` it is rejected. Scoring adds columns to the row: no exchange, no
join, and repeated rows stay as they are. Counting shuffles each distinct text once. Only the
table of buckets, as large for any input, passes through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES

BUCKETS = 10_000
#: Most labelled rows that the trusted multinomial is fitted on: those with the lowest hash of their id.
TRUSTED = 20_000
#: Mean log ratio that a document must reach.
THRESHOLD = -0.05
#: What a bucket that no trusted document has counts as, as a share of its raw frequency.
FLOOR = 0.01
#: Up to so many repeated windows in a text, positions are found by looking through them; beyond, by sorting. Both find the same.
FEW = 24


def with_words(docs: DataFrame, text: str = "text", into: str = "w") -> DataFrame:
    trimmed = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES))
    return docs.withColumn(into, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+")))


def _gram(h: str, n: int) -> Column:
    """Hashes of the n-word windows of an array of word hashes."""
    parts = ", ".join(["x", *(f"{h}[i + {k}]" for k in range(1, n))])
    return F.expr(f"CASE WHEN size({h}) < {n} THEN CAST(array() AS array<bigint>) ELSE transform(slice({h}, 1, size({h}) - {n - 1}), (x, i) -> xxhash64({parts})) END")


def _fenced(judged: DataFrame) -> DataFrame:
    """The same rows, counted on the way: no filter is pushed below a count. One that is copies every expression below it once for each use, and theirs in turn."""
    return judged.observe("judged", F.count(F.lit(1)).alias("rows"))


def with_rules(docs: DataFrame, text: str = "text", w: str = "w", h: str = "h") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and base_failed."""
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    out = docs.withColumns({"__l": lines, "__g": _gram(h, 3)}).withColumn("__s", F.sort_array("__g"))
    out = out.withColumn("__d", F.expr("array_distinct(filter(__s, (x, i) -> x = get(__s, i - 1)))"))
    looked = "filter(sequence(0, size(__g) - 1), i -> array_contains(__d, __g[i]))"
    ordered = "array_sort(transform(__g, (x, i) -> struct(x AS x, i AS i)))"
    alike = "filter(__o, (p, k) -> p.x = get(__o, k - 1).x OR p.x = get(__o, k + 1).x)"
    out = out.withColumn("__o", F.expr(f"CASE WHEN size(__d) > {FEW} THEN {ordered} END"))
    out = out.withColumn("__p", F.expr(f"CASE WHEN size(__d) = 0 THEN CAST(array() AS array<int>) WHEN size(__d) > {FEW} THEN sort_array(transform({alike}, p -> p.i)) ELSE {looked} END"))
    repeated = "aggregate(transform(__p, (p, k) -> least(3, coalesce(get(__p, k + 1) - p, 3))), 0L, (a, b) -> a + b)"
    out = out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(raw, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.expr(repeated),
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__l", "__g", "__s", "__d", "__o", "__p")


def with_hashes(docs: DataFrame) -> DataFrame:
    return with_words(docs).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def _buckets(h: str = "h", buckets: int = BUCKETS) -> Column:
    return F.transform(F.concat(F.col(h), _gram(h, 2)), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED) -> list[float] | None:
    """Of each bucket, log p(trusted) / p(raw); None where no document is trusted. docs: doc_id, text; labels: doc_id, quality."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("good")).distinct()
    good = good.orderBy(F.xxhash64("good"), "good").limit(trusted)
    own = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    own = own.join(F.broadcast(good), own["doc_id"] == F.col("good"), "left")  # at most ``trusted`` ids
    # copies combine before the exchange, so a large group sends one row from each task
    once = own.groupBy(F.xxhash64("text").alias("h1"), F.hash("text").alias("h2")).agg(F.max(F.col("good").isNotNull().cast("long")).alias("t"), F.first("text").alias("text"))
    grams = with_hashes(once.select("t", "text")).select("t", F.explode(_buckets(buckets=buckets)).alias("b"))
    rows = grams.groupBy("b").agg(F.count("*").alias("n"), F.sum("t").alias("t")).collect()
    n, t = sum(r.n for r in rows), sum(r.t for r in rows)
    if not t:
        return None
    out = [0.0] * buckets
    for r in rows:
        out[r.b] = round(math.log(((r.t / t) / (r.n / n) + FLOOR) / (1 + FLOOR)), 5)
    return out


def with_verdict(docs: DataFrame, ratios: list[float] | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs: with h and base_failed. Adds score (null without n-grams or ratios) and kept."""
    if ratios is None:
        return docs.withColumns({"score": F.lit(None).cast("double"), "kept": ~F.col("base_failed")})
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    docs = docs.withColumn("__b", _buckets(buckets=len(ratios)))
    total = F.aggregate("__b", F.lit(0.0), lambda a, b: a + table[b])
    docs = docs.withColumn("score", F.when(F.size("__b") > 0, total / F.size("__b")))
    return docs.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("score"), F.lit(0.0)) >= threshold)).drop("__b")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of every row of ``docs`` (doc_id, text; others are ignored).

    A null or blank text has no words and fails the base rules. Ids may be null or repeat:
    every row is judged by itself. Without trusted rows only the base rules hold.
    """
    own = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    judged = with_verdict(with_rules(with_hashes(own)), log_ratios(docs, labels), threshold)
    return _fenced(judged).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that are rejected, with all their columns."""
    own = docs.select(F.struct(*docs.columns).alias("row"), docs["text"].alias("text"))
    judged = with_verdict(with_rules(with_hashes(own)), log_ratios(docs, labels), threshold)
    return _fenced(judged).where("kept").select("row.*")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(docs, labels)


def base_rules(docs: DataFrame) -> DataFrame:
    """The base rules alone, as :func:`quality` has them: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    own = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return _fenced(with_rules(with_hashes(own))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


#: The base rules; the verdict's hashes are beyond SQL.
BASE_ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3
), k AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 2)) AS n FROM s
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY doc_id
), l AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w
), x AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x
"""
