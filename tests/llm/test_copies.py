"""What hashes and counts must not do when a line or a text is in very many documents."""

from __future__ import annotations

from cases import documents
from pyspark.sql import functions as F
from test_operators import SF, key, removed, texts

from palimpsest.llm import quality, substring


def test_phrases_that_agree_in_32_bits_stay(spark):
    """Two phrases of one anchor whose hashes have the same upper 32 bits, found by search."""
    own = [f"a{i} {'x ' * 6}line 16034 in very many texts {'y ' * 6}b{i}" for i in (1184, 61114)]
    df = documents(spark, [(i, t, None, None, None) for i, t in enumerate(own)])
    rows = sorted(map(tuple, substring.query(df).collect()), key=key)
    assert rows == removed(texts(df)) and [r[2] for r in rows] == [0, 0]


def test_verdicts_do_not_depend_on_copies(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    before = {r.doc_id: (r.score, r.kept) for r in quality.query(docs, labels).collect()}
    labelled = {r.doc_id for r in labels.collect()}
    one = max(i for i, (_, kept) in before.items() if kept and i not in labelled)
    many = docs.where(F.col("doc_id") == one).drop("doc_id").crossJoin(spark.range(10**6, 10**6 + 1000).toDF("doc_id")).select(docs.columns)
    after = {r.doc_id: (r.score, r.kept) for r in quality.query(docs.union(many), labels).collect()}
    assert {i: after[i] for i in before} == before and all(after[10**6 + k] == before[one] for k in range(1000))
