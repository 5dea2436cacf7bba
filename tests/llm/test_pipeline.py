"""Every stage of the corpus pipeline, each judged on its own input."""

from __future__ import annotations

import itertools

import pytest
from cases import clashing
from pyspark.sql import functions as F
from test_operators import removed, rules, texts

import corpus_pipeline
from palimpsest.llm import common, packing, pii, quality, substring

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet"))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.written(stage(spark, out[-1], SF), name))
    return out


def test_columns(steps):
    assert all(x.columns == steps[0].columns for x in steps[1:-1])


def test_quality_stage(spark, steps):
    before, after = dict(texts(steps[0])), dict(texts(steps[1]))
    judged = {r.doc_id: r.kept for r in quality.query(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert after == {i: t for i, t in before.items() if judged[i]} and not any(rules(t)[-1] for t in after.values())


def shingles(text):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in common.words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_stage(steps):
    """Five-word shingles, similarity of 0.8 or more, all pairs compared: the smallest id of each component stays."""
    before, after = dict(texts(steps[1])), dict(texts(steps[2]))
    sets = {i: shingles(t) for i, t in before.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if len(a & b) >= 0.8 * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    assert after == {i: before[i] for i in {find(i) for i in root}} and len(after) < len(before)


def test_substring_stage(steps):
    before, after = texts(steps[2]), dict(texts(steps[3]))
    for i, n_words, n_removed, digest in removed(before):
        if n_removed < n_words:
            import hashlib

            assert hashlib.sha256(b" ".join(common.words(after[i]))).hexdigest() == digest
        else:
            assert i not in after
    assert all(r.n_chars == len(r.text) for r in steps[3].collect())
    assert substring.query(steps[3]).count() == len(after)


def test_pseudonym_stage(steps):
    before, after = dict(texts(steps[3])), dict(texts(steps[4]))
    assert before.keys() == after.keys()
    changed = {r.doc_id: r.n_masked for r in pii.query(steps[3]).collect()}
    assert all((before[i] != after[i]) == (changed[i] > 0) for i in before) and any(changed.values())


def test_packing_stage(spark, steps):
    want = {tuple(r)[:5] for r in packing.query(steps[4]).collect()}
    assert {tuple(r)[:5] for r in steps[5].collect()} == want
    assert {tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()} and len(want) > 0


def test_short_sql(spark, monkeypatch):
    """What Spark's parser has learned of a text stays in the driver: of 21,000 characters for operator 5 it kept 76 MB. No stage gives it long texts."""
    asked, expr = [0], F.expr
    monkeypatch.setattr(F, "expr", lambda text: (asked.append(len(text)), expr(text))[1])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pii.mask(docs, "a key that no other test has")
    quality.base_rules(docs)
    assert max(asked) < 1000
