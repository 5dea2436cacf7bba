"""Nulls, repeats, clashing names and empty tables where other tests don't have them."""

from __future__ import annotations

import numpy as np
import pytest
from cases import ROWS, clashing, documents
from pyspark.sql import functions as F
from test_operators import SF, key

import corpus_pipeline
from palimpsest.llm import chat, common, quality

NAMES = ("seq", "kind", "target", "position", "tie", "o", "reset", "gone", "last", "place", "head", "body", "t", "b", "all", "loss", "nth", "formatted", "turns", "id", "doc_id")


def folded(events):
    """Messages of a log by walking through it."""
    state, first = {}, {}
    for conv, _, kind, target, role, text in sorted(events, key=lambda e: e[1]):
        k = conv, target
        first.setdefault(k, len(first))
        m = state.setdefault(k, {"role": "", "text": "", "gone": True, "started": False})
        if kind == "delete":
            m["gone"] = True
            if not m["started"]:
                m["text"] = ""
        elif kind == "delta":
            m["text"], m["gone"] = m["text"] + (text or ""), False
        else:
            m["text"], m["gone"], m["started"] = text or "", False, True
            m["role"] = role if role is not None else m["role"]
    return sorted((c, first[c, t], m["role"], m["text"]) for (c, t), m in state.items() if not m["gone"])


def test_random_logs(spark):
    rng = np.random.default_rng(9)
    kinds, roles = ["message", "delta", "delta", "delta", "edit", "regenerate", "delete"], ["user", "assistant", None]
    events = [(int(rng.integers(20)), int(s), kinds[rng.integers(7)], int(rng.integers(4)), roles[rng.integers(3)], None if rng.random() < 0.05 else f"{'<|im_end|>&'[: rng.integers(12)]}{rng.integers(99)} ") for s in rng.permutation(3000)]
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, target long, role string, text string")
    got = chat.reconstruct(df).collect()
    want = folded(events)
    place = {}
    for c, n, role, text in want:
        place.setdefault(c, []).append((role, text))
    mine = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.position, r.tie)):
        mine.setdefault(r.conv_id, []).append((r.role, r.text))
    assert mine == place
    back = {r.conv_id: r.n_turns for r in chat.read_back(chat.render(chat.reconstruct(df))).collect()}
    assert back == {c: len(x) for c, x in place.items()}


def test_conversations_with_clashing_names(spark):
    rows = [(1, 0, "user", None), (1, None, None, "x"), (None, None, None, None), (None, 3, "assistant", "y"), (2, 1, "user", "same"), (2, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain, more = chat.query(df), chat.query(df.withColumns({n: F.lit("clash") for n in NAMES}))
    assert sorted(map(tuple, plain.collect()), key=key) == sorted(map(tuple, more.collect()), key=key)
    assert {r.conv_id: r.n_turns for r in plain.collect()} == {1: 2, None: 2, 2: 2, -1: 2}


def test_labels_with_nulls_and_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = labels.union(spark.createDataFrame([(None, 1, 0), (3, None, None), (None, None, None)], labels.schema)).union(labels.limit(5))
    more = odd.withColumns({n: F.lit("clash") for n in ("good", "text", "t", "b", "n", "h", "h1", "h2", "w", "score", "kept")})
    want = sorted(map(tuple, quality.query(docs, labels).collect()), key=key)
    assert sorted(map(tuple, quality.query(clashing(docs), more).collect()), key=key) == want


@pytest.mark.parametrize("empty", [True, False])
def test_every_stage_on_odd_rows(spark, empty):
    """Null ids, null and empty texts, repeats and clashing names, or nothing at all, through each stage by itself."""
    docs = clashing(documents(spark, [] if empty else ROWS))
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, SF), name)
        n = out.count()
        assert out.columns == docs.columns or name == "best_fit_packing"
        assert n == 0 if empty else n > 0 or name == "quality_rules"


def test_pipeline_of_nothing(spark, tmp_path):
    documents(spark, []).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
