"""What works inside a row against the way across rows, and how it grows."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import exprs
from palimpsest.operators import layout, parts, revisions, stream, trees
from palimpsest.schema import LAYOUT, REVISIONS, STREAM_OPS
from palimpsest.sources import synthetic


def rows(df):
    return sorted(map(str, df.collect()))


# --- the fold


def folded(ops):
    """Modes by copying the whole state at every step."""
    mode, stack, frames, out = 0, (), (), []
    for op, asked, shown in ops:
        if op in ("Tj", "TJ", "'", '"') and mode in (3, 7):
            out.append(shown or b"")
        elif op == "q":
            stack += (mode,)
        elif op == "Q" and stack:
            mode, stack = stack[-1], stack[:-1]
        elif op == "Tr" and asked is not None:
            mode = asked
        elif op == "FORM_BEGIN":
            frames, stack = (*frames, (mode, stack)), ()
        elif op == "FORM_END" and frames:
            (mode, stack), frames = frames[-1], frames[:-1]
    return len(out), b"".join(out)


def test_fold_of_random_operators(spark):
    rng = random.Random(4)
    pages = []
    for i in range(200):
        ops = [(rng.choice(["q", "Q", "Q", "Tr", "Tj", "TJ", "'", '"', "FORM_BEGIN", "FORM_END", "re"]), rng.choice([0, 1, 3, 7, None]), rng.choice([None, b"", b"a%d " % k])) for k in range(rng.randrange(120))]
        pages.append((i, 1, ops))
    df = spark.createDataFrame([(i, p, [(k, *x, 0) for k, x in enumerate(ops)]) for i, p, ops in pages] + [(999, 1, None), (998, 1, [])], STREAM_OPS)
    got = {r.doc_id: (r.n, bytes(r.shown)) for r in stream.invisible_shows(df).collect()}
    assert got == {i: x for i, _, ops in pages if (x := folded(ops))[0]}
    plan = stream.invisible_shows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_fold_is_linear():
    """Ten times the operators, however deep and however many are shown, in about ten times the time."""

    def took(n):
        ops = ["Tr", *["q"] * n, *["Tj"] * n, *["Q"] * n, *["FORM_BEGIN", "Tj"] * n, *["FORM_END"] * n]
        modes, shown = [3] + [None] * (len(ops) - 1), [b"x"] * len(ops)
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            assert stream.fold(ops, modes, shown)[0] == 2 * n
            best = min(best, time.perf_counter() - began)
        return best

    took(1000)
    assert took(100_000) < 25 * took(10_000) and took(100_000) < 2


# --- revisions


def history(seed, n=80):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["--", "é1", "x" * 40]
    text = lambda: rng.choice([None, "", " \n", " ".join(rng.choices(words, k=rng.randrange(60)))])
    return [(i, [(k + 1, text()) for k in range(rng.choice([0, 1, 2, 3, 5, 70]))]) for i in range(n)]


def test_in_the_row_and_across_rows(spark):
    df = spark.createDataFrame(history(1) + [(500, None)], REVISIONS)
    for f in (revisions.recovered, revisions.status, revisions.revision_history):
        assert rows(f(df)) == rows(f(df, 0)) == rows(f(df, 200)) and f(df).count()


def test_lost_tokens_by_counters(spark):
    from collections import Counter

    given = history(2)
    want = {}
    for i, revs in given:
        last = Counter(x for x in (revs[-1][1] or "").split() if any(c.isascii() and c.isalnum() for c in x)) if revs else Counter()
        for k, text in revs[:-1]:
            own = [x for x in (text or "").split() if any(c.isascii() and c.isalnum() for c in x)]
            lost = [t for t in dict.fromkeys(own) if Counter(own)[t] > last[t]]
            if lost and k <= 64:
                want[i, k] = (len(lost), " ".join(lost[:60]))
    got = {(r.doc_id, r.rev_index): (r.n_tokens, r.evidence) for r in revisions.recovered(spark.createDataFrame(given, REVISIONS)).collect()}
    assert got == want


def test_tokens_are_not_exchanged_in_the_row(spark):
    df = spark.createDataFrame(history(1), REVISIONS)
    plan = revisions._in_row(revisions.examined(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# --- parts


def stated(seed, n=40):
    rng = random.Random(seed)
    out, numbers = [], []
    for i in range(n):
        last = rng.choice([1, 2, 5, 90])
        numbers.append((i, last))
        for p in "abc"[: rng.randrange(1, 4)]:
            texts = [rng.choice(["one two", "two", None, "", "three one one"]) for _ in range(3)]
            out += [(i, p, r, rng.choice(texts)) for r in range(1, last + 1) if rng.random() < 0.6]
    return out, numbers


def test_parts_as_of(spark):
    given, numbers = stated(3)
    states, docs = spark.createDataFrame(given, "doc_id long, part string, rev_index int, text string"), spark.createDataFrame(numbers, "doc_id long, n_revisions long")
    changed = parts.changes(states)
    want, have, keys = {}, {(i, p, r): t for i, p, r, t in given}, {(i, p) for i, p, _, _ in given}
    for i, last in numbers:
        for p in (p for d, p in keys if d == i):
            now = None
            for r in range(1, last + 1):
                if (i, p, r) in have and (now is None or have[i, p, r] != now[1]):
                    now = (r, have[i, p, r])
                if now:
                    want[i, r, p] = now
    got = {(r.doc_id, r.rev_index, r.part): (r.version, r.text) for r in parts.as_of(changed, docs).collect()}
    assert got == want and changed.count() < len(given)
    # each version compared once gives what comparing every revision's state gives
    states_of = {}
    for (i, r, p), (_, text) in sorted(want.items()):
        states_of.setdefault((i, p), []).append((r, text))
    plain = spark.createDataFrame([(f"{i}{p}", s) for (i, p), s in states_of.items()], "doc_id string, revisions array<struct<rev_index: int, text: string>>")
    per_revision = {(r.doc_id, r.rev_index): (r.n_tokens, r.evidence) for r in revisions.recovered(plain).collect()}
    once = {(f"{r.doc_id}{r.part}", r.rev_index): (r.n_tokens, r.evidence) for r in parts.recovered_as_of(changed, docs).collect()}
    assert once == per_revision and once


# --- heavy pages


def page(rng, i, n_glyphs, n_covers, size=12.0):
    box = lambda a, b, w, h: (float(a), float(b), float(a + w), float(b + h))
    glyphs = [(k, rng.choice("abc "), *box(rng.uniform(-40, 700), rng.uniform(-40, 900), rng.choice([0.0, 6.0, 300.0 if k % 97 == 0 else 5.0]), size), 12.0, 0.0) for k in range(n_glyphs)]
    covers = [(k, rng.choice(["rect", "image"]), True, *box(rng.uniform(-400, 700), rng.uniform(-40, 900), rng.choice([4, 30, 9000 if k % 31 == 0 else 60]), rng.choice([4.0, 14.0, 32.0])), rng.choice([0.0, 0.6])) for k in range(n_covers)]
    return (i, 1, 0.0, 0.0, 612.0, 792.0, False, glyphs, covers)


def test_grid_gives_the_plain_rows(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([page(rng, i, n, m) for i, (n, m) in enumerate([(300, 40), (0, 5), (50, 0), (500, 80), (40, 3)])], LAYOUT)
    plain = rows(layout.covered_spans(df, 10**12))
    assert plain == rows(layout.covered_spans(df, 0)) == rows(layout.covered_spans(df, 12_000)) and len(plain) > 20
    marks = spark.createDataFrame([(i, 1, k, "/Redact", [x, y, x + 80, y + 14], None, None, None) for i in range(6) for k in range(3) for x, y in [(rng.uniform(0, 500), rng.uniform(0, 700))]] + [(0, 1, 9, "/Redact", None, None, None, None)], "doc_id long, page int, ord int, subtype string, rect array<double>, contents string, rc string, overlay_text string")
    assert rows(layout.text_under(marks, df, 10**12)) == rows(layout.text_under(marks, df, 0))


def test_a_heavy_page_in_seconds(spark):
    """50,000 glyphs and 5,000 covers on one page."""
    rng = random.Random(7)
    glyphs = [(k, "g", 6.0 * (k % 100), 1.5 * (k // 100), 6.0 * (k % 100) + 6, 1.5 * (k // 100) + 1.5, 1.5, 0.0) for k in range(50_000)]
    covers = [(k, "rect", True, x, y, x + 30, y + 6, 0.0) for k in range(5000) for x, y in [(rng.uniform(0, 570), rng.uniform(0, 740))]]
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 612.0, 792.0, False, glyphs, covers)], LAYOUT).cache()
    df.count()
    began = time.time()
    got = {r.c.cover_id: r.n_glyphs for r in layout.covered_spans(df).collect()}
    assert time.time() - began < 30
    for k in rng.sample(range(5000), 40):
        _, _, _, x0, y0, x1, y1, _ = covers[k]
        n = sum(max(0.0, min(g[4], x1) - max(g[2], x0)) * max(0.0, min(g[5], y1) - max(g[3], y0)) / 9.0 >= 0.30 for g in glyphs)
        assert got.get(k, 0) == n


# --- trees


@pytest.mark.parametrize("forest", [True, False])
def test_a_chain_and_a_cycle(spark, forest):
    chain = [(1, f"c{k}", f"c{k + 1}") for k in range(60)]
    cycle = [(2, "c0", "c1"), (2, "c1", "c2"), (2, "c2", "c0")]
    edges = spark.createDataFrame(chain + cycle + [(3, "c0", "c1"), (3, "c0", "c1"), (3, None, "x"), (3, "c0", None), (4, "a", "b")], "doc_id long, parent string, child string")
    roots = spark.createDataFrame([(1, "c0"), (2, "c0"), (3, "c0"), (3, None)], "doc_id long, node string")
    got = {(r.doc_id, r.node): r.depth for r in trees.reached(edges, roots, forest=forest).collect()}
    assert got == {(1, f"c{k}"): k for k in range(51)} | {(2, f"c{k}"): k for k in range(3)} | {(3, "c0"): 0, (3, "c1"): 1}


def test_diamonds_cost_no_more_than_their_nodes(spark):
    edges = [(1, f"{k}{a}", f"{k + 1}{b}") for k in range(40) for a in "xy" for b in "xy"]
    df, roots = spark.createDataFrame(edges, "doc_id long, parent string, child string"), spark.createDataFrame([(1, "0x")], "doc_id long, node string")
    assert not trees.is_forest(df) and trees.reached(df, roots).count() == 81


def test_first_known_size_by_source(spark):
    edges, roots = spark.createDataFrame([(1, "r", "a"), (1, "r", "b")], "doc_id long, parent string, child string"), spark.createDataFrame([(1, "r")], "doc_id long, node string")
    held = [(1, "b", 2, 0, "f", 7), (1, "a", 1, 5, "f", -1), (1, "a", 1, 9, "f", 3), (1, "z", 1, 0, "f", 1), (1, "a", 1, 1, "g", -1)]
    entries = spark.createDataFrame(held, "doc_id long, node string, source_ord int, ord int, name string, size long")
    assert rows(trees.names_below(edges, roots, entries)) == rows(spark.createDataFrame([(1, "f", 3), (1, "g", -1)], "doc_id long, name string, size long"))


# --- runs of glyphs


def test_runs_give_the_rows_of_their_glyphs(spark):
    """Runs on, partly on and off the page, tiny, white with and without a dark box behind, blank; a page beyond HEAVY too."""
    rng = random.Random(8)
    pages = []
    for i in range(40):
        runs = [(100 * k, "".join(rng.choice("ab  é😀") for _ in range(rng.randrange(1, 60))), rng.uniform(-60, 640), 820.0 - 14 * k, 6.0, 832.0 - 14 * k, rng.choice([12.0, 0.25, None]), rng.choice([0.0, 1.0, None])) for k in range(62)]
        covers = [(k, rng.choice(["rect", "image"]), rng.choice([True, False]), x, y, x + rng.choice([4.0, 60.0]), y + 14.0, rng.choice([0.0, 0.6])) for k in range(30) for x, y in [(rng.uniform(-40, 700), rng.uniform(-40, 840))]]
        pages.append((i, 1, 0.0, 0.0, 612.0, 792.0, covers, runs, sum(len(r[1]) for r in runs)))
    covers = LAYOUT[LAYOUT.index("covers ") :]
    df = spark.createDataFrame(pages, f"doc_id bigint, page int, x0 double, y0 double, x1 double, y1 double, {covers}, runs array<struct<glyph_id: bigint, text: string, x0: double, y0: double, step: double, y1: double, size: double, brightness: double>>, n_glyphs bigint")
    plain = df.withColumn("glyphs", exprs.glyphs_of(F.col("runs"))).drop("runs", "n_glyphs").localCheckpoint()
    want = rows(layout.covered_spans(plain))
    assert want == rows(layout.covered_spans(df)) == rows(layout.covered_spans(df, 0)) == rows(layout.covered_spans(df, 30_000)) and len(want) > 100
    hidden = layout.hidden_pages(plain).collect()
    assert sorted(map(str, hidden)) == rows(layout.hidden_pages(df)) and all(sum(r[n] for r in hidden) > 100 for n in ("n_white", "n_tiny", "n_offpage"))
    marks = spark.createDataFrame([(i, 1, k, [x, y, x + 80, y + 14]) for i in range(42) for k in range(3) for x, y in [(rng.uniform(0, 500), rng.uniform(0, 700))]], "doc_id long, page int, ord int, rect array<double>")
    assert rows(layout.text_under(marks, plain)) == rows(layout.text_under(marks, df))


def test_no_glyph_crosses_an_exchange(spark):
    """Pages of the plain tables meet their marks as runs, and nothing makes glyphs ahead of the exchange that deals pages out."""
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = synthetic.layout(documents)
    marks = documents.selectExpr("doc_id", "1 AS page", "0 AS ord", "array(0D, 0D, 99D, 99D) AS rect")
    for df in (layout.covered_spans(pages), layout.hidden_pages(pages), layout.text_under(marks, pages)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        deals = [k for k, line in enumerate(plan) if "REPARTITION_BY_NUM" in line]
        assert deals
        for k in deals:
            depth = plan[k].index("Exchange")
            below = []
            for line in plan[k + 1 :]:
                if len(line) - len(line.lstrip(" :+-*")) <= depth:
                    break
                below.append(line)
            assert not any("split(" in line for line in below)
    joins = layout.text_under(marks, pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "runs#" in joins and " glyphs#" not in joins
