"""Divergence, line dedup and search against brute force, SQL and the odd cases."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
from cases import ROWS, clashing, documents
from pyspark.sql import functions as F
from test_operators import SF, key

from palimpsest.llm import divergence, lines, queries, search

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ordered(rows):
    return sorted(map(tuple, rows), key=key)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_lines", "op13_search"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = c.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert ordered(got.select(*want.columns).collect()) == ordered(want.fetchall())


# --- line dedup


def cut_lines(rows, least_chars=20, least_docs=3):
    """(doc_id, n_lines, n_dropped, digest) by a table of all keys."""
    held = collections.defaultdict(set)
    fold = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(_UPPER)
    low = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(fold(x)) >= least_chars:
                held[fold(x)].add(low(i))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if len(h := held.get(fold(x), ())) < least_docs or max(h) == low(i)]
        out.append((i, len(own), len(own) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return ordered(out)


def line_rows(seed=5, n=300):
    rng = np.random.default_rng(seed)
    pool = [f"{' ' * (k % 3)}Line number {k} that is LONG enough{chr(9) * (k % 2)}" for k in range(60)] + ["short", "", " \t", "Ünïcode line of TWENTY chars", "x" * 19, "y" * 20]
    rows = [(int(i), "\n".join(pool[min(int(k), len(pool) - 1)] for k in rng.zipf(1.3, rng.integers(0, 12)))) for i in rng.permutation(n)]
    hot = "the one line that a third of all have"
    return [(i, f"{hot}\n{t}\n{hot.upper()}" if i % 3 == 0 else t) for i, t in rows] + [(None, None), (None, pool[0]), (None, pool[0]), (7, pool[1]), (7, "another row of this id\n" + pool[0]), (-3, ""), (2**60, "\n\n")]


@pytest.mark.parametrize("rows", [line_rows(), [(r[0], r[1]) for r in ROWS], []])
def test_lines_against_a_table(spark, rows):
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumns({n: F.lit("clash") for n in ("pos", "keep", "lines", "n_dropped", "c0", "g", "line", "key")})
    assert ordered(lines.query(df).collect()) == cut_lines(rows)


def test_lines_without_hot_keys_and_with_others(spark, monkeypatch):
    rows = line_rows(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = cut_lines(rows)
    for hot in (1, 2, 50):
        monkeypatch.setattr(lines, "HOT", hot)
        assert ordered(lines.query(df).collect()) == want


def test_ranges_are_the_only_exchange_of_lines(spark):
    df = spark.createDataFrame(line_rows(), "doc_id long, text string")
    plan = lines.dropped(df)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "hashpartitioning(h" not in plan.split("Union")[0] and "Python" not in plan and "Pandas" not in plan
    deals = re.findall(r"Exchange (\w+)\((h#\d+L?)", plan)
    assert sum(kind == "rangepartitioning" for kind, _ in deals) == 1


def test_bitmaps_are_runs_of_what_stays(spark):
    same = "a line that many documents share"
    rows = [(i, f"{i} first\n{same}\n{same}\n{i} middle\n{same}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_dropped, [tuple(x) for x in r.keep]) for r in lines.keep_bitmaps(df).collect()}
    assert set(got) == {0, 1, 2} and all(n == 3 and runs[:2] == [(0, 1), (3, 1)] and runs[2][0] == 5 for n, runs in got.values())
    out = {r.doc_id: r.text for r in lines.cut(df).collect()}
    assert out == {i: f"{i} first\n{i} middle" if i < 3 else rows[3][1] for i in range(4)}


def test_cut_keeps_rows_and_columns(spark):
    docs = clashing(documents(spark, ROWS * 2))
    out = lines.cut(docs)
    assert out.columns == docs.columns and out.count() == 2 * len(ROWS) and out.where("text IS NULL").count() == 2


# --- divergence


def audited(rows, least=30):
    """(lang, source, part, item, value, rank) by every term in every source."""
    split = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    n, df = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        own = split.findall(text.translate(_UPPER))
        n[lang, source].update(own)
        df[lang].update(set(own))
    out = []
    for lang in {k for k, _ in n}:
        kept = sorted(t for t, d in df[lang].items() if d >= least)
        share = lambda c, kept=kept: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        own = {s: c for (g, s), c in n.items() if g == lang}
        p = {s: share(c) for s, c in own.items()}
        q = share(sum(own.values(), collections.Counter()))
        for s in own:
            parts = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s], "term": [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[: 50 if part == "term" else None], 1)]
    return ordered(out)


def divergence_rows(seed=2):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(120)] + ["Élan", "ÉLAN", "日本語", "𝔘ni"]
    rows = []
    for i in range(400):
        source = "hot" if i % 3 else [None, "b", "c", "d'e", "empty"][rng.integers(5)]
        lang = [None, "en", "de"][rng.integers(3)]
        text = " ".join(words[k].upper() if k % 7 == 0 else words[k] + str(k) for k in np.minimum(rng.zipf(1.2, rng.integers(0, 60)), len(words) - 1)) if source != "empty" else [None, "", "12 34 _-!"][rng.integers(3)]
        rows.append((lang, source, text))
    return rows + [("one", "a", "some words here"), ("one", "b", None), ("alone", "a", "x " * 40)]


@pytest.mark.parametrize("rows", [divergence_rows(), [(r[2], r[3], r[1]) for r in ROWS], []])
def test_divergence(spark, rows):
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({n: F.lit("clash") for n in ("doc_id", "term", "n", "docs", "p", "q", "p0", "v", "held", "total", "value", "rank", "item", "part")})
    assert ordered(divergence.query(df).collect()) == audited(rows)


def test_divergence_counts_in_small_tables(spark):
    rows = divergence_rows(3)
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    few, many = (ordered(divergence.counted(df, held).collect()) for held in (5, 10**6))
    assert few == many


def test_divergence_is_exact_for_large_counts(spark):
    n, total, v = 4 * 10**15 + 1, 9 * 10**15, 12_345_678
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence._p("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * v)


# --- search


def searched(rows, items, top=10):
    """(item_id, rank, doc_id, score) by scoring everything."""
    split = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    docs = [(-(2**63) if i is None else i, split.findall((t or "").translate(_UPPER))) for i, t in rows]
    docs = [(i, collections.Counter(t), len(t)) for i, t in docs if t]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        asked = set(split.findall((text or "").translate(_UPPER)))
        found = []
        for i, c, n in docs:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0:
                found.append((-s, i))
        out += [(item, k, None if i == -(2**63) else i, -s) for k, (s, i) in enumerate(sorted(found)[:top], 1)]
    return ordered(out)


def search_rows(seed=4):
    rng = np.random.default_rng(seed)
    word = lambda: f"t{int(rng.zipf(1.15)) % 900}"
    rows = [(int(i), " ".join(word() for _ in range(rng.integers(0, 80)))) for i in rng.permutation(700)]
    copy = "an exact passage that is copied very often"
    rows += [(1000 + i, copy) for i in range(300)] + [(None, "t1 t2 t3"), (None, "t1 t2 t3"), (5, None), (6, ""), (7, "?! --"), (8, "t5 " * 9000), (9, "ÉLAN Élan t7")]
    items = [(k, " ".join(word() for _ in range(rng.integers(1, 40)))) for k in range(40)] + [(40, copy), (40, copy), (41, None), (42, ""), (43, "nowhere"), (44, "ÉLAN T7"), (None, "t1 t2"), (45, " ".join(f"t{k}" for k in range(900)))]
    return rows, items


def test_search(spark):
    rows, items = search_rows()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({n: F.lit("clash") for n in ("doc_id", "rank", "score", "item", "terms", "n", "id")})
    assert ordered(search.query(df, asked).collect()) == searched(rows, items)


def test_search_in_small_blocks(spark, monkeypatch):
    """Blocks of the index and of the items may end anywhere."""
    rows, items = search_rows(8)
    df, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(search, "ITEM_TERMS", 300)
    index = search.Index(df)
    assert ordered(index.search(asked).collect()) == searched(rows, items)
    assert ordered(index.search(asked, 3).collect()) == searched(rows, items, 3)


def test_small_index_blocks():
    """The heaps of many blocks are those of one."""
    rows, items = search_rows(9)
    docs = [(i, search.terms(t)) for i, t in rows if i is not None and search.terms(t)]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    df = collections.Counter(x for _, t in docs for x in set(t))
    asked = [(k, [(t, w) for t in sorted(set(search.terms(text))) if t in df and (w := search.weight(df[t], n_docs)) > 0]) for k, (_, text) in enumerate(items)]
    found = []
    for size in (1, 7, 250, 10**6):
        best = {k: [] for k, _ in asked}
        for at in range(0, len(docs), size):
            block = search._Building(n_docs, n_terms)
            for i, t in docs[at : at + size]:
                block.add(i, t)
            search._Block(block.row().to_pylist()[0]).into(best, asked, 10)
        found.append({k: sorted(h) for k, h in best.items()})
    assert all(x == found[0] for x in found)


def test_bytes_are_upper_bounds():
    counts, norms = np.random.default_rng(1).integers(1, 10**6, 10_000), np.random.default_rng(2).integers(10, 10**7, 10_000)
    exact = search.impacts(counts, norms)
    raised = -(-exact // search.STEP)
    assert (raised <= 255).all() and (raised * search.STEP >= exact).all() and ((raised - 1) * search.STEP < exact).all()


def test_search_of_nothing(spark):
    none = documents(spark, [])
    asked = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert search.query(none, asked).count() == 0 and search.query(documents(spark), asked.where("false")).count() == 0
