"""Isolation by document, opaque detectors, the pruned source, and the sink."""

from __future__ import annotations

import io
import json
import os
import time

import pytest
from pdf_files import CORRUPT, FILES
from pyspark.sql import functions as F

from palimpsest.operators import report
from palimpsest.operators.findings import finding
from palimpsest.plans import cli, engine
from palimpsest.plans.engine import Engine, Tables
from palimpsest.plans.opaque import Opaque, checked
from palimpsest.schema import ANNOTS, DOCS, ERRORS, FILESPECS, INFO, LAYOUT, REVISIONS, STREAM_OPS, XMP, XMP_FIELDS
from palimpsest.sources import datasource, files


def tables_of(spark, n, at):
    """``n`` documents with a page each and nothing on it, as tables."""
    rows = {"docs": DOCS, "stream_ops": STREAM_OPS, "revisions": REVISIONS, "filespecs": FILESPECS, "info": INFO, "xmp": XMP, "xmp_fields": XMP_FIELDS, "annots": ANNOTS, "errors": ERRORS, "layout": LAYOUT}
    made = {k: spark.createDataFrame([], v) for k, v in rows.items()}
    made["docs"] = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit(1).cast("long").alias("length"), F.lit("ok").alias("open_status"))
    made["layout"] = spark.createDataFrame([(i, 1, 0.0, 0.0, 9.0, 9.0, False, [], []) for i in range(n)], LAYOUT)
    made["docs"].write.parquet(f"file://{at}/docs")
    return Tables(**made | {"docs": spark.read.parquet(f"file://{at}/docs")})


def raising(on):
    return lambda t: finding(t.docs, "mine", "low", F.when(F.col("doc_id").isin(*on), F.raise_error(F.lit("poisoned row")).cast("string")).otherwise(F.col("path")), F.lit("e"), "r")


@pytest.mark.parametrize(("n", "on"), [(100, [41]), (12, [3, 7, 8])])
def test_bad_documents_cost_only_themselves(spark, tmp_path, n, on):
    tables = tables_of(spark, n, tmp_path)
    good = lambda t: finding(t.docs, "good", "low", F.lit("d"), F.lit("e"), "r")
    rows = {r.doc_id: r for r in Engine({"mine": raising(on), "good": good}).reports(tables, to=f"file://{tmp_path}/to").collect()}
    assert len(rows) == n
    for i, r in rows.items():
        if i in on:
            assert set(r.detector_errors) == {"mine"} and "poisoned row" in r.detector_errors["mine"] and [f.vector for f in r.findings] == ["good"] and r.incomplete
        else:
            assert r.detector_errors == {} and sorted(f.vector for f in r.findings) == ["good", "mine"]


def test_a_detector_that_fails_everywhere(spark, tmp_path):
    tables, runs = tables_of(spark, 100, tmp_path), []

    def broken(t):
        runs.append(1)
        return raising(range(100))(t)

    rows = Engine({"mine": broken}).reports(tables, to=f"file://{tmp_path}/to").collect()
    assert len(rows) == 100 and all(r.incomplete and not r.clean and set(r.detector_errors) == {"mine"} for r in rows) and len(runs) <= 16


def test_tries_are_bounded_and_none_is_clean(spark, tmp_path):
    on = list(range(0, 100, 9))
    got = engine.isolated(raising(on), tables_of(spark, 100, tmp_path), f"file://{tmp_path}/to", tries=20)
    failed = {r.doc_id for part in got.errors for r in part.collect()}
    found = {r.doc_id for part in got.rows for r in part.collect()}
    assert set(on) <= failed and not failed & found and failed | found == set(range(100))


def test_failures_of_machines_are_raised(spark, tmp_path):
    tables = tables_of(spark, 4, tmp_path)
    full = lambda t: finding(t.docs, "mine", "low", F.raise_error(F.lit("java.io.IOException: No space left on device")).cast("string"), F.lit("e"), "r")
    with pytest.raises(Exception, match="No space left"):
        Engine({"mine": full}).reports(tables, to=f"file://{tmp_path}/to")


def test_opaque_detectors(spark, tmp_path):
    """One raises, one sleeps, one gives what is no finding, one works: each costs its own documents alone."""

    def slow(rows):
        if rows[0]["doc_id"] == 2:
            time.sleep(3)
        return []

    def boom(rows):
        if rows[0]["doc_id"] == 1:
            raise RuntimeError("x" * 5000 + "\nsecond line")
        return [dict(severity="low", description="d", evidence=f"page {rows[0]['page']}", page=1, bbox=[1, 2, 3, 4])]

    def shapeless(rows):
        return {0: ["text"], 1: [dict(severity="dire")], 2: [dict(severity="low", evidence=5)], 3: [dict(severity="low", place=1)], 4: None}[rows[0]["doc_id"]]

    tables = tables_of(spark, 5, tmp_path)
    detectors = {"slow": Opaque("slow", slow, 0.3), "boom": Opaque("boom", boom), "shapeless": Opaque("shapeless", shapeless)}
    for to in (None, f"file://{tmp_path}/to"):
        rows = {r.doc_id: r for r in Engine(detectors).reports(tables, to=to).collect()}
        assert rows[2].detector_errors["slow"] == "TimeoutError: time limit of 0.3 s exceeded"
        assert rows[1].detector_errors["boom"].startswith("RuntimeError: xx") and "\n" not in rows[1].detector_errors["boom"] and len(rows[1].detector_errors["boom"]) < 250
        assert {i: "shapeless" in r.detector_errors for i, r in rows.items()} == {0: True, 1: True, 2: True, 3: True, 4: False}
        assert {i: [f.evidence for f in r.findings] for i, r in rows.items()} == {i: [] if i == 1 else ["page 1"] for i in range(5)}
        assert rows[0].findings[0].bbox == [1.0, 2.0, 3.0, 4.0] and rows[4].detector_errors == {}


def test_what_is_no_finding():
    for bad in ("x", dict(severity="low", more=1), dict(severity=None), dict(severity="low", description=1), dict(severity="low", page="1"), dict(severity="low", bbox=[1, 2]), dict(severity="low", page=True)):
        with pytest.raises((TypeError, ValueError)):
            checked(bad)
    assert checked(dict(severity="info", bbox=(1, 2, 3, 4)))["bbox"] == [1.0, 2.0, 3.0, 4.0]


# --- the source


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("source")
    for name, raw in (FILES | CORRUPT).items():
        (at / f"{name}.pdf").write_bytes(raw)
    (at / "notes.txt").write_text("no pdf")
    (at / "_hidden.pdf").write_bytes(FILES["clean"])
    (at / "deep/er").mkdir(parents=True)
    (at / "deep/er/below.pdf").write_bytes(FILES["clean"])
    return at


def test_no_exchange_above_the_scan(spark, folder):
    for df in (files.parsed(spark, f"file://{folder}"), files.extracted(files.scan(spark, f"file://{folder}"))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_both_readers_give_the_same_rows(spark, folder):
    own = files.parsed(spark, f"file://{folder}").drop("phases")
    other = files.extracted(files.scan(spark, f"file://{folder}")).drop("phases")
    names = lambda df: sorted((os.path.basename(r.path), r.page, r.open_status, len(r.glyphs or ()), str(r.info), str(r.revisions), str(r.errors)) for r in df.collect())
    assert names(own) == names(other) and len({x[0] for x in names(own)}) == len(FILES) + len(CORRUPT) + 1


@pytest.mark.parametrize(("only", "want"), [(["metadata"], ["metadata"]), (["embedded_files", "metadata"], ["attachments", "metadata"]), (["redact_annotations"], ["layout", "annotations"]), (["own"], None), (None, None)])
def test_only_the_phases_that_are_needed(spark, folder, only, want):
    every = ["layout", "operators", "annotations", "attachments", "metadata", "revisions"]
    rows = files.parsed(spark, f"file://{folder}", only=only).where("page = 0 AND open_status = 'ok'").collect()
    assert rows and all(r.phases == (want or every) for r in rows)
    if only == ["metadata"]:
        pages = files.parsed(spark, f"file://{folder}", only=only).where("page > 0")
        assert pages.where("glyphs IS NOT NULL OR ops IS NOT NULL OR annots IS NOT NULL").isEmpty() and not pages.isEmpty()


@pytest.mark.parametrize("only", [["metadata"], ["covered_text"], ["hidden_text"], ["revision_history"], ["embedded_files"], ["redact_annotations"]])
def test_pruning_changes_no_finding(spark, folder, tmp_path, only):
    def found(name, phases):
        tables = files.load(spark, f"file://{folder}", f"file://{tmp_path}/{name}", only=phases)
        return sorted(map(str, Engine().findings(tables, only).collect())), sorted(map(str, Engine().errors(tables, only).collect()))

    assert found("pruned", only) == found("whole", None)


def test_shares_are_of_like_size():
    many = [(f"f{k}", (k * 7919) % 1000 * 10_000) for k in range(2000)]
    shares = datasource.dealt(many, 64 << 20)
    sizes = [sum(n + datasource.OPEN for _, n in x) for x in shares]
    assert sorted(f for x in shares for f in x) == sorted(many) and max(sizes) - min(sizes) < 12 << 20 and max(sizes) < 80 << 20
    assert datasource.dealt([]) == [] and len(datasource.dealt([("a", 10**12), ("b", 1)], 1 << 20, most=100)) <= 2


def test_a_file_that_goes_meanwhile(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(FILES["clean"])
    (tmp_path / "b.pdf").write_bytes(FILES["clean"])
    (tmp_path / "b.pdf").chmod(0)
    reader = datasource.FileReader({"path": f"file:{tmp_path}"}, files.source_schema())
    (tmp_path / "a.pdf").rename(tmp_path / "c.pdf")
    got = [r for share in [datasource.Share([(f"file:{tmp_path}/a.pdf", 5)])] for batch in reader.read(share) for r in batch.to_pylist()]
    assert [(r["open_status"], r["errors"][0]["kind"]) for r in got] == [("unreadable", "FileNotFoundError")]


def test_source_by_name(spark, folder):
    spark.dataSource.register(datasource.Files)
    rows = spark.read.format("palimpsest").option("only", "metadata").option("glob", "metadata*.pdf").load(f"file://{folder}").where("page = 0").collect()
    assert [os.path.basename(r.path) for r in rows] == ["metadata_leak.pdf"] and rows[0].info and rows[0].phases == ["metadata"]


# --- the sink


def test_reports_as_files(spark, folder, tmp_path):
    out = io.StringIO()
    args = ["scan", f"file://{folder}", "--json", "--to", f"file://{tmp_path}/to", "--out", f"file://{tmp_path}/out"]
    code = cli.main(args, spark, out)
    lines = spark.read.text(f"file://{tmp_path}/out/reports").collect()
    shown = [json.loads(r.value) for r in lines]
    (counts,) = spark.read.json(f"file://{tmp_path}/out/manifest").collect()
    n = len(FILES) + len(CORRUPT) + 1
    assert code == 2 and len(shown) == counts.documents == n and sum(x["finding_count"] for x in shown) == counts.findings
    assert counts.exit_0 + counts.exit_2 + counts.exit_3 == n and counts.exit_3 >= len(CORRUPT)
    assert {"CRITICAL", "CLEAN", "PARTIAL"} <= {r.stamp for r in lines} and out.getvalue().count("\n") == 1
    assert all(json.loads(r.value)["worst_severity"] == (None if r.stamp in ("CLEAN", "PARTIAL") else r.stamp.lower()) for r in lines)


def test_exit_codes_of_counts():
    assert [report.exit_code(dict(exit_0=a, exit_2=b, exit_3=c)) for a, b, c in ((1, 0, 0), (1, 1, 1), (1, 0, 1), (0, 0, 0))] == [0, 2, 3, 0]


def test_text_report(spark, folder, tmp_path):
    tables = files.load(spark, f"file://{folder}/metadata_leak.pdf", f"file://{tmp_path}/rows")
    (row,) = report.as_text(Engine().reports(tables)).collect()
    lines = row.text.split("\n")
    assert lines[0].startswith("MEDIUM  ") and lines[1].startswith("Found: ") and lines[2] == "metadata" and "  medium: " in lines[3]
    (row,) = report.as_text(Engine().reports(tables), color=True).collect()
    assert "\x1b[33m" in row.text and "\x1b[0m" in row.text
