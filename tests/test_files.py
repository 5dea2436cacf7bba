"""Files with one planted leak each, end to end through Spark."""

from __future__ import annotations

import io
import json
import os

import pytest
from pdf_files import CORRUPT, FILES, LOCKED, ROTATED

from palimpsest.functions.exprs import SEVERITIES
from palimpsest.plans import cli
from palimpsest.plans.engine import Engine
from palimpsest.sources import files
from palimpsest.sources.pdf.extract import Clock, files_of, read, revision_ends
from palimpsest.sources.pdf.objects import File

#: file: detector, severity, what its evidence must hold
EXPECTED = {
    "box_over_text": ("covered_text", "critical", "532-11-0947"), "white_box_over_text": ("covered_text", "high", "7003-1182"), "grey_box": ("covered_text", "high", "532-11-0947"), "cmyk_box": ("covered_text", "critical", "532-11-0947"),
    "cover_in_form": ("covered_text", "critical", "660071"), "image_cover": ("covered_text", "high", "9072"), "text_form": ("covered_text", "high", "Figuretext"), "invisible_text": ("hidden_text", "critical", "Ilse 9034"),
    "invisible_in_form": ("hidden_text", "critical", "formsecret"), "saved_state": ("hidden_text", "critical", "hidden"), "white_on_white": ("hidden_text", "critical", "Tomas5521"), "tiny_text": ("hidden_text", "critical", "tinysecret"),
    "off_page": ("hidden_text", "critical", "outside"), "incremental_redaction": ("revision_history", "critical", "815500 Borealis"), "retained_history": ("revision_history", "low", "1 incremental"), "embedded_file": ("embedded_files", "high", "stipends.csv (14 bytes)"),
    "file_annotation": ("embedded_files", "high", "ledger.csv (4 bytes)"), "associated_file": ("embedded_files", "high", "af.bin (unknown size)"), "metadata_leak": ("metadata", "medium", "DOCKET-71-B"), "xmp_only": ("metadata", "medium", "Olu Farrow"),
    "xmp_entities": ("metadata", "info", "XMP packet"), "page_xmp": ("metadata", "info", "page-level"), "unapplied_redact": ("redact_annotations", "critical", "under redaction: Nadiaunder | Contents: Nadia Brandt | OverlayText: REDACTED"), "sticky_note": ("redact_annotations", "info", "/Text: ring Petra"),
}
EXPECTED |= dict.fromkeys((*LOCKED, "rotated"), ("covered_text", "critical", "532-11-0947"))
QUIET = ("outline_only", "page_background", "white_on_dark", "literal_eof", "clean")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("pdfs")
    for name, raw in (FILES | LOCKED | CORRUPT | {"rotated": ROTATED}).items():
        (at / f"{name}.pdf").write_bytes(raw)
    return at


@pytest.fixture(scope="module")
def reports(spark, folder, tmp_path_factory):
    tables = files.load(spark, f"file://{folder}", f"file://{tmp_path_factory.mktemp('rows')}/rows")
    rows = Engine().reports(tables).collect()
    return {os.path.basename(r.path)[:-4]: r for r in rows}


@pytest.mark.parametrize("name", EXPECTED)
def test_leak_is_found(reports, name):
    vector, severity, text = EXPECTED[name]
    found = [f for f in reports[name].findings if f.vector == vector]
    assert any(text in f.evidence and f.severity == severity for f in found), found
    assert reports[name].detector_errors == {}


@pytest.mark.parametrize("name", QUIET)
def test_nothing_is_found(reports, name):
    r = reports[name]
    if name == "white_on_dark":  # text drawn over a box counts as covered, but not as hidden
        assert {f.vector for f in r.findings} == {"covered_text"}
    else:
        assert r.findings == [] and r.clean and r.exit_code == 0 and r.stamp == "CLEAN"


def test_one_leak_is_one_leak(reports):
    assert {f.vector for f in reports["box_over_text"].findings} == {"covered_text"}
    assert sum(f.vector == "hidden_text" for f in reports["saved_state"].findings) == 1
    shown = [f for f in reports["invisible_in_form"].findings if f.vector == "hidden_text"]
    assert all("visible" not in f.evidence for f in shown)


def test_xmp_repeats_information_once(reports):
    values = [f.evidence for f in reports["metadata_leak"].findings if "Olu" in f.evidence]
    assert values == ["/Author = Olu Farrow"]


@pytest.mark.parametrize("name", CORRUPT)
def test_unreadable_is_never_clean(reports, name):
    r = reports[name]
    assert not r.clean and r.incomplete and r.exit_code == 3 and r.stamp == "PARTIAL"


def test_worst_first(reports):
    order = [SEVERITIES.index(f.severity) for f in reports["metadata_leak"].findings]
    assert order == sorted(order, reverse=True)


def test_box_of_cover(reports):
    (f,) = reports["box_over_text"].findings
    assert f.page == 1 and f.bbox == [70.0, 694.0, 430.0, 716.0]


def test_oversize_is_an_error(spark, folder, tmp_path):
    tables = files.load(spark, f"file://{folder}/clean.pdf", f"file://{tmp_path}/rows", most=16)
    (r,) = Engine().reports(tables).collect()
    assert r.incomplete and "over the limit" in r.detector_errors["open"]


def test_own_detector_and_only(spark, folder, tmp_path):
    from palimpsest.operators.findings import finding
    from pyspark.sql import functions as F

    tables = files.load(spark, f"file://{folder}/clean.pdf", f"file://{tmp_path}/rows")
    engine = Engine()
    engine.detectors["mine"] = lambda t: finding(t.docs, "mine", "low", F.lit("d"), F.lit("e"), "r")
    assert [r.vector for r in engine.findings(tables, ["mine"]).collect()] == ["mine"]
    with pytest.raises(ValueError, match="ghost"):
        engine.findings(tables, ["ghost"])


def test_failed_detector_has_no_findings(spark, folder, tmp_path):
    tables = files.load(spark, f"file://{folder}/box_over_text.pdf", f"file://{tmp_path}/rows")
    i = tables.docs.first().doc_id
    tables.errors = spark.createDataFrame([(i, "covered_text", "RuntimeError: x")], "doc_id long, detector string, message string")
    (r,) = Engine().reports(tables).collect()
    assert r.findings == [] and r.detector_errors == {"covered_text": "RuntimeError: x"} and r.exit_code == 3


def test_command_line(spark, folder, tmp_path, capsys):
    def run(*args):
        out = io.StringIO()
        return cli.main(list(args), spark, out), out.getvalue()

    assert run("list-vectors") == (0, "covered_text\nhidden_text\nrevision_history\nembedded_files\nmetadata\nredact_annotations\n")
    code, text = run("scan", f"file://{folder}/box_over_text.pdf", "--json", "--to", f"file://{tmp_path}/a")
    assert code == 2 and json.loads(text)["worst_severity"] == "critical"
    code, text = run("scan", f"file://{folder}/box_over_text.pdf", "--no-color", "--only", "metadata,", "--to", f"file://{tmp_path}/b")
    assert code == 0 and "Nothing recoverable" in text
    assert run("scan", f"file://{folder}/metadata_leak.pdf", "--fail-on", "medium", "--to", f"file://{tmp_path}/c")[0] == 2
    assert run("scan", f"file://{folder}/clean.pdf", "--only", "ghost")[0] == 1
    assert run("scan", f"file://{folder}/absent.pdf", "--to", f"file://{tmp_path}/d")[0] == 1
    assert run("scan", f"file://{folder}/no_header.pdf", "--to", f"file://{tmp_path}/e")[0] == 1


def test_stream(spark, folder, tmp_path):
    from palimpsest.streaming.ingest import audit

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(FILES["box_over_text"])
    audit(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    (r,) = spark.read.parquet(f"file://{tmp_path}/out/reports").collect()
    assert r.worst_severity == "critical"


def test_stream_reports_files_over_the_limit(spark, tmp_path):
    from palimpsest.streaming.ingest import audit

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(FILES["box_over_text"])
    (tmp_path / "in/big.pdf").write_bytes(FILES["clean"] + b"%" * 5000)
    audit(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp", most=5000).awaitTermination()
    by = {os.path.basename(r.path): r for r in spark.read.parquet(f"file://{tmp_path}/out/reports").collect()}
    assert by["a.pdf"].worst_severity == "critical"
    assert by["big.pdf"].incomplete and not by["big.pdf"].clean and "over the limit" in by["big.pdf"].detector_errors["open"]


def slow_file():
    from pdf_files import line, page

    return page(line(b"some text to lay out") * 60_000)


def test_two_late_phases_are_one_error(spark, tmp_path):
    """A file that overruns in two phases of one detector leaves its neighbours their reports."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/good.pdf").write_bytes(FILES["box_over_text"])
    (tmp_path / "in/slow.pdf").write_bytes(slow_file())
    tables = files.load(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/rows", seconds=0.3)
    by = {os.path.basename(r.path): r for r in Engine().reports(tables).collect()}
    assert by["good.pdf"].worst_severity == "critical" and by["good.pdf"].detector_errors == {}
    late = by["slow.pdf"].detector_errors
    assert late["hidden_text"] == late["covered_text"] == "TimeoutError: time limit of 0.3 s exceeded" and by["slow.pdf"].exit_code == 3


def test_two_errors_of_one_detector(spark, folder, tmp_path):
    tables = files.load(spark, f"file://{folder}/box_over_text.pdf", f"file://{tmp_path}/rows")
    i = tables.docs.first().doc_id
    tables.errors = spark.createDataFrame([(i, "metadata", "a"), (i, "metadata", "b"), (i, None, "c"), (i, "open", None)], "doc_id long, detector string, message string")
    (r,) = Engine().reports(tables).collect()
    assert r.detector_errors == {"metadata": "b", "open": "c"} and r.worst_severity == "critical"


def test_a_detector_that_raises(spark, folder, tmp_path):
    """While it is planned, or while it runs: the others go on, and no document is clean."""
    from palimpsest.operators.findings import finding
    from pyspark.sql import functions as F

    tables = files.load(spark, f"file://{folder}/box_over_text.pdf", f"file://{tmp_path}/rows")

    def planned(t):
        raise RuntimeError("x" * 5000 + "\nsecond line")

    def running(t):
        return finding(t.docs, "running", "low", F.raise_error(F.lit("boom")).cast("string"), F.lit("e"), "r")

    engine = Engine()
    engine.detectors |= {"planned": planned, "running": running, "shapeless": lambda t: t.docs}
    (r,) = engine.reports(tables, to=f"file://{tmp_path}/findings").collect()
    assert set(r.detector_errors) == {"planned", "running", "shapeless"} and r.worst_severity == "critical" and r.incomplete
    assert r.detector_errors["planned"].startswith("RuntimeError: xx") and all("\n" not in x and len(x) < 250 for x in r.detector_errors.values())
    only = Engine({"planned": planned})
    (r,) = only.reports(tables).collect()
    assert r.findings == [] and r.exit_code == 3 and only.findings(tables).count() == 0


def test_time_limit():
    import contextlib
    import time

    def work():
        for _ in range(20):
            with contextlib.suppress(Exception):  # what a phase suppresses, its end is not
                time.sleep(1)

    began = time.time()
    assert "time limit of 0.1 s" in str(Clock(0.1).phase(work)) and time.time() - began < 0.9
    assert Clock(5).phase(lambda: None) is None and isinstance(Clock(0).phase(lambda: 1 / 0), ZeroDivisionError)


def test_attachment_sources():
    f = File(FILES["embedded_file"])
    assert [(x["source_ord"], x["name"], x["size"]) for x in files_of(f, f.pages())] == [(1, "stipends.csv", 14), (2, "stipends.csv", 14)]


def test_what_is_no_file(spark, folder, tmp_path):
    assert cli.main(["scan", "file:///dev/null", "--to", f"file://{tmp_path}/a"], spark, io.StringIO()) == 1
    (tmp_path / "folder.pdf").mkdir()
    assert cli.main(["scan", f"file://{tmp_path}/folder.pdf", "--to", f"file://{tmp_path}/b"], spark, io.StringIO()) == 1


def test_aes_vectors():
    """Examples of FIPS 197."""
    from palimpsest.sources.pdf.aes import Aes

    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        a = Aes(bytes(range(n)))
        assert a.encrypt(block, bytes(16)).hex() == want and a.decrypt(bytes.fromhex(want), bytes(16)) == block


def test_revision_ends():
    assert len(revision_ends(FILES["incremental_redaction"])) == 2
    assert len(revision_ends(FILES["literal_eof"])) == 1
    assert revision_ends(b"") == []


def test_many_revisions_are_capped():
    from pdf_files import line, page, stream, updated

    raw = page(line(b"first 1"))
    for n in range(70):
        raw = updated(raw, 4, stream(line(b"text %d" % n)))
    status, rows = read(raw)
    texts = rows[0]["revisions"]
    assert status == "ok" and len(texts) == 71 and texts[0]["text"] == "first 1" and texts[69]["text"] == "" and texts[-1]["text"] == "text 69"
