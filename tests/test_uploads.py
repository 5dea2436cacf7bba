"""Uploads as a stream: once scanned, reported under each name, through replays and restarts."""

from __future__ import annotations

import os
import shutil

import pytest
from pdf_files import FILES

from palimpsest.streaming import uploads


def names(spark, to):
    return sorted((os.path.basename(r.path), r.uploaded, r.worst_severity) for r in uploads.reports(spark, to).collect())


def test_what_comes_twice_is_scanned_once(spark, tmp_path):
    inbox, to, cp = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp"
    inbox.mkdir()

    def receive(**more):
        uploads.receive(spark, f"file://{inbox}", to, cp, **more).awaitTermination()

    (inbox / "a.pdf").write_bytes(FILES["box_over_text"])
    (inbox / "copy of a.pdf").write_bytes(FILES["box_over_text"])
    (inbox / "b.pdf").write_bytes(FILES["clean"])
    receive()
    assert names(spark, to) == [("a.pdf", 0, "critical"), ("b.pdf", 0, None), ("copy of a.pdf", 0, "critical")]
    assert spark.read.parquet(f"{to}/reports").count() == 2

    # a new query from the same checkpoint: what is remembered isn't scanned again
    (inbox / "again.pdf").write_bytes(FILES["box_over_text"])
    (inbox / "c.pdf").write_bytes(FILES["metadata_leak"])
    receive()
    assert names(spark, to) == [("a.pdf", 0, "critical"), ("again.pdf", 1, "critical"), ("b.pdf", 0, None), ("c.pdf", 1, "medium"), ("copy of a.pdf", 0, "critical")]
    assert spark.read.parquet(f"{to}/reports").count() == 3

    # the last batch is replayed: its commit is lost, and the outcome is the same
    before = names(spark, to)
    os.remove(tmp_path / "cp/commits/1")
    for x in (tmp_path / "cp/commits").glob(".1.crc"):
        os.remove(x)
    shutil.rmtree(tmp_path / "out/reports/batch=1")
    receive()
    assert names(spark, to) == before and spark.read.parquet(f"{to}/reports").count() == 3


def test_what_is_forgotten_and_what_is_too_large(spark, tmp_path):
    """Files over the limit stand for themselves; after its time a content is scanned anew, and uploads keep the report of their time."""
    (tmp_path / "in").mkdir()
    for name in ("x.pdf", "y.pdf"):
        (tmp_path / "in" / name).write_bytes(FILES["clean"] + b"%" * 5000)

    def receive():
        uploads.receive(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp", most=5000, remembered=1).awaitTermination()
        return {os.path.basename(r.path): r for r in uploads.reports(spark, f"file://{tmp_path}/out").collect()}

    (tmp_path / "in/a.pdf").write_bytes(FILES["clean"])
    first = receive()
    assert set(first) == {"a.pdf", "x.pdf", "y.pdf"} and first["a.pdf"].clean
    assert all(first[x].incomplete and "over the limit" in first[x].detector_errors["open"] for x in ("x.pdf", "y.pdf"))
    (tmp_path / "in/b.pdf").write_bytes(FILES["clean"])
    again = receive()
    fresh = {os.path.basename(r.path): r.fresh for r in spark.read.parquet(f"file://{tmp_path}/out/uploads").collect()}
    assert fresh == {"a.pdf": True, "b.pdf": True, "x.pdf": True, "y.pdf": True} and again["b.pdf"].clean and len(again) == 4


def test_a_store_that_workers_cannot_open(spark):
    with pytest.raises(ValueError, match="store"):
        uploads.receive(spark, "viewfs://x/in", "file:///tmp/none", "file:///tmp/none")
