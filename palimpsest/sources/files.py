"""Files to tables (S1, S2, S22, C1-C4, P15): a guarded scan, one parse, one Parquet table, ten views of it.

Where Python can open the store by itself, files are dealt to tasks by path and length and opened there (:mod:`.datasource`); else Spark's own
reader packs them. Files over the limit are never read. Each file is parsed once, as far as the
chosen detectors need; its rows are written as Parquet, and every normalised table is a projection of that,
so a detector reads only the columns it needs, and no content ever reaches a shuffle.
"""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.report import error_line
from ..plans.engine import Tables
from ..schema import _BOX, _COVER, _GLYPH
from . import datasource

#: Largest file that is read.
MOST = 512 << 20
SECONDS = 60.0
SOURCE = f"""path string, length bigint, open_status string, page int, x0 double, y0 double, x1 double, y1 double, has_metadata boolean,
glyphs array<struct<{_GLYPH}>>, covers array<struct<{_COVER}>>, ops array<struct<seq: bigint, op: string, int_arg: int, shown: binary, depth: int>>,
annots array<struct<ord: int, subtype: string, rect: array<double>, contents: string, rc: string, overlay_text: string>>,
files array<struct<source_ord: int, ord: int, name: string, size: bigint>>, info array<struct<ord: int, key: string, value: string>>, has_xmp boolean, xmp_bytes bigint,
xmp_fields array<struct<ord: int, name: string, value: string>>, revisions array<struct<rev_index: int, text: string>>, errors array<struct<detector: string, kind: string, message: string>>, phases array<string>"""


def row_schema() -> StructType:
    return StructType.fromDDL(f"doc_id bigint, {SOURCE}")


def source_schema() -> StructType:
    """Rows as a worker makes them, which doesn't know the number that Spark gives to a path."""
    return StructType.fromDDL(SOURCE)


def rows_of(path: str, length: int, content: Callable[[], bytes], most: int = MOST, seconds: float = SECONDS, only: list[str] | None = None) -> list[dict]:
    """One row for each page and one, page 0, for the document. A file that is too large or can't be fetched has its error there."""
    from .pdf.extract import read

    def failed(status: str, kind: str | None, message: str) -> tuple[str, list[dict]]:
        return status, [dict(page=0, errors=[dict(detector=None, kind=kind, message=message)], phases=[])]

    if length > most:
        status, rows = failed("oversize", None, "file is over the limit")
    else:
        try:
            raw = content()
        except OSError as e:  # it went, or may not be read
            status, rows = failed("unreadable", type(e).__name__, "file can't be read")
        else:
            status, rows = read(raw, seconds, only)
    return [{"path": path, "length": length, "open_status": status} | r for r in rows]


def work_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of this machine only where Spark runs on it alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("name a folder that driver and executors share, or set spark.checkpoint.dir")
        base = f"file://{tempfile.gettempdir()}"
    return base.rstrip("/")


def scan(spark: SparkSession, path: str, glob: str = "*.pdf", most: int = MOST, stream: bool = False) -> DataFrame:
    """(path, length, content) of all files, content null where the file is over the limit: the reader is told the length first."""
    reader = spark.readStream if stream else spark.read
    files = reader.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    rows = (files.schema("path string, modificationTime timestamp, length long, content binary") if stream else files).load(path)
    small = rows.where(F.col("length") <= most).select("path", "length", "content")
    return small.unionByName(rows.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content")))


def extracted(files: DataFrame, seconds: float = SECONDS, only: list[str] | None = None) -> DataFrame:
    """One row for each page and one, page 0, for each document; files: path, length, content, which is null where the file is over the limit."""
    names = [f.name for f in source_schema()]

    def of(batches):
        for batch in batches:
            for path, length, content in zip(batch["path"], batch["length"], batch["content"]):
                out = rows_of(path, length, lambda content=content: bytes(content), -1 if content is None else length, seconds, only)
                yield pd.DataFrame([{n: r.get(n) for n in names} for r in out], columns=names).astype(object)

    return numbered(files.select("path", "length", "content").mapInPandas(of, source_schema()))


def numbered(rows: DataFrame) -> DataFrame:
    return rows.select(F.xxhash64("path").alias("doc_id"), *rows.columns)


def opened(uploads: DataFrame, most: int = MOST, seconds: float = SECONDS, only: list[str] | None = None) -> DataFrame:
    """Rows of :func:`extracted` of files that the workers open themselves, numbered by their content; uploads: content (any text that names it), path, length."""
    fields = to_arrow_schema(StructType.fromDDL(f"content string, {SOURCE}"))

    def of(batches):
        for batch in batches:
            for content, path, length in zip(*(batch.column(c).to_pylist() for c in ("content", "path", "length"))):
                rows = rows_of(path, length, lambda path=path: datasource.content(path), most, seconds, only)
                yield pa.RecordBatch.from_pylist([{"content": content} | r for r in rows], fields)

    rows = uploads.select("content", "path", "length").mapInArrow(of, from_arrow_schema(fields))
    return rows.select(F.xxhash64("content").alias("doc_id"), *(f.name for f in source_schema()))


def parsed(spark: SparkSession, path: str, most: int = MOST, seconds: float = SECONDS, only: list[str] | None = None) -> DataFrame:
    """Rows of :func:`extracted` of the files under ``path``; nothing is exchanged on the way."""
    if datasource.direct(path):
        spark.dataSource.register(datasource.Files)
        source = spark.read.format("palimpsest").options(most=most, seconds=seconds, only=",".join(only or []), share=_share(spark))
        return numbered(source.load(path))
    return extracted(scan(spark, path, most=most), seconds, only)


def _share(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def tables(rows: DataFrame) -> Tables:
    """Normalised tables from rows of :func:`extracted`."""
    doc, page = rows.where("page = 0"), rows.where("page > 0")

    def opened(df: DataFrame, column: str, *keys: str) -> DataFrame:
        return df.select(*keys, F.explode(column).alias("x")).select(*keys, "x.*")

    return Tables(
        docs=doc.select("doc_id", "path", "length", "open_status"),
        layout=page.select("doc_id", "page", "x0", "y0", "x1", "y1", "has_metadata", "glyphs", "covers", "annots"),
        stream_ops=page.select("doc_id", "page", "ops"), annots=opened(page, "annots", "doc_id", "page"), revisions=doc.select("doc_id", "revisions"), filespecs=opened(doc, "files", "doc_id"),
        info=opened(doc, "info", "doc_id"), xmp=doc.where("has_xmp").select("doc_id", F.col("xmp_bytes").alias("bytes")), xmp_fields=opened(doc, "xmp_fields", "doc_id"), errors=opened(doc, "errors", "doc_id").select("doc_id", "detector", error_line(F.col("kind"), F.col("message")).alias("message")),
    )


@contextlib.contextmanager
def few_in_a_batch(spark: SparkSession, n: int = 4):
    """Files are few and large where rows are many and small: a Python worker gets so many at once while a table is written."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def load(spark: SparkSession, path: str, to: str, most: int = MOST, seconds: float = SECONDS, only: list[str] | None = None) -> Tables:
    """Parse the files under ``path``, as far as the detectors in ``only`` need, into a Parquet table at ``to``, and read that."""
    with few_in_a_batch(spark):
        parsed(spark, path, most, seconds, only).write.parquet(to)
    return tables(spark.read.schema(row_schema()).parquet(to))
