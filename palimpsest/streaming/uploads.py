"""Uploads as a stream: what comes twice is scanned once and reported under each name.

State is keyed by the hash of the content, one small row for each, and goes after a time that is stated; a content that comes
again by then is not scanned again. Only hashes, paths and lengths meet in the state's shuffle: files
are hashed where they are read, and those that are new are opened again by the workers that parse them. Each batch writes its own
folders, keyed by its number, so a replayed batch overwrites what it had written.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..plans.engine import Engine
from ..sources import datasource, files

#: Milliseconds for which a content is remembered.
REMEMBERED = 30 * 24 * 3600 * 1000
_UPLOAD = "content string, path string, length bigint, fresh boolean"


class Contents(StatefulProcessor):
    """(content, path, length, fresh) of each upload; of a content that isn't remembered, the upload with the smallest path is fresh."""

    def __init__(self, remembered: int = REMEMBERED):
        self.remembered = remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "path string", self.remembered)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.seen.exists()
        first = None
        held = []
        for r in rows:
            # one is held back, all others go on at once, however many copies come together
            if first is None or r["path"] < first["path"]:
                first, r = r, first
            if r is not None:
                held.append(Row(content=key[0], path=r["path"], length=r["length"], fresh=False))
                if len(held) >= 1000:
                    yield from held
                    held = []
        yield from held
        if first is not None:
            yield Row(content=key[0], path=first["path"], length=first["length"], fresh=not known)
            if not known:
                self.seen.update((first["path"],))

    def close(self) -> None:
        pass


def hashed(spark: SparkSession, path: str, most: int = files.MOST) -> DataFrame:
    """(content, path, length) of arriving files; one over the limit isn't read and stands for itself."""
    arriving = files.scan(spark, path, most=most, stream=True)
    return arriving.select(F.coalesce(F.sha2("content", 256), F.concat(F.lit("unread:"), "path")).alias("content"), "path", "length")


def receive(spark: SparkSession, path: str, to: str, checkpoint: str, only: list[str] | None = None, most: int = files.MOST, seconds: float = files.SECONDS, once: bool = True, remembered: int = REMEMBERED) -> StreamingQuery:
    """Starts a query over files that arrive at ``path``: ``to``/uploads has every upload, ``to``/reports a report of each content; :func:`reports` joins them."""
    if not datasource.direct(path):
        raise ValueError(f"uploads are opened by the workers, so they need a store of {', '.join(datasource.SCHEMES)}: {path}")
    # state with a time limit asks for batches without data again and again, which would never let a query end
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def batch(df: DataFrame, number: int) -> None:
        own = df.sparkSession
        df.write.mode("overwrite").parquet(f"{to}/uploads/batch={number}")
        fresh = own.read.schema(_UPLOAD).parquet(f"{to}/uploads/batch={number}").where("fresh")
        files.opened(fresh, most, seconds, only).write.mode("overwrite").parquet(f"{to}/rows/batch={number}")
        tables = files.tables(own.read.schema(files.row_schema()).parquet(f"{to}/rows/batch={number}"))
        Engine().reports(tables, only, to=f"{to}/findings/batch={number}").write.mode("overwrite").parquet(f"{to}/reports/batch={number}")

    kept = hashed(spark, path, most).groupBy("content").transformWithState(Contents(remembered), _UPLOAD, "Append", "ProcessingTime")
    writer = kept.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def reports(spark: SparkSession, to: str) -> DataFrame:
    """A report for each upload, under the path that it was displayed by; one that was scanned anew has its latest report."""
    uploads = spark.read.parquet(f"{to}/uploads").select(F.xxhash64("content").alias("doc_id"), "content", "path", F.col("batch").alias("uploaded"))
    found = spark.read.parquet(f"{to}/reports").drop("path")
    met = uploads.join(found, "doc_id").where("batch <= uploaded")
    columns = [c for c in found.columns if c not in ("doc_id", "batch")]
    latest = met.groupBy("doc_id", "content", "path", "uploaded").agg(F.max_by(F.struct(*columns), "batch").alias("r"))
    return latest.select("doc_id", "content", "path", "uploaded", "r.*")
