"""A stream of files to a table of reports, a micro-batch at a time.

Detectors look at one document at a time, so there is no state and no watermark; each batch
is parsed into its own partition of the extracted table, keyed by batch number, so a replayed
batch overwrites what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..sources import files


def audit(spark: SparkSession, path: str, to: str, checkpoint: str, only: list[str] | None = None, most: int = files.MOST, seconds: float = files.SECONDS, once: bool = True) -> StreamingQuery:
    """Starts a query that writes ``to``/rows, ``to``/findings and ``to``/reports; a file over ``most`` bytes has a report with its error; with ``once`` it ends when all present files are done."""

    def batch(df: DataFrame, number: int) -> None:
        with files.few_in_a_batch(df.sparkSession):
            files.extracted(df, seconds, only).write.mode("overwrite").parquet(f"{to}/rows/batch={number}")
        tables = files.tables(spark.read.parquet(f"{to}/rows/batch={number}"))
        Engine().reports(tables, only, to=f"{to}/findings/batch={number}").write.mode("overwrite").parquet(f"{to}/reports/batch={number}")

    writer = files.scan(spark, path, most=most, stream=True).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
