"""Attached files from four sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .findings import finding


def distinct_files(filespecs: DataFrame) -> DataFrame:
    """(doc_id, name, size): of each name the first known size in order of source and place, -1 if none is known. One combinable aggregate."""
    known = F.min_by("size", F.when(F.col("size") >= 0, F.struct("source_ord", "ord")))
    return filespecs.groupBy("doc_id", "name").agg(F.coalesce(F.when(F.max("size") >= 0, known), F.lit(-1)).cast("long").alias("size"))


def embedded_files(filespecs: DataFrame) -> DataFrame:
    """Findings of a document in the order of the files' names."""
    rows = distinct_files(filespecs).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("name")))
    size = F.when(F.col("size") >= 0, F.concat(F.lit("("), F.col("size").cast("string"), F.lit(" bytes)"))).otherwise("(unknown size)")
    return finding(rows, "embedded_files", "high", F.concat(F.lit("The document carries the file "), F.col("name"), F.lit(".")), F.concat_ws(" ", "name", size), "Detach files that the reader shouldn't get.", emit=F.col("place"))
