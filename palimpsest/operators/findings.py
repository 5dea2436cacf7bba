"""The finding row, and the union of detectors' rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FINDING, VECTORS


def finding(df: DataFrame, vector: str, severity: Column | str, description: Column, evidence: Column, recommendation: str, page: Column | None = None, bbox: Column | None = None, emit: Column | None = None) -> DataFrame:
    return df.select(
        "doc_id", F.lit(vector).alias("vector"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), description.alias("description"),
        (F.lit(None) if page is None else page).cast("int").alias("page"), (F.lit(None) if bbox is None else bbox).cast("array<double>").alias("bbox"), evidence.cast("string").alias("evidence"),
        F.lit(recommendation).alias("recommendation"), F.lit(VECTORS.index(vector) if vector in VECTORS else len(VECTORS)).alias("detector_ord"), (F.lit(0) if emit is None else emit).cast("long").alias("emit_ord"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*FINDING) for p in parts])
