"""Document information and XMP."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from .findings import finding, union

CUT = 200
_FIX = "Clear document properties before publishing."


def info_entries(info: DataFrame) -> DataFrame:
    """(doc_id, ord, key, value, severity) of keys with a value."""
    rows = info.select("doc_id", "ord", "key", E.strip(F.col("value")).alias("value")).where("value <> ''")
    return rows.withColumn("severity", E.info_severity(F.col("key")))


def xmp_entries(xmp_fields: DataFrame, info: DataFrame) -> DataFrame:
    """(doc_id, ord, name, value, severity): wanted XMP fields, distinct by name and whole value, cut, and then unless the cut value is a document information value or an earlier field's."""
    wanted = xmp_fields.where(F.col("name").isin(*E.XMP_IDENTITY, *E.XMP_SOFTWARE) & (F.col("value") != ""))
    once = wanted.groupBy("doc_id", "name", "value").agg(F.min("ord").alias("ord"))
    cut = once.select("doc_id", "ord", "name", F.substring("value", 1, CUT).alias("value"))
    first = cut.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "value").orderBy("ord"))).where("r = 1").drop("r")
    seen = info_entries(info).select("doc_id", "value").distinct()
    fresh = first.join(seen, ["doc_id", "value"], "left_anti")
    return fresh.select("doc_id", "ord", "name", "value", F.when(F.col("name").isin(*E.XMP_IDENTITY), "medium").otherwise("info").alias("severity"))


def metadata(info: DataFrame, xmp: DataFrame, xmp_fields: DataFrame, layout: DataFrame) -> DataFrame:
    entries = info_entries(info)
    kind = F.when(F.col("severity") == "medium", "identity or custom").otherwise("software")
    one = finding(entries, "metadata", F.col("severity"), F.concat(F.lit("Document information, "), kind, F.lit(": "), F.col("key")), F.concat(F.col("key"), F.lit(" = "), F.substring("value", 1, CUT)), _FIX, emit=F.col("ord"))
    fields = xmp_entries(xmp_fields, info)
    two = finding(fields, "metadata", F.col("severity"), F.concat(F.lit("XMP field "), F.col("name")), F.concat(F.lit("xmp:"), F.col("name"), F.lit(" = "), F.col("value")), _FIX, emit=F.col("ord") + 100_000)
    size = F.when(F.col("bytes").isNotNull(), F.concat(F.lit(" of "), F.col("bytes").cast("string"), F.lit(" bytes"))).otherwise("")
    three = finding(xmp, "metadata", "info", F.lit("An XMP packet is present."), F.concat(F.lit("XMP packet"), size), _FIX, emit=F.lit(10_000_000))
    pages = layout.where("has_metadata").select("doc_id", "page")
    four = finding(pages, "metadata", "info", F.lit("The page has XMP of its own."), F.lit("page-level XMP packet"), _FIX, F.col("page"), emit=F.lit(10_000_001))
    return union([one, two, three, four])
