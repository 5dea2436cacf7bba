"""Redaction marks and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from .findings import finding, union
from .layout import text_under

CUT = 200
_FIELDS = (("contents", "Contents"), ("rc", "RC"), ("overlay_text", "OverlayText"))


def stored_texts(annots: DataFrame) -> DataFrame:
    """annots with ``texts``: (field, text) of what the annotation stores, in fixed order, blanks dropped."""
    own = [F.when(~E.blank(F.col(c)), F.struct(F.lit(name).alias("field"), E.strip(F.col(c)).alias("text"))) for c, name in _FIELDS]
    return annots.withColumn("texts", F.array_compact(F.array(*own)))


def redact_evidence(annots: DataFrame, layout: DataFrame) -> DataFrame:
    """(doc_id, page, ord, evidence) of every mark."""
    rows = text_under(stored_texts(annots.where("subtype = '/Redact'")), layout)
    under = F.when(F.col("under") != "", F.concat(F.lit("under redaction: "), F.col("under")))
    parts = F.array_compact(F.concat(F.array(under), F.transform("texts", lambda t: F.concat_ws(": ", t["field"], t["text"]))))
    return rows.select("doc_id", "page", "ord", F.coalesce(F.nullif(F.array_join(parts, " | "), F.lit("")), F.lit("(no recoverable text)")).alias("evidence"))


def notes(annots: DataFrame) -> DataFrame:
    """(doc_id, page, ord, evidence) of other annotations that store text: only the first one."""
    rows = stored_texts(annots.where("subtype <> '/Redact'")).where("size(texts) > 0")
    return rows.select("doc_id", "page", "ord", F.concat(F.col("subtype"), F.lit(": "), F.substring(F.col("texts")[0]["text"], 1, CUT)).alias("evidence"))


def redact_annotations(annots: DataFrame, layout: DataFrame) -> DataFrame:
    marks = finding(redact_evidence(annots, layout), "redact_annotations", "critical", F.lit("A redaction mark was placed but never applied."), F.col("evidence"), "Apply redactions, then save as a new file.", F.col("page"), emit=F.col("ord"))
    other = finding(notes(annots), "redact_annotations", "info", F.lit("An annotation stores text."), F.col("evidence"), "Delete notes that the reader shouldn't get.", F.col("page"), emit=F.col("ord"))
    return union([marks, other])
