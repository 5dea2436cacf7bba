"""Revisions as of: a document's parts, each stored where it changed, and joined to the revisions that show it.

A revision seldom changes all of a document. A change row (doc_id, part, rev_index, text) says what a part holds from that
revision on; the version that a revision shows is the latest at or before it. A version is in force up to
the next one of its part, so the as-of join is the sequence of revisions in between: it needs no join of all
versions with all revisions. What is compared, is compared once for a version, however many revisions show it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .revisions import REVISIONS, ROW_BYTES, compared


def _part() -> WindowSpec:
    return Window.partitionBy("doc_id", "part").orderBy("rev_index")


def changes(states: DataFrame) -> DataFrame:
    """(doc_id, part, rev_index, text): of what each revision says about its parts (the same columns), the rows that differ from the one before; a part that isn't mentioned is as it was.

    A null text says that the part is empty from there on. A revision says one thing about a part; where rows repeat, one stands for all.
    """
    once = states.groupBy("doc_id", "part", "rev_index").agg(F.max("text").alias("text"))
    before = F.lag("text").over(_part())
    return once.withColumns({"__first": F.row_number().over(_part()) == 1, "__before": before}).where(F.col("__first") | ~F.col("text").eqNullSafe(F.col("__before"))).drop("__first", "__before")


def in_force(changed: DataFrame, documents: DataFrame) -> DataFrame:
    """Change rows with ``until``, the last revision that shows them; documents: (doc_id, n_revisions)."""
    rows = changed.withColumn("next", F.lead("rev_index").over(_part())).join(documents.select("doc_id", "n_revisions"), "doc_id")
    return rows.withColumn("until", (F.coalesce(F.col("next"), F.col("n_revisions") + 1) - 1).cast("int")).where("rev_index <= until").drop("next")


def as_of(changed: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, rev_index, part, version, text): every revision with the version of each part that it shows, the latest at or before it."""
    rows = in_force(changed, documents).withColumnRenamed("rev_index", "version")
    return rows.select("doc_id", F.explode(F.sequence("version", "until")).alias("rev_index"), "part", "version", "text")


def recovered_as_of(changed: DataFrame, documents: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(doc_id, part, rev_index, n_tokens, evidence): earlier revisions that show a version of a part with tokens that its last one has less often; each version is compared once."""
    forced = in_force(changed, documents)
    version = F.struct(F.col("rev_index").cast("int").alias("rev_index"), "text")
    rows = forced.groupBy(F.struct("doc_id", "part").alias("doc_id")).agg(F.array_sort(F.collect_list(version)).alias("revisions"))
    found = compared(rows, row_bytes, cap=None).select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.part").alias("part"), F.explode("found").alias("f"))
    shown = forced.select("doc_id", "part", F.col("rev_index").alias("version"), "until", "n_revisions")
    met = found.select("doc_id", "part", F.col("f.rev_index").alias("version"), "f.n_tokens", "f.evidence").join(shown, ["doc_id", "part", "version"])
    each = met.select("doc_id", "part", F.explode(F.sequence(F.col("version").cast("int"), "until")).alias("rev_index"), "n_revisions", "n_tokens", "evidence")
    return each.where((F.col("rev_index") <= REVISIONS) & (F.col("rev_index") < F.col("n_revisions"))).drop("n_revisions")
