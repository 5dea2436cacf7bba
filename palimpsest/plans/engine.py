"""The engine: registry, choice of detectors, union of their findings, reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import annotations, attachments, layout, metadata, report, revisions, stream
from ..operators.findings import union
from ..schema import DESCRIPTIONS, FINDING, FINDING_SCHEMA, VECTORS
from .opaque import Opaque

#: Characters of an error's message that are kept.
MESSAGE = 200
#: Runs over parts of the documents by which those that make a detector fail are told from the others.
TRIES, DEEPEST = 256, 62
#: Where all of so many parts fail, it is the detector that fails, not a document.
PARTS = 8
#: What a failed job says that no row of data is to blame for.
_MACHINES = ("ExecutorLostFailure", "No space left on device", "OutOfMemoryError", "FetchFailed", "Disk quota", "SparkContext was shut down", "was cancelled", "Connection refused", "Permission denied")


@dataclass
class Tables:
    """Normalised tables of a corpus; see :mod:`palimpsest.schema`."""

    docs: DataFrame
    layout: DataFrame
    stream_ops: DataFrame
    revisions: DataFrame
    filespecs: DataFrame
    info: DataFrame
    xmp: DataFrame
    xmp_fields: DataFrame
    annots: DataFrame
    errors: DataFrame

    def where(self, condition: Column) -> Some:
        """The rows of all tables for which the condition on doc_id holds."""
        return Some(self, condition)


class Some:
    """Tables with some of their documents; a table is cut when a detector asks for it."""

    def __init__(self, tables: Tables, condition: Column):
        self._tables, self._condition = tables, condition

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(self._tables, name).where(self._condition)


#: A relational detector: tables to rows of the finding schema. Each finding of a document rests on that document's rows alone.
Detector = Callable[[Tables], DataFrame]

DETECTORS: dict[str, Detector] = {
    "covered_text": lambda t: layout.covered_text(t.layout),
    "hidden_text": lambda t: union([stream.hidden_stream(t.stream_ops), layout.hidden_geometry(t.layout)]),
    "revision_history": lambda t: revisions.revision_history(t.revisions),
    "embedded_files": lambda t: attachments.embedded_files(t.filespecs),
    "metadata": lambda t: metadata.metadata(t.info, t.xmp, t.xmp_fields, t.layout),
    "redact_annotations": lambda t: annotations.redact_annotations(t.annots, t.layout),
}


def parse_only(text: str | None) -> list[str]:
    """Names of a comma list; none means all."""
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def names_of(text: Column) -> Column:
    """As :func:`parse_only`, of a column: the names of a comma list, none for null."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: E.strip(x)), lambda x: x != "")


def chosen_of(text: Column, available: tuple[str, ...] = VECTORS) -> tuple[Column, Column]:
    """Detectors that a comma list chooses, in the registry's order, all for an empty one; and its names that aren't detectors, sorted."""
    names, every = names_of(text), F.array(*map(F.lit, available))
    return F.when(F.size(names) == 0, every).otherwise(F.array_intersect(every, names)), F.array_sort(F.array_except(names, every))


def unknown(names: list[str], available: tuple[str, ...] = VECTORS) -> list[str]:
    return sorted(set(names) - set(available))


def vectors(spark: SparkSession) -> DataFrame:
    """(ord, name, description) of the registry."""
    return spark.createDataFrame([(i, v, DESCRIPTIONS.get(v, "")) for i, v in enumerate(VECTORS)], "ord int, name string, description string")


def said(e: BaseException) -> str:
    return f"{type(e).__name__}: {' '.join(str(e).split())[:MESSAGE]}"


def of_data(e: BaseException) -> bool:
    """Whether a job failed by what it computed, not by the machines it ran on."""
    return not any(x in str(e) for x in _MACHINES)


def part(depth: int, k: int) -> Column:
    """One of 2**depth parts of the documents."""
    return F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - depth) == k if depth else F.lit(True)


@dataclass
class Isolated:
    """What a detector gave where it could: its written rows, documents' own errors, and the error that holds for all, if one does."""

    rows: list[DataFrame]
    errors: list[DataFrame]
    broken: str | None = None


def isolated(detector: Detector, tables: Tables, to: str, tries: int = TRIES) -> Isolated:
    """Run a detector over all documents at once; where that fails, over halves of those that fail, until single documents are left.

    So one bad document costs about two runs for each doubling of their number, of ever smaller parts, and has an
    error; all others keep their findings. After ``tries`` runs the documents of parts that still fail share the part's
    error: none is ever clean. A failure of machines or a full disk is raised, as no document is to blame for it.
    """
    spark, docs = tables.docs.sparkSession, tables.docs.select("doc_id")

    def planned(own: Tables | Some) -> DataFrame:
        return detector.rows(own) if isinstance(detector, Opaque) else detector(own).select(*FINDING)

    def run(depth: int, k: int, rows: DataFrame) -> tuple[DataFrame | None, str]:
        path = f"{to}/part={depth}-{k}"
        try:
            rows.write.mode("overwrite").parquet(path)
        except Exception as e:  # a detector's own code may raise anything
            if not of_data(e):
                raise
            return None, said(e)
        return spark.read.schema(rows.schema).parquet(path), ""

    try:
        failing = [(0, 0, planned(tables))]
    except Exception as e:
        return Isolated([], [], said(e))
    out, runs = Isolated([], []), 0
    while failing:
        again: list[tuple[int, int, str]] = []
        for depth, k, planned_rows in failing:
            rows, message = run(depth, k, planned_rows)
            runs += 1
            if rows is not None:
                out.rows.append(rows)
            else:
                again.append((depth, k, message))
        if len(again) == PARTS == 2 ** again[0][0]:
            return Isolated([], [], again[0][2])
        failing = []
        for depth, k, message in again:
            own = docs.where(part(depth, k))
            few = len(own.limit(2).collect())
            if not few:  # rows of no document make it fail
                return Isolated([], [], message)
            if few < 2 or depth == DEEPEST or runs + 2 * len(again) > tries:
                out.errors.append(own.select("doc_id", F.lit(message).alias("message")))
            else:
                failing += [(depth + 1, x, planned(tables.where(part(depth + 1, x)))) for x in (2 * k, 2 * k + 1)]
    return out


@dataclass
class Engine:
    """Detectors by name; others may be added, or given instead. Unchosen ones are never planned."""

    detectors: dict[str, Detector] = field(default_factory=lambda: dict(DETECTORS))

    def outcome(self, tables: Tables, only: list[str] | None = None, to: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Findings and errors of the chosen detectors. A document where a detector raises has its error there and none of its findings; all others go on.

        With ``to``, a shared folder, each detector's rows are first written there, which tells the documents that make it
        raise from the others (:func:`isolated`); without, only a detector that raises while it is planned is told from the
        others, and has an error in every document.
        """
        if bad := unknown(only or [], tuple(self.detectors)):
            raise ValueError(f"unknown detectors: {', '.join(bad)}; there are {', '.join(self.detectors)}")
        spark, parts = tables.docs.sparkSession, []
        chosen = {k: f for k, f in self.detectors.items() if not only or k in only}
        errors = [tables.errors.where(F.col("detector").isNull() | F.col("detector").isin(*chosen)).select("doc_id", "detector", "message")]

        def failed(docs: DataFrame, name: str, message: Column) -> None:
            errors.append(docs.select("doc_id", F.lit(name).alias("detector"), message.alias("message")))

        for name, detector in chosen.items():
            if to:
                one = isolated(detector, tables, f"{to}/{name}")
                for docs in one.errors:
                    failed(docs, name, F.col("message"))
            else:
                try:
                    one = Isolated([detector.rows(tables) if isinstance(detector, Opaque) else detector(tables).select(*FINDING)], [])
                except Exception as e:
                    one = Isolated([], [], said(e))
            if one.broken is not None:
                failed(tables.docs, name, F.lit(one.broken))
            for rows in one.rows:
                if "kind" in rows.columns:
                    failed(rows.where("kind IS NOT NULL"), name, F.col("message"))
                    rows = rows.where("kind IS NULL")
                parts.append(rows.select(*FINDING))
        found = union(parts) if parts else spark.createDataFrame([], FINDING_SCHEMA)
        every = reduce(DataFrame.union, errors)
        gone = every.select("doc_id", F.coalesce("detector", F.lit("open")).alias("vector")).distinct()
        return found.join(gone, ["doc_id", "vector"], "left_anti"), every

    def findings(self, tables: Tables, only: list[str] | None = None) -> DataFrame:
        """All rows of the chosen detectors, but for documents where that detector failed: a failed detector has none."""
        return self.outcome(tables, only)[0]

    def errors(self, tables: Tables, only: list[str] | None = None) -> DataFrame:
        """Errors of the chosen detectors, and of documents that could not be opened."""
        return self.outcome(tables, only)[1]

    def reports(self, tables: Tables, only: list[str] | None = None, fail_on: str = "high", fail_on_error: bool = True, to: str | None = None) -> DataFrame:
        return report.rollup(tables.docs, *self.outcome(tables, only, to), fail_on, fail_on_error)
