"""Detectors that are plain functions of one document (§2.12, C1, C2): a Python table function, called once for each document.

``Opaque("mine", work)`` is a detector like any other. ``work`` gets the rows of one document and gives findings as dictionaries
with ``severity``, ``description`` and ``evidence``, and ``page``, ``bbox`` and ``recommendation`` if they have them. What it
raises, what it gives that is no finding, and that it takes too long, is an error of that document
alone, which then has no findings of this detector.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.exprs import SEVERITIES
from ..schema import FINDING_SCHEMA, VECTORS

SECONDS = 60.0
OPAQUE_SCHEMA = f"{FINDING_SCHEMA}, kind string, message string"
_NAME = re.compile("[A-Za-z_][A-Za-z0-9_]*")
_TEXTS = ("description", "evidence", "recommendation")


def checked(found: object) -> dict:
    """A finding as a row; raises TypeError or ValueError for what is none."""
    if not isinstance(found, dict):
        raise TypeError(f"a finding is a dictionary, not {type(found).__name__}")
    if more := set(found) - {"severity", "page", "bbox", *_TEXTS}:
        raise ValueError(f"a finding has no {', '.join(sorted(more))}")
    if found.get("severity") not in SEVERITIES:
        raise ValueError(f"severity is one of {', '.join(SEVERITIES)}, not {found.get('severity')!r}")
    for name in _TEXTS:
        if not isinstance(found.get(name), (str, type(None))):
            raise TypeError(f"{name} is a string, not {type(found[name]).__name__}")
    if not isinstance(page := found.get("page"), (int, type(None))) or isinstance(page, bool):
        raise TypeError(f"page is a number, not {type(page).__name__}")
    box = found.get("bbox")
    if box is not None and (len(box) != 4 or not all(isinstance(x, (int, float)) for x in box)):
        raise TypeError("bbox is four numbers")
    return found | {"bbox": None if box is None else [float(x) for x in box]}


def _table_function(name: str, work: Callable[[list[Row]], Iterable[dict]], seconds: float):
    """A table function over the rows of one document: its findings, or one row with its error."""
    place = VECTORS.index(name) if name in VECTORS else len(VECTORS)

    class Run:
        def __init__(self):
            self.doc, self.rows = None, []

        def eval(self, row: Row):
            self.doc = row["doc_id"]
            self.rows.append(row)

        def terminate(self):
            from ..sources.pdf.extract import Clock

            out: list[dict] = []
            if not self.rows:
                return
            if error := Clock(seconds).phase(lambda: out.extend(map(checked, work(self.rows) or ()))):
                kind = "TimeoutError" if "time limit" in str(error) else type(error).__name__
                yield (self.doc, name, *(None,) * 6, place, 0, kind, str(error))
                return
            for k, f in enumerate(out):
                yield (self.doc, name, f["severity"], f.get("description"), f.get("page"), f.get("bbox"), f.get("evidence"), f.get("recommendation"), place, k, None, None)

    return udtf(Run, returnType=OPAQUE_SCHEMA)


@dataclass
class Opaque:
    """A detector that is a function. ``of`` gives the rows that it sees, each with a doc_id; by default those of pages. They are partitioned by document and sorted by page."""

    name: str
    work: Callable[[list[Row]], Iterable[dict]]
    seconds: float = SECONDS
    of: Callable[[object], DataFrame] = lambda tables: tables.layout

    def rows(self, tables) -> DataFrame:
        """Findings, and errors as rows with a ``kind``; of OPAQUE_SCHEMA."""
        from ..operators.report import error_line

        if not _NAME.fullmatch(self.name):
            raise ValueError(f"no name of a detector: {self.name!r}")
        rows = self.of(tables)
        spark = rows.sparkSession
        spark.udtf.register(f"palimpsest_{self.name}", _table_function(self.name, self.work, self.seconds))
        order = "ORDER BY page" if "page" in rows.columns else ""
        found = spark.sql(f"SELECT f.* FROM palimpsest_{self.name}(TABLE(SELECT * FROM {{rows}}) PARTITION BY doc_id {order}) f", rows=rows)
        return found.withColumn("message", F.when(F.col("kind").isNotNull(), error_line(F.col("kind"), F.col("message"))))

    def __call__(self, tables) -> DataFrame:
        return self.rows(tables).where("kind IS NULL")
