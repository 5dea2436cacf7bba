"""The graphics-state fold over content-stream operators.

A page row holds its operators in order, so nothing is exploded, shuffled or grouped. Pages that never set
an invisible mode are told by a filter on the array and go no further; the others are walked
once, with stacks that are pushed and popped in place, so that the time grows with the number of operators however
deep they nest and however many are shown. ``aggregate`` can't do that: it copies its state at every step.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import finding

#: Operators that show text, and text render modes that draw nothing.
SHOWS, UNSEEN = ("Tj", "TJ", "'", '"'), (3, 7)


def fold(ops: list[str], modes: list[int | None], shown: list[bytes | None]) -> tuple[int, bytes]:
    """How often text is shown in a mode that draws nothing, and what. Forms save the whole state and begin with an empty stack; a pop of nothing is passed over."""
    mode, stack, frames, n, out = 0, [], [], 0, []
    for op, asked, raw in zip(ops, modes, shown):
        if op in SHOWS:
            if mode in UNSEEN:
                n += 1
                out.append(raw or b"")
        elif op == "q":
            stack.append(mode)
        elif op == "Q":
            mode = stack.pop() if stack else mode
        elif op == "Tr":
            mode = mode if asked is None else asked
        elif op == "FORM_BEGIN":
            frames.append((mode, stack))
            stack = []
        elif op == "FORM_END" and frames:
            mode, stack = frames.pop()
    return n, b"".join(out)


def invisible_shows(pages: DataFrame) -> DataFrame:
    """(doc_id, page, n, shown) of page rows (doc_id, page, ops; an array of structs with op, int_arg and shown, in order) with a text show in an invisible mode."""
    able = F.exists("ops", lambda x: (x["op"] == "Tr") & x["int_arg"].isin(*UNSEEN))
    ops = F.transform("ops", lambda x: F.struct(x["op"].alias("op"), x["int_arg"].alias("int_arg"), x["shown"].alias("shown")))

    def of(batches):
        for batch in batches:
            column = batch.column("ops")
            parts = [column.flatten().field(k).to_pylist() for k in range(3)]
            ends = pc.cumulative_sum(pc.list_value_length(column)).to_pylist()
            found = [fold(*(p[a:b] for p in parts)) for a, b in zip([0, *ends], ends)]
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page"), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["doc_id", "page", "n", "shown"])
            yield rows.filter(pc.greater(rows.column("n"), 0))

    return pages.select("doc_id", "page", ops.alias("ops")).where(able).mapInArrow(of, "doc_id bigint, page int, n bigint, shown binary")


def hidden_stream(pages: DataFrame) -> DataFrame:
    rows = invisible_shows(pages)
    text = F.when(F.hex(F.substring("shown", 1, 2)) == "FEFF", F.decode(F.expr("substring(shown, 3)"), "UTF-16BE")).otherwise(F.decode("shown", "ISO-8859-1"))
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    evidence = F.nullif(F.substring(stripped, 1, 400), F.lit(""))
    return finding(rows, "hidden_text", "critical", F.concat(F.col("n").cast("string"), F.lit(" pieces of text are drawn in an invisible mode.")), evidence, "Remove text drawn in render mode 3 or 7.", F.col("page"))
