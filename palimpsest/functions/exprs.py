"""Geometry, text and classification as Column expressions (survey P1-P19, O6).

Boxes are structs or rows with double fields x0, y0, x1, y1. Comparisons are in binary64, so
constants are written as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities and their order.
SEVERITIES = ("info", "low", "medium", "high", "critical")
#: Thresholds of the detectors.
DARK, WHITE = 0.35, 0.95
OVERLAP = 0.30
BACKGROUND = 0.80
TINY = 0.5
#: Document information keys.
STANDARD_KEYS = ("/Title", "/Author", "/Subject", "/Keywords", "/Creator", "/Producer", "/CreationDate", "/ModDate", "/Trapped")
IDENTITY_KEYS = ("/Author", "/Title", "/Subject", "/Keywords")
#: XMP element names.
XMP_IDENTITY = ("creator", "author", "title", "subject", "rights", "DocumentID", "InstanceID")
XMP_SOFTWARE = ("CreatorTool", "ProducerTool", "History", "ManagedFrom")


def rank(severity: Column) -> Column:
    """1 (info) to 5 (critical), null for null; anything else is an error, never silently null."""
    known = F.lit(None).cast("int")
    for i, name in enumerate(SEVERITIES, 1):
        known = F.when(severity == name, i).otherwise(known)
    return F.when(severity.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(known, F.raise_error(F.concat(F.lit("unknown severity: "), severity)).cast("int")))


def label(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, name in enumerate(SEVERITIES, 1):
        out = F.when(rank == i, name).otherwise(out)
    return out


def brightness(color: Column) -> Column:
    """Of an array of 1, 3 (RGB) or 4 (CMYK) doubles; null for null or anything else."""
    c = [F.get(color, F.lit(i)) for i in range(4)]
    one = F.lit(1.0)
    cmyk = (one - c[0]) * (one - c[3]) * 0.33 + (one - c[1]) * (one - c[3]) * 0.33 + (one - c[2]) * (one - c[3]) * 0.34
    return F.when(F.size(color) == 1, c[0]).when(F.size(color) == 3, (c[0] + c[1] + c[2]) / 3.0).when(F.size(color) == 4, cmyk)


def area(b) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def center_inside(inner, outer, pad: float = 0.0) -> Column:
    x, y = (inner["x0"] + inner["x1"]) / 2.0, (inner["y0"] + inner["y1"]) / 2.0
    return x.between(outer["x0"] - pad, outer["x1"] + pad) & y.between(outer["y0"] - pad, outer["y1"] + pad)


def overlap_ratio(inner, outer) -> Column:
    """Share of ``inner`` that ``outer`` covers; for an inner box without area, whether its centre lies inside."""
    width = F.greatest(F.lit(0.0), F.least(inner["x1"], outer["x1"]) - F.greatest(inner["x0"], outer["x0"]))
    height = F.greatest(F.lit(0.0), F.least(inner["y1"], outer["y1"]) - F.greatest(inner["y0"], outer["y0"]))
    return F.when(area(inner) <= 0, F.when(center_inside(inner, outer), 1.0).otherwise(0.0)).otherwise(width * height / area(inner))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Runs without white space that hold an ASCII letter or digit, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1)), lambda t: t.rlike("[A-Za-z0-9]"))


def is_dark(kind: Column, bright: Column) -> Column:
    return F.coalesce((kind == "rect") & (bright <= DARK), F.lit(False))


def cover_severity(kind: Column, bright: Column) -> Column:
    return F.when(is_dark(kind, bright), "critical").otherwise("high")


def cover_label(kind: Column, bright: Column) -> Column:
    return F.when(is_dark(kind, bright), "dark rectangle").when(kind == "rect", "rectangle").otherwise("image")


def info_severity(key: Column) -> Column:
    return F.when(key.isin(*IDENTITY_KEYS) | ~key.isin(*STANDARD_KEYS), "medium").otherwise("info")


def in_reading_order(items: Column) -> Column:
    """Concatenates an array of structs (up, x0, glyph_id, ch), up being -y0: from top to bottom, left to right, ties as emitted."""
    # sort_array compares as array_sort does, without a lambda for each comparison; no item is null
    return F.array_join(F.transform(F.sort_array(items), lambda z: z["ch"]), "")


def glyph_place(g) -> Column:
    return F.struct((-g["y0"]).alias("up"), g["x0"].alias("x0"), g["glyph_id"].alias("glyph_id"), g["ch"].alias("ch"))


def run_box(r) -> dict[str, Column]:
    """Box of a run: the glyphs of ``text``, from left to right on one line, each ``step`` wide, numbered from ``glyph_id``. Runs of a page do not overlap."""
    return {"x0": r["x0"], "y0": r["y0"], "x1": r["x0"] + r["step"] * F.length(r["text"]), "y1": r["y1"]}


def glyphs_of(runs: Column) -> Column:
    """The glyphs of an array of runs, in order."""

    def glyph(r: Column, ch: Column, i: Column) -> Column:
        x = r["x0"] + r["step"] * i
        return F.struct((r["glyph_id"] + i).alias("glyph_id"), ch.alias("ch"), x.alias("x0"), r["y0"].alias("y0"), (x + r["step"]).alias("x1"), r["y1"].alias("y1"), r["size"].alias("size"), r["brightness"].alias("brightness"))

    return F.flatten(F.transform(runs, lambda r: F.transform(F.split(r["text"], ""), lambda ch, i: glyph(r, ch, i))))


def xml_escape(text: Column) -> Column:
    """Text inside markup; empty for null."""
    out = F.coalesce(text, F.lit(""))
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def byte_size(n: Column) -> Column:
    """A number of bytes to read: B below 1024, else KB or MB with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / float(1 << 20)))


#: Fixed value: bytes that a request may have beyond the file in it.
SLACK = 4096


def body_allowed(length: Column, most: int) -> Column:
    """Whether a request of this stated length may be read; one that states none, or no number, may."""
    stated = F.when(length.rlike("^ *[+-]?[0-9]+ *$"), F.trim(length).try_cast("bigint"))
    return F.coalesce(stated <= most + SLACK, F.lit(True))
