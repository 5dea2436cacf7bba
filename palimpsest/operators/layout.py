"""Detectors over the glyphs of a page.

A page row holds its glyphs and its covers, so the spatial joins are filters over the arrays of
one row: glyphs are never rows of their own, nothing is shuffled or grouped, and a row leaves with
what matched alone. Only on a heavy page, of more than ``HEAVY`` pairs of a glyph and a box, boxes meet glyphs by the
cells of a grid: glyphs and boxes become rows that are joined by page and cell, so a page spreads over its cells and
a pair is looked at once. Both ways give the same rows. Where rows have ``runs`` too, lines whose glyphs stand side by side
(:func:`palimpsest.functions.exprs.run_box`), boxes meet runs first, and only runs that matter become glyphs. Boxes are as the sources give them, x0 <= x1 and y0 <= y1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from .findings import finding

#: Pairs of a glyph and a box that are looked at inside a page's row; beyond, the page is cut into cells of so many points.
HEAVY, CELL = 2_000_000, 32.0
_BOX = ("x0", "y0", "x1", "y1")
_PAGE = ("doc_id", "page")


def _page_box() -> Column:
    return F.struct(*_BOX)


def _near(g, box: Column) -> Column:
    return (g["y1"] >= box["y0"]) & (g["y0"] <= box["y1"]) & (g["x1"] >= box["x0"]) & (g["x0"] <= box["x1"])


def _hit(g: Column, box: Column) -> Column:
    """Whether ``box`` covers at least OVERLAP of a glyph that is no white space; the cheap tests, which most glyphs fail, come first."""
    return _near(g, box) & (E.overlap_ratio(g, box) >= E.OVERLAP) & ~E.blank(g["ch"])


def _read(glyphs: Column) -> Column:
    """Text of an array of glyphs in reading order."""
    return E.in_reading_order(F.transform(glyphs, E.glyph_place))


def _text(layout: DataFrame) -> list[str]:
    """The columns that hold the text of a page: runs and how many glyphs they have, where there are any."""
    return ["runs", "n_glyphs"] if "runs" in layout.columns else ["glyphs"]


def effective_covers(page: Column) -> Column:
    """The covers that aren't a mere background of the page."""
    return F.filter("covers", lambda c: E.is_dark(c["kind"], c["brightness"]) | ~((E.area(page) > 0) & (E.area(c) / E.area(page) > E.BACKGROUND)))


def _cells(a: Column, b: Column) -> Column:
    """Numbers of the cells from ``a`` to ``b`` along one side; outside the page's neighbourhood everything is the outermost cell."""
    at = lambda x: F.greatest(F.lit(-4), F.least(F.lit(60), F.floor(x / CELL))).cast("int")
    return F.sequence(at(a), at(b))


def _by_cell(rows: DataFrame, item: str) -> DataFrame:
    """rows (doc_id, page, item) once for each cell that the item's box touches, as cx and cy, with the first cell of both sides."""
    box = F.col(item)
    out = rows.withColumns({"xs": _cells(box["x0"], box["x1"]), "ys": _cells(box["y0"], box["y1"])})
    out = out.select(*rows.columns, F.get("xs", F.lit(0)).alias(f"{item}_x"), F.get("ys", F.lit(0)).alias(f"{item}_y"), "ys", F.explode("xs").alias("cx"))
    return out.select(*rows.columns, f"{item}_x", f"{item}_y", "cx", F.explode("ys").alias("cy"))


def _under(pages: DataFrame, boxes: str, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, page, b, g): of each box in the array ``boxes`` that hides a glyph, the glyphs that it does; pages: doc_id, page, glyphs or runs, boxes. A box is a struct with x0, y0, x1, y1 and whatever tells it from others."""
    if "runs" in pages.columns:
        count, every = F.col("n_glyphs"), E.glyphs_of(F.col("runs"))
        near = lambda b: E.glyphs_of(F.filter("runs", lambda r: _near(E.run_box(r), b)))
    else:
        count, every, near = F.size("glyphs").cast("long"), F.col("glyphs"), lambda b: F.col("glyphs")
    weight = count * F.size(boxes)
    # light pages are told in the row: a filter would be pushed down to the source, ahead of its exchange;
    # outer generators: for plain ones the planner adds a filter on the size of the array, which makes it once more, and of all pages
    plain = F.transform(F.when(~(weight > heavy), F.col(boxes)), lambda b: F.struct(b.alias("b"), F.filter(near(b), lambda g: _hit(g, b)).alias("g")))
    light = pages.select(*_PAGE, F.explode_outer(plain).alias("u")).where(F.size("u.g") > 0).select(*_PAGE, "u.b", "u.g")
    large = pages.where(weight > heavy)
    glyphs = _by_cell(large.select(*_PAGE, F.explode_outer(every).alias("g")).where(~E.blank(F.col("g.ch"))), "g")
    covers = _by_cell(large.select(*_PAGE, F.posexplode(boxes).alias("nth", "b")), "b")
    # two boxes that meet do so in the cell that is the larger of their first ones, among others; there they are looked at
    met = glyphs.join(covers, [*_PAGE, "cx", "cy"]).where((F.col("cx") == F.greatest("g_x", "b_x")) & (F.col("cy") == F.greatest("g_y", "b_y"))).where(_hit(F.col("g"), F.col("b")))
    return light.unionByName(met.groupBy(*_PAGE, "nth").agg(F.first("b").alias("b"), F.collect_list("g").alias("g")).select(*_PAGE, "b", "g"))


def covered_spans(layout: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, page, c, n_glyphs, evidence) of covers with covered text; a glyph counts under every cover that hides it."""
    rows = _under(layout.select(*_PAGE, *_text(layout), effective_covers(_page_box()).alias("boxes")), "boxes", heavy)
    return rows.select(*_PAGE, F.col("b").alias("c"), F.size("g").cast("long").alias("n_glyphs"), _read(F.col("g")).alias("evidence"))


def covered_text(layout: DataFrame) -> DataFrame:
    rows = covered_spans(layout)
    c = F.col("c")
    text = F.concat(F.col("n_glyphs").cast("string"), F.lit(" characters lie under a "), E.cover_label(c["kind"], c["brightness"]), F.lit(" and can be copied out."))
    box = F.array(*(F.round(c[x], 2) for x in _BOX))
    return finding(rows, "covered_text", E.cover_severity(c["kind"], c["brightness"]), text, E.strip(F.col("evidence")), "Delete the text below the cover, then export a new file.", F.col("page"), box, c["cover_id"])


def _off(g, p: Column) -> Column:
    return (g["x1"] < p["x0"]) | (g["x0"] > p["x1"]) | (g["y1"] < p["y0"]) | (g["y0"] > p["y1"])


def _tiny(g: Column) -> Column:
    return F.coalesce(g["size"], F.lit(1.0)) <= E.TINY


def _white(g: Column) -> Column:
    return g["brightness"] >= E.WHITE


def _why(g: Column, p: Column, dark: Column) -> Column:
    """``off`` the page ``p``, ``tiny``, or ``white`` without one of ``dark`` (the page's dark top-level rectangles) behind; null for a glyph to be seen."""
    return F.when(_off(g, p), "off").when(_tiny(g), "tiny").when(_white(g) & ~F.exists(dark, lambda c: E.overlap_ratio(g, c) >= E.OVERLAP), "white")


def _unseen(glyphs: Column, p: Column, dark: Column) -> Column:
    """(up, x0, glyph_id, ch, why, n) of glyphs that nobody sees."""
    own = F.transform(glyphs, lambda g: F.struct(E.glyph_place(g)["up"].alias("up"), g["x0"].alias("x0"), g["glyph_id"].alias("glyph_id"), g["ch"].alias("ch"), _why(g, p, dark).alias("why"), F.lit(1).alias("n")))
    return F.filter(own, lambda z: z["why"].isNotNull() & ~E.blank(z["ch"]))


def _unseen_runs(p: Column, dark: Column) -> Column:
    """The same of runs. All glyphs of a run that lies on the page or off it have one reason, unless a dark box is near: such a run is one row, without its white space."""

    def of(r: Column) -> Column:
        b = E.run_box(r)
        why = F.when(_off(b, p), "off").when((b["x0"] < p["x0"]) | (b["x1"] > p["x1"]), None).when(_tiny(r), "tiny").when(~F.exists(dark, lambda c: _near(b, c)), "white")
        text = F.regexp_replace(r["text"], r"(?U)\s+", "")
        whole = F.struct((-r["y0"]).alias("up"), r["x0"].alias("x0"), r["glyph_id"].alias("glyph_id"), text.alias("ch"), why.alias("why"), F.length(text).alias("n"))
        return F.when(why.isNotNull(), F.array(whole)).otherwise(_unseen(E.glyphs_of(F.array(r)), p, dark))

    # of other runs no glyph can be hidden
    some = F.filter("runs", lambda r: _off(E.run_box(r), p) | (r["x0"] < p["x0"]) | (E.run_box(r)["x1"] > p["x1"]) | _tiny(r) | _white(r))
    return F.filter(F.flatten(F.transform(some, of)), lambda z: z["n"] > 0)


def hidden_pages(layout: DataFrame) -> DataFrame:
    """A3: (doc_id, page, n_white, n_tiny, n_offpage, text) of pages with invisible glyphs; each counts for the first reason that holds."""
    dark = F.filter("covers", lambda c: F.coalesce(c["top_level"], F.lit(False)) & E.is_dark(c["kind"], c["brightness"]))
    unseen = _unseen_runs(F.col("p"), F.col("dark")) if "runs" in layout.columns else _unseen(F.col("glyphs"), F.col("p"), F.col("dark"))
    # a generator of one row: no filter is pushed below it, where the expression would be evaluated once more
    rows = layout.select(*_PAGE, *_text(layout), _page_box().alias("p"), dark.alias("dark")).select(*_PAGE, F.explode_outer(F.array(unseen)).alias("z")).where(F.size("z") > 0)

    def count(why: str) -> Column:
        return F.aggregate("z", F.lit(0).cast("long"), lambda n, z: n + F.when(z["why"] == why, z["n"]).otherwise(0))

    counts = [count(why).alias(name) for name, why in (("n_white", "white"), ("n_tiny", "tiny"), ("n_offpage", "off"))]
    return rows.select(*_PAGE, *counts, E.in_reading_order(F.col("z")).alias("text"))


def hidden_geometry(layout: DataFrame) -> DataFrame:
    rows = hidden_pages(layout)
    parts = [F.when(F.col(f"n_{w}") > 0, F.concat(F.col(f"n_{w}").cast("string"), F.lit(f" {say}"))) for w, say in (("white", "in white"), ("tiny", "too small to see"), ("offpage", "outside the page"))]
    return finding(rows, "hidden_text", "critical", F.concat(F.lit("Characters that nobody sees: "), F.concat_ws("; ", *parts), F.lit(".")), F.substring("text", 1, 400), "Remove the hidden text from the content.", F.col("page"), emit=F.lit(1))


def text_under(annots: DataFrame, layout: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Annots with ``under``, the text below each rectangle in reading order; empty for none, a null rectangle or a missing page.

    Where layout rows carry the annotations of their page (``annots``, as :mod:`palimpsest.sources.files` gives
    them), no page is moved to meet its marks. Else pages are joined to them before any glyph is looked at, and as runs where they have any.
    """
    def mark(place: Column, rect: Column) -> Column:
        return F.struct(place.alias("ord"), *(rect[i].alias(x) for i, x in enumerate(_BOX)))

    if "annots" in layout.columns:
        own = F.filter("annots", lambda a: (a["subtype"] == "/Redact") & a["rect"].isNotNull())
        pages = layout.select(*_PAGE, *_text(layout), F.transform(own, lambda a: mark(a["ord"], a["rect"])).alias("marks"))
    else:
        marks = annots.where("rect IS NOT NULL").groupBy(*_PAGE).agg(F.collect_list(mark(F.col("ord"), F.col("rect"))).alias("marks"))
        pages = layout.select(*_PAGE, *_text(layout)).join(marks, list(_PAGE))
    found = _under(pages, "marks", heavy).select(*_PAGE, "b.ord", _read(F.col("g")).alias("under"))
    return annots.join(found, [*_PAGE, "ord"], "left").withColumn("under", F.coalesce("under", F.lit("")))
