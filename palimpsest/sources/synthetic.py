"""Layout, operators, revisions and more, made of plain tables by exact arithmetic.

Numbers are integers or dyadic fractions, so any engine computes the same boxes. A page holds
50 lines of 80 characters; some lines are shifted off the page, tiny or white, and every page
has three small covers and a page-wide background. One page in 29 has XMP of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..plans.engine import Tables
from ..schema import ERRORS

PER_PAGE = 4000

_COVERS = """
array(
  {small},
  named_struct('cover_id', 3, 'kind', 'rect', 'top_level', true, 'x0', 0D, 'y0', 0D, 'x1', 612D, 'y1', 792D, 'brightness', 0.9375D)
)"""
_SMALL = """named_struct('cover_id', {k}, 'kind', '{kind}', 'top_level', true,
  'x0', CAST(76 + 6 * pmod(doc_id * 7 + page * 5 + {k} * 13, 60) AS double), 'y0', CAST(720 - 14 * pmod(doc_id * 3 + {k} * 17, 50) + {up} AS double),
  'x1', CAST(76 + 6 * pmod(doc_id * 7 + page * 5 + {k} * 13, 60) + 6 * (5 + {k} * 4) AS double), 'y1', CAST(732 - 14 * pmod(doc_id * 3 + {k} * 17, 50) + {up} AS double), 'brightness', {bright})"""
COVERS = _COVERS.format(small=",\n  ".join(_SMALL.format(k=k, kind=kind, up=up, bright=b) for k, kind, up, b in ((0, "rect", 0, "0D"), (1, "rect", 0, "0.5D"), (2, "image", 8, "CAST(NULL AS double)"))))


def page_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, page, text, covers)."""
    rows = documents.where("length(text) > 0").select("doc_id", "text", F.explode(F.expr(f"sequence(1, CAST((length(text) + {PER_PAGE - 1}) div {PER_PAGE} AS int))")).alias("page"))
    return rows.select("doc_id", "page", F.expr(f"substring(text, (page - 1) * {PER_PAGE} + 1, {PER_PAGE})").alias("text"), F.expr(COVERS).alias("covers"))


def layout(documents: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Page rows of :data:`palimpsest.schema.LAYOUT`, with the ``runs`` that their glyphs are made of; of the pages (doc_id, page) in ``only``, if given, before any glyph is made."""
    pages = page_texts(documents)
    if only is not None:
        pages = pages.join(only, ["doc_id", "page"], "left_semi")
    # a line is a run of glyphs; detectors make glyphs only of the runs they need
    runs = f"""transform(sequence(0, CAST((length(text) + 79) div 80 AS int) - 1), k -> named_struct('glyph_id', (page - 1) * {PER_PAGE}L + 80 * k, 'text', substring(text, 80 * k + 1, 80),
      'x0', CASE WHEN pmod(doc_id + (page - 1) * 50 + k, 23) = 0 THEN 672D ELSE 72D END, 'y0', CAST(720 - 14 * k AS double), 'step', 6D, 'y1', CAST(732 - 14 * k AS double),
      'size', CASE WHEN pmod(doc_id + (page - 1) * 50 + k, 17) = 0 THEN 0.25D ELSE 12D END, 'brightness', CASE WHEN pmod(doc_id + (page - 1) * 50 + k, 11) = 0 THEN 1D ELSE 0D END))"""
    box = (F.lit(x).alias(name) for name, x in (("x0", 0.0), ("y0", 0.0), ("x1", 612.0), ("y1", 792.0)))
    pages = pages.repartition(2 * documents.sparkSession.sparkContext.defaultParallelism, "doc_id", "page").withColumn("runs", F.expr(runs))
    return pages.select("doc_id", "page", *box, (F.pmod(F.col("doc_id") + F.col("page"), F.lit(29)) == 3).alias("has_metadata"), E.glyphs_of(F.col("runs")).alias("glyphs"), "covers", "runs", F.length("text").cast("long").alias("n_glyphs"))


def stream_ops(events: DataFrame, forms: bool = False) -> DataFrame:
    """Events of a user as content-stream operators of one page; with ``forms``, some of them begin or end one."""
    form = "WHEN event_id % 11 = 3 THEN 'FORM_BEGIN' WHEN event_id % 11 = 8 THEN 'FORM_END' " if forms else ""
    op = F.expr(f"CASE {form}WHEN event_type = 'signup' THEN 'q' WHEN event_type = 'error' THEN 'Q' WHEN event_type = 'click' THEN 'Tj' ELSE 'Tr' END")
    mode = F.expr("CASE event_type WHEN 'view' THEN 3 WHEN 'purchase' THEN 0 END")
    shown = F.when(F.col("event_type") == "click", F.encode(F.concat(F.col("event_id").cast("string"), F.lit(" ")), "UTF-8"))
    one = F.struct(F.col("event_id").alias("seq"), op.alias("op"), mode.alias("int_arg"), shown.alias("shown"))
    return events.groupBy(F.col("user_id").alias("doc_id")).agg(F.array_sort(F.collect_list(one)).alias("ops")).select("doc_id", F.lit(1).alias("page"), "ops")


def revisions(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation as revisions of a document's row, the last one the current."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    ranked = F.transform(turns, lambda x, i: F.struct((i + 1).alias("rev_index"), x["text"].alias("text")))
    # small as the rows are, what is done with them isn't: they are dealt to all cores
    dealt = conversations.repartition(2 * conversations.sparkSession.sparkContext.defaultParallelism, "conv_id")
    return dealt.groupBy(F.col("conv_id").alias("doc_id")).agg(ranked.alias("revisions"))


def parts(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each turn of a conversation, as a revision, says about its one part, ``text``, and about the part of its role; and the number of revisions of each."""
    ranked = conversations.select(F.col("conv_id").alias("doc_id"), F.expr("CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS int)").alias("rev_index"), "role", "text")
    states = ranked.select("doc_id", F.explode(F.array(F.lit("text"), F.col("role"))).alias("part"), "rev_index", "text")
    return states, ranked.groupBy("doc_id").agg(F.max("rev_index").cast("long").alias("n_revisions"))


def filespecs(pages: DataFrame, part: DataFrame) -> DataFrame:
    href = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    linked = pages.select(F.pmod("page_id", F.lit(97)).alias("doc_id"), F.lit(2).alias("source_ord"), F.col("page_id").alias("ord"), F.explode(href).alias("name"), F.lit(-1).cast("long").alias("size"))
    size = F.when(F.col("p_size") % 5 == 0, -1).otherwise(F.col("p_size")).cast("long")
    stored = part.select(F.pmod("p_partkey", F.lit(97)).alias("doc_id"), F.lit(1).alias("source_ord"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), size.alias("size"))
    return stored.unionByName(linked)


def links(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, roots and entries of a graph for each seventh of the pages: a page leads to the names it links, a name to the pages whose first link it is; the smallest page is the root, and every link is a file of that name."""
    own = pages.select(F.pmod("page_id", F.lit(7)).alias("doc_id"), "page_id", F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("page"), F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)).alias("names"), F.octet_length("html").cast("long").alias("size"))
    down = own.select("doc_id", "page_id", F.col("page").alias("parent"), F.explode("names").alias("child"), "size")
    across = own.where(F.size("names") > 0).select("doc_id", F.col("names")[0].alias("parent"), F.col("page").alias("child"))
    roots = own.groupBy("doc_id").agg(F.min_by("page", "page_id").alias("node"))
    size = F.when(F.col("page_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("size"))
    entries = down.select("doc_id", F.col("child").alias("node"), F.lit(2).alias("source_ord"), F.col("page_id").alias("ord"), F.col("child").alias("name"), size.alias("size"))
    return down.select("doc_id", "parent", "child").union(across), roots, entries


def info(pages: DataFrame) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(key).alias("key"), F.regexp_extract("html", pattern, 1).alias("value")) for i, (key, pattern) in enumerate((("/Title", "<title>([^<]*)</title>"), ("/Lang", 'lang="([^"]*)"'), ("/Producer", 'charset="([^"]*)"'), ("/Trapped", "<trapped>([^<]*)<")))))
    return pages.select(F.col("page_id").alias("doc_id"), F.explode(entries).alias("e")).select("doc_id", "e.ord", "e.key", "e.value")


def xmp_fields(pages: DataFrame) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(name).alias("name"), F.regexp_extract("html", pattern, 1).alias("value")) for i, (name, pattern) in enumerate((("title", "<h1>([^<]*)</h1>"), ("creator", "<b>([^<]*)<"), ("CreatorTool", 'charset="([^"]*)"'), ("format", "<p>([^<]*)<"), ("rights", '<div class="ad">([^<]*)<'), ("subject", '<div class="ad">([^<]*)<')))))
    return pages.select(F.col("page_id").alias("doc_id"), F.explode(entries).alias("e")).select("doc_id", "e.ord", "e.name", "e.value")


def annots(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """A redaction mark on page 1 of each labelled document of low quality, a note with its text on the others."""
    box = F.expr("array(CAST(72 + 6 * pmod(doc_id * 7, 40) AS double), CAST(720 - 14 * pmod(doc_id * 3, 20) AS double), CAST(132 + 6 * pmod(doc_id * 7, 40) AS double), CAST(732 - 14 * pmod(doc_id * 3, 20) AS double))")
    mark = F.col("quality") == 0
    rows = labels.join(documents.select("doc_id", "text"), "doc_id")
    return rows.select(
        "doc_id", F.lit(1).alias("page"), F.lit(0).alias("ord"), F.when(mark, "/Redact").otherwise("/Text").alias("subtype"), F.when(mark, box).alias("rect"),
        F.when(mark, F.when(F.col("toxic") == 1, F.lit(" mark ")).otherwise("")).otherwise(F.col("text")).alias("contents"), F.lit("").alias("rc"), F.when(mark & (F.col("doc_id") % 2 == 0), "REDACTED").alias("overlay_text"),
    )


def event_findings(events: DataFrame) -> DataFrame:
    """Events other than errors as findings of their user."""
    severity = F.expr("CASE event_type WHEN 'signup' THEN 'info' WHEN 'view' THEN 'low' WHEN 'click' THEN 'medium' WHEN 'purchase' THEN 'high' END")
    return events.where("event_type <> 'error'").select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("vector"), severity.alias("severity"), F.col("props").alias("description"), F.expr("nullif(CAST(event_id % 7 AS int), 0)").alias("page"),
        F.lit(None).cast("array<double>").alias("bbox"), F.col("event_id").cast("string").alias("evidence"), F.lit(None).cast("string").alias("recommendation"), F.lit(0).alias("detector_ord"), F.col("event_id").alias("emit_ord"),
    )


def event_errors(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'error'").select(F.col("user_id").alias("doc_id"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("detector"), F.col("props").alias("message"))


def opened(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events as documents, most of which could not be opened, and their errors."""
    status = F.expr("CASE event_type WHEN 'signup' THEN 'oversize' WHEN 'view' THEN 'encrypted' WHEN 'click' THEN 'corrupt' WHEN 'error' THEN 'unreadable' ELSE 'ok' END")
    docs = events.select(F.col("event_id").alias("doc_id"), status.alias("open_status"))
    errors = events.select(F.col("event_id").alias("doc_id"), F.when(F.col("event_type") == "purchase", "metadata").alias("detector"), F.when(F.col("event_id") % 3 > 0, F.col("props")).alias("message"))
    return docs, errors


def xmp(pages: DataFrame) -> DataFrame:
    return pages.where("page_id % 3 = 0").select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 2 == 0, F.octet_length("html").cast("long")).alias("bytes"))


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All tables of the engine, made of the plain tables."""

    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    documents, pages = t("documents"), t("pages")
    docs = documents.select("doc_id", F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").cast("bigint").alias("length"), F.lit("ok").alias("open_status"))
    return Tables(
        docs=docs, layout=layout(documents), stream_ops=stream_ops(t("events")), revisions=revisions(t("conversations")), filespecs=filespecs(pages, t("part")), info=info(pages), xmp=xmp(pages), xmp_fields=xmp_fields(pages),
        annots=annots(t("labels"), documents), errors=spark.createDataFrame([], ERRORS),
    )
