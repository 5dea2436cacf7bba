"""The registered queries of the reference's own operators, and SQL for each."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as E
from .operators import annotations, attachments, layout, metadata, parts, report, revisions, stream, trees
from .operators.findings import finding
from .plans import engine
from .plans.opaque import Opaque
from .schema import DESCRIPTIONS, VECTORS
from .sources import files, synthetic


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def covered_text(spark: SparkSession, d: str) -> DataFrame:
    rows = layout.covered_spans(synthetic.layout(_t(spark, d, "documents")))
    c = F.col("c")
    return rows.select("doc_id", "page", c["cover_id"].alias("cover_id"), E.cover_severity(c["kind"], c["brightness"]).alias("severity"), c["x0"].alias("x0"), c["y0"].alias("y0"), "n_glyphs", "evidence")


def cover_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.counts_by_severity(layout.covered_text(synthetic.layout(_t(spark, d, "documents"))))


def hidden_geometry(spark: SparkSession, d: str) -> DataFrame:
    return layout.hidden_pages(synthetic.layout(_t(spark, d, "documents"))).select("doc_id", "page", "n_white", "n_tiny", "n_offpage", F.substring("text", 1, 400).alias("evidence"))


def invisible_ops(spark: SparkSession, d: str) -> DataFrame:
    return stream.invisible_shows(synthetic.stream_ops(_t(spark, d, "events"))).select("doc_id", F.col("n").alias("n_shows"), F.decode("shown", "UTF-8").alias("evidence"))


def invisible_ops_forms(spark: SparkSession, d: str) -> DataFrame:
    """As invisible_ops, with operators that begin and end forms among them."""
    return stream.invisible_shows(synthetic.stream_ops(_t(spark, d, "events"), forms=True)).select("doc_id", F.col("n").alias("n_shows"), F.decode("shown", "UTF-8").alias("evidence"))


def revision_diff(spark: SparkSession, d: str) -> DataFrame:
    return revisions.recovered(synthetic.revisions(_t(spark, d, "conversations")))


def revision_status(spark: SparkSession, d: str) -> DataFrame:
    return revisions.status(synthetic.revisions(_t(spark, d, "conversations")))


def revision_tokens_except_all(spark: SparkSession, d: str) -> DataFrame:
    rows = revisions.examined(synthetic.revisions(_t(spark, d, "conversations")))
    first, last = (revisions.token_rows(rows.selectExpr("doc_id", f"{x}.rev_index AS rev_index", f"{x}.text AS text")).select("doc_id", "token") for x in ("earlier[0]", "last"))
    return first.exceptAll(last)


def revision_diff_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The rows of revision_diff by change rows of one part: a text that a revision repeats is stored and compared once."""
    states, numbers = synthetic.parts(_t(spark, d, "conversations"))
    changed = parts.changes(states.where("part = 'text'"))
    return parts.recovered_as_of(changed, numbers).select("doc_id", "rev_index", "n_tokens", "evidence")


def revisions_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Every revision with the version of each role's part that it shows."""
    states, numbers = synthetic.parts(_t(spark, d, "conversations"))
    rows = parts.as_of(parts.changes(states.where("part <> 'text'")), numbers)
    return rows.select("doc_id", "rev_index", "part", "version", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def linked_names(spark: SparkSession, d: str) -> DataFrame:
    return trees.names_below(*synthetic.links(_t(spark, d, "pages")))


def _odd_words(rows: list) -> list[dict]:
    """A detector as a function: the longest words of a document; it can't do with some documents, and gives others a severity that there isn't."""
    doc, text = rows[0]["doc_id"], rows[0]["text"] or ""
    if doc % 50 == 7:
        raise RuntimeError(f"document {doc} is not for this detector")
    words = sorted(set(text.split()), key=lambda w: (-len(w), w))[:2]
    return [dict(severity="none" if doc % 50 == 9 else "low", description="A long word.", evidence=w, page=1) for w in words]


def opaque_detector(spark: SparkSession, d: str) -> DataFrame:
    """Findings and errors of a detector that is a Python function of one document."""
    documents = _t(spark, d, "documents").select("doc_id", "text")
    rows = Opaque("odd_words", _odd_words, of=lambda _: documents).rows(None)
    return rows.select("doc_id", "vector", "severity", "page", "evidence", "emit_ord", "message")


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{files.work_folder(spark)}/palimpsest-{name}-{uuid.uuid4().hex}"


def isolated_failure(spark: SparkSession, d: str) -> DataFrame:
    """Reports of a detector that one document makes fail while it runs: that document has an error, all others their finding."""
    documents = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("path"))
    bad = F.when(F.col("doc_id") == 7, F.raise_error(F.lit("not this one")).cast("string")).otherwise(F.col("path"))
    tables = synthetic.tables(spark, d)
    tables.docs = documents
    one = engine.Engine({"named": lambda t: finding(t.docs, "named", "low", F.lit("It has a name."), bad, "r")})
    rows = one.reports(tables, to=_new_folder(spark, "isolated"))
    return rows.select("doc_id", "finding_count", F.size("detector_errors").alias("n_errors"), F.get("findings.evidence", F.lit(0)).alias("evidence"), "stamp", "exit_code")


def report_files(spark: SparkSession, d: str) -> DataFrame:
    """Reports written as files by stamp, and read back."""
    to = _new_folder(spark, "reports")
    report.written_reports(_reports(spark, d), to)
    return spark.read.schema("value string, stamp string").text(f"{to}/reports").select("stamp", F.col("value").alias("json"))


def attachment_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return attachments.distinct_files(synthetic.filespecs(_t(spark, d, "pages"), _t(spark, d, "part")))


def metadata_info(spark: SparkSession, d: str) -> DataFrame:
    return metadata.info_entries(synthetic.info(_t(spark, d, "pages"))).select("doc_id", "key", "value", "severity")


def metadata_xmp_antijoin(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "pages")
    return metadata.xmp_entries(synthetic.xmp_fields(pages), synthetic.info(pages)).select("doc_id", "name", "value", "severity")


def redact_under_rect(spark: SparkSession, d: str) -> DataFrame:
    documents = _t(spark, d, "documents")
    marks = synthetic.annots(_t(spark, d, "labels"), documents).where("subtype = '/Redact'")
    return annotations.redact_evidence(marks, synthetic.layout(documents, marks.select("doc_id", "page"))).select("doc_id", "page", "evidence")


def annotation_notes(spark: SparkSession, d: str) -> DataFrame:
    return annotations.notes(synthetic.annots(_t(spark, d, "labels"), _t(spark, d, "documents"))).select("doc_id", "page", "evidence")


def _reports(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events")
    docs = events.select(F.col("user_id").alias("doc_id")).distinct().withColumn("path", F.concat(F.lit("user-"), F.col("doc_id").cast("string")))
    return report.rollup(docs, synthetic.event_findings(events), synthetic.event_errors(events))


def report_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("doc_id", "path", "worst_severity", "finding_count", F.size("detector_errors").cast("long").alias("n_errors"), "incomplete", "clean", "stamp", "exit_code")


def report_order(spark: SparkSession, d: str) -> DataFrame:
    return report.ordered(synthetic.event_findings(_t(spark, d, "events"))).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "severity", "vector", "page", "emit_ord")


def report_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.counts_by_severity(synthetic.event_findings(_t(spark, d, "events")), ("doc_id",))


def report_json(spark: SparkSession, d: str) -> DataFrame:
    return report.as_json(_reports(spark, d))


def report_text(spark: SparkSession, d: str) -> DataFrame:
    return report.as_text(_reports(spark, d))


def error_envelopes(spark: SparkSession, d: str) -> DataFrame:
    return report.envelopes(*synthetic.opened(_t(spark, d, "events")))


def threshold_gate(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events")
    one = events.groupBy(F.col("user_id").alias("doc_id")).agg(F.max(F.expr("CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END")).alias("w"), F.count_if(F.col("event_type") == "error").alias("e"))
    gates = F.array(*(F.struct(F.lit(s).alias("fail_on"), F.lit(on).alias("fail_on_error"), report.gate(F.col("w"), F.col("e"), s, on).alias("exit_code")) for s in E.SEVERITIES for on in (True, False)))
    return one.select("doc_id", F.explode(gates).alias("x")).select("doc_id", "x.*")


def evidence_snippets(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select("conv_id", "turn", report.snippet(F.col("text")).alias("snippet"))


def geometry(spark: SparkSession, d: str) -> DataFrame:
    """P1-P5 over lines of orders: one box for the line, one for its part."""
    box = "named_struct('x0', CAST({0} AS double), 'y0', CAST({1} AS double), 'x1', CAST({2} AS double), 'y1', CAST({3} AS double))"
    rows = _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr(box.format("l_quantity", "l_linenumber", "l_quantity + l_suppkey % 8", "l_linenumber + l_partkey % 4")).alias("a"),
        F.expr(box.format("l_partkey % 50", "l_suppkey % 7", "l_partkey % 50 + 16", "l_suppkey % 7 + 8")).alias("b"), F.expr("slice(array(l_discount, l_tax, CAST(0.5 AS double), CAST(0.25 AS double)), 1, CAST(l_orderkey % 5 AS int))").alias("color"),
    )
    a, b = F.col("a"), F.col("b")
    return rows.select("l_orderkey", "l_linenumber", E.area(a).alias("area"), E.overlap_ratio(a, b).alias("overlap"), E.center_inside(a, b, 1.0).alias("inside"), E.brightness(F.col("color")).alias("brightness"))


def _choices(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, known, strange): what the comma list that each event makes of its number chooses."""
    name = lambda i, v: F.when(F.col("event_id").bitwiseAND(1 << i) != 0, F.lit(f" {v}" if i % 2 else f"{v} "))
    ghosts = [F.when(F.col("event_id") % 10 == 0, F.lit("ghosts")), F.when(F.col("event_id") % 4 == 0, F.lit(" colour"))]
    text = F.concat(F.concat_ws(",", *ghosts, *(name(i, v) for i, v in enumerate(VECTORS))), F.lit(", ,"))
    known, strange = engine.chosen_of(text)
    return _t(spark, d, "events").select("event_id", known.alias("known"), strange.alias("strange"))


def only_filter(spark: SparkSession, d: str) -> DataFrame:
    return _choices(spark, d).select("event_id", F.array_join("known", ",").alias("chosen"))


def unknown_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _choices(spark, d).select("event_id", F.explode("strange").alias("name"))


def vector_registry(spark: SparkSession, d: str) -> DataFrame:
    """The registry, with how many events choose each detector."""
    n = _choices(spark, d).select(F.explode("known").alias("name")).groupBy("name").agg(F.count("*").alias("n_chosen"))
    return engine.vectors(spark).join(n, "name", "left").select("ord", "name", "description", F.coalesce("n_chosen", F.lit(0)).cast("long").alias("n_chosen"))


def finding_count_minimum(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events")
    docs, findings = events.select(F.col("user_id").alias("doc_id")).distinct(), synthetic.event_findings(events)
    return reduce(DataFrame.union, [report.count_at_least(docs, findings, s).select("doc_id", F.lit(s).alias("minimum"), "n") for s in E.SEVERITIES])


def page_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Byte sizes, escaped titles and whether a request with the page might be read, over pages."""
    size = F.octet_length("html") * F.pmod("page_id", F.lit(5000))
    stated = F.expr("CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'chunked' WHEN 2 THEN CAST(octet_length(html) * 9 AS string) ELSE CAST(octet_length(html) AS string) END")
    return _t(spark, d, "pages").select("page_id", E.byte_size(size.cast("long")).alias("size"), E.xml_escape(F.substring("html", 1, 80)).alias("escaped"), E.body_allowed(stated, 512).alias("allowed"))


def _findings(detector: str) -> Callable[[SparkSession, str], DataFrame]:
    """All columns of a detector's findings, as the engine gives them."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        tables = synthetic.tables(spark, d)
        if detector == "redact_annotations":
            tables.layout = synthetic.layout(_t(spark, d, "documents"), tables.annots.where("subtype = '/Redact'").select("doc_id", "page"))
        rows = engine.Engine().findings(tables, [detector])
        box = (F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1")))
        return rows.select("doc_id", "vector", "severity", "description", "page", *box, "evidence", "recommendation", "detector_ord", "emit_ord")

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        covered_text, cover_severity_counts, hidden_geometry, invisible_ops, invisible_ops_forms, revision_diff, revision_diff_as_of, revisions_as_of, linked_names, opaque_detector, isolated_failure, revision_status, revision_tokens_except_all, attachment_dedupe, metadata_info, metadata_xmp_antijoin, redact_under_rect,
        annotation_notes, report_rollup, report_order, report_counts, report_json, report_text, report_files, error_envelopes, threshold_gate, evidence_snippets, geometry, only_filter, unknown_vectors, vector_registry, finding_count_minimum, page_sizes,
    )
} | {f"findings_{v}": _findings(v) for v in VECTORS}

_GLYPHS = """
c0 AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM documents WHERE length(text) > 0),
c1 AS (SELECT *, i // 80 AS line FROM c0 WHERE trim(ch, E' \\t\\n\\r\\x0b\\x0c') <> ''),
g AS (SELECT doc_id, line // 50 + 1 AS page, i AS glyph_id, ch, CAST(72 + 6 * (i % 80) + CASE WHEN (doc_id + line) % 23 = 0 THEN 600 ELSE 0 END AS DOUBLE) AS x0, CAST(720 - 14 * (line % 50) AS DOUBLE) AS y0,
  CASE WHEN (doc_id + line) % 17 = 0 THEN 0.25::DOUBLE ELSE 12 END AS size, CASE WHEN (doc_id + line) % 11 = 0 THEN 1 ELSE 0 END AS brightness FROM c1),
p AS (SELECT doc_id, unnest(range(1, (length(text) + 3999) // 4000 + 1)) AS page FROM documents WHERE length(text) > 0),
k AS (SELECT * FROM (VALUES (0, 'rect', 0::DOUBLE, 0), (1, 'rect', 0.5::DOUBLE, 0), (2, 'image', NULL, 8)) t(k, kind, brightness, up)),
c AS (SELECT doc_id, page, k AS cover_id, kind, brightness, CAST(76 + 6 * ((doc_id * 7 + page * 5 + k * 13) % 60) AS DOUBLE) AS x0, CAST(720 - 14 * ((doc_id * 3 + k * 17) % 50) + up AS DOUBLE) AS y0, CAST(6 * (5 + k * 4) AS DOUBLE) AS w FROM p, k)
"""
_COVERED = f"""{_GLYPHS},
h AS (SELECT c.doc_id, c.page, c.cover_id, CASE WHEN kind = 'rect' AND c.brightness <= 0.35::DOUBLE THEN 'critical' ELSE 'high' END AS severity, c.x0, c.y0, count(*) AS n_glyphs, string_agg(ch, '' ORDER BY g.y0 DESC, g.x0, glyph_id) AS evidence
  FROM g JOIN c ON g.doc_id = c.doc_id AND g.page = c.page
  WHERE greatest(0::DOUBLE, least(g.x0 + 6, c.x0 + c.w) - greatest(g.x0, c.x0)) * greatest(0::DOUBLE, least(g.y0 + 12, c.y0 + 12) - greatest(g.y0, c.y0)) / 72::DOUBLE >= 0.30::DOUBLE
  GROUP BY ALL)"""
_REVISIONS = """
r0 AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rev_index, text FROM conversations),
r AS (SELECT *, max(rev_index) OVER (PARTITION BY doc_id) AS last_index, count(*) OVER (PARTITION BY doc_id) AS n_revisions FROM r0),
t0 AS (SELECT doc_id, rev_index, last_index, list_filter(regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+'), lambda t: regexp_matches(t, '[A-Za-z0-9]')) AS t FROM r WHERE rev_index <= 64 OR rev_index = last_index),
t AS (SELECT doc_id, rev_index, last_index, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM t0),
n AS (SELECT doc_id, rev_index, last_index, token, count(*) AS n, min(pos) AS pos FROM t GROUP BY ALL),
lost AS (SELECT e.doc_id, e.rev_index, e.token, e.pos FROM n e LEFT JOIN n l ON l.doc_id = e.doc_id AND l.rev_index = l.last_index AND l.token = e.token WHERE e.rev_index < e.last_index AND e.n > coalesce(l.n, 0)),
f AS (SELECT doc_id, CAST(rev_index AS INTEGER) AS rev_index, count(*) AS n_tokens, array_to_string(list_slice(list(token ORDER BY pos), 1, 60), ' ') AS evidence FROM lost GROUP BY doc_id, rev_index)
"""
_FINDINGS = """
f AS (SELECT user_id AS doc_id, event_type AS vector, CASE event_type WHEN 'signup' THEN 'info' WHEN 'view' THEN 'low' WHEN 'click' THEN 'medium' WHEN 'purchase' THEN 'high' END AS severity,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END AS rank, CAST(nullif(event_id % 7, 0) AS INTEGER) AS page, event_id AS emit_ord FROM events WHERE event_type <> 'error')
"""
_TRIM = "E' \\t\\n\\r\\x0b\\x0c'"
_ANNOTS = "a AS (SELECT l.doc_id, quality, toxic, text FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
_INFO = """i AS (SELECT page_id AS doc_id, unnest([{'key': '/Title', 'value': regexp_extract(html, '<title>([^<]*)</title>', 1)}, {'key': '/Lang', 'value': regexp_extract(html, 'lang="([^"]*)"', 1)}, {'key': '/Producer', 'value': regexp_extract(html, 'charset="([^"]*)"', 1)}, {'key': '/Trapped', 'value': regexp_extract(html, '<trapped>([^<]*)<', 1)}], recursive := true) FROM pages),
info AS (SELECT doc_id, key, trim(value, """ + _TRIM + """) AS value, CASE WHEN key IN ('/Producer', '/Trapped') THEN 'info' ELSE 'medium' END AS severity FROM i WHERE trim(value, """ + _TRIM + """) <> '')"""

_REPORTS = """
e0 AS (SELECT user_id AS doc_id, event_id, event_type AS vector, CASE event_type WHEN 'signup' THEN 'info' WHEN 'view' THEN 'low' WHEN 'click' THEN 'medium' WHEN 'purchase' THEN 'high' END AS severity,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END AS rank, CAST(nullif(event_id % 7, 0) AS INTEGER) AS page, props FROM events),
u AS (SELECT DISTINCT doc_id, 'user-' || doc_id AS path FROM e0),
w AS (SELECT doc_id, ['info', 'low', 'medium', 'high'][max(rank)] AS worst, count(*) AS n FROM e0 WHERE vector <> 'error' GROUP BY doc_id)
"""
_OPS = """
o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 0 AS mode, CAST([] AS INTEGER[]) AS st, CAST(0 AS BIGINT) AS n, '' AS shown FROM o
  UNION ALL SELECT s.user_id, o.k, CASE event_type WHEN 'view' THEN 3 WHEN 'purchase' THEN 0 WHEN 'error' THEN CASE WHEN len(st) > 0 THEN st[len(st)] ELSE mode END ELSE mode END,
    CASE event_type WHEN 'signup' THEN list_append(st, mode) WHEN 'error' THEN CASE WHEN len(st) > 0 THEN st[1:len(st) - 1] ELSE st END ELSE st END,
    n + CASE WHEN event_type = 'click' AND mode = 3 THEN 1 ELSE 0 END, shown || CASE WHEN event_type = 'click' AND mode = 3 THEN event_id || ' ' ELSE '' END
  FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1),
ops AS (SELECT user_id AS doc_id, n AS n_shows, shown AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS r FROM s) WHERE r = 1 AND n > 0)
"""

_CHOICES = "c AS (SELECT event_id, CASE WHEN event_id % 64 = 0 AND event_id % 10 <> 0 AND event_id % 4 <> 0 THEN a ELSE list_filter(a, lambda x: (event_id >> (list_position(a, x) - 1)) & 1 = 1) END AS known, list_filter(['colour', 'ghosts'], lambda x: event_id % CASE x WHEN 'colour' THEN 4 ELSE 10 END = 0) AS strange FROM (SELECT event_id, [" + ", ".join(f"'{v}'" for v in VECTORS) + "] AS a FROM events))"
_FORMS = """
o AS (SELECT user_id, event_id, CASE WHEN event_id % 11 = 3 THEN 'form' WHEN event_id % 11 = 8 THEN 'end' ELSE event_type END AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 0 AS mode, CAST([] AS INTEGER[]) AS st, CAST([] AS STRUCT(m INTEGER, st INTEGER[])[]) AS fr, CAST(0 AS BIGINT) AS n, '' AS shown FROM o
  UNION ALL SELECT s.user_id, o.k,
    CASE op WHEN 'view' THEN 3 WHEN 'purchase' THEN 0 WHEN 'error' THEN CASE WHEN len(st) > 0 THEN st[len(st)] ELSE mode END WHEN 'end' THEN CASE WHEN len(fr) > 0 THEN fr[len(fr)].m ELSE mode END ELSE mode END,
    CASE op WHEN 'signup' THEN list_append(st, mode) WHEN 'error' THEN CASE WHEN len(st) > 0 THEN st[1:len(st) - 1] ELSE st END WHEN 'form' THEN CAST([] AS INTEGER[]) WHEN 'end' THEN CASE WHEN len(fr) > 0 THEN fr[len(fr)].st ELSE st END ELSE st END,
    CASE op WHEN 'form' THEN list_append(fr, {'m': mode, 'st': st}) WHEN 'end' THEN CASE WHEN len(fr) > 0 THEN fr[1:len(fr) - 1] ELSE fr END ELSE fr END,
    n + CASE WHEN op = 'click' AND mode = 3 THEN 1 ELSE 0 END, shown || CASE WHEN op = 'click' AND mode = 3 THEN event_id || ' ' ELSE '' END
  FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1),
ops AS (SELECT user_id AS doc_id, n AS n_shows, shown AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS r FROM s) WHERE r = 1 AND n > 0)
"""


def _row(vector: str, severity: str, description: str, page: str, evidence: str, recommendation: str, emit: str, source: str, box: tuple[str, ...] = ("NULL",) * 4) -> str:
    """A finding in SQL."""
    corners = ", ".join(f"CAST({x} AS DOUBLE) AS {c}" for x, c in zip(box, ("x0", "y0", "x1", "y1")))
    return f"SELECT doc_id, '{vector}' AS vector, {severity} AS severity, {description} AS description, CAST({page} AS INTEGER) AS page, {corners}, {evidence} AS evidence, '{recommendation.replace(chr(39), chr(39) * 2)}' AS recommendation, {VECTORS.index(vector)} AS detector_ord, CAST({emit} AS BIGINT) AS emit_ord FROM {source}"


ORACLE_SQL: dict[str, str] = {
    "covered_text": f"WITH {_COVERED} SELECT doc_id, CAST(page AS INTEGER) AS page, cover_id, severity, x0, y0, n_glyphs, evidence FROM h",
    "cover_severity_counts": f"WITH {_COVERED} SELECT s.severity, count(h.severity) AS n FROM (VALUES ('info'), ('low'), ('medium'), ('high'), ('critical')) s(severity) LEFT JOIN h ON h.severity = s.severity GROUP BY s.severity",
    "hidden_geometry": f"""WITH {_GLYPHS},
w AS (SELECT *, CASE WHEN x0 + 6 < 0 OR x0 > 612 OR y0 + 12 < 0 OR y0 > 792 THEN 'offpage' WHEN size <= 0.5::DOUBLE THEN 'tiny' WHEN brightness >= 0.95::DOUBLE AND NOT EXISTS (
  SELECT 1 FROM c WHERE c.doc_id = g.doc_id AND c.page = g.page AND kind = 'rect' AND c.brightness <= 0.35::DOUBLE
    AND greatest(0::DOUBLE, least(g.x0 + 6, c.x0 + c.w) - greatest(g.x0, c.x0)) * greatest(0::DOUBLE, least(g.y0 + 12, c.y0 + 12) - greatest(g.y0, c.y0)) / 72::DOUBLE >= 0.30::DOUBLE) THEN 'white' END AS why FROM g)
SELECT doc_id, CAST(page AS INTEGER) AS page, count(*) FILTER (WHERE why = 'white') AS n_white, count(*) FILTER (WHERE why = 'tiny') AS n_tiny, count(*) FILTER (WHERE why = 'offpage') AS n_offpage,
  left(string_agg(ch, '' ORDER BY y0 DESC, x0, glyph_id), 400) AS evidence FROM w WHERE why IS NOT NULL GROUP BY doc_id, page""",
    "invisible_ops": f"WITH RECURSIVE {_OPS} SELECT * FROM ops",
    "invisible_ops_forms": f"WITH RECURSIVE {_FORMS} SELECT * FROM ops",
    "revision_diff": f"WITH {_REVISIONS} SELECT * FROM f",
    "revision_diff_as_of": f"""WITH {_REVISIONS},
v AS (SELECT doc_id, rev_index, text FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY rev_index) AS p FROM r) WHERE rev_index = 1 OR text IS DISTINCT FROM p),
a AS (SELECT r.doc_id, r.rev_index, r.last_index, v.text FROM r ASOF JOIN v ON r.doc_id = v.doc_id AND r.rev_index >= v.rev_index WHERE r.rev_index <= 64 OR r.rev_index = last_index),
ax AS (SELECT doc_id, rev_index, last_index, list_filter(regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+'), lambda t: regexp_matches(t, '[A-Za-z0-9]')) AS t FROM a),
an AS (SELECT doc_id, rev_index, last_index, token, count(*) AS n, min(pos) AS pos FROM (SELECT doc_id, rev_index, last_index, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM ax) GROUP BY ALL),
al AS (SELECT e.doc_id, e.rev_index, e.token, e.pos FROM an e LEFT JOIN an l ON l.doc_id = e.doc_id AND l.rev_index = l.last_index AND l.token = e.token WHERE e.rev_index < e.last_index AND e.n > coalesce(l.n, 0))
SELECT doc_id, CAST(rev_index AS INTEGER) AS rev_index, count(*) AS n_tokens, array_to_string(list_slice(list(token ORDER BY pos), 1, 60), ' ') AS evidence FROM al GROUP BY doc_id, rev_index""",
    "revisions_as_of": """WITH r AS (SELECT conv_id AS doc_id, role AS part, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rev_index FROM conversations),
v AS (SELECT doc_id, part, rev_index, text FROM (SELECT *, row_number() OVER w AS k, lag(text) OVER w AS p FROM r WINDOW w AS (PARTITION BY doc_id, part ORDER BY rev_index)) WHERE k = 1 OR text IS DISTINCT FROM p),
g AS (SELECT DISTINCT r.doc_id, r.rev_index, p.part FROM r JOIN (SELECT DISTINCT doc_id, part FROM r) p ON p.doc_id = r.doc_id)
SELECT g.doc_id, CAST(g.rev_index AS INTEGER) AS rev_index, g.part, CAST(v.rev_index AS INTEGER) AS version, sha256(coalesce(v.text, '')) AS text_sha256 FROM g ASOF JOIN v ON g.doc_id = v.doc_id AND g.part = v.part AND g.rev_index >= v.rev_index""",
    "linked_names": """WITH RECURSIVE p AS (SELECT page_id % 7 AS doc_id, page_id, 'page ' || page_id AS page, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS names, CAST(strlen(html) AS BIGINT) AS size FROM pages),
d AS (SELECT doc_id, page_id, page AS parent, unnest(names) AS child, size FROM p),
e AS (SELECT doc_id, parent, child FROM d UNION SELECT doc_id, names[1], page FROM p WHERE len(names) > 0),
w AS (SELECT doc_id, arg_min(page, page_id) AS node, 0 AS depth FROM p GROUP BY doc_id UNION SELECT w.doc_id, e.child, depth + 1 FROM w JOIN e ON e.doc_id = w.doc_id AND e.parent = w.node WHERE depth < 50),
s AS (SELECT doc_id, child AS name, page_id, CASE WHEN page_id % 3 = 0 THEN -1 ELSE size END AS size FROM d WHERE EXISTS (SELECT 1 FROM w WHERE w.doc_id = d.doc_id AND w.node = d.child))
SELECT doc_id, name, coalesce(arg_min(size, page_id) FILTER (WHERE size >= 0), -1) AS size FROM s GROUP BY doc_id, name""",
    "opaque_detector": """WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS w FROM documents),
f AS (SELECT doc_id, unnest(list_sort(list_transform(w, lambda x: {'n': -length(x), 'x': x}))[1:2]) AS f, unnest(range(len(w[1:2]))) AS emit_ord FROM t WHERE doc_id % 50 NOT IN (7, 9))
SELECT doc_id, 'odd_words' AS vector, 'low' AS severity, 1 AS page, f.x AS evidence, emit_ord, NULL AS message FROM f
UNION ALL SELECT doc_id, 'odd_words', NULL, NULL, NULL, 0, CASE doc_id % 50 WHEN 7 THEN 'RuntimeError: document ' || doc_id || ' is not for this detector' ELSE 'ValueError: severity is one of info, low, medium, high, critical, not ' || chr(39) || 'none' || chr(39) END FROM t WHERE doc_id % 50 = 7 OR (doc_id % 50 = 9 AND len(w) > 0)""",
    "revision_status": f"""WITH {_REVISIONS},
b AS (SELECT doc_id, max(n_revisions) AS n_revisions, count(*) AS n_earlier, count(*) FILTER (WHERE trim(coalesce(text, ''), {_TRIM}) = '') AS n_blank FROM r WHERE rev_index < last_index AND rev_index <= 64 GROUP BY doc_id)
SELECT b.*, EXISTS (SELECT 1 FROM f WHERE f.doc_id = b.doc_id) AS any_recovered FROM b""",
    "revision_tokens_except_all": f"WITH {_REVISIONS} SELECT doc_id, token FROM t WHERE rev_index = 1 AND last_index > 1 EXCEPT ALL SELECT doc_id, token FROM t WHERE rev_index = last_index AND last_index > 1",
    "attachment_dedupe": """WITH s AS (SELECT p_partkey % 97 AS doc_id, 1 AS src, p_partkey AS ord, p_name AS name, CAST(CASE WHEN p_size % 5 = 0 THEN -1 ELSE p_size END AS BIGINT) AS size FROM part
  UNION ALL SELECT page_id % 97, 2, page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)), -1 FROM pages)
SELECT doc_id, name, coalesce(arg_min(size, {'a': src, 'b': ord}) FILTER (WHERE size >= 0), -1) AS size FROM s GROUP BY doc_id, name""",
    "metadata_info": f"WITH {_INFO} SELECT doc_id, key, value, severity FROM info",
    "metadata_xmp_antijoin": f"""WITH {_INFO},
x AS (SELECT page_id AS doc_id, unnest([{{'ord': 0, 'name': 'title', 'value': regexp_extract(html, '<h1>([^<]*)</h1>', 1)}}, {{'ord': 1, 'name': 'creator', 'value': regexp_extract(html, '<b>([^<]*)<', 1)}}, {{'ord': 2, 'name': 'CreatorTool', 'value': regexp_extract(html, 'charset="([^"]*)"', 1)}}, {{'ord': 4, 'name': 'rights', 'value': regexp_extract(html, '<div class="ad">([^<]*)<', 1)}}, {{'ord': 5, 'name': 'subject', 'value': regexp_extract(html, '<div class="ad">([^<]*)<', 1)}}], recursive := true) FROM pages),
y AS (SELECT doc_id, ord, name, left(value, 200) AS value FROM x WHERE value <> ''),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY ord) AS r FROM y)
SELECT doc_id, name, value, CASE WHEN name = 'CreatorTool' THEN 'info' ELSE 'medium' END AS severity FROM z WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM info WHERE info.doc_id = z.doc_id AND info.value = z.value)""",
    "redact_under_rect": f"""WITH {_GLYPHS}, {_ANNOTS},
m AS (SELECT doc_id, toxic, CAST(72 + 6 * ((doc_id * 7) % 40) AS DOUBLE) AS x0, CAST(720 - 14 * ((doc_id * 3) % 20) AS DOUBLE) AS y0 FROM a WHERE quality = 0),
u AS (SELECT m.doc_id, string_agg(ch, '' ORDER BY g.y0 DESC, g.x0, glyph_id) AS under FROM m JOIN g ON g.doc_id = m.doc_id AND g.page = 1
  WHERE greatest(0::DOUBLE, least(g.x0 + 6, m.x0 + 60) - greatest(g.x0, m.x0)) * greatest(0::DOUBLE, least(g.y0 + 12, m.y0 + 12) - greatest(g.y0, m.y0)) / 72::DOUBLE >= 0.30::DOUBLE GROUP BY m.doc_id)
SELECT m.doc_id, 1 AS page, coalesce(nullif(concat_ws(' | ', CASE WHEN under <> '' THEN 'under redaction: ' || under END, CASE WHEN toxic = 1 THEN 'Contents: mark' END, CASE WHEN m.doc_id % 2 = 0 THEN 'OverlayText: REDACTED' END), ''), '(no recoverable text)') AS evidence
FROM m LEFT JOIN u ON u.doc_id = m.doc_id""",
    "annotation_notes": f"WITH {_ANNOTS} SELECT doc_id, 1 AS page, '/Text: ' || left(trim(text, {_TRIM}), 200) AS evidence FROM a WHERE quality <> 0 AND trim(text, {_TRIM}) <> ''",
    "report_rollup": f"""WITH {_FINDINGS}, w AS (SELECT doc_id, max(rank) AS w, count(*) AS n FROM f GROUP BY doc_id), e AS (SELECT user_id AS doc_id, count(*) AS e FROM events WHERE event_type = 'error' GROUP BY user_id),
u AS (SELECT DISTINCT user_id AS doc_id FROM events), x AS (SELECT u.doc_id, w, coalesce(n, 0) AS n, coalesce(e, 0) AS e, ['info', 'low', 'medium', 'high'][w] AS s FROM u LEFT JOIN w ON w.doc_id = u.doc_id LEFT JOIN e ON e.doc_id = u.doc_id)
SELECT doc_id, 'user-' || doc_id AS path, s AS worst_severity, n AS finding_count, e AS n_errors, e > 0 AS incomplete, w IS NULL AND e = 0 AS clean, CASE WHEN w IS NOT NULL THEN upper(s) WHEN e > 0 THEN 'PARTIAL' ELSE 'CLEAN' END AS stamp, CASE WHEN coalesce(w, 0) >= 4 THEN 2 WHEN e > 0 THEN 3 ELSE 0 END AS exit_code FROM x""",
    "report_order": f"WITH {_FINDINGS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, vector, coalesce(page, 0), emit_ord) AS ordinal, severity, vector, page, emit_ord FROM f",
    "report_counts": f"WITH {_FINDINGS} SELECT u.doc_id, s.severity, count(f.severity) AS n FROM (SELECT DISTINCT doc_id FROM f) u, (VALUES ('info'), ('low'), ('medium'), ('high'), ('critical')) s(severity) LEFT JOIN f ON f.doc_id = u.doc_id AND f.severity = s.severity GROUP BY u.doc_id, s.severity",
    "isolated_failure": """SELECT doc_id, CASE doc_id WHEN 7 THEN 0 ELSE 1 END AS finding_count, CASE doc_id WHEN 7 THEN 1 ELSE 0 END AS n_errors, CASE doc_id WHEN 7 THEN NULL ELSE 'document-' || doc_id END AS evidence,
  CASE doc_id WHEN 7 THEN 'PARTIAL' ELSE 'LOW' END AS stamp, CASE doc_id WHEN 7 THEN 3 ELSE 0 END AS exit_code FROM documents""",
    "error_envelopes": """WITH e AS (SELECT event_id AS doc_id, CASE event_type WHEN 'signup' THEN 413 WHEN 'view' THEN 415 WHEN 'click' THEN 422 ELSE 500 END AS status,
  CASE event_type WHEN 'signup' THEN 'oversize' WHEN 'view' THEN 'encrypted' WHEN 'click' THEN 'corrupt' END AS open_status, CASE WHEN event_id % 3 > 0 THEN props END AS message FROM events WHERE event_type <> 'purchase')
SELECT doc_id, status, CAST(to_json({'error': CASE WHEN open_status IS NULL THEN 'internal server error' ELSE coalesce(message, 'file is ' || open_status) END}) AS VARCHAR) AS json FROM e""",
    "threshold_gate": """WITH x AS (SELECT user_id AS doc_id, coalesce(max(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END), 0) AS w, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY user_id)
SELECT doc_id, fail_on, fail_on_error, CASE WHEN w >= r THEN 2 WHEN fail_on_error AND e > 0 THEN 3 ELSE 0 END AS exit_code FROM x, (VALUES ('info', 1), ('low', 2), ('medium', 3), ('high', 4), ('critical', 5)) s(fail_on, r), (VALUES (true), (false)) b(fail_on_error)""",
    "evidence_snippets": f"""WITH x AS (SELECT conv_id, turn, text, trim(replace(text, chr(10), ' ⏎ '), {_TRIM}) AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN '—' WHEN length(s) > 80 THEN left(s, 79) || '…' ELSE s END AS snippet FROM x""",
    "geometry": """WITH x AS (SELECT l_orderkey, l_linenumber, l_orderkey % 5 AS n, l_discount AS d, l_tax AS t, l_quantity AS ax0, CAST(l_linenumber AS DOUBLE) AS ay0, CAST(l_quantity + l_suppkey % 8 AS DOUBLE) AS ax1, CAST(l_linenumber + l_partkey % 4 AS DOUBLE) AS ay1,
  CAST(l_partkey % 50 AS DOUBLE) AS bx0, CAST(l_suppkey % 7 AS DOUBLE) AS by0, CAST(l_partkey % 50 + 16 AS DOUBLE) AS bx1, CAST(l_suppkey % 7 + 8 AS DOUBLE) AS by1 FROM lineitem),
y AS (SELECT *, greatest(0::DOUBLE, ax1 - ax0) * greatest(0::DOUBLE, ay1 - ay0) AS area, greatest(0::DOUBLE, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0::DOUBLE, least(ay1, by1) - greatest(ay0, by0)) AS inter, (ax0 + ax1) / 2::DOUBLE AS cx, (ay0 + ay1) / 2::DOUBLE AS cy FROM x)
SELECT l_orderkey, l_linenumber, area, CASE WHEN area <= 0 THEN CASE WHEN cx BETWEEN bx0 AND bx1 AND cy BETWEEN by0 AND by1 THEN 1::DOUBLE ELSE 0::DOUBLE END ELSE inter / area END AS overlap, cx BETWEEN bx0 - 1::DOUBLE AND bx1 + 1::DOUBLE AND cy BETWEEN by0 - 1::DOUBLE AND by1 + 1::DOUBLE AS inside,
  CASE n WHEN 1 THEN d WHEN 3 THEN (d + t + 0.5::DOUBLE) / 3::DOUBLE WHEN 4 THEN (1::DOUBLE - d) * 0.75::DOUBLE * 0.33::DOUBLE + (1::DOUBLE - t) * 0.75::DOUBLE * 0.33::DOUBLE + 0.5::DOUBLE * 0.75::DOUBLE * 0.34::DOUBLE END AS brightness FROM y""",
    "only_filter": f"WITH {_CHOICES} SELECT event_id, array_to_string(known, ',') AS chosen FROM c",
    "unknown_vectors": f"WITH {_CHOICES} SELECT event_id, unnest(strange) AS name FROM c",
    "vector_registry": f"WITH {_CHOICES}, n AS (SELECT name, count(*) AS n FROM (SELECT unnest(known) AS name FROM c) GROUP BY name) SELECT v.ord, v.name, v.description, coalesce(n, 0) AS n_chosen FROM (VALUES " + ", ".join(f"({i}, '{v}', '{DESCRIPTIONS[v]}')" for i, v in enumerate(VECTORS)) + ") v(ord, name, description) LEFT JOIN n ON n.name = v.name",
    "page_sizes": """WITH x AS (SELECT page_id, html, CAST(strlen(html) * (page_id % 5000) AS BIGINT) AS n FROM pages)
SELECT page_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0::DOUBLE * 10 + 0.5::DOUBLE) / 10) ELSE printf('%.1f MB', floor(n / 1048576.0::DOUBLE * 10 + 0.5::DOUBLE) / 10) END AS size,
  replace(replace(replace(left(html, 80), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, CASE page_id % 4 WHEN 2 THEN strlen(html) * 9 <= 4608 WHEN 3 THEN strlen(html) <= 4608 ELSE true END AS allowed FROM x""",
    "finding_count_minimum": """WITH u AS (SELECT DISTINCT user_id AS doc_id FROM events), x AS (SELECT user_id AS doc_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END AS r FROM events WHERE event_type <> 'error')
SELECT u.doc_id, s.minimum, count(x.r) AS n FROM u CROSS JOIN (VALUES ('info', 1), ('low', 2), ('medium', 3), ('high', 4), ('critical', 5)) s(minimum, k) LEFT JOIN x ON x.doc_id = u.doc_id AND x.r >= s.k GROUP BY u.doc_id, s.minimum""",
    "report_json": f"""WITH {_REPORTS},
f AS (SELECT doc_id, list({{'vector': vector, 'severity': severity, 'description': props, 'page': page, 'bbox': NULL::DOUBLE[], 'evidence': CAST(event_id AS VARCHAR), 'recommendation': NULL::VARCHAR}} ORDER BY rank DESC, vector, coalesce(page, 0), event_id) AS f FROM e0 WHERE vector <> 'error' GROUP BY doc_id),
e AS (SELECT doc_id, map_from_entries(list({{'k': 'event ' || event_id, 'v': props}} ORDER BY 'event ' || event_id)) AS e FROM e0 WHERE vector = 'error' GROUP BY doc_id)
SELECT u.doc_id, CAST(to_json({{'path': path, 'worst_severity': worst, 'finding_count': coalesce(n, 0), 'findings': coalesce(f, []), 'detector_errors': coalesce(e, MAP {{}}), 'incomplete': e IS NOT NULL}}) AS VARCHAR) AS json
FROM u LEFT JOIN w ON w.doc_id = u.doc_id LEFT JOIN f ON f.doc_id = u.doc_id LEFT JOIN e ON e.doc_id = u.doc_id""",
    "report_text": f"""WITH {_REPORTS},
v AS (SELECT doc_id, vector, string_agg('  ' || severity || coalesce(', page ' || page, '') || ': ' || props || chr(10) || '    read: ' || event_id, chr(10) ORDER BY coalesce(page, 0), event_id) AS b, max(rank) AS rank FROM e0 WHERE vector <> 'error' GROUP BY doc_id, vector),
b AS (SELECT doc_id, string_agg(chr(10) || vector || chr(10) || b, '' ORDER BY rank DESC, vector) AS b FROM v GROUP BY doc_id),
k AS (SELECT doc_id, 'Found: ' || array_to_string(list(n || ' ' || severity ORDER BY rank DESC), ', ') || '.' AS s FROM (SELECT doc_id, severity, rank, count(*) AS n FROM e0 WHERE vector <> 'error' GROUP BY ALL) GROUP BY doc_id),
e AS (SELECT doc_id, string_agg(chr(10) || 'event ' || event_id || chr(10) || '  failed: ' || props, '' ORDER BY 'event ' || event_id) AS e FROM e0 WHERE vector = 'error' GROUP BY doc_id)
SELECT u.doc_id, CASE WHEN worst IS NOT NULL THEN upper(worst) WHEN e IS NOT NULL THEN 'PARTIAL' ELSE 'CLEAN' END || '  ' || path || chr(10) || coalesce(s, 'Nothing recoverable was found.') || coalesce(b, '') || coalesce(e, '') AS text
FROM u LEFT JOIN w ON w.doc_id = u.doc_id LEFT JOIN b ON b.doc_id = u.doc_id LEFT JOIN k ON k.doc_id = u.doc_id LEFT JOIN e ON e.doc_id = u.doc_id""",
    "findings_covered_text": f"""WITH {_GLYPHS},
h AS (SELECT c.doc_id, c.page, c.cover_id, kind = 'rect' AND c.brightness <= 0.35::DOUBLE AS dark, kind, c.x0, c.y0, c.w, count(*) AS n, string_agg(ch, '' ORDER BY g.y0 DESC, g.x0, glyph_id) AS text FROM g JOIN c ON g.doc_id = c.doc_id AND g.page = c.page
  WHERE greatest(0::DOUBLE, least(g.x0 + 6, c.x0 + c.w) - greatest(g.x0, c.x0)) * greatest(0::DOUBLE, least(g.y0 + 12, c.y0 + 12) - greatest(g.y0, c.y0)) / 72::DOUBLE >= 0.30::DOUBLE GROUP BY ALL)
""" + _row("covered_text", "CASE WHEN dark THEN 'critical' ELSE 'high' END", "n || ' characters lie under a ' || CASE WHEN dark THEN 'dark rectangle' WHEN kind = 'rect' THEN 'rectangle' ELSE 'image' END || ' and can be copied out.'", "page", f"trim(text, {_TRIM})", "Delete the text below the cover, then export a new file.", "cover_id", "h", ("x0", "y0", "x0 + w", "y0 + 12")),
    "findings_revision_history": f"""WITH {_REVISIONS},
b AS (SELECT doc_id, max(n_revisions) AS n_revisions, count(*) AS n_earlier, count(*) FILTER (WHERE trim(coalesce(text, ''), {_TRIM}) = '') AS n_blank FROM r WHERE rev_index < last_index AND rev_index <= 64 GROUP BY doc_id)
""" + " UNION ALL ".join((
        _row("revision_history", "'critical'", "'Revision ' || rev_index || ' of ' || n_revisions || ' holds ' || n_tokens || ' tokens that the last one lost.'", "NULL", "evidence", "Save the document as a new file without its history.", "rev_index", "(SELECT f.*, n_revisions FROM f JOIN b USING (doc_id))"),
        _row("revision_history", "'high'", "'Earlier revisions exist whose text can''t be verified.'", "NULL", "n_blank || ' earlier revision(s) present but not parseable'", "Save the document as a new file without its history.", "1000", "b WHERE n_blank > 0"),
        _row("revision_history", "'low'", "'The file keeps earlier revisions; their text is all still shown.'", "NULL", "n_earlier || ' incremental update(s) detected'", "Save the document as a new file without its history.", "1001", "b WHERE n_blank = 0 AND doc_id NOT IN (SELECT doc_id FROM f)"),
    )),
}
ORACLE_SQL |= {
    "report_files": f"SELECT stamp, json FROM ({ORACLE_SQL['report_rollup']}) a JOIN ({ORACLE_SQL['report_json']}) b ON a.doc_id = b.doc_id",
    "findings_hidden_text": f"""WITH RECURSIVE {_OPS}, h AS ({ORACLE_SQL["hidden_geometry"]}) """ + " UNION ALL ".join((
        _row("hidden_text", "'critical'", "n_shows || ' pieces of text are drawn in an invisible mode.'", "1", f"nullif(left(trim(evidence, {_TRIM}), 400), '')", "Remove text drawn in render mode 3 or 7.", "0", "ops"),
        _row("hidden_text", "'critical'", "'Characters that nobody sees: ' || concat_ws('; ', CASE WHEN n_white > 0 THEN n_white || ' in white' END, CASE WHEN n_tiny > 0 THEN n_tiny || ' too small to see' END, CASE WHEN n_offpage > 0 THEN n_offpage || ' outside the page' END) || '.'", "page", "evidence", "Remove the hidden text from the content.", "1", "h"),
    )),
    "findings_embedded_files": f"WITH a AS ({ORACLE_SQL['attachment_dedupe']}) " + _row("embedded_files", "'high'", "'The document carries the file ' || name || '.'", "NULL", "name || ' ' || CASE WHEN size >= 0 THEN '(' || size || ' bytes)' ELSE '(unknown size)' END", "Detach files that the reader shouldn't get.", "row_number() OVER (PARTITION BY doc_id ORDER BY name)", "a"),
    "findings_metadata": f"""WITH {_INFO}, n AS (SELECT info.*, k.ord FROM info JOIN (VALUES ('/Title', 0), ('/Lang', 1), ('/Producer', 2), ('/Trapped', 3)) k(key, ord) USING (key)), x1 AS ({ORACLE_SQL["metadata_xmp_antijoin"]}),
x2 AS (SELECT x1.*, k.ord FROM x1 JOIN (VALUES ('title', 0), ('creator', 1), ('CreatorTool', 2), ('rights', 4), ('subject', 5)) k(name, ord) USING (name)), packets AS (SELECT page_id AS doc_id, CASE WHEN page_id % 2 = 0 THEN ' of ' || strlen(html) || ' bytes' ELSE '' END AS size FROM pages WHERE page_id % 3 = 0) """ + " UNION ALL ".join((
        _row("metadata", "severity", "'Document information, ' || CASE WHEN severity = 'medium' THEN 'identity or custom' ELSE 'software' END || ': ' || key", "NULL", "key || ' = ' || left(value, 200)", "Clear document properties before publishing.", "ord", "n"),
        _row("metadata", "severity", "'XMP field ' || name", "NULL", "'xmp:' || name || ' = ' || value", "Clear document properties before publishing.", "ord + 100000", "x2"),
        _row("metadata", "'info'", "'An XMP packet is present.'", "NULL", "'XMP packet' || size", "Clear document properties before publishing.", "10000000", "packets"),
        _row("metadata", "'info'", "'The page has XMP of its own.'", "page", "'page-level XMP packet'", "Clear document properties before publishing.", "10000001", "(SELECT * FROM (SELECT doc_id, unnest(range(1, (length(text) + 3999) // 4000 + 1)) AS page FROM documents WHERE length(text) > 0) WHERE (doc_id + page) % 29 = 3)"),
    )),
    "findings_redact_annotations": f"WITH m AS ({ORACLE_SQL['redact_under_rect']}), n AS ({ORACLE_SQL['annotation_notes']}) " + " UNION ALL ".join((
        _row("redact_annotations", "'critical'", "'A redaction mark was placed but never applied.'", "page", "evidence", "Apply redactions, then save as a new file.", "0", "m"),
        _row("redact_annotations", "'info'", "'An annotation stores text.'", "page", "evidence", "Delete notes that the reader shouldn't get.", "0", "n"),
    )),
}
