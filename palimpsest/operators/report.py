"""Report algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import exprs as E

CLEAN, FOUND, INCOMPLETE = 0, 2, 3


def counts_by_severity(findings: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, severity, n) with all five severities, zero where none is."""
    one = findings.groupBy(*keys).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in E.SEVERITIES)) if keys else findings.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in E.SEVERITIES))
    return one.select(*keys, F.explode(F.array(*(F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in E.SEVERITIES))).alias("x")).select(*keys, "x.severity", "x.n")


def count_at_least(docs: DataFrame, findings: DataFrame, minimum: str = "info") -> DataFrame:
    """(doc_id, n) of every document, its findings of severity ``minimum`` or worse."""
    n = findings.groupBy("doc_id").agg(F.count_if(E.rank(F.col("severity")) >= E.SEVERITIES.index(minimum) + 1).alias("n"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def error_line(kind: Column, message: Column, most: int = 200) -> Column:
    """An error as one line: its kind and the beginning of what it says."""
    return F.concat_ws(": ", kind, F.substring(E.collapse(message), 1, most))


def ordered(findings: DataFrame) -> DataFrame:
    """Adds ``ordinal``, 1-based within the document, worst first."""
    w = Window.partitionBy("doc_id").orderBy(E.rank(F.col("severity")).desc(), "vector", F.coalesce("page", F.lit(0)), "detector_ord", "emit_ord", F.col("evidence").asc_nulls_first())
    return findings.withColumn("ordinal", F.row_number().over(w))


def gate(worst_rank: Column, n_errors: Column, fail_on: str = "high", fail_on_error: bool = True) -> Column:
    """K5: 2 if the worst finding reaches ``fail_on``, else 3 if a detector failed, else 0."""
    least = E.SEVERITIES.index(fail_on) + 1
    return F.when(F.coalesce(worst_rank, F.lit(0)) >= least, FOUND).when(F.lit(fail_on_error) & (n_errors > 0), INCOMPLETE).otherwise(CLEAN)


def stamp(worst_severity: Column, n_errors: Column) -> Column:
    return F.when(worst_severity.isNotNull(), F.upper(worst_severity)).when(n_errors > 0, "PARTIAL").otherwise("CLEAN")


def rollup(docs: DataFrame, findings: DataFrame, errors: DataFrame, fail_on: str = "high", fail_on_error: bool = True) -> DataFrame:
    """One report row for each document: doc_id, path, worst_severity, finding_count, findings (worst first), detector_errors, incomplete, clean, stamp, exit_code.

    A document whose scan failed is never clean: its error makes it incomplete. A detector has one
    error in a report; where a table has more, the greatest message stands for them.
    """
    shown = F.struct("vector", "severity", "description", "page", "bbox", "evidence", "recommendation")
    f = ordered(findings).groupBy("doc_id").agg(
        F.max(E.rank(F.col("severity"))).alias("worst_rank"), F.count("*").alias("finding_count"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", shown.alias("f")))), lambda x: x["f"]).alias("findings")
    )
    once = errors.groupBy("doc_id", F.coalesce("detector", F.lit("open")).alias("detector")).agg(F.max(F.coalesce("message", F.lit(""))).alias("message"))
    e = once.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("detector", "message")))).alias("detector_errors"))
    rows = docs.select("doc_id", "path").join(f, "doc_id", "left").join(e, "doc_id", "left")
    n_errors = F.when(F.col("detector_errors").isNull(), 0).otherwise(F.size("detector_errors"))
    worst_severity = E.label(F.col("worst_rank"))
    return rows.select(
        "doc_id", "path", worst_severity.alias("worst_severity"), F.coalesce("finding_count", F.lit(0)).cast("long").alias("finding_count"), F.coalesce("findings", F.array().cast(f.schema["findings"].dataType)).alias("findings"),
        F.coalesce("detector_errors", F.create_map().cast("map<string,string>")).alias("detector_errors"), (n_errors > 0).alias("incomplete"), (F.col("worst_rank").isNull() & (n_errors == 0)).alias("clean"),
        stamp(worst_severity, n_errors).alias("stamp"), gate(F.col("worst_rank"), n_errors, fail_on, fail_on_error).alias("exit_code"),
    )


def as_json(reports: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """K1, K3: (doc_id, json, and columns to keep)."""
    shown = F.struct("path", "worst_severity", "finding_count", "findings", "detector_errors", "incomplete")
    return reports.select("doc_id", F.to_json(shown, {"ignoreNullFields": "false"}).alias("json"), *keep)


#: Statuses of files that can't be scanned for a fault of their own, by how opening them ended, and of any other; what is said of these.
STATUSES = {"oversize": 413, "encrypted": 415, "corrupt": 422}
INTERNAL, UNSAID = 500, "internal server error"


def envelopes(docs: DataFrame, errors: DataFrame) -> DataFrame:
    """K7: (doc_id, status, json) of documents that could not be opened, as a caller is told; docs: doc_id, open_status.

    The message is the greatest of the errors of opening it. What isn't the file's own fault is not spelled out.
    """
    opening = errors.where(F.coalesce("detector", F.lit("open")) == "open").groupBy("doc_id").agg(F.max("message").alias("message"))
    rows = docs.where("open_status <> 'ok'").select("doc_id", "open_status").join(opening, "doc_id", "left")
    known = F.element_at(F.create_map(*(F.lit(x) for pair in STATUSES.items() for x in pair)), F.col("open_status"))
    said = F.when(known.isNull(), UNSAID).otherwise(F.coalesce("message", F.concat(F.lit("file is "), "open_status")))
    return rows.select("doc_id", F.coalesce(known, F.lit(INTERNAL)).alias("status"), F.to_json(F.struct(said.alias("error"))).alias("json"))


def snippet(evidence: Column, limit: int = 80) -> Column:
    """K4: one line of at most ``limit`` characters."""
    line = E.strip(F.replace(evidence, F.lit("\n"), F.lit(" ⏎ ")))
    cut = F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit - 1), F.lit("…"))).otherwise(line)
    return F.when(evidence.isNull() | (evidence == ""), "—").otherwise(cut)


#: ANSI codes of the severities, of bold and of the end of either; characters of evidence that a text report shows.
_COLORS = {"info": "\x1b[36m", "low": "\x1b[34m", "medium": "\x1b[33m", "high": "\x1b[31m", "critical": "\x1b[1;31m"}
_BOLD, _RESET = "\x1b[1m", "\x1b[0m"
SHOWN = 240


def as_text(reports: DataFrame, color: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """K2: (doc_id, text, and columns to keep), a report to read: stamp and path, counts by severity, then each detector with what it found, the worst first, and detectors that failed."""

    def painted(text: Column, code: Column) -> Column:
        return F.concat(code, text, F.lit(_RESET)) if color else text

    codes = F.create_map(*(F.lit(x) for pair in _COLORS.items() for x in pair))
    lines = lambda *parts: F.array_join(F.array_compact(F.array(*parts)), "\n")

    def number(severity: str) -> Column:
        n = F.size(F.filter("findings", lambda f: f["severity"] == severity))
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {severity}")))

    counts = F.array_join(F.array_compact(F.array(*map(number, reversed(E.SEVERITIES)))), ", ")
    summary = F.when(F.col("finding_count") == 0, F.lit("Nothing recoverable was found.")).otherwise(F.concat(F.lit("Found: "), counts, F.lit(".")))

    def one(f: Column) -> Column:
        page = F.when(F.coalesce(f["page"], F.lit(0)) != 0, F.concat(F.lit(", page "), f["page"].cast("string"))).otherwise("")
        seen = F.replace(F.coalesce(f["evidence"], F.lit("")), F.lit("\n"), F.lit(" "))
        seen = F.when(F.length(seen) > SHOWN, F.concat(F.substring(seen, 1, SHOWN), F.lit(" ..."))).otherwise(seen)
        head = F.concat(F.lit("  "), painted(f["severity"], codes[f["severity"]]), page, F.lit(": "), f["description"])
        return lines(head, F.when(seen != "", F.concat(F.lit("    read: "), painted(seen, F.lit(_BOLD)))), F.when(F.coalesce(f["recommendation"], F.lit("")) != "", F.concat(F.lit("    do: "), f["recommendation"])))

    by_detector = F.transform(F.array_distinct(F.transform("findings", lambda f: f["vector"])), lambda v: F.concat(v, F.lit("\n"), F.array_join(F.transform(F.filter("findings", lambda f: f["vector"] == v), one), "\n")))
    failed = F.transform(F.map_entries("detector_errors"), lambda e: F.concat(e["key"], F.lit("\n  failed: "), e["value"]))
    head = F.concat(painted(F.col("stamp"), F.coalesce(codes[F.col("worst_severity")], F.lit(_BOLD))), F.lit("  "), F.col("path"))
    return reports.select("doc_id", F.array_join(F.concat(F.array(lines(head, summary)), by_detector, failed), "\n").alias("text"), *keep)


def written_reports(reports: DataFrame, to: str, text: bool = False, color: bool = False) -> dict[str, int]:
    """K1, K2, K5: write reports, a line of JSON or a text for each document, as files below ``to``/reports, by stamp, and their counts to ``to``/manifest.

    One job: the counts (documents, findings, and documents by exit code) are observed while the reports are written, and nothing else comes to the driver.
    """
    seen = Observation("reports")
    codes = (F.count_if(F.col("exit_code") == c).alias(f"exit_{c}") for c in (CLEAN, FOUND, INCOMPLETE))
    rows = reports.observe(seen, F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("finding_count"), F.lit(0)).alias("findings"), *codes)
    shown = as_text(rows, color, ("stamp",)) if text else as_json(rows, ("stamp",))
    shown.drop("doc_id").write.partitionBy("stamp").text(f"{to}/reports")
    counts = {k: int(v) for k, v in seen.get.items()}
    reports.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts)).coalesce(1).write.json(f"{to}/manifest")
    return counts


def exit_code(counts: dict[str, int]) -> int:
    return FOUND if counts[f"exit_{FOUND}"] else INCOMPLETE if counts[f"exit_{INCOMPLETE}"] else CLEAN
