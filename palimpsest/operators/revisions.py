"""What earlier revisions hold that the last one lost.

A document's row holds all its revisions, so their tokens are counted and compared there, as maps from token to count:
no token is shuffled. Documents whose revisions have more than ``ROW_BYTES`` of text leave the row: theirs are
exploded and joined by document and token. Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from .findings import finding

#: Earlier revisions examined, the oldest first; tokens shown of each.
REVISIONS, TOKENS = 64, 60
#: Bytes of text of all revisions of a document that are compared inside its row.
ROW_BYTES = 16 << 20
_FOUND = "array<struct<rev_index:int,n_tokens:bigint,evidence:string>>"


def examined(docs: DataFrame, cap: int | None = REVISIONS) -> DataFrame:
    """(doc_id, n_revisions, last_index, earlier, last, bytes): earlier revisions within the cap, if there is one, and the last one, of documents with more than one; docs: doc_id, revisions, in order."""
    rows = docs.where(F.size("revisions") > 1).select("doc_id", F.size("revisions").cast("long").alias("n_revisions"), F.element_at("revisions", -1).alias("last"), "revisions")
    earlier = F.filter("revisions", lambda r: (r["rev_index"] < F.col("last.rev_index")) & (F.lit(cap is None) | (r["rev_index"] <= F.lit(cap))))
    size = F.aggregate("revisions", F.lit(0).cast("long"), lambda a, r: a + F.coalesce(F.octet_length(r["text"]), F.lit(0)))
    return rows.select("doc_id", "n_revisions", F.col("last.rev_index").alias("last_index"), earlier.alias("earlier"), "last", size.alias("bytes"))


def _named(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token_counts(text: Column) -> Column:
    """Map from each token to how often it stands in the text and its first place."""
    ordered = F.array_sort(F.transform(E.tokens(F.coalesce(text, F.lit(""))), lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

    def counted(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["t"] != F.get(s, i - 1)["t"]), i)), lambda i: i.isNotNull())
        entry = lambda h, k, heads: F.struct(F.get(s, h)["t"].alias("key"), F.struct((F.coalesce(F.get(heads, k + 1), F.size(s)) - h).alias("n"), F.get(s, h)["i"].alias("i")).alias("value"))
        return _named(first, lambda heads: F.map_from_entries(F.transform(heads, lambda h, k: entry(h, k, heads))))

    return _named(ordered, counted)


def _lost(before: Column, now: Column) -> Column:
    """Of two maps of counts, the tokens that the first has more often: (first place, token, how many are lost), in order of place."""
    less = F.map_zip_with(before, now, lambda t, a, b: F.when(a["n"] > F.coalesce(b["n"], F.lit(0)), F.struct(a["i"].alias("i"), (a["n"] - F.coalesce(b["n"], F.lit(0))).alias("lost"))))
    return F.array_sort(F.transform(F.filter(F.map_entries(less), lambda e: e["value"].isNotNull()), lambda e: F.struct(e["value"]["i"].alias("i"), e["key"].alias("token"), e["value"]["lost"].alias("lost"))))


def _shown(lost: Column) -> Column:
    return F.array_join(F.slice(F.transform(lost, lambda x: x["token"]), 1, TOKENS), " ")


def _in_row(rows: DataFrame) -> DataFrame:
    """rows of :func:`examined` with ``found``."""
    own = rows.withColumn("now", token_counts(F.col("last.text")))
    one = lambda r: _named(_lost(token_counts(r["text"]), F.col("now")), lambda z: F.struct(r["rev_index"].alias("rev_index"), F.size(z).cast("long").alias("n_tokens"), _shown(z).alias("evidence")))
    found = F.filter(F.transform("earlier", one), lambda x: x["n_tokens"] > 0)
    return own.withColumn("found", found.cast(_FOUND))


def token_rows(revisions: DataFrame) -> DataFrame:
    """(doc_id, rev_index, pos, token) of revision rows (doc_id, rev_index, text)."""
    return revisions.select("doc_id", "rev_index", F.posexplode(E.tokens(F.col("text"))).alias("pos", "token"))


def _across(rows: DataFrame) -> DataFrame:
    """As :func:`_in_row`, for documents that are too large for it: counts combine before the exchange, and a document spreads over its tokens."""
    each = rows.select("doc_id", "last_index", F.explode(F.concat("earlier", F.array("last"))).alias("r")).select("doc_id", "last_index", F.col("r.rev_index").alias("rev_index"), F.posexplode(E.tokens(F.col("r.text"))).alias("i", "token"))
    counts = each.groupBy("doc_id", "rev_index", "last_index", "token").agg(F.count("*").alias("n"), F.min("i").alias("i"))
    now = counts.where("rev_index = last_index").select("doc_id", "token", F.col("n").alias("now"))
    gone = counts.where("rev_index < last_index").join(now, ["doc_id", "token"], "left").where("n > coalesce(now, 0)")
    z = F.array_sort(F.collect_list(F.struct("i", "token")))
    shown = gone.groupBy("doc_id", "rev_index").agg(F.count("*").alias("n_tokens"), z.alias("z")).select("doc_id", F.struct("rev_index", "n_tokens", _shown(F.col("z")).alias("evidence")).alias("f"))
    found = shown.groupBy("doc_id").agg(F.array_sort(F.collect_list("f")).cast(_FOUND).alias("found"))
    return rows.join(found, "doc_id", "left").withColumn("found", F.coalesce("found", F.array().cast(_FOUND)))


def compared(docs: DataFrame, row_bytes: int = ROW_BYTES, cap: int | None = REVISIONS) -> DataFrame:
    """(doc_id, n_revisions, n_earlier, n_blank, found) of documents with more than one revision; found: (rev_index, n_tokens, evidence) of earlier ones with tokens that the last one has less often."""
    rows = examined(docs, cap)
    keep = ("doc_id", "n_revisions", F.size("earlier").cast("long").alias("n_earlier"), F.size(F.filter("earlier", lambda r: E.blank(r["text"]))).cast("long").alias("n_blank"), "found")
    return _in_row(rows.where(F.col("bytes") <= row_bytes)).select(*keep).unionByName(_across(rows.where(F.col("bytes") > row_bytes)).select(*keep))


def recovered(docs: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(doc_id, rev_index, n_tokens, evidence) of earlier revisions with lost tokens."""
    return compared(docs, row_bytes).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def status(docs: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(doc_id, n_revisions, n_earlier, n_blank, any_recovered) of documents with more than one revision."""
    return compared(docs, row_bytes).select("doc_id", "n_revisions", "n_earlier", "n_blank", (F.size("found") > 0).alias("any_recovered"))


def revision_history(docs: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    fix = "Save the document as a new file without its history."
    critical = F.transform("found", lambda f: F.struct(
        F.lit("critical").alias("severity"), F.concat(F.lit("Revision "), f["rev_index"].cast("string"), F.lit(" of "), F.col("n_revisions").cast("string"), F.lit(" holds "), f["n_tokens"].cast("string"), F.lit(" tokens that the last one lost.")).alias("text"),
        f["evidence"].alias("evidence"), f["rev_index"].alias("emit"),
    ))

    def other(severity: str, text: str, evidence: Column, emit: int) -> Column:
        return F.array(F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("text"), evidence.alias("evidence"), F.lit(emit).alias("emit")))

    unread = other("high", "Earlier revisions exist whose text can't be verified.", F.concat(F.col("n_blank").cast("string"), F.lit(" earlier revision(s) present but not parseable")), 1000)
    kept = other("low", "The file keeps earlier revisions; their text is all still shown.", F.concat(F.col("n_earlier").cast("string"), F.lit(" incremental update(s) detected")), 1001)
    more = F.when(F.col("n_blank") > 0, unread).when(F.size("found") == 0, kept).otherwise(F.slice(kept, 1, 0))
    rows = compared(docs, row_bytes).select("doc_id", F.explode(F.concat(critical, more)).alias("x"))
    return finding(rows, "revision_history", F.col("x.severity"), F.col("x.text"), F.col("x.evidence"), fix, emit=F.col("x.emit"))
