"""Line dedup by range-partitioned hashes (operator 12), in DataFrame functions alone.

Every line that is long enough sends 128 bits of its key's hash with document and position. Hashes
are cut into ranges and sorted inside them by document, the largest first, and position, so the
occurrences of a key stream by one after another: the first is the one that stays, and those of other documents go if there
are enough documents. What comes back for a document is its keep bitmap as runs of lines that
stay; texts meet only these. No text is shuffled to be compared.

A key with over one part in ``common.HOT`` of all lines is hot: an aggregate of bounded size finds all of them, fewer than ``common.HOT``,
its documents are counted by combinable aggregates, and its lines are decided where they lie.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, NULL_ID, SPACES, doc_id, partitions, written

#: Code points that a key must have, and documents that must hold it.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Keys that the aggregate for hot ones tracks: it finds every key with over 3.5 parts in so many of all lines.
TRACKED = 16 * HOT
_RUNS = "array<struct<start:int,n:int>>"
#: Length of a run that goes on to the end of the text.
_REST = 1 << 30


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keyed(docs: DataFrame, *carry: str) -> DataFrame:
    """id, mark (tells rows that repeat an id apart), text and the columns to carry, as c0, c1, ..."""
    mark = F.hash(docs["text"]).alias("mark")
    return docs.select(F.coalesce(docs["doc_id"], F.lit(NULL_ID)).alias("id"), mark, docs["text"].alias("text"), *(docs[c].alias(f"c{i}") for i, c in enumerate(carry)))


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h, g, id, mark, pos) of every line whose key has ``least_chars`` code points or more; h and g are the key's hashes."""
    rows = _keyed(docs).select("id", "mark", F.posexplode(_split(F.col("text"))).alias("pos", "line"))
    rows = rows.where(F.length("line") >= least_chars)  # a key is no longer than its line
    rows = rows.withColumn("key", F.translate(F.trim("line", F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase))
    return rows.where(F.length("key") >= least_chars).select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), "id", "mark", "pos")


def _hot(lines: DataFrame) -> DataFrame:
    """(h) of every hash with more than one part in HOT of all lines; fewer than HOT rows."""
    found = lines.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h, {HOT}, {TRACKED})").alias("top"))
    return found.select("n", F.explode("top").alias("x")).where(F.col("x.count") * HOT > F.col("n")).select(F.col("x.item").alias("h"))


def dropped(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(id, mark, pos) of every line that goes: of a key in ``least_docs`` documents or more, all but those of the largest id."""
    lines = written(occurrences(docs, least_chars), "lines")
    hot = written(_hot(lines), "hot")
    cold = lines.join(F.broadcast(hot), "h", "left_anti")
    of_key = Window.partitionBy("h", "g")
    # ranges of h hold whole keys, so the windows need no other exchange
    ranged = cold.repartitionByRange(partitions(lines.sparkSession), "h").withColumn("nth", F.dense_rank().over(of_key.orderBy(F.desc("id"))))
    gone = ranged.withColumn("docs", F.max("nth").over(of_key)).where((F.col("nth") > 1) & (F.col("docs") >= least_docs))
    held = lines.join(F.broadcast(hot), "h", "left_semi")
    last = held.groupBy("h", "g", "id").agg(F.lit(1).alias("one")).groupBy("h", "g").agg(F.count("*").alias("docs"), F.max("id").alias("last")).where(F.col("docs") >= least_docs)
    return gone.select("id", "mark", "pos").union(held.join(F.broadcast(last), ["h", "g"]).where("id <> last").select("id", "mark", "pos"))


def _runs(z: str) -> Column:
    """Sorted positions of lines that go, to runs (start, n) of those that stay; the last one has no end of its own."""
    starts = f"filter({z}, (p, i) -> i = 0 OR {z}[i - 1] <> p - 1)"
    ends = f"filter({z}, (p, i) -> i = size({z}) - 1 OR {z}[i + 1] <> p + 1)"
    return F.expr(f"CAST(filter(zip_with(concat(array(-1), {ends}), concat({starts}, array({_REST})), (e, s) -> struct(e + 1 AS start, s - e - 1 AS n)), r -> r.n > 0) AS {_RUNS})")


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(id, mark, n_dropped, keep) of every document that loses a line; keep: its keep bitmap, compressed to runs (start, n) of lines that stay, the last one open.

    A line's key is the line without white space at its ends, A-Z in lower case. Rows that repeat a
    doc_id are one document, each with a bitmap of its own; a null id counts as the smallest. A null or empty text is one empty line, which
    is too short to go. An empty table gives none.
    """
    gone = dropped(docs, least_chars, least_docs).groupBy("id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("z"))  # no more than a document has lines
    return gone.select("id", "mark", F.size("z").cast("long").alias("n_dropped"), _runs("z").alias("keep"))


def _met(docs: DataFrame, carry: tuple[str, ...], **bounds: int) -> DataFrame:
    """(id, text, n_lines, n_dropped, kept, c0, c1, ...) of every row."""
    own = _keyed(docs, *carry).join(keep_bitmaps(docs, **bounds), ["id", "mark"], "left").withColumn("lines", _split(F.col("text")))
    kept = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice("lines", r["start"] + 1, r["n"]))), "\n")
    return own.select("id", "text", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept).alias("kept"), *(f"c{i}" for i in range(len(carry))))


def cut(docs: DataFrame, **bounds: int) -> DataFrame:
    """``docs`` without the lines that go (and their new length as n_chars, if there is such a column); a null text stays null, and rows and other columns stay as they are."""
    carry = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")} | {c: F.col(f"c{i}") for i, c in enumerate(carry)}
    return _met(docs, carry, **bounds).select(*(new[c].alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return _met(docs, ()).select(doc_id(), "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), e AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM t
), k AS (
  SELECT doc_id, line, pos, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e
), d AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, pos, line, last IS NOT NULL AND last <> k.doc_id AS gone FROM k LEFT JOIN d ON d.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
