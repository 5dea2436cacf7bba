"""Source divergence audit (operator 11): how far the word frequencies of the sources of a language lie apart.

Every source of a language gives each kept term a smoothed frequency p, also the terms it
doesn't hold, so a distance of two sources sums over the whole vocabulary. It is worked out over
supports alone, by inclusion and exclusion: a term that a source lacks has one constant
frequency p0, so

    sum |p - q|  =  sum over the first's terms of |p - q0|  +  sum over the second's of |p0 - q|
                    + (V - size of the first - size of the second) * |p0 - q0|
                    + sum over the terms of both of |p - q| - |p - q0| - |p0 - q| + |p0 - q0|

The first two sums are priced by a source's histogram of counts, since p depends on the count
alone; the third is a constant; only the last one needs the sources' postings to meet, term by term. Nothing is ever
as large as vocabulary x sources.

Tasks count terms in a table of bounded size before anything is shuffled, so a source with a third of all rows sends one
row for each term and task. What meets in one key is at most a row for each source.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

#: Documents of a language that must hold a term; added to every count; frequencies are parts of so many; ranks of terms.
LEAST_DOCS, SMOOTH, PARTS, TOP = 30, 5, 1_000_000_000, 50
#: Terms counted in a task before they are sent on.
HELD = 400_000
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_COUNTED = "lang string, source string, term string, n long, docs long"


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of letters of ASCII and characters beyond it, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")))


def counted(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a source, and documents that hold it. Every row is a document."""

    def sent(groups: dict) -> pa.RecordBatch:
        sizes = [len(n) for n, _ in groups.values()]
        names = [pa.array([k[i] for k in groups], pa.string()).take(pa.array([j for j, s in enumerate(sizes) for _ in range(s)], pa.int64())) for i in (0, 1)]
        found = pa.array([t for n, _ in groups.values() for t in n], pa.binary()).cast(pa.string())
        numbers = [pa.array([x for n, d in groups.values() for x in side(n, d)], pa.int64()) for side in (lambda n, d: n.values(), lambda n, d: map(d.__getitem__, n))]
        return pa.RecordBatch.from_arrays([*names, found, *numbers], names=["lang", "source", "term", "n", "docs"])

    def of(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        have = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                own = terms(text)
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                have -= len(n)
                n.update(own)
                docs.update(set(own))
                have += len(n)
                if have > held:
                    yield sent(groups)
                    groups, have = {}, 0
        if have:
            yield sent(groups)

    rows = _named(docs).mapInArrow(of, _COUNTED)
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(n: Column | str, total: Column | str, size: Column | str) -> Column:
    """1 + floor(PARTS * (n + SMOOTH) / (total + SMOOTH * size)), exact for any counts."""
    n, total, size = (F.expr(x) if isinstance(x, str) else x for x in (n, total, size))
    part = F.call_function("div", (n + SMOOTH).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)"), (total + size * SMOOTH).cast("decimal(20,0)"))
    return part + 1


class Audit:
    """Frequencies of the kept terms by source and by language. docs: lang, source, text, each ''where it is null; others are ignored.

    Every row is a document, repeated ones too. Without a kept term a language has V = 0, and its sources are at distance 0.
    An empty table gives no rows.
    """

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS):
        small_batches(docs.sparkSession)
        counts = written(counted(docs), "terms")
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
        #: (lang, term, n_lang): occurrences of each kept term in the language.
        self.kept = written(kept, "kept")
        postings = written(counts.select("lang", "source", "term", "n").join(self.kept, ["lang", "term"]), "postings")
        langs = self.kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
        sizes = postings.groupBy("lang", "source").agg(F.count("*").alias("held"), F.sum("n").alias("total"))
        groups = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("held", "total", "v", "total_lang")))
        #: (lang, source, held, total, v, total_lang, p0) of every source that occurs, with or without terms; p0 is null where V is 0.
        self.groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, _p(F.lit(0).cast("long"), "total", "v"))), "groups")
        own = self.groups.select("lang", "source", "total", "v", "total_lang", "p0")
        #: (lang, source, term, n, p, q, p0): a source's kept terms with their frequency there and in the language.
        self.postings = postings.join(own, ["lang", "source"]).select("lang", "source", "term", "n", _p("n", "total", "v").alias("p"), _p("n_lang", "total_lang", "v").alias("q"), "p0")

    def telling(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): the terms that a source holds more often than its language, first those by most."""
        more = self.postings.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        return _ranked(more).where(F.col("rank") <= top)

    def distances(self) -> DataFrame:
        """(lang, source, item, value, rank): every other source of the language with the sum of differences over all kept terms."""
        two = self.groups.alias("a").join(self.groups.alias("b"), F.col("a.lang") == F.col("b.lang"))  # one row for each row of the result
        side = lambda x: [F.col(f"{x}.{c}").alias(f"{x}_{c}") for c in ("source", "held", "total", "v", "p0")]
        pairs = two.where("a.source <> b.source").select(F.col("a.lang").alias("lang"), *side("a"), *side("b"))
        # one-sided: what each count of a source costs against another's constant
        counts = self.postings.groupBy("lang", "source", "n", "p").agg(F.count("*").alias("k"))
        other = self.groups.where("v > 0").select("lang", F.col("source").alias("b_source"), F.col("p0").alias("b_p0"))
        priced = counts.withColumnRenamed("source", "a_source").join(other, "lang").where("a_source <> b_source")
        priced = priced.groupBy("lang", "a_source", "b_source").agg(F.sum(F.col("k") * F.abs(F.col("p") - F.col("b_p0"))).alias("one"))
        # both: what the one-sided sums and the constant have wrong where the postings of two sources meet
        left = self.postings.select("lang", "term", F.col("source").alias("a_source"), F.col("p").alias("a_p"), F.col("p0").alias("a_p0"))
        right = self.postings.select("lang", "term", F.col("source").alias("b_source"), F.col("p").alias("b_p"), F.col("p0").alias("b_p0"))
        met = left.join(right, ["lang", "term"]).where("a_source < b_source")
        amount = F.expr("abs(a_p - b_p) - abs(a_p - b_p0) - abs(a_p0 - b_p) + abs(a_p0 - b_p0)")
        mend = written(met.groupBy("lang", "a_source", "b_source").agg(F.count("*").alias("shared"), F.sum(amount).alias("mend")), "overlaps")
        swapped = mend.select("lang", F.col("b_source").alias("a_source"), F.col("a_source").alias("b_source"), "shared", "mend")
        priced = written(priced, "priced")
        back = priced.select("lang", F.col("b_source").alias("a_source"), F.col("a_source").alias("b_source"), F.col("one").alias("two"))
        keys = ["lang", "a_source", "b_source"]
        rows = pairs.join(priced, keys, "left").join(back, keys, "left").join(mend.union(swapped), keys, "left")
        neither = F.expr("coalesce((a_v - a_held - b_held) * abs(a_p0 - b_p0), 0)")
        value = F.coalesce("one", F.lit(0)) + F.coalesce("two", F.lit(0)) + F.coalesce("mend", F.lit(0)) + neither
        return _ranked(rows.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), value.cast("long").alias("value")))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(order))


def query(docs: DataFrame) -> DataFrame:
    audit = Audit(docs)
    parts = {"pair": audit.distances(), "term": audit.telling()}
    return parts["pair"].withColumn("part", F.lit("pair")).unionByName(parts["term"].withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


#: The same rows by every term in every source.
ORACLE = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), k AS (
  SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30
), g AS (
  SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), n AS (
  SELECT t.lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL
), f AS (
  SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c, k.c AS cl FROM g JOIN k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), p AS (
  SELECT lang, source, term, c, 1 + CAST((1000000000::HUGEINT * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w) AS BIGINT) AS p, 1 + CAST((1000000000::HUGEINT * (cl + 5)) // (sum(cl) OVER w + 5 * count(*) OVER w) AS BIGINT) AS q
  FROM f WINDOW w AS (PARTITION BY lang, source)
), x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(d.v, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT s.lang, s.source, z.source AS item, sum(abs(s.p - z.p)) AS v FROM p s JOIN p z ON s.lang = z.lang AND s.term = z.term GROUP BY ALL) d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x) WHERE part = 'pair' OR rank <= 50
"""
