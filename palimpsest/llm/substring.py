"""Substring dedup by relative Lempel-Ziv parsing (operator 1).

The reference is the corpus itself, cut into blocks by content: every window of ``WINDOW`` words
belongs to the smallest hash among its ``GRAM``-word grams, its anchor, and the consecutive
windows of one anchor make a block of about eight windows. The index holds each different
block at its first place in the corpus. A document is parsed from left to right into factors, runs
of its words that stand in the same order at one place of the reference: a factor
begins with a block that the index has at an earlier place, and goes on as long as the first place of the next
block is next to it there. Since a block has its first place alone, a factor isn't always the longest one that any place of the
corpus would give, and factors of different sources may overlap; the words under them are the same. Where documents part inside a block, at the ends of
factors, no block matches; there single windows are looked up, each among all others of the corpus, and
lengthen the factors word by word or begin factors of their own. A factor covers ``WINDOW`` words at least, and
words under a factor go.

Blocks depend on content alone, so nothing is missed: the words that go are those of looking up
every window, at the price of about one row for eight words.

No key is joined as it is where it is hot: of the keys that hold over one part in ``common.HOT`` of all rows there are
less than ``HOT``, and they are broadcast, while their rows go where they lie. First places are
combinable minima. So neither a passage in a third of all documents nor a large group of
copies meets in one task.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import NULL_ID, doc_id, meet, small_batches, words, written

WINDOW = 20
GRAM = 6
#: A place packs start << 24 | (windows - 1) << 20 | 20 bits of the text's hash, so that places sort by start.
_MARK, _COUNT = 20, 4
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, 4096) * 2
        _powers[base] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (base, pow(base, -1, 2**64)))
    return _powers[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Text:
    """Hashes of any run of a text's words, from prefix sums."""

    def __init__(self, w: list[bytes]):
        self.n = len(w)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, self.n)
        self.sums = [np.r_[np.uint64(0), np.cumsum(hashes * _power(b, self.n)[0][: self.n])] for b in _BASES]

    def runs(self, start: np.ndarray, end: np.ndarray, k: int = 0) -> np.ndarray:
        s = self.sums[k]
        return _mixed((s[end] - s[start]) * _power(_BASES[k], self.n)[1][start])


def _phrases(t: _Text, window: int) -> tuple[np.ndarray, ...]:
    """Of each block: anchor, hash of its words, first and last window."""
    starts = np.arange(t.n - GRAM + 1)
    grams = t.runs(starts, starts + GRAM)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | starts.astype(np.uint64)  # the leftmost of the smallest
    width, have = window - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    lo, hi = np.r_[0, cut], np.r_[cut - 1, len(at) - 1]
    shape = (at[lo] - lo).astype(np.uint64) * np.uint64(64) + (hi - lo).astype(np.uint64)
    full = _mixed(t.runs(lo, hi + window, 1) + shape)
    return grams[at[lo]].view(np.int64), full.view(np.int64), lo, hi


def _mark(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42) & ((1 << _MARK) - 1)


def phrases(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, phrase, id, place) of every block of every document; a null or short text has none."""

    def of(batches):
        for batch in batches:
            rows, have = [], 0
            for i, text in zip(batch["id"], batch["text"]):
                w = words(text)
                if len(w) < window:
                    continue
                anchor, phrase, lo, hi = _phrases(_Text(w), window)
                rows.append((anchor, phrase, np.full(len(lo), i), (lo << (_MARK + _COUNT)) | ((hi - lo) << _MARK) | _mark(text)))
                have += len(lo)
                if have > 200_000:
                    yield pd.DataFrame(dict(zip(("anchor", "phrase", "id", "place"), map(np.concatenate, zip(*rows)))))
                    rows, have = [], 0
            if rows:
                yield pd.DataFrame(dict(zip(("anchor", "phrase", "id", "place"), map(np.concatenate, zip(*rows)))))

    return _keyed(docs).mapInPandas(of, "anchor long, phrase long, id long, place long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"], F.lit(NULL_ID)).alias("id"), docs["text"].alias("text"))


def factors(start: np.ndarray, end: np.ndarray, source: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matched runs of words (start to end, found in document ``source`` from word ``offset`` on) to factors of the same form.

    From left to right a factor takes in every run that touches it and continues it in the same document of the reference.
    """
    order = np.lexsort((end, start))
    start, end, source, offset = (x[order] for x in (start, end, source, offset))
    # runs of one source and distance, each from left to right
    by = np.lexsort((start, offset - start, source))
    s, e, d, o = (x[by] for x in (start, end, source, offset))
    same = (d[1:] == d[:-1]) & ((o - s)[1:] == (o - s)[:-1]) & (s[1:] <= e[:-1])
    first = np.flatnonzero(np.r_[True, ~same])
    out = s[first], np.maximum.reduceat(e, first), d[first], o[first]
    order = np.argsort(out[0], kind="stable")
    return tuple(x[order] for x in out)


def _covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    step = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(step[:-1]) > 0


def _cut(text: str, gone: np.ndarray) -> str:
    """The text without the words that are gone; a kept word keeps the spaces before it."""
    raw, at, out, cut = text.encode("utf-8", "surrogatepass"), 0, [], False
    for m, x in zip(_WORD.finditer(raw), gone):
        if not x:
            out.append(raw[at : m.end()])
        at = m.end()
        cut |= bool(x)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass").strip() if cut else text


_FACTOR = "struct<start: long, n_words: long, source_id: long, source_start: long>"
_MATCHES = "array<struct<place: long, source: long, at: long>>"
_DONE = f"id long, mark int, n_words long, n_removed long, kept_sha256 string, kept string, factors array<{_FACTOR}>, text string, known {_MATCHES}, open array<long>"


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Of each row its list as a matrix, one row for each field of its structs; none for null."""
    flat = column.flatten()
    fields = [flat.field(k).to_numpy() for k in range(flat.type.num_fields)] if pa.types.is_struct(flat.type) else [flat.to_numpy()]
    ends = np.cumsum(np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64))
    values = np.stack([np.asarray(x, np.int64) for x in fields])
    return [values[:, a:b] for a, b in zip(np.r_[0, ends], ends)]


def _runs(matches: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    place, source, at = matches
    lo = place >> (_MARK + _COUNT)
    return lo, lo + ((place >> _MARK) & ((1 << _COUNT) - 1)) + window, source, at >> (_MARK + _COUNT)


def _finish(keep_text: bool, keep_factors: bool, window: int, fields: pa.Schema):
    """Rows (id, mark, text, known, open, found, carried columns) to ``fields``: as they will stay, or with text, known and open for the look at the ends of factors."""

    def row(text, known, found):
        w = words(text)
        parsed = factors(*(np.concatenate(x) for x in zip(_runs(known, window), _runs(found, window)))) if known.size or found.size else ()
        gone = _covered(len(w), *parsed[:2]) if parsed else np.zeros(len(w), bool)
        kept = b" ".join(x for x, g in zip(w, gone) if not g) if parsed else b" ".join(w)
        shown = [dict(zip(("start", "n_words", "source_id", "source_start"), x)) for x in zip(parsed[0].tolist(), (parsed[1] - parsed[0]).tolist(), parsed[2].tolist(), parsed[3].tolist())] if parsed and keep_factors else []
        return len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest(), _cut(text, gone) if keep_text and text is not None else None, shown

    def of(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                todo = pc.fill_null(pc.greater(pc.list_value_length(batch.column("open")), 0), False)
                wait = todo.to_pylist()
                texts = batch.column("text").to_pylist()
                made = [(None,) * 5 if later else row(*x) for later, *x in zip(wait, texts, *(_lists(batch.column(c)) for c in ("known", "found")))]
                held = [pc.if_else(todo, batch.column(c), pa.nulls(batch.num_rows, batch.column(c).type)) for c in ("text", "known", "open")]
                columns = [batch.column("id"), batch.column("mark"), *(pa.array(x, f.type) for x, f in zip(zip(*made), list(fields)[2:7])), *(x.cast(f.type) for x, f in zip(held, list(fields)[7:10]))]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(f.name).cast(f.type) for f in list(fields)[10:])], schema=fields)

    return of


def _windows(window: int):
    names = ("w", "x", "id", "place")

    def of(batches):
        for batch in batches:
            rows, have = [], 0
            for i, mark, text, todo in zip(*(batch[c] for c in ("id", "mark", "text", "open"))):
                places = np.asarray(todo, np.int64)
                lo, more = places >> (_MARK + _COUNT), (places >> _MARK) & ((1 << _COUNT) - 1)
                at = np.repeat(lo, more + 1) + np.arange((more + 1).sum()) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                t = _Text(words(text))
                first, second = (t.runs(at, at + window, k) for k in (0, 1))
                rows.append((first.view(np.int64), (second >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(len(at), i), (at << (_MARK + _COUNT)) | mark))
                have += len(at)
                if have > 200_000:
                    yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*rows)))))
                    rows, have = [], 0
            if rows:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*rows)))))

    return of


def _start(column: str):
    return F.shiftright(column, _MARK + _COUNT)


def _later(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows (by, id, place): the first of each key, with n; and the rows that start after it, as (id, place, source, at)."""
    first = written(rows.groupBy(*by).agg(F.min(F.struct("id", "place")).alias("f"), F.count("*").alias("n")), "first")
    again = meet(rows, first.where("n > 1"), by, "f", "id", "place")
    after = (F.col("id") > F.col("f.id")) | ((F.col("id") == F.col("f.id")) & (_start("place") > _start("f.place")))
    return first, again.where(after).select("id", "place", F.col("f.id").alias("source"), F.col("f.place").alias("at"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, keep_text: bool = True, carry: tuple[str, ...] = (), keep_factors: bool = False) -> DataFrame:
    """(id, mark, n_words, n_removed, kept_sha256, kept, factors, c0, c1, ...) of every row of ``docs`` (doc_id, text, and the columns to carry, as c0, c1, ...; others are ignored).

    A word goes if a window over it, of ``window`` consecutive words of one document, also
    starts earlier: in a smaller doc_id or at an earlier word of the same one (rows that
    repeat a doc_id are read as one document; a null doc_id is the smallest). ``kept`` is the
    text without those words, null for a null text; the digest is of the kept words, joined
    by one space. ``factors`` are the parse, if asked for. Windows are judged on the input. An empty table gives none.
    """
    if not GRAM <= window <= GRAM + 15:
        raise ValueError("window is 6 to 21 words")
    small_batches(docs.sparkSession)
    blocks = phrases(docs, window)
    twice = written(blocks.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors").withColumn("seen", F.lit(True))
    shared = written(meet(blocks, twice, ["anchor"], "seen", "id", "place").drop("seen"), "blocks")
    first, whole = _later(shared, ["anchor", "phrase"])
    # blocks that part: of one anchor, but not the same
    parted = first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").withColumn("seen", F.lit(True))
    ends = meet(first.select("anchor", "f.id", "f.place"), written(parted, "parted"), ["anchor"], "seen", "id", "place").select("id", "place", F.lit(None).cast("long").alias("source"), F.lit(None).cast("long").alias("at"))
    mark = F.col("place").bitwiseAND((1 << _MARK) - 1).cast("int").alias("mark")
    match = F.struct("place", "source", "at")
    marks = whole.union(ends).groupBy("id", mark).agg(F.collect_list(F.when(F.col("source").isNotNull(), match)).alias("known"), F.collect_list(F.when(F.col("source").isNull(), F.col("place"))).alias("open"))
    own = docs.select(F.coalesce(docs["doc_id"], F.lit(NULL_ID)).alias("id"), text_mark(docs["text"]).alias("mark"), docs["text"].alias("text"), *(docs[c].alias(f"c{i}") for i, c in enumerate(carry)))
    types = StructType([*_parse_datatype_string(_DONE).fields, *own.schema.fields[3:]])
    finish = _finish(keep_text, keep_factors, window, to_arrow_schema(types))
    step = written(own.join(marks, ["id", "mark"], "left").withColumn("found", F.lit(None).cast(_MATCHES)).mapInArrow(finish, types), "parsed")
    pending = step.where("open IS NOT NULL")
    singles = pending.select("id", "mark", "text", "open").mapInPandas(_windows(window), "w long, x int, id long, place long")
    _, later = _later(singles, ["w", "x"])
    found = later.groupBy("id", mark).agg(F.collect_list(match).alias("found"))
    rest = pending.withColumn("open", F.lit(None).cast("array<long>")).join(found, ["id", "mark"], "left").mapInArrow(finish, types)
    return step.where("open IS NULL").union(rest).drop("text", "known", "open")


def parse(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, n_words, source_id, source_start) of every factor of every document, words counted from 0: its n_words from ``start`` on stand in ``source_id`` from ``source_start`` on."""
    rows = substring_dedup(docs, window, False, (), True).select("id", F.explode("factors").alias("f"))
    return rows.select(doc_id(), "f.start", "f.n_words", F.nullif("f.source_id", F.lit(NULL_ID)).alias("source_id"), "f.source_start")


def text_mark(text):
    return F.coalesce(F.xxhash64(text).bitwiseAND((1 << _MARK) - 1).cast("int"), F.lit(0))


def cut(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``kept`` as text (and its length as n_chars, if there is such a column); a document of which nothing is kept goes."""
    carry = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    done = substring_dedup(docs, window, True, carry).where("n_removed = 0 OR kept <> ''")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")} | {c: F.col(f"c{i}") for i, c in enumerate(carry)}
    return done.select(*(new[c].alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs, keep_text=False).select(doc_id(), "n_words", "n_removed", "kept_sha256")


#: The same rows by looking up every window.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20
), k AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY list_slice(w, i, i + 19) ORDER BY doc_id, i) AS r FROM s
), gone AS (
  SELECT doc_id, count(*) AS n_removed, list(p) AS p FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM k WHERE r > 1) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(p, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
"""
