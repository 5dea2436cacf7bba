"""Language identification by segmentation-marginalised unigrams (operator 4).

For each language, pieces of a fixed public vocabulary get probabilities by expectation
maximisation, over all segmentations of the words of a bounded sample of labelled documents.
A text's likelihood is the product over its words of the sum over all their segmentations,
which the forward algorithm gives; nothing depends on one best segmentation.

The model has (pieces x languages) numbers, whatever the corpus. Words are scored once and
remembered, in a bounded memory; documents are scored where they lie, without an exchange.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches
from .lattice import Pieces, padded, sentencepiece_vocabulary
from .tokens import public_vocabulary

SPACE = "▁"
#: Most documents of each language that are learned from: those with the lowest hash of their id. Of each its first stretches so many: words, and what longer ones are cut into every LONG characters.
SAMPLE, WORDS = 400, 5_000
#: Most languages: the model has a column for each.
LANGUAGES = 256
#: Words of more characters are summed one by one along a ring of columns, shorter ones many at once. Both give the same.
LONG = 48
ROUNDS = 4
#: Added to every piece's expected count; probability of a character that is no piece.
PRIOR, STRANGE = 0.05, 1e-7
#: Words remembered by a worker, some 250 bytes each.
MEMORY = 200_000
#: Words are looked up for so many characters of text at once, and new ones scored in arrays of so many numbers.
BLOCK, CELLS = 1_500_000, 2_000_000


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces([x for x in sentencepiece_vocabulary(path)[0] if x == x.lower()])


def words(text: str) -> list[str]:
    """Lower-case words with the mark of their beginning."""
    return [SPACE + w for w in text.lower().split()]


def _arcs(pieces: Pieces, codes: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """By start: (end, rows, pieces); a character that is no piece is piece number len(pieces)."""
    out: list[list] = [[] for _ in range(codes.shape[1])]
    single = np.zeros(codes.shape, bool)
    for start, n, rows, found in pieces.find(codes):
        out[start].append((start + n, rows, found))
        if n == 1:
            single[rows, start] = True
    for start in range(codes.shape[1]):
        rows = np.flatnonzero(~single[:, start] & (codes[:, start] != 0))
        if len(rows):
            out[start].append((start + 1, rows, np.full(len(rows), len(pieces.pieces))))
    return out


def _by_length(strings: list[str], columns: int = 1):
    """Blocks of strings of nearly one length: of so many characters that their sums, for each of the columns, stay small."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    order = np.argsort(sizes, kind="stable")
    sizes, at = sizes[order], 0
    while at < len(order):
        end = min(at + max(1, CELLS // (columns * (int(sizes[at]) + 3))), int(np.searchsorted(sizes, max(4, sizes[at] + 2), "right")))
        yield order[at:end], [strings[k] for k in order[at:end].tolist()]
        at = end


def long_likelihood(pieces: Pieces, table: np.ndarray, text: str, block: int = 50_000) -> np.ndarray:
    """As :func:`likelihoods`, of one string of any length: of the forward sums only those are held that a piece can still reach, scaled at every step."""
    ring, log = np.zeros((pieces.longest + 1, table.shape[1])), np.zeros(table.shape[1])
    ring[0] = 1.0
    for at in range(0, len(text), block):
        count = min(block, len(text) - at)
        codes = padded([text[at : at + count + pieces.longest]])[0]
        which = np.full((count, pieces.longest), -1)
        which[:, 0] = len(pieces.pieces)
        for n, starts, found in pieces.all_of(codes, count):
            which[starts, n - 1] = found
        for row in which:
            ends = np.flatnonzero(row >= 0)
            ring[ends + 1] += ring[0] * table[row[ends]]
            ring[:-1], ring[-1] = ring[1:], 0.0
            log += np.log(ring[0])
            ring /= ring[0]
    return log


def likelihoods(pieces: Pieces, table: np.ndarray, strings: list[str]) -> np.ndarray:
    """Log of the sum over all segmentations, of each string in each language; table: (pieces + 1) x languages."""
    out = np.zeros((len(strings), table.shape[1]))
    for k, x in enumerate(strings):
        if len(x) > LONG:
            out[k] = long_likelihood(pieces, table, x)
    short = [k for k, x in enumerate(strings) if len(x) <= LONG]
    for places, own in _by_length([strings[k] for k in short], table.shape[1]):
        places = np.array(short)[places]
        codes = padded(own)
        width = codes.shape[1]
        alpha = np.zeros((width + 1, len(own), table.shape[1]))
        alpha[0] = 1.0
        for start, arcs in enumerate(_arcs(pieces, codes)):
            for end, rows, found in arcs:
                alpha[end, rows] += alpha[start, rows] * table[found]
        out[places] = np.log(np.maximum(alpha[(codes != 0).sum(1), np.arange(len(own))], 1e-300))
    return out


def learn(pieces: Pieces, counts: dict[str, int]) -> np.ndarray:
    """Piece probabilities of one language from its word counts, by expectation maximisation over all segmentations."""
    p = np.full(len(pieces.pieces) + 1, 1.0 / len(pieces.pieces))
    p[-1] = STRANGE
    strings = list(counts)
    blocks = []
    for places, own in _by_length(strings):
        codes = padded(own)
        blocks.append((_arcs(pieces, codes), (codes != 0).sum(1), np.array([counts[x] for x in own], float)))
    for _ in range(ROUNDS):
        expected = np.full(len(p), PRIOR)
        for arcs, length, n in blocks:
            width, rows_n = len(arcs), len(n)
            alpha, beta = np.zeros((width + 1, rows_n)), np.zeros((width + 1, rows_n))
            alpha[0], beta[length, np.arange(rows_n)] = 1.0, 1.0
            for start in range(width):
                for end, rows, found in arcs[start]:
                    alpha[end, rows] += alpha[start, rows] * p[found]
            for start in reversed(range(width)):
                for end, rows, found in arcs[start]:
                    beta[start, rows] += beta[end, rows] * p[found]
            weight = n / np.maximum(beta[0], 1e-300)
            for start in range(width):
                for end, rows, found in arcs[start]:
                    expected += np.bincount(found, alpha[start, rows] * p[found] * beta[end, rows] * weight[rows], len(p))
        p = expected / expected[:-1].sum()
        p[-1] = STRANGE
    return p


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text) of at most ``sample`` documents of each language that are not held out.

    Languages are counted first, so that each task sends on only what can be among the lowest hashes; about
    twice the sample of a language then meets to be ranked, whatever the input.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND pmod(crc32(CAST(doc_id AS string)), 5) <> 0").withColumn("h", F.xxhash64("doc_id"))
    sizes = rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    low, span = -(2**63), 2**64
    most = [(r.lang, min(2**63 - 1, low + span * 2 * sample // r["count"])) for r in sizes]
    cut = docs.sparkSession.createDataFrame(most, "lang string, most long")
    few = rows.join(F.broadcast(cut), "lang").where("h <= most")
    once = few.groupBy("lang", "h", "doc_id", F.xxhash64("text").alias("mark")).agg(F.first("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "mark")
    return once.withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample).select("lang", "text")


def stretches(text: str) -> Iterator[str]:
    """Words of a text; one of more than LONG characters, as languages without spaces have them, in parts, so that all of it is learned but for pieces that a cut parts."""
    return (w[at : at + LONG] for w in words(text) for at in range(0, len(w), LONG))


def train(docs: DataFrame, vocabulary: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their table, from a sample of the rows (doc_id, text, lang) that are not held out: at most sample x WORDS stretches of each language, which is learned in a task of its own. A language without a word isn't learned."""

    def counted(batches):
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                found = Counter(w for x in texts for w in islice(stretches(x), WORDS))
                if found:
                    yield pd.DataFrame({"lang": lang, "word": list(found), "n": list(found.values())})

    def fitted(own: pd.DataFrame) -> pd.DataFrame:
        counts = dict(sorted(zip(own["word"], own["n"].tolist())))
        return pd.DataFrame({"lang": [own["lang"].iloc[0]], "p": [learn(_pieces(vocabulary), counts).tobytes()]})

    counts = sampled(docs, sample).mapInPandas(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    learned = {r.lang: np.frombuffer(r.p) for r in counts.groupBy("lang").applyInPandas(fitted, "lang string, p binary").collect()}
    langs = sorted(learned)
    return langs, np.stack([learned[x] for x in langs], 1) if langs else np.zeros((len(_pieces(vocabulary).pieces) + 1, 0))


class _Scorer:
    def __init__(self, vocabulary: str, table: np.ndarray):
        self.pieces, self.table = _pieces(vocabulary), table
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, table.shape[1]))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Log likelihoods of texts, each in all languages."""
        parts = [words(x) for x in texts]
        needed = set().union(*parts)
        if len(self.known) + len(needed) > MEMORY and self.known:
            self.known, self.rows = {}, self.rows[:0]
        new = list(needed.difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.rows = np.concatenate([self.rows, likelihoods(self.pieces, self.table, new)])
        get = self.known.__getitem__
        return np.stack([self.rows[np.fromiter(map(get, p), np.int64, len(p))].sum(0) for p in parts]) if texts else self.rows[:0]


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, vocabulary: str) -> DataFrame:
    """docs: (doc_id, text); adds lang_pred and score, the share of the best language in the sum of the likelihoods of all. ``und`` and 0 for a null text or one without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))
    held: list[_Scorer] = []

    @F.pandas_udf("lang_pred string, score double")
    def best(texts: pd.Series) -> pd.DataFrame:
        langs, table = shared.value
        if not held:
            held.append(_Scorer(vocabulary, table))
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        real = [k for k, x in enumerate(texts) if langs and x and any(map(str.isalpha, x))]
        at = 0
        while at < len(real):
            size, end = 0, at
            while end < len(real) and (end == at or size < BLOCK):
                size += len(texts.iloc[real[end]])
                end += 1
            own, at = real[at:end], end
            found = held[0]([texts.iloc[k] for k in own])
            top = found.argmax(1)
            scores[own] = 1 / np.exp(np.maximum(found - found.max(1, keepdims=True), -700)).sum(1)
            for k, t in zip(own, top):
                names[k] = langs[t]
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn("x", best("text")).select(*docs.columns, "x.lang_pred", "x.score")


def identify(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang; others are ignored).

    Repeated rows and null ids are scored like any other; a null id counts as not held out
    and is not learned from. Without a labelled row everything is ``und``.
    """
    path = vocabulary or public_vocabulary("piece_bpe_32k.model")
    small_batches(docs.sparkSession)
    own = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    langs, table = train(own, path)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False)).alias("held_out")
    return predict(own.select("doc_id", "text"), langs, table, path).select("doc_id", held_out, "lang_pred", "score")


def query(docs: DataFrame) -> DataFrame:
    return identify(docs)
