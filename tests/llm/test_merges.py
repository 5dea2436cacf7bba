"""Ids of operator 6 against the library, and the lattice against the merges of whole texts."""

from __future__ import annotations

import duckdb
import numpy as np
import sentencepiece
from cases import ROWS
from test_operators import SF

from palimpsest.llm import streaming_viterbi, tokens

PATH = tokens.public_vocabulary("piece_bpe_32k.model")


def test_ids_are_those_of_the_library():
    own, library = streaming_viterbi.codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = np.random.default_rng(3)
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()] + [t for _, t, *_ in ROWS if t and "▁" not in t]
    texts += ["ab" * 3000, "x" * 5000, "  two  spaces   and more ", "".join(rng.choice(list("abcdeéß語 "), 2000)), "\U0001d400\U0001f600 é\n\tz"]
    for text, ids in zip(texts, own.encode_all(texts)):
        assert ids.tolist() == library.encode(text)
        assert own.decode(ids.tolist()) == text


def test_random_strings():
    """Strings over few characters have the most ways to be parted; those over many meet characters outside the vocabulary."""
    own, library = streaming_viterbi.codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list(chars), n)) for chars in ("ab", "est r", "ing t", "012 ", "éèe𝔘 ", "th e\n", "=-  ", "aeiou") for n in rng.integers(1, 200, 250)]
    for text, ids in zip(texts, own.encode_all(texts)):
        assert ids.tolist() == library.encode(text)


def test_stream_does_not_need_segments():
    """The window alone, over a text with no boundary that no piece spans, gives what the merges give for the whole."""
    own = streaming_viterbi.codec(PATH)
    rng = np.random.default_rng(5)
    for chars in ("abcdefgh", "est", "-=", "xy語"):
        symbols = "".join(rng.choice(list(chars), 3000))
        want = [i for x in own.merged(symbols) for i in ([own.score[x][1]] if x in own.score else [own.bytes[b] for b in x.encode()])]
        assert list(own.stream(symbols)) == want


def test_memory_turns_over(monkeypatch):
    monkeypatch.setattr(streaming_viterbi, "MEMORY", 50)
    monkeypatch.setattr(streaming_viterbi, "BLOCK", 500)
    texts = [None, ""] + [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' LIMIT 30").fetchall()]
    own, other = streaming_viterbi.Merges(PATH), streaming_viterbi.codec(PATH)
    assert [x.tolist() for x in own.encode_all(texts)] == [other.encode(x).tolist() for x in texts]


def test_pieces_beside_each_other():
    """By the histories of both pieces against the merges of their joined text."""
    own = streaming_viterbi.codec(PATH)
    rng = np.random.default_rng(6)
    pieces = list(own.score)
    short = [x for x in pieces if len(x) < 4]
    for first, second in [*rng.choice(pieces, (15_000, 2)), *rng.choice(short, (15_000, 2))]:
        assert own.beside(first, second) == (own.merged(first + second) == [first, second]), (first, second)
