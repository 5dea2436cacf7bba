"""Words of texts that come as Arrow arrays: each distinct one is encoded once, by runs, whatever marks follow it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import tokens

TEXTS = ["skipped, as a slice begins later: été", "The hello, HELLO. hello!! (hello) Été, été; naïve　x", None, "", " \n", "hello <|endoftext|> Hello", "don't 3.14 a@b.example ---", "\xc9 é İ ΣΣ q\x00r \x1cs", "last... été"]


@pytest.fixture
def own():
    return tokens.Encoder(tokens.public_vocabulary("word_bpe_49k.json"), spaced=False)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("first", [0, 1, 5])
def test_slices_encode_like_whole_texts(own, kind, first, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 40)
    want = [x.ids for x in own.tokenizer.encode_batch([t or "" for t in TEXTS[first:]], add_special_tokens=False)]
    for many in (len(TEXTS), 2):
        got = [x for at in range(first, len(TEXTS), many) for x in own(pa.array(TEXTS, kind).slice(at, many))]
        assert [np.frombuffer(x, own.dtype).tolist() for x in got] == want
    assert own(pa.array([], kind)) == own([]) == []


def test_distinct_words_are_encoded_once(own, monkeypatch):
    seen = []
    monkeypatch.setattr(own, "_runs", lambda words, runs=own._runs: runs(seen.extend(words) or words))
    text = "Zorble, zorble. ZORBLE!! zorble quux? quux; garçon, Garçon."
    for _ in range(2):
        (ids,) = own(pa.array([text]))
        assert np.frombuffer(ids, own.dtype).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(seen) == ["garçon", "quux", "zorble"]  # a capital beyond A-Z is lowered by the library


def test_models_without_ends_of_words_go_word_for_word(own, monkeypatch):
    monkeypatch.setattr(tokens, "RUN", 3)
    words = ["the", "été", "zorble", "x", "naïveté", "语", "hello"]
    want = [own._pack(own.tokenizer.encode(w, add_special_tokens=False).ids) for w in words]
    assert list(own._runs(words)) == want and list(own._runs([])) == []
    own.last[:] = False
    assert list(own._runs(words)) == want
