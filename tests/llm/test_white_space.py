"""Ids of chunks against those of whole texts, for white space of every kind in every place."""

from __future__ import annotations

import numpy as np
import pytest

from palimpsest.llm import tokens

#: What texts are drawn from, white space most of all.
GAPS = [" ", " ", " ", "\n", "\n", "\n\n", "  ", "\r\n", "\r", "\t", "\x0b", "\x0c", "\xa0", "\u3000", "\x85", "\u2028", "\x1c", "\0", "\u200b"]
WORDS = ["a", "The", "word", "x.", "it's", "don't", "12", "3.14", "(b)", ",", "--", "é", "e\u0301", "\u0301", "語", "İ", "<|endoftext|>", "<|", "#1", "'", "'s", "\U0001f600", "end.", "wow!!", "cost$$$", "q...\"", "été,", "über###", "x|>", "don't.", "A.B.", "_", "-", "naïve)", "w@", "É!"]
KNOWN = ["word\n\n", "Para one.\n\nPara two.\n\n", "x\n\n\n", "a\n\n b", "A.\n\nB", "x \n\n", "foo\r\n\r\n", "\n", "\n\n", "a\n", "a\n b", "a\n\tb", "a\r\nb", "if x:\n    y = 1\n\n\n    z\n", "a <|endoftext|>\n<|endoftext|>  b"]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_random_white_space(name, spaced):
    rng = np.random.default_rng(11)
    own = tokens.Encoder(tokens.public_vocabulary(name), spaced)
    texts = list(KNOWN)
    for n in rng.integers(1, 14, 20_000):
        gaps = rng.random(n) < 0.6
        texts.append("".join(GAPS[rng.integers(len(GAPS) if rng.random() < 0.5 else 8)] if g else WORDS[rng.integers(len(WORDS))] for g in gaps))
    want = [x.ids for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, ids, x in zip(texts, want, own(texts)) if np.frombuffer(x, own.dtype).tolist() != ids]
    assert not wrong, (len(wrong), wrong[:10])
