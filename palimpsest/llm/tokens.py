"""Encoding with the tokenizers library, a chunk at a time through a bounded cache.

Pre-tokens of both vocabularies never reach from a character that is no white space to one
that is, so a text parts there and its chunks encode alone. The cache has two
generations of about ``CACHE`` chunks, the older of which goes when the newer is full; it
changes the time, not the ids. Where white space is dropped, Arrow parts the texts, numbers their
chunks and puts the ids together; Python sees each distinct word of a block once.
"""

from __future__ import annotations

import codecs
import gc
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept by a Python worker, some 200 bytes each.
CACHE = 300_000
#: Chunks are looked up for so many code points of text (bytes, where white space is dropped) at once.
BLOCK = 3_000_000
_MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
_GAPS = (b"", b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c", b"\0")
_SPACED = re.compile(rb"\s*\S+|\s+")
#: White space that, unlike single spaces and new lines, never stands between chunks of the quick way.
_ODD = (b"\r", b"\t", b"\x0b", b"\x0c", b"\0")
#: White space beyond ASCII: texts that hold any are encoded in one piece.
_WIDE = re.compile("[\x85\xa0  -     　]")
#: How byte-level vocabularies write bytes: those without a visible character of their own follow from U+0100 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_VISIBLE = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)}
_LOOKS = "".join(" " if b == 0x20 else chr(_VISIBLE.get(b, b)) for b in range(256))
#: New words are encoded so many at once.
RUN = 4_000


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _spaced(raw: bytes) -> list[bytes]:
    """Chunks of a text, each from the white space before it; those that follow a single space stand without it, the first of a text and those with more white space after a zero byte.

    A run of white space is never parted, and one that ends a text is a chunk of its own: how it is
    cut into pre-tokens depends on all of it and on what follows.
    """
    lines = raw.replace(b"\n", b" \n")
    # a part would be empty beside white space, or a lone new line before white space or the end
    if b"  " in lines or b"\n " in lines or lines[:1] == b" " or lines[-1:] in (b" ", b"\n", b"") or any(x in raw for x in _ODD):
        return [x[1:] if x[:1] == b" " and x[1:2] not in _GAPS else x if x[:1] == b"\n" and x[1:2] not in _GAPS else b"\0" + x for x in _SPACED.findall(raw)]
    return (b"\0" + lines).split(b" ")


def _chunk(x: bytes) -> bytes:
    return x[1:] if x[:1] == b"\0" else x if x[:1] == b"\n" else b" " + x


class Encoder:
    """path: a file of the tokenizers library; spaced: whether its pre-tokens take the space before them."""

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.chunk = _chunk if spaced else bytes
        # a new line between chunks is a pre-token of its own; where white space is dropped, a lone control character is
        self.mark, self.risky = ("\n", re.compile(rb".*(?:\s\s|[\n\r\t\x0b\x0c]|<\||\s$)", re.S).match) if spaced else (" \x01 ", re.compile(rb".*\x01", re.S).match)
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.model, self.spaced = self.tokenizer.model, spaced
        self.line = self._pack([self.mark_id]) if spaced else b""
        self.tails: dict[bytes, bytes] = {}
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.words: dict[str, bytes | None] = {}
        self.old_words: dict[str, bytes | None] = {}
        if not spaced:
            self.lone = Tokenizer(self.model)
            self.lone.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
            suffix = getattr(self.model, "end_of_word_suffix", None)
            self.last = np.array([bool(suffix) and (x or "").endswith(suffix) for x in names])

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _packed(self, word: str) -> bytes:
        """Ids of a pre-token, as the model's vocabulary writes it."""
        ids = array("H" if self.dtype.itemsize == 2 else "I", [t.id for t in self.model.tokenize(word)])
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()

    def _parts(self, x: bytes) -> tuple[bytes, str, bytes] | None:
        """A chunk of a new line (or none), one word as the model's vocabulary writes it, and marks behind it (or none), if it is no more than that.

        These are pre-tokens of their own. Apostrophes, which some letters follow in one pre-token, and what
        special tokens begin with are no such marks.
        """
        head, core = b"", x
        if x[:1] in (b"\n", b"\0"):
            head, core = x[:1].strip(b"\0"), x[1:]
        stem = core.rstrip(_MARKS)
        if stem.isalpha():  # ASCII letters
            word = stem.decode()
        else:
            word = stem.decode("utf-8")
            if not word.isalpha():
                return None
            word = stem.decode("latin-1").translate(_VISIBLE)
        return head, word if core is not x else "\u0120" + word, core[len(stem) :]

    def _runs(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each of some words, by the model alone. Where all have a token that ends a word, these part the ids of many words at once; other models get word for word."""
        for first in range(0, len(words), RUN):
            run = codecs.charmap_decode(" ".join(words[first : first + RUN]).encode("utf-8"), "strict", _LOOKS)[0]
            ids = np.array(self.lone.encode_batch_fast([run], add_special_tokens=False)[0].ids, self.dtype)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize).tolist()
            raw = ids.tobytes()
            if len(ends) == run.count(" ") + 1:
                yield from (raw[a:b] for a, b in zip([0, *ends], ends))
            else:
                yield from map(self._packed, run.split(" "))

    def _fill(self, missing: set[bytes]) -> None:
        """Encode what the cache lacks: single pre-tokens by the model alone, others as one text, parted by an id that no chunk has; chunks that could have it go one by one."""
        new, odd, cache, tails, packed = [], [], self.cache, self.tails, self._packed
        for x in missing:
            parts = self._parts(x) if self.spaced else None
            if parts is None:
                raw = self.chunk(x)
                (odd if self.risky(raw) else new).append((x, raw.decode("utf-8")))
                continue
            head, word, tail = parts
            ids = cache.get(x[: -len(tail)]) if tail else None
            if ids is None:
                ids = self.line + packed(word) if head else packed(word)
            if tail:
                end = tails.get(tail)
                if end is None:
                    if len(tails) > 10_000:
                        tails.clear()
                    end = tails[tail] = packed(tail.decode())
                ids += end
            cache[x] = ids
        for first in range(0, len(new), 200):  # short runs encode fastest
            part = new[first : first + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(x[1] for x in part)], add_special_tokens=False)[0].ids, self.dtype)
            raw, size = ids.tobytes(), self.dtype.itemsize
            at = 0
            for (x, _), end in zip(part, [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]):
                self.cache[x] = raw[at * size : end * size]
                at = end + 1
        if odd:
            for (x, _), e in zip(odd, self.tokenizer.encode_batch_fast([x[1] for x in odd], add_special_tokens=False)):
                self.cache[x] = self._pack(e.ids)

    def _look_up(self, parts: list[list[bytes]]) -> dict[bytes, bytes]:
        """A small table of the chunks at hand: looking up in it is cheaper than in the cache."""
        needed = set().union(*parts)
        if len(self.cache) > CACHE:
            self.old, self.cache = self.cache, {}
        missing = needed.difference(self.cache)
        again = missing.intersection(self.old)
        self.cache.update((x, self.old[x]) for x in again)
        self._fill(missing.difference(again))
        cache = self.cache
        return {x: cache[x] for x in needed}

    def _known(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of distinct pieces of lowered chunks, by way of a cache: of nothing, marks alone, or a word that normalisation leaves alone, which are pre-tokens of their own; none for any other."""
        if len(self.words) > CACHE:
            self.old_words, self.words = self.words, {}
        words, old, new, marks = self.words, self.old_words, [], _MARKS.decode()
        for x in [x for x in pieces if x not in words]:
            if x in old:
                words[x] = old[x]
            elif x.isalpha() and x == x.lower() and (x.isascii() or unicodedata.is_normalized("NFC", x)):
                new.append(x)
            else:
                words[x] = None if x.strip(marks) else self._packed(x) if x else b""
        words.update(zip(new, self._runs(new)))
        return list(map(words.__getitem__, pieces))

    def _ids(self, chunks: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct chunks. Each is parted, over its own bytes, before the marks that end it; what is more than a word and marks goes to the library whole."""
        n, (_, starts, data) = len(chunks), chunks.buffers()
        at = np.empty(2 * n + 1, np.int64)
        at[::2] = np.frombuffer(starts, np.int64, n + 1, 8 * chunks.offset)
        at[1::2] = at[:-1:2] + np.asarray(pc.binary_length(pc.ascii_rtrim(chunks, _MARKS.decode())))
        pieces = pa.Array.from_buffers(pa.large_string(), 2 * n, [None, pa.py_buffer(at), data]).dictionary_encode()
        distinct = pa.ListArray.from_arrays([0, len(pieces.dictionary)], pieces.dictionary)
        found = self._known(pc.binary_join(distinct, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n"))
        ids = pa.array([x or b"" for x in found], pa.large_binary()).take(pieces.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, 2 * n + 1, 8 * ids.offset)[::2].copy()
        whole = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), ids.buffers()[2]])
        more = np.flatnonzero(np.array([x is None for x in found])[np.asarray(pieces.indices)[::2]])
        if not len(more):
            return whole
        keys = [x.encode("utf-8") for x in chunks.take(pa.array(more)).to_pylist()]
        by = self._look_up([keys])
        place = np.arange(n)
        place[more] = n + np.arange(len(more))
        return pa.concat_arrays([whole, pa.array([by[x] for x in keys], pa.large_binary())]).take(pa.array(place))

    def _dropped(self, texts: pa.LargeStringArray) -> list[bytes]:
        """Ids of texts whose white space and case are dropped; ASCII is lowered here, the rest by the library."""
        wide = pc.match_substring_regex(texts, _WIDE.pattern)
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # special tokens are told by their case
        parts = pc.ascii_split_whitespace(pc.if_else(wide, "", lowered))
        chunks = parts.flatten().dictionary_encode()
        ids = self._ids(chunks.dictionary).take(chunks.indices)
        starts = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(parts)), dtype=np.int64)]
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)[starts].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        out = [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]
        for i in np.flatnonzero(np.asarray(wide)).tolist():
            out[i] = self._pack(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids)
        return out

    def __call__(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text (null: none) as little-endian integers of ``dtype``."""
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and looking for them costs a fifteenth of the time
        try:
            return self._all(texts) if self.spaced else self._by_arrow(texts)
        finally:
            if collects:
                gc.enable()

    def _by_arrow(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        size = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
        out: list[bytes] = []
        while len(out) < len(texts):
            at = len(out)
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK, "right"))
            out += self._dropped(texts.take(pa.array(np.arange(at, max(at + 1, end)))))  # not a slice: ascii_lower takes wrong bytes of arrays that don't begin where their data do
        return out

    def _all(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size < BLOCK):
                size += len(texts[end] or "")
                end += 1
            whole = {i for i in range(at, end) if texts[i] and not texts[i].isascii() and _WIDE.search(texts[i])}
            parts = [_spaced((texts[i] or "").encode("utf-8")) if i not in whole else [] for i in range(at, end)]
            found = self._look_up(parts)
            for i, part in enumerate(parts, at):
                if i in whole:
                    out.append(self._pack(self.tokenizer.encode(texts[i], add_special_tokens=False).ids))
                else:
                    out.append(b"".join(itemgetter(*part)(found)) if len(part) > 1 else b"".join(map(found.__getitem__, part)))
            at = end
        return out
