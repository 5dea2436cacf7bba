"""All pieces of a vocabulary inside many short strings at once, by array operations.

Strings are padded rows of code points. For each length, the hashes of all substrings of that
length are looked up in a table; walking the columns from left to right then gives the
forward sums or the Viterbi path of all strings together.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Table:
    """Numbers of 64-bit keys, each at one of two places (cuckoo hashing), so that looking up is two reads."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        while not self._built(keys, values, bits):
            bits += 1

    def _built(self, keys: np.ndarray, values: np.ndarray, bits: int) -> bool:
        self.shifts = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        places = [x.tolist() for x in self._places(keys)]
        held: list[dict[int, int]] = [{}, {}]
        for k in range(len(keys)):
            side = 0
            for _ in range(64):
                at = places[side][k]
                k, held[side][at] = held[side].get(at, -1), k
                if k < 0:
                    break
                side = 1 - side
            else:
                return False
        self.keys, self.values = np.zeros((2, 1 << bits), np.uint64), np.full((2, 1 << bits), -1, np.int32)
        for side in (0, 1):
            at, own = np.array(list(held[side]), np.int64), np.array(list(held[side].values()), np.int64)
            self.keys[side, at], self.values[side, at] = keys[own], values[own]
        return True

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (keys >> self.shifts[0]).view(np.int64), (keys & self.shifts[1]).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for those that have none."""
        first, second = self._places(keys)
        found = np.where(self.keys[0][first] == keys, self.values[0][first], -1)
        missed = np.flatnonzero(found < 0)
        second = second[missed]
        found[missed] = np.where(self.keys[1][second] == keys[missed], self.values[1][second], -1)
        return found


class Pieces:
    """pieces: distinct non-empty strings; ``find`` gives their places in the list."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.tables: dict[int, _Table] = {}
        for n in sorted({len(x) for x in pieces}):
            own = [k for k, x in enumerate(pieces) if len(x) == n]
            codes = np.array([[ord(c) for c in pieces[k]] for k in own], np.uint64)
            keys = self._hash([codes[:, i] for i in range(n)])
            if len(np.unique(keys)) != len(keys):
                raise ValueError("pieces repeat")
            self.tables[n] = _Table(keys, np.array(own))

    @staticmethod
    def _hash(columns: list[np.ndarray]) -> np.ndarray:
        x = np.full_like(columns[0], 0x51)
        for c in columns:
            x = (x ^ c) * _MULTIPLIER
            x ^= x >> np.uint64(32)
        return _mixed(x)

    def find(self, codes: np.ndarray):
        """codes: rows of code points, 0 where a row has ended. Yields (start, n, rows, pieces) for every piece found."""
        rows, width = codes.shape
        wide = codes.astype(np.uint64)
        running = [np.full(rows, 0x51, np.uint64) for _ in range(width)]
        for n in range(1, min(self.longest, width) + 1):
            table = self.tables.get(n)
            for start in range(width - n + 1):
                x = (running[start] ^ wide[:, start + n - 1]) * _MULTIPLIER
                running[start] = x ^ (x >> np.uint64(32))
                if table is None:
                    continue
                found = table(_mixed(running[start]))
                hit = np.flatnonzero((found >= 0) & (codes[:, start + n - 1] != 0))
                if len(hit):
                    yield start, n, hit, found[hit]


    def all_of(self, codes: np.ndarray, count: int):
        """codes: one long row. Yields (n, starts, pieces) of the pieces that begin at its first ``count`` places."""
        wide = np.r_[codes.astype(np.uint64), np.zeros(self.longest, np.uint64)]
        x = np.full(count, 0x51, np.uint64)
        for n in range(1, self.longest + 1):
            last = wide[n - 1 : n - 1 + count]
            x = (x ^ last) * _MULTIPLIER
            x ^= x >> np.uint64(32)
            if n in self.tables:
                found = self.tables[n](_mixed(x))
                hit = np.flatnonzero((found >= 0) & (last != 0))
                yield n, hit, found[hit]


def padded(strings: list[str]) -> np.ndarray:
    """Code points of strings of nearly equal length, as a matrix filled up with 0."""
    width = max(map(len, strings))
    raw = "".join(x.ljust(width, "\0") for x in strings).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, "<u4").reshape(len(strings), width)


@lru_cache(maxsize=2)
def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[float], list[int], int, dict[int, int]]:
    """Normal pieces of a sentencepiece model with their scores and ids, the unknown id, and the id of each byte."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, ids, byte = [], [], [], {}
    for i in range(p.get_piece_size()):
        if p.is_byte(i):
            byte[int(p.id_to_piece(i)[1:-1], 16)] = i
        elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
            pieces.append(p.id_to_piece(i))
            scores.append(p.get_score(i))
            ids.append(i)
    return pieces, scores, ids, p.unk_id(), byte


def model_type(path: str) -> int:
    """Of a sentencepiece model: 1 unigram, 2 BPE; field 3 of the trainer's settings, field 2 of the file."""

    def number(raw: bytes, at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return n, at

    def fields(raw: bytes):
        at = 0
        while at < len(raw):
            tag, at = number(raw, at)
            if tag & 7 == 0:
                value, at = number(raw, at)
            else:
                size, at = number(raw, at) if tag & 7 == 2 else (8 if tag & 7 == 1 else 4, at)
                value, at = raw[at : at + size], at + size
            yield tag >> 3, value

    with open(path, "rb") as f:
        trainer = b"".join(v for k, v in fields(f.read()) if k == 2)
    return dict(fields(trainer)).get(3, 1)
