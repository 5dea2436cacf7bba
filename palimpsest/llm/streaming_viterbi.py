"""SentencePiece encoding and decoding by a streaming Viterbi (operator 6).

A text is a path through the lattice of its pieces. Every position keeps one backpointer: its
last piece and where that begins. Only positions within the longest piece of the frontier can
still be left by a later piece, so a window of that length is retained; whenever the
backpointer paths of all surviving positions converge on one boundary, the ids before it are
final and are committed.

Which backpointer a position keeps depends on the kind of model. For a unigram model it is the
one of greatest total score. Scores of a BPE model (the public vocabulary is one) order its
merges, and their greatest sum is not its encoding. There, of all pieces that end at a position,
exactly one follows the piece before it as the merges leave them: two pieces may stand side by
side if and only if the merges give these two for their joined text. See :class:`Merges`.

A boundary that no piece spans (in this vocabulary: before a space that follows anything but
a space) is a point of convergence for every path, so what lies between two of them is encoded
by itself and remembered, in a bounded memory.

Texts are encoded as they are, without Unicode normalisation, so decoding is exact: a space
becomes U+2581, one is put before the text, and characters outside the vocabulary, U+2581
itself among them, become their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_id, small_batches, with_key
from .lattice import model_type, sentencepiece_vocabulary
from .tokens import public_vocabulary

SPACE = "▁"
#: What a character outside the vocabulary costs more than the worst piece, as in the library.
UNKNOWN = 10.0
#: Segments remembered by a worker in each of two generations, some 200 bytes each.
MEMORY = 300_000
#: Beginnings of segments that are remembered, in characters.
HEAD = 8
#: Segments are looked up for so many code points of text at once.
BLOCK = 3_000_000


class Codec:
    """Of a unigram model."""

    def __init__(self, path: str):
        pieces, scores, ids, self.unknown, self.bytes = sentencepiece_vocabulary(path)
        self.score = dict(zip(pieces, zip(scores, ids)))
        self.longest = max(map(len, pieces))
        #: Score and id of what pieces end with, None where that is no piece itself: looking back from a position stops at what is missing here.
        self.ends = {x[k:]: None for x in pieces for k in range(1, len(x))} | self.score
        #: Neighbours inside pieces; no piece spans any others.
        self.inside = {x[k : k + 2] for x in pieces for k in range(len(x) - 1)}
        #: Whether a new line is in no longer piece: then no piece spans its sides.
        self.lines = not any("\n" in x for x in pieces if len(x) > 1)
        self.worst = min(scores) - UNKNOWN
        inner = [x for x in pieces if SPACE in x.lstrip(SPACE)]
        if inner:
            raise ValueError(f"pieces span a space: {inner[:3]}")
        self.value = {i: b for b, i in self.bytes.items()}
        #: What each id stands for.
        self.raw = [b""] * (1 + max(*ids, *self.value, 0))
        for i, x in [*((i, x.replace(SPACE, " ").encode()) for x, i in zip(pieces, ids)), *((i, bytes([b])) for b, i in self.bytes.items())]:
            self.raw[i] = x
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.literal = self._packed([self.bytes[b] for b in SPACE.encode()]) if self.bytes else b""
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def choose(self, held: str, best: list[float], back: list[tuple[int, int]], before: str) -> tuple[float, tuple[int, int]]:
        """Of the position at the end of ``held``: its total, and where its last piece begins with that piece's id (-1: a character outside the vocabulary). best, back: of the positions before; before: the last piece that has been committed."""
        top, way = -1e300, (len(held) - 1, -1)
        for start in range(len(held) - 1, -1, -1):
            found = self.ends.get(held[start:], 0)
            if found == 0:
                break
            if found is not None and best[start] + found[0] > top:
                top, way = best[start] + found[0], (start, found[1])
        if held[-1] not in self.score and best[-1] + self.worst > top:
            top, way = best[-1] + self.worst, (len(held) - 1, -1)
        return top, way

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of characters (spaces as U+2581), each as soon as no later character can change it."""
        held, best, back, before = "", [0.0], [(0, -1)], ""
        for c in symbols:
            held += c
            top, way = self.choose(held, best, back, before)
            best.append(top)
            back.append(way)
            if len(held) >= 4 * self.longest:
                at = self._converged(back, len(held))
                if at:
                    yield from self._ids(held, back, at)
                    before = held[back[at][0] : at]
                    held, best, back = held[at:], [x - best[at] for x in best[at:]], [(s - at, i) for s, i in back[at:]]
        yield from self._ids(held, back, len(held))

    def segment(self, symbols: str) -> Iterable[int]:
        return self.stream(symbols)

    def _converged(self, back: list[tuple[int, int]], n: int) -> int:
        """The last boundary on the paths of all positions that a later piece can leave from, 0 if there is none."""
        ends = set(range(n - self.longest + 1, n + 1))
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(back[last][0])
        return ends.pop()

    def _ids(self, held: str, back: list[tuple[int, int]], end: int) -> list[int]:
        out: list[int] = []
        while end:
            start, i = back[end]
            out.extend([i] if i >= 0 else [self.bytes[b] for b in reversed(held[start:end].encode("utf-8", "surrogatepass"))])
            end = start
        return out[::-1]

    @staticmethod
    def _packed(ids: Iterable[int]) -> bytes:
        return np.fromiter(ids, np.int32).tobytes()

    def _encoded(self, symbols: str) -> bytes:
        return self._packed(self.segment(symbols) if len(symbols) < 4 * self.longest else self.stream(symbols))

    def _parts(self, text: str) -> list[str]:
        """Names of a text's segments: a word that follows one space, or begins the text, as it is; one that begins with a new line too; any other with U+2581 before it; U+2581 alone for that character itself."""
        parts = (text.replace("\n", " \n") if self.lines else text).split(" ")
        if "" not in parts and SPACE not in text:
            return parts
        out: list[str] = []
        for k, plain in enumerate(text.split(SPACE)):
            if k:
                out.append(SPACE)
            symbols = plain.replace(" ", SPACE) if k else SPACE + plain.replace(" ", SPACE)
            out.extend(x[1:] if x[0] == SPACE and x[1:2] not in ("", SPACE, "\n") else SPACE + x for x in self.segments.findall(symbols))
        return out

    def _found(self, parts: list[list[str]]) -> dict[str, bytes]:
        """Ids of all segments at hand, from what is remembered or anew."""
        needed = set().union(*parts)
        if len(self.memory) > MEMORY:
            self.older, self.memory = self.memory, {}
        found = {x: self.memory[x] for x in needed if x in self.memory}
        for x in needed.difference(found):
            ids = self.older.get(x)
            if ids is None:
                if x[-2:] not in self.inside and (stem := found.get(x[:-1]) or self.memory.get(x[:-1])) and x[0] != SPACE:
                    ids = stem + self._encoded(x[-1])
                else:
                    ids = self.literal if x == SPACE else self._encoded(x[1:] if x[0] == SPACE else x if x[0] == "\n" and self.lines else SPACE + x)
            found[x] = ids
            if len(x) <= 64:
                self.memory[x] = ids
        return found

    def encode_all(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null or empty one has none."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size < BLOCK):
                size += len(texts[end] or "")
                end += 1
            parts = [self._parts(x) if x else [] for x in texts[at:end]]
            found = self._found(parts)
            out.extend(np.frombuffer(b"".join(itemgetter(*p)(found)) if len(p) > 1 else b"".join(map(found.__getitem__, p)), np.int32) for p in parts)
            at = end
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


class Merges(Codec):
    """Of a BPE model: of all neighbours that make a piece, those of the highest score merge first, from the left.

    What the merges make of a text is, up to each of its boundaries, what they make of the text up to
    there. So each position has one last piece, whatever follows, and a path of such pieces is
    the encoding of the whole.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.pairs: dict[tuple[str, str], bool] = {}
        #: The last piece of the beginnings of segments, which many share.
        self.heads: dict[str, str] = {}
        #: Of each longer piece: the merges that make it.
        self.made: dict[str, list[tuple[float, str, str]] | None] = {}

    def merged(self, symbols: str, log: list[tuple[float, str, str]] | None = None) -> list[str]:
        """The pieces that the merges leave of a text; characters outside the vocabulary stand alone. log: gets of each merge its negative score, and the first and last piece after it."""
        score, part = self.score, list(symbols)
        before, after = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        ready: list[tuple[float, int, str]] = []
        end = len(part) - 1

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := score.get(part[i] + part[j])) is not None:
                heapq.heappush(ready, (-found[0], i, part[i] + part[j]))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while ready:
            rank, i, whole = heapq.heappop(ready)
            j = after[i]
            if not part[i] or j < 0 or part[i] + part[j] != whole:
                continue  # one of the two has merged since
            part[i], part[j], after[i] = whole, "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
            else:
                end = i
            if log is not None:
                log.append((rank, part[0], part[end]))
            offer(before[i], i)
            offer(i, after[i])
        return [x for x in part if x]

    def _history(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece, None if they make something else of its characters."""
        if len(piece) == 1:
            return []
        if piece not in self.made:
            log: list[tuple[float, str, str]] = []
            self.made[piece] = log if self.merged(piece, log) == [piece] else None
        return self.made[piece]

    def beside(self, first: str, second: str) -> bool:
        """Whether the merges leave these two pieces as they are; ``first`` is empty at the beginning of a text.

        Each is made by its own merges, in an order that both share by score, the left one first among
        equals. They stay apart unless the pieces that face each other at some time merge sooner.
        """
        a, b = self._history(first) if first else [], self._history(second)
        if a is None or b is None:
            return False
        left, right = first[-1:], second[0]
        i = j = 0
        while left:
            across = self.score.get(left + right)
            rank = -across[0] if across is not None else math.inf
            if i < len(a) and a[i][0] <= rank and (j == len(b) or a[i][0] <= b[j][0]):
                left = a[i][2]
                i += 1
            elif rank < math.inf and (j == len(b) or rank <= b[j][0]):
                return False
            elif j < len(b):
                right = b[j][1]
                j += 1
            else:
                return True
        return True

    def _fits(self, first: str, second: str) -> bool:
        fits = self.pairs.get((first, second))
        if fits is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            fits = self.pairs[first, second] = self.beside(first, second)
        return fits

    def segment(self, symbols: str) -> list[int]:
        """As :meth:`stream`, for a text so short that the window holds it."""
        ends, pairs, heads, last, begin = self.ends, self.pairs, self.heads, [""], [0]
        for n in range(1, len(symbols) + 1):
            piece = heads.get(symbols[:n]) if n <= HEAD else None
            if piece is None:
                for start in range(n - 1, -1, -1):
                    piece = symbols[start:n]
                    found = ends.get(piece, 0)
                    if found or start == n - 1:
                        fits = pairs.get((last[start], piece))
                        if self._fits(last[start], piece) if fits is None else fits:
                            break
                    elif found == 0:
                        raise ValueError("no piece ends here")
                else:
                    raise ValueError("no piece ends here")
                if n <= HEAD:
                    if len(heads) >= MEMORY:
                        heads.clear()
                    heads[symbols[:n]] = piece
            last.append(piece)
            begin.append(n - len(piece))
        return self._ids(symbols, [(start, self.score[x][1] if x in self.score else -1) for start, x in zip(begin, last)], len(symbols))

    def choose(self, held: str, best: list[float], back: list[tuple[int, int]], before: str) -> tuple[float, tuple[int, int]]:
        last = len(held) - 1
        for start in range(last, -1, -1):
            found = self.ends.get(held[start:], 0)
            if found == 0 and start < last:
                break
            if (found or start == last) and self._fits(held[back[start][0] : start] if start else before, held[start:]):
                return 0.0, (start, found[1] if found else -1)
        raise ValueError("no piece ends here")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Merges(path) if model_type(path) == 2 else Codec(path)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(id, ids) of every row of ``docs`` (doc_id, text; others are ignored); a null or empty text has no ids."""
    path = vocabulary or public_vocabulary("piece_bpe_32k.model")

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(codec(path).encode_all(texts.tolist()))

    small_batches(docs.sparkSession)
    return with_key(docs, "text").select("id", ids("text").alias("ids"))


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(id, text) of rows (id, ids): what was encoded, with the empty text for null."""
    path = vocabulary or public_vocabulary("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([own.decode(x.tolist()) if x is not None else "" for x in ids])

    return rows.select("id", text("ids").alias("text"))


def query(docs: DataFrame) -> DataFrame:
    """Of every document: n_ids, ids_crc32 (little-endian 32-bit ids), text_sha256 of its text and decoded_sha256 of what its ids decode to."""
    path = public_vocabulary("piece_bpe_32k.model")

    @F.pandas_udf("n_ids long, ids_crc32 long, decoded_sha256 string")
    def both(texts: pd.Series) -> pd.DataFrame:
        own = codec(path)
        rows = []
        for ids in own.encode_all(texts.tolist()):
            rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(own.decode(ids.tolist()).encode("utf-8", "surrogatepass")).hexdigest()))
        return pd.DataFrame(rows, columns=["n_ids", "ids_crc32", "decoded_sha256"])

    small_batches(docs.sparkSession)
    rows = with_key(docs, "text").select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), both("text").alias("x"))
    return rows.select(doc_id(), "x.n_ids", "x.ids_crc32", "text_sha256", "x.decoded_sha256")
