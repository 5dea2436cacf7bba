"""AES in CBC mode (FIPS 197, SP 800-38A), as far as reading files needs it.

Decryption takes all blocks at once, as array operations; encryption is a chain by nature and
is only needed for the few kilobytes that a key is derived from.
"""

from __future__ import annotations

import hashlib

import numpy as np


def _times(a: int, b: int) -> int:
    """Product in the field of 256 elements modulo x^8 + x^4 + x^3 + x + 1."""
    out = 0
    while b:
        out ^= a * (b & 1)
        a, b = (a << 1) ^ (0x11B if a & 0x80 else 0), b >> 1
    return out


def _substitution() -> list[int]:
    out = [0x63] * 256
    x = y = 1
    while True:  # x runs through the powers of 3, y through their inverses
        x, y = _times(x, 3), _times(y, 0xF6)
        out[x] = 0x63 ^ y ^ (y << 1 | y >> 7) & 255 ^ (y << 2 | y >> 6) & 255 ^ (y << 3 | y >> 5) & 255 ^ (y << 4 | y >> 4) & 255
        if x == 1:
            return out


_S = _substitution()
_INVERSE = np.argsort(_S).astype(np.uint8)
#: Column of a substituted byte in the first row, after mixing, as one number; other rows are rotations of it.
_MIXED = [[_times(s, 2) << 24 | s << 16 | s << 8 | _times(s, 3) for s in _S]]
for _ in range(3):
    _MIXED.append([x >> 8 | (x & 255) << 24 for x in _MIXED[-1]])
_UNMIX = {k: np.array([_times(x, k) for x in range(256)], np.uint8) for k in (9, 11, 13, 14)}
#: Where each byte of a state comes from when rows are shifted back.
_BACK = np.array([(i - 4 * (i % 4)) % 16 for i in range(16)])


class Aes:
    """key: 16 or 32 bytes."""

    def __init__(self, key: bytes):
        n, words = len(key) // 4, [int.from_bytes(key[i : i + 4], "big") for i in range(0, len(key), 4)]
        factor = 1
        for i in range(n, 4 * (n + 7)):
            x = words[-1]
            if i % n == 0:
                x = (x << 8 | x >> 24) & 0xFFFFFFFF
            if i % n == 0 or (n > 6 and i % n == 4):
                x = _S[x >> 24] << 24 | _S[x >> 16 & 255] << 16 | _S[x >> 8 & 255] << 8 | _S[x & 255]
            if i % n == 0:
                x ^= factor << 24
                factor = _times(factor, 2)
            words.append(words[-n] ^ x)
        self.words, self.rounds = words, n + 6

    def _block(self, s: list[int]) -> list[int]:
        w, (t0, t1, t2, t3) = self.words, _MIXED
        a, b, c, d = (x ^ k for x, k in zip(s, w))
        for r in range(4, 4 * self.rounds, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ w[r], t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ w[r + 1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ w[r + 2], t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ w[r + 3],
            )
        last = w[4 * self.rounds :]
        rows = ((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))
        return [(_S[x >> 24] << 24 | _S[y >> 16 & 255] << 16 | _S[z >> 8 & 255] << 8 | _S[v & 255]) ^ k for (x, y, z, v), k in zip(rows, last)]

    def encrypt(self, data: bytes, iv: bytes) -> bytes:
        """data: whole blocks."""
        numbers = np.frombuffer(data, ">u4").tolist()
        held, out = np.frombuffer(iv, ">u4").tolist(), []
        for i in range(0, len(numbers), 4):
            held = self._block([x ^ y for x, y in zip(numbers[i : i + 4], held)])
            out.extend(held)
        return np.array(out, ">u4").tobytes()

    def decrypt(self, data: bytes, iv: bytes) -> bytes:
        """data: whole blocks."""
        blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
        keys = np.array(self.words, ">u4").view(np.uint8).reshape(-1, 16)
        s = blocks ^ keys[-1]
        for r in range(self.rounds - 1, -1, -1):
            s = _INVERSE[s[:, _BACK]] ^ keys[r]
            if r:
                columns = s.reshape(-1, 4, 4)
                around = [np.roll(columns, -k, axis=2) for k in range(4)]
                s = (_UNMIX[14][around[0]] ^ _UNMIX[11][around[1]] ^ _UNMIX[13][around[2]] ^ _UNMIX[9][around[3]]).reshape(-1, 16)
        before = np.concatenate([np.frombuffer(iv, np.uint8)[None], blocks[:-1]])
        return (s ^ before).tobytes()


def plain(key: bytes, data: bytes) -> bytes:
    """A string or stream: its first block is the initial vector, its last bytes say how many were added."""
    data = data[: len(data) // 16 * 16]
    if len(data) < 32:
        return b""
    out = Aes(key).decrypt(data[16:], data[:16])
    return out[: -out[-1]] if 1 <= out[-1] <= 16 else out


def hardened(password: bytes, salt: bytes, more: bytes = b"") -> bytes:
    """The hash of revision 6 (ISO 32000-2, algorithm 2.B)."""
    k, n = hashlib.sha256(password + salt + more).digest(), 0
    while True:
        n += 1
        e = Aes(k[:16]).encrypt((password + k + more) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]
