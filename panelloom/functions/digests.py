"""MD5 of many short keys at once, for draws that any engine can repeat.

A key is ``seed:rep:slot``, at most 55 bytes, so its digest is one block: 64 steps on 32-bit words, taken here for a whole
batch of keys in step. Only the digest's first four bytes are kept.
"""

from __future__ import annotations

import math

import numpy as np

# Keys digested at a time: their words stay in a core's cache.
BATCH = 8_192
_MASK = 0xFFFFFFFF
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & _MASK for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_TENS = 10 ** np.arange(1, 19, dtype=np.int64)


def _heads(words: list, size: int) -> np.ndarray:
    """First four bytes of the digest as a big-endian number; a word is one number, or an array where it differs by key."""
    a, b, c, d = (np.full(size, x, np.uint32) for x in _START)
    f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(64):
        stage, turn = i // 16, _TURNS[i // 16][i % 4]
        if stage == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif stage == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif stage == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[stage] % 16]
        f += a
        if isinstance(word, np.ndarray):
            f += word
            word = 0
        f += np.uint32((_SINES[i] + word) & _MASK)
        np.left_shift(f, np.uint32(turn), out=t)
        f >>= np.uint32(32 - turn)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(_START[0])).byteswap()


def _alike(seed: int, rep: np.ndarray, slot: np.ndarray, lengths: tuple[int, int]) -> np.ndarray:
    """Heads of keys whose numbers have the same counts of digits."""
    head = f"{seed}:".encode()
    places = (len(head), len(head) + lengths[0] + 1)
    size = places[1] + lengths[1]
    if size > 55:
        raise ValueError(f"a key of {size} bytes does not fit one block")
    fixed = bytearray(64)
    fixed[: len(head)] = head
    fixed[places[1] - 1] = ord(":")
    fixed[size] = 0x80
    fixed[56:58] = (size * 8).to_bytes(2, "little")
    words: list = [int.from_bytes(fixed[k : k + 4], "little") for k in range(0, 64, 4)]
    for number, place, n in zip((rep, slot), places, lengths):
        rest = number.astype(np.uint32) if n < 10 else number.astype(np.uint64)
        for k in range(place + n - 1, place - 1, -1):
            whole = rest // 10
            digit = (rest - whole * 10 + 48).astype(np.uint32) << np.uint32(8 * (k % 4))
            words[k // 4] = digit | (words[k // 4] if isinstance(words[k // 4], np.ndarray) else np.uint32(words[k // 4]))
            rest = whole
    return _heads(words, len(rep))


def drawn(seed: int, rep: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    """Number below ``n`` drawn for every pair of replicate and slot: 32 bits of the digest of their key, modulo ``n``."""
    out = np.empty(len(rep), np.int64)
    for lo in range(0, len(rep), BATCH):
        r, s = rep[lo : lo + BATCH], slot[lo : lo + BATCH]
        digits = (np.searchsorted(_TENS, r, "right") + 1) * 32 + np.searchsorted(_TENS, s, "right") + 1
        heads = np.empty(len(r), np.int64)
        for kind in np.unique(digits):
            mine = digits == kind
            heads[mine] = _alike(seed, r[mine], s[mine], divmod(int(kind), 32))
        out[lo : lo + BATCH] = heads % n
    return out
