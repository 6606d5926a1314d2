"""Hashes of all words of a text, and of all runs of consecutive words, in numpy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
BASES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_RUNS = tuple(np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
#: Long texts are hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 20
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2 ** 64."""
    size = 1 << max(12, (n - 1).bit_length())
    key = (int(base), size)
    if key not in _POWERS:
        for old in [k for k in _POWERS if k[0] == key[0]]:
            del _POWERS[old]
        _POWERS[key] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)], dtype=np.uint64)
    return _POWERS[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece(codes: np.ndarray, base: np.uint64) -> np.ndarray:
    word = ~_SPACE[codes]
    edge = np.diff(np.r_[np.int8(0), word.astype(np.int8), np.int8(0)])
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not start.size:
        return np.zeros(0, np.uint64)
    power = _powers(base, codes.size + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: codes.size], dtype=np.uint64)])
    inverse = np.uint64(pow(int(base), -1, 2**64))
    back = _powers(inverse, codes.size + 1)
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes, base: np.uint64 = BASES[0], lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word (run of anything but the six ASCII white-space characters), in order."""
    if lower:
        text = text.lower()
    codes = np.frombuffer(text, np.uint8)
    if codes.size <= PIECE:
        return _piece(codes, base)
    out, at = [], 0
    while at < codes.size:
        to = min(codes.size, at + PIECE)
        while to < codes.size and not _SPACE[codes[to]]:
            ahead = np.flatnonzero(_SPACE[codes[to : to + PIECE]])
            to = to + int(ahead[0]) if ahead.size else min(codes.size, to + PIECE)
        out.append(_piece(codes[at:to], base))
        at = to
    return np.concatenate(out)


def run_hashes(words: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive words."""
    count = words.size - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    factor, out = _RUNS[kind], np.zeros(count, np.uint64)
    for i in range(n):
        out = out * factor + words[i : i + count]
    return mix(out)
