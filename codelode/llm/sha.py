"""SHA-256 over many messages at once in numpy, with states that can be kept and resumed between 64-byte blocks.

hashlib can copy a state but not store it; a tree that keeps states in files needs them as bytes.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]


def _cube_root(x: int) -> int:
    lo, hi = 0, 1 << (x.bit_length() // 3 + 1)
    while lo < hi:
        mid = (lo + hi + 1) >> 1
        lo, hi = (mid, hi) if mid**3 <= x else (lo, mid - 1)
    return lo


#: Fractional bits of the square roots of the first 8 primes, and of the cube roots of the first 64.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], np.uint32)
_ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _PRIMES[:64]], np.uint32)
#: What ends a message of so many whole blocks.
_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), np.uint8).reshape(256, 2)
DIGEST = 32


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States (n, 8) after one more block each; blocks (n, 16) big-endian words, or (1, 16) for all."""
    w = list(blocks.T)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = np.ascontiguousarray(states.T)
    for k, m in zip(_ROUND, w, strict=True):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (m + k)
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def ended(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of messages of so many whole blocks each."""
    out = np.empty((states.shape[0], DIGEST), np.uint8)
    for n in np.unique(blocks).tolist():
        last = np.zeros((1, 16), np.uint32)
        last[0, 0], last[0, 14], last[0, 15] = 1 << 31, n * 512 >> 32, n * 512 & 0xFFFFFFFF
        at = blocks == n
        out[at] = absorb(states[at], last).astype(">u4").view(np.uint8).reshape(-1, DIGEST)
    return out


def hex_text(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32) as lowercase hex (n, 64): a block each."""
    return _HEX[digests].reshape(digests.shape[0], 64)


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(hex_text(digests)).view(">u4").astype(np.uint32)


def to_bytes(states: np.ndarray) -> np.ndarray:
    return states.astype(">u4").view(np.uint8).reshape(-1, DIGEST)


def from_bytes(kept: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(kept).view(">u4").astype(np.uint32).reshape(-1, 8)
