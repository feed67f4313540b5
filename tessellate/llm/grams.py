"""Hashed character n-grams of many texts at once, in numpy over one byte buffer."""

from __future__ import annotations

import numpy as np

PAD = 8  # spaces between texts, more than the longest n-gram
MULTIPLIERS = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393, 3144134277)]


def table(kept: str) -> np.ndarray:
    """Byte map that keeps ASCII letters in lower case, the given ASCII characters and all bytes over 127; the rest becomes a space."""
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    for c in "abcdefghijklmnopqrstuvwxyz" + kept:
        out[ord(c)] = ord(c)
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out[ord(c)] = ord(c) + 32
    return out


def buffer(texts: list[str], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mapped bytes of all texts, each after PAD spaces, and the place where each one's share begins."""
    gap = b" " * PAD
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(p) + PAD for p in parts], np.int64)
    data = keep[np.frombuffer(gap + gap.join(parts) + gap, np.uint8)]
    return data, np.concatenate([[0], np.cumsum(sizes)])


def hashes(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each place (the last n - 1 places have none)."""
    m = len(data) - n + 1
    h = np.full(m, np.uint32((n * 0x9E3779B1) & 0xFFFFFFFF), np.uint32)
    for k in range(n):
        h += data[k : k + m] * MULTIPLIERS[k]
        h ^= h >> np.uint32(13)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - bits)
