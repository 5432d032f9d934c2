"""Words of a text: maximal runs of letters and digits of the lower-cased text."""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import numpy as np

# ``\w`` without the underscore is the set of letters and numbers of every script.
WORD = re.compile(r"[^\W_]+")
_CHUNK = 1 << 18  # characters hashed at a time, so that the arrays stay in the processor's cache
_STEP = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    """A value for each code point of a word, 0 for all others."""
    values = np.random.default_rng(19).integers(1, 1 << 63, sys.maxunicode + 1, dtype=np.uint64)
    values[~np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)] = 0
    return values


@lru_cache(maxsize=2)
def _powers(step: int, count: int) -> np.ndarray:
    powers = np.full(count, step, dtype=np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


def _hashed(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a text: the values of its characters times powers by place, without a loop over words."""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    value = _values()[codes]
    inside = value != 0
    start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(start):
        return np.zeros(0, np.uint64), start
    count = 1 << max(18, int(len(codes)).bit_length())
    value *= _powers(_STEP, count)[: len(codes)]
    return np.add.reduceat(value, start) * _powers(pow(_STEP, -1, 1 << 64), count)[start], start


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of all texts, and the text that it belongs to."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    held: list[str] = []
    size, first = 0, 0

    def flush() -> None:
        found, start = _hashed("\n".join(held))
        hashes.append(found)
        owners.append(first + np.searchsorted(np.cumsum([len(t) + 1 for t in held]), start, side="right"))

    for k, text in enumerate(texts):
        held.append(text.lower() if text else "")
        size += len(held[-1]) + 1
        if size >= _CHUNK:
            flush()
            held, size, first = [], 0, k + 1
    if held:
        flush()
    return np.concatenate(hashes), np.concatenate(owners)
