"""Words and word shingles of whole text columns as hashed numpy arrays, without a Python object per word."""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_GRAM = np.random.default_rng(20240301).integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    there = np.full(n, U(_BASE), dtype=np.uint64)
    back = np.full(n, U(pow(_BASE, -1, 1 << 64)), dtype=np.uint64)
    there[0] = back[0] = U(1)
    return np.cumprod(there), np.cumprod(back)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none), one after the other, and where each begins and the last ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8), offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and the number of words of each text (null: none).

    A word is a run of bytes other than ASCII white space. A text's words need not be told from the
    next text's by a space. The hash is a polynomial over a random table of the bytes, taken from
    prefix sums, and scrambled.
    """
    raw, offsets = text_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    there, back = _powers(max(22, int(len(raw)).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * there[: len(raw)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def windows(counts: np.ndarray, n: int) -> np.ndarray:
    """Positions (in the array of all words) at which a window of n words of one text begins."""
    total = int(counts.sum())
    if total < n:
        return np.zeros(0, np.int64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    return np.flatnonzero(left >= n)


def gram_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for j in range(n):
        out += words[starts + j] * _GRAM[j % 64]
        if j % 64 == 63:
            out = mixed(out)
    return mixed(out)


def shingles(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's n-word shingles, with repeats, and their number for each text.

    A text of fewer words, one at least, has all of them as its only shingle.
    """
    starts = windows(counts, n)
    many = np.maximum(counts - n + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not len(short):
        return gram_hashes(words, starts, n), many
    begins = np.cumsum(counts) - counts
    extra = np.array([mixed(np.sum(words[begins[i] : begins[i] + counts[i]] * _GRAM[: counts[i]] + U(counts[i]), keepdims=True))[0] for i in short], np.uint64)
    owner = np.concatenate([np.repeat(np.arange(len(counts)), many), short])
    both = np.concatenate([gram_hashes(words, starts, n), extra])
    many[short] = 1
    return both[np.argsort(owner, kind="stable")], many


def text_ids(texts: pa.Array) -> pa.Array:
    """128 bits of BLAKE2b over each text's words, joined by single spaces."""
    raw, offsets = text_bytes(texts)
    inside = ~_IS_SPACE[raw]
    behind = np.zeros(len(raw), bool)  # the white space that follows a word of its text
    behind[1:] = inside[:-1] & ~inside[1:]
    behind[offsets[:-1][offsets[:-1] < len(raw)]] = False
    kept = inside | behind
    joined = np.where(inside, raw, np.uint8(0x20))[kept]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])[offsets].tolist()
    last = [b - (b > a and joined[b - 1] == 0x20) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.array([blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(ends, last, strict=False)], pa.binary())
