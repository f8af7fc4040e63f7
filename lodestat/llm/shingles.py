"""Word shingles and their hashes, shared by the operators on near copies."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
PARITY_WORDS = 4  # bits / 64 that shingles flip; sets of which more bits differ than shingles may are never similar


def run_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of `size` words, joined by one space, in order; fewer words are one run."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    n = len(words) - size + 1
    slices = map(slice, starts[:n].tolist(), ends[size - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, slices), repeat(SEED)), np.uint64, n)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of `size` words (A-Z lower-cased, joined by one space), repeats included, in text order.

    A text of fewer words is one shingle, its whole word sequence; a text without words, or null, has none.
    """
    return run_hashes(WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER)) if text else [], size)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64-bit hash derived from `h`; the 0th is `h` itself."""
    if k == 0:
        return h
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


_LANES = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)[:, None]
_RUN, _BLOCK = 255, 255 * 256


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values in `h` have each bit set (64 counts, bit 0 first).

    Eight bits at a time are added in the byte lanes of one word, over runs of 255 values so that no lane overflows.
    """
    out = np.zeros((8, 8), np.int64)
    for at in range(0, len(h), _BLOCK):
        part = h[at : at + _BLOCK]
        part = np.concatenate([part, np.zeros(-len(part) % _RUN, np.uint64)])
        sums = ((part >> _SHIFTS) & _LANES).reshape(8, -1, _RUN).sum(axis=2, dtype=np.uint64)
        out += sums.view(np.uint8).reshape(8, -1, 8).sum(axis=1, dtype=np.int64).T
    return out.ravel()


def simhash(h: np.ndarray, words: int = 1) -> list[int]:
    """The SimHash of the shingle hashes `h` as `words` signed 64-bit numbers: a bit is 1 if set in over half of them."""
    if not len(h):
        return [0] * words
    bits = np.concatenate([bit_counts(mixed(h, k)) for k in range(words)]) * 2 > len(h)
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def parity(shingles: np.ndarray) -> list[int]:
    """A bit is 1 if an odd number of the distinct `shingles` fall on it, so no more bits of two sets differ than shingles do."""
    bits = np.bincount((shingles % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64).tolist()
