"""Vectorised words and hashes of whole texts, for use inside Arrow tasks.

Texts arrive as Arrow string arrays; everything here works on their UTF-8 bytes
with numpy, in slices of about a megabyte (one document at least), so a task's
memory does not depend on the size of its batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)

#: A-Z become a-z, every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` once lower-cased: digits, a-z and all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of `[^\x20\x09-\x0D]`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Longer spans are digested one by one.
CHUNKED_BYTES = 512


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each span: eight bytes at a time through a bijection, BLAKE2 for long ones.

    Spans of equal length of at most eight bytes never collide; all others do by
    chance of 2^-64 only, whatever their structure.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    load = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) * _STEP + _STEP)
    live = np.flatnonzero((size > 0) & (size <= CHUNKED_BYTES))
    at, left, now = starts[live], size[live], out[live]
    while len(live):
        now = mix(now ^ (load[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        done = ~more
        out[live[done]] = now[done]
        live, at, left, now = live[more], at[more] + 8, left[more] - 8, now[more]
    for i in np.flatnonzero(size > CHUNKED_BYTES):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def texts(array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of documents; nulls are empty texts."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(array):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, len(array))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(is_word: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True within documents, and where each document's words begin."""
    n = len(is_word)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    before &= ~edge[:n]
    starts = np.flatnonzero(is_word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, first word of each document and the end, starts, ends)."""
    low = LOWER[data]
    starts, ends, first = word_spans(kind[low], offs)
    return hash_spans(low, starts, ends), first, starts, ends


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] for every i; the caller drops those across documents."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * _STEP + words[j : j + n]
    return mix(out)
