"""Words and n-grams of whole texts as arrays, for the operators that run inside Arrow batches.

A word is a maximal run of ASCII letters and digits and of non-ASCII characters other than Latin-1 signs
(U+0080-U+00BF but ``ª µ º``), general punctuation (U+2000-U+207F) and CJK punctuation (U+3000-U+303F), lower-cased.
Words and n-grams are 64-bit hashes; offsets tell which belong to which text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(256, 0xD6E8FEB86659FD93, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls: null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array (``plain``), and where each string begins and ends in them."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    if not len(strings) or strings.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(strings) + 1, np.int64)
    return np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``limit`` bytes of text each (one text at least), so that arrays stay small."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        until = int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right"))
        until = min(max(until, at + 1), at + 4096)
        yield batch.slice(at, until - at)
        at = until


@dataclass
class Words:
    """``hashes`` of all words in turn; ``first`` has n + 1 entries: text i has words first[i]:first[i + 1].
    ``starts``, ``ends``: the words' bytes in ``data``."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))


def words(strings: pa.Array) -> Words:
    """Words of each text of a ``plain`` array."""
    data, offsets = raw(pc.utf8_lower(strings))
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(strings) + 1, np.int64), none, none, data)
    inside = _WORD_BYTE[data]
    for lead, second, last in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
        at = np.flatnonzero(data == lead)
        at = at[at + last <= n]
        if second:
            at = at[np.isin(data[at + 1], second)]
        elif len(at):
            at = at[~np.isin(data[at + 1], (0xAA, 0xB5, 0xBA))]
        for k in range(last):
            inside[at + k] = False
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~(before & ~edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), first, starts, ends, data)
    lengths = ends - starts
    heads = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
    letters = data[inside].astype(np.uint64) + np.uint64(1)
    letters *= _POWERS[place & 255]
    return Words(mix(np.add.reduceat(letters, heads) + lengths.astype(np.uint64) * _ODD), first, starts, ends, data)


def ngrams(w: Words, n: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word sequences in turn, and the n + 1 offsets of each text's. ``whole_if_short``: a text of 1 to
    n - 1 words has one, made of all its words."""
    count = np.diff(w.first)
    per = np.maximum(count - n + 1, 0)
    if whole_if_short:
        per = np.where((per == 0) & (count > 0), 1, per)
    first = np.concatenate([[0], np.cumsum(per)])
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], per)
    ends = np.repeat(w.first[1:], per)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([w.hashes, np.zeros(n, np.uint64)])
    for k in range(n):
        out += np.where(at + k < ends, padded[at + k], np.uint64(0)) * _POWERS[k + 8]
    return mix(out), first


def uniques(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 64-bit keys within each text, in ascending order: keys, counts, and the offsets of each text's."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(k)))
    return k[at], counts, np.searchsorted(t[at], np.arange(len(first)))


def small_uniques(keys: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``uniques`` for keys below 2**bits: one sort of a combined 64-bit value."""
    text = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    both = np.sort((text << bits) | keys.astype(np.int64))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(both)))
    both = both[at]
    return both & ((1 << bits) - 1), counts, np.searchsorted(both >> bits, np.arange(len(first)))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``, zero where a text has none."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
