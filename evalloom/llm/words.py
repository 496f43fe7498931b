"""Vectorised word scanning and hashing over UTF-8 Arrow columns (numpy)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHARD_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words of anything but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words of digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:256] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Longer words are hashed one by one (BLAKE2b); shorter ones all at once, eight bytes a step.
LONG_WORD = 64
_LANE = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offs, data = column.buffers()
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64, count=column.offset + n + 1)[column.offset :]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def shards(batch: pa.RecordBatch, text: str, limit: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with at most ``limit`` bytes of text; a longer row stands alone."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
        yield batch.slice(at, to - at)
        at, done = to, int(size[to - 1])


def hashed(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and each document's first word (n + 1 pointers).

    A-Z is lower-cased first. A word's length and then its bytes, eight at a time, go through a non-linear
    mixer, so no two words collide by their structure; 64 bits are the only bound.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    x = np.zeros(n + 8, np.uint8)
    np.take(_LOWER, raw, out=x[:n])
    w = kind[x[:n]]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    cut = offsets[:-1]
    cut = cut[cut < n]
    first[cut] = w[cut]
    back = cut[cut > 0] - 1
    last[back] = w[back]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    del first, last, w
    size = e - s
    lanes = np.ndarray((n + 1,), "<u8", x, strides=(1,))  # the eight bytes from every place on
    out = mix(size.astype(np.uint64) * _LANE)
    live = np.flatnonzero(size <= LONG_WORD)
    for step in range(0, LONG_WORD, 8):
        live = live[size[live] > step]
        if not len(live):
            break
        got = lanes[s[live] + step] & _KEEP[np.minimum(size[live] - step, 8)]
        out[live] = mix(out[live] + mix(got + _LANE))
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(x[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    return out, np.searchsorted(s, offsets).astype(np.int64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
