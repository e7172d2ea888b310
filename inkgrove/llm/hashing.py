"""Hashes of many short slices of bytes at once."""

from __future__ import annotations

import numpy as np
import xxhash

#: Slices longer than this are hashed one by one.
LONG_SLICE = 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_SALT = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slice_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:stop], which must not be empty: eight bytes are mixed in at a time, so slices of up to
    eight bytes of one length never share a hash and longer ones do so by chance only."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    sizes = (stops - starts).astype(np.int64)
    out = mix(sizes.astype(np.uint64) + _SALT)
    live, at, left = slice(None), starts.astype(np.int64), np.where(sizes > LONG_SLICE, 0, sizes)
    while len(left):
        out[live] = mix((out[live] ^ (wide[at] & _MASKS[np.minimum(left, 8)])) + _SALT)
        more = left > 8
        live = np.flatnonzero(more) if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG_SLICE).tolist():
        out[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : stops[i]].tobytes())
    return out
