"""Counts of 64-bit keys over the whole corpus, moved as sorted, delta-coded runs.

A task turns a block of keys into sorted distinct keys with counts, cut by their top bits into
buckets; each piece is a small binary. A bucket's pieces meet in one task and are added up. Keys
are hashes, and a block sends each key once, so no bucket is larger than the others however often
one key occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

U64 = np.uint64
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(a: np.ndarray) -> bytes:
    """An unsigned array by byte planes, compressed: planes that are nearly constant cost nothing."""
    return _PACK.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(_UNPACK.decompress(b), np.uint8)
    w = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(w, -1).T).view(dtype).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending unsigned keys as differences."""
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def pieces(keys: np.ndarray, counts: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, keys, counts) of ascending ``keys`` of ``bits`` bits; ``buckets`` is a power of two."""
    shift = U64(bits - int(buckets).bit_length() + 1)
    b = (keys >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(b)][: len(cut)], strict=True):
        yield int(b[x]), pack_keys(keys[x:y]), pack(counts[x:y].astype(np.uint32))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    k, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
    return k[cut], np.add.reduceat(n, cut) if len(cut) else n


def buckets_for(expected: int, each: int = 1 << 20, most: int = 1 << 16) -> int:
    """A power of two of buckets with about ``each`` keys."""
    return 1 << max(3, min(most.bit_length() - 1, int(max(1, expected // each)).bit_length()))
