"""Shared folders, Arrow blocks and vectorised word scanning for the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_OWN = "file:///tmp/checkpoints/tidewire"
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or an own one where it is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or _OWN).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidewire-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns whose names an operator is about to add (case-insensitive)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def text_block(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column (null: none) end to end, and the n + 1 offsets of its rows."""
    col = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]] if len(col) else np.empty(0, np.uint8)
    return data, (offs - offs[0]) if len(col) else np.zeros(1, np.int64)


def blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into row ranges of about ``max_bytes`` text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = text_block(batch, column)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, max_bytes: int = 1 << 20) -> Iterator[None]:
    """Within it, Spark sends Arrow batches of about ``max_bytes`` at most; by rows alone a task's whole input is one, in the JVM and in its worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, max_bytes)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def trimmed(work: Callable) -> Callable:
    """``work`` over batches, after which its memory goes back to the system: a worker that waits for its next task keeps it else."""

    def run(batches):
        yield from work(batches)
        _pow[:] = [np.ones(1, U64), np.ones(1, U64)]
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between white space: all but space and \x09-\x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters, digits and all beyond ASCII, in lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def word_spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes in ``inside``; no run crosses rows."""
    m = inside[data]
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    full = np.flatnonzero(np.diff(offs) > 0)
    first, last = offs[full], offs[full + 1] - 1
    s[first], e[last] = m[first], m[last]
    starts = np.flatnonzero(s)
    return starts, np.flatnonzero(e) + 1, np.searchsorted(offs, starts, "right") - 1


_BASE = 0x9E3779B97F4A7C15 | 1
_pow = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, U64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _pow[k] = np.multiply.accumulate(p)
    return _pow[0][:n], _pow[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums over a block, for hashes of any of its byte strings."""
    p, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U64) + U64(1)) * p[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end): equal strings, equal hashes, in every block."""
    _, inv = _powers(len(prefix))
    with np.errstate(over="ignore"):
        h = (prefix[ends] - prefix[starts]) * inv[starts]
        return mix(h ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))
