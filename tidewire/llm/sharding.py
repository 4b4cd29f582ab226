"""Sharding by histogram sort: equal bytes in every shard, one exchange.

Each row gets a 16-byte key: a hash of the text, then a hash of the row's id, so equal texts stay
together but a hot text can still be cut. Boundaries are probed: every partition counts the exact
bytes and rows below the candidate keys, the counts are added up, and the interval around each
wanted boundary is probed again more finely until its bytes are within the tolerance (or it holds
one key). Shards are cut further into runs of a bounded size; their exact row counts, summed up,
are where their slots begin. Then the rows are exchanged once, by run, and sorted in it.

Defined cases: a null text has no bytes and size 1; rows alike in text and id share a key and are
not parted; an empty table gives an empty result; input columns named like a computed one are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, staged

OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
KEY_BYTES = 16


def row_key(text: str, row_id: str) -> Column:
    """The 16-byte key of a row, in an order that only its contents decide."""
    eight = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    return F.concat(eight(F.xxhash64(F.lit(1), F.col(text))), eight(F.xxhash64(F.lit(2), F.col(row_id).cast("string"), F.col(text))))


def _as_keys(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=f"S{KEY_BYTES}")


def _histogram(keyed: DataFrame, probes: list[bytes]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each probe (ascending) over all partitions."""
    cuts = np.array(probes, dtype=f"S{KEY_BYTES}")

    def count(batches):
        size, rows = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
        for b in batches:
            if b.num_rows:
                # numpy strings ignore zero bytes at their end, on both sides alike
                k = np.searchsorted(cuts, _as_keys(b.column("key")), "right")
                np.add.at(size, k, b.column("size").to_numpy())
                rows += np.bincount(k, minlength=len(rows))
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({"at": at, "size": size[at], "rows": rows[at]})

    got = keyed.select("key", "size").mapInArrow(count, "at bigint, size bigint, rows bigint").groupBy("at").agg(F.sum("size"), F.sum("rows")).collect()
    size, rows = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
    for at, s, r in got:
        size[at], rows[at] = s, r
    return np.cumsum(size).tolist()[:-1], np.cumsum(rows).tolist()[:-1]


def splitters(keyed: DataFrame, n_shards: int, runs: int, tolerance: float, fan: int = 32) -> tuple[list[bytes], list[int], list[int]]:
    """Keys that begin runs 1.. (shards begin at every ``runs``-th), with the rows before each run.

    Shard boundaries are refined to ``tolerance`` of a shard's bytes; boundaries between the runs
    of one shard are the nearest of the keys probed first. At most n_shards * fan probes a round.
    """
    top = 1 << (8 * KEY_BYTES)
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    want = [total[0] * j / n_shards for j in range(1, n_shards)]
    known: dict[int, tuple[int, int]] = {0: (0, 0), top: (int(total[0]), int(total[1]))}
    probes = sorted({top * k // (n_shards * max(fan, 4 * runs)) for k in range(1, n_shards * max(fan, 4 * runs))})
    slack = tolerance * total[0] / n_shards
    while probes and total[1]:  # a round leaves 1 / fan of an interval, so the keys end it
        size, rows = _histogram(keyed, [p.to_bytes(KEY_BYTES, "big") for p in probes])
        known |= {p: (s, r) for p, s, r in zip(probes, size, rows, strict=True)}
        keys = sorted(known)
        below = np.array([known[k][0] for k in keys])
        probes = set()
        for w in want:
            j = int(np.searchsorted(below, w, "right")) - 1
            lo, hi = keys[j], keys[min(j + 1, len(keys) - 1)]
            if min(abs(known[lo][0] - w), abs(known[hi][0] - w)) > slack and known[hi][1] - known[lo][1] > 1 and hi - lo > 1:
                probes |= {lo + (hi - lo) * k // fan for k in range(1, fan)} - {lo, hi}
        probes = sorted(probes)
    keys = sorted(known)[:-1]
    below = np.array([known[k][0] for k in keys])
    nearest = lambda w: keys[int(np.argmin(np.abs(below - w)))]
    shard_cuts = [0, *(nearest(w) for w in want), top]
    cuts, shard_of = [], []
    for s in range(n_shards):
        lo, hi = shard_cuts[s], shard_cuts[s + 1]
        a, b = known[lo][0], known[hi][0]
        inner = sorted({nearest(a + (b - a) * k / runs) for k in range(1, runs)} - {lo})
        for c in [lo, *(c for c in inner if lo < c < hi)]:
            if hi > lo:
                cuts.append(c)
                shard_of.append(s)
    begin = [known[c][1] - known[shard_cuts[s]][1] for c, s in zip(cuts, shard_of, strict=True)]
    return [c.to_bytes(KEY_BYTES, "big") for c in cuts[1:]], shard_of, begin


def shard(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.002, run_bytes: int = 8 << 20, most_runs: int = 256, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` with size, text_crc32, law ("bytes"), shard, slot (gapless from 0 in its shard) and grown_shard."""
    docs = fresh(docs, *OUT)
    sized = docs.withColumns({"size": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1, "__tw_key": row_key(text, row_id)})
    keyed = staged(sized.select(F.col("__tw_key").alias("key"), "size"), "keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    runs = max(8, min(most_runs, -(-total // (n_shards * run_bytes))))
    cuts, shard_of, begin = splitters(keyed, n_shards, runs, tolerance)
    table = np.array(cuts, dtype=f"S{KEY_BYTES}")

    @F.pandas_udf("int")
    def run_of(key):
        return __import__("pandas").Series(np.searchsorted(table, np.array(key.to_list(), dtype=f"S{KEY_BYTES}"), "right").astype(np.int32)) if len(key) else key.astype("int32")

    shards, begins = F.array(*map(F.lit, shard_of or [0])), F.array(*[F.lit(b).cast("long") for b in begin or [0]])
    # sort by key alone: rows of one key are alike in text and id
    ranked = sized.withColumn("__tw_run", run_of("__tw_key")).withColumn("__tw_at", F.expr("row_number() OVER (PARTITION BY __tw_run ORDER BY __tw_key)"))
    return ranked.select(
        *docs.columns, "size", F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.get(shards, F.col("__tw_run")).alias("shard"), (F.get(begins, F.col("__tw_run")) + F.col("__tw_at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
