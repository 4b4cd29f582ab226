"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are laid end to end (in the order of a hash) and cut into blocks of equal
bytes. With weight ``w``, a source's block k is released at slot floor((k - 1) / w) and due at slot
ceil(k / w); in each slot the released block with the earliest deadline goes next. As the weights
add up to one, every block meets its deadline and no source is ever a whole block off its share.

Weights are exact fractions and are not rounded: the driver deals every block once (one step of a
heap a block of 64 KB) and sends the slots by broadcast, 8 bytes a block. When a source runs out, a
new phase begins with the weights of the others scaled up; there are at most as many phases as
sources. No row is dropped or repeated. With ``period`` the weights are rounded to whole parts of it.

Ranks within a source come from two levels of sums (buckets of a hash, then rows in a bucket), so
that a source with a third of all rows is spread over all tasks.

Defined cases: null sources are a source of their own; a null text has no bytes and takes one; a
source without a target weight is an error; documents alike in id and text are in any order;
an empty table gives an empty result; input columns named like a computed one are replaced.
"""

from __future__ import annotations

import heapq
import itertools
import math
from array import array
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, staged

OUT = ("block", "weight", "slot", "seq")
#: Blocks of a source whose slots go in one row of the broadcast.
CHUNK = 4096


def shares(weights: dict, period: int) -> dict:
    """Whole parts of ``period``, one at least, nearest to the weights (largest remainders first)."""
    total = sum(weights.values())
    exact = {s: w * period / total for s, w in weights.items()}
    parts = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (parts[s] - exact[s], str(s)))
    k = 0
    while (left := period - sum(parts.values())) != 0:
        s = order[k % len(order)] if left > 0 else max(parts, key=lambda s: (parts[s] - exact[s], parts[s], str(s)))
        parts[s] += 1 if left > 0 else -1
        k += 1
    return parts


def dealt(weights: dict):
    """The source of each slot without end, for whole-number weights: earliest deadline first among released blocks, ties by source."""
    names = sorted(weights, key=lambda s: (s is not None, str(s)))
    w = [weights[s] for s in names]
    total = sum(w)
    waiting, ready, t = [(0, i, 1) for i in range(len(names))], [], 0
    heapq.heapify(waiting)
    while True:
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-k * total // w[i]), i, k))
        d, i, k = heapq.heappop(ready)
        assert d > t
        yield names[i]
        heapq.heappush(waiting, (k * total // w[i], i, k + 1))
        t += 1


def one_period(parts: dict, period: int) -> list:
    """The source of each slot of a period."""
    return list(itertools.islice(dealt(parts), period))


def whole(weights: dict) -> dict:
    """Whole numbers in exactly the proportions of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(f.denominator for f in exact.values())) if exact else 1
    return {s: int(f * common) for s, f in exact.items()}


def schedule(blocks: dict, weights: dict) -> dict:
    """The slots of each source's blocks, in order; a source of weight zero waits until the others have run out."""
    left, slot = {s: n for s, n in blocks.items() if n}, 0
    out = {s: array("q") for s in left}
    while left:
        live = {s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1)
        for s in dealt(live):
            out[s].append(slot)
            slot += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
    return out


def mix(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, block_bytes: int = 1 << 16, period: int | None = None, source: str = "source", text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` with block (of its source, from 0), weight (target), slot (of the block in the mix) and seq (byte at which it begins in the block).

    Ordered by (slot, seq, row id) the rows are the mix. Without ``weights`` a source weighs its bytes to
    the power ``alpha``. The number of sources must be at most ``period``, where it is given.
    """
    docs = fresh(docs, *OUT)
    spark = docs.sparkSession
    size = F.greatest(F.coalesce(F.octet_length(F.col(text)), F.lit(0)), F.lit(1)).cast("long")
    order = F.xxhash64(F.lit(3), F.col(row_id).cast("string"), F.col(text))
    sized = docs.withColumns({"__tw_size": size, "__tw_hash": order, "__tw_source": F.col(source).cast("string")})
    rows = staged(sized.select("__tw_source", "__tw_hash", "__tw_size"), "sizes")
    n_buckets = max(64, min(1 << 16, rows.count() // 4096))
    bucket = F.pmod(F.shiftrightunsigned("__tw_hash", 20), F.lit(n_buckets))
    counts = staged(rows.groupBy("__tw_source", bucket.alias("__tw_bucket")).agg(F.sum("__tw_size").alias("bytes")), "buckets")
    bases = counts.selectExpr("__tw_source AS s", "__tw_bucket AS b", "sum(bytes) OVER (PARTITION BY __tw_source ORDER BY __tw_bucket) - bytes AS base")
    totals = {s: n for s, n in counts.groupBy("__tw_source").agg(F.sum("bytes")).collect()}  # noqa: C416
    if period is not None and len(totals) > period:
        raise ValueError(f"{len(totals)} sources need a period of as many slots at least")
    target = {s: float(n) ** alpha for s, n in totals.items()} if weights is None else {s: weights[s] for s in totals}
    parts = whole(target) if period is None or not target else shares(target, period)
    scale = sum(parts.values()) or 1
    plan = schedule({s: -(-n // block_bytes) for s, n in totals.items()}, parts)
    steps = [(s, k, at[k * CHUNK : (k + 1) * CHUNK].tolist(), parts[s] / scale) for s, at in plan.items() for k in range(-(-len(at) // CHUNK))]
    schema = pa.schema([("s", pa.string()), ("chunk", pa.int64()), ("at", pa.list_(pa.int64())), ("w", pa.float64())])
    table = spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, x, strict=True)) for x in steps], schema))  # Python rows would start a second family of workers
    in_bucket = "PARTITION BY __tw_source, __tw_bucket ORDER BY __tw_hash ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    placed = sized.withColumn("__tw_bucket", bucket).withColumn("__tw_in", F.expr(f"sum(__tw_size) OVER ({in_bucket}) - __tw_size"))
    placed = placed.join(bases, F.col("__tw_source").eqNullSafe(F.col("s")) & (F.col("__tw_bucket") == F.col("b"))).withColumn("__tw_byte", F.col("base") + F.col("__tw_in")).drop("s", "b", "base")
    placed = placed.withColumns({"__tw_block": F.expr(f"__tw_byte div {block_bytes}"), "__tw_seq": F.expr(f"__tw_byte % {block_bytes}")})
    out = placed.join(F.broadcast(table), F.col("__tw_source").eqNullSafe(F.col("s")) & (F.expr(f"__tw_block div {CHUNK}") == F.col("chunk")))
    slot = F.get("at", F.expr(f"cast(__tw_block % {CHUNK} AS int)"))
    return out.select(*[F.col(c) for c in docs.columns], F.col("__tw_block").alias("block"), F.col("w").alias("weight"), slot.alias("slot"), F.col("__tw_seq").alias("seq"))


def mixed(docs: DataFrame, parts: int | None = None, **options) -> DataFrame:
    """The columns of ``docs``, its rows in the order of the mix from the first partition to the last."""
    out = mix(docs, **options)
    key = ("slot", "seq", "doc_id")
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, *key).sortWithinPartitions(*key).select(*[c for c in docs.columns if c in out.columns])
