"""Correspondence analysis of a weighted amplifier x amplified table (src, dst, weight)."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .barrier import Peers, slots
from .tables import staged

MOST_ROUNDS, TOLERANCE, SEED = 400, 1e-9, 20260914
_SCHEMA = "side string, actor_id bigint, dim int, score double, diag string"
#: Tables of at most so many cells are analysed in one task (about 100 MB of arrays).
TASK_CELLS = 2_000_000


def prune(table: DataFrame, least: int = 2, most_rounds: int = 100) -> DataFrame:
    """Rows with ``least`` columns and columns with ``least`` rows or more, until none falls away."""
    now = staged(table.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "bip")
    n = now.count()
    for _ in range(most_rounds):
        rows = now.groupBy("src").count().where(F.col("count") >= least).select("src")
        half = now.join(rows, "src", "left_semi")
        cols = half.groupBy("dst").count().where(F.col("count") >= least).select("dst")
        now = staged(half.join(cols, "dst", "left_semi"), "bip")
        m = now.count()
        if m == n:
            break
        n = m
    return now


def largest_component(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The largest connected part of the table (rows and columns are different nodes), and its coverage."""
    from .graph import components

    name = lambda side, c: F.concat(F.lit(side), F.col(c).cast("string"))
    ids = staged(table.select(F.explode(F.array(name("r", "src"), name("c", "dst"))).alias("name")).distinct().withColumn("id", F.xxhash64("name")), "names")
    e = table.select(F.lit("2000-01-03").cast("date").alias("window_start"), F.xxhash64(name("r", "src")).alias("src"), F.xxhash64(name("c", "dst")).alias("dst"))
    parts = components(e)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.orderBy(F.desc("n"), "component").limit(1)
    keep = parts.join(best, "component", "left_semi").select(F.col("actor_id").alias("id"))
    rows = ids.join(keep, "id", "left_semi").where("name LIKE 'r%'").select(F.substring("name", 2, 40).cast("long").alias("src"))
    stats = sizes.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), F.sum("n").alias("nodes")).withColumn("coverage", F.col("largest") / F.col("nodes"))
    return table.join(rows, "src", "left_semi"), stats


def total_inertia(table: DataFrame) -> DataFrame:
    """Sum of w_ij^2 / (r_i c_j) less one: the table's chi-square over its weight."""
    r, c = table.groupBy("src").agg(F.sum("weight").alias("r")), table.groupBy("dst").agg(F.sum("weight").alias("c"))
    return table.join(r, "src").join(c, "dst").agg((F.sum(F.col("weight") * F.col("weight") / (F.col("r") * F.col("c"))) - 1).alias("inertia"))


def dimensions(i: np.ndarray, j: np.ndarray, w: np.ndarray, dims: int = 2, seed: int = SEED, shape: tuple[int, int] | None = None, add: Callable[[np.ndarray], np.ndarray] = np.asarray) -> tuple[list[np.ndarray], list[np.ndarray], list[dict]]:
    """Row and column principal coordinates of each dimension, by power iteration with deflation, and how it went.

    Rows can be dealt to several tasks: each passes its own rows, the ``shape`` of those by all columns, and
    ``add``, which returns the sum of an array over the tasks. All of them then take the same steps.
    """
    n, m = shape or (int(i.max()) + 1, int(j.max()) + 1)
    total = float(add(np.array([w.sum()]))[0])
    r, c = np.bincount(i, w, n), add(np.bincount(j, w, m))
    a = w / np.sqrt(r[i] * c[j])
    forward = lambda v: np.bincount(i, a * v[j], n)
    back = lambda u: add(np.bincount(j, a * u[i], m))
    found, rows, cols, diags = [np.sqrt(c / total)], [], [], []
    inertia = float(add(np.array([(a**2).sum()]))[0] - 1)
    rng = np.random.default_rng(seed)
    for dim in range(1, dims + 1):
        v = rng.standard_normal(m)
        step, rest, ok = 0, np.inf, False
        for f in found:
            v -= f * (f @ v)
        v /= np.linalg.norm(v) or 1.0
        for step in range(1, MOST_ROUNDS + 1):  # noqa: B007
            new = back(forward(v))
            for f in found:
                new -= f * (f @ new)
            size = np.linalg.norm(new)
            if size < 1e-14:
                v, ok, rest = new, True, 0.0
                break
            new /= size
            rest, v = float(min(np.abs(new - v).max(), np.abs(new + v).max())), new
            if rest < TOLERANCE:
                ok = True
                break
        u = forward(v)
        sigma = float(np.sqrt(add(np.array([u @ u]))[0]))
        rows.append(u / np.sqrt(r / total) if sigma > 1e-12 else np.zeros(n))
        cols.append(sigma * v / np.sqrt(c / total) if sigma > 1e-12 else np.zeros(m))
        found.append(v)
        diags.append({"dim": dim, "converged": ok, "sigma": sigma, "inertia": sigma**2, "total_inertia": inertia, "share": sigma**2 / inertia if inertia > 1e-12 else 0.0, "rounds": step, "residual": rest})
    return rows, cols, diags


def positions(table: DataFrame, dims: int = 2, task_cells: int = TASK_CELLS) -> DataFrame:
    """(side, actor_id, dim, score, diag) of a table restricted to one component, written once.

    One task holds the cells of a small table. Rows of a larger one are dealt to as many tasks as run at a time,
    which keep theirs over all rounds and add up their columns' sums (a value a column and task).
    """

    def run(t: pd.DataFrame) -> pd.DataFrame:
        ri, i = np.unique(t["src"], return_inverse=True)
        ci, j = np.unique(t["dst"], return_inverse=True)
        rows, cols, diags = dimensions(i, j, t["weight"].to_numpy(float), dims)
        out = []
        for k in range(dims):
            d = json.dumps(diags[k])
            for side, ids, x in (("row", ri, rows[k]), ("col", ci, cols[k])):
                out.append(pd.DataFrame({"side": side, "actor_id": ids, "dim": k + 1, "score": x, "diag": d}))
        return pd.concat(out)

    def share(batches):
        got = pa.Table.from_batches(batches, pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("weight", pa.float64())]))
        src, dst, w = (got.column(k).to_numpy() for k in range(3))
        del got
        with Peers() as peers:
            ri, i = np.unique(src, return_inverse=True)
            ci = peers.combine(np.unique(dst), np.union1d)
            rows, cols, diags = dimensions(i, np.searchsorted(ci, dst), w, dims, shape=(len(ri), len(ci)), add=lambda x: peers.combine(x, np.add))
            first = peers.rank == 0
        for k in range(dims):
            for side, ids, x in (("row", ri, rows[k]), *[("col", ci, cols[k])] * first):
                for at in range(0, len(ids), 1 << 16):
                    some = ids[at : at + (1 << 16)]
                    same = [pa.repeat(pa.scalar(v, kind), len(some)) for v, kind in ((side, pa.string()), (k + 1, pa.int32()), (json.dumps(diags[k]), pa.string()))]
                    yield pa.RecordBatch.from_arrays([same[0], pa.array(some), same[1], pa.array(x[at : at + len(some)]), same[2]], names=["side", "actor_id", "dim", "score", "diag"])

    cells = staged(table.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double")), "cells")
    n = slots(table.sparkSession) if cells.count() > task_cells else 1
    dealt = cells.repartition(n, "src").mapInArrow(share, _SCHEMA, barrier=True) if n > 1 else cells.groupBy().applyInPandas(run, _SCHEMA)
    return staged(dealt, "positions")


def per_actor(scores: DataFrame) -> DataFrame:
    """One score an actor and dimension: that as amplified wins over that as amplifier."""
    c, r = scores.where("side = 'col'").select("actor_id", "dim", F.col("score").alias("c")), scores.where("side = 'row'").select("actor_id", "dim", F.col("score").alias("r"))
    j = c.join(r, ["actor_id", "dim"], "full_outer")
    axis = F.when(F.col("dim") == 1, "amp").otherwise(F.concat(F.lit("amp"), F.col("dim").cast("string")))
    how = F.when(F.col("c").isNotNull(), "ca-amp-v1/amplificado").otherwise("ca-amp-v1/amplifica")
    return j.select("actor_id", "dim", axis.alias("axis"), F.coalesce("c", "r").alias("score"), how.alias("method"))


def orient(scores: DataFrame, partition: DataFrame) -> DataFrame:
    """Scores negated where community 0 lies above zero, then scaled to a largest size of one."""
    mean = scores.join(partition.where("community_id = 0"), "actor_id", "left_semi").groupBy("dim").agg(F.avg("score").alias("m"))
    top = scores.groupBy("dim").agg(F.max(F.abs("score")).alias("top"))
    sign = F.when(F.col("m") > 0, -1.0).otherwise(1.0)
    return scores.join(F.broadcast(mean), "dim", "left").join(F.broadcast(top), "dim").withColumn("score", F.coalesce(F.try_divide(sign * F.col("score"), F.col("top")), F.lit(0.0))).drop("m", "top")


def agreement(scores: DataFrame, partition: DataFrame) -> DataFrame:
    """(dim, agreement): how well the sign parts the two largest communities, by the better of both ways."""
    two = partition.groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "community_id").limit(2).agg(F.min("community_id").alias("x"), F.max("community_id").alias("y"))
    s = scores.join(partition, "actor_id").join(F.broadcast(two)).where("community_id IN (x, y)")
    same = F.count_if((F.col("score") < 0) == (F.col("community_id") == F.col("x"))) / F.count(F.lit(1))
    return s.groupBy("dim").agg(F.greatest(same, 1 - same).alias("agreement"))


def summary(scores: DataFrame) -> DataFrame:
    """(dim, n, deciles, middle, lowest, highest): middle is the share of sizes under a quarter."""
    g = scores.groupBy("dim").agg(F.sort_array(F.collect_list("score")).alias("a"), F.count(F.lit(1)).alias("n"), F.avg((F.abs("score") < 0.25).cast("double")).alias("middle"), F.min_by("actor_id", F.struct("score", "actor_id")).alias("lowest"), F.max_by("actor_id", F.struct("score", "actor_id")).alias("highest"))
    deciles = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.get("a", F.least(F.size("a") - 1, F.expr("size(a)") * k / 10).cast("int")))
    return g.select("dim", "n", deciles.alias("deciles"), "middle", "lowest", "highest")


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Positions with all of the ``amp`` axes replaced by the new ones; other axes stay."""
    return old.where(~F.col("axis").startswith("amp")).unionByName(new)


def degenerate(agree: float, middle: float) -> bool:
    """The first dimension only tells two blocks apart: use the second."""
    return agree > 0.95 and middle < 0.05


def chosen_dimension(agree: DataFrame, scores: DataFrame) -> DataFrame:
    """(dim, agreement, middle) of the first dimension, ``dim`` 2 if it is degenerate; no row without scores."""
    middle = scores.where("dim = 1").groupBy("dim").agg(F.avg((F.abs("score") < 0.25).cast("double")).alias("middle"))
    two_blocks = (F.col("agreement") > 0.95) & (F.col("middle") < 0.05)
    return middle.join(agree, "dim", "left").select(F.when(two_blocks, 2).otherwise(1).alias("dim"), "agreement", "middle")
