"""Graph measures over weekly edges (window_start, src, dst, weight)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edges import ends, vertices
from .tables import staged

MIN_STRENGTH = 2.0


def core(edges: DataFrame, least: float = MIN_STRENGTH, most_rounds: int = 100) -> DataFrame:
    """Edges left when actors whose strength (in and out) is under ``least`` are dropped again and again.

    Sums are compared at nine decimals. Each round is written, so lineage stays short.
    """
    now = staged(edges, "core")
    n = now.count()
    for _ in range(most_rounds):
        keep = ends(now).groupBy("window_start", "actor_id").agg(F.sum("weight").alias("s")).where(F.round("s", 9) >= least)
        k = keep.select(F.col("window_start").alias("kw"), "actor_id")
        half = now.join(k, (F.col("window_start") == F.col("kw")) & (F.col("src") == F.col("actor_id")), "left_semi")
        now = staged(half.join(k, (F.col("window_start") == F.col("kw")) & (F.col("dst") == F.col("actor_id")), "left_semi"), "core")
        m = now.count()
        if m == n:
            return now
        n = m
    return now


#: Weeks with at most so many edges are ranked in one task each (about 1 GB of arrays at most).
TASK_EDGES = 20_000_000


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-12, task_edges: int = TASK_EDGES) -> DataFrame:
    """(window_start, actor_id, pagerank): weighted, mass of actors without out-edges spread evenly; sums to one a week.

    A week whose edges fit one task is iterated there, all weeks side by side; if any is larger, the
    rounds are joins.
    """
    most = edges.groupBy("window_start").count().agg(F.max("count")).first()[0] or 0
    if most > task_edges:
        return _pagerank_joins(edges, damping, rounds, max(tolerance, 1e-9))

    def run(key, t):
        ids, e = np.unique(np.concatenate([t["src"], t["dst"]]), return_inverse=True)
        s, d, w = e[: len(t)], e[len(t) :], t["weight"].to_numpy(float)
        n = len(ids)
        out = np.bincount(s, w, n)
        p = w / out[s]
        r = np.full(n, 1 / n)
        for _ in range(rounds):
            new = (1 - damping) / n + damping * (np.bincount(d, r[s] * p, n) + r[out == 0].sum() / n)
            moved, r = np.abs(new - r).max(), new
            if moved < tolerance:
                break
        return pd.DataFrame({"window_start": key[0], "actor_id": ids, "pagerank": r})

    return edges.select("window_start", "src", "dst", "weight").groupBy("window_start").applyInPandas(run, "window_start date, actor_id bigint, pagerank double")


def _pagerank_joins(edges: DataFrame, damping: float, rounds: int, tolerance: float) -> DataFrame:
    v = staged(vertices(edges), "vertices")
    count = v.groupBy("window_start").agg(F.count(F.lit(1)).alias("n"))
    e = staged(edges.withColumn("p", F.expr("weight / sum(weight) OVER (PARTITION BY window_start, src)")).select("window_start", "src", "dst", "p"), "transitions")
    sink = v.join(e.select("window_start", F.col("src").alias("actor_id")).distinct(), ["window_start", "actor_id"], "left_anti").withColumn("sink", F.lit(True))
    rank = staged(v.join(count, "window_start").join(sink, ["window_start", "actor_id"], "left").select("window_start", "actor_id", "n", F.coalesce("sink", F.lit(False)).alias("sink"), (1.0 / F.col("n")).alias("r")), "rank")
    for _ in range(rounds):
        flow = e.join(rank.select("window_start", F.col("actor_id").alias("src"), "r"), ["window_start", "src"]).groupBy("window_start", F.col("dst").alias("actor_id")).agg(F.sum(F.col("r") * F.col("p")).alias("got"))
        lost = rank.groupBy("window_start").agg(F.sum(F.when(F.col("sink"), F.col("r")).otherwise(0.0)).alias("lost"))
        new = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))
        nxt = staged(rank.join(flow, ["window_start", "actor_id"], "left").join(lost, "window_start").select("window_start", "actor_id", "n", "sink", new.alias("r"), F.abs(new - F.col("r")).alias("d")), "rank")
        moved = nxt.agg(F.max("d")).first()[0] or 0.0
        rank = nxt.drop("d")
        if moved < tolerance:
            break
    return rank.select("window_start", "actor_id", F.col("r").alias("pagerank"))


def ei_index(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(window_start, actor_id, community_id, strength, ei): (external - internal) / all, 0 where there is nothing."""
    c = lambda a, b: partition.select(F.col("actor_id").alias(a), F.col("community_id").alias(b))
    both = ends(edges).join(c("actor_id", "community_id"), "actor_id").join(c("other", "oc"), "other")
    ext = F.sum(F.when(F.col("community_id") != F.col("oc"), F.col("weight")).otherwise(0.0))
    tot = F.sum("weight")
    return both.groupBy("window_start", "actor_id", "community_id").agg(tot.alias("strength"), F.coalesce(F.try_divide(2 * ext - tot, tot), F.lit(0.0)).alias("ei"))


def community_summary(ei: DataFrame, least: float = MIN_STRENGTH) -> DataFrame:
    """Size, mean E-I, and mean E-I of the actors whose strength gave them a choice."""
    choice = F.round("strength", 9) >= least
    return ei.groupBy("window_start", "community_id").agg(
        F.count(F.lit(1)).alias("size"), F.avg("ei").alias("ei_mean"), F.avg(F.when(choice, F.col("ei"))).alias("ei_choice"), F.count_if(choice).alias("choice_actors")
    )


def components(edges: DataFrame) -> DataFrame:
    """(window_start, actor_id, component = least id): large-star and small-star rounds until nothing moves."""
    e = staged(edges.where("src <> dst").select("window_start", F.greatest("src", "dst").alias("b"), F.least("src", "dst").alias("a")).distinct(), "cc")
    before = None
    while True:
        both = e.select("window_start", F.col("b").alias("u"), F.col("a").alias("v")).union(e.select("window_start", "a", "b"))
        low = both.groupBy("window_start", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, ["window_start", "u"]).where("v > u AND v <> m").select("window_start", F.col("v").alias("b"), F.col("m").alias("a")).distinct()
        low = large.groupBy("window_start", F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.withColumnRenamed("b", "u").join(low, ["window_start", "u"])
        e = staged(small.where("m <> a").select("window_start", F.col("a").alias("b"), F.col("m").alias("a")).union(low.select("window_start", F.col("u"), F.col("m"))).distinct(), "cc")
        now = e.agg(F.count(F.lit(1)), *[F.sum(F.col(c).cast("decimal(38,0)")) for c in "ab"]).first()
        if now == before:
            break
        before = now
    v = vertices(edges)
    return v.join(e.select("window_start", F.col("b").alias("actor_id"), "a"), ["window_start", "actor_id"], "left").select("window_start", "actor_id", F.coalesce("a", "actor_id").alias("component"))


def component_stats(parts: DataFrame, trivial: int = 3) -> DataFrame:
    """Per week: components, size of the largest, its share, and how many are trivial."""
    size = parts.groupBy("window_start", "component").agg(F.count(F.lit(1)).alias("n"))
    return size.groupBy("window_start").agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), (F.max("n") / F.sum("n")).alias("core_share"), F.count_if(F.col("n") <= trivial).alias("trivial"))


def import_partition(actors: DataFrame, partition: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels of another scope for ``actors`` (window_start, actor_id), and the number of actors without one."""
    have = actors.join(partition.select("actor_id", "community_id"), "actor_id")
    lack = actors.join(partition, "actor_id", "left_anti").groupBy("window_start").agg(F.count(F.lit(1)).alias("without"))
    return have, lack


def match_communities(a: DataFrame, b: DataFrame, noise: float = 0.01) -> DataFrame:
    """For each community of ``a`` the one of ``b`` that it shares most actors with (ties: the lower id)."""
    na, nb = a.groupBy("community_id").agg(F.count(F.lit(1)).alias("n_a")), b.groupBy(F.col("community_id").alias("b")).agg(F.count(F.lit(1)).alias("n_b"))
    both = a.join(b.select("actor_id", F.col("community_id").alias("b")), "actor_id").groupBy("community_id", "b").agg(F.count(F.lit(1)).alias("common"))
    best = both.withColumn("r", F.expr("row_number() OVER (PARTITION BY community_id ORDER BY common DESC, b)")).where("r = 1").join(nb, "b")
    out = na.join(best, "community_id", "left").select(F.col("community_id").alias("a"), "b", "n_a", "n_b", F.coalesce("common", F.lit(0)).alias("common"))
    share = F.col("common") / F.col("n_a")
    return out.withColumns({"share_a": share, "share_b": F.col("common") / F.col("n_b"), "jaccard": F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common")), "noise": share < noise})


def renumber(partition: DataFrame) -> DataFrame:
    """Communities numbered by size, largest first; ties by their least actor."""
    size = partition.groupBy("community_id").agg(F.count(F.lit(1)).alias("n"), F.min("actor_id").alias("least"))
    new = size.select("community_id", (F.expr("row_number() OVER (ORDER BY n DESC, least)") - 1).alias("new_id"))
    return partition.join(new, "community_id").select("actor_id", F.col("new_id").alias("community_id"))


def shared_audience(edges: DataFrame, top: int = 60, least: int = 2) -> DataFrame:
    """(a, b, common): pairs of the ``top`` receivers with ``least`` senders in common or more."""
    best = edges.groupBy("dst").agg(F.sum("weight").alias("s")).orderBy(F.desc("s"), "dst").limit(top)
    aud = edges.join(F.broadcast(best.select("dst")), "dst", "left_semi").select("dst", "src").distinct()
    x, y = aud.select(F.col("dst").alias("a"), "src"), aud.select(F.col("dst").alias("b"), "src")
    return x.join(y, "src").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= least)


def disparity(links: DataFrame) -> DataFrame:
    """(a, b, w, alpha): the lesser of (1 - w/s)^(k-1) over both ends; 0 where an end has one link (Serrano et al. 2009)."""
    each = links.select(F.col("a").alias("v"), "w").union(links.select("b", "w")).groupBy("v").agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("k"))
    x, y = each.select(F.col("v").alias("a"), F.col("s").alias("sa"), F.col("k").alias("ka")), each.select(F.col("v").alias("b"), F.col("s").alias("sb"), F.col("k").alias("kb"))
    p = lambda s, k: F.when(F.col(k) <= 1, 0.0).otherwise(F.pow(1 - F.col("w") / F.col(s), F.col(k) - 1))
    return links.join(x, "a").join(y, "b").select("a", "b", "w", F.least(p("sa", "ka"), p("sb", "kb")).alias("alpha"))


LADDER = (0.01, 0.02, 0.05, 0.1, 0.15, 0.25, 0.4, 0.6, 1.0)


def skeleton(alphas: DataFrame, degree: float = 3.5) -> DataFrame:
    """(alpha_cut, links, nodes, mean_degree) of each step of the ladder, and which one is chosen."""
    steps = F.explode(F.array(*map(F.lit, LADDER)))
    at = alphas.select("a", "b", "alpha", steps.alias("alpha_cut")).where((F.col("alpha") < F.col("alpha_cut")) | (F.col("alpha_cut") == 1.0))
    n = at.select("alpha_cut", F.explode(F.array("a", "b")).alias("v")).groupBy("alpha_cut").agg(F.count_distinct("v").alias("nodes"))
    d = at.groupBy("alpha_cut").agg(F.count(F.lit(1)).alias("links")).join(n, "alpha_cut").withColumn("mean_degree", 2 * F.col("links") / F.col("nodes"))
    return d.withColumn("chosen", F.expr("row_number() OVER (ORDER BY abs(mean_degree - %r), alpha_cut)" % degree) == 1)


def coamplification(interactions: DataFrame, seconds: int = 60, most: int = 50, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pairs of accounts that repost one actor within ``seconds`` of each other, ``least`` times or more.

    Groups of over ``most`` events on one target in a week are viral, not coordinated: left out, and
    counted in the second result. Times fall into buckets as long as the window, and each event
    meets those of its own and the next bucket, so the range join is an equi-join.
    """
    r = interactions.where("kind = 'repost'").select("window_start", "dst", "src", F.unix_timestamp("occurred_at").alias("t"), "post_id")
    size = r.groupBy("window_start", "dst").agg(F.count(F.lit(1)).alias("n"))
    ok = r.join(size.where(F.col("n") <= most), ["window_start", "dst"], "left_semi").withColumn("k", F.expr(f"t div {max(seconds, 1)}"))
    x = ok.select("window_start", "dst", F.col("src").alias("s1"), F.col("t").alias("t1"), F.col("post_id").alias("p1"), F.explode(F.array(F.col("k"), F.col("k") + 1)).alias("k"))
    y = ok.select("window_start", "dst", F.col("src").alias("s2"), F.col("t").alias("t2"), F.col("post_id").alias("p2"), "k")
    later = (F.col("t2") > F.col("t1")) | ((F.col("t2") == F.col("t1")) & (F.col("p2") > F.col("p1")))
    near = x.join(y, ["window_start", "dst", "k"]).where(later & (F.col("s1") != F.col("s2")) & (F.col("t2") - F.col("t1") <= seconds))
    pairs = near.groupBy("window_start", F.least("s1", "s2").alias("a"), F.greatest("s1", "s2").alias("b")).agg(F.count(F.lit(1)).alias("times"), F.sort_array(F.collect_list(F.col("t2") - F.col("t1"))).alias("gaps"))
    cut = size.where(F.col("n") > most).groupBy("window_start").agg(F.count(F.lit(1)).alias("viral_groups"))
    return pairs.where(F.col("times") >= least), cut


def coamplification_clusters(pairs: DataFrame) -> DataFrame:
    """Connected accounts: (window_start, component, accounts, n, times, median gap), upper median."""
    parts = components(pairs.select("window_start", F.col("a").alias("src"), F.col("b").alias("dst")))
    of = parts.groupBy("window_start", "component").agg(F.sort_array(F.collect_list("actor_id")).alias("accounts"), F.count(F.lit(1)).alias("n"))
    gaps = pairs.join(parts.withColumnRenamed("actor_id", "a"), ["window_start", "a"]).groupBy("window_start", "component").agg(F.sum("times").alias("times"), F.sort_array(F.flatten(F.collect_list("gaps"))).alias("g"))
    return of.join(gaps, ["window_start", "component"]).select("window_start", "component", "accounts", "n", "times", F.get("g", F.expr("size(g) div 2")).alias("median_gap"))
