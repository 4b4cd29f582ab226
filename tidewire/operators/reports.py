"""Reports: analysis of a scope, radar, dossier, comparison, export with its manifest."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scope import Scope

from . import communities, edges, graph
from .tables import staged


def analyze(edge_window: DataFrame, scope: Scope, partition: DataFrame | None = None) -> dict[str, DataFrame]:
    """Graph, partition, tall metrics, communities and diagnostics of a scope: edges, partition, metrics, communities, stats.

    ``partition`` (window_start, actor_id, community_id) is imported as it is; without one,
    communities are detected. Betweenness comes for weeks of 20,000 actors at most.
    """
    e = staged(edges.view_edges(edge_window, scope.view), "view")
    stats = graph.component_stats(graph.components(e))
    if scope.core:
        e = graph.core(e)
    p = staged(communities.detect(e) if partition is None else partition.join(edges.vertices(e), ["window_start", "actor_id"], "left_semi"), "partition")
    two = lambda a, b: p.select("window_start", F.col("actor_id").alias(a), F.col("community_id").alias(b))
    both = edges.ends(e).join(two("actor_id", "c"), ["window_start", "actor_id"]).join(two("other", "o"), ["window_start", "other"])
    tot = F.sum("weight")
    ei = staged(both.groupBy("window_start", "actor_id", F.col("c").alias("community_id")).agg(tot.alias("strength"), ((2 * F.sum(F.when(F.col("c") != F.col("o"), F.col("weight")).otherwise(0.0)) - tot) / tot).alias("ei")), "ei")
    tall = lambda df, col: df.select("window_start", "actor_id", F.lit(col).alias("metric"), F.col(col).cast("double").alias("value"))
    s = edges.strengths(e)
    m = tall(graph.pagerank(e), "pagerank").union(tall(s, "in_strength")).union(tall(s, "out_strength")).union(tall(ei, "ei")).union(tall(communities.betweenness(e), "betweenness"))
    return {"edges": e, "partition": p, "metrics": staged(m, "metrics"), "communities": graph.community_summary(ei), "stats": stats}


def wide(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("window_start", "actor_id").pivot("metric", ["pagerank", "in_strength", "out_strength", "ei", "betweenness"]).max("value")


def radar(interactions: DataFrame, result: dict[str, DataFrame], top: int = 5) -> dict[str, DataFrame]:
    """Topics (posts, authors, concentration, spread) and communities (volume, topics, profiles) of each week."""
    by = interactions.groupBy("window_start", "label", "src").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.expr("row_number() OVER (PARTITION BY window_start, label ORDER BY n DESC, src)"))
    topics = by.groupBy("window_start", "label").agg(F.sum("n").alias("posts"), F.count(F.lit(1)).alias("authors"), (F.sum(F.when(F.col("r") <= 3, F.col("n"))) / F.sum("n")).alias("concentration"))
    p = result["partition"].withColumnRenamed("actor_id", "src")
    c = by.join(p, ["window_start", "src"], "left").groupBy("window_start", "label", "community_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("posts"))
    c = c.withColumn("inside", F.expr("sum(if(community_id IS NULL, 0, n)) OVER (PARTITION BY window_start, label)"))
    inner = F.col("community_id").isNotNull()
    share = F.try_divide(F.col("n"), F.col("inside"))
    spread = c.groupBy("window_start", "label").agg(
        F.count_if(inner & (share >= 0.05)).alias("crosses"), F.max_by("community_id", F.when(inner, F.struct("n", -F.col("community_id")))).alias("dominant"), F.max(F.when(inner, share)).alias("dominant_share"), F.sum(F.when(~inner, F.col("n")).otherwise(0)).alias("outside")
    )
    topics = topics.join(spread, ["window_start", "label"])
    cl = c.where(inner).withColumn("r", F.expr("row_number() OVER (PARTITION BY window_start, community_id ORDER BY posts DESC, label)"))
    per = cl.groupBy("window_start", "community_id").agg(F.sum("posts").alias("volume"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "label")))), lambda x: x["label"]).alias("topics"))
    prof = result["metrics"].where("metric = 'pagerank'").join(result["partition"], ["window_start", "actor_id"]).withColumn("r", F.expr("row_number() OVER (PARTITION BY window_start, community_id ORDER BY round(value, 12) DESC, actor_id)")).where("r <= 3")
    prof = prof.groupBy("window_start", "community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "actor_id"))), lambda x: x["actor_id"]).alias("profiles"))
    comm = result["communities"].join(per, ["window_start", "community_id"], "left").join(prof, ["window_start", "community_id"], "left")
    comm = comm.withColumn("volume_share", F.expr("volume / sum(volume) OVER (PARTITION BY window_start)"))
    actors = wide(result["metrics"]).withColumn("r", F.expr("row_number() OVER (PARTITION BY window_start ORDER BY round(pagerank, 12) DESC, actor_id)")).where(F.col("r") <= top)
    return {"topics": topics, "communities": comm, "actors": actors}


def summary(edge_window: DataFrame, actors: DataFrame) -> DataFrame:
    """Per week: actors, actors of each tier, edges and their weight (0 for an empty week)."""
    v = edges.vertices(edge_window).join(actors.select("actor_id", "tier"), "actor_id", "left")
    tiers = v.groupBy("window_start").agg(F.count(F.lit(1)).alias("actors"), *[F.count_if(F.col("tier") == t).alias(f"tier_{t.lower()}") for t in "ABC"])
    return tiers.join(edge_window.groupBy("window_start").agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")), "window_start", "left")


def top_actors(metrics: DataFrame, actors: DataFrame, positions: DataFrame | None = None, top: int = 25) -> DataFrame:
    """Top actors by PageRank with tier, relative rank, its change from the week before, and their place on the axis."""
    w = wide(metrics).withColumn("rank", F.expr("(row_number() OVER (PARTITION BY window_start ORDER BY round(pagerank, 12), actor_id) - 1) / greatest(count(*) OVER (PARTITION BY window_start) - 1, 1)"))
    weeks = w.select("window_start").distinct().withColumn("next", F.expr("lead(window_start) OVER (ORDER BY window_start)"))
    prev = w.join(F.broadcast(weeks), "window_start").select(F.col("next").alias("window_start"), "actor_id", F.col("rank").alias("before"))
    out = w.join(prev, ["window_start", "actor_id"], "left").withColumn("change", F.col("rank") - F.col("before")).drop("before").join(actors.select("actor_id", "handle", "tier"), "actor_id", "left")
    if positions is not None:
        out = out.join(positions.where("dim = 1").select("actor_id", F.col("score").alias("axis")), "actor_id", "left")
    return out.withColumn("r", F.expr("row_number() OVER (PARTITION BY window_start ORDER BY round(pagerank, 12) DESC, actor_id)")).where(F.col("r") <= top).drop("r")


def compare(a: DataFrame, b: DataFrame, closure_a: DataFrame, closure_b: DataFrame) -> DataFrame:
    """Communities of ``a`` matched to those of ``b``, with the change of their choice E-I where both have one."""
    m = graph.match_communities(a, b)
    ca, cb = closure_a.select(F.col("community_id").alias("a"), F.col("ei_choice").alias("ei_a")), closure_b.select(F.col("community_id").alias("b"), F.col("ei_choice").alias("ei_b"))
    return m.join(ca, "a", "left").join(cb, "b", "left").withColumn("jump", F.col("ei_b") - F.col("ei_a"))


def to_json(parts: dict[str, DataFrame], path: str | None = None, compact: bool = False) -> str:
    """Small report frames as one JSON object; written to a file if there is a path."""
    body = {k: [json.loads(x) for (x,) in df.select(F.to_json(F.struct(*df.columns))).collect()] for k, df in parts.items()}
    text = json.dumps(body, ensure_ascii=False, indent=None if compact else 2)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def write_csv(df: DataFrame, path: str, columns: list[str], order: list) -> None:
    """One UTF-8 CSV folder with a header, in a fixed order of columns and rows."""
    df.select(*columns).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def export(result: dict[str, DataFrame], edge_window: DataFrame, runs: DataFrame, days: dict[str, int], out_dir: str, published: DataFrame | None = None, core: bool = False) -> dict:
    """Actors, communities, edges and runs as CSV, and a manifest with what to beware of.

    With ``published`` (actor_id), only those actors and edges between them go out.
    """
    actors = wide(result["metrics"]).join(result["partition"], ["window_start", "actor_id"], "left")
    out_edges = edge_window
    if published is not None:
        actors, out_edges = actors.join(published, "actor_id", "left_semi"), edges.within(edge_window, published)
    write_csv(actors, f"{out_dir}/actors", ["window_start", "actor_id", "community_id", "pagerank", "in_strength", "out_strength", "ei", "betweenness"], ["window_start", F.desc("pagerank"), "actor_id"])
    write_csv(result["communities"], f"{out_dir}/communities", ["window_start", "community_id", "size", "ei_mean", "ei_choice", "choice_actors"], ["window_start", "community_id"])
    write_csv(out_edges, f"{out_dir}/edges", ["window_start", "src", "dst", "kind", "weight"], ["window_start", F.desc("weight"), "src", "dst", "kind"])
    write_csv(runs, f"{out_dir}/runs", runs.columns, runs.columns[:1])
    caveats = [f"week {w} has {n} days of 7" for w, n in sorted(days.items()) if n < 5] + ["only the core of the graph"] * core
    manifest = {"files": ["actors", "communities", "edges", "runs"], "caveats": caveats, "filtered": published is not None}
    if "://" not in out_dir:
        os.makedirs(out_dir, exist_ok=True)
        with open(f"{out_dir}/manifest.json", "w", encoding="utf-8") as f:
            json.dump(manifest, f, ensure_ascii=False, indent=2)
    return manifest
