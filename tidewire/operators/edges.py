"""Weekly edges, their views, and the plain aggregations over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scope import VIEWS, topic_scope


def aggregate(interactions: DataFrame, labels: list[str] | None = None, window: str | None = None) -> DataFrame:
    """(window_start, scope, src, dst, kind, weight = count) of a week or all weeks, for all or some labels."""
    df = interactions
    if window is not None:
        df = df.where(F.col("window_start") == F.lit(window).cast("date"))
    if labels:
        df = df.where(F.col("label").isin(labels))
    return df.groupBy("window_start", F.lit(topic_scope(labels or [])).alias("scope"), "src", "dst", "kind").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def aggregate_by_topic(interactions: DataFrame) -> DataFrame:
    """Edges of the scope ``all`` and of each label's own, in one pass."""
    scopes = F.explode(F.array(F.lit("all"), F.concat(F.lit("topic:"), F.col("label"))))
    return interactions.withColumn("scope", scopes).groupBy("window_start", "scope", "src", "dst", "kind").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def weight_of(view: str) -> Column:
    out = F.lit(None).cast("double")
    for kind, w in VIEWS[view].items():
        out = F.when(F.col("kind") == kind, F.lit(w)).otherwise(out)
    return out


def view_edges(edge_window: DataFrame, view: str = "amp") -> DataFrame:
    """(window_start, src, dst, weight): parallel kinds merged with the view's weights."""
    kinds = edge_window.where(F.col("kind").isin(list(VIEWS[view])))
    return kinds.groupBy("window_start", "src", "dst").agg(F.sum(F.col("weight") * weight_of(view)).alias("weight"))


def ends(edges: DataFrame, *more: str) -> DataFrame:
    """Both ends of each edge: (window_start, actor_id, other, weight, out)."""
    both = F.explode(F.array(
        F.struct(F.col("src").alias("actor_id"), F.col("dst").alias("other"), F.lit(True).alias("out")),
        F.struct(F.col("dst").alias("actor_id"), F.col("src").alias("other"), F.lit(False).alias("out")),
    ))
    return edges.select("window_start", "weight", *more, both.alias("e")).select("window_start", "e.actor_id", "e.other", "e.out", "weight", *more)


def strengths(edges: DataFrame) -> DataFrame:
    """(window_start, actor_id, in_strength, out_strength)."""
    part = lambda out: F.sum(F.when(F.col("out") == out, F.col("weight")).otherwise(0.0))
    return ends(edges).groupBy("window_start", "actor_id").agg(part(False).alias("in_strength"), part(True).alias("out_strength"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select("window_start", F.col("src").alias("actor_id")).union(edges.select("window_start", "dst")).distinct()


def concentration(edges: DataFrame, alert: float = 0.05) -> DataFrame:
    """Per week: share of all weight that the strongest sender, and the five strongest, hold."""
    out = edges.groupBy("window_start", "src").agg(F.sum("weight").alias("s"))
    ranked = out.withColumn("r", F.expr("row_number() OVER (PARTITION BY window_start ORDER BY s DESC, src)"))
    top = lambda n: F.sum(F.when(F.col("r") <= n, F.col("s")).otherwise(0.0)) / F.sum("s")
    return ranked.groupBy("window_start").agg(top(1).alias("top1_share"), top(5).alias("top5_share")).withColumn("alert", F.col("top1_share") >= alert)


def topics_by_volume(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("window_start", "label").agg(F.count_distinct("post_id").alias("posts"))


def heaviest(edges: DataFrame, n: int) -> DataFrame:
    return edges.orderBy(F.desc("weight"), "src", "dst", "window_start").limit(n)


def within(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges both of whose ends are in ``members`` (actor_id): two semi-joins."""
    m = members.select("actor_id").distinct()
    half = edges.join(m, edges["src"] == m["actor_id"], "left_semi")
    return half.join(m, half["dst"] == m["actor_id"], "left_semi")


def kind_mix(edge_window: DataFrame) -> DataFrame:
    """Weight and share of each kind in each week."""
    by = edge_window.groupBy("window_start", "kind").agg(F.sum("weight").alias("weight"))
    return by.withColumn("share", F.expr("weight / sum(weight) OVER (PARTITION BY window_start)"))
