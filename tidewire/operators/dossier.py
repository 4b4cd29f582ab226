"""The dossier of one week: map of the most central actors, community cards, actors of a topic; and the status of a cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import edges as E
from . import graph, maps
from .tables import staged


def topic_actors(metrics: DataFrame, actors: DataFrame, by: str = "pagerank", top: int = 5) -> DataFrame:
    """(window_start, scope, who, value, rank): the ``top`` actors of each week and topic by a metric of the topic's own graph."""
    m = metrics.where(F.col("metric") == by).withColumn("rank", F.expr("row_number() OVER (PARTITION BY window_start, scope ORDER BY round(value, 9) DESC, actor_id)")).where(F.col("rank") <= top)
    return m.join(actors.select("actor_id", "handle"), "actor_id", "left").select("window_start", "scope", F.coalesce("handle", F.col("actor_id").cast("string")).alias("who"), "value", "rank")


def community_cards(communities: DataFrame, partition: DataFrame, positions: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``communities`` with axis, n_axis and axis2, the mean places of their placed members, and terms, best first.

    ``positions`` has (actor_id, dim, score), dimensions 1 and 2 in use; ``terms`` (community_id, term, lift).
    A community without placed members has null axes and n_axis 0; one without terms an empty list.
    """
    on = lambda n: F.when(F.col("dim") == n, F.col("score"))
    mean = partition.join(positions, "actor_id").groupBy("community_id").agg(F.avg(on(1)).alias("axis"), F.count(on(1)).alias("n_axis"), F.avg(on(2)).alias("axis2"))
    out = communities.join(mean, "community_id", "left").withColumn("n_axis", F.coalesce("n_axis", F.lit(0)))
    if terms is None:
        return out
    best = terms.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("lift")).alias("k"), "term"))), lambda x: x["term"]).alias("terms"))
    return out.join(best, "community_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def network_map(edges: DataFrame, rank: DataFrame, top: int = 60, least: int = 2, alpha: float | None = None) -> dict[str, DataFrame]:
    """Nodes, links and a summary of the picture of one week's ``top`` actors by ``rank`` (actor_id, value).

    A link is an audience in common, of ``least`` senders or more, and the picture shows their
    skeleton at ``alpha`` or the step whose mean degree reads best. Actors without a link have no
    place. The summary sets beside it the direct edges between these actors, their weight, and its
    share of the week's. All but the audiences is bounded by ``top``.
    """
    chosen = staged(rank.select("actor_id", "value").orderBy(F.desc(F.round("value", 9)), "actor_id").limit(top), "chosen")
    heard = edges.join(F.broadcast(chosen.select(F.col("actor_id").alias("dst"))), "dst", "left_semi").select("dst", "src").distinct()
    audience = heard.groupBy(F.col("dst").alias("actor_id")).agg(F.count(F.lit(1)).alias("audience"))
    x, y = heard.select(F.col("dst").alias("a"), "src"), heard.select(F.col("dst").alias("b"), "src")
    links = x.join(y, "src").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") >= least)
    alphas = staged(graph.disparity(links), "alphas")
    cut = graph.skeleton(alphas).where("chosen").select("alpha_cut") if alpha is None else chosen.sparkSession.range(1).select(F.lit(alpha).alias("alpha_cut"))
    kept = alphas.join(F.broadcast(cut)).where("alpha < alpha_cut OR alpha_cut = 1.0").select("a", "b", "w", "alpha_cut")
    linked = kept.select(F.explode(F.array("a", "b")).alias("actor_id")).distinct()
    direct = E.within(edges, chosen).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    one = lambda df, *cols: df.agg(*cols)
    n = one(chosen, F.count(F.lit(1)).alias("actors"))
    s = n.join(F.broadcast(one(alphas, F.count(F.lit(1)).alias("links_all")))).join(F.broadcast(one(kept, F.count(F.lit(1)).alias("links"), F.max("alpha_cut").alias("alpha"))))
    s = s.join(F.broadcast(one(linked, F.count(F.lit(1)).alias("linked")))).join(F.broadcast(one(direct, F.count(F.lit(1)).alias("direct_edges"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("direct_weight")))).join(F.broadcast(one(edges, F.sum("weight").alias("whole"))))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    summary = s.select("actors", "links_all", "links", "alpha", (F.col("actors") - F.col("linked")).alias("loose"), ratio(2 * F.col("links"), F.col("actors")).alias("mean_degree"), "direct_edges", "direct_weight", ratio(F.col("direct_weight"), F.col("whole")).alias("weight_share"))
    nodes = chosen.join(audience, "actor_id", "left").withColumn("audience", F.coalesce("audience", F.lit(0))).join(maps.layout(kept), "actor_id", "left")
    return {"nodes": nodes, "links": kept.drop("alpha_cut"), "summary": summary}


def status(interactions: DataFrame, actors: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(section, item, n): what a cut by labels, or all, holds: actors by tier, edges by kind, posts by label, days of the period."""
    i = interactions if labels is None else interactions.where(F.col("label").isin(labels))
    ends = i.select(F.explode(F.array("src", "dst")).alias("actor_id")).distinct()
    tier = actors.join(ends, "actor_id", "left_semi").groupBy(F.lit("tier").alias("section"), F.col("tier").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    kind = i.groupBy(F.lit("kind").alias("section"), F.col("kind").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    label = i.groupBy(F.lit("label").alias("section"), F.col("label").alias("item")).agg(F.count_distinct("post_id").alias("n"))
    days = i.agg(F.date_diff(F.max("occurred_at"), F.min("occurred_at")).cast("bigint").alias("n")).select(F.lit("period").alias("section"), F.lit("days").alias("item"), "n").where("n IS NOT NULL")
    return tier.unionByName(kind).unionByName(label).unionByName(days)


def label_volume(interactions: DataFrame, runs: DataFrame) -> DataFrame:
    """(window_start, label, posts, runs, share): posts of each week and label, by how many runs, and their share of the week."""
    n = interactions.groupBy("window_start", "label").agg(F.count_distinct("post_id").alias("posts"))
    r = runs.groupBy("label").agg(F.count_distinct("run_id").alias("runs"))
    return n.join(r, "label", "left").select("window_start", "label", "posts", F.coalesce("runs", F.lit(0)).alias("runs"), F.expr("posts / sum(posts) OVER (PARTITION BY window_start)").alias("share"))
