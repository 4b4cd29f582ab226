"""Queries of the dossier, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import correspondence, dossier
from tidewire.operators import edges as E
from tidewire.sources import adapters as A

from .registry import query
from .relational import C, DISP

WEEK = "2024-01-08"
# places on two axes that both sides can state: three actors of four
PLACES = ", place AS (SELECT actor_id, 1 AS dim, (actor_id % 200) / 100.0 - 1 AS score FROM actor WHERE actor_id % 4 <> 0 UNION ALL SELECT actor_id, 2, (actor_id % 50) / 25.0 - 1 FROM actor WHERE actor_id % 4 <> 0)"


def _places(spark, d):
    a = A.actors(spark, d).where("actor_id % 4 <> 0")
    one = lambda n, of, by: a.select("actor_id", F.lit(n).alias("dim"), (F.col("actor_id") % of / F.lit(by) - 1).alias("score"))
    return one(1, 200, 100.0).union(one(2, 50, 25.0))


@query("G3_topic_actors", C + """, s AS (SELECT window_start, 'topic:' || label AS scope, dst AS actor_id, sum(w) AS value FROM interaction JOIN vw USING (kind) WHERE view_ = 'amp' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY window_start, scope ORDER BY round(value, 9) DESC, actor_id) AS rank FROM s)
SELECT window_start, scope, coalesce(handle, CAST(actor_id AS VARCHAR)) AS who, round(value, 6) AS value, rank FROM r LEFT JOIN actor USING (actor_id) WHERE rank <= 5""")
def topic_actors(spark, d):
    e = E.aggregate_by_topic(A.interactions(spark, d)).where("scope <> 'all'").withColumn("weight", F.col("weight") * E.weight_of("amp")).where("weight > 0")
    m = e.groupBy("window_start", "scope", F.col("dst").alias("actor_id")).agg(F.sum("weight").alias("value")).withColumn("metric", F.lit("in_strength"))
    return dossier.topic_actors(m, A.actors(spark, d), by="in_strength").withColumn("value", F.round("value", 6))


@query("O6_community_cards", C + PLACES + """, m AS (SELECT community_id, avg(CASE WHEN dim = 1 THEN score END) AS axis, count(CASE WHEN dim = 1 THEN 1 END) AS n_axis, avg(CASE WHEN dim = 2 THEN score END) AS axis2 FROM part JOIN place USING (actor_id) GROUP BY ALL)
SELECT c.community_id, c.size, round(axis, 6) AS axis, coalesce(n_axis, 0) AS n_axis, round(axis2, 6) AS axis2, CASE WHEN c.community_id % 2 = 0 THEN 'y' || c.community_id || ',x' || c.community_id ELSE '' END AS terms FROM (SELECT community_id, count(*) AS size FROM part GROUP BY ALL) c LEFT JOIN m USING (community_id)""")
def cards(spark, d):
    p = A.partition(spark, d)
    c = p.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))
    terms = c.where("community_id % 2 = 0").select("community_id", F.explode(F.array(F.struct(F.concat(F.lit("x"), F.col("community_id").cast("string")).alias("term"), F.lit(1.5).alias("lift")), F.struct(F.concat(F.lit("y"), F.col("community_id").cast("string")).alias("term"), F.lit(2.5).alias("lift")))).alias("t")).select("community_id", "t.term", "t.lift")
    out = dossier.community_cards(c, p, _places(spark, d), terms)
    return out.select("community_id", "size", F.round("axis", 6).alias("axis"), "n_axis", F.round("axis2", 6).alias("axis2"), F.array_join("terms", ",").alias("terms"))


MAP = DISP + f""", step AS (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.15, 0.25, 0.4, 0.6, 1.0]::DOUBLE[]) AS alpha_cut),
h AS (SELECT alpha_cut, a, b, w FROM al, step WHERE alpha < alpha_cut OR alpha_cut = 1.0), n AS (SELECT alpha_cut, count(DISTINCT v) AS nodes FROM (SELECT alpha_cut, a AS v FROM h UNION ALL SELECT alpha_cut, b FROM h) GROUP BY ALL),
cut AS (SELECT alpha_cut FROM h JOIN n USING (alpha_cut) GROUP BY alpha_cut ORDER BY abs(2 * count(*) / any_value(nodes) - 3.5), alpha_cut LIMIT 1),
kept AS (SELECT * FROM h WHERE alpha_cut = (SELECT alpha_cut FROM cut)),
dir AS (SELECT src, dst, sum(weight) AS weight FROM edge WHERE window_start = DATE '{WEEK}' AND src IN (SELECT dst FROM top_) AND dst IN (SELECT dst FROM top_) GROUP BY ALL)"""


@query("K17_map_summary", C + MAP + f""" SELECT (SELECT count(*) FROM top_) AS actors, (SELECT count(*) FROM lk) AS links_all, (SELECT count(*) FROM kept) AS links, (SELECT max(alpha_cut) FROM kept) AS alpha,
(SELECT count(*) FROM top_) - (SELECT count(DISTINCT v) FROM (SELECT a AS v FROM kept UNION ALL SELECT b FROM kept)) AS loose, round(coalesce(2 * (SELECT count(*) FROM kept) / nullif((SELECT count(*) FROM top_), 0), 0), 6) AS mean_degree,
(SELECT count(*) FROM dir) AS direct_edges, round(coalesce((SELECT sum(weight) FROM dir), 0), 6) AS direct_weight, round(coalesce((SELECT sum(weight) FROM dir) / (SELECT sum(weight) FROM edge WHERE window_start = DATE '{WEEK}'), 0), 6) AS weight_share""")
def map_summary(spark, d):
    out = _map(spark, d)["summary"]
    return out.withColumns({c: F.round(c, 6) for c in ("mean_degree", "direct_weight", "weight_share")})


@query("K17_map_nodes", C + MAP + f""" SELECT dst AS actor_id, count(DISTINCT src) AS audience, dst IN (SELECT a FROM kept UNION SELECT b FROM kept) AS placed FROM edge WHERE window_start = DATE '{WEEK}' AND dst IN (SELECT dst FROM top_) GROUP BY ALL""")
def map_nodes(spark, d):
    return _map(spark, d)["nodes"].select("actor_id", "audience", F.col("x").isNotNull().alias("placed"))


def _map(spark, d):
    e = E.view_edges(E.aggregate(A.interactions(spark, d), window=WEEK))
    rank = e.groupBy(F.col("dst").alias("actor_id")).agg(F.round(F.sum("weight"), 6).alias("value"))
    return dossier.network_map(e, rank)


@query("M10_dimension", C + PLACES + """, two AS (SELECT community_id FROM part GROUP BY ALL ORDER BY count(*) DESC, community_id LIMIT 2), x AS (SELECT min(community_id) AS x FROM two),
g AS (SELECT dim, count(*) FILTER ((score < 0) = (community_id = (SELECT x FROM x))) / count(*) AS same FROM place JOIN part USING (actor_id) WHERE community_id IN (SELECT community_id FROM two) GROUP BY ALL),
m AS (SELECT dim, avg(CASE WHEN abs(score) < 0.25 THEN 1.0 ELSE 0.0 END) AS middle FROM place GROUP BY ALL)
SELECT CASE WHEN greatest(same, 1 - same) > 0.95 AND middle < 0.05 THEN 2 ELSE 1 END AS dim, round(greatest(same, 1 - same), 6) AS agreement, round(middle, 6) AS middle FROM g JOIN m USING (dim) WHERE dim = 1""")
def dimension(spark, d):
    s = _places(spark, d)
    return correspondence.chosen_dimension(correspondence.agreement(s, A.partition(spark, d)), s).withColumns({c: F.round(c, 6) for c in ("agreement", "middle")})


def _status_sql(where: str) -> str:
    return C + f""", i AS (SELECT * FROM interaction {where})
SELECT 'tier' AS section, tier AS item, count(*) AS n FROM actor WHERE actor_id IN (SELECT src FROM i UNION SELECT dst FROM i) GROUP BY ALL
UNION ALL SELECT 'kind', kind, count(*) FROM i GROUP BY ALL UNION ALL SELECT 'label', label, count(DISTINCT post_id) FROM i GROUP BY ALL
UNION ALL SELECT 'period', 'days', date_diff('day', min(occurred_at), max(occurred_at)) FROM i"""


@query("O12_status", _status_sql(""))
def status(spark, d):
    return dossier.status(A.interactions(spark, d), A.actors(spark, d))


@query("O12_status_cut", _status_sql("WHERE label IN ('T0', 'T2')"))
def status_cut(spark, d):
    return dossier.status(A.interactions(spark, d), A.actors(spark, d), ["T0", "T2"])


@query("O10_label_volume", C + ", n AS (SELECT window_start, label, count(DISTINCT post_id) AS posts FROM interaction GROUP BY ALL), r AS (SELECT label, count(DISTINCT run_id) AS runs FROM run WHERE run_id <> 3 GROUP BY ALL) SELECT window_start, label, posts, coalesce(runs, 0) AS runs, round(posts / sum(posts) OVER (PARTITION BY window_start), 6) AS share FROM n LEFT JOIN r USING (label)")
def volume(spark, d):
    return dossier.label_volume(A.interactions(spark, d), A.runs(spark).where("run_id <> 3")).withColumn("share", F.round("share", 6))
