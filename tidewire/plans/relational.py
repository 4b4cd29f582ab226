"""Queries over edges, actors, runs and communities, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import times
from tidewire.operators import edges as E
from tidewire.operators import graph as G
from tidewire.operators import seeds as S
from tidewire.sources import adapters as A

from .registry import query

C = A.CTE


def _r(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


def _edges(spark: SparkSession, d: str, view: str = "amp") -> DataFrame:
    return E.view_edges(E.aggregate(A.interactions(spark, d)), view)


@query("entry_weekly_top_receivers", C + """, s AS (SELECT window_start, dst AS actor_id, round(sum(weight), 9) AS in_strength FROM edge GROUP BY ALL),
t AS (SELECT *, in_strength / sum(in_strength) OVER (PARTITION BY window_start) AS share, row_number() OVER (PARTITION BY window_start ORDER BY in_strength DESC, actor_id) AS rank FROM s)
SELECT window_start, actor_id, round(in_strength, 6) AS in_strength, round(share, 6) AS share, rank FROM t WHERE rank <= 20""")
def entry(spark, d):
    s = E.strengths(_edges(spark, d)).where("in_strength > 0").select("window_start", "actor_id", F.round("in_strength", 9).alias("in_strength"))
    s = s.withColumns({"share": F.expr("in_strength / sum(in_strength) OVER (PARTITION BY window_start)"), "rank": F.expr("row_number() OVER (PARTITION BY window_start ORDER BY in_strength DESC, actor_id)")})
    return s.where("rank <= 20").withColumns(_r("in_strength", "share"))


@query("E1_edge_window", C + "SELECT * FROM edge_window")
def edge_window(spark, d):
    return E.aggregate(A.interactions(spark, d))


@query("E1_edge_window_topics", C + "SELECT window_start, 'topic:T0+T1' AS scope, src, dst, kind, count(*)::DOUBLE AS weight FROM interaction WHERE label IN ('T0', 'T1') GROUP BY ALL")
def edge_window_topics(spark, d):
    return E.aggregate(A.interactions(spark, d), ["T1", "T0"])


@query("E1_edge_window_by_topic", C + "SELECT * FROM edge_window UNION ALL SELECT window_start, 'topic:' || label, src, dst, kind, count(*)::DOUBLE FROM interaction GROUP BY ALL")
def edge_window_by_topic(spark, d):
    return E.aggregate_by_topic(A.interactions(spark, d))


@query("E2_view_edges_amp", C + "SELECT window_start, src, dst, round(weight, 6) AS weight FROM edge")
def view_amp(spark, d):
    return _edges(spark, d).withColumns(_r("weight"))


@query("E2_view_edges_all", C + "SELECT window_start, src, dst, round(sum(weight * w), 6) AS weight FROM edge_window JOIN vw USING (kind) WHERE view_ = 'all' GROUP BY ALL")
def view_all(spark, d):
    return _edges(spark, d, "all").withColumns(_r("weight"))


@query("E2_view_edges_reply", C + "SELECT window_start, src, dst, round(sum(weight * w), 6) AS weight FROM edge_window JOIN vw USING (kind) WHERE view_ = 'reply' GROUP BY ALL")
def view_reply(spark, d):
    return _edges(spark, d, "reply").withColumns(_r("weight"))


@query("E3_topics_by_volume", C + "SELECT window_start, label, count(DISTINCT post_id) AS posts FROM interaction GROUP BY ALL")
def topics(spark, d):
    return E.topics_by_volume(A.interactions(spark, d))


@query("E4_windows", C + "SELECT DISTINCT window_start, CAST(window_start + INTERVAL 7 DAY AS DATE) AS window_end FROM interaction")
def windows(spark, d):
    return A.interactions(spark, d).select("window_start").distinct().withColumn("window_end", times.window_end(F.col("window_start")))


@query("E5_topic_posts_authors", C + "SELECT window_start, label, count(*) AS posts, count(DISTINCT src) AS authors FROM interaction GROUP BY ALL")
def topic_authors(spark, d):
    return A.interactions(spark, d).groupBy("window_start", "label").agg(F.count(F.lit(1)).alias("posts"), F.count_distinct("src").alias("authors"))


@query("E6_topic_top3_concentration", C + """, a AS (SELECT window_start, label, src, count(*) AS n FROM interaction GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY window_start, label ORDER BY n DESC, src) AS r FROM a)
SELECT window_start, label, round(sum(n) FILTER (r <= 3) / sum(n), 6) AS concentration FROM r GROUP BY ALL""")
def concentration3(spark, d):
    a = A.interactions(spark, d).groupBy("window_start", "label", "src").agg(F.count(F.lit(1)).alias("n"))
    a = a.withColumn("r", F.expr("row_number() OVER (PARTITION BY window_start, label ORDER BY n DESC, src)"))
    return a.groupBy("window_start", "label").agg(F.round(F.sum(F.when(F.col("r") <= 3, F.col("n"))) / F.sum("n"), 6).alias("concentration"))


@query("E7_topic_spread", C + """, c AS (SELECT i.window_start, i.label, p.community_id, count(DISTINCT i.src) AS n FROM interaction i LEFT JOIN (SELECT * FROM part WHERE community_id < 5) p ON i.src = p.actor_id GROUP BY ALL),
t AS (SELECT window_start, label, sum(n) FILTER (community_id IS NULL) AS outside, sum(n) FILTER (community_id IS NOT NULL) AS inside FROM c GROUP BY ALL)
SELECT c.window_start, c.label, any_value(coalesce(t.outside, 0))::BIGINT AS outside, arg_max(c.community_id, c.n * 1000 - c.community_id) AS dominant, round(max(c.n) / any_value(t.inside), 6) AS dominant_share, count(*) FILTER (c.n / t.inside >= 0.05) AS crosses
FROM c JOIN t USING (window_start, label) WHERE c.community_id IS NOT NULL GROUP BY ALL""")
def topic_spread(spark, d):
    i, p = A.interactions(spark, d), A.partition(spark, d).where("community_id < 5")
    c = i.join(p, i["src"] == p["actor_id"], "left").groupBy("window_start", "label", "community_id").agg(F.count_distinct("src").alias("n"))
    c = c.withColumns({"inside": F.expr("sum(if(community_id IS NULL, 0, n)) OVER (PARTITION BY window_start, label)"), "outside": F.expr("sum(if(community_id IS NULL, n, 0)) OVER (PARTITION BY window_start, label)")})
    return c.where("community_id IS NOT NULL").groupBy("window_start", "label").agg(
        F.max("outside").alias("outside"), F.max_by("community_id", F.struct("n", -F.col("community_id"))).alias("dominant"), F.round(F.max("n") / F.max("inside"), 6).alias("dominant_share"), F.count_if(F.col("n") / F.col("inside") >= 0.05).alias("crosses")
    )


METRICS = """, m AS (SELECT window_start, actor_id, metric, value FROM (
  SELECT window_start, dst AS actor_id, 'in_strength' AS metric, sum(weight) AS value FROM edge GROUP BY ALL UNION ALL
  SELECT window_start, src, 'out_strength', sum(weight) FROM edge GROUP BY ALL))"""


def metrics(spark, d) -> DataFrame:
    """Tall metrics: (window_start, actor_id, metric, value)."""
    e = _edges(spark, d)
    one = lambda end, name: e.groupBy("window_start", F.col(end).alias("actor_id")).agg(F.sum("weight").alias("value")).select("window_start", "actor_id", F.lit(name).alias("metric"), "value")
    return one("dst", "in_strength").union(one("src", "out_strength"))


@query("E8_metrics_wide", C + METRICS + " SELECT window_start, actor_id, round(max(CASE WHEN metric = 'in_strength' THEN value END), 6) AS in_strength, round(max(CASE WHEN metric = 'out_strength' THEN value END), 6) AS out_strength FROM m GROUP BY ALL")
def wide(spark, d):
    return metrics(spark, d).groupBy("window_start", "actor_id").pivot("metric", ["in_strength", "out_strength"]).max("value").withColumns(_r("in_strength", "out_strength"))


@query("E9_community_label_posts", C + "SELECT window_start, community_id, label, count(*) AS posts FROM interaction JOIN part ON src = actor_id GROUP BY ALL")
def community_labels(spark, d):
    i, p = A.interactions(spark, d), A.partition(spark, d)
    return i.join(p, i["src"] == p["actor_id"]).groupBy("window_start", "community_id", "label").agg(F.count(F.lit(1)).alias("posts"))


@query("E10_community_voices", C + "SELECT window_start, community_id, count(DISTINCT src) AS voices FROM interaction JOIN part ON src = actor_id GROUP BY ALL")
def voices(spark, d):
    i, p = A.interactions(spark, d), A.partition(spark, d)
    return i.join(p, i["src"] == p["actor_id"]).groupBy("window_start", "community_id").agg(F.count_distinct("src").alias("voices"))


@query("E11_kind_mix", C + ", k AS (SELECT window_start, kind, sum(weight) AS weight FROM edge_window GROUP BY ALL) SELECT window_start, kind, weight, round(weight / sum(weight) OVER (PARTITION BY window_start), 6) AS share FROM k")
def mix(spark, d):
    return E.kind_mix(E.aggregate(A.interactions(spark, d))).withColumns(_r("share"))


@query("E12_cost_without_fanout", C + "SELECT window_start, round(sum(cost_usd), 6) AS cost_usd, count(*) AS runs FROM (SELECT DISTINCT window_start, label FROM interaction) JOIN run USING (label) GROUP BY ALL")
def cost(spark, d):
    w = A.interactions(spark, d).select("window_start", "label").distinct()
    return A.runs(spark).join(w, "label").groupBy("window_start").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count(F.lit(1)).alias("runs"))


@query("E13_cost_view", C + "SELECT kind, label, status, count(*) AS runs, round(sum(cost_usd), 4) AS cost_usd FROM run GROUP BY ALL")
def cost_view(spark, d):
    return A.runs(spark).groupBy("kind", "label", "status").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


@query("E14_run_provenance", C + "SELECT run_id, count(*) AS posts, CAST(min(occurred_at) AS DATE) AS first_day, CAST(max(occurred_at) AS DATE) AS last_day FROM interaction JOIN run USING (label) WHERE window_start = DATE '2024-01-08' GROUP BY ALL")
def provenance(spark, d):
    i = A.interactions(spark, d).where(F.col("window_start") == F.lit("2024-01-08").cast("date"))
    return i.join(F.broadcast(A.runs(spark)), "label").groupBy("run_id").agg(F.count(F.lit(1)).alias("posts"), F.min("occurred_at").cast("date").alias("first_day"), F.max("occurred_at").cast("date").alias("last_day"))


@query("E15_run_windows", C + "SELECT run_id, string_agg(DISTINCT strftime(window_start, '%Y-%m-%d'), ',' ORDER BY strftime(window_start, '%Y-%m-%d')) AS windows FROM interaction JOIN run USING (label) GROUP BY ALL")
def run_windows(spark, d):
    i = A.interactions(spark, d).join(F.broadcast(A.runs(spark)), "label")
    return i.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set(F.date_format("window_start", "yyyy-MM-dd"))), ",").alias("windows"))


@query("E16_active_weeks", C + "SELECT src AS actor_id, count(DISTINCT strftime(occurred_at, '%Y-%W')) AS weeks FROM interaction GROUP BY ALL")
def weeks(spark, d):
    return A.interactions(spark, d).groupBy(F.col("src").alias("actor_id")).agg(F.count_distinct(times.year_week(F.col("occurred_at"))).alias("weeks"))


@query("E17_table_counts", "SELECT 'events' AS table_name, count(*) AS n FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations")
def counts(spark, d):
    out = [A.read(spark, d, t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n")) for t in ("events", "documents", "conversations")]
    return out[0].union(out[1]).union(out[2])


@query("E18_tiers", C + "SELECT tier, count(*) AS actors FROM actor GROUP BY ALL")
def tiers(spark, d):
    return A.actors(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("actors"))


EI = """, both_ AS (SELECT window_start, src AS actor_id, dst AS other, weight FROM edge UNION ALL SELECT window_start, dst, src, weight FROM edge),
ei AS (SELECT window_start, b.actor_id, p.community_id, sum(weight) AS strength, (2 * sum(CASE WHEN p.community_id <> q.community_id THEN weight ELSE 0 END) - sum(weight)) / sum(weight) AS ei
  FROM both_ b JOIN part p ON p.actor_id = b.actor_id JOIN part q ON q.actor_id = b.other GROUP BY ALL)"""


@query("K5_ei_index", C + EI + " SELECT window_start, actor_id, community_id, round(strength, 6) AS strength, round(ei, 6) AS ei FROM ei")
def ei(spark, d):
    return G.ei_index(_edges(spark, d), A.partition(spark, d)).withColumns(_r("strength", "ei"))


@query("K6_E19_community_summary", C + EI + """ SELECT window_start, community_id, count(*) AS size, round(avg(ei), 6) AS ei_mean, round(avg(ei) FILTER (round(strength, 9) >= 2), 6) AS ei_choice, count(*) FILTER (round(strength, 9) >= 2) AS choice_actors FROM ei GROUP BY ALL""")
def summary(spark, d):
    return G.community_summary(G.ei_index(_edges(spark, d), A.partition(spark, d))).withColumns(_r("ei_mean", "ei_choice"))


@query("E20_old_posts", C + "SELECT label, count(*) AS posts, count(*) FILTER (created_at < (SELECT max(created_at) FROM post) - INTERVAL 20 DAY) AS old_posts, min(created_at) AS first_day, max(created_at) AS last_day FROM post GROUP BY ALL")
def old_posts(spark, d):
    p = A.posts(spark, d).select("label", "created_at")
    top = p.agg(F.max("created_at").alias("top"))
    return p.join(F.broadcast(top)).groupBy("label").agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col("created_at") < F.date_sub("top", 20)).alias("old_posts"), F.min("created_at").alias("first_day"), F.max("created_at").alias("last_day"))


SIZES = ", s AS (SELECT window_start, src, count(*) AS n FROM edge GROUP BY ALL)"


def _degrees(spark, d):
    return _edges(spark, d).groupBy("window_start", "src").agg(F.count(F.lit(1)).alias("n"))


@query("E21_size_histogram", C + SIZES + " SELECT window_start, CASE WHEN n >= 500 THEN '500+' WHEN n >= 100 THEN '100-499' WHEN n >= 10 THEN '10-99' WHEN n >= 4 THEN '4-9' ELSE '1-3' END AS bin, count(*) AS n FROM s GROUP BY 1, 2")
def histogram(spark, d):
    n = F.col("n")
    bin_ = F.when(n >= 500, "500+").when(n >= 100, "100-499").when(n >= 10, "10-99").when(n >= 4, "4-9").otherwise("1-3")
    return _degrees(spark, d).groupBy("window_start", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("E22_tail_summary", C + SIZES + " SELECT window_start, count(*) AS actors, max(n) AS largest, min(n) AS least, list_sort(list(n))[count(*) // 2 + 1] AS median, sum(n)::BIGINT AS total FROM s GROUP BY ALL")
def tail(spark, d):
    g = _degrees(spark, d).groupBy("window_start").agg(F.count(F.lit(1)).alias("actors"), F.max("n").alias("largest"), F.min("n").alias("least"), F.sort_array(F.collect_list("n")).alias("a"), F.sum("n").alias("total"))
    return g.select("window_start", "actors", "largest", "least", F.get("a", F.expr("size(a) div 2")).alias("median"), "total")


@query("E23_archive_coverage", C + "SELECT CAST(date_trunc('week', created_at) AS DATE) AS week, count(DISTINCT created_at) AS days, count(DISTINCT label) AS terms, count(DISTINCT created_at) < 7 AS partial FROM post GROUP BY ALL")
def coverage(spark, d):
    p = A.posts(spark, d).groupBy(times.week_start(F.col("created_at")).alias("week")).agg(F.count_distinct("created_at").alias("days"), F.count_distinct("label").alias("terms"))
    return p.withColumn("partial", F.col("days") < 7)


@query("E23_empty_weeks", C + ", w AS (SELECT DISTINCT CAST(date_trunc('week', created_at) AS DATE) AS week FROM post WHERE post_id % 28 < 5 OR post_id % 28 > 20) SELECT CAST(g AS DATE) AS week FROM (SELECT unnest(generate_series((SELECT min(week) FROM w)::TIMESTAMP, (SELECT max(week) FROM w)::TIMESTAMP, INTERVAL 7 DAY)) AS g) WHERE CAST(g AS DATE) NOT IN (SELECT week FROM w)")
def empty_weeks(spark, d):
    w = A.posts(spark, d).where("post_id % 28 < 5 OR post_id % 28 > 20").select(times.week_start(F.col("created_at")).alias("week")).distinct()
    all_ = w.agg(F.explode(F.sequence(F.min("week"), F.max("week"), F.expr("INTERVAL 7 DAYS"))).alias("week"))
    return all_.join(w, "week", "left_anti")


@query("E24_history", C + "SELECT label, min(created_at) AS first_day, max(created_at) AS last_day, count(*) AS n FROM post WHERE label LIKE 'src1%' GROUP BY ALL")
def history(spark, d):
    return A.posts(spark, d).where(F.col("label").startswith("src1")).groupBy("label").agg(F.min("created_at").alias("first_day"), F.max("created_at").alias("last_day"), F.count(F.lit(1)).alias("n"))


@query("E25_recurring_terms", C + "SELECT label, count(DISTINCT window_start) AS weeks FROM interaction GROUP BY ALL HAVING count(DISTINCT window_start) >= 2")
def recurring(spark, d):
    return A.interactions(spark, d).groupBy("label").agg(F.count_distinct("window_start").alias("weeks")).where("weeks >= 2")


@query("E26_weight_concentration", C + """, s AS (SELECT window_start, src, sum(weight) AS s FROM edge GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY s DESC, src) AS r FROM s)
SELECT window_start, round(sum(s) FILTER (r <= 1) / sum(s), 6) AS top1_share, round(sum(s) FILTER (r <= 5) / sum(s), 6) AS top5_share, sum(s) FILTER (r <= 1) / sum(s) >= 0.05 AS alert FROM r GROUP BY ALL""")
def weight_concentration(spark, d):
    return E.concentration(_edges(spark, d)).withColumns(_r("top1_share", "top5_share"))


@query("C1_week_range", C + "SELECT post_id, kind FROM interaction WHERE occurred_at >= TIMESTAMP '2024-01-08' AND occurred_at < TIMESTAMP '2024-01-15'")
def week_range(spark, d):
    return A.interactions(spark, d).where(times.in_window(F.col("occurred_at"), "2024-01-08")).select("post_id", "kind")


@query("C6_flag_sums", C + "SELECT window_start, count(*) FILTER (kind = 'repost') AS reposts, count(*) FILTER (src < dst) AS upward, count(*) FILTER (a.handle IS NULL) AS no_handle FROM interaction LEFT JOIN actor a ON a.actor_id = src GROUP BY ALL")
def flag_sums(spark, d):
    i, a = A.interactions(spark, d), A.actors(spark, d)
    return i.join(a, i["src"] == a["actor_id"], "left").groupBy("window_start").agg(F.count_if(F.col("kind") == "repost").alias("reposts"), F.count_if(F.col("src") < F.col("dst")).alias("upward"), F.count_if(F.col("handle").isNull()).alias("no_handle"))


@query("C7_display_names", C + "SELECT actor_id, coalesce(handle, CAST(actor_id AS VARCHAR)) AS name FROM actor")
def names(spark, d):
    return A.actors(spark, d).select("actor_id", F.coalesce("handle", F.col("actor_id").cast("string")).alias("name"))


@query("C8_violations", "SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'kind' ELSE 'loop' END AS broken FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup') OR user_id = CAST(json_extract_string(props, '$.k') AS BIGINT)")
def violations(spark, d):
    from tidewire.operators.validate import broken

    e = A.read(spark, d, "events").select("event_id", "event_type", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return broken(e, {"kind": F.col("event_type").isin(list(A.KINDS)), "loop": F.col("user_id") != F.col("k")}).select("event_id", "broken")


@query("C9_orphans", C + "SELECT DISTINCT dst AS actor_id FROM interaction WHERE dst NOT IN (SELECT src FROM interaction)")
def orphans(spark, d):
    from tidewire.operators.validate import missing_keys

    i = A.interactions(spark, d)
    return missing_keys(i.select(F.col("dst").alias("actor_id")), i.select(F.col("src").alias("actor_id")), ["actor_id"])


@query("C12_seeds", C + "SELECT actor_id, tier FROM actor WHERE tier IN ('A', 'B')")
def seed_list(spark, d):
    return A.actors(spark, d).where(F.col("tier").isin("A", "B")).select("actor_id", "tier")


@query("C13_min_degree", C + ", s AS (SELECT window_start, dst, sum(weight) AS s FROM edge GROUP BY ALL) SELECT DISTINCT actor_id, tier FROM actor WHERE actor_id IN (SELECT dst FROM s WHERE s >= 3)")
def min_degree(spark, d):
    strong = metrics(spark, d).where("metric = 'in_strength' AND round(value, 9) >= 3")
    return A.actors(spark, d).join(strong, "actor_id", "left_semi").select("actor_id", "tier")


@query("C14_status_cut", C + "SELECT i.post_id, i.label FROM interaction i WHERE i.label IN (SELECT label FROM run WHERE kind = 'campanha')")
def status_cut(spark, d):
    return A.interactions(spark, d).join(F.broadcast(A.runs(spark).where("kind = 'campanha'")), "label", "left_semi").select("post_id", "label")


@query("D3_filtered_left_join", C + "SELECT a.actor_id, p.community_id FROM actor a LEFT JOIN part p ON p.actor_id = a.actor_id AND p.community_id = 3")
def filtered_left(spark, d):
    return A.actors(spark, d).join(A.partition(spark, d).where("community_id = 3"), "actor_id", "left").select("actor_id", "community_id")


@query("D4_metric_actor_community", C + METRICS + " SELECT window_start, m.actor_id, a.tier, p.community_id, round(max(value) FILTER (metric = 'in_strength'), 6) AS in_strength FROM m JOIN actor a ON a.actor_id = m.actor_id LEFT JOIN part p ON p.actor_id = m.actor_id GROUP BY ALL")
def metric_actor(spark, d):
    w = metrics(spark, d).groupBy("window_start", "actor_id").pivot("metric", ["in_strength"]).max("value")
    return w.join(A.actors(spark, d).select("actor_id", "tier"), "actor_id").join(A.partition(spark, d), "actor_id", "left").select("window_start", "actor_id", "tier", "community_id", F.round("in_strength", 6).alias("in_strength"))


@query("D5_edge_names", C + "SELECT window_start, coalesce(s.handle, CAST(e.src AS VARCHAR)) AS src_name, coalesce(t.handle, CAST(e.dst AS VARCHAR)) AS dst_name, kind, weight FROM edge_window e JOIN actor s ON s.actor_id = src JOIN actor t ON t.actor_id = dst")
def edge_names(spark, d):
    n = names(spark, d)
    s, t = n.select(F.col("actor_id").alias("src"), F.col("name").alias("src_name")), n.select(F.col("actor_id").alias("dst"), F.col("name").alias("dst_name"))
    return E.aggregate(A.interactions(spark, d)).join(s, "src").join(t, "dst").select("window_start", "src_name", "dst_name", "kind", "weight")


@query("D6_latest_snapshot", C + ", l AS (SELECT src, max(occurred_at) AS t FROM interaction GROUP BY ALL) SELECT a.actor_id, max(i.post_id) AS last_post FROM actor a LEFT JOIN (SELECT i.src, i.post_id FROM interaction i JOIN l ON l.src = i.src AND l.t = i.occurred_at) i ON i.src = a.actor_id GROUP BY ALL")
def latest(spark, d):
    last = A.interactions(spark, d).groupBy(F.col("src").alias("actor_id")).agg(F.max_by("post_id", F.struct("occurred_at", "post_id")).alias("last_post"))
    return A.actors(spark, d).join(last, "actor_id", "left").select("actor_id", "last_post")


@query("D7_actor_counts", C + "SELECT a.actor_id, (SELECT count(*) FROM interaction i WHERE i.dst = a.actor_id) AS received, (SELECT count(*) FROM interaction i WHERE i.src = a.actor_id) AS sent FROM actor a")
def actor_counts(spark, d):
    return S.actor_counts(A.actors(spark, d), A.interactions(spark, d)).select("actor_id", "received", "sent")


@query("D8_runs_with_posts", C + "SELECT run_id FROM run WHERE EXISTS (SELECT 1 FROM interaction i WHERE i.label = run.label AND i.window_start = DATE '2024-01-29')")
def runs_with_posts(spark, d):
    return A.runs(spark).join(A.interactions(spark, d).where(F.col("window_start") == F.lit("2024-01-29").cast("date")), "label", "left_semi").select("run_id")


@query("D10_posts_without_edges", C + "SELECT event_id FROM events WHERE event_id NOT IN (SELECT post_id FROM interaction)")
def no_edges(spark, d):
    return A.read(spark, d, "events").select("event_id").join(A.interactions(spark, d).select(F.col("post_id").alias("event_id")), "event_id", "left_anti")


@query("D11_G2_core_heaviest", C + ", k AS (SELECT actor_id FROM actor WHERE tier <> 'C') SELECT window_start, src, dst, round(weight, 6) AS weight FROM edge WHERE src IN (SELECT * FROM k) AND dst IN (SELECT * FROM k) ORDER BY weight DESC, src, dst, window_start LIMIT 50")
def core_heaviest(spark, d):
    return E.heaviest(E.within(_edges(spark, d).withColumns(_r("weight")), A.actors(spark, d).where("tier <> 'C'")), 50)


@query("D12_seed_yield", C + "SELECT a.actor_id, count(i.post_id) AS reposts FROM actor a LEFT JOIN interaction i ON i.src = a.actor_id AND i.kind = 'repost' WHERE a.tier = 'A' GROUP BY ALL")
def seed_yield(spark, d):
    r = A.interactions(spark, d).where("kind = 'repost'").groupBy(F.col("src").alias("actor_id")).agg(F.count(F.lit(1)).alias("n"))
    return A.actors(spark, d).where("tier = 'A'").join(r, "actor_id", "left").select("actor_id", F.coalesce("n", F.lit(0)).alias("reposts"))


AUD = """, top_ AS (SELECT dst FROM (SELECT dst, sum(weight) AS s FROM edge WHERE window_start = DATE '2024-01-08' GROUP BY ALL) ORDER BY round(s, 6) DESC, dst LIMIT 60),
aud AS (SELECT DISTINCT dst, src FROM edge WHERE window_start = DATE '2024-01-08' AND dst IN (SELECT dst FROM top_)),
lk AS (SELECT x.dst AS a, y.dst AS b, count(*) AS common FROM aud x JOIN aud y ON x.src = y.src AND x.dst < y.dst GROUP BY ALL HAVING count(*) >= 2)"""


def _audience(spark, d):
    w = _edges(spark, d).where(F.col("window_start") == F.lit("2024-01-08").cast("date")).withColumns(_r("weight"))
    return G.shared_audience(w)


@query("K13_D15_shared_audience", C + AUD + " SELECT * FROM lk")
def audience(spark, d):
    return _audience(spark, d)


DISP = AUD + """, ends_ AS (SELECT a AS v, common AS w FROM lk UNION ALL SELECT b, common FROM lk), st AS (SELECT v, sum(w)::DOUBLE AS s, count(*) AS k FROM ends_ GROUP BY ALL),
al AS (SELECT a, b, common AS w, least(CASE WHEN x.k <= 1 THEN 0 ELSE pow(1 - common / x.s, x.k - 1) END, CASE WHEN y.k <= 1 THEN 0 ELSE pow(1 - common / y.s, y.k - 1) END) AS alpha FROM lk JOIN st x ON x.v = a JOIN st y ON y.v = b)"""


@query("K14_disparity", C + DISP + " SELECT a, b, w, round(alpha, 6) AS alpha FROM al")
def disparity(spark, d):
    return G.disparity(_audience(spark, d).withColumnRenamed("common", "w")).withColumns(_r("alpha"))


@query("K15_skeleton", C + DISP + """, st2 AS (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.15, 0.25, 0.4, 0.6, 1.0]::DOUBLE[]) AS alpha_cut),
h AS (SELECT alpha_cut, a, b FROM al, st2 WHERE alpha < alpha_cut OR alpha_cut = 1.0), n AS (SELECT alpha_cut, count(DISTINCT v) AS nodes FROM (SELECT alpha_cut, a AS v FROM h UNION ALL SELECT alpha_cut, b FROM h) GROUP BY ALL),
m AS (SELECT alpha_cut, count(*) AS links, any_value(nodes) AS nodes, 2 * count(*) / any_value(nodes) AS mean_degree FROM h JOIN n USING (alpha_cut) GROUP BY ALL)
SELECT alpha_cut, links, nodes, round(mean_degree, 6) AS mean_degree, row_number() OVER (ORDER BY abs(mean_degree - 3.5), alpha_cut) = 1 AS chosen FROM m""")
def skeleton(spark, d):
    return G.skeleton(G.disparity(_audience(spark, d).withColumnRenamed("common", "w"))).withColumns(_r("mean_degree"))


COAMP = """, rp AS (SELECT window_start, dst, src, epoch(date_trunc('second', occurred_at))::BIGINT AS t, post_id FROM interaction WHERE kind = 'repost'),
ok AS (SELECT * FROM rp WHERE (window_start, dst) IN (SELECT (window_start, dst) FROM rp GROUP BY window_start, dst HAVING count(*) <= 50)),
pr AS (SELECT x.window_start, least(x.src, y.src) AS a, greatest(x.src, y.src) AS b, count(*) AS times FROM ok x JOIN ok y ON x.window_start = y.window_start AND x.dst = y.dst AND x.src <> y.src AND (y.t > x.t OR (y.t = x.t AND y.post_id > x.post_id)) AND y.t - x.t <= 86400 GROUP BY ALL)"""


@query("K19_D14_coamplification_pairs", C + COAMP + " SELECT * FROM pr WHERE times >= 2")
def coamp(spark, d):
    return G.coamplification(A.interactions(spark, d), 86400, 50, 2)[0].select("window_start", "a", "b", "times")


@query("K19_coamplification_clusters")
def coamp_clusters(spark, d):
    return G.coamplification_clusters(G.coamplification(A.interactions(spark, d), 86400, 50, 2)[0])


@query("K12_O8_match_communities", C + ", x AS (SELECT actor_id, actor_id % 7 AS a FROM actor), y AS (SELECT actor_id, (actor_id * 3 + actor_id // 20) % 5 AS b FROM actor WHERE actor_id % 4 <> 0)" + """,
j AS (SELECT a, b, count(*) AS common FROM x JOIN y USING (actor_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY common DESC, b) AS r FROM j)
SELECT na.a, r.b, n_a, n_b, common, round(common / n_a, 6) AS share_a, round(common / n_b, 6) AS share_b, round(common / (n_a + n_b - common), 6) AS jaccard, common / n_a < 0.01 AS noise
FROM (SELECT a, count(*) AS n_a FROM x GROUP BY a) na LEFT JOIN r ON r.a = na.a AND r.r = 1 LEFT JOIN (SELECT b, count(*) AS n_b FROM y GROUP BY b) nb ON nb.b = r.b""")
def match(spark, d):
    a = A.partition(spark, d)
    b = A.actors(spark, d).where("actor_id % 4 <> 0").selectExpr("actor_id", "(actor_id * 3 + actor_id div 20) % 5 AS community_id")
    return G.match_communities(a, b).withColumns(_r("share_a", "share_b", "jaccard"))


@query("K11_import_partition", C + ", v AS (SELECT window_start, src AS actor_id FROM edge UNION SELECT window_start, dst FROM edge) SELECT window_start, v.actor_id, community_id FROM v JOIN (SELECT * FROM part WHERE actor_id % 6 <> 0) USING (actor_id)")
def imported(spark, d):
    return G.import_partition(E.vertices(_edges(spark, d)), A.partition(spark, d).where("actor_id % 6 <> 0"))[0].select("window_start", "actor_id", "community_id")


@query("K11_without_partition", C + ", v AS (SELECT window_start, src AS actor_id FROM edge UNION SELECT window_start, dst FROM edge) SELECT window_start, count(*) AS without FROM v WHERE actor_id % 6 = 0 GROUP BY ALL")
def not_imported(spark, d):
    return G.import_partition(E.vertices(_edges(spark, d)), A.partition(spark, d).where("actor_id % 6 <> 0"))[1]


@query("F4_K9_renumber", C + ", s AS (SELECT community_id, count(*) AS n, min(actor_id) AS m FROM part GROUP BY ALL), r AS (SELECT community_id, row_number() OVER (ORDER BY n DESC, m) - 1 AS new_id FROM s) SELECT actor_id, new_id AS community_id FROM part JOIN r USING (community_id)")
def renumber(spark, d):
    return G.renumber(A.partition(spark, d))


@query("K3_strengths", C + METRICS + " SELECT window_start, actor_id, round(coalesce(max(value) FILTER (metric = 'in_strength'), 0), 6) AS in_strength, round(coalesce(max(value) FILTER (metric = 'out_strength'), 0), 6) AS out_strength FROM m GROUP BY ALL")
def strength(spark, d):
    return E.strengths(_edges(spark, d)).withColumns(_r("in_strength", "out_strength"))


E0 = C + ", e0 AS (SELECT window_start AS w, src, dst, weight FROM edge)"
_PRUNE = "".join(f", k{i} AS (SELECT w, v FROM (SELECT w, src AS v, weight FROM e{i} UNION ALL SELECT w, dst, weight FROM e{i}) GROUP BY ALL HAVING round(sum(weight), 9) >= 2), e{i + 1} AS (SELECT * FROM e{i} WHERE (w, src) IN (SELECT (w, v) FROM k{i}) AND (w, dst) IN (SELECT (w, v) FROM k{i}))" for i in range(12))


@query("K2_core", E0 + _PRUNE + " SELECT w AS window_start, src, dst, round(weight, 6) AS weight FROM e12")
def core(spark, d):
    return G.core(_edges(spark, d)).withColumns(_r("weight"))


COMP = E0.replace("WITH ", "WITH RECURSIVE ", 1) + ", u AS (SELECT w, src AS x, dst AS y FROM e0 UNION SELECT w, dst, src FROM e0), reach(w, v, r) AS (SELECT w, x, x FROM u UNION SELECT u.w, u.y, reach.r FROM reach JOIN u ON u.x = reach.v AND u.w = reach.w), cc AS (SELECT w, v AS actor_id, min(r) AS component FROM reach GROUP BY ALL)"


@query("K10_components", COMP + " SELECT w AS window_start, actor_id, component FROM cc")
def components(spark, d):
    return G.components(_edges(spark, d))


@query("K10_component_stats", COMP + ", s AS (SELECT w, component, count(*) AS n FROM cc GROUP BY ALL) SELECT w AS window_start, count(*) AS components, max(n) AS largest, round(max(n) / sum(n), 6) AS core_share, count(*) FILTER (n <= 3) AS trivial FROM s GROUP BY w")
def component_stats(spark, d):
    return G.component_stats(G.components(_edges(spark, d))).withColumns(_r("core_share"))


RANK = """, nd AS (SELECT w, v, 1.0::DOUBLE / count(*) OVER (PARTITION BY w) AS share FROM (SELECT w, src AS v FROM e0 UNION SELECT w, dst FROM e0)), p AS (SELECT w, src, dst, weight / sum(weight) OVER (PARTITION BY w, src) AS p FROM e0),
sink AS (SELECT w, v FROM nd WHERE (w, v) NOT IN (SELECT (w, src) FROM e0)), it(i, w, v, r) AS (SELECT 0, w, v, share FROM nd UNION ALL
SELECT min(x.i) + 1, x.w, x.v, any_value(0.15 * nd.share) + 0.85 * sum(x.m) FROM (SELECT it.i, it.w, p.dst AS v, it.r * p.p AS m FROM it JOIN p ON it.w = p.w AND it.v = p.src UNION ALL SELECT it.i, it.w, nd.v, it.r * nd.share FROM it JOIN sink ON it.w = sink.w AND it.v = sink.v JOIN nd ON nd.w = it.w UNION ALL SELECT i, w, v, 0.0 FROM it) x JOIN nd ON nd.w = x.w AND nd.v = x.v WHERE x.i < 100 GROUP BY x.w, x.v)"""


@query("K4_pagerank", E0.replace("WITH ", "WITH RECURSIVE ", 1) + RANK + " SELECT w AS window_start, v AS actor_id, round(r, 6) AS pagerank FROM it WHERE i = 100")
def pagerank(spark, d):
    return G.pagerank(_edges(spark, d)).withColumns(_r("pagerank"))


@query("F1_top_per_community", C + METRICS + ", r AS (SELECT window_start, community_id, m.actor_id, round(value, 6) AS value, row_number() OVER (PARTITION BY window_start, community_id ORDER BY round(value, 6) DESC, m.actor_id) AS rank FROM m JOIN part p ON p.actor_id = m.actor_id WHERE metric = 'in_strength') SELECT * FROM r WHERE rank <= 3")
def top_per_community(spark, d):
    m = metrics(spark, d).where("metric = 'in_strength'").join(A.partition(spark, d), "actor_id").select("window_start", "community_id", "actor_id", F.round("value", 6).alias("value"))
    return m.withColumn("rank", F.expr("row_number() OVER (PARTITION BY window_start, community_id ORDER BY value DESC, actor_id)")).where("rank <= 3")


RANK = METRICS + ", k AS (SELECT window_start, actor_id, (row_number() OVER (PARTITION BY window_start ORDER BY round(value, 6), actor_id) - 1) / greatest(count(*) OVER (PARTITION BY window_start) - 1, 1) AS posto FROM m WHERE metric = 'in_strength')"


def _ranks(spark, d):
    m = metrics(spark, d).where("metric = 'in_strength'").withColumn("value", F.round("value", 6))
    return m.select("window_start", "actor_id", F.expr("(row_number() OVER (PARTITION BY window_start ORDER BY value, actor_id) - 1) / greatest(count(*) OVER (PARTITION BY window_start) - 1, 1)").alias("posto"))


@query("F2_relative_rank", C + RANK + " SELECT window_start, actor_id, round(posto, 6) AS posto FROM k")
def relative_rank(spark, d):
    return _ranks(spark, d).withColumns(_r("posto"))


@query("F3_F5_rank_change", C + RANK + " SELECT b.window_start, b.actor_id, round(b.posto - a.posto, 6) AS change FROM k a JOIN k b ON a.actor_id = b.actor_id AND a.window_start + INTERVAL 7 DAY = b.window_start")
def rank_change(spark, d):
    k = _ranks(spark, d)
    prev = k.select(F.date_add("window_start", 7).alias("window_start"), "actor_id", F.col("posto").alias("before"))
    return k.join(prev, ["window_start", "actor_id"]).select("window_start", "actor_id", F.round(F.col("posto") - F.col("before"), 6).alias("change"))


@query("F6_deciles", C + METRICS + ", s AS (SELECT window_start, list_sort(list(round(value, 6))) AS a, count(*) AS n FROM m WHERE metric = 'out_strength' GROUP BY ALL) SELECT window_start, k, a[least(n - 1, n * k // 10) + 1] AS value FROM s, (SELECT range AS k FROM range(11))")
def deciles(spark, d):
    g = metrics(spark, d).where("metric = 'out_strength'").groupBy("window_start").agg(F.sort_array(F.collect_list(F.round("value", 6))).alias("a"))
    return g.select("window_start", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("k")).select("window_start", "k", F.get("a", F.least(F.size("a") - 1, F.expr("size(a) * k div 10")).cast("int")).alias("value"))


@query("F7_common_authors", C + ", n AS (SELECT label, lang, actor_id, count(*) AS posts FROM post GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label, lang ORDER BY posts DESC, actor_id) AS rank FROM n) SELECT * FROM r WHERE rank <= 3")
def common_authors(spark, d):
    n = A.posts(spark, d).groupBy("label", "lang", "actor_id").agg(F.count(F.lit(1)).alias("posts"))
    return n.withColumn("rank", F.expr("row_number() OVER (PARTITION BY label, lang ORDER BY posts DESC, actor_id)")).where("rank <= 3")


@query("G1_top_actors", C + METRICS + " SELECT actor_id, round(value, 6) AS value FROM m WHERE metric = 'in_strength' AND window_start = DATE '2024-01-08' ORDER BY round(value, 6) DESC, actor_id LIMIT 25")
def top_actors(spark, d):
    m = metrics(spark, d).where((F.col("metric") == "in_strength") & (F.col("window_start") == F.lit("2024-01-08").cast("date"))).select("actor_id", F.round("value", 6).alias("value"))
    return m.orderBy(F.desc("value"), "actor_id").limit(25)


@query("H1_authors_and_targets", C + "SELECT src AS actor_id FROM interaction UNION SELECT dst FROM interaction")
def everyone(spark, d):
    i = A.interactions(spark, d)
    return i.select(F.col("src").alias("actor_id")).union(i.select("dst")).distinct()


@query("H2_only_senders", C + "SELECT src AS actor_id FROM interaction EXCEPT SELECT dst FROM interaction")
def only_senders(spark, d):
    i = A.interactions(spark, d)
    return i.select(F.col("src").alias("actor_id")).distinct().join(i.select(F.col("dst").alias("actor_id")), "actor_id", "left_anti")


@query("H3_vertices", C + "SELECT window_start, src AS actor_id FROM edge UNION SELECT window_start, dst FROM edge")
def verts(spark, d):
    return E.vertices(_edges(spark, d))


@query("L1_seed_candidates", C + """, o AS (SELECT src AS actor_id, count(DISTINCT dst) AS targets, count(*) AS interactions, count(DISTINCT strftime(occurred_at, '%Y-%W')) AS weeks FROM interaction WHERE src % 11 <> 0 GROUP BY ALL), i AS (SELECT dst AS actor_id, count(*) AS received FROM interaction GROUP BY ALL)
SELECT actor_id, targets, interactions, weeks, coalesce(received, 0) AS received, CASE WHEN targets >= 3 AND coalesce(received, 0) > 3 * targets THEN 'both' WHEN coalesce(received, 0) > 3 * targets THEN 'voice' WHEN targets >= 3 THEN 'factory' ELSE 'little' END AS kind
FROM o LEFT JOIN i USING (actor_id) ORDER BY targets DESC, interactions DESC, actor_id LIMIT 40""")
def candidates(spark, d):
    out = A.actors(spark, d).where("actor_id % 11 = 0")
    return S.candidates(A.interactions(spark, d), 40, exclude=out)


@query("L2_actor_search", C + """SELECT a.actor_id, a.handle, (SELECT count(*) FROM interaction i WHERE i.dst = a.actor_id) AS received, (SELECT count(*) FROM interaction i WHERE i.src = a.actor_id) AS sent
FROM actor a WHERE a.handle ILIKE '%SER1%' ORDER BY received DESC, sent DESC, handle LIMIT 20""")
def search(spark, d):
    return S.search(A.actors(spark, d), A.interactions(spark, d), "SER1", 20)


@query("J_reply_turns", "SELECT role AS src, prev AS dst, count(*) AS n FROM (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE prev IS NOT NULL GROUP BY ALL")
def reply_turns(spark, d):
    return A.replies(spark, d).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
