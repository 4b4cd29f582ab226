"""The canonical model over plain tables: interactions, posts, actors, runs, partitions, replies.

``CTE`` is the same model in DuckDB SQL, for the twins of the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.times import week_start

KINDS = {"click": "repost", "view": "quote", "purchase": "reply", "signup": "mention"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post_id, src, dst, kind, occurred_at, window_start, label), no loops."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    e = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("post_id"), F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"),
        kind[F.col("event_type")].alias("kind"), F.col("ts").cast("timestamp").alias("occurred_at"), F.concat(F.lit("T"), (F.col("event_id") % 5).cast("string")).alias("label"),
    )
    return e.where("kind IS NOT NULL AND src <> dst").withColumn("window_start", week_start(F.col("occurred_at")))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post_id, actor_id, text, lang, label, created_at, run_id) from documents."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("post_id"), (F.col("doc_id") % 97).alias("actor_id"), "text", "lang", F.col("source").alias("label"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).alias("created_at"))


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(actor_id, handle, tier) of all that send or receive."""
    i = interactions(spark, sf_dir)
    a = i.select(F.col("src").alias("actor_id")).union(i.select("dst")).distinct()
    tier = F.when(F.col("actor_id") % 10 == 0, "A").when(F.col("actor_id") % 10 == 1, "B").otherwise("C")
    return a.select("actor_id", F.when(F.col("actor_id") % 3 != 0, F.concat(F.lit("user"), F.col("actor_id").cast("string"))).alias("handle"), tier.alias("tier"))


def runs(spark: SparkSession) -> DataFrame:
    """One run a label: (run_id, label, kind, status, cost_usd)."""
    return spark.range(5).select(F.col("id").alias("run_id"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("label"), F.when(F.col("id") % 2 == 0, "baseline").otherwise("campanha").alias("kind"), F.lit("ok").alias("status"), (F.col("id") * 0.01).alias("cost_usd"))


def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in partition: (actor_id, community_id = actor_id mod 7)."""
    return actors(spark, sf_dir).select("actor_id", (F.col("actor_id") % 7).alias("community_id"))


def amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bipartite table of customers and suppliers: (src, dst, weight = lines)."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return j.groupBy(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000).alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, src = role of the turn, dst = role of the one before)."""
    c = read(spark, sf_dir, "conversations")
    prev = F.expr("lag(role) OVER (PARTITION BY conv_id ORDER BY turn)")
    return c.select("conv_id", "turn", F.col("role").alias("src"), prev.alias("dst")).where("dst IS NOT NULL")


CTE = """WITH interaction AS (
  SELECT event_id AS post_id, user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst,
    CASE event_type WHEN 'click' THEN 'repost' WHEN 'view' THEN 'quote' WHEN 'purchase' THEN 'reply' WHEN 'signup' THEN 'mention' END AS kind,
    ts AS occurred_at, 'T' || (event_id % 5) AS label, CAST(date_trunc('week', ts) AS DATE) AS window_start
  FROM events WHERE event_type IN ('click', 'view', 'purchase', 'signup') AND user_id <> CAST(json_extract_string(props, '$.k') AS BIGINT)
), post AS (
  SELECT doc_id AS post_id, doc_id % 97 AS actor_id, text, lang, source AS label, CAST(DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER) AS DATE) AS created_at FROM documents
), actor AS (
  SELECT actor_id, CASE WHEN actor_id % 3 <> 0 THEN 'user' || actor_id END AS handle, CASE WHEN actor_id % 10 = 0 THEN 'A' WHEN actor_id % 10 = 1 THEN 'B' ELSE 'C' END AS tier
  FROM (SELECT src AS actor_id FROM interaction UNION SELECT dst FROM interaction)
), run AS (
  SELECT range AS run_id, 'T' || range AS label, CASE WHEN range % 2 = 0 THEN 'baseline' ELSE 'campanha' END AS kind, 'ok' AS status, range * 0.01::DOUBLE AS cost_usd FROM range(5)
), part AS (SELECT actor_id, actor_id % 7 AS community_id FROM actor
), vw(view_, kind, w) AS (VALUES ('amp','repost',1.0::DOUBLE),('amp','quote',0.8),('reply','reply',1.0),('all','repost',1.0),('all','quote',0.8),('all','reply',0.4),('all','mention',0.3)
), edge_window AS (
  SELECT window_start, 'all' AS scope, src, dst, kind, CAST(count(*) AS DOUBLE) AS weight FROM interaction GROUP BY ALL
), edge AS (
  SELECT window_start, src, dst, sum(weight * w) AS weight FROM edge_window JOIN vw USING (kind) WHERE view_ = 'amp' GROUP BY ALL
)
"""
