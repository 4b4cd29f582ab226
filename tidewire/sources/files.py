"""Seed lists, environment files, and a look at an unknown table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names that fill each role.
ROLES: dict[str, tuple[str, ...]] = {
    "id do post": ("id", "id_str", "tweet_id", "post_id", "status_id"),
    "id do autor": ("author_id", "user_id", "userid", "author", "user", "from_user_id"),
    "handle do autor": ("username", "screen_name", "author_username", "user_username", "handle", "user_screen_name", "author_handle", "from_user", "user_info"),
    "texto": ("text", "full_text", "content", "tweet", "tweet_text", "body", "tweet_content"),
    "data": ("created_at", "createdat", "date", "timestamp", "tweet_created_at", "datetime"),
    "idioma": ("lang", "language", "tweet_lang"),
    "posts referenciados": ("referenced_tweets", "referenced_tweet", "references", "in_reply_to_status_id", "retweeted_status", "quoted_status", "quoted_status_id", "in_reply_to_tweet_id", "conversation_id", "is_retweet", "is_quote", "is_reply"),
    "autor referenciado": ("referenced_tweets_author_id", "in_reply_to_user_id", "retweeted_user_id", "quoted_user_id", "referenced_author_id", "original_author_id", "in_reply_to_screen_name", "retweeted_author_id", "retweeted_from", "quoted_from", "reply_to"),
    "menções": ("entities", "mentions", "entities_mentions", "user_mentions", "entities_mentions_username"),
    "métricas": ("public_metrics", "retweet_count", "like_count", "reply_count", "quote_count", "favorite_count"),
}
NEEDED = ("id do post", "id do autor", "texto", "data")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(seed, doubtful): one a line; # begins a comment, a leading ? marks doubt."""
    t = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("s")).where("s <> ''")
    return t.select(F.trim(F.regexp_replace("s", r"^\?\s*", "")).alias("seed"), F.col("s").startswith("?").alias("doubtful"))


def load_env(path: str) -> dict[str, str]:
    """``NAME=value`` lines; variables that are already set win."""
    out = {}
    if os.path.exists(path):
        for line in open(path, encoding="utf-8"):
            name, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and not name.startswith("#"):
                out[name.strip()] = os.environ.setdefault(name.strip(), value.strip().strip("'\""))
    return out


def describe(df: DataFrame, first: int = 50) -> DataFrame:
    """(column, type, null_share, example) in one pass; the example is from the first rows."""
    names = df.columns
    aggs = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.avg(F.col(f"`{c}`").isNull().cast("double")).alias("null_share")) for c, t in df.dtypes]
    shares = df.agg(F.explode(F.array(*aggs)).alias("s")) if names else None
    examples = df.limit(first).agg(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.first(F.col(f"`{c}`").cast("string"), ignorenulls=True).alias("example")) for c in names])).alias("e"))
    return shares.select("s.*").join(examples.select("e.*"), "column", "left")


def diagnose(df: DataFrame) -> dict:
    """Which roles the columns fill, and what graph they allow."""
    clean = {c: c.lower().replace("-", "_").replace(".", "_").strip() for c in df.columns}
    found = {role: [c for c, k in clean.items() if k in names] for role, names in ROLES.items()}
    lacking = [r for r in NEEDED if not found[r]]
    if df.isEmpty():
        verdict = "empty"
    elif lacking:
        verdict = "blocked"
    elif found["autor referenciado"]:
        verdict = "direct"
    elif found["menções"]:
        verdict = "by mention"
    elif found["posts referenciados"]:
        verdict = "partial"
    else:
        verdict = "no edges"
    return {"verdict": verdict, "lacking": lacking, "roles": found, "no_handle": not found["handle do autor"]}
