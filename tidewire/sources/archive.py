"""Archive rows (parquet members of a zip file), with nested values written as Python literals."""

from __future__ import annotations

import ast
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.times import parse_utc

from .events import EVENT_COLUMNS, target

PLATFORM = "x"
SCHEMA = "created_at string, tweet_id bigint, tweet_content string, user string, user_info string, has_mention boolean, mentions string, is_reply boolean, reply_to string, is_quote boolean, quoted_from string, is_retweet boolean, retweeted_from string, hashtags string"
#: Flag, column and kind of each reference, by precedence.
REFERENCES = [("is_retweet", "retweeted_from", "repost"), ("is_reply", "reply_to", "reply"), ("is_quote", "quoted_from", "quote")]


def members(path: str, suffix: str = ".parquet") -> list[str]:
    """Members of a zip file, by name."""
    with zipfile.ZipFile(path) as z:
        return sorted(n for n in z.namelist() if n.endswith(suffix))


def extract(path: str, out_dir: str, names: list[str] | None = None) -> list[str]:
    """Unpack members into a folder that Spark can read."""
    with zipfile.ZipFile(path) as z:
        return [z.extract(n, out_dir) for n in names or members(path)]


def file_label(name: Column) -> Column:
    """(day, label) of ``YYYY-MM-DD-label.parquet``, with or without folders; null for other names."""
    base = F.element_at(F.split(name, "/"), -1)
    part = lambda i: F.regexp_extract(base, r"^(\d{4}-\d{2}-\d{2})-(.+)\.parquet$", i)
    return F.when(part(2) != "", F.struct(part(1).try_cast("date").alias("day"), part(2).alias("label")))


def between(names: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """``names`` with the day and label of each file, of those from ``first`` to ``last``, both included; undated ones are left out."""
    named = names.withColumn("__l", file_label(F.col(column)))
    return named.withColumns({"day": F.col("__l.day"), "label": F.col("__l.label")}).drop("__l").where(F.col("day").between(first, last))


def _value(text) -> object:
    try:
        return ast.literal_eval(text) if isinstance(text, str) else None
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None


_TEXT = T.StringType()


@F.pandas_udf(T.StructType([T.StructField(c, _TEXT) for c in ("id", "name", "username")]))
def person(text: pd.Series) -> pd.DataFrame:
    """id, name and user name of a literal dict; all null for anything else."""
    d = [v if isinstance(v := _value(x), dict) else {} for x in text]
    s = lambda v: None if v is None else str(v)
    first = lambda v, *keys: next((v[k] for k in keys if v.get(k) is not None), None)
    return pd.DataFrame({"id": [s(first(v, "id", "user_id")) for v in d], "name": [s(v.get("name")) for v in d], "username": [s(first(v, "username", "user")) for v in d]}, dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, _TEXT) for c in ("id", "username")])))
def people(text: pd.Series) -> pd.Series:
    """The dicts of a literal list that have an id or a user name."""

    def each(x):
        v = _value(x)
        rows = [m for m in v if isinstance(m, dict)] if isinstance(v, list) else []
        return [{"id": str(m.get("id") or m.get("username")), "username": str(m["username"]) if m.get("username") else None} for m in rows if m.get("id") or m.get("username")]

    return pd.Series([each(x) for x in text])


def normalize(rows: DataFrame) -> DataFrame:
    """Normalized events; rows without an id, a date or an author have none.

    The first reference that holds names the post's type; all are targets. Mentions are told apart by
    their own uid only, so an account may be a target twice in different ways.
    """
    r = rows.withColumns({"__who": person("user_info"), "__m": people("mentions"), "__at": parse_utc(F.col("created_at"))} | {f"__{k}": person(c) for _, c, k in REFERENCES})
    uid = F.coalesce("__who.id", "user")
    refs = F.array_compact(F.array(*[F.when(F.col(flag), target(k, F.coalesce(F.col(f"__{k}.id"), F.col(f"__{k}.username")), F.col(f"__{k}.username"))) for flag, _, k in REFERENCES]))
    once = F.filter("__m", lambda m, i: F.array_position(F.transform("__m", lambda x: x["id"]), m["id"]) == i + 1)
    mentions = F.transform(F.coalesce(once, F.array()), lambda m: target("mention", m["id"], m["username"]))
    none = lambda t: F.lit(None).cast(t)
    out = r.where(F.col("tweet_id").isNotNull() & F.col("__at").isNotNull() & uid.isNotNull())
    return out.select(
        F.lit(PLATFORM).alias("platform"), F.lit("post").alias("kind"), uid.alias("actor_uid"), F.col("user").alias("actor_handle"), none("string").alias("actor_display_name"), none("string").alias("actor_bio"),
        none("timestamp").alias("actor_created_at"), F.col("__at").alias("occurred_at"), F.col("tweet_id").cast("string").alias("cursor"), F.lit("").alias("cursor_account"), F.col("tweet_id").cast("string").alias("post_uid"),
        F.coalesce(F.get(refs, F.lit(0))["kind"], F.lit("original")).alias("post_type"), F.col("tweet_content").alias("text"), F.lit("pt").alias("lang"), F.concat(refs, mentions).alias("targets"),
        F.to_json(F.struct(*[c for c in rows.columns])).alias("raw"),
    ).select(*EVENT_COLUMNS)


def scan(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Events of one unpacked member, with the ``label`` and ``day`` of its name; and how many rows gave none."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    events = normalize(rows)
    named = file_label(F.lit(path))
    return events.withColumns({"label": named["label"], "day": named["day"]}), rows.count() - events.count()
