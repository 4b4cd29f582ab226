"""Firehose events (JSON lines): scan and normalization, in column expressions."""

from __future__ import annotations

from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.times import from_micros, parse_utc

from .events import EVENT_COLUMNS, TARGET, target

PLATFORM = "bluesky"
POST, REPOST = "app.bsky.feed.post", "app.bsky.feed.repost"
SCHEMA = """did string, time_us bigint, kind string, identity struct<did: string, handle: string, seq: bigint, time: string>,
commit struct<rev: string, operation: string, collection: string, rkey: string, cid: string, record: struct<`$type`: string, text: string, createdAt: string, langs: array<string>,
  subject: struct<uri: string, cid: string>, reply: struct<root: struct<uri: string, cid: string>, parent: struct<uri: string, cid: string>>,
  embed: struct<`$type`: string, record: struct<uri: string, record: struct<uri: string>>>,
  facets: array<struct<features: array<struct<`$type`: string, did: string>>>>>>"""
MOST_ACCOUNTS, MOST_COLLECTIONS = 10_000, 100


def url(host: str, collections: list[str], accounts: list[str] = (), cursor: int | None = None) -> str:
    """The subscription's address; the service's bounds are checked here."""
    if len(accounts) > MOST_ACCOUNTS or len(collections) > MOST_COLLECTIONS:
        raise ValueError("too many accounts or collections for one subscription")
    q = [("wantedCollections", c) for c in collections] + [("wantedDids", a) for a in accounts] + ([("cursor", str(cursor))] if cursor is not None else [])
    return f"wss://{host}/subscribe?{urlencode(q)}"


def uri_parts(uri: Column) -> Column:
    """(did, collection, rkey, rid) of ``at://did/collection/rkey``; null for anything else."""
    part = lambda i: F.regexp_extract(uri, r"^at://([^/]+)/([^/]+)/([^/]+)$", i)
    s = F.struct(part(1).alias("did"), part(2).alias("collection"), part(3).alias("rkey"), F.concat_ws("/", part(1), part(2), part(3)).alias("rid"))
    return F.when(part(1) != "", s)


def quoted_uri(embed: Column) -> Column:
    kind = embed["$type"]
    return F.when(kind == "app.bsky.embed.record", embed["record"]["uri"]).when(kind == "app.bsky.embed.recordWithMedia", embed["record"]["record"]["uri"])


def mentioned(facets: Column, own: Column) -> Column:
    """Distinct accounts that the facets mention, but the author."""
    each = F.flatten(F.transform(F.coalesce(facets, F.array()), lambda f: F.filter(F.coalesce(f["features"], F.array()), lambda x: x["$type"] == "app.bsky.richtext.facet#mention")))
    dids = F.filter(F.transform(each, lambda x: x["did"]), lambda d: d.isNotNull() & (d != own))
    return F.array_distinct(dids)


def parse(lines: DataFrame) -> DataFrame:
    """Lines of text (``value``) as raw events with ``raw``; blank lines and // comments are skipped."""
    kept = lines.where("trim(value) <> '' AND NOT ltrim(value) LIKE '//%'")
    return kept.select(F.from_json("value", SCHEMA).alias("e"), F.col("value").alias("raw")).select("e.*", "raw")


def normalize(events: DataFrame) -> DataFrame:
    """Normalized events; what can't be used has no row."""
    r, did = F.col("commit.record"), F.col("did")
    is_post, is_repost = F.col("commit.collection") == POST, F.col("commit.collection") == REPOST
    gone = F.col("commit.operation") == "delete"
    kind = F.when(F.col("kind") == "identity", "identity").when((F.col("kind") == "commit") & (is_post | is_repost), F.when(gone, "delete").when((F.col("commit.operation") == "create") & r.isNotNull(), "post"))
    to = lambda k, uri: F.when(uri_parts(uri)["did"] != did, target(k, uri_parts(uri)["did"], post_uid=uri_parts(uri)["rid"]))
    reply = r["reply"]["parent"]["uri"]
    quote = quoted_uri(r["embed"])
    mentions = F.transform(mentioned(r["facets"], did), lambda d: target("mention", d))
    own = F.array_compact(F.concat(F.array(to("reply", reply), to("quote", quote)), mentions))
    targets = F.when(is_repost, F.array_compact(F.array(to("repost", r["subject"]["uri"])))).when(is_post, own).otherwise(F.expr(f"cast(array() as array<{TARGET}>)"))
    post_type = F.when(is_repost, "repost").when(reply.isNotNull(), "reply").when(quote.isNotNull() & uri_parts(quote).isNotNull(), "quote").otherwise("original")
    none = lambda t: F.lit(None).cast(t)
    out = events.withColumn("__kind", kind).where(F.col("__kind").isNotNull() & did.isNotNull())
    # a repost of one's own is no event
    out = out.where(~((F.col("__kind") == "post") & F.coalesce(is_repost, F.lit(False)) & (F.size(targets) == 0)))
    post = F.col("__kind") == "post"
    return out.select(
        F.lit(PLATFORM).alias("platform"), F.col("__kind").alias("kind"), did.alias("actor_uid"), F.when(F.col("__kind") == "identity", F.col("identity.handle")).alias("actor_handle"),
        none("string").alias("actor_display_name"), none("string").alias("actor_bio"), none("timestamp").alias("actor_created_at"),
        F.coalesce(F.when(post, parse_utc(r["createdAt"])), from_micros(F.col("time_us"))).alias("occurred_at"), F.col("time_us").cast("string").alias("cursor"), F.lit("").alias("cursor_account"),
        F.when(F.col("__kind") != "identity", F.concat_ws("/", did, "commit.collection", "commit.rkey")).alias("post_uid"), F.when(post, post_type).alias("post_type"),
        F.when(post, r["text"]).alias("text"), F.when(post, F.get(r["langs"], F.lit(0))).alias("lang"), targets.alias("targets"), "raw",
    ).select(*EVENT_COLUMNS)


def scan(spark: SparkSession, path: str, cursor: int | None = None, accounts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Events of a JSON-lines file after ``cursor`` (of ``accounts``, if given), and (skipped): lines that gave none."""
    raw = parse(spark.read.text(path))
    if cursor is not None:
        raw = raw.where(F.col("time_us") > cursor)
    if accounts is not None:
        raw = raw.join(accounts.select("did"), "did", "left_semi")
    events = normalize(raw)
    skipped = raw.agg(F.count(F.lit(1)).alias("n")).crossJoin(events.agg(F.count(F.lit(1)).alias("m"))).select((F.col("n") - F.col("m")).alias("skipped"))
    return events, skipped
