"""From normalized events to actors, posts, interactions and the raw archive; every write may be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seeds import upsert


def _first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    k = ", ".join(key)
    return df.withColumn("__n", F.expr(f"row_number() OVER (PARTITION BY {k} ORDER BY {order})")).where("__n = 1").drop("__n")


def new_posts(events: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Posts not yet there; of repeats in the batch the first stays. Tombstones count as there."""
    p = events.where("kind = 'post' AND post_uid IS NOT NULL").select("platform", "post_uid", "actor_uid", F.col("occurred_at").alias("created_at"), "lang", "text", "post_type", "cursor", F.lit(None).cast("timestamp").alias("deleted_at"))
    p = _first(p, ["platform", "post_uid"], "created_at, cursor")
    return p if posts is None else p.join(posts, ["platform", "post_uid"], "left_anti")


def new_interactions(events: DataFrame, interactions: DataFrame | None = None) -> DataFrame:
    """(platform, post_uid, src, dst, kind, occurred_at), no loops, one for each (post, kind, dst)."""
    i = events.where("kind = 'post'").select("platform", "post_uid", F.col("actor_uid").alias("src"), "occurred_at", F.explode("targets").alias("t"))
    i = i.select("platform", "post_uid", "src", F.col("t.uid").alias("dst"), F.col("t.kind").alias("kind"), "occurred_at").where("src <> dst").dropDuplicates(["platform", "post_uid", "kind", "dst"])
    return i if interactions is None else i.join(interactions, ["platform", "post_uid", "kind", "dst"], "left_anti")


def sightings(events: DataFrame, author_tier: str = "C") -> DataFrame:
    """What the events say about actors, authors and targets, in the form that ``seeds.upsert`` takes."""
    seq = F.struct("occurred_at", "cursor")
    own = events.select("platform", F.col("actor_uid").alias("uid"), F.col("actor_handle").alias("handle"), F.col("actor_display_name").alias("display_name"), F.col("actor_bio").alias("bio"), F.lit(author_tier).alias("tier"), seq.alias("seq"), F.col("occurred_at").alias("seen_at"))
    to = events.select("platform", F.explode("targets").alias("t"), seq.alias("seq"), F.col("occurred_at").alias("seen_at"))
    return own.where("uid IS NOT NULL").unionByName(to.select("platform", F.col("t.uid").alias("uid"), F.col("t.handle").alias("handle"), F.col("t.display_name").alias("display_name"), F.col("t.bio").alias("bio"), F.lit("C").alias("tier"), "seq", "seen_at"))


def raw_archive(events: DataFrame, run_id: int, deleted: DataFrame | None = None) -> DataFrame:
    """(run_id, platform, post_uid, payload, occurred_at): the last payload of each post in the run; posts known as deleted are not archived again."""
    last = events.where("kind = 'post' AND raw IS NOT NULL").groupBy("platform", "post_uid").agg(F.max_by("raw", "cursor").alias("payload"), F.max_by("occurred_at", "cursor").alias("occurred_at"))
    r = last.select(F.lit(run_id).alias("run_id"), "platform", "post_uid", "payload", "occurred_at")
    return r if deleted is None else r.join(deleted, ["platform", "post_uid"], "left_anti")


def tombstones(events: DataFrame) -> DataFrame:
    return events.where("kind = 'delete'").groupBy("platform", "post_uid").agg(F.min("occurred_at").alias("gone_at"))


def apply_deletes(posts: DataFrame, raw: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posts without the text of deleted ones (edges stay), the raw archive without them in any run, and how many were unknown."""
    p = posts.join(dead, ["platform", "post_uid"], "left")
    hit = F.col("gone_at").isNotNull()
    p = p.withColumns({"text": F.when(~hit, F.col("text")), "deleted_at": F.coalesce("deleted_at", "gone_at")}).drop("gone_at")
    unknown = dead.join(posts, ["platform", "post_uid"], "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    return p, raw.join(dead, ["platform", "post_uid"], "left_anti"), unknown


def active(posts: DataFrame) -> DataFrame:
    """Posts that were not deleted."""
    return posts.where("deleted_at IS NULL")


RUN = "run_id int, status string, frame string, items int, cost_usd double"


def open_run(runs: DataFrame | None, spark, run_id: int, frame: str | None) -> DataFrame:
    """``runs`` with one more, open, and what it set out to cover."""
    new = spark.createDataFrame([(run_id, "open", frame, 0, 0.0)], RUN)
    return new if runs is None else runs.unionByName(new)


def close_run(runs: DataFrame, run_id: int, status: str, items: int, cost_usd: float, frame: str | None = None) -> DataFrame:
    """``runs`` with one closed, failed ones with what they cost till then; without a new frame the opening one stays."""
    if status not in ("ok", "partial", "failed"):
        raise ValueError(f"unknown status {status!r}")
    new = {"status": F.lit(status), "items": F.lit(items), "cost_usd": F.lit(cost_usd), "frame": F.coalesce(F.lit(frame).cast("string"), F.col("frame"))}
    return runs.withColumns({c: F.when(F.col("run_id") == run_id, x).otherwise(F.col(c)) for c, x in new.items()})


def merge_cursors(old: DataFrame, new: DataFrame) -> DataFrame:
    """The cursors of all sources and accounts, each the further of both."""
    far = F.max_by("cursor", F.struct(F.length("cursor"), "cursor"))
    return old.unionByName(new).groupBy("source", "account").agg(far.alias("cursor"))


def cursors(events: DataFrame, source: str) -> DataFrame:
    """(source, account, cursor): the furthest of each account."""
    far = F.max_by("cursor", F.struct(F.length("cursor"), "cursor"))
    return events.groupBy(F.lit(source).alias("source"), F.col("cursor_account").alias("account")).agg(far.alias("cursor"))


def counters(events: DataFrame, posts: DataFrame) -> DataFrame:
    """One row: events seen, posts, new posts, repeats, deletes, identities."""
    n = events.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("kind") == "post").alias("post_events"), F.count_if(F.col("kind") == "delete").alias("deletes"), F.count_if(F.col("kind") == "identity").alias("identities"))
    return n.crossJoin(posts.agg(F.count(F.lit(1)).alias("new_posts"))).withColumn("repeats", F.col("post_events") - F.col("new_posts"))


def snapshots(profiles: DataFrame) -> DataFrame:
    """The last counts of each actor and day."""
    s = F.struct("followers", "following", "posts")
    return profiles.groupBy("actor_id", F.to_date("seen_at").alias("snapshot_date")).agg(F.max_by(s, "seen_at").alias("s")).select("actor_id", "snapshot_date", "s.*")


__all__ = ["active", "apply_deletes", "close_run", "merge_cursors", "open_run", "counters", "cursors", "new_interactions", "new_posts", "raw_archive", "sightings", "snapshots", "tombstones", "upsert"]
