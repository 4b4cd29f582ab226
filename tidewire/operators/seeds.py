"""Choosing and keeping seed accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.times import year_week

TIERS = {"C": 0, "B": 1, "A": 2}


def actor_counts(actors: DataFrame, interactions: DataFrame) -> DataFrame:
    """Actors with received and sent: counted first, then joined."""
    n = lambda end, name: interactions.groupBy(F.col(end).alias("actor_id")).agg(F.count(F.lit(1)).alias(name))
    out = actors.join(n("dst", "received"), "actor_id", "left").join(n("src", "sent"), "actor_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("received", "sent")})


def candidates(interactions: DataFrame, limit: int, exclude: DataFrame | None = None) -> DataFrame:
    """Accounts by distinct targets, then volume. Known seeds are left out before the limit, not after."""
    out = interactions if exclude is None else interactions.join(exclude.select(F.col("actor_id").alias("src")), "src", "left_anti")
    sent = out.groupBy(F.col("src").alias("actor_id")).agg(F.count_distinct("dst").alias("targets"), F.count(F.lit(1)).alias("interactions"), F.count_distinct(year_week(F.col("occurred_at"))).alias("weeks"))
    got = interactions.groupBy(F.col("dst").alias("actor_id")).agg(F.count(F.lit(1)).alias("received"))
    c = sent.join(got, "actor_id", "left").withColumn("received", F.coalesce("received", F.lit(0)))
    wide, loud = F.col("targets") >= 3, F.col("received") > 3 * F.col("targets")
    kind = F.when(wide & loud, "both").when(loud, "voice").when(wide, "factory").otherwise("little")
    return c.withColumn("kind", kind).orderBy(F.desc("targets"), F.desc("interactions"), "actor_id").limit(limit)


def search(actors: DataFrame, interactions: DataFrame, part: str, limit: int = 20) -> DataFrame:
    """Actors whose handle has ``part`` in it, in any case, busiest first."""
    text = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    found = actors.where(F.col("handle").ilike(f"%{text}%")).select("actor_id", "handle")
    return actor_counts(found, interactions).orderBy(F.desc("received"), F.desc("sent"), "handle").limit(limit)


def upsert(actors: DataFrame, seen: DataFrame) -> DataFrame:
    """Actors (platform, uid, handle, display_name, bio, tier, first_seen, last_seen) after some more sightings (…, seq, seen_at).

    A tier only rises; the last handle that is not null stays, and names and bios are kept where the new ones are null.
    """
    rank = F.when(F.col("tier") == "A", 2).when(F.col("tier") == "B", 1).otherwise(0)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    new = seen.groupBy("platform", "uid").agg(last("handle"), last("display_name"), last("bio"), F.max(rank).alias("rank"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    old = actors.select("platform", "uid", *[F.col(c).alias(f"old_{c}") for c in ("handle", "display_name", "bio", "first_seen", "last_seen")], rank.alias("old_rank"))
    j = old.join(new, ["platform", "uid"], "full_outer")
    top = F.greatest(F.coalesce("rank", F.lit(0)), F.coalesce("old_rank", F.lit(0)))
    return j.select("platform", "uid", *[F.coalesce(c, f"old_{c}").alias(c) for c in ("handle", "display_name", "bio")], F.when(top == 2, "A").when(top == 1, "B").otherwise("C").alias("tier"), F.least("first_seen", "old_first_seen").alias("first_seen"), F.greatest("last_seen", "old_last_seen").alias("last_seen"))


def demote(actors: DataFrame, names: DataFrame) -> DataFrame:
    """``actors`` with those of ``names`` (handle or uid) back in tier C; history stays."""
    n = names.select(F.lower(F.col(names.columns[0])).alias("n")).distinct()
    hit = F.col("n").isNotNull()
    by_handle = actors.join(n, F.lower("handle") == F.col("n"), "left")
    return by_handle.withColumn("tier", F.when(hit, "C").otherwise(F.col("tier"))).drop("n")
