"""Streaming ingestion: JSON-lines files to normalized tables, and windows that follow late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.functions.times import week_start
from tidewire.operators import edges, ingest
from tidewire.operators.tables import staged
from tidewire.sources import firehose


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def forget(spark: SparkSession, out: str, dead: DataFrame) -> int:
    """Take texts and payloads of the posts in ``dead`` (platform, post_uid, gone_at) out of the tables; how many posts were not known.

    Weeks with such a post are written to the side and then put in place of what was there.
    """
    unknown = 0
    for table in ("post", "raw"):
        old = _table(spark, f"{out}/{table}")
        if old is None:
            return dead.count()
        weeks = [r[0] for r in old.join(dead, ["platform", "post_uid"], "left_semi").select("window_start").distinct().collect()]  # a week a row
        old = old.where(F.col("window_start").isin(weeks))
        if table == "post":
            unknown = dead.join(old, ["platform", "post_uid"], "left_anti").count()
            new = ingest.apply_deletes(old, old.select("platform", "post_uid"), dead)[0].select(*old.columns)
        else:
            hit = F.col("gone_at").isNotNull()
            new = old.join(dead, ["platform", "post_uid"], "left").withColumn("payload", F.when(~hit, F.col("payload"))).select(*old.columns)
        if weeks:
            staged(new, "forget").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_start").parquet(f"{out}/{table}")
    return unknown


def land(batch: DataFrame, out: str, batch_id: int = 0) -> None:
    """One micro-batch: new posts and interactions are appended, the weeks they touch are counted again as wholes.

    A batch may come twice: what is there already isn't added again, and a week's edges are replaced
    by the same edges. Deleted posts lose their text and their raw payloads, in the weeks that have any
    of them; their edges stay. ``run`` has a row of each batch, with deletes of posts that are not known.
    """
    spark = batch.sparkSession
    events = batch.persist()
    posts, inter = _table(spark, f"{out}/post"), _table(spark, f"{out}/interaction")
    new = ingest.new_interactions(events, inter).withColumn("window_start", week_start(F.col("occurred_at"))).persist()
    fresh = ingest.new_posts(events, posts).withColumn("window_start", week_start(F.col("created_at"))).persist()
    counted = ingest.counters(events, fresh).first().asDict()  # before the posts are written: what reads them is computed anew then
    fresh.write.mode("append").partitionBy("window_start").parquet(f"{out}/post")
    ingest.raw_archive(events, batch_id).withColumn("window_start", week_start(F.col("occurred_at"))).write.mode("append").partitionBy("window_start").parquet(f"{out}/raw")
    dead, unknown = ingest.tombstones(events), 0
    if not dead.isEmpty():
        dead.write.mode("append").parquet(f"{out}/tombstone")
        unknown = forget(spark, out, dead)
    row = {"batch": batch_id, **counted, "unknown_deletes": unknown}
    spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} bigint" for c in row)).write.mode("append").parquet(f"{out}/run")
    fresh.unpersist()
    ingest.sightings(events).select("platform", "uid", "handle", "display_name", "bio", "tier", "seen_at").write.mode("append").parquet(f"{out}/sighting")
    weeks = [r[0] for r in events.where("kind = 'post'").select(week_start(F.col("occurred_at")).alias("w")).distinct().collect()]
    new.write.mode("append").partitionBy("window_start").parquet(f"{out}/interaction")
    if weeks and (all_ := _table(spark, f"{out}/interaction")) is not None:
        touched = all_.where(F.col("window_start").isin(weeks)).withColumn("label", F.lit(None).cast("string"))
        edges.aggregate(touched).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_start", "scope").parquet(f"{out}/edge_window")
    new.unpersist()
    events.unpersist()


def start(spark: SparkSession, source_dir: str, out: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Run over the files there are, remembering where it was: one checkpoint folder for each source.

    No watermark: an event is taken however late it is, and the tables tell repeats.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source_dir)
    events = firehose.normalize(firehose.parse(lines))
    return events.writeStream.foreachBatch(lambda df, k: land(df, out, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_counts(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Posts per week as a stream: tumbling weeks from Monday (the epoch is a Thursday)."""
    w = F.window("occurred_at", "7 days", "7 days", "4 days")
    return events.where("kind = 'post'").withWatermark("occurred_at", delay).groupBy(w.alias("w"), "post_type").agg(F.count(F.lit(1)).alias("posts")).select(F.col("w.start").cast("date").alias("window_start"), "post_type", "posts")
