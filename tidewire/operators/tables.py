"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to spark.checkpoint.dir (an own folder where it is unset) and read again."""
    spark = df.sparkSession
    top = (spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints/tidewire").rstrip("/")
    path = f"{top}/tidewire-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
