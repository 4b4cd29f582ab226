"""Checks of tables: conditions, keys, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the canonical tables, as conditions that must hold.
RULES: dict[str, dict[str, str]] = {
    "actor": {"tier": "tier IN ('A', 'B', 'C')", "public_reason": "NOT coalesce(is_public_figure, false) OR public_figure_reason IS NOT NULL"},
    "collection_run": {"kind": "kind IN ('baseline', 'campanha')", "label": "kind <> 'campanha' OR campaign_label IS NOT NULL", "cost": "cost_usd >= 0", "status": "status IN ('running', 'ok', 'partial', 'failed')"},
    "post": {"post_type": "post_type IN ('original', 'repost', 'reply', 'quote')"},
    "interaction": {"kind": "kind IN ('repost', 'reply', 'quote', 'mention')", "loop": "src <> dst"},
    "edge_window": {"weight": "weight > 0", "loop": "src <> dst", "kind": "kind IN ('repost', 'reply', 'quote', 'mention')"},
}


def broken(df: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """Rows that break a rule (or leave it unknown), with the first one broken."""
    name = F.lit(None).cast("string")
    for k, rule in reversed(rules.items()):
        holds = F.expr(rule) if isinstance(rule, str) else rule
        name = F.when(~F.coalesce(holds, F.lit(False)), k).otherwise(name)
    return df.withColumn("broken", name).where("broken IS NOT NULL")


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_keys(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of ``df`` that ``other`` lacks."""
    return df.select(*key).distinct().join(other, key, "left_anti")


def require(df: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """``df``; reading a row that breaks a rule is an error."""
    for k, rule in rules.items():
        holds = F.expr(rule) if isinstance(rule, str) else rule
        df = df.where(F.when(F.coalesce(holds, F.lit(False)), True).otherwise(F.raise_error(f"rule {k} is broken").cast("boolean")))
    return df
