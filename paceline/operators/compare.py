"""Differences between two cohorts' results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.numeric import round_exact

LEAST_DELTA = 0.05  # fixed value: five percentage points


def _compare(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares of A minus shares of B; a side that lacks a row counts as the population share."""
    left = a.select(*keys, F.col("segment_pct").alias("a"), F.col("population_pct").alias("a_base"))
    right = b.select(*keys, F.col("segment_pct").alias("b"), F.col("population_pct").alias("b_base"))
    joined = left.join(right, list(keys), "full_outer").select(
        *keys,
        F.coalesce("a", "b_base").alias("a_pct"),
        F.coalesce("b", "a_base").alias("b_pct"),
    )
    return (
        joined.withColumn("delta", round_exact("a_pct - b_pct"))
        .filter(F.abs("delta") >= LEAST_DELTA)
        .orderBy(F.abs("delta").desc(), *keys)
    )


def compare_discoveries(a: DataFrame, b: DataFrame) -> DataFrame:
    return _compare(a, b, ["event"])


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    return _compare(a, b, ["property", "value"])


HIGHLIGHTS = 5


def highlights(compared: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """The largest differences as ``(rank, item, segment_a, a_pct, segment_b, b_pct, delta)``."""
    keys = [c for c in ("event", "property", "value") if c in compared.columns]
    top = compared.orderBy(F.abs("delta").desc(), *keys).limit(HIGHLIGHTS)
    order = Window.partitionBy(F.lit(0)).orderBy(F.abs("delta").desc(), *keys)  # of five rows
    return top.select(
        F.row_number().over(order).alias("rank"), F.concat_ws("=", *keys).alias("item"), F.lit(label_a).alias("segment_a"), "a_pct",
        F.lit(label_b).alias("segment_b"), "b_pct", "delta",
    )
