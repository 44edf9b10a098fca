"""Structural invariants as counts of violations, which must be 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("violations"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of ``child`` that ``parent`` lacks (left anti join, so nulls can't empty the result)."""
    left = child.where(F.col(key).isNotNull()).select(key).distinct()
    return left.join(parent.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("violations"))


def overlapping(df: DataFrame, key: str, source: str, one: str, other: str) -> DataFrame:
    """Keys that have rows of both sources."""
    both = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max((F.col(source) == one).cast("int")).alias("a"), F.max((F.col(source) == other).cast("int")).alias("b"))
    return both.where("a = 1 AND b = 1").agg(F.count(F.lit(1)).alias("violations"))


def outside(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(allowed)).agg(F.count(F.lit(1)).alias("violations"))


def nulls(df: DataFrame, *columns: str) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.agg(F.count_if(bad).alias("violations"))


def checks(named: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in named.items():
        row = df.select(F.lit(name).alias("invariant"), F.col("violations"))
        out = row if out is None else out.unionByName(row)
    return out
