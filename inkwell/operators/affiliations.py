"""Best and worst represented countries and institutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import strip


def usable(c: Column, min_length: int = 1) -> Column:
    """Stripped value; null for blanks, for the words none, nan, null and <na>, and for what is too short."""
    s = strip(c)
    return F.when(~F.lower(s).isin("", "none", "nan", "null", "<na>") & (F.length(s) >= min_length), s)


def country_counts(df: DataFrame) -> DataFrame:
    """(country_iso3, country, paper_count); a missing code counts as ''."""
    named = df.select(F.coalesce(usable(F.col("country_iso3"), 2), F.lit("")).alias("country_iso3"), usable(F.col("country"), 2).alias("country"))
    return named.where(F.col("country").isNotNull()).groupBy("country_iso3", "country").agg(F.count(F.lit(1)).alias("paper_count"))


def value_counts(df: DataFrame, column: str, count: str = "paper_count", min_length: int = 1) -> DataFrame:
    """(column, count) of the usable values."""
    return df.select(usable(F.col(column), min_length).alias(column)).where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(count))


def top(counts: DataFrame, count: str, name: str, n: int) -> DataFrame:
    return counts.orderBy(F.desc(count), F.asc(name)).limit(n)


def bottom(counts: DataFrame, count: str, n: int, at_least: int = 1) -> DataFrame:
    """The n rarest with at least ``at_least``; ties by the first column (the code for countries)."""
    ties = [c for c in counts.columns if c != count]
    return counts.where(F.col(count) >= at_least).orderBy(F.asc(count), *[F.asc(c) for c in ties]).limit(n)
