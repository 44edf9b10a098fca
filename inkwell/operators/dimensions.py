"""Expensive look-ups on distinct values: distinct -> map -> join. And the country dimension built that way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import accent_fold

# --- fixed values: aliases of countries, accents folded ---
COUNTRY_ALIASES = {
    "deutschland": "DEU", "espana": "ESP", "brasil": "BRA", "mexico": "MEX",
    "osterreich": "AUT", "uae": "ARE", "uk": "GBR", "scotland": "GBR",
    "england": "GBR", "wales": "GBR", "northern ireland": "GBR",
    "the netherlands": "NLD", "usa": "USA",
}
# -----------------------------------------------------------


def on_distinct(df: DataFrame, column: str, mapped: Column, name: str) -> DataFrame:
    """``mapped`` evaluated once for each distinct non-null value of ``column``: (column, name). Catalyst doesn't do this."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().select(column, mapped.alias(name))


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(COUNTRY_ALIASES.items()), "akey string, alias_iso3 string")


def country_words(c: Column) -> Column:
    """Words of a country as typed: accents folded, lower case, letters only; dotted or spaced abbreviations closed up."""
    letters = F.regexp_replace(F.lower(accent_fold(c)), r"[^a-z]+", " ")
    closed = F.regexp_replace(letters, r"(?<=\b[a-z]) (?=[a-z]\b)", "")
    return F.filter(F.split(closed, " "), lambda w: w != "")


def country_dimension(df: DataFrame, raw: str, names: DataFrame) -> DataFrame:
    """(raw, country_iso3, country): each distinct raw country with its entry, null if it has none.

    A name of ``names`` (iso3, name, alt_names), or an alias, counts wherever it stands in the value as whole words; of several
    the one that begins first, of those the longest. Every run of words, no longer than the longest name, is looked up by
    equality, so the work is in proportion to the distinct values. A key that is a name and an alias is a name; two entries of
    one key: the smaller code. Null and blank values have no entry.
    """
    listed = names.select("iso3", F.explode(F.concat(F.array("name"), F.coalesce("alt_names", F.array().cast("array<string>")))).alias("n")).select("iso3", F.array_join(country_words(F.col("n")), " ").alias("key"), F.lit(0).alias("pass"))
    aliases = alias_table(df.sparkSession).select(F.col("alias_iso3").alias("iso3"), F.array_join(country_words(F.col("akey")), " ").alias("key"), F.lit(1).alias("pass"))
    known = listed.unionByName(aliases).where("key <> ''").groupBy("key").agg(F.min_by("iso3", F.struct("pass", "iso3")).alias("iso3"))
    longest = known.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 0
    values = df.where(F.col(raw).isNotNull()).select(F.col(raw).alias("raw")).distinct().select("raw", country_words(F.col("raw")).alias("w"))
    starts = values.select("raw", "w", F.posexplode("w").alias("at", "_first"))
    runs = starts.select("raw", "at", F.explode(F.array(*[F.when(F.col("at") + n <= F.size("w"), F.struct(F.array_join(F.slice("w", F.col("at") + 1, F.lit(n)), " ").alias("key"), F.lit(n).alias("n"))) for n in range(1, longest + 1)])).alias("r")).where("r IS NOT NULL") if longest else None
    if runs is None:
        return values.select("raw", F.lit(None).cast("string").alias("country_iso3"), F.lit(None).cast("string").alias("country"))
    found = runs.select("raw", "at", "r.key", "r.n").join(known, "key").groupBy("raw").agg(F.min_by("iso3", F.struct("at", -F.col("n"))).alias("country_iso3"))
    named = names.groupBy(F.col("iso3").alias("country_iso3")).agg(F.min("name").alias("country"))
    return values.select("raw").join(found, "raw", "left").join(named, "country_iso3", "left").select("raw", "country_iso3", "country")
