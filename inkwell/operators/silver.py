"""Cleaning and flagging of the raw tables: papers, paragraphs, authors and their rollups.

Objective errors are repaired and flags added; nothing is dropped that an analysis might want.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import clean_str, collapse, nfkc, strip, title_norm
from inkwell.operators.partitioning import fits_broadcast, maybe_among
from inkwell.session import written

# --- fixed values ---
DEAD_COLUMNS = ["mag_id", "arxiv_id", "who_covidence_id"]
REFERENCE_SECTION = r"(?:referen|bibliograph|acknowledg|author contrib|conflict|competing interest|funding|declarat|supplement|copyright)"
EDGE_PUNCTUATION = " ,;.-\t"
# --------------------


def year(publish_time: Column) -> Column:
    """First four characters as a number; anything else is null."""
    return F.substring(publish_time, 1, 4).try_cast("smallint")


def tidy_source(c: Column) -> Column:
    return F.lower(strip(c))


def reference_like(section: Column) -> Column:
    """Section title that announces references, declarations and the like; null means no."""
    return F.lower(F.coalesce(section, F.lit(""))).rlike(REFERENCE_SECTION)


def norm_institution(c: Column) -> Column:
    return F.nullif(F.btrim(collapse(nfkc(c)), F.lit(EDGE_PUNCTUATION)), F.lit(""))


def richest(df: DataFrame, key: str, rank: Column) -> DataFrame:
    """One row per key, the one of highest rank; ties go to the smallest row in column order, null first.

    An aggregation, so each partition sends at most one row per key and a hot key stays harmless. A null key is a key.
    """
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct((-rank).alias("r"), *rest)).alias("x"))
    return best.select(key, "x.*").select(*df.columns)


def papers(df: DataFrame) -> DataFrame:
    """One row per cord_uid with year, has_pdf, has_pmc, title flags and a tidied abstract; dead columns dropped."""
    flagged = df.drop(*DEAD_COLUMNS).withColumns({"year": year(F.col("publish_time")), "has_pdf": F.col("pdf_json_files").isNotNull(), "has_pmc": F.col("pmc_json_files").isNotNull()})
    one = richest(flagged, "cord_uid", F.col("has_pdf").cast("int") + F.col("has_pmc").cast("int"))
    return title_flags(one.withColumn("abstract", strip(collapse(F.col("abstract")))))


def title_flags(df: DataFrame, title: str = "title") -> DataFrame:
    """title_norm, title_dup_count, title_ok, is_title_unique. A null or blank title has no norm, count or uniqueness.

    Counting is a grouped join and not a window, so a title that a third of the rows share is pre-aggregated.
    """
    normed = df.withColumn("title_norm", title_norm(F.col(title)))
    counts = normed.where(F.col("title_norm").isNotNull()).groupBy("title_norm").agg(F.count(F.lit(1)).cast("int").alias("title_dup_count"))
    return normed.join(counts, "title_norm", "left").withColumns(
        {"title_ok": F.col(title).isNotNull() & (F.length(strip(F.col(title))) >= 3), "is_title_unique": F.col("title_dup_count") == 1}
    )


def prefer_source(df: DataFrame, key: str = "cord_uid", source: str = "source", preferred: str = "pmc") -> DataFrame:
    """Rows of the preferred source, and all rows of keys that have none. Null keys are kept.

    The keys that lack the source come from an aggregation of two columns; other rows are kept by a semi join with them. Where
    the keys may be too many to send, they are written and a filter of fixed size keeps nearly all rows that fall away, and
    their texts, out of the join's shuffle.
    """
    is_preferred = F.coalesce(tidy_source(F.col(source)) == preferred, F.lit(False))
    has = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(is_preferred).alias("has"))
    lacking, others = has.where(~F.col("has")).select(key), df.where(~is_preferred)
    if fits_broadcast(df.select(key)):
        kept = others.join(lacking, key, "left_semi")
    else:  # the keys are distinct; a semi join would be pushed below the filter
        lacking = written(lacking, "lacking")
        kept = maybe_among(others, key, lacking).join(lacking, key)
    return df.where(is_preferred).unionByName(kept.select(*df.columns)).unionByName(others.where(F.col(key).isNull()))


def paragraphs(df: DataFrame) -> DataFrame:
    return prefer_source(df).withColumns({"section": clean_str(F.col("section")), "is_reference_like": reference_like(F.col("section"))})


def authors(df: DataFrame, countries: DataFrame) -> DataFrame:
    """With institution_norm, country_iso3 and the country's name; ``countries``: (raw, country_iso3, country)."""
    normed = df.withColumn("institution_norm", norm_institution(F.col("institution"))).drop("country")
    return normed.join(countries.withColumnRenamed("raw", "country_raw"), "country_raw", "left")


def paper_rollup(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows whose last column isn't null (paper and country, paper and institution)."""
    return df.where(F.col(columns[-1]).isNotNull()).select(*columns).distinct()
