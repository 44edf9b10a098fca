"""Profiling of tables: nulls, keys, coverage, histograms, JSON keys, campaign statistics. Each is one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.silver import year


def null_shares(df: DataFrame) -> DataFrame:
    """(column_name, null_pct), most incomplete first."""
    one = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 2).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column_name", "null_pct").orderBy(F.desc("null_pct"), "column_name")


def key_integrity(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, non_null, distinct_values, duplicates), all columns in one aggregation."""
    one = df.agg(*[e for c in columns for e in (F.count(c).alias(f"{c}|n"), F.count_distinct(c).alias(f"{c}|d"))])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}|n`").alias("non_null"), F.col(f"`{c}|d`").alias("distinct_values"), (F.col(f"`{c}|n`") - F.col(f"`{c}|d`")).alias("duplicates")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def full_text_coverage(papers: DataFrame) -> DataFrame:
    pdf, pmc = F.col("pdf_json_files").isNotNull(), F.col("pmc_json_files").isNotNull()
    return papers.agg(
        F.count_if(pdf & ~pmc).alias("only_pdf"), F.count_if(pmc & ~pdf).alias("only_pmc"), F.count_if(pdf & pmc).alias("both"), F.count_if(~pdf & ~pmc).alias("neither"),
        F.count_if(F.coalesce(F.col("pdf_json_files"), F.lit("")).contains(";")).alias("several_pdf"),
    )


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """(column, count) without null, most frequent first; ties by value."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column)
    return out.limit(n) if n else out


def year_histogram(papers: DataFrame, first: int = 1950, last: int = 2021) -> DataFrame:
    return papers.select(year(F.col("publish_time")).alias("year")).where(F.col("year").between(first, last)).groupBy("year").count().orderBy("year")


def peak_year(papers: DataFrame) -> DataFrame:
    """The year with most papers; of several the earliest."""
    return year_histogram(papers).agg(F.max_by("year", F.struct("count", -F.col("year"))).alias("year"), F.max("count").alias("n"))


def json_key_frequency(df: DataFrame, column: str) -> DataFrame:
    """(key, n): in how many JSON objects of the column each top-level key occurs."""
    return df.select(F.explode(F.array_distinct(F.json_object_keys(column))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _no_keys() -> Column:
    return F.array().cast("array<string>")


def _list_at(text: Column, path: str) -> Column:
    """Elements of a JSON list as JSON texts; anything else is an empty list."""
    return F.coalesce(F.from_json(F.get_json_object(text, path), "array<string>"), _no_keys())


def json_level_keys(df: DataFrame, column: str, objects: dict[str, str], lists: dict[str, str]) -> DataFrame:
    """(level, key, n): how often each key occurs at several levels of JSON texts.

    ``objects`` and ``lists`` name the levels by JSON paths: of an object, and of a list whose objects are all counted.
    One pass; what isn't of the expected kind has no keys.
    """
    keys = {name: F.coalesce(F.json_object_keys(F.get_json_object(column, path)), _no_keys()) for name, path in objects.items()}
    for name, path in lists.items():
        keys[name] = F.flatten(F.transform(_list_at(F.col(column), path), lambda x: F.coalesce(F.json_object_keys(x), _no_keys())))
    named = [F.struct(F.lit(name).alias("level"), k.alias("keys")) for name, k in keys.items()]
    per_level = df.select(F.inline(F.array(*named))).select("level", F.explode("keys").alias("key"))
    return per_level.groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"))


def paper_json_profile(df: DataFrame, source: str, column: str) -> DataFrame:
    """(source, n, with_abstract, empty_body, no_authors, authors, affiliated, top_keys): what the JSON papers of each source have."""
    text = F.col(column)
    authors = _list_at(text, "$.metadata.authors")
    filled = F.size(F.filter(authors, lambda a: F.coalesce(F.size(F.json_object_keys(F.get_json_object(a, "$.affiliation"))), F.lit(0)) > 0))
    rows = df.select(
        F.col(source).alias("source"), F.coalesce(F.json_object_keys(text), _no_keys()).alias("keys"), F.size(_list_at(text, "$.body_text")).alias("body"), F.size(authors).alias("authors"), filled.alias("filled")
    )
    whole = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("keys", "abstract")).alias("with_abstract"), F.count_if(F.col("body") == 0).alias("empty_body"), F.count_if(F.col("authors") == 0).alias("no_authors"),
        F.sum("authors").alias("authors"), F.sum("filled").alias("affiliated"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys")))), ",").alias("top_keys"),
    )
    return whole


def pivot_means(df: DataFrame, index: str, column: str, value: str, names: list[str]) -> DataFrame:
    """(index, names..., total): mean value of each named column and their sum, as for the stages of a run. A missing one is null."""
    wide = df.groupBy(index).pivot(column, names).agg(F.avg(value))
    return wide.select(index, *names, sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0)).alias("total"))


def curve(df: DataFrame, x: str, value: str, digits: int = 4) -> DataFrame:
    """(x, mean, least, most, failed): a curve with its bars; a null value is a failed run, an x with failures only has a null mean."""
    return df.groupBy(x).agg(F.round(F.avg(value), digits).alias("mean"), F.round(F.min(value), digits).alias("least"), F.round(F.max(value), digits).alias("most"), F.count_if(F.col(value).isNull()).alias("failed"))


def failed_points(df: DataFrame, x: str, value: str) -> DataFrame:
    """The x values at which some run failed."""
    return df.where(F.col(value).isNull()).select(x).distinct()


def threads_per_worker(threads: str, workers: str) -> Column:
    return F.round(F.col(threads) / F.col(workers)).cast("int")


def group_stats(df: DataFrame, keys: list[str], value: str, digits: int = 4) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.round(F.avg(value), digits).alias("mean"), F.round(F.min(value), digits).alias("least"), F.round(F.max(value), digits).alias("most"), F.count(value).alias("n")
    )


def speedup(df: DataFrame, size: str, seconds: str) -> DataFrame:
    """(size, seconds, speedup, efficiency, serial_share) against the smallest size, as Amdahl's law has it."""
    means = df.groupBy(size).agg(F.avg(seconds).alias("seconds"))
    base = means.agg(F.min_by("seconds", size).alias("t1"), F.min(size).alias("s1"))
    ratio, by = F.col("t1") / F.col("seconds"), F.col(size) / F.col("s1")
    return means.join(F.broadcast(base)).select(  # the base is one row
        size, F.round("seconds", 4).alias("seconds"), F.round(ratio, 4).alias("speedup"), F.round(ratio / by, 4).alias("efficiency"), F.round(F.when(by > 1, (by / ratio - 1) / (by - 1)), 4).alias("serial_share")
    )


def source_profile(df: DataFrame, source: str, flags: dict[str, str]) -> DataFrame:
    """Per source: rows and the count of each named condition (SQL)."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(cond)).alias(name) for name, cond in flags.items()])
