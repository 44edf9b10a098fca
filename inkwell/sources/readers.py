"""Reading the raw catalogue, the parsed papers and word-vector files. Schemas are declared, nothing is inferred."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.text import clean_str, strip
from inkwell.sources.writers import write_parquet

# --- fixed values: what counts as missing in the catalogue, and its columns ---
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
CATALOGUE = ["cord_uid", "sha", "source_x", "title", "doi", "pmcid", "pubmed_id", "license", "abstract", "publish_time", "authors", "journal", "mag_id", "who_covidence_id", "arxiv_id", "pdf_json_files", "pmc_json_files", "url", "s2_id"]
# ------------------------------------------------------------------------------

_TEXT = T.StringType()
PAPER = T.StructType(
    [
        T.StructField("paper_id", _TEXT),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("title", _TEXT),
                    T.StructField(
                        "authors",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("first", _TEXT),
                                    T.StructField("last", _TEXT),
                                    T.StructField("affiliation", T.StructType([T.StructField("institution", _TEXT), T.StructField("location", T.StructType([T.StructField("settlement", _TEXT), T.StructField("country", _TEXT)]))])),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        ),
        T.StructField("abstract", T.ArrayType(T.StructType([T.StructField("text", _TEXT), T.StructField("section", _TEXT)]))),
        T.StructField("body_text", T.ArrayType(T.StructType([T.StructField("text", _TEXT), T.StructField("section", _TEXT)]))),
    ]
)


def read_catalogue(spark: SparkSession, path: str, columns: list[str] = CATALOGUE) -> DataFrame:
    """The CSV catalogue, all text; quoted line breaks are kept; the usual tokens for "missing" become null.

    A multi-line CSV file can't be split, so write it to Parquet once and read that from then on.
    """
    schema = T.StructType([T.StructField(c, _TEXT) for c in columns])
    raw = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    return raw.select(*[F.when(~F.col(c).isin(NULL_TOKENS), F.col(c)).alias(c) for c in columns])


def landed_catalogue(spark: SparkSession, path: str, target: str, columns: list[str] = CATALOGUE, partitions: int | None = None) -> DataFrame:
    """The CSV catalogue written to Parquet once and read back: from then on it splits, prunes and filters."""
    rows = read_catalogue(spark, path, columns)
    write_parquet(rows.repartition(partitions) if partitions else rows, target)
    return spark.read.parquet(target)


def path_list(cell: Column) -> Column:
    """Paths of a ';'-joined cell, stripped, without empty ones; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), strip), lambda p: p != "")


def read_papers(spark: SparkSession, *paths: str) -> DataFrame:
    """One parsed paper per JSON file, with ``file``; files that aren't JSON give a row whose fields are all null."""
    return spark.read.schema(PAPER).option("multiLine", True).option("mode", "PERMISSIVE").json(list(paths)).withColumn("file", F.col("_metadata.file_path"))


def parsed_bodies(df: DataFrame, body: str) -> DataFrame:
    """With ``paper`` and ``ok``: whether the text is JSON at all. Fields of another type than declared are null in ``paper``."""
    return df.withColumns({"paper": F.from_json(F.col(body), PAPER), "ok": F.try_parse_json(F.col(body)).isNotNull()})


def paragraph_rows(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, para_idx, section, text): body paragraphs that aren't blank; para_idx is the place in the full list."""
    rows = df.select(*keep, F.posexplode("body_text").alias("para_idx", "p"))
    return rows.where(F.coalesce(strip(F.col("p.text")) != "", F.lit(False))).select(*keep, "para_idx", clean_str(F.col("p.section")).alias("section"), F.col("p.text").alias("text"))


def author_rows(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, author_idx, institution, country_raw, settlement): every author, with or without affiliation."""
    rows = df.select(*keep, F.posexplode("metadata.authors").alias("author_idx", "a")).where("a IS NOT NULL")
    place = F.col("a.affiliation.location")
    return rows.select(
        *keep, "author_idx", clean_str(F.col("a.affiliation.institution")).alias("institution"), clean_str(place.getField("country")).alias("country_raw"), clean_str(place.getField("settlement")).alias("settlement")
    )


def catalogue_paragraphs(catalogue: DataFrame, papers: DataFrame) -> DataFrame:
    """Paragraphs of all files a catalogue row names, both sources, with its cord_uid. ``papers`` needs ``file``."""
    return paragraph_rows(_named_papers(catalogue, papers, ("pdf", "pmc"), "body_text"), "cord_uid", "paper_id", "source")


def catalogue_authors(catalogue: DataFrame, papers: DataFrame) -> DataFrame:
    """Authors of all pdf files a catalogue row names, with its cord_uid; the other source has no affiliations."""
    return author_rows(_named_papers(catalogue, papers, ("pdf",), "metadata"), "cord_uid", "paper_id")


def _named_papers(catalogue: DataFrame, papers: DataFrame, sources: tuple[str, ...], part: str) -> DataFrame:
    """Papers with the cord_uid and source of each catalogue row that names their file; only ``part`` of them is moved."""
    named = None
    for source in sources:
        rows = catalogue.select("cord_uid", F.lit(source).alias("source"), F.explode(path_list(F.col(f"{source}_json_files"))).alias("path"))
        named = rows if named is None else named.unionByName(rows)
    last_two = r"([^/]+/[^/]+)$"
    opened = papers.select(F.regexp_extract("file", last_two, 1).alias("path_key"), "paper_id", part)
    return named.select("cord_uid", "source", F.regexp_extract("path", last_two, 1).alias("path_key")).join(opened, "path_key")


def read_vectors(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(word, vec) of a text file ``word f1 f2 ...``; quotes and words like 'nan' mean themselves. The header line has two fields."""
    parts = spark.read.text(path).select(F.split("value", " ").alias("p"))
    rows = parts.where(F.size("p") > 2) if header else parts
    return rows.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.try_cast("float")).alias("vec"))


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A Parquet table's columns; the error names those that are missing."""
    df = spark.read.parquet(path)
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df.select(*columns)


def sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows in a seeded random order that depends on the row's content only."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns)).limit(n)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The dry run: the first n rows of the ordered catalogue."""
    return df.orderBy(*order).limit(n)


def config_values(*paths: str | Path) -> list[str]:
    """Values of the first line that is no comment, of the first file that exists."""
    for p in map(Path, paths):
        if p.exists():
            for line in p.read_text(encoding="utf-8").splitlines():
                if line.strip() and not line.strip().startswith("#"):
                    return [x.strip() for x in line.split(",") if x.strip()]
    return []
