"""File-level views of a Parquet table: rows, bytes and row groups, without reading its data."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows_per_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, n_rows); the counts come from the footers."""
    df = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return df.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("n_rows"))


def footers(*paths: str) -> list[dict]:
    """Rows, row groups and uncompressed bytes of local files."""
    import pyarrow.parquet as pq

    out = []
    for p in paths:
        m = pq.ParquetFile(p).metadata
        out.append({"file": os.path.basename(p), "rows": m.num_rows, "row_groups": m.num_row_groups, "bytes": sum(m.row_group(k).total_byte_size for k in range(m.num_row_groups))})
    return out


def columns_of(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    return spark.read.parquet(path).dtypes


def folder_size(path: str) -> tuple[int, float]:
    """(part files, MB) of a local dataset folder."""
    n, size = 0, 0
    for base, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                n += 1
            size += os.path.getsize(os.path.join(base, name))
    return n, round(size / 1e6, 3)


def file_number(name: str) -> tuple[int, str]:
    """Sort key: the last number in a file's name before its ending, -1 without one; then the name."""
    numbers = re.findall(r"\d+", os.path.basename(name).split(".parquet")[0].split(".snappy")[0].split(".zstd")[0])
    return (int(numbers[-1]) if numbers else -1), os.path.basename(name)


def data_files(spark: SparkSession, folder: str) -> list[str]:
    """The Parquet files of a folder on any file system Spark reads, in numeric order of their names (part.9 before part.10)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((f.getPath().toString() for f in found if f.getPath().getName().endswith(".parquet")), key=file_number)


def even_groups(items: Sequence, k: int) -> list[list]:
    """Neighbouring items in k groups whose sizes differ by one at most; k is held between 1 and the number of items."""
    k = max(1, min(k, len(items)))
    size, more = divmod(len(items), k)
    groups, at = [], 0
    for g in range(k):
        n = size + (g < more)
        groups.append(list(items[at : at + n]))
        at += n
    return groups


def read_in_groups(spark: SparkSession, names: Sequence[str], k: int) -> DataFrame:
    """The files as exactly k partitions (fewer files: as many as files), each of neighbouring files, without a shuffle.

    Meant for measuring, with up to some hundred partitions; otherwise Spark packs files by size itself. Turns
    ``spark.sql.unionOutputPartitioning`` off for the session, which would make one partition of all groups.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    parts = [spark.read.parquet(*group).coalesce(1) for group in even_groups(names, k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def partition_slice(spark: SparkSession, folder: str, first: int, stop: int) -> DataFrame:
    """The rows of the files first .. stop - 1 of a folder, in numeric order; an empty slice keeps the columns."""
    names = data_files(spark, folder)[first:stop]
    return spark.read.parquet(*names) if names else spark.read.parquet(folder).limit(0)
