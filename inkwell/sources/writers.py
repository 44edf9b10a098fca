"""Sinks: Parquet, CSV, JSON summaries, Markdown tables and the guard against writing into the input."""

from __future__ import annotations

import csv
import json
import os
import uuid
import warnings
from pathlib import Path

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, rows_per_file: int | None = None, rows_per_group: int | None = None, append: bool = False) -> None:
    """zstd Parquet; ``rows_per_file`` and ``rows_per_group`` keep files and row groups of skewed rows small.

    A target that is the input, lies in an input table's folder, or holds the input and would be overwritten, is refused.
    """
    plain = lambda f: f.removeprefix("file://").removeprefix("file:")
    inputs = [plain(f) for f in df.inputFiles()]
    for folder in {os.path.dirname(f) for f in inputs if f.endswith(".parquet")}:
        if not append or not folder.startswith(plain(path)):
            guard_output(folder, path)
    if not append and any(f.startswith(plain(path).rstrip("/") + "/") for f in inputs):
        raise ValueError(f"writing {path} would delete the input")
    w = df.write.mode("append" if append else "overwrite").option("compression", "zstd")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    if rows_per_group:
        w = w.option("parquet.block.row.count.limit", rows_per_group)
    w.parquet(path)


def append_batch(df: DataFrame, path: str, offset: int, **options: int) -> int:
    """One batch more in a flat folder, its files named ``part.<offset + k>.parquet``; gives the next offset.

    The batch is written aside and its files are moved, so readers see whole files only. A batch that is written again with
    the same offset replaces its files.
    """
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}/_batch-{uuid.uuid4().hex}"
    write_parquet(df, aside, **options)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(aside).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(at(aside)) if f.getPath().getName().endswith(".parquet"))
    for k, name in enumerate(names):
        target = at(f"{path.rstrip('/')}/part.{offset + k}.parquet")
        fs.delete(target, False)
        fs.rename(at(f"{aside}/{name}"), target)
    fs.delete(at(aside), True)
    return offset + len(names)


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header, a file for each partition; ``files`` = 1 for small reports."""
    out = df.coalesce(files) if files else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def append_row(path: str | Path, row: dict) -> None:
    """One measurement more in a CSV file; the header is written with the first."""
    path = Path(path)
    new = not path.exists()
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, fieldnames=list(row))
        if new:
            w.writeheader()
        w.writerow(row)


def write_summary(one_row: DataFrame, path: str | Path, **more: object) -> dict:
    """A one-row result with further values as JSON."""
    out = {**one_row.first().asDict(recursive=True), **more}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, indent=2, default=str, ensure_ascii=False), encoding="utf-8")
    return out


def markdown_table(small: DataFrame) -> str:
    """A collected report as a Markdown table."""
    rows = small.collect()
    cells = lambda r: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in r) + " |"
    return "\n".join([cells(small.columns), "|" + " --- |" * len(small.columns), *map(cells, rows)]) + "\n"


def report(path: str | Path, title: str, sections: dict[str, DataFrame | str]) -> None:
    """A Markdown report: each section a text or a small table."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    parts = [f"# {title}\n"]
    for name, body in sections.items():
        parts += [f"## {name}\n", (body if isinstance(body, str) else markdown_table(body)).rstrip() + "\n"]
    Path(path).write_text("\n".join(parts), encoding="utf-8")


def bar_chart(small: DataFrame, label: str, value: str, path: str) -> bool:
    """Horizontal bars as PNG where matplotlib is there; False if it isn't."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ModuleNotFoundError:
        return False
    rows = small.select(label, value).collect()[::-1]
    fig, ax = plt.subplots()
    ax.barh([r[0] for r in rows], [r[1] for r in rows])
    fig.tight_layout()
    fig.savefig(path)
    plt.close(fig)
    return True


def guard_output(source: str, target: str) -> None:
    """Refuse a target inside the input, or the input itself; warn of a target that holds the input."""
    s, t = Path(source).expanduser().resolve(), Path(target.removeprefix("file://")).expanduser().resolve()
    if t == s or s in t.parents:
        raise ValueError(f"the output {target} lies in the input {source}")
    if t in s.parents:
        warnings.warn(f"the output {target} holds the input {source}; a folder of its own is safer", stacklevel=2)
