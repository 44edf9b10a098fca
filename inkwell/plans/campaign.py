"""Measuring campaign: a reference point with one knob turned at a time; a failure is a row, not a gap."""

from __future__ import annotations

import itertools
import json
import resource
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import SparkSession

from inkwell.operators.partitioning import exactly, with_timeout
from inkwell.operators.wordcount import word_counts
from inkwell.sources.writers import append_row


@dataclass(frozen=True)
class Point:
    curve: str = "reference"
    cores: int = 4
    partitions: int = 8
    shards: int = 8


def points(base: Point, **knobs: list[int]) -> list[Point]:
    """The reference point, then for each knob its other values."""
    out = [base]
    for name, values in knobs.items():
        out += [replace(base, curve=name, **{name: v}) for v in values if v != getattr(base, name)]
    return out


def word_count_job(spark: SparkSession, source: str, target: str, p: Point) -> None:
    """Map, reduce and the writing of the vocabulary, over ``partitions`` splits and ``shards`` reducers."""
    spark.conf.set("spark.sql.shuffle.partitions", str(p.shards))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = exactly(spark.read.parquet(source).select("text"), p.partitions)
    word_counts(df, "text").write.mode("overwrite").parquet(target)


def measure(session: Callable[[Point], SparkSession], source: str, target: str, todo: list[Point], csv: str, repetitions: int = 1, limit: float = 3_600) -> list[dict]:
    """Whole passes over all points, each in a fresh session; one CSV row each, with what really ran."""
    rows = []
    for n, p in itertools.product(range(repetitions), todo):
        spark, began, error = session(p), time.perf_counter(), ""
        try:
            with_timeout(spark.range(1), lambda _, p=p, s=spark: word_count_job(s, source, target, p), limit)
        except Exception as e:
            error = type(e).__name__
        ran = {"parallelism": spark.sparkContext.defaultParallelism, "ran_shards": int(spark.conf.get("spark.sql.shuffle.partitions"))}
        if not error and (ran["parallelism"] != p.cores or ran["ran_shards"] != p.shards):
            error = "other state"  # what was asked for is not what ran
        row = {**asdict(p), "repetition": n, "seconds": "" if error else round(time.perf_counter() - began, 3), "error": error, **ran, "driver_peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024}
        append_row(csv, row)
        rows.append(row)
        spark.stop()
    return rows


def event_log_summary(lines: Iterable[str]) -> dict:
    """What an event log (``spark.eventLog.enabled``) tells of a run: stages with their seconds, tasks, failures, spill and shuffle, and each executor's peak memory.

    ``executors`` holds the peaks in MB of JVM heap, JVM off-heap and, where process metrics are on, Python's resident memory.
    """
    stages: dict[int, dict] = {}
    peaks: dict[str, dict[str, float]] = {}
    wanted = {"JVMHeapMemory": "heap_mb", "JVMOffHeapMemory": "off_heap_mb", "ProcessTreePythonRSSMemory": "python_mb"}

    def peak(executor: str, metrics: dict) -> None:
        own = peaks.setdefault(executor, {})
        for name, short in wanted.items():
            if name in metrics:
                own[short] = max(own.get(short, 0.0), round(metrics[name] / 1e6, 1))

    for line in lines:
        e = json.loads(line)
        kind = e.get("Event")
        if kind == "SparkListenerTaskEnd":
            s = stages.setdefault(e["Stage ID"], {"tasks": 0, "failed": 0, "task_seconds": 0.0, "longest": 0.0, "spilled_mb": 0.0, "shuffled_mb": 0.0})
            m = e.get("Task Metrics") or {}
            seconds = m.get("Executor Run Time", 0) / 1000
            s["tasks"] += 1
            s["failed"] += bool(e["Task Info"].get("Failed"))
            s["task_seconds"] += seconds
            s["longest"] = max(s["longest"], seconds)
            s["spilled_mb"] += m.get("Disk Bytes Spilled", 0) / 1e6
            s["shuffled_mb"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0) / 1e6
            peak(e["Task Info"]["Executor ID"], e.get("Task Executor Metrics") or {})
        elif kind == "SparkListenerStageExecutorMetrics":
            peak(e["Executor ID"], e.get("Executor Metrics") or {})
    return {"stages": {k: {n: round(v, 3) for n, v in s.items()} for k, s in sorted(stages.items())}, "executors": peaks}
