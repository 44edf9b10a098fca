"""Partitioning and materialisation."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exactly(df: DataFrame, k: int) -> DataFrame:
    """k partitions: merged without a shuffle where there are more, dealt out anew where there are fewer. k is 1 at least."""
    k, now = max(1, k), df.rdd.getNumPartitions()
    return df.coalesce(k) if k <= now else df.repartition(k)


def by_key(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def kept(df: DataFrame) -> DataFrame:
    """Cached and filled, for two consumers or more."""
    df = df.cache()
    df.count()
    return df


def maybe_among(df: DataFrame, key: str, keys: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """Rows whose key is among ``keys``, and some others: a Bloom filter of fixed size (8 MB), worked out in the JVM, before a join.

    The filter is put together in Spark and travels as one row. With some ten million keys it lets most rows through; it never
    keeps a wanted one back. Null keys are kept back.
    """
    import numpy as np
    import pyarrow as pa

    h = F.xxhash64(key)
    probes = [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]
    rows = keys.select(F.explode(F.array(*probes)).alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("w")).toArrow()
    words = np.zeros(bits // 64, dtype=np.int64)
    words[rows.column("at").to_numpy()] = rows.column("w").to_numpy()
    one = df.sparkSession.createDataFrame(pa.table({"_bits": pa.array([words], pa.list_(pa.int64()))}))
    is_set = lambda p: F.call_function("getbit", F.element_at("_bits", (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
    return df.join(F.broadcast(one), F.col(key).isNotNull() & is_set(probes[0]) & is_set(probes[1])).select(*df.columns)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the planner's estimate of the rows' size is within its own limit for broadcasts."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def with_timeout(df: DataFrame, action: Callable[[DataFrame], object], seconds: float, group: str = "inkwell-timed") -> object:
    """The action's result; past the time its jobs are cancelled and TimeoutError is raised."""
    sc = df.sparkSession.sparkContext
    box: dict = {}

    def run() -> None:
        sc.setJobGroup(group, "timed action", interruptOnCancel=True)
        try:
            box["value"] = action(df)
        except Exception as error:
            box["error"] = error

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(seconds)
    if t.is_alive():
        sc.cancelJobGroup(group)
        t.join(10)
        raise TimeoutError(f"not done in {seconds} s")
    if "error" in box:
        raise box["error"]
    return box["value"]


def on_every_slot(spark: SparkSession, f: Callable[[], str]) -> list[str]:
    """What ``f`` gives in a task on each of the cluster's slots (a version, a folder, a setting)."""
    n = spark.sparkContext.defaultParallelism

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"said": [str(f())] * len(pdf)})

    return [r.said for r in spark.range(0, n, 1, n).mapInPandas(run, "said string").collect()]
