"""Session builder, shared-folder materialisation and the few settings every operator reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "inkwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC on. Settings given in ``conf`` win; the cluster's own settings are kept."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def describe(spark: SparkSession) -> dict[str, str]:
    """What the session really runs on, so that no fallback stays silent."""
    sc, get = spark.sparkContext, spark.conf.get
    return {
        "master": sc.master,
        "default_parallelism": str(sc.defaultParallelism),
        "shuffle_partitions": get("spark.sql.shuffle.partitions"),
        "executor_memory": sc.getConf().get("spark.executor.memory", "default"),
        "adaptive": get("spark.sql.adaptive.enabled"),
        "shared_folder": shared_folder(spark),
    }


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only on a local master (tests) an own one is made where it is unset."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="inkwell-"))
        atexit.register(shutil.rmtree, _own_folder[0], True)
    return f"file://{_own_folder[0]}"


_scratch: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends or by ``forget_scratch``."""
    path = f"{shared_folder(spark).rstrip('/')}/inkwell-{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    atexit.register(_remove, spark, path)
    return path


def forget_scratch(spark: SparkSession) -> int:
    """Remove all tables written so far, for long sessions whose results have been stored; gives their number."""
    n = len(_scratch)
    while _scratch:
        _remove(spark, _scratch.pop())
    return n


def written(df: DataFrame, label: str = "table", by: str | None = None) -> DataFrame:
    """``df`` written once as zstd Parquet into the shared folder and read back; ``by``: a column with few values, one folder each.

    Cuts the lineage, survives the loss of executors and lets several consumers read what was computed once.
    """
    path = scratch(df.sparkSession, label)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the driver is going down; what is left lies in the checkpoint folder
        if path.startswith("file://"):
            shutil.rmtree(path[7:], True)


def task_slots(spark: SparkSession) -> int:
    """Number of partitions for CPU-heavy narrow work: the larger of the cluster's slots and the shuffle setting."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan of few splits over the cluster before CPU-heavy work; a scan that has enough splits is left alone."""
    want = task_slots(df.sparkSession)
    if df.rdd.getNumPartitions() >= min(want, df.sparkSession.sparkContext.defaultParallelism):
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def send(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of bounded size together with its class's code; ``received`` unpacks it in a worker."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast) -> object:
    return cloudpickle.loads(sent.value)
