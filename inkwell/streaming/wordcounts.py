"""Running word count over a folder that new Parquet parts arrive in.

The aggregation is the batch operator's; state is one row per word. A part is counted once, whatever fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkwell.operators.wordcount import word_counts


def counts(spark: SparkSession, folder: str, schema: str, text: str) -> DataFrame:
    return word_counts(spark.readStream.schema(schema).parquet(folder), text)


def into_memory(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Complete mode into a table in memory; for tests and small vocabularies."""
    return stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def into_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """After every batch the whole count replaces the table at ``path``."""
    return stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).start()
