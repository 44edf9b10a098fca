"""Frequency of every term and in how many records it occurs: recursive radix spilling, aggregated out of core by DuckDB.

1. Rows are placed by record, so that a record's terms are made distinct where they arise. Records that hold more than half
   a partition's rows (there are at most twice as many of them as partitions) are spread over salts; their terms keep the
   record's name until the end.
2. In each task DuckDB reduces every chunk of (record, term) rows to one row per term before anything is shuffled.
3. The reduced rows are shuffled by the leading hash bits of the term. A task whose partition is larger than
   ``spill_rows`` splits it by the next bits into files in the shared folder, again and again until each part fits, and
   DuckDB aggregates part by part. A term has at most one row per chunk and hot record, so parts always shrink.
   DuckDB itself may spill, if at all, to the shared folder only.

Null or empty texts have no terms; a null record counts its occurrences, but is no record. Ties play no role: counts
are exact and independent of the order of rows. Empty input gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.session import scratch, written

CHUNK_ROWS = 400_000
SPILL_ROWS = 1_500_000
RADIX_BITS = 4


#: Leading hash bits for each reduce partition that Spark's own partitioning may use, so that partitions differ little.
PART_BITS = 5


def _duck(folder: str):
    """DuckDB with one thread; its temporary folder is in the shared one, or it has none where that is no mounted path."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    local = folder.removeprefix("file://").removeprefix("file:")
    mounted = local.startswith("/")
    con.execute(f"SET memory_limit = '{256 if mounted else 1024}MB'")
    con.execute("SET temp_directory = '{}'".format(f"{local}/duck-{uuid.uuid4().hex}".replace("'", "''") if mounted else ""))
    return con


def reduce_chunks(batches: Iterator, folder: str, chunk_rows: int = CHUNK_ROWS) -> Iterator:
    """(term, n, hot, cold) -> one row per chunk, term and hot record with summed n and number of other records."""
    import pyarrow as pa

    con, held, rows = _duck(folder), [], 0

    def flush() -> Iterator:
        chunk = pa.Table.from_batches(held)
        con.register("chunk", chunk)
        out = con.sql("SELECT term, sum(n)::BIGINT AS n, hot, sum(cold)::BIGINT AS cold FROM chunk GROUP BY term, hot").to_arrow_table()
        con.unregister("chunk")
        yield from out.cast(SCHEMA()).to_batches(max_chunksize=20_000)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= chunk_rows:
            yield from flush()
            held, rows = [], 0
    if held:
        yield from flush()


def SCHEMA():  # noqa: N802 - a pyarrow schema, built where pyarrow is
    import pyarrow as pa

    return pa.schema([("term", pa.string()), ("n", pa.int64()), ("hot", pa.string()), ("cold", pa.int64())])


FINAL = "SELECT term, sum(n)::BIGINT AS n_occurrences, (sum(cold) + count(DISTINCT hot))::BIGINT AS n_records FROM part GROUP BY term"


class RadixAggregator:
    """Aggregates one shuffled partition; parts that don't fit are split by the next hash bits on the shared folder."""

    def __init__(self, folder: str, spill_rows: int = SPILL_ROWS, bits: int = RADIX_BITS, first_bit: int = 0):
        self.folder, self.spill_rows, self.bits, self.first_bit = folder, spill_rows, bits, first_bit

    def __call__(self, batches: Iterator) -> Iterator:
        yield from self._aggregate(batches, self.first_bit)

    def _finish(self, held: list) -> Iterator:
        import pyarrow as pa

        con = _duck(self.folder)
        con.register("part", pa.Table.from_batches(held).drop_columns(["h"]))
        out = con.sql(FINAL).to_arrow_table()
        yield from out.to_batches(max_chunksize=20_000)

    def _aggregate(self, batches: Iterator, bit: int) -> Iterator:
        held, rows, splitter = [], 0, None
        for batch in batches:
            if splitter is not None:
                splitter.add(batch)
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows > self.spill_rows and bit + self.bits <= 64:
                splitter = _Splitter(self.folder, bit, self.bits)
                for b in held:
                    splitter.add(b)
                held = []
        if splitter is None:
            if held:
                yield from self._finish(held)
            return
        for part in splitter.parts():
            yield from self._aggregate(part, bit + self.bits)
        splitter.remove()


class _Splitter:
    """Arrow files in the shared folder, one for each value of the next hash bits."""

    def __init__(self, folder: str, bit: int, bits: int):
        from pyarrow import fs

        self.fs, base = fs.FileSystem.from_uri(folder)
        self.dir = f"{base}/{uuid.uuid4().hex}"
        self.fs.create_dir(self.dir, recursive=True)
        self.shift, self.mask, self.out, self.streams = 64 - bit - bits, (1 << bits) - 1, {}, {}

    def add(self, batch) -> None:
        import numpy as np
        import pyarrow as pa

        h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
        part = (h >> np.uint64(self.shift)).astype(np.int64) & self.mask
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order])) + 1
        for rows in np.split(order, edges):
            if len(rows):
                p = int(part[rows[0]])
                if p not in self.out:
                    self.streams[p] = self.fs.open_output_stream(f"{self.dir}/{p}.arrow")
                    self.out[p] = pa.ipc.new_stream(self.streams[p], batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                self.out[p].write_batch(batch.take(pa.array(rows)))

    def parts(self) -> Iterator[Iterator]:
        import pyarrow as pa

        for p, w in self.out.items():
            w.close()
            self.streams[p].close()
        for p in sorted(self.out):
            with self.fs.open_input_stream(f"{self.dir}/{p}.arrow") as f, pa.ipc.open_stream(f) as reader:
                yield iter(reader)

    def remove(self) -> None:
        self.fs.delete_dir(self.dir)


def ascii_terms(text: Column) -> Column:
    """Maximal runs of a-z and 0-9 in the lower-cased text that have two characters or more and a letter."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?<![a-z0-9])(?=[0-9]*[a-z])[a-z0-9]{2,}"), F.lit(0))


def placed_by_record(base: DataFrame, total: int, parts: int) -> DataFrame:
    """Rows (r, s, t) with a text, dealt to ``parts`` partitions by record r; records of more than half a partition's rows, and rows without one, also by s."""
    hot_rows = base.where("r IS NOT NULL").groupBy("r").count().where(F.col("count") * 2 * parts > total).select("r")  # fewer than 2 * parts rows
    hot = written(hot_rows, "hot").withColumn("is_hot", F.lit(True))
    marked = base.where("t IS NOT NULL").join(F.broadcast(hot), "r", "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
    salt = F.when(F.col("is_hot") | F.col("r").isNull(), F.pmod("s", F.lit(parts * 2))).otherwise(F.lit(-1))
    return marked.select("r", "is_hot", salt.alias("salt"), "t").repartition(parts, "r", "salt")


def term_frequencies(
    df: DataFrame, text: str, record: str, spread_by: str | None = None, terms=ascii_terms, rare_at_most: int = 2, common_share: float = 0.5, spill_rows: int = SPILL_ROWS
) -> DataFrame:
    """(term, n_occurrences, n_records, mark): every term of ``text``; ``mark`` is 'rare', 'common' or null.

    'rare': in at most ``rare_at_most`` records; 'common': in more than ``common_share`` of the records that have any
    term. A term that is both is 'rare'. ``spread_by``: a column that tells rows of a hot record apart (default: the text).
    """
    spark = df.sparkSession
    base = df.select(F.col(record).cast("string").alias("r"), F.col(text).alias("t"), F.xxhash64(F.col(spread_by or text)).alias("s"))
    total = base.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = placed_by_record(base, total, parts)
    pairs = (
        placed.select("r", "is_hot", "salt", terms(F.col("t")).alias("w"))
        .where(F.size("w") > 0)
        .select("r", "is_hot", "salt", F.explode(F.concat(F.col("w"), F.array(F.lit("")))).alias("term"))  # '' stands for "any term"
        .groupBy("r", "salt", "term", "is_hot")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("term", "n", F.when(F.col("is_hot"), F.col("r")).alias("hot"), F.when(F.col("is_hot") | F.col("r").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("cold"))
    )
    folder = scratch(spark, "radix")
    reduced = pairs.mapInArrow(lambda batches: reduce_chunks(batches, folder), "term string, n long, hot string, cold long")
    first = min(40, parts.bit_length() + PART_BITS)
    radix = reduced.withColumn("h", F.xxhash64("term")).repartition(parts, F.shiftrightunsigned("h", 64 - first))
    counted = written(radix.mapInArrow(RadixAggregator(folder, spill_rows, first_bit=first), "term string, n_occurrences long, n_records long"), "terms")
    records = (counted.where("term = ''").agg(F.max("n_records")).first() or [0])[0] or 0
    return counted.where("term <> ''").select(
        "term",
        "n_occurrences",
        "n_records",
        F.when(F.col("n_records") <= rare_at_most, F.lit("rare")).when(F.col("n_records") > common_share * records, F.lit("common")).alias("mark"),
    )
