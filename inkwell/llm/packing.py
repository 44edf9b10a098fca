"""Items of varying length into containers of fixed capacity, in the order of a space-filling curve.

Each text's words are hashed into a vector of BUCKETS counts and projected to DIMENSIONS coordinates (principal axes of a
bounded sample, each coordinate cut at the sample's quantiles). The Hilbert key of the coordinates orders the texts so
that neighbours are alike; the rows are range-sorted by it and packed along the curve: LOOK_AHEAD neighbouring items at a
time, larger ones first, each into the open container with the least room that still takes it. At most OPEN containers
stay open, the fullest are closed first. Both numbers are small, so that a container holds neighbours along the curve:
larger ones fill containers a little better and mix unlike texts.

An item is cut only if it alone exceeds the capacity; its full pieces are containers of their own, the rest is packed as
an item. Only keys, ids and sizes are shuffled. Range bounds include the id, so any number of equal texts spreads over
tasks. A null size is counted from the text (null text: 0); items of size 0 are packed too. Repeated rows are packed as
often as they occur. Empty input gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import received, send, spread, task_slots, written

BUCKETS, DIMENSIONS, CELL_BITS = 256, 3, 10
SAMPLE_ROWS = 3_000
LOOK_AHEAD, OPEN = 64, 16
ROWS_PER_TASK = 200_000


def hashed_vectors(lists):
    """Arrow list array of word hashes -> unit vectors of logarithmic counts."""
    import numpy as np

    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0] : offsets[-1]]
    rows = np.repeat(np.arange(len(lists)), np.diff(offsets))
    counts = np.bincount(rows * BUCKETS + (flat % np.uint64(BUCKETS)).astype(np.int64), minlength=len(lists) * BUCKETS).reshape(len(lists), BUCKETS)
    v = np.log1p(counts).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


class Curve:
    """Projection and quantiles learned from a sample, and the Hilbert key."""

    def __init__(self, sample):
        import numpy as np

        self.mean = sample.mean(0) if len(sample) else np.zeros(BUCKETS, dtype=np.float32)
        x = sample - self.mean
        self.axes = np.linalg.svd(x.T @ x)[0][:, :DIMENSIONS] if len(sample) else np.eye(BUCKETS, DIMENSIONS)
        at = np.linspace(0, 1, 1 << 6)[1:-1]
        self.edges = [np.quantile(x @ self.axes[:, d], at) if len(sample) else at for d in range(DIMENSIONS)]

    def keys(self, vectors):
        import numpy as np

        z = (vectors - self.mean) @ self.axes
        cells = np.stack([np.searchsorted(e, z[:, d]) << (CELL_BITS - 6) for d, e in enumerate(self.edges)], axis=1)
        return hilbert(cells.astype(np.int64), CELL_BITS)


def hilbert(cells, bits: int):
    """Index along the Hilbert curve of points with integer coordinates of ``bits`` bits: (rows, dimensions) -> (rows,)."""
    import numpy as np

    x = cells.T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level, from the top
        p = q - 1
        for d in range(n):
            flip = (x[d] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, n):
        x[d] ^= x[d - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def pack(sizes: list[int], capacity: int, look_ahead: int = LOOK_AHEAD, most_open: int = OPEN) -> list[int]:
    """Container number of each item; items are taken in order, ``look_ahead`` at a time."""
    where = [0] * len(sizes)
    room: list[tuple[int, int]] = []  # (space left, container), ascending
    made = 0
    for at in range(0, len(sizes), look_ahead):
        for k in sorted(range(at, min(at + look_ahead, len(sizes))), key=lambda k: (-sizes[k], k)):
            p = bisect_left(room, (sizes[k], -1))
            if p < len(room):
                left, c = room.pop(p)
            else:
                left, c, made = capacity, made, made + 1
            where[k] = c
            insort(room, (left - sizes[k], c))
        if len(room) > most_open:
            room = room[-most_open:]  # those with the most space stay open
    return where


def packed(df: DataFrame, item: str, text: str, size: str, capacity: int = 2_048, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(container, position, item, piece, first_token, n_tokens): every piece of every item, in containers."""
    from inkwell.llm.leaks import words

    spark = df.sparkSession
    kind = df.schema[item].dataType.simpleString()
    tokens = F.coalesce(F.col(size).cast("int"), F.size(F.regexp_extract_all(F.col(text), F.lit(r"(?U)\w+|[^\w\s]+"), F.lit(0))), F.lit(0))
    base = df.select(F.col(item).alias("item"), tokens.alias("size"), F.coalesce(words(F.col(text)), F.array().cast("array<bigint>")).alias("w"))
    total = df.count()
    share = max(1, total // SAMPLE_ROWS)
    # chosen by the id's hash, so that no text is read to choose; the vectors are made in the tasks
    sample = df.where(F.pmod(F.xxhash64(F.col(item)), F.lit(share)) == 0).where(F.length(text) > 0).limit(4 * SAMPLE_ROWS).select(words(F.col(text)).alias("w"))

    def vectors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in hashed_vectors(batch.column(0))], pa.binary())], names=["v"])

    def keyed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        curve = received(sent)
        for batch in batches:
            keys = curve.keys(hashed_vectors(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["item", "size", "key"])

    import numpy as np

    got = [np.frombuffer(r.v, dtype=np.float32) for r in sample.mapInArrow(vectors, "v binary").collect()]
    sent = send(spark, Curve(np.stack(got) if got else np.zeros((0, BUCKETS), dtype=np.float32)))
    keys = written(spread(base).mapInArrow(keyed, f"item {kind}, size int, key long"), "keys")
    pieces = keys.select(
        "item", "size", "key", F.explode(F.when(F.col("size") > capacity, F.sequence(F.lit(0), F.floor((F.col("size") - 1) / capacity).cast("int"))).otherwise(F.array(F.lit(0)))).alias("piece")
    ).select("item", "key", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int").alias("n_tokens"))
    tasks = min(max(1, -(-total // rows_per_task)), 1 << 20)
    tasks = max(tasks, min(task_slots(spark), max(1, total // 5_000)))
    # equal rows too are told apart, so that no number of copies ends in one range
    ranged = pieces.repartitionByRange(tasks, "key", "item", "piece").sortWithinPartitions("key", "item", "piece")

    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa

        base_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        sizes = table.column("n_tokens").to_pylist()
        where = pack(sizes, capacity)
        position, seen = [], {}
        for c in where:
            position.append(seen.get(c, 0))
            seen[c] = position[-1] + 1
        out = pa.table({"container": pa.array([base_id + c for c in where], pa.int64()), "position": pa.array(position, pa.int32())})
        for name in ("item", "piece", "first_token", "n_tokens"):
            out = out.append_column(name, table.column(name))
        yield from out.to_batches()

    return ranged.select("item", "piece", "first_token", "n_tokens").mapInArrow(fill, f"container long, position int, item {kind}, piece int, first_token int, n_tokens int")


def locality(pieces: DataFrame, docs: DataFrame, item: str, text: str) -> DataFrame:
    """(containers, in_container, any_two): mean cosine of two whole items' hashed vectors in one container and of any two.

    By sums of unit vectors with partial aggregation; no pairs are formed. Items without words and cut items take no part; a
    mean of no pairs is null.
    """
    from inkwell.llm.leaks import words
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    kind = docs.schema[item].dataType.simpleString()

    def vectors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            v = hashed_vectors(batch.column(1))
            offsets = pa.array(range(0, v.size + 1, BUCKETS), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(v.ravel(), pa.float32()))], names=["item", "v"])

    known = docs.where(F.length(text) > 0).select(F.col(item).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0).mapInArrow(vectors, f"item {kind}, v array<float>")
    whole = pieces.groupBy("item").agg(F.min("container").alias("container"), F.count(F.lit(1)).alias("n")).where("n = 1").select("item", "container")
    placed = known.join(whole, "item").select("container", array_to_vector(F.col("v").cast("array<double>")).alias("v"))
    held = placed.groupBy("container").agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(F.col("v"))).alias("s"))
    held = written(held, "sums")
    # of n unit vectors with the sum s: mean cosine of two different ones
    mean = F.when(F.col("n") > 1, (F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x) - F.col("n")) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0)))
    inside = held.where("n > 1").select(mean.alias("c"), "n")
    all_in = held.groupBy(F.lit(1).alias("one")).agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).select(mean.alias("any_two"))
    one = inside.agg(F.count(F.lit(1)).alias("containers"), F.round(F.try_divide(F.sum(F.col("c") * F.col("n")), F.sum("n")), 4).alias("in_container"))
    return one.join(all_in, F.lit(True), "left").select("containers", "in_container", F.round("any_two", 4).alias("any_two"))
