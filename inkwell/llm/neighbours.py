"""The k most similar vectors of every vector, by multi-index hashing of learned rotated binary codes.

A rotation is learned (iterative quantisation) on a bounded sample; the signs of the rotated vector are its code. The code is
split into m substrings, each of which is indexed: a code is filed in every substring's table under its value and all values
one bit away. Two codes whose substrings differ in two bits or less meet in a table, so by the pigeonhole principle every
code within a Hamming distance of 3 m - 1 is retrieved; of those beyond, as many as have one near substring, up to the share
CUT of the bits. They are reranked by the float vectors. A substring has one bit more than the logarithm of the rows, so a
table's buckets keep the same size whatever the number of rows; longer substrings go with more of them.

The tables are rows (substring and value, code) that are shuffled once by value and joined with themselves: what is moved is
in proportion to rows x probes. Distances are counted in the join, so only near pairs leave it. Buckets of more than
HOT_ROWS rows (near copies, hot topics) are left out of the join; the rows in any of them, each once, are scored with each other
whole, in blocks, by the float vectors, each row keeping its k best of each block. No number of candidates is capped.

Vectors that are equal after scaling form a class that is searched once. Null and zero vectors take no part, nor do vectors
with nulls, NaN or another length than the usual one. Ties go to the smaller id. Repeated ids are taken once, with the smallest vector.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import received, send, spread, written

LEAST_SUBSTRINGS, LEAST_BITS, USUAL_BITS = 8, 8, 16
#: Share of a code's bits that may differ between candidates.
CUT = 0.265
SAMPLE_ROWS = 8_192
HOT_ROWS, BLOCK_ROWS = 8_192, 8_192
ITERATIONS = 30


def scheme(rows: int) -> tuple[int, int]:
    """(substrings, bits of each) for so many rows: a bit more than their logarithm; beyond USUAL_BITS more substrings."""
    bits = min(31, max(LEAST_BITS, (max(rows, 1) - 1).bit_length() + 1))
    return LEAST_SUBSTRINGS + 2 * max(0, bits - USUAL_BITS), bits


def learn_rotation(sample, bits: int, iterations: int = ITERATIONS):
    """Projection of unit vectors whose signs lose the least: principal axes, then the rotation nearest to its own signs."""
    import numpy as np

    dim = sample.shape[1]
    rng = np.random.default_rng(5)
    if len(sample) == 0:
        return np.linalg.qr(rng.normal(size=(max(dim, bits), bits)))[0][:dim].astype(np.float32)
    axes = np.linalg.svd(sample.T @ sample)[0][:, : min(bits, dim)]
    if axes.shape[1] < bits:  # fewer dimensions than bits: further random directions
        axes = np.concatenate([axes, rng.normal(size=(dim, bits - axes.shape[1]))], axis=1)
    z = sample @ axes
    r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(iterations):
        u, _, w = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
        r = w.T @ u.T
    return (axes @ r).astype(np.float32)


def codes_of(units, projection):
    """Unsigned 64-bit words of the codes, filled up with zeros: (rows, words)."""
    import numpy as np

    bits = units @ projection > 0
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1).view(">u8").astype(np.uint64)


def substrings(units, projection, m: int, bits: int):
    """Values of the m substrings of each code: (rows, m)."""
    import numpy as np

    on = (units @ projection > 0)[:, : m * bits].reshape(len(units), m, bits)
    return on @ (1 << np.arange(bits, dtype=np.int64))


def block_neighbours(units_a, units_b, k: int, same: bool, chunk: int = 512) -> tuple:
    """(row of a, row of b, cosine): the pairs that are among the k best of either row within the two blocks."""
    import numpy as np

    out = []
    for at in range(0, len(units_a), chunk):
        part = units_a[at : at + chunk]
        scores = part @ units_b.T
        if same:
            scores[np.arange(len(part)), at + np.arange(len(part))] = -2.0
        n = min(k, scores.shape[1])
        best_b = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        q, b = np.repeat(np.arange(len(part)), n), best_b.ravel()
        if not same:  # the other block's rows need their best too
            best_a = np.argpartition(-scores, min(k, len(part)) - 1, axis=0)[: min(k, len(part))]
            both = np.unique(np.r_[q * len(units_b) + b, best_a.ravel() * len(units_b) + np.tile(np.arange(scores.shape[1]), best_a.shape[0])])
            q, b = both // len(units_b), both % len(units_b)
        c = scores[q, b]
        keep = c > -2.0
        out.append((q[keep] + at, b[keep], c[keep]))
    a, b, c = (np.concatenate([o[n] for o in out]) if out else np.zeros(0) for n in range(3))
    a, b = a.astype(np.int64), b.astype(np.int64)
    keep = _first_k(a, c, k)
    if not same:
        keep |= _first_k(b, c, k)
    return a[keep], b[keep], c[keep]


def _first_k(group, score, k: int):
    """True for the rows that are among the k highest scores of their group (all that tie with the k-th)."""
    import numpy as np

    order = np.lexsort((-score, group))
    g, s = group[order], score[order]
    new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, dtype=bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0)) if len(g) else new
    kth = np.minimum(first + k - 1, len(g) - 1)
    same_group = g[kth] == g if len(g) else new
    out = np.zeros(len(g), dtype=bool)
    out[order] = ~same_group | (s >= s[kth])
    return out


def _encode(batches: Iterator, projection, m: int, bits: int) -> Iterator:
    import numpy as np
    import pandas as pd
    import xxhash

    dim = projection.shape[0]
    for pdf in batches:
        ids, units = [], []
        for uid, vec in zip(pdf["id"], pdf["vec"]):
            if vec is None or len(vec) != dim:
                continue
            v = np.asarray(vec, dtype=np.float64)
            n = np.sqrt(v @ v)
            if np.isfinite(n) and n > 0:
                ids.append(uid)
                units.append(v / n)
        u = np.stack(units).astype(np.float32) if units else np.zeros((0, dim), dtype=np.float32)
        same = [xxhash.xxh3_64_intdigest((np.round(x, 6) + 0.0).tobytes()) - (1 << 63) for x in u]
        yield pd.DataFrame({"id": ids, "same": np.array(same, dtype=np.int64), "unit": [x.tobytes() for x in u], "code": list(codes_of(u, projection).view(np.int64)), "parts": list(substrings(u, projection, m, bits))})


def filed(m: int, bits: int) -> Column:
    """Keys under which a code is filed, from its column ``parts``: each substring's value and all values one bit away."""
    masks = F.array(*[F.lit(x).cast("long") for x in [0, *(1 << k for k in range(bits))]])
    return F.flatten(F.transform("parts", lambda v, k: F.transform(masks, lambda x: F.shiftleft(k.cast("long"), 32).bitwiseOR(v.bitwiseXOR(x)))))


def _hot_keys(classes: DataFrame, bits: int, hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, from the counts of the values themselves."""
    own = classes.select(F.posexplode("parts").alias("k", "v")).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    masks = F.array(*[F.lit(x).cast("long") for x in [0, *(1 << k for k in range(bits))]])
    near = own.select(F.explode(F.transform(masks, lambda x: F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").bitwiseXOR(x)))).alias("key"), "n")
    return near.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot_rows).select("key")


def nearest(df: DataFrame, uid: str, vec: str, k: int = 3, sample_rows: int = SAMPLE_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, other, cosine, rank): for each vector its k most similar others, as far as their codes meet in the index."""
    import numpy as np

    spark = df.sparkSession
    kind = df.schema[uid].dataType.simpleString()
    rows = df.where(F.col(uid).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x))).select(F.col(uid).alias("id"), F.col(vec).cast("array<float>").alias("vec"))
    n_rows = rows.count()
    if not n_rows:
        return spark.createDataFrame([], f"id {kind}, other {kind}, cosine double, rank int")
    part = max(1, n_rows // sample_rows)
    sample = [r.vec for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(part)) == 0).limit(4 * sample_rows).collect()] or [rows.first().vec]
    dim = max({len(v) for v in sample}, key=lambda n: sum(len(v) == n for v in sample))
    x = np.array([v for v in sample if len(v) == dim and any(v)], dtype=np.float64).reshape(-1, dim)
    m, bits = scheme(n_rows)
    projection = learn_rotation(x / np.linalg.norm(x, axis=1, keepdims=True), m * bits)
    sent = send(spark, projection)
    encoded = spread(rows).mapInPandas(lambda it: _encode(it, received(sent), m, bits), f"id {kind}, same long, unit binary, code array<long>, parts array<long>")
    coded = written(encoded.groupBy("id").agg(F.min(F.struct("same", "unit", "code", "parts")).alias("x")).select("id", "x.*"), "codes")

    heads = coded.select("same", "id").withColumn("n", F.row_number().over(Window.partitionBy("same").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = coded.groupBy("same").agg(F.count(F.lit(1)).alias("size"), F.min_by(F.struct("unit", "code", "parts"), "id").alias("x")).select("same", "size", "x.unit", "x.code", "x.parts")
    classes = written(classes, "classes")

    words = -(-m * bits // 64)
    entries = classes.select("same", *[F.col("code")[w].alias(f"c{w}") for w in range(words)], F.explode(filed(m, bits)).alias("key"))
    hot = written(_hot_keys(classes, bits, hot_rows), "hot")
    some_hot = not hot.isEmpty()
    if some_hot:
        entries = entries.join(hot, "key", "left_anti")
    a, b = entries.alias("a"), entries.alias("b")
    apart = sum((F.bit_count(F.col(f"a.c{w}").bitwiseXOR(F.col(f"b.c{w}"))) for w in range(words)), F.lit(0))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.same") < F.col("b.same")) & (apart <= int(CUT * m * bits)))
    pairs = met.select(F.col("a.same").alias("a"), F.col("b.same").alias("b")).distinct()
    units = classes.select("same", "unit")
    both = pairs.join(units.select(F.col("same").alias("a"), F.col("unit").alias("u")), "a").join(units.select(F.col("same").alias("b"), F.col("unit").alias("v")), "b").select("a", "b", "u", "v")

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            u, v = (np.frombuffer(b"".join(batch.column(n).to_pylist()), dtype=np.float32).reshape(batch.num_rows, -1) for n in (2, 3))
            c = np.einsum("ij,ij->i", u, v).astype(np.float64)
            one, two = batch.column(0), batch.column(1)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([one, two]), pa.concat_arrays([two, one]), pa.array(np.r_[c, c])], names=["a", "b", "cosine"])

    links = both.mapInArrow(score, "a long, b long, cosine double")
    if some_hot:
        links = links.unionByName(_hot_links(classes, hot, m, bits, k)).distinct()
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    # a class brings at most k of its members, so k classes are enough for every member
    top = links.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("a", "b", "cosine")
    within = classes.where("size > 1").select(F.col("same").alias("a"), F.col("same").alias("b"), F.lit(1.0).alias("cosine"))
    open_classes = classes.where(F.col("size") <= k).select(F.col("same").alias("a"))
    between = top.join(open_classes, "a")
    found = (
        coded.select(F.col("id"), F.col("same").alias("a"))
        .join(between.unionByName(within), "a")
        .join(heads.select(F.col("same").alias("b"), F.col("id").alias("other")), "b")
        .where("id <> other")
    )
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other")))
    return ranked.where(F.col("rank") <= k).select("id", "other", "cosine", "rank")


def _hot_links(classes: DataFrame, hot: DataFrame, m: int, bits: int, k: int) -> DataFrame:
    """(a, b, cosine): of the rows in full buckets the k best of every row of each block, blocks of BLOCK_ROWS rows, every two of them a task."""
    full = classes.select("same", F.explode(filed(m, bits)).alias("key")).join(hot, "key", "left_semi").select("same").distinct()
    full = written(classes.select("same", "unit").join(full, "same", "left_semi"), "full")
    blocks = max(1, -(-full.count() // BLOCK_ROWS))
    held = full.withColumn("block", F.pmod(F.xxhash64("same"), F.lit(blocks)).cast("int"))
    shipped = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("with")).select("same", "unit", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))

    def search(pdf):
        import numpy as np
        import pandas as pd

        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        sides = []
        for block in {i: 0, j: 0}:
            own = pdf[pdf["block"] == block]
            sides.append((own["same"].to_numpy(), np.frombuffer(b"".join(own["unit"]), dtype=np.float32).reshape(len(own), -1) if len(own) else None))
        a, b = sides[0], sides[-1]
        if a[1] is None or b[1] is None:
            return pd.DataFrame({"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64), "cosine": np.zeros(0)})
        p, q, c = block_neighbours(a[1], b[1], k, i == j)
        one, two, score = a[0][p], b[0][q], c.astype(np.float64)
        if i != j:
            one, two, score = np.r_[one, two], np.r_[two, one], np.r_[score, score]
        keep = _first_k(one, score, k)
        return pd.DataFrame({"a": one[keep], "b": two[keep], "cosine": score[keep]})

    return shipped.repartition(blocks * (blocks + 1) // 2, "i", "j").groupBy("i", "j").applyInPandas(search, "a long, b long, cosine double")
