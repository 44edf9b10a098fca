"""Held-out test items that stand, wholly or partly, in corpus documents: size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with the whole document, so documents are never signed
as a whole. Items are partitioned by size (classes that double: up to 32, 64, 128 ... shingles) and each class is compared
with document windows of its own size: the minima of K hash functions are taken once for blocks of BLOCK shingles and
merged to the windows of every class, one start per block. One equal minimum makes a candidate (bands of one row: with
a containment of 0.25 in a window twice as long the chance to miss an item is below 0.3 %; an item in several stretches
has that many chances). Candidates are verified against the whole document by exact five-word shingles in order.

The documents are read once, whatever the number of items. What travels to them are two filters of bounded size (FILTER_BITS):
one of the items' minima, one of their shingles. A document with a known minimum and enough known shingles leaves the scan
cut down to the words of these shingles and of short gaps; its minima are joined with the items', the shingles of each pair
so found are counted, and the pairs that have enough are verified. Only hashes are shuffled, and words of verified pairs.
The filters may let through what is no match (more so for many millions of items' words), never keep back what is one.
Copies and hot feeds play no role, every document stands alone.

Null or empty texts contain nothing; items without words, or with a null passage, are in no document. Items that share
their passage are searched as one and each reported. Items shorter than a shingle are looked up as one shingle of their
own length.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import received, send, written

SHINGLE = 5
BLOCK = 32
HASHES = 64
#: Largest filter (64 MB), and how many bits a key gets below that.
FILTER_BITS, BITS_A_KEY = 1 << 29, 1 << 10
#: Least share of an item's words found in order.
LEAST_SHARE = 0.4
#: Words between two matching stretches that count as a light change and not as a new stretch.
BRIDGE = 8


def words(text: Column) -> Column:
    """64-bit hashes of the lower-cased words, in order."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def shingle_hashes(w, n: int = SHINGLE):
    """Hashes of all runs of n words of a uint64 array (n or fewer words: one hash over all)."""
    import numpy as np

    w = np.asarray(w).view(np.uint64)
    if not len(w):
        return w
    n = min(n, len(w))
    out = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(out)]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def short_hash(h):
    import numpy as np

    return (h >> np.uint64(32)).astype(np.uint32)


def hash_functions():
    import numpy as np

    return np.random.default_rng(20_240_229).integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)


def size_class(n: int) -> int:
    """Shingles of the windows that an item of n shingles is compared with."""
    size = BLOCK
    while size < n:
        size *= 2
    return size


def mark(size: int, k: int, value):
    """64-bit key of the minimum ``value`` (array) of hash function k in windows of ``size``; the same for short items' shingles."""
    import numpy as np

    x = value.astype(np.uint64) + np.uint64((size * (HASHES + 1) + k) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Filter:
    """Bloom filter with two probes."""

    def __init__(self, words, bits: int):
        self.words, self.bits = words, bits

    def has(self, keys):
        import numpy as np

        one, two = _probes(keys, self.bits)
        return ((self.words[one >> 6] >> (one & 63).astype(np.uint64)) & (self.words[two >> 6] >> (two & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _probes(keys, bits: int):
    import numpy as np

    keys = np.asarray(keys).view(np.uint64)
    return (keys & np.uint64(bits - 1)).astype(np.int64), ((keys >> np.uint64(29)) & np.uint64(bits - 1)).astype(np.int64)


def _filter(keys: DataFrame, key: str, n: int) -> Filter:
    """The filter of a column of keys; its words are put together in Spark, so at most FILTER_BITS / 64 rows reach the driver."""
    import numpy as np

    bits = 1 << 16
    while bits < min(FILTER_BITS, BITS_A_KEY * n):
        bits *= 2
    probe = F.explode(F.array(F.col(key).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 29).bitwiseAND(F.lit(bits - 1)))).alias("p")
    rows = keys.select(probe).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("w")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[rows.column("at").to_numpy()] = rows.column("w").to_numpy().view(np.uint64)
    return Filter(words, bits)


def item_marks(w) -> tuple[int, list, list]:
    """(size class, marks of the minima, shingles in order) of an item's words; a short item's class is its length."""
    import numpy as np

    if len(w) < SHINGLE:
        return len(w), mark(len(w), 0, shingle_hashes(w, len(w))).view(np.int64).tolist(), []
    s = shingle_hashes(w)
    size, low = size_class(len(s)), (short_hash(s)[:, None] * hash_functions()).min(0)
    return size, [int(mark(size, k, low[k : k + 1]).view(np.int64)[0]) for k in range(HASHES)], s.view(np.int64).tolist()


def block_minima(shingles: list, mul):
    """Minima of every hash function over the blocks of each document, (hashes, blocks), and the blocks' documents."""
    import numpy as np

    padded, owner = [], []
    for d, s in enumerate(shingles):
        if len(s):
            n = -(-len(s) // BLOCK)
            block = np.full(n * BLOCK, short_hash(s[-1:])[0], dtype=np.uint32)
            block[: len(s)] = short_hash(s)
            padded.append(block.reshape(n, BLOCK))
            owner.append(np.full(n, d))
    if not padded:
        return np.zeros((len(mul), 0), dtype=np.uint32), np.zeros(0, dtype=np.int64)
    grid = np.ascontiguousarray(np.concatenate(padded).T)  # (BLOCK, blocks): minima run over whole rows
    out, work = np.empty((len(mul), grid.shape[1]), dtype=np.uint32), np.empty_like(grid)
    for k, m in enumerate(mul):
        np.multiply(grid, m, out=work)
        work.min(axis=0, out=out[k])
    return out, np.concatenate(owner)


def known_marks(minima, owner, sizes: list[int], known: Filter) -> list:
    """(documents, marks) of the minima of all windows of the sizes that the filter knows."""
    import numpy as np

    found, wide = [], 1
    for size in sizes:
        while wide * BLOCK < size:  # windows twice as wide; beyond a document's end nothing is added
            joined = minima.copy()
            if minima.shape[1] > wide:
                same = owner[:-wide] == owner[wide:]
                joined[:, :-wide] = np.where(same, np.minimum(minima[:, :-wide], minima[:, wide:]), minima[:, :-wide])
            minima, wide = joined, wide * 2
        for k in range(len(minima)):
            marks = mark(size, k, minima[k])
            at = np.flatnonzero(known.has(marks))
            if len(at):
                found.append((owner[at], marks[at]))
    return found


def cut_down(doc, at, n: int = SHINGLE):
    """The words of the shingles at the places ``at`` and of gaps that a bridge may span; a 0 for all that is left out."""
    import numpy as np

    at = np.unique(at)
    keep = np.zeros(len(doc) + 1, dtype=np.int64)
    stop = np.minimum(at + n, len(doc))
    near = np.r_[at[1:] - stop[:-1] <= 2 * BRIDGE, False]
    stop[near] = np.maximum(stop[near], np.r_[at[1:], 0][near])
    np.add.at(keep, at, 1)
    np.add.at(keep, stop, -1)
    keep = np.cumsum(keep[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, keep, False]))
    gap = np.zeros(1, dtype=doc.dtype)
    return np.concatenate([x for a, b in zip(edges[::2], edges[1::2]) for x in (gap, doc[a:b])] or [doc[:0]])


def spread_out(cut):
    """A document that was cut down, with more room at each cut than a bridge can span."""
    import numpy as np

    return np.repeat(cut, np.where(np.asarray(cut) == 0, 2 * BRIDGE + 1, 1))


def share(own, doc) -> float:
    """Share of the item's words ``own`` that stand in the document in the item's order, in stretches begun by exact shingles."""
    import numpy as np

    own, doc = np.asarray(own).view(np.uint64), np.asarray(doc).view(np.uint64)
    n = min(SHINGLE, len(own))
    if not n or len(doc) < n:
        return 0.0
    at: dict[int, list[int]] = {}
    for pos, x in enumerate(shingle_hashes(own, n).tolist()):
        at.setdefault(x, []).append(pos)
    places = [(j, at[x]) for j, x in enumerate(shingle_hashes(doc, n).tolist()) if x in at]
    if not places:
        return 0.0
    # exact runs along diagonals
    runs: dict[int, list[list[int]]] = {}
    for j, at_item in places:
        for i in at_item:
            line = runs.setdefault(j - i, [])
            if line and j <= line[-1][1]:
                line[-1][1] = max(line[-1][1], j + n)
            else:
                line.append([j, j + n])
    pieces = sorted((a, b, a - diag, b - diag) for diag, line in runs.items() for a, b in line)  # doc from, to, item from, to
    # best chain in order over all earlier pieces, bridging small gaps by the words they have in common; of pieces too far
    # back for a bridge only the place in the item and the score matter, so the best of each place stands for all of them
    spans = sorted({(i, e) for _, _, i, e in pieces})
    slot = {x: k for k, x in enumerate(spans)}
    starts, ends = np.array(spans).T
    far = np.full(len(spans), -np.inf)
    best: list[float] = []
    near: list[int] = []
    for k, (a, b, i, e) in enumerate(pieces):
        score = float(e - i)
        gone = [p for p in near if a - pieces[p][1] > 2 * BRIDGE]
        if gone:
            for p in gone:
                x = slot[pieces[p][2:]]
                far[x] = max(far[x], best[p])
            near = [p for p in near if a - pieces[p][1] <= 2 * BRIDGE]
        for p in near:
            pa, pb, pi, pe = pieces[p]
            if pe <= i or (pi < i and pe < e):
                cut = max(0, pe - i, pb - a)
                if e - i - cut <= 0:
                    continue
                gain = best[p] + (e - i - cut)
                gi, gj = i - pe, a - pb
                if 0 < gi <= BRIDGE and 0 < gj <= 2 * BRIDGE:
                    gain += _common(own[pe:i], doc[pb:a])
                score = max(score, gain)
        if len(near) < k:
            gains = np.where((ends <= i) | (starts < i) & (ends < e), far - np.maximum(ends - i, 0), -np.inf)
            score = max(score, float(gains.max()) + (e - i))
        best.append(score)
        near.append(k)
    return max(best) / len(own)


def _common(a, b) -> int:
    """Length of the longest common subsequence of two short arrays."""
    row = [0] * (len(b) + 1)
    for x in a.tolist():
        last = 0
        for k, y in enumerate(b.tolist(), 1):
            keep = row[k]
            row[k] = last + 1 if x == y else max(row[k], row[k - 1])
            last = keep
    return row[-1]


def _scan(batches: Iterator, sizes: list[int], known: Filter, shingled: Filter, least_hits: float) -> Iterator:
    """(doc, uid, words of known shingles and of short gaps, known shingles, known marks) of the documents that may hold an item."""
    import numpy as np
    import pyarrow as pa

    mul, short = hash_functions(), [x for x in sizes if x < SHINGLE]
    windows = sorted(x for x in sizes if x >= SHINGLE)
    for batch in batches:
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        rows, kept, hits, keys = [], [], [], []
        first = 0
        while first < len(offsets) - 1:
            # so many documents at a time that the arrays stay in the cache's reach
            last = first + 1
            while last < len(offsets) - 1 and offsets[last + 1] - offsets[first] < 200_000:
                last += 1
            docs = [flat[offsets[d] : offsets[d + 1]] for d in range(first, last)]
            shingles = [shingle_hashes(w) for w in docs]
            marks: dict[int, list] = {}
            if windows:
                found = known_marks(*block_minima(shingles, mul), windows, known)
                if found:
                    owner, values = (np.concatenate(x) for x in zip(*found))
                    order = np.argsort(owner, kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
                        marks[int(owner[part[0]])] = [values[part]]
            at: dict[int, list] = {}
            for n in short:
                for d, w in enumerate(docs):
                    if len(w) >= n:
                        m = mark(n, 0, shingle_hashes(w, n))
                        p = np.flatnonzero(known.has(m))
                        if len(p):
                            marks.setdefault(d, []).append(m[p])
                            at.setdefault(d, []).append(p)
            for d, own in marks.items():
                hit = np.flatnonzero(shingled.has(shingles[d]))
                # no chain can cover more than a shingle and a bridge for each shingle found
                if d in at or len(hit) >= least_hits:
                    rows.append(first + d)
                    kept.append(cut_down(docs[d], np.concatenate([hit, *at.get(d, [])])).view(np.int64))
                    hits.append(np.unique(shingles[d][hit]).view(np.int64))
                    keys.append(np.unique(np.concatenate(own)).view(np.int64))
            first = last
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(y) for y in x])].astype(np.int32)), pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64)))
        at_rows = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at_rows), batch.column(1).take(at_rows), lists(kept), lists(hits), lists(keys)], names=["doc", "uid", "w", "hits", "keys"])


def _step(at: Column, k: Column) -> Column:
    """Words that the k-th place of a sorted array can cover before the next one, bridge included."""
    last = F.when(k < F.size(at), F.element_at(at, F.least(k + 1, F.size(at))) - F.element_at(at, k))
    return F.when(last <= SHINGLE + BRIDGE, last).otherwise(SHINGLE)


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc, item, share): documents that hold at least ``least_share`` of an item's words in the item's order.

    The ids keep their types. Rows of ``docs`` with the same id are searched one by one.
    """
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    named = items.where(F.col(passage).isNotNull()).select(F.col(item_id).alias("item"), F.xxhash64(passage).alias("pid"), F.col(passage).alias("passage"))
    passages = written(named.groupBy("pid").agg(F.min("passage").alias("p")).select("pid", words(F.col("p")).alias("own")).where("size(own) > 0"), "passages")

    def marked(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for pid, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size, low, shingles = item_marks(np.array(own, dtype=np.int64).view(np.uint64))
                out += [(pid, size, x, 0) for x in low] + [(pid, 0, x, k) for k, x in enumerate(shingles)]
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=["pid", "size", "key", "at"])

    marks = written(passages.mapInArrow(marked, "pid long, size int, key long, at int"), "marks")  # size 0: a shingle and its place
    counts = {r["size"]: r["count"] for r in marks.groupBy("size").count().collect()}
    sizes = sorted(x for x in counts if x)
    if not sizes:
        return spark.createDataFrame([], f"doc {kind}, item {items.schema[item_id].dataType.simpleString()}, share double")
    shortest = passages.agg(F.min(F.size("own"))).first()[0]
    known, shingled = _filter(marks.where("size > 0"), "key", sum(counts[x] for x in sizes)), _filter(marks.where("size = 0"), "key", counts.get(0, 0))
    sent = send(spark, (sizes, known, shingled, least_share * shortest / (SHINGLE + BRIDGE)))
    prepared = docs.where(F.length(text) > 0).select(F.col(doc_id).alias("doc"), F.xxhash64(doc_id, text).alias("uid"), words(F.col(text)).alias("w"))
    found = written(prepared.mapInArrow(lambda batches: _scan(batches, *received(sent)), f"doc {kind}, uid long, w array<long>, hits array<long>, keys array<long>"), "suspects")
    pairs = found.select("uid", F.explode("keys").alias("key")).join(marks.where("size > 0").select("key", "pid"), "key").select("uid", "pid").distinct()
    # pairs whose shingles, with bridges, can cover as many of the item's words as a chain needs; a short item's only mark is its shingle
    held = found.select("uid", F.explode("hits").alias("key")).join(marks.where("size = 0").select("key", "pid", "at"), "key").groupBy("uid", "pid").agg(F.array_sort(F.collect_set("at")).alias("at"))
    reach = F.aggregate(F.sequence(F.lit(1), F.size("at")), F.lit(0), lambda sum_, k: sum_ + _step(F.col("at"), k))
    lengths = passages.select("pid", F.size("own").alias("n"))
    likely = pairs.join(held, ["uid", "pid"], "left").join(lengths, "pid").where((F.col("n") < SHINGLE) | (reach >= F.col("n") * least_share))
    likely = written(likely.select("uid", "pid"), "likely")
    tried = found.select("doc", "uid", "w").join(likely, "uid").join(passages, "pid").select("doc", "pid", "w", "own")

    def verified(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            cut = [(x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)) for x in (batch.column(2), batch.column(3))]
            docs, owns = ([v[o[k] : o[k + 1]] for k in range(batch.num_rows)] for o, v in cut)
            shares = [share(own, spread_out(doc)) for doc, own in zip(docs, owns)]
            keep = np.flatnonzero(np.array(shares) >= least_share)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([shares[k] for k in keep], pa.float64())], names=["doc", "pid", "share"])

    out = tried.mapInArrow(verified, f"doc {kind}, pid long, share double")
    return out.join(named.select("pid", "item"), "pid").select("doc", "item", "share")
