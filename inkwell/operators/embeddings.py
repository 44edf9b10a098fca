"""Title embeddings by mean pooling over a word-vector model, and exact cosine top-k in blocks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.words import title_tokens
from inkwell.session import received, send


def title_words(papers: DataFrame) -> DataFrame:
    """(cord_uid, word) of usable titles, with multiplicity."""
    return papers.where("title_ok").select("cord_uid", F.explode(title_tokens(F.col("title_norm"))).alias("word"))


def model_of(model: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of the model whose word occurs: a semi join, broadcast by the planner if the vocabulary is small."""
    return model.join(words.select("word").distinct(), "word", "left_semi")


def mean_pooled(words: DataFrame, model: DataFrame, key: str = "cord_uid", digits: int | None = None) -> DataFrame:
    """(key, n_words, vec): mean of the vectors of a title's words, in double, cast to float. No known word, no row.

    Partial aggregation by Summarizer: one vector per title and partition is shuffled, not one per word.
    """
    joined = words.join(model, "word").select(key, array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
    pooled = joined.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n_words"), Summarizer.mean(F.col("v")).alias("m"))
    values = vector_to_array("m")
    return pooled.select(key, "n_words", F.transform(values, lambda x: F.round(x, digits)).alias("vec") if digits is not None else values.cast("array<float>").alias("vec"))


def with_flags(pooled: DataFrame, papers: DataFrame) -> DataFrame:
    return pooled.join(papers.select("cord_uid", "title", "is_title_unique"), "cord_uid", "left").select("cord_uid", "title", "is_title_unique", "n_words", "vec")


def coverage(papers: DataFrame, words: DataFrame, model: DataFrame) -> DataFrame:
    """One row: usable titles and those with a known word, tokens and known tokens, vocabulary and its known words, and the shares.

    A share of nothing is null.
    """
    known = words.select("cord_uid", "word").join(model.select("word", F.lit(1).alias("known")), "word", "left")
    per_word = known.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("known"))
    tokens = per_word.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("tokens_matched"), F.count(F.lit(1)).alias("vocabulary"), F.count("known").alias("model_words"))
    titles = papers.where("title_ok").agg(F.count(F.lit(1)).alias("titles"))
    embedded = known.where("known = 1").agg(F.count_distinct("cord_uid").alias("titles_embedded"))
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 4)
    one = titles.join(embedded).join(tokens)  # single rows
    return one.select("*", share("titles_embedded", "titles").alias("title_coverage"), share("tokens_matched", "tokens").alias("token_coverage"), share("model_words", "vocabulary").alias("vocabulary_coverage"))


def cosine(u: Column, v: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(u, v) / (F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)))


QUERY_BLOCK = 4_096


def cosine_top_k(queries: DataFrame, base: DataFrame, key: str, vec: str, k: int = 10) -> DataFrame:
    """(query, other, cosine, rank): exact; a stated query set against all rows.

    The queries go to the rows in blocks of QUERY_BLOCK, each partition keeps k per query, so what is broadcast and what
    is shuffled are bounded. Ties by the smaller key. Null and zero vectors take no part.
    """
    kind = base.schema[key].dataType.simpleString()
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    rows = base.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec"))
    out = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).where(F.col(vec).isNotNull()).select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec")).collect()
        sent = send(base.sparkSession, ([r.key for r in part], [r.vec for r in part]))
        found = rows.mapInPandas(lambda it, s=sent: _best(it, received(s), k), f"query {kind}, other {kind}, cosine double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "other")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(batches: Iterator, block: tuple, k: int) -> Iterator:
    import numpy as np
    import pandas as pd

    ids, vectors = block
    usable = [n for n, v in enumerate(vectors) if any(v)]
    if not usable:
        return
    q = np.array([vectors[n] for n in usable])
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    names = [ids[n] for n in usable]
    asked = pd.DataFrame({"name": names, "q": range(len(names))})
    for pdf in batches:
        pdf = pdf[[v is not None and len(v) == q.shape[1] and bool(np.any(v)) for v in pdf["vec"]]]
        if not len(pdf):
            continue
        x = np.stack(pdf["vec"].to_list())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        keys, scores = pdf["key"].to_numpy(), q @ x.T
        own = asked.merge(pd.DataFrame({"name": keys, "b": range(len(keys))}), on="name")
        scores[own["q"], own["b"]] = -2.0  # a row isn't its own neighbour
        n = min(k, scores.shape[1])
        kth = np.partition(scores, -n, axis=1)[:, -n]
        at_q, at_b = np.nonzero((scores >= kth[:, None]) & (scores > -2.0))
        yield pd.DataFrame({"query": np.array(names, dtype=object)[at_q], "other": keys[at_b], "cosine": scores[at_q, at_b]})
