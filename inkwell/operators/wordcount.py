"""Distributed word count. One aggregation by word; per-record counts only where they are asked for.

The partial hash aggregate is the combiner of the map side; the number of reduce shards is
``spark.sql.shuffle.partitions``. Null texts have no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import sanitized
from inkwell.functions.words import tokens, tokens_of_sanitized


def word_rows(df: DataFrame, text: str, *keep: str, tokenizer=tokens) -> DataFrame:
    if tokenizer is tokens:
        return sanitized(df, text, "_text", *keep).select(*keep, F.explode(tokens_of_sanitized(F.col("_text"))).alias("word"))
    return df.select(*keep, F.explode(tokenizer(F.col(text))).alias("word"))


def word_counts(df: DataFrame, text: str, tokenizer=tokens) -> DataFrame:
    """(word, count)."""
    return word_rows(df, text, tokenizer=tokenizer).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def record_word_counts(df: DataFrame, record: str, text: str, tokenizer=tokens) -> DataFrame:
    """(record, word, count), exact also where a record's paragraphs lie in several partitions. Null records are left out."""
    rows = word_rows(df.where(F.col(record).isNotNull()), text, record, tokenizer=tokenizer)
    return rows.groupBy(record, "word").agg(F.count(F.lit(1)).alias("count"))


def totals(per_record: DataFrame) -> DataFrame:
    """(word, count) from per-record counts: the second stage of a two-stage count."""
    return per_record.groupBy("word").agg(F.sum("count").alias("count"))


def top_words(counts: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent words; ties by the alphabet. Planned as TakeOrderedAndProject."""
    return counts.orderBy(F.desc("count"), "word").limit(n)


def unflagged(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag isn't true; null keeps the row."""
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


def conservation(df: DataFrame, record: str, text: str) -> DataFrame:
    """Occurrences before and after both stages, which must agree (null records left out)."""
    mapped = word_rows(df.where(F.col(record).isNotNull()), text).agg(F.count(F.lit(1)).alias("before"))
    reduced = totals(record_word_counts(df, record, text)).agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("after"))
    return mapped.join(F.broadcast(reduced))  # two single rows


def vocabulary_tail(counts: DataFrame) -> DataFrame:
    """Size of the vocabulary, words seen once and their share."""
    once: Column = F.count_if(F.col("count") == 1)
    return counts.agg(F.count(F.lit(1)).alias("words"), once.alias("once"), F.round(once / F.count(F.lit(1)), 4).alias("share"))
