import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwell.operators import affiliations, dimensions, embeddings, partitioning, profile, quality, silver, wordcount
from inkwell.session import describe, written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_count(spark):
    df = spark.createDataFrame([("a", "virus host virus"), ("a", "host"), ("b", None), (None, "virus"), ("c", "")], "r string, t string")
    assert {r.word: r["count"] for r in wordcount.word_counts(df, "t").collect()} == {"virus": 3, "host": 2}
    assert {(r.r, r.word): r["count"] for r in wordcount.record_word_counts(df, "r", "t").collect()} == {("a", "virus"): 2, ("a", "host"): 2}
    row = wordcount.conservation(df, "r", "t").first()
    assert row.before == row.after == 4
    assert [r.word for r in wordcount.top_words(wordcount.word_counts(df, "t"), 1).collect()] == ["virus"]
    assert wordcount.word_counts(df.limit(0), "t").count() == 0


def test_top_words_needs_no_full_sort(spark):
    df = spark.createDataFrame([("a b",)], "t string")
    assert "TakeOrderedAndProject" in plan(wordcount.top_words(wordcount.word_counts(df, "t"), 5))


def test_unflagged_keeps_null(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, f boolean")
    assert sorted(r.k for r in wordcount.unflagged(df, "f").collect()) == [2, 3]


def test_papers(spark):
    cols = "cord_uid string, title string, publish_time string, abstract string, pdf_json_files string, pmc_json_files string, mag_id string"
    rows = [
        ("a", None, "2020", "x", None, None, "1"), ("a", " A  Title ", "2020-01-02", " two\n words", "p", "q", "1"), ("b", "a title", "junk", None, None, "q", "1"), ("c", "  ", "", None, None, None, None),
        ("d", "ab", None, None, "p", None, None), ("d", "ab", None, None, "p", None, None),
    ]
    out = {r.cord_uid: r for r in silver.papers(spark.createDataFrame(rows, cols)).collect()}
    assert len(out) == 4 and "mag_id" not in out["a"].asDict()
    assert (out["a"].year, out["a"].title_norm, out["a"].title_dup_count, out["a"].is_title_unique, out["a"].title_ok, out["a"].abstract) == (2020, "a title", 2, False, True, "two words")
    assert out["b"].year is None and out["c"].title_norm is None and out["c"].is_title_unique is None and out["c"].title_ok is False
    assert out["d"].title_ok is False and out["d"].is_title_unique is True


def test_prefer_source_and_flags(spark):
    df = spark.createDataFrame([(1, "a", "PMC ", "References"), (2, "a", "pdf", None), (3, "b", "pdf", "Funding"), (4, None, "pdf", ""), (5, "c", None, "x")], "id int, cord_uid string, source string, section string")
    assert sorted(r.id for r in silver.prefer_source(df).collect()) == [1, 3, 4, 5]
    assert {r.id: r.is_reference_like for r in silver.paragraphs(df).collect()} == {1: True, 3: True, 4: False, 5: False}
    assert "getbit" in plan(silver.prefer_source(df))  # rows of unknown size: filtered before the join


def test_richest_breaks_ties_always_alike(spark):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 1), ("k", None, 0), (None, "z", 5)], "key string, v string, r int")
    assert sorted((str(r.key), r.v) for r in silver.richest(df, "key", F.col("r")).collect()) == [("None", "z"), ("k", "a")]


def test_institutions_and_countries(spark):
    names = spark.createDataFrame([("GBR", "United Kingdom", None), ("DEU", "Germany", ["Deutschland"]), ("CHN", "China", []), ("USA", "United States", ["USA"])], "iso3 string, name string, alt_names array<string>")
    raw = ["uk", "Deutschland", "China; USA", "???", "Wales", " germany ", None, "", "UK / China"]
    df = spark.createDataFrame([(r, f" {r},") for r in raw], "country_raw string, institution string")
    got = {r.raw: r.country_iso3 for r in dimensions.country_dimension(df, "country_raw", names).collect()}
    assert got == {"uk": "GBR", "Deutschland": "DEU", "China; USA": "CHN", "???": None, "Wales": "GBR", " germany ": "DEU", "": None, "UK / China": "GBR"}
    out = silver.authors(df, dimensions.country_dimension(df, "country_raw", names)).collect()
    assert len(out) == len(raw) and {r.institution_norm for r in out} >= {"uk", "China; USA", "None"}


def test_affiliation_lists(spark):
    df = spark.createDataFrame([("FRA", "France")] * 3 + [("", "Atlantis")] * 2 + [(None, "Atlantis"), ("X", "nan"), ("BEL", "Belgium"), ("BEL", "Belgium"), ("CZE", "Czechia")], "country_iso3 string, country string")
    counts = affiliations.country_counts(df)
    assert {(r.country_iso3, r.country): r.paper_count for r in counts.collect()} == {("FRA", "France"): 3, ("", "Atlantis"): 3, ("BEL", "Belgium"): 2, ("CZE", "Czechia"): 1}
    assert [r.country for r in affiliations.top(counts, "paper_count", "country", 2).collect()] == ["Atlantis", "France"]
    assert [r.country for r in affiliations.bottom(counts, "paper_count", 3, 2).collect()] == ["Belgium", "Atlantis", "France"]


def test_mean_pooling_counts_words_with_multiplicity(spark):
    words = spark.createDataFrame([("t", "a"), ("t", "a"), ("t", "b"), ("u", "none")], "cord_uid string, word string")
    model = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [4.0, 3.0]), ("unused", [9.0, 9.0])], "word string, vec array<float>")
    out = embeddings.mean_pooled(words, embeddings.model_of(model, words)).collect()
    assert [(r.cord_uid, r.n_words, r.vec) for r in out] == [("t", 3, [2.0, 1.0])]


def test_cosine_top_k(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, 0.0])], "id long, v array<float>")
    out = embeddings.cosine_top_k(df.where("id = 1"), df, "id", "v", 2).orderBy("rank").collect()
    assert [r.other for r in out] == [6, 2] and out[0].cosine == pytest.approx(1.0)


def test_profile(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), (None, "x"), ("b", "y")], "k string, v string")
    assert [(r.column_name, r.null_pct) for r in profile.null_shares(df).collect()] == [("k", 25.0), ("v", 25.0)]
    assert [tuple(r) for r in profile.key_integrity(df, ["k"]).collect()] == [("k", 3, 2, 1)]
    assert [tuple(r) for r in profile.value_counts(df, "v").collect()] == [("x", 2), ("y", 1)]
    times = spark.createDataFrame([(1, 8.0), (2, 5.0), (4, 3.0)], "n int, s double")
    assert {r.n: (r.speedup, r.efficiency) for r in profile.speedup(times, "n", "s").collect()}[2] == (1.6, 0.8)


def test_invariants(spark):
    a = spark.createDataFrame([("x", "pmc"), ("x", "pdf"), ("y", "pdf"), (None, "pdf")], "k string, s string")
    b = spark.createDataFrame([("x",)], "k string")
    assert quality.orphans(a, b, "k").first().violations == 1
    assert quality.overlapping(a, "k", "s", "pmc", "pdf").first().violations == 1
    assert quality.duplicate_keys(a, "k").first().violations == 1
    assert quality.nulls(a, "k").first().violations == 1 and quality.outside(a, "s", ["pdf"]).first().violations == 1


def test_partitions_and_timeout(spark):
    df = spark.range(100).repartition(8)
    assert [partitioning.exactly(df, k).rdd.getNumPartitions() for k in (1, 3, 8, 0, 16)] == [1, 3, 8, 1, 16]
    assert partitioning.with_timeout(df, lambda x: x.count(), 60) == 100
    slow = spark.range(4).repartition(4).rdd.map(lambda x: time.sleep(30)).map(lambda x: (1,)).toDF("x int")
    with pytest.raises(TimeoutError):
        partitioning.with_timeout(slow, lambda x: x.count(), 1)


def test_written_table_and_description(spark):
    df = written(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"))
    assert sorted(map(tuple, df.collect()), key=str) == [(1, None), (2, "x")]
    assert describe(spark)["master"] == "local[4]" and describe(spark)["shared_folder"]


def test_counter_equals_python(spark, data):
    df = spark.read.parquet(f"{data}/paragraphs.parquet")
    from test_text import python_tokens

    true = Counter(w for r in df.select("text").collect() if r.text for w in python_tokens(r.text))
    assert {r.word: r["count"] for r in wordcount.word_counts(df, "text").collect()} == dict(true)


def test_no_own_folder_on_a_cluster(monkeypatch):
    from inkwell import session

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.shared_folder(type("S", (), {"sparkContext": Context})())


def test_code_on_every_slot(spark):
    from inkwell.operators import partitioning

    assert len(partitioning.on_every_slot(spark, lambda: "here")) >= spark.sparkContext.defaultParallelism


def test_prefer_source_with_many_keys(spark):
    """The same rows where the keys are taken for too many to send, by way of the filter."""
    rows = [("a", "PMC ", "t1"), ("a", "pdf", "t2"), ("b", "pdf", "t3"), ("b", None, "t4"), (None, "pdf", "t5"), (None, "pmc", "t6")]
    rows += [(f"k{k}", s, f"{k} {s}") for k in range(500) for s in (("pdf", "pmc") if k % 2 else ("pdf",))]
    df = spark.createDataFrame(rows, "cord_uid string, source string, text string")
    few = sorted(r.text for r in silver.prefer_source(df).collect())
    assert {"t1", "t3", "t4", "t5", "t6"} <= set(few) and "t2" not in few and len(few) == 5 + 500
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert few == sorted(r.text for r in silver.prefer_source(df).collect())
        assert silver.prefer_source(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_filter_keeps_every_wanted_row(spark):
    from inkwell.operators import partitioning

    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("_x")).unionByName(spark.createDataFrame([(None, "x")], "k string, _x string"))
    keys = spark.range(0, 2_000, 2).select(F.col("id").cast("string").alias("k"))
    for bits in (1 << 26, 1 << 10):
        kept = {r.k for r in partitioning.maybe_among(df, "k", keys, bits).collect()}
        assert kept >= {str(k) for k in range(0, 2_000, 2)} and None not in kept and (bits < 1 << 20 or len(kept) < 1_010)
    assert partitioning.maybe_among(df, "k", keys.limit(0)).count() == 0


def test_threads_and_curves(spark):
    from inkwell.operators import profile

    df = spark.createDataFrame([(4, 16, 2.0), (4, 15, None), (8, 16, 3.0)], "workers int, threads int, s double")
    assert [r.t for r in df.select(profile.threads_per_worker("threads", "workers").alias("t")).collect()] == [4, 4, 2]
    assert [tuple(r) for r in profile.curve(df, "workers", "s").orderBy("workers").collect()] == [(4, 2.0, 2.0, 2.0, 1), (8, 3.0, 3.0, 3.0, 0)]
    assert [r.workers for r in profile.failed_points(df, "workers", "s").collect()] == [4]


def test_written_tables_can_be_forgotten(spark):
    from inkwell import session

    kept = session.written(spark.range(3), "t")
    assert kept.count() == 3 and session.forget_scratch(spark) >= 1
    with pytest.raises(Exception):
        kept.withColumn("x", kept.id + 1).collect()


def test_profiles_of_odd_json_and_of_nothing(spark):
    from inkwell.operators import embeddings, profile

    rows = [("a", None), (None, ""), ("a", "{"), ("a", "[1]"), ("a", '{"metadata":3,"body_text":{"a":1}}'), ("b", '{"body_text":[1,null,{"x":2}],"metadata":{"authors":[{"affiliation":{}},{"affiliation":{"i":1}},null,4]}}')]
    df = spark.createDataFrame(rows, "source string, body string")
    levels = lambda x: {tuple(r) for r in profile.json_level_keys(x, "body", {"top": "$", "meta": "$.metadata"}, {"p": "$.body_text"}).collect()}
    assert levels(df) == {("meta", "authors", 1), ("p", "x", 1), ("top", "body_text", 2), ("top", "metadata", 2)} and levels(df.limit(0)) == set()
    got = {r.source: tuple(r)[1:] for r in profile.paper_json_profile(df, "source", "body").collect()}
    assert got == {"a": (4, 0, 4, 4, 0, 0, "body_text,metadata"), None: (1, 0, 1, 1, 0, 0, ""), "b": (1, 0, 0, 0, 4, 1, "body_text,metadata")}
    empty = lambda schema: spark.createDataFrame([], schema)
    one = embeddings.coverage(empty("cord_uid string, title_ok boolean"), empty("cord_uid string, word string"), empty("word string, vec array<float>")).first()
    assert tuple(one) == (0, 0, 0, 0, 0, 0, None, None, None)
    assert profile.pivot_means(empty("i int, c string, v double"), "i", "c", "v", ["a", "b"]).count() == 0
    assert dimensions.country_dimension(spark.createDataFrame([("x",), (None,)], "country_raw string"), "country_raw", empty("iso3 string, name string, alt_names array<string>")).collect() == [("x", None, None)]
