"""Queries over the whole test tables for the reference's own operators, each with equivalent SQL.

SQL that needs Unicode normalisation spells out the four characters of the test data that it changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import words
from inkwell.functions.text import clean_str, collapse, strip
from inkwell.operators import affiliations, dimensions, embeddings, partitioning, profile, quality, silver, wordcount
from inkwell.session import scratch, spread, written
from inkwell.sources import files, readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _text(spark: SparkSession, d: str) -> DataFrame:
    return spread(_read(spark, d, "paragraphs").select("row_id", "cord_uid", "section", "text"), "row_id")


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def _nfkc(x: str) -> str:
    return f"replace(replace(replace(replace({x}, 'µ', 'μ'), '³', '3'), 'ﬁ', 'fi'), chr(160), ' ')"


def _fold(x: str) -> str:
    return f"""translate({x}, '‐‑‒–—―−‘’‚‛“”„', '-------''''''''""\"')"""


_SANE = _fold(f"lower({_nfkc(r'''regexp_replace(text, '(?s)\\documentclass.*?\\end\{document\}', ' ', 'g')''')})")
_WORDS = f"w AS (SELECT cord_uid, row_id, section, unnest(regexp_extract_all({_SANE}, '{words.TOKEN}')) AS word FROM paragraphs WHERE text IS NOT NULL), k AS (SELECT * FROM w WHERE length(word) >= 2 AND word NOT IN ({_list(words.STOPWORDS + words.ARTIFACTS)}))"
_PLAIN = f"""w AS (SELECT unnest(regexp_extract_all({_fold(f"lower({_nfkc('text')})")}, '{words.PLAIN_TOKEN}')) AS word FROM paragraphs WHERE text IS NOT NULL), k AS (SELECT * FROM w WHERE length(word) >= 2 AND word NOT IN ({_list(words.PLAIN_STOPWORDS)}))"""

# --- word count ---------------------------------------------------------------------------------------------------


@query(f"WITH {_WORDS} SELECT word, count(*)::BIGINT AS count FROM k GROUP BY word")
def wc_global(spark, d):
    return wordcount.word_counts(_text(spark, d), "text")


@query(f"WITH {_WORDS} SELECT word, count(*)::BIGINT AS count FROM k GROUP BY word ORDER BY count DESC, word LIMIT 20")
def wc_top20(spark, d):
    return wordcount.top_words(wordcount.word_counts(_text(spark, d), "text"), 20)


@query(f"WITH {_WORDS} SELECT cord_uid, word, count(*)::BIGINT AS count FROM k WHERE cord_uid IS NOT NULL GROUP BY cord_uid, word")
def wc_doc_counts(spark, d):
    return wordcount.record_word_counts(_text(spark, d), "cord_uid", "text")


@query(f"WITH {_WORDS} SELECT word, count(*)::BIGINT AS count FROM k WHERE cord_uid IS NOT NULL GROUP BY word")
def wc_two_stage(spark, d):
    return wordcount.totals(wordcount.record_word_counts(_text(spark, d), "cord_uid", "text"))


@query(f"WITH {_PLAIN} SELECT word, count(*)::BIGINT AS count FROM k GROUP BY word")
def wc_old_tokenizer(spark, d):
    return wordcount.word_counts(_text(spark, d), "text", words.plain_tokens)


@query(f"WITH {_WORDS} SELECT word, count(*)::BIGINT AS count FROM k WHERE NOT regexp_matches(lower(coalesce(section, '')), '{silver.REFERENCE_SECTION}') GROUP BY word")
def wc_exclude_flagged(spark, d):
    flagged = _text(spark, d).withColumn("flag", F.when(F.col("section").isNotNull(), silver.reference_like(F.col("section"))))
    return wordcount.word_counts(wordcount.unflagged(flagged, "flag"), "text")


@query(f"WITH {_WORDS} SELECT count(*)::BIGINT AS before, count(*)::BIGINT AS after FROM k WHERE cord_uid IS NOT NULL")
def wc_conservation(spark, d):
    return wordcount.conservation(_text(spark, d), "cord_uid", "text")


@query(f"WITH {_WORDS} SELECT word, count(*)::BIGINT AS count FROM k GROUP BY word HAVING count(*) >= 10")
def wc_min_count(spark, d):
    return wordcount.word_counts(_text(spark, d), "text").where("count >= 10")


@query(f"WITH {_WORDS}, c AS (SELECT word, count(*) AS n FROM k GROUP BY word) SELECT count(*)::BIGINT AS words, count(*) FILTER (n = 1)::BIGINT AS once, round(count(*) FILTER (n = 1)::DOUBLE / count(*), 4) AS share FROM c")
def wc_hapax_share(spark, d):
    return wordcount.vocabulary_tail(wordcount.word_counts(_text(spark, d), "text"))


@query(f"WITH {_WORDS} SELECT word, count(*)::BIGINT AS count FROM w WHERE length(word) >= 2 AND word NOT IN ('levels', 'infection') GROUP BY word")
def wc_stopword_file(spark, d):
    own = words.parse_stopwords(["# own list", "Levels", "", "infection "], with_default=False)
    return wordcount.word_counts(_text(spark, d), "text", lambda c: words.tokens(c, own))


@query("SELECT row_id, length(regexp_replace(text, '(?s)\\\\documentclass.*?\\\\end\\{document\\}', ' ', 'g'))::BIGINT AS kept FROM paragraphs WHERE text IS NOT NULL")
def text_without_latex(spark, d):
    from inkwell.functions.text import without_latex

    return _text(spark, d).where("text IS NOT NULL").select("row_id", F.length(without_latex(F.col("text"))).cast("long").alias("kept"))


@query(f"WITH {_WORDS}, p AS (SELECT cord_uid, word, count(*) AS n FROM k WHERE cord_uid IS NOT NULL GROUP BY cord_uid, word) SELECT word, count(*)::BIGINT AS papers, max(n)::BIGINT AS most FROM p GROUP BY word")
def wc_paper_spread(spark, d):
    return wordcount.record_word_counts(_text(spark, d), "cord_uid", "text").groupBy("word").agg(F.count(F.lit(1)).alias("papers"), F.max("count").alias("most"))


# --- rows from nested records -------------------------------------------------------------------------------------

_BODY = "b AS (SELECT rec_id, unnest(body_text) AS p, generate_subscripts(body_text, 1) - 1 AS para_idx FROM pdf_json)"


@query(f"WITH {_BODY} SELECT rec_id, para_idx::INTEGER AS para_idx, nullif({_strip('p.section')}, '') AS section, p.text AS text FROM b WHERE {_strip('p.text')} <> ''")
def json_paragraphs(spark, d):
    return readers.paragraph_rows(_read(spark, d, "pdf_json"), "rec_id")


@query(f"""WITH a AS (SELECT rec_id, unnest(metadata.authors) AS a, generate_subscripts(metadata.authors, 1) - 1 AS author_idx FROM pdf_json)
SELECT rec_id, author_idx::INTEGER AS author_idx, nullif({_strip('a.affiliation.institution')}, '') AS institution, nullif({_strip('a.affiliation.location.country')}, '') AS country_raw, nullif({_strip('a.affiliation.location.settlement')}, '') AS settlement FROM a WHERE a IS NOT NULL""")
def json_authors(spark, d):
    return readers.author_rows(_read(spark, d, "pdf_json"), "rec_id")


@query(f"WITH {_BODY} SELECT rec_id, string_agg(p.text, ' ' ORDER BY para_idx) AS full_text FROM b WHERE p.text IS NOT NULL GROUP BY rec_id")
def full_text_join(spark, d):
    texts = F.filter(F.transform("body_text", lambda p: p.getField("text")), lambda t: t.isNotNull())
    return _read(spark, d, "pdf_json").where(F.size(F.coalesce(texts, F.array().cast("array<string>"))) > 0).select("rec_id", F.array_join(texts, " ").alias("full_text"))


@query("SELECT rec_id, coalesce(json_valid(body), false) AS ok FROM raw_json")
def json_gate(spark, d):
    return readers.parsed_bodies(_read(spark, d, "raw_json"), "body").select("rec_id", "ok")


@query("WITH k AS (SELECT unnest(json_keys(body)) AS key FROM raw_json WHERE json_valid(body)) SELECT key, count(*)::BIGINT AS n FROM k GROUP BY key")
def json_key_frequency(spark, d):
    good = readers.parsed_bodies(_read(spark, d, "raw_json"), "body").where("ok")
    return profile.json_key_frequency(good, "body")


@query("""SELECT count(*)::BIGINT AS records, count(*) FILTER (len(abstract) > 0)::BIGINT AS with_abstract, count(*) FILTER (coalesce(len(body_text), 0) = 0)::BIGINT AS no_body,
count(*) FILTER (coalesce(len(metadata.authors), 0) = 0)::BIGINT AS no_authors FROM pdf_json""")
def parse_profile(spark, d):
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return _read(spark, d, "pdf_json").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(n("abstract") > 0).alias("with_abstract"), F.count_if(n("body_text") <= 0).alias("no_body"), F.count_if(n("metadata.authors") <= 0).alias("no_authors")
    )


# --- catalogue ----------------------------------------------------------------------------------------------------

_PATHS = "p AS (SELECT cord_uid, 'pdf' AS source, unnest(string_split(coalesce(pdf_json_files, ''), ';')) AS path FROM papers UNION ALL SELECT cord_uid, 'pmc', unnest(string_split(coalesce(pmc_json_files, ''), ';')) FROM papers)"


@query(f"WITH {_PATHS} SELECT cord_uid, source, {_strip('path')} AS path FROM p WHERE {_strip('path')} <> ''")
def catalogue_paths(spark, d):
    rows = _read(spark, d, "papers")
    part = lambda s: rows.select("cord_uid", F.lit(s).alias("source"), F.explode(readers.path_list(F.col(f"{s}_json_files"))).alias("path"))
    return part("pdf").unionByName(part("pmc"))


_NA = f"CASE WHEN {{0}} NOT IN ({_list(readers.NULL_TOKENS)}) THEN {{0}} END AS {{0}}"


@query("SELECT " + ", ".join(_NA.format(c) for c in ("cord_uid", "title", "publish_time", "license", "abstract")) + " FROM papers")
def csv_catalogue(spark, d):
    """The catalogue written as CSV and read back: quoted line breaks, quotes, missing values."""
    rows = _read(spark, d, "papers")
    path = scratch(spark, "csv")
    writers.write_csv(rows, path)
    return readers.read_catalogue(spark, path, rows.columns).select("cord_uid", "title", "publish_time", "license", "abstract")


_FLAGS = "f AS (SELECT *, try_cast(substr(publish_time, 1, 4) AS SMALLINT) AS year, pdf_json_files IS NOT NULL AS has_pdf, pmc_json_files IS NOT NULL AS has_pmc FROM papers)"
_COLUMNS = ["sha", "source_x", "title", "doi", "pmcid", "pubmed_id", "license", "abstract", "publish_time", "authors", "journal", "pdf_json_files", "pmc_json_files", "url", "s2_id"]
_RICHEST = f"{_FLAGS}, r AS (SELECT *, row_number() OVER (PARTITION BY cord_uid ORDER BY has_pdf::INT + has_pmc::INT DESC, {', '.join(c + ' ASC NULLS FIRST' for c in _COLUMNS)}) AS rn FROM f), one AS (SELECT * FROM r WHERE rn = 1)"


@query(f"WITH {_RICHEST} SELECT cord_uid, title, doi, pdf_json_files, pmc_json_files FROM one")
def papers_richest(spark, d):
    rows = _read(spark, d, "papers")
    rank = F.col("pdf_json_files").isNotNull().cast("int") + F.col("pmc_json_files").isNotNull().cast("int")
    return silver.richest(rows, "cord_uid", rank).select("cord_uid", "title", "doi", "pdf_json_files", "pmc_json_files")


_NORM = f"n AS (SELECT *, nullif({_collapse('lower(' + _strip('title') + ')')}, '') AS title_norm FROM one), c AS (SELECT title_norm, count(*)::INTEGER AS title_dup_count FROM n WHERE title_norm IS NOT NULL GROUP BY title_norm)"


@query(f"""WITH {_RICHEST}, {_NORM} SELECT n.cord_uid, coalesce(n.year, -1)::SMALLINT AS year, n.has_pdf, n.has_pmc, n.title_norm, coalesce(c.title_dup_count, 0)::INTEGER AS title_dup_count, n.title IS NOT NULL AND length({_strip('n.title')}) >= 3 AS title_ok,
c.title_dup_count = 1 AS is_title_unique, {_strip(_collapse('n.abstract'))} AS abstract FROM n LEFT JOIN c USING (title_norm)""")
def papers_silver(spark, d):
    return silver.papers(_read(spark, d, "papers")).select(
        "cord_uid", F.coalesce("year", F.lit(-1).cast("smallint")).alias("year"), "has_pdf", "has_pmc", "title_norm", F.coalesce("title_dup_count", F.lit(0)).alias("title_dup_count"), "title_ok", "is_title_unique", "abstract")


@query("SELECT * EXCLUDE (source_x) RENAME (s2_id AS scholar_id) FROM papers")
def drop_and_rename(spark, d):
    return _read(spark, d, "papers").drop("source_x", *silver.DEAD_COLUMNS).withColumnRenamed("s2_id", "scholar_id")


_TIDY = f"lower({_strip('source')})"


@query(f"SELECT row_id FROM paragraphs WHERE {_TIDY} = 'pmc' UNION ALL SELECT row_id FROM paragraphs p WHERE coalesce({_TIDY}, '') <> 'pmc' AND NOT EXISTS (SELECT 1 FROM paragraphs q WHERE q.cord_uid = p.cord_uid AND {_TIDY.replace('source', 'q.source')} = 'pmc')")
def prefer_source(spark, d):
    return silver.prefer_source(_read(spark, d, "paragraphs").select("row_id", "cord_uid", "source")).select("row_id")


@query(f"SELECT row_id, regexp_matches(lower(coalesce(section, '')), '{silver.REFERENCE_SECTION}') AS is_reference_like FROM paragraphs")
def reference_like_flag(spark, d):
    return _read(spark, d, "paragraphs").select("row_id", silver.reference_like(F.col("section")).alias("is_reference_like"))


@query(f"""WITH m AS (SELECT DISTINCT cord_uid FROM paragraphs WHERE {_TIDY} = 'pmc' AND cord_uid IS NOT NULL)
SELECT row_id, nullif({_strip('section')}, '') AS section, regexp_matches(lower(coalesce(nullif({_strip('section')}, ''), '')), '{silver.REFERENCE_SECTION}') AS is_reference_like, text FROM paragraphs p
WHERE {_TIDY} = 'pmc' OR NOT EXISTS (SELECT 1 FROM m WHERE m.cord_uid = p.cord_uid)""")
def paragraphs_silver(spark, d):
    return silver.paragraphs(_read(spark, d, "paragraphs").select("row_id", "cord_uid", "source", "section", "text")).select("row_id", "section", "is_reference_like", "text")


_INST = f"nullif(trim({_collapse(_nfkc('institution'))}, ' ,;.-' || chr(9)), '')"


@query(f"SELECT cord_uid, author_idx, institution, {_INST} AS institution_norm FROM authors")
def inst_norm(spark, d):
    return _read(spark, d, "authors").select("cord_uid", "author_idx", "institution", silver.norm_institution(F.col("institution")).alias("institution_norm"))


_KEY = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z]+', ' ', 'g'))"
#: Another way than the operator's: the names that the value contains, by their place in it.
_DIM = f"""al(akey, iso) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in dimensions.COUNTRY_ALIASES.items())}),
nm AS (SELECT {_KEY.format('n')} AS nkey, min(iso3) AS iso FROM (SELECT iso3, name AS n FROM countries UNION ALL SELECT iso3, unnest(alt_names) FROM countries) GROUP BY 1),
kn AS (SELECT regexp_replace(nkey, '(^| )([a-z]) ([a-z])( |$)', '\\1\\2\\3\\4', 'g') AS nkey, iso FROM nm WHERE nkey <> '' UNION ALL SELECT akey, iso FROM al WHERE akey NOT IN (SELECT nkey FROM nm)),
v AS (SELECT DISTINCT country_raw AS raw, ' ' || regexp_replace(regexp_replace({_KEY.format('country_raw')}, '\\b([a-z]) ([a-z])\\b', '\\1\\2', 'g'), '\\b([a-z][a-z]) ([a-z])\\b$', '\\1\\2') || ' ' AS k FROM authors WHERE country_raw IS NOT NULL),
hit AS (SELECT raw, iso, row_number() OVER (PARTITION BY raw ORDER BY strpos(k, ' ' || nkey || ' '), length(nkey) DESC) AS n FROM v JOIN kn ON contains(k, ' ' || nkey || ' ')),
dim AS (SELECT v.raw, iso AS country_iso3 FROM v LEFT JOIN hit ON hit.raw = v.raw AND n = 1),
dimension AS (SELECT raw, country_iso3, name AS country FROM dim LEFT JOIN countries ON iso3 = country_iso3)"""


def _dimension(spark, d):
    return dimensions.country_dimension(_read(spark, d, "authors"), "country_raw", _read(spark, d, "countries"))


def _silver_authors(spark, d):
    return silver.authors(_read(spark, d, "authors"), _dimension(spark, d))


@query(f"WITH {_DIM} SELECT raw, country_iso3, country FROM dimension")
def country_map(spark, d):
    return _dimension(spark, d)


_AUTHORS = f"{_DIM}, s AS (SELECT a.cord_uid, a.author_idx, {_INST.replace('institution', 'a.institution')} AS institution_norm, country_iso3, dimension.country FROM authors a LEFT JOIN dimension ON raw = country_raw)"


@query(f"WITH {_AUTHORS} SELECT * FROM s")
def authors_silver(spark, d):
    return _silver_authors(spark, d).select("cord_uid", "author_idx", "institution_norm", "country_iso3", "country")


@query(f"WITH {_AUTHORS} SELECT DISTINCT cord_uid, country_iso3, country FROM s WHERE country IS NOT NULL")
def paper_countries(spark, d):
    return silver.paper_rollup(_silver_authors(spark, d), "cord_uid", "country_iso3", "country")


@query(f"WITH {_AUTHORS} SELECT DISTINCT cord_uid, institution_norm FROM s WHERE institution_norm IS NOT NULL")
def paper_institutions(spark, d):
    return silver.paper_rollup(_silver_authors(spark, d), "cord_uid", "institution_norm")


@query(f"WITH {_AUTHORS} SELECT count(*)::BIGINT AS n_rows, count(country_iso3)::BIGINT AS resolved, round(count(country_iso3)::DOUBLE / count(*), 4) AS share FROM authors LEFT JOIN dimension ON raw = country_raw WHERE country_raw IS NOT NULL")
def country_coverage(spark, d):
    rows = _silver_authors(spark, d).where("country_raw IS NOT NULL")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count("country_iso3").alias("resolved"), F.round(F.count("country_iso3") / F.count(F.lit(1)), 4).alias("share"))


# --- representation -----------------------------------------------------------------------------------------------

_COUNTRIES = f"{_AUTHORS}, pc AS (SELECT DISTINCT cord_uid, country_iso3, country FROM s WHERE country IS NOT NULL), cc AS (SELECT coalesce(country_iso3, '') AS country_iso3, country, count(*)::BIGINT AS paper_count FROM pc GROUP BY 1, 2)"
_USABLE = "lower({0}) NOT IN ('', 'none', 'nan', 'null', '<na>')"
_INSTITUTIONS = f"{_AUTHORS}, pi AS (SELECT DISTINCT cord_uid, institution_norm FROM s WHERE institution_norm IS NOT NULL), ic AS (SELECT institution_norm, count(*)::BIGINT AS paper_count FROM pi WHERE length(institution_norm) >= 3 AND {_USABLE.format('institution_norm')} GROUP BY 1)"


@query(f"WITH {_COUNTRIES} SELECT * FROM cc")
def country_counts(spark, d):
    return affiliations.country_counts(paper_countries(spark, d))


@query(f"WITH {_COUNTRIES} SELECT * FROM cc ORDER BY paper_count DESC, country LIMIT 10")
def country_top(spark, d):
    return affiliations.top(country_counts(spark, d), "paper_count", "country", 10)


@query(f"WITH {_COUNTRIES} SELECT * FROM cc WHERE paper_count >= 2 ORDER BY paper_count, country_iso3, country LIMIT 10")
def country_bottom(spark, d):
    return affiliations.bottom(country_counts(spark, d), "paper_count", 10, 2)


@query(f"WITH {_INSTITUTIONS} SELECT * FROM ic")
def institution_counts(spark, d):
    return affiliations.value_counts(paper_institutions(spark, d), "institution_norm", min_length=3)


@query(f"WITH {_INSTITUTIONS} SELECT * FROM ic ORDER BY paper_count DESC, institution_norm LIMIT 20")
def institution_top(spark, d):
    return affiliations.top(institution_counts(spark, d), "paper_count", "institution_norm", 20)


@query(f"WITH {_INSTITUTIONS} SELECT * FROM ic WHERE paper_count >= 2 ORDER BY paper_count, institution_norm LIMIT 20")
def institution_bottom(spark, d):
    return affiliations.bottom(institution_counts(spark, d), "paper_count", 20, 2)


@query(f"WITH {_AUTHORS} SELECT country, count(*)::BIGINT AS author_row_count FROM s WHERE length(country) >= 2 GROUP BY country")
def author_row_counts(spark, d):
    return affiliations.value_counts(_silver_authors(spark, d), "country", "author_row_count", 2)


# --- titles and vectors -------------------------------------------------------------------------------------------

_TITLES = f"{_RICHEST}, {_NORM}, tt AS (SELECT cord_uid, unnest(regexp_extract_all(title_norm, '[a-z]{{2,}}')) AS word FROM n WHERE title IS NOT NULL AND length({_strip('title')}) >= 3), tw AS (SELECT * FROM tt WHERE word NOT IN ({_list(words.TITLE_STOPWORDS)}))"
#: A stand-in for a word-vector file: the word picks a row of embeddings by its first letters and length.
_SLOT = "(ascii(substr({0}, 1, 1)) * 7 + ascii(substr({0}, 2, 1)) * 13 + length({0}) * 3) % 450"


def _title_words(spark, d):
    return embeddings.title_words(silver.papers(_read(spark, d, "papers")))


def _model(spark, d, vocabulary: DataFrame) -> DataFrame:
    slots = vocabulary.select("word").distinct().withColumn("slot", F.expr(_SLOT.format("word").replace("% 450", "% 450L")))
    return slots.join(_read(spark, d, "embeddings").select(F.col("vec_id").alias("slot"), F.col("embedding").alias("vec")), "slot").select("word", "vec")


@query(f"WITH {_TITLES} SELECT cord_uid, word, count(*)::BIGINT AS n FROM tw GROUP BY cord_uid, word")
def title_tokens(spark, d):
    return _title_words(spark, d).groupBy("cord_uid", "word").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TITLES}, u AS (SELECT DISTINCT word, {_SLOT.format('word')} AS slot FROM tw) SELECT word, vec_id FROM u JOIN embeddings ON vec_id = slot")
def model_filter_semi(spark, d):
    """Rows of the model whose word occurs in a title, by a semi join (the whole model: all words of titles and texts)."""
    every = wordcount.word_rows(_text(spark, d), "text").select("word").unionByName(_title_words(spark, d).select("word"))
    slots = every.distinct().withColumn("slot", F.expr(_SLOT.format("word")).cast("long"))
    model = slots.join(_read(spark, d, "embeddings").select(F.col("vec_id").alias("slot"), F.col("vec_id")), "slot").select("word", "vec_id")
    return embeddings.model_of(model, _title_words(spark, d))


@query(f"""WITH {_TITLES}, j AS (SELECT cord_uid, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM tw JOIN embeddings ON vec_id = {_SLOT.format('word')}),
m AS (SELECT cord_uid, i, count(*) AS n, round(avg(x::DOUBLE), 5) AS v FROM j GROUP BY 1, 2)
SELECT cord_uid, max(n)::INTEGER AS n_words, round(sum(v * i), 2) AS weighted FROM m GROUP BY cord_uid""")
def title_mean_pool(spark, d):
    """Mean vector of each title, summed up as the sum of value times position (comparable by value)."""
    tokens = _title_words(spark, d)
    pooled = embeddings.mean_pooled(tokens, _model(spark, d, tokens), digits=5)
    weighted = F.aggregate(F.zip_with("vec", F.sequence(F.lit(1), F.size("vec")), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return pooled.select("cord_uid", "n_words", F.round(weighted, 2).alias("weighted"))


@query(f"""WITH {_TITLES}, j AS (SELECT cord_uid, count(*)::INTEGER AS n_words FROM tw JOIN embeddings ON vec_id = {_SLOT.format('word')} GROUP BY cord_uid)
SELECT cord_uid, n.title, c.title_dup_count = 1 AS is_title_unique, n_words FROM j LEFT JOIN n USING (cord_uid) LEFT JOIN c USING (title_norm)""")
def title_embeddings(spark, d):
    tidy = written(silver.papers(_read(spark, d, "papers")), "papers")
    tokens = embeddings.title_words(tidy)
    return embeddings.with_flags(embeddings.mean_pooled(tokens, _model(spark, d, tokens)), tidy).select("cord_uid", "title", "is_title_unique", "n_words")


@query(f"""WITH {_TITLES}, m AS (SELECT cord_uid, word, {_SLOT.format('word')} % 2 = 0 AS known FROM tw), w AS (SELECT word, count(*) AS n, bool_or(known) AS known FROM m GROUP BY word)
SELECT *, round(titles_embedded / titles, 4) AS title_coverage, round(tokens_matched / tokens, 4) AS token_coverage, round(model_words / vocabulary, 4) AS vocabulary_coverage FROM
(SELECT count(*)::BIGINT AS titles FROM n WHERE title IS NOT NULL AND length({_strip('title')}) >= 3), (SELECT count(DISTINCT cord_uid)::BIGINT AS titles_embedded FROM m WHERE known),
(SELECT sum(n)::BIGINT AS tokens, (sum(n) FILTER (known))::BIGINT AS tokens_matched, count(*)::BIGINT AS vocabulary, (count(*) FILTER (known))::BIGINT AS model_words FROM w)""")
def title_coverage(spark, d):
    """Shares of titles, tokens and vocabulary that a model with every second word knows."""
    tidy = silver.papers(_read(spark, d, "papers"))
    tokens = embeddings.title_words(tidy)
    half = tokens.select("word").distinct().where(F.expr(_SLOT.format("word")) % 2 == 0)
    return embeddings.coverage(tidy, tokens, half)


@query("WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) SELECT label, (pos - 1)::INTEGER AS pos, count(*)::BIGINT AS n, round(avg(x::DOUBLE), 5) AS mean FROM e GROUP BY label, pos")
def mean_pool_label(spark, d):
    rows = _read(spark, d, "embeddings").select("label", F.col("embedding").alias("vec"))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    means = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>"))).alias("m"))
    return means.select("label", "n", F.posexplode(vector_to_array("m")).alias("pos", "mean")).select("label", "pos", "n", F.round("mean", 5).alias("mean"))


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query, e.vec_id AS other, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM q, embeddings e WHERE q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, other) AS rank FROM s) SELECT query, other, round(c, 6) AS cosine, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def cosine_topk(spark, d):
    base = _read(spark, d, "embeddings")
    return embeddings.cosine_top_k(base.where("vec_id % 20 = 0"), base, "vec_id", "embedding", 10).select("query", "other", F.round("cosine", 6).alias("cosine"), "rank")


@query("SELECT a.vec_id AS one, b.vec_id AS two, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_next(spark, d):
    """Cosine of each vector with the next one: the column expression."""
    e = _read(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("one"), F.col("embedding").alias("u")), e.select((F.col("vec_id") - 1).alias("one"), F.col("vec_id").alias("two"), F.col("embedding").alias("v"))
    return a.join(b, "one").select("one", "two", F.round(embeddings.cosine(F.col("u"), F.col("v")), 6).alias("cosine"))


@query("SELECT vec_id::VARCHAR AS word, len(embedding)::INTEGER AS dims, round(embedding[1]::DOUBLE, 4) AS first FROM embeddings")
def vector_file(spark, d):
    """The vectors as a text file 'word f1 f2 ...' with a header line, read back."""
    rows = _read(spark, d, "embeddings").select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value"))
    path = scratch(spark, "vec")
    spark.createDataFrame([("500 64",)], "value string").unionByName(rows).write.text(path)
    return readers.read_vectors(spark, path).select("word", F.size("vec").alias("dims"), F.round(F.col("vec")[0].cast("double"), 4).alias("first"))


# --- profiling ----------------------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(({c} IS NULL)::INT) * 100, 2) AS null_pct FROM papers" for c in ["cord_uid", *_COLUMNS]))
def null_profile(spark, d):
    return profile.null_shares(_read(spark, d, "papers"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c})::BIGINT AS non_null, count(DISTINCT {c})::BIGINT AS distinct_values, (count({c}) - count(DISTINCT {c}))::BIGINT AS duplicates FROM papers" for c in ("cord_uid", "sha", "pmcid")))
def key_integrity(spark, d):
    return profile.key_integrity(_read(spark, d, "papers"), ["cord_uid", "sha", "pmcid"])


@query("""SELECT count(*) FILTER (pdf_json_files IS NOT NULL AND pmc_json_files IS NULL)::BIGINT AS only_pdf, count(*) FILTER (pdf_json_files IS NULL AND pmc_json_files IS NOT NULL)::BIGINT AS only_pmc,
count(*) FILTER (pdf_json_files IS NOT NULL AND pmc_json_files IS NOT NULL)::BIGINT AS both, count(*) FILTER (pdf_json_files IS NULL AND pmc_json_files IS NULL)::BIGINT AS neither, count(*) FILTER (pdf_json_files LIKE '%;%')::BIGINT AS several_pdf FROM papers""")
def coverage_flags(spark, d):
    return profile.full_text_coverage(_read(spark, d, "papers"))


_YEARS = "y AS (SELECT try_cast(substr(publish_time, 1, 4) AS SMALLINT) AS year FROM papers), h AS (SELECT year, count(*)::BIGINT AS count FROM y WHERE year BETWEEN 1950 AND 2021 GROUP BY year)"


@query(f"WITH {_YEARS} SELECT * FROM h")
def year_histogram(spark, d):
    return profile.year_histogram(_read(spark, d, "papers"))


@query(f"WITH {_YEARS} SELECT year, count AS n FROM h ORDER BY count DESC, year LIMIT 1")
def peak_year(spark, d):
    return profile.peak_year(_read(spark, d, "papers"))


@query("SELECT source_x, count(*)::BIGINT AS count FROM papers WHERE source_x IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def value_counts_source(spark, d):
    return profile.value_counts(_read(spark, d, "papers"), "source_x", 8)


@query("SELECT license, count(*)::BIGINT AS count FROM papers WHERE license IS NOT NULL GROUP BY 1")
def value_counts_license(spark, d):
    return profile.value_counts(_read(spark, d, "papers"), "license")


@query("SELECT DISTINCT journal FROM papers WHERE journal IS NOT NULL")
def distinct_values(spark, d):
    return _read(spark, d, "papers").dropna(subset=["journal"]).select("journal").distinct()


@query(f"""SELECT coalesce({_TIDY}, '') AS source, count(*)::BIGINT AS n, count(*) FILTER (section IS NULL)::BIGINT AS no_section, count(*) FILTER (parsed_at IS NULL)::BIGINT AS no_time, count(*) FILTER (length(text) > 500)::BIGINT AS long_text FROM paragraphs GROUP BY 1""")
def source_profile(spark, d):
    rows = _read(spark, d, "paragraphs").withColumn("source", F.coalesce(silver.tidy_source(F.col("source")), F.lit("")))
    return profile.source_profile(rows, "source", {"no_section": "section IS NULL", "no_time": "parsed_at IS NULL", "long_text": "length(text) > 500"})


@query("SELECT event_type, user_id % 4 AS bucket, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most, count(value)::BIGINT AS n FROM events GROUP BY 1, 2")
def group_stats(spark, d):
    return profile.group_stats(_read(spark, d, "events").withColumn("bucket", F.col("user_id") % 4), ["event_type", "bucket"], "value")


@query("SELECT user_id % 8 AS bucket, " + ", ".join(f"count(*) FILTER (event_type = '{t}')::BIGINT AS {t}" for t in ("click", "purchase")) + ", count(*)::BIGINT AS total FROM events GROUP BY 1")
def pivot_stage(spark, d):
    rows = _read(spark, d, "events").withColumn("bucket", F.col("user_id") % 8)
    kinds = ("click", "purchase")
    return rows.groupBy("bucket").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("total"))


@query("SELECT user_id % 8 AS bucket, " + ", ".join(f"round(avg(value) FILTER (event_type = '{t}'), 4) AS {t}" for t in ("click", "purchase")) + ", round(" + " + ".join(f"coalesce(avg(value) FILTER (event_type = '{t}'), 0)" for t in ("click", "purchase")) + ", 4) AS total FROM events GROUP BY 1")
def pivot_means(spark, d):
    """Mean seconds by workers and stage, with the row's sum."""
    wide = profile.pivot_means(_read(spark, d, "events").withColumn("bucket", F.col("user_id") % 8), "bucket", "event_type", "value", ["click", "purchase"])
    return wide.select("bucket", *[F.round(c, 4).alias(c) for c in ("click", "purchase", "total")])


@query("""WITH m AS (SELECT user_id % 4 + 1 AS size, avg(value) AS seconds FROM events GROUP BY 1), b AS (SELECT seconds AS t1 FROM m WHERE size = 1)
SELECT size, round(seconds, 4) AS seconds, round(t1 / seconds, 4) AS speedup, round(t1 / seconds / size, 4) AS efficiency, round(CASE WHEN size > 1 THEN (size / (t1 / seconds) - 1) / (size - 1) END, 4) AS serial_share FROM m, b""")
def speedup_table(spark, d):
    return profile.speedup(_read(spark, d, "events").withColumn("size", F.col("user_id") % 4 + 1), "size", "value")


@query("WITH r AS (SELECT user_id % 5 AS x, CASE WHEN value < 5 THEN NULL ELSE value END AS s FROM events) SELECT x, round(avg(s), 4) AS mean, round(min(s), 4) AS least, round(max(s), 4) AS most, count(*) FILTER (s IS NULL)::BIGINT AS failed FROM r GROUP BY x")
def curve_stats(spark, d):
    return profile.curve(_runs(spark, d), "x", "s")


def _runs(spark, d):
    return _read(spark, d, "events").select((F.col("user_id") % 5).alias("x"), F.when(F.col("value") >= 5, F.col("value")).alias("s"))


@query("SELECT DISTINCT user_id % 5 AS x FROM events WHERE value < 5")
def curve_failures(spark, d):
    return profile.failed_points(_runs(spark, d), "x", "s")


_JSON = "v AS (SELECT rec_id, body::JSON AS j FROM raw_json WHERE json_valid(body))"


@query(f"""WITH {_JSON}, k AS (SELECT 'top' AS level, unnest(json_keys(j)) AS key FROM v WHERE json_type(j) = 'OBJECT'
UNION ALL SELECT 'metadata', unnest(json_keys(json_extract(j, '$.metadata'))) FROM v WHERE json_type(json_extract(j, '$.metadata')) = 'OBJECT'
UNION ALL SELECT 'paragraph', unnest(json_keys(x)) FROM (SELECT unnest(json_extract(j, '$.body_text')::JSON[]) AS x FROM v WHERE json_type(json_extract(j, '$.body_text')) = 'ARRAY') WHERE json_type(x) = 'OBJECT')
SELECT level, key, count(*)::BIGINT AS n FROM k GROUP BY level, key""")
def json_level_keys(spark, d):
    """How often each key occurs at the top, in the metadata and in the paragraphs of JSON papers."""
    good = readers.parsed_bodies(_read(spark, d, "raw_json"), "body").where("ok")
    return profile.json_level_keys(good, "body", {"top": "$", "metadata": "$.metadata"}, {"paragraph": "$.body_text"})


@query(f"""WITH {_JSON}, p AS (SELECT (rec_id % 2)::VARCHAR AS source, json_keys(j) AS keys, CASE json_type(json_extract(j, '$.body_text')) WHEN 'ARRAY' THEN json_array_length(j, '$.body_text') ELSE 0 END AS body,
CASE json_type(json_extract(j, '$.metadata.authors')) WHEN 'ARRAY' THEN json_extract(j, '$.metadata.authors')::JSON[] ELSE []::JSON[] END AS a FROM v)
SELECT source, count(*)::BIGINT AS n, count(*) FILTER (list_contains(keys, 'abstract'))::BIGINT AS with_abstract, count(*) FILTER (body = 0)::BIGINT AS empty_body, count(*) FILTER (len(a) = 0)::BIGINT AS no_authors, sum(len(a))::BIGINT AS authors,
sum(len(list_filter(a, lambda x: json_type(json_extract(x, '$.affiliation')) = 'OBJECT' AND len(json_keys(json_extract(x, '$.affiliation'))) > 0)))::BIGINT AS affiliated,
array_to_string(list_sort(list_distinct(flatten(list(keys)))), ',') AS top_keys FROM p GROUP BY source""")
def json_profile(spark, d):
    """What the JSON papers of two deliveries have (told apart by their number): abstracts, bodies, authors, affiliations, keys."""
    good = readers.parsed_bodies(_read(spark, d, "raw_json"), "body").where("ok").withColumn("source", (F.col("rec_id") % 2).cast("string"))
    return profile.paper_json_profile(good, "source", "body")


@query("WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL) SELECT key, count(*)::BIGINT AS n FROM k GROUP BY key")
def event_key_frequency(spark, d):
    return profile.json_key_frequency(_read(spark, d, "events"), "props")


# --- integrity ----------------------------------------------------------------------------------------------------


@query(f"""SELECT 'papers_unique' AS invariant, 0::BIGINT AS violations UNION ALL SELECT 'authors_in_papers', (SELECT count(DISTINCT cord_uid) FROM authors WHERE cord_uid NOT IN (SELECT cord_uid FROM papers WHERE cord_uid IS NOT NULL))::BIGINT
UNION ALL SELECT 'paragraphs_in_papers', (SELECT count(DISTINCT cord_uid) FROM paragraphs WHERE cord_uid NOT IN (SELECT cord_uid FROM papers WHERE cord_uid IS NOT NULL))::BIGINT UNION ALL SELECT 'one_source', 0 UNION ALL SELECT 'rollup_unique', 0""")
def invariants(spark, d):
    uid = lambda t: _read(spark, d, t).select("cord_uid")
    tidy = silver.prefer_source(_read(spark, d, "paragraphs").select("cord_uid", "source")).withColumn("source", silver.tidy_source(F.col("source")))
    return quality.checks(
        {
            "papers_unique": quality.duplicate_keys(silver.papers(_read(spark, d, "papers")).select("cord_uid"), "cord_uid"),
            "authors_in_papers": quality.orphans(uid("authors"), uid("papers"), "cord_uid"),
            "paragraphs_in_papers": quality.orphans(uid("paragraphs"), uid("papers"), "cord_uid"),
            "one_source": quality.overlapping(tidy, "cord_uid", "source", "pmc", "pdf"),
            "rollup_unique": quality.duplicate_keys(paper_institutions(spark, d), "cord_uid", "institution_norm"),
        }
    )


@query(f"SELECT count(*)::BIGINT AS violations FROM (SELECT cord_uid FROM paragraphs WHERE {_TIDY} = 'pmc' INTERSECT SELECT cord_uid FROM paragraphs WHERE {_TIDY} = 'pdf')")
def source_overlap(spark, d):
    rows = _read(spark, d, "paragraphs").select("cord_uid", silver.tidy_source(F.col("source")).alias("source"))
    return quality.overlapping(rows, "cord_uid", "source", "pmc", "pdf")


@query("SELECT count(*)::BIGINT AS violations FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))")
def referential_orders(spark, d):
    return quality.orphans(_read(spark, d, "orders").withColumnRenamed("o_custkey", "k"), _read(spark, d, "customer").withColumnRenamed("c_custkey", "k"), "k")


@query("SELECT count(DISTINCT cord_uid)::BIGINT AS papers, count(*)::BIGINT AS shared FROM (SELECT DISTINCT cord_uid FROM documents WHERE cord_uid IS NOT NULL INTERSECT SELECT DISTINCT cord_uid FROM paragraphs)")
def shared_papers(spark, d):
    both = _read(spark, d, "documents").where("cord_uid IS NOT NULL").select("cord_uid").intersect(_read(spark, d, "paragraphs").select("cord_uid"))
    return both.agg(F.count_distinct("cord_uid").alias("papers"), F.count(F.lit(1)).alias("shared"))


# --- scans, partitions, sinks -------------------------------------------------------------------------------------


@query("SELECT cord_uid, title FROM papers ORDER BY cord_uid, title NULLS FIRST LIMIT 200")
def head_limit(spark, d):
    return readers.first_rows(_read(spark, d, "papers").select("cord_uid", "title"), 200, "cord_uid", "title")


@query()
def seeded_sample(spark, d):
    return readers.sample(_read(spark, d, "papers").select("cord_uid", "title"), 30, 7)


@query("SELECT cord_uid, pdf_json_files, pmc_json_files FROM papers")
def column_subset(spark, d):
    return readers.read_columns(spark, f"{d}/papers.parquet", ["cord_uid", "pdf_json_files", "pmc_json_files"])


@query("SELECT cord_uid, title FROM papers WHERE title ILIKE '%cohort%' AND license IS NOT NULL AND license NOT IN ('cc0', 'unk')")
def predicates(spark, d):
    return _read(spark, d, "papers").where(F.col("title").rlike("(?i)cohort") & F.col("license").isNotNull() & ~F.col("license").isin("cc0", "unk")).select("cord_uid", "title")


@query("SELECT sum(n)::BIGINT AS n_rows FROM (SELECT count(*) AS n FROM paragraphs)")
def file_scan(spark, d):
    return files.rows_per_file(spark, f"{d}/paragraphs.parquet").agg(F.sum("n_rows").alias("n_rows"))


@query(f"WITH {_WORDS} SELECT word, count(*)::BIGINT AS count FROM k GROUP BY word")
def wc_k_partitions(spark, d):
    """The count with the input in exactly 5 partitions: no result may depend on that."""
    return wordcount.word_counts(partitioning.exactly(_read(spark, d, "paragraphs").select("text"), 5), "text")


@query("SELECT cord_uid, count(*)::BIGINT AS n FROM paragraphs GROUP BY cord_uid")
def key_partitions(spark, d):
    """Shuffled by key first; the aggregation then needs no exchange of its own."""
    return partitioning.by_key(_read(spark, d, "paragraphs").select("cord_uid"), "cord_uid").groupBy("cord_uid").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_id, cord_uid, para_idx, text FROM paragraphs")
def parquet_sink(spark, d):
    """Written as zstd Parquet with at most 20,000 rows a file and read back."""
    path = scratch(spark, "sink")
    writers.write_parquet(_read(spark, d, "paragraphs").select("row_id", "cord_uid", "para_idx", "text"), path, 20_000)
    return spark.read.parquet(path)


@query("SELECT row_id, cord_uid FROM paragraphs WHERE row_id % 2 = 0")
def numbered_files(spark, d):
    """Batches appended under stable numbers, read in numeric order, in groups and as a slice (the second half of the files)."""
    path = scratch(spark, "parts")
    rows = _read(spark, d, "paragraphs").select("row_id", "cord_uid")
    at = writers.append_batch(rows.where("row_id % 2 = 1").coalesce(3), path, 0, rows_per_group=1_000)
    end = writers.append_batch(rows.where("row_id % 2 = 0").coalesce(9), path, at, rows_per_group=1_000)
    names = files.data_files(spark, path)
    if [files.file_number(n)[0] for n in names] != list(range(end)) or files.read_in_groups(spark, names, 2).rdd.getNumPartitions() != min(2, end):
        raise AssertionError(names)
    return files.partition_slice(spark, path, at, end)


@query(f"SELECT row_id, {_strip(_collapse('text'))} AS text FROM paragraphs WHERE text IS NOT NULL")
def text_collapsed(spark, d):
    return _text(spark, d).where("text IS NOT NULL").select("row_id", strip(collapse(F.col("text"))).alias("text"))


@query(f"SELECT cord_uid, nullif({_strip('title')}, '') AS title, coalesce(try_cast(pubmed_id AS INTEGER), -1)::INTEGER AS pubmed FROM papers")
def cast_and_clean(spark, d):
    return _read(spark, d, "papers").select("cord_uid", clean_str(F.col("title")).alias("title"), F.coalesce(F.col("pubmed_id").try_cast("int"), F.lit(-1)).alias("pubmed"))


@query("SELECT cord_uid, source_x AS value FROM papers UNION ALL SELECT cord_uid, lang FROM documents")
def union_sources(spark, d):
    return _read(spark, d, "papers").select("cord_uid", F.col("source_x").alias("value")).unionByName(_read(spark, d, "documents").select("cord_uid", F.col("lang").alias("value")))


@query("WITH a AS (SELECT DISTINCT unnest(json_keys(body)) AS key FROM raw_json WHERE json_valid(body)), b AS (SELECT DISTINCT unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL) SELECT key, 'only_first' AS side FROM (SELECT key FROM a EXCEPT SELECT key FROM b) UNION ALL SELECT key, 'only_second' FROM (SELECT key FROM b EXCEPT SELECT key FROM a)")
def key_set_difference(spark, d):
    one, two = json_key_frequency(spark, d).select("key"), event_key_frequency(spark, d).select("key")
    return one.exceptAll(two).withColumn("side", F.lit("only_first")).unionByName(two.exceptAll(one).withColumn("side", F.lit("only_second")))
