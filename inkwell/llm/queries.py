"""Queries of the training-text operators and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import canonical, encodings, leaks, names, neighbours, packing, scans, survivors, term_counts
from inkwell.operators.embeddings import cosine_top_k
from inkwell.session import spread


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


SOURCES = ["pmc", "pdf"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The table's owner fixes the order of the rows, so nothing is learned here; the quality model shows in the other p1 queries."""
    rows = _read(spark, d, "paragraphs").select("row_id", "cord_uid", "para_idx", "source", "section", "text", "parsed_at")
    best = survivors.best_records(rows, ["cord_uid", "para_idx"], "row_id", "text", ["section"], "source", SOURCES, "parsed_at", with_values=False)
    return best.select("cord_uid", "para_idx", "text_row_id", "section_row_id")


def p1_best_rows(spark: SparkSession, d: str) -> DataFrame:
    """One record per paragraph by the stated order, its text and section each from the best row that has them; single rows too."""
    rows = _read(spark, d, "paragraphs").select("row_id", "cord_uid", "para_idx", "source", "section", "text", "parsed_at")
    best = survivors.best_records(rows, ["cord_uid", "para_idx"], "row_id", "text", ["section"], "source", SOURCES, "parsed_at", least_rows=1)
    return best.select("cord_uid", "para_idx", "n_rows", "text", "section")


#: Numbers of citations stand in one parse and not in the other.
CITED = r"\[\d{1,3}\]"


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One record per paragraph: its most probable text and all its sections that are judged true."""
    rows = _read(spark, d, "paragraphs").select("cord_uid", "para_idx", "source", "section", "text", "parsed_at")
    return survivors.survivors(rows, ["cord_uid", "para_idx"], ["text", "section"], "source", "parsed_at", several=("section",), ignore=CITED)


def p1_source_quality(spark: SparkSession, d: str) -> DataFrame:
    """Sensitivity and specificity of the sources by field."""
    rows = _read(spark, d, "paragraphs")
    q = survivors.fit_sources(rows, ["cord_uid", "para_idx"], ["text", "section"], "source", ignore=CITED)
    out = [(f, s, round(float(q.sensitivity[f][k]), 4), round(float(q.specificity[f][k]), 4)) for f in ("text", "section") for k, s in enumerate(q.sources)]
    return spark.createDataFrame(out, "field string, source string, sensitivity double, specificity double")


def p1_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The pattern table that the quality model is fitted on: which sources assert a value, which could have, how often."""
    return survivors.patterns(_read(spark, d, "paragraphs"), ["cord_uid", "para_idx"], ["text", "section"], "source", ignore=CITED)


def p1_judged_values(spark: SparkSession, d: str) -> DataFrame:
    """Every text and section value of every paragraph with its probability; all that are true are kept."""
    rows = _read(spark, d, "paragraphs")
    return survivors.judged_values(rows, ["cord_uid", "para_idx"], ["text", "section"], "source", ignore=CITED)


def _titled(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "title_vectors").where("is_title_unique").select("cord_uid", "vec")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(_titled(spark, d), "cord_uid", "vec", 3).where("cosine >= 0.8")
    return near.select(F.least("id", "other").alias("uid_a"), F.greatest("id", "other").alias("uid_b")).distinct()


def _exact(spark: SparkSession, d: str, every: int) -> DataFrame:
    """Brute force: of every ``every``-th vector by hash its three most similar others with a cosine of 0.8 or more."""
    base = _titled(spark, d)
    near = cosine_top_k(base.where(F.pmod(F.xxhash64("cord_uid"), F.lit(every)) == 0), base, "cord_uid", "vec", 3)
    return near.where("cosine >= 0.8").select(F.col("query").alias("id"), "other")


def p2_exact(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p2_found by brute force, all vectors against all, in blocks."""
    return _exact(spark, d, 1).select(F.least("id", "other").alias("uid_a"), F.greatest("id", "other").alias("uid_b")).distinct()


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the three most similar others of every 20th vector, with a cosine of 0.8 or more, those that the index finds, and the share."""
    found = neighbours.nearest(_titled(spark, d), "cord_uid", "vec", 3).where("cosine >= 0.8").select("id", "other")
    both = _exact(spark, d, 20).withColumn("t", F.lit(1)).join(found.withColumn("f", F.lit(1)), ["id", "other"], "left")
    return both.agg(F.count("t").alias("n_true"), F.count("f").alias("n_found"), F.round(F.count("f") / F.count("t"), 4).alias("recall"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Container and position of every piece of every document, containers of 2,048 tokens."""
    docs = _read(spark, d, "documents").select("doc_id", "text", "n_tokens")
    return packing.packed(docs, "doc_id", "text", "n_tokens", 2_048).withColumnRenamed("item", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    per = p8_packed(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.round(F.sum("n") / F.count(F.lit(1)) / 2048, 4).alias("filled"))


def p8_locality(spark: SparkSession, d: str) -> DataFrame:
    """How alike the documents of a container are, beside any two documents."""
    docs = _read(spark, d, "documents").select("doc_id", "text", "n_tokens")
    pieces = packing.packed(docs, "doc_id", "text", "n_tokens", 2_048)
    return packing.locality(pieces, docs, "doc_id", "text")


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What any right answer has: pieces and tokens placed, documents cut, containers too full, cuts of documents that fit."""
    pieces = p8_packed(spark, d)
    docs = pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("size"))
    one = docs.agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_pieces"), F.sum("size").alias("n_tokens"), F.count_if(F.expr("n > 1")).alias("n_cut"), F.count_if(F.expr("n > 1 AND size <= 2048")).alias("n_cut_wrongly"))
    held = pieces.groupBy("container").agg(F.sum("n_tokens").alias("size"), F.count_distinct("position").alias("places"), F.count(F.lit(1)).alias("n"), F.max("position").alias("last"))
    return one.join(held.agg(F.count_if(F.expr("size > 2048")).alias("n_too_full"), F.count_if(F.expr("places <> n OR last <> n - 1")).alias("n_misplaced")))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """Texts that come from scanned pages: all paragraphs but those of pmc, and the bodies of pdf_json."""
    cols = [F.lit("paragraphs").alias("tab"), F.col("row_id").alias("rec_id"), "para_idx", "text"]
    rows = _read(spark, d, "paragraphs").where(F.coalesce(survivors.tidy_source(F.col("source")), F.lit("")) != "pmc").select(*cols)
    return spread(rows).unionByName(spread(_bodies(spark, d)))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    body = _read(spark, d, "pdf_json").select("rec_id", F.posexplode("body_text").alias("para_idx", "b"))
    return body.select(F.lit("pdf_json").alias("tab"), "rec_id", "para_idx", F.col("b.text").alias("text"))


def _lexicon(spark: SparkSession, d: str) -> scans.Lexicon:
    corpus = spread(_read(spark, d, "paragraphs").select("text")).unionByName(_bodies(spark, d).select("text"))
    return scans.lexicon_of(corpus, "text", _scanned(spark, d))


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(_scanned(spark, d), "text", _lexicon(spark, d))


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of pmc, which are no scans, damaged on purpose: how many are found and wholly restored."""
    clean = _read(spark, d, "paragraphs").where(survivors.tidy_source(F.col("source")) == "pmc").select("row_id", "text")
    return scans.recall(spread(clean), "row_id", "text", _lexicon(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("tab", "rec_id", "para_idx", F.explode("kinds").alias("kind")).distinct()


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every scanned paragraph as continuous text, with the kinds of damage that were removed."""
    return _repaired(spark, d).select("tab", "rec_id", "para_idx", F.col("repaired_text").alias("text"), F.array_join("kinds", ",").alias("kinds"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(names.linked_names(_read(spark, d, "authors"), "institution_norm", "settlement"))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling of an institution with the entity it belongs to and its rows."""
    return names.linked_names(_read(spark, d, "authors"), "institution_norm", "settlement")


def p5_affiliations(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct affiliation that names a linked organisation, with its entity."""
    found = names.linked_mentions(_read(spark, d, "authors"), "affiliation", p5_entities(spark, d))
    return found.select(F.col("mention").alias("affiliation"), "entity", "name")


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """New misspellings of the organisations' names: how many are linked with the name they come from."""
    return names.recall(_read(spark, d, "authors"), "institution_norm", "settlement")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_mapped(spark, d).select("country", "iso3")


def p6_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Every typed country with its entry, score and number of rows; iso3 is NONE where there is none."""
    typed = _read(spark, d, "authors").select("country")
    return canonical.canonical(typed, "country", _read(spark, d, "countries"), "iso3", "name", "alt_names").select(F.col("value").alias("country"), "iso3", F.round("score", 4).alias("score"), "n_rows")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_term_counts(spark, d).where("mark IS NOT NULL").select("term", "mark")


def p7_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_frequencies(_read(spark, d, "paragraphs"), "text", "cord_uid", "row_id")


def p7_spilled(spark: SparkSession, d: str) -> DataFrame:
    """The same counts with room for 4,000 rows a part, so that every partition is split by hash bits on the shared folder."""
    return term_counts.term_frequencies(_read(spark, d, "paragraphs"), "text", "cord_uid", "row_id", spill_rows=4_000)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items they give away and the share of the item's words in them."""
    docs = spread(_read(spark, d, "documents").select("doc_id", "text"))
    found = leaks.leaked_items(docs, "doc_id", "text", _read(spark, d, "eval_items"), "item_id", "passage")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.round("share", 4).alias("share"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select(F.col("doc").alias("doc_id")).distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with the chains undone and the restored text."""
    return _garbled(spark, d).select(F.col("doc").alias("doc_id"), F.array_join("chains", ", ").alias("chains"), "lost", "restored")


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", "text")
    return encodings.garbled_texts(spread(docs), "doc_id", "text", encodings.fit(docs, "doc_id", "text"))


def p10_recall(spark: SparkSession, d: str) -> DataFrame:
    """Clean documents garbled on purpose, by chain: how many are found and wholly restored."""
    docs = _read(spark, d, "documents").select("doc_id", "text")
    return encodings.recall(spread(docs), "doc_id", "text", encodings.fit(docs, "doc_id", "text"))


QUERIES = {
    "p1_found": p1_found,
    "p1_best_rows": p1_best_rows,
    "p1_survivors": p1_survivors,
    "p1_source_quality": p1_source_quality,
    "p1_patterns": p1_patterns,
    "p1_judged_values": p1_judged_values,
    "p2_found": p2_found,
    "p2_exact": p2_exact,
    "p2_recall": p2_recall,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p8_locality": p8_locality,
    "p8_invariants": p8_invariants,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p3_recall": p3_recall,
    "p5_found": p5_found,
    "p5_entities": p5_entities,
    "p5_affiliations": p5_affiliations,
    "p5_recall": p5_recall,
    "p6_found": p6_found,
    "p6_mapped": p6_mapped,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
    "p10_recall": p10_recall,
    "p7_found": p7_found,
    "p7_term_counts": p7_term_counts,
    "p7_spilled": p7_spilled,
}

_P7 = """
WITH w AS (SELECT cord_uid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM paragraphs),
t AS (SELECT * FROM w WHERE length(term) >= 2 AND regexp_matches(term, '[a-z]')),
c AS (SELECT term, count(*)::BIGINT AS n_occurrences, count(DISTINCT cord_uid)::BIGINT AS n_records FROM t GROUP BY term),
m AS (SELECT *, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records > 0.5 * (SELECT count(DISTINCT cord_uid) FROM t) THEN 'common' END AS mark FROM c)
"""

_P1 = """
WITH o AS (SELECT *, regexp_replace(coalesce(text, ''), '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]', '', 'g') = '' AS tb,
    regexp_replace(coalesce(section, ''), '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]', '', 'g') = '' AS sb,
    CASE regexp_replace(lower(coalesce(source, '')), '^\\s+|\\s+$', '', 'g') WHEN 'pmc' THEN 0 WHEN 'pdf' THEN 1 ELSE 2 END AS sr FROM paragraphs),
r AS (SELECT *, row_number() OVER (PARTITION BY cord_uid, para_idx ORDER BY tb, sr, parsed_at DESC NULLS LAST, row_id) AS rn,
    row_number() OVER (PARTITION BY cord_uid, para_idx ORDER BY sb, tb, sr, parsed_at DESC NULLS LAST, row_id) AS rs FROM o)
"""

#: An independent rule: parts equal to a name, or one typing error away from names of one entry only.
_P6 = """
WITH v AS (SELECT DISTINCT country FROM authors WHERE country IS NOT NULL),
s AS (SELECT country, regexp_split_to_array(country, '[,;/|()&]|\\s[-–—]\\s') AS l FROM v),
p AS (SELECT country, unnest(l) AS part, generate_subscripts(l, 1) AS pos FROM s),
q AS (SELECT country, pos, trim(regexp_replace(regexp_replace(lower(strip_accents(part)), '[^a-z ]', '', 'g'), ' +', ' ', 'g')) AS f FROM p),
n AS (SELECT iso3, trim(regexp_replace(regexp_replace(lower(strip_accents(x)), '[^a-z ]', '', 'g'), ' +', ' ', 'g')) AS n FROM (SELECT iso3, name AS x FROM countries UNION ALL SELECT iso3, unnest(alt_names) FROM countries)),
e AS (SELECT country, pos, min(iso3) AS iso3 FROM q JOIN n ON n = f OR (length(replace(f, ' ', '')) <= 3 AND n = replace(f, ' ', '')) WHERE f <> '' GROUP BY 1, 2),
d AS (SELECT country, pos, min(iso3) AS iso3 FROM q JOIN n ON length(f) >= 4 AND length(n) >= 4 AND damerau_levenshtein(f, n) <= 1 GROUP BY 1, 2 HAVING count(DISTINCT iso3) = 1),
b AS (SELECT country, pos, coalesce(e.iso3, d.iso3) AS iso3 FROM q LEFT JOIN e USING (country, pos) LEFT JOIN d USING (country, pos)),
r AS (SELECT country, min(pos) AS pos FROM b WHERE iso3 IS NOT NULL GROUP BY country)
SELECT v.country, coalesce(b.iso3, 'NONE') AS iso3 FROM v LEFT JOIN r USING (country) LEFT JOIN b ON b.country = v.country AND b.pos = r.pos
"""

SQL = {
    "p6_found": _P6,
    "p1_found": _P1 + """
SELECT cord_uid, para_idx, max(CASE WHEN rn = 1 THEN row_id END)::BIGINT AS text_row_id,
    max(CASE WHEN rs = 1 AND NOT sb THEN row_id ELSE -1 END)::BIGINT AS section_row_id
FROM r GROUP BY cord_uid, para_idx HAVING count(*) >= 2
""",
    "p1_patterns": """
WITH c AS (SELECT cord_uid, para_idx, coalesce(nullif(trim(lower(source), ' ' || chr(9) || chr(10) || chr(13) || chr(160)), ''), 'other') AS src, unnest([{'f': 'text', 'v': text}, {'f': 'section', 'v': section}]) AS x FROM paragraphs),
v AS (SELECT cord_uid, para_idx, src, x.f AS field, lower(x.v) AS l, regexp_replace(regexp_replace(lower(x.v), '\\[\\d{1,3}\\]', '', 'g'), '[^\\p{L}\\p{N}]+', '', 'g') AS bare FROM c WHERE regexp_replace(x.v, '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]', '', 'g') <> ''),
k AS (SELECT *, CASE WHEN bare <> '' THEN 'b' || bare ELSE 'r' || regexp_replace(l, '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+', '', 'g') END AS fact FROM v),
g AS (SELECT cord_uid, para_idx, field, fact, array_to_string(list_sort(list(DISTINCT src)), ',') AS asserted FROM k GROUP BY ALL),
a AS (SELECT cord_uid, para_idx, field, array_to_string(list_sort(list(DISTINCT src)), ',') AS able FROM k GROUP BY ALL)
SELECT g.field, asserted, able, count(*)::BIGINT AS n FROM g JOIN a ON g.cord_uid IS NOT DISTINCT FROM a.cord_uid AND g.para_idx IS NOT DISTINCT FROM a.para_idx AND g.field = a.field GROUP BY ALL
""",
    "p1_best_rows": _P1 + """
SELECT cord_uid, para_idx, count(*)::BIGINT AS n_rows, max(CASE WHEN rn = 1 THEN text END) AS text, max(CASE WHEN rs = 1 AND NOT sb THEN section END) AS section
FROM r GROUP BY cord_uid, para_idx
""",
    "p7_found": _P7 + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p7_term_counts": _P7 + "SELECT term, n_occurrences, n_records, mark FROM m",
    "p7_spilled": _P7 + "SELECT term, n_occurrences, n_records, mark FROM m",
    "p2_exact": """
WITH v AS (SELECT cord_uid, vec FROM title_vectors WHERE is_title_unique AND vec IS NOT NULL AND list_inner_product(vec, vec) > 0),
c AS (SELECT a.cord_uid AS id, b.cord_uid AS other, list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) AS c FROM v a JOIN v b ON a.cord_uid <> b.cord_uid),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS n FROM c)
SELECT DISTINCT least(id, other) AS uid_a, greatest(id, other) AS uid_b FROM r WHERE n <= 3 AND c >= 0.8
""",
    "p8_invariants": """
SELECT count(*)::BIGINT AS n_documents, sum(CASE WHEN n_tokens > 2048 THEN (n_tokens + 2047) // 2048 ELSE 1 END)::BIGINT AS n_pieces, sum(n_tokens)::BIGINT AS n_tokens,
    count(*) FILTER (n_tokens > 2048)::BIGINT AS n_cut, 0::BIGINT AS n_cut_wrongly, 0::BIGINT AS n_too_full, 0::BIGINT AS n_misplaced FROM documents
""",
}
