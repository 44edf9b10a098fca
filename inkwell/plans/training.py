"""Queries of the general training-data operators (nested records)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.nested import paper_links, paper_nodes, paper_tables


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return paper_links(paper_nodes(_read(spark, d, "pdf_json"), _read(spark, d, "raw_json")))


def p4_table_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and records of each flat table of pdf_json and raw_json, all tables made in one labelled pass."""
    out = None
    for name, t in paper_tables(_read(spark, d, "pdf_json"), _read(spark, d, "raw_json"), one_pass=True).items():
        part = t.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("rec_id").alias("n_records"))
        out = part if out is None else out.unionByName(part)
    return out


def _table(path: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return paper_tables(_read(spark, d, "pdf_json"), _read(spark, d, "raw_json"))[path]

    return query


#: The flat tables of pdf_json and raw_json.
TABLES = {
    "p4_records": "records", "p4_authors": "metadata.authors", "p4_affiliations": "metadata.authors.affiliation", "p4_paragraphs": "body_text",
    "p4_citations": "body_text.cite_spans", "p4_references": "bib_entries", "p4_reference_authors": "bib_entries.authors", "p4_abstracts": "abstract",
}
QUERIES = {"p4_found": p4_found, "p4_table_sizes": p4_table_sizes, **{name: _table(path) for name, path in TABLES.items()}}

WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SAID = "(regexp_replace(coalesce({0}, ''), '" + WS.replace("{", "{{").replace("}", "}}") + "', '', 'g') <> '')"
_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN ({0})::JSON[] WHEN 'OBJECT' THEN [{0}] ELSE []::JSON[] END"


def _any(*columns: str) -> str:
    return "(" + " OR ".join(_SAID.format(c) for c in columns) + ")"


_FOUND = f"""
WITH a AS (SELECT rec_id, unnest(metadata.authors) AS x, generate_subscripts(metadata.authors, 1) - 1 AS i FROM pdf_json),
b AS (SELECT rec_id, unnest(body_text) AS x, generate_subscripts(body_text, 1) - 1 AS i FROM pdf_json),
c AS (SELECT rec_id, i, unnest(x.cite_spans) AS y, generate_subscripts(x.cite_spans, 1) - 1 AS k FROM b WHERE {_SAID.format('x.text')}),
e AS (SELECT rec_id, unnest(map_entries(bib_entries)) AS m FROM pdf_json),
f AS (SELECT rec_id, m.key AS key, unnest(m.value.authors) AS y, generate_subscripts(m.value.authors, 1) - 1 AS k FROM e WHERE m.value IS NOT NULL),
v AS (SELECT rec_id, body::JSON AS j FROM raw_json WHERE json_valid(body)),
ra AS (SELECT rec_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM (SELECT rec_id, {_LIST.format("json_extract(j, '$.metadata.authors')")} AS l FROM v)),
rb AS (SELECT rec_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM (SELECT rec_id, {_LIST.format("json_extract(j, '$.body_text')")} AS l FROM v)),
rc AS (SELECT rec_id, i, unnest(l) AS y, generate_subscripts(l, 1) - 1 AS k FROM (SELECT rec_id, i, {_LIST.format("json_extract(x, '$.cite_spans')")} AS l FROM rb WHERE json_type(x) = 'OBJECT' AND {_SAID.format("json_extract_string(x, '$.text')")})),
rk AS (SELECT rec_id, j, unnest(json_keys(json_extract(j, '$.bib_entries'))) AS key FROM v WHERE json_type(json_extract(j, '$.bib_entries')) = 'OBJECT'),
re AS (SELECT rec_id, key, json_extract(j, '$.bib_entries.' || '"' || key || '"') AS x FROM rk),
rf AS (SELECT rec_id, key, unnest(l) AS y, generate_subscripts(l, 1) - 1 AS k FROM (SELECT rec_id, key, {_LIST.format("json_extract(x, '$.authors')")} AS l FROM re WHERE json_type(x) = 'OBJECT'))
SELECT rec_id, 'author' AS child, '' AS parent_key, i::VARCHAR AS child_key FROM a WHERE x IS NOT NULL
UNION ALL SELECT rec_id, 'affiliation', i::VARCHAR, '0' FROM a WHERE {_any(*(f'x.affiliation.{n}' for n in ('laboratory', 'institution', 'location.settlement', 'location.region', 'location.country', 'location.post_code')))}
UNION ALL SELECT rec_id, 'paragraph', '', i::VARCHAR FROM b WHERE {_SAID.format('x.text')}
UNION ALL SELECT rec_id, 'cite_span', i::VARCHAR, k::VARCHAR FROM c WHERE y IS NOT NULL
UNION ALL SELECT rec_id, 'bib_entry', '', m.key FROM e WHERE m.value IS NOT NULL
UNION ALL SELECT rec_id, 'bib_author', key, k::VARCHAR FROM f WHERE y IS NOT NULL
UNION ALL SELECT rec_id, 'author', '', i::VARCHAR FROM ra WHERE json_type(x) <> 'NULL'
UNION ALL SELECT rec_id, 'affiliation', i::VARCHAR, '0' FROM ra WHERE json_type(json_extract(x, '$.affiliation')) = 'OBJECT' AND {_any(*(f"json_extract_string(x, '$.affiliation.{n}')" for n in ('laboratory', 'institution', 'location.settlement', 'location.region', 'location.country', 'location.post_code')))}
UNION ALL SELECT rec_id, 'paragraph', '', i::VARCHAR FROM rb WHERE json_type(x) = 'OBJECT' AND {_SAID.format("json_extract_string(x, '$.text')")}
UNION ALL SELECT rec_id, 'cite_span', i::VARCHAR, k::VARCHAR FROM rc WHERE json_type(y) <> 'NULL'
UNION ALL SELECT rec_id, 'bib_entry', '', key FROM re WHERE json_type(x) <> 'NULL'
UNION ALL SELECT rec_id, 'bib_author', key, k::VARCHAR FROM rf WHERE json_type(y) <> 'NULL'
"""

SQL = {
    "p4_found": _FOUND,
    "p4_table_sizes": f"""
WITH a AS (SELECT rec_id, unnest(metadata.authors) AS x FROM pdf_json WHERE metadata IS NOT NULL),
b AS (SELECT rec_id, unnest(body_text) AS x FROM pdf_json),
s AS (SELECT rec_id, unnest(abstract) AS x FROM pdf_json),
c AS (SELECT rec_id, unnest(x.cite_spans) AS x FROM b WHERE x IS NOT NULL),
e AS (SELECT rec_id, unnest(map_values(bib_entries)) AS x FROM pdf_json),
f AS (SELECT rec_id, unnest(x.authors) AS x FROM e WHERE x IS NOT NULL),
v AS (SELECT rec_id, body::JSON AS j FROM raw_json WHERE json_valid(body)),
o AS (SELECT * FROM v WHERE json_type(j) = 'OBJECT'),
ra AS (SELECT rec_id, unnest({_LIST.format("json_extract(j, '$.metadata.authors')")}) AS x FROM o),
rb AS (SELECT rec_id, unnest({_LIST.format("json_extract(j, '$.body_text')")}) AS x FROM o),
rs AS (SELECT rec_id, unnest({_LIST.format("json_extract(j, '$.abstract')")}) AS x FROM o),
rc AS (SELECT rec_id, unnest({_LIST.format("json_extract(x, '$.cite_spans')")}) AS x FROM rb WHERE json_type(x) = 'OBJECT'),
rk AS (SELECT rec_id, j, unnest(json_keys(json_extract(j, '$.bib_entries'))) AS key FROM o WHERE json_type(json_extract(j, '$.bib_entries')) = 'OBJECT'),
re AS (SELECT rec_id, json_extract(j, '$.bib_entries.' || '"' || key || '"') AS x FROM rk),
rf AS (SELECT rec_id, unnest({_LIST.format("json_extract(x, '$.authors')")}) AS x FROM re WHERE json_type(x) = 'OBJECT'),
l AS (SELECT 'records' AS t, rec_id FROM pdf_json UNION ALL SELECT 'records', rec_id FROM o
UNION ALL SELECT 'metadata.authors', rec_id FROM a WHERE x IS NOT NULL UNION ALL SELECT 'metadata.authors', rec_id FROM ra WHERE json_type(x) <> 'NULL'
UNION ALL SELECT 'metadata.authors.affiliation', rec_id FROM a WHERE x.affiliation IS NOT NULL
UNION ALL SELECT 'metadata.authors.affiliation', rec_id FROM ra WHERE json_type(json_extract(x, '$.affiliation')) = 'OBJECT'
UNION ALL SELECT 'abstract', rec_id FROM s WHERE x IS NOT NULL UNION ALL SELECT 'abstract', rec_id FROM rs WHERE json_type(x) <> 'NULL'
UNION ALL SELECT 'body_text', rec_id FROM b WHERE x IS NOT NULL UNION ALL SELECT 'body_text', rec_id FROM rb WHERE json_type(x) <> 'NULL'
UNION ALL SELECT 'body_text.cite_spans', rec_id FROM c WHERE x IS NOT NULL UNION ALL SELECT 'body_text.cite_spans', rec_id FROM rc WHERE json_type(x) <> 'NULL'
UNION ALL SELECT 'bib_entries', rec_id FROM e WHERE x IS NOT NULL UNION ALL SELECT 'bib_entries', rec_id FROM re WHERE json_type(x) <> 'NULL'
UNION ALL SELECT 'bib_entries.authors', rec_id FROM f WHERE x IS NOT NULL UNION ALL SELECT 'bib_entries.authors', rec_id FROM rf WHERE json_type(x) <> 'NULL')
SELECT t AS table_name, count(*)::BIGINT AS n_rows, count(DISTINCT rec_id)::BIGINT AS n_records FROM l GROUP BY t
""",
}
