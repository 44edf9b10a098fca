import json

from inkwell.operators.nested import Wanted, dewey_nodes, paper_links, paper_nodes, paper_tables, parent_label, record_tables

SCHEMA = """rec_id long, paper_id string, clash string, metadata struct<title: string, authors: array<struct<first: string, middle: array<string>, affiliation: struct<institution: string, location: struct<country: string>>>>>,
body_text array<struct<text: string, section: string, cite_spans: array<struct<start_pos: int, text: string>>>>, bib_entries map<string, struct<title: string, authors: array<struct<last: string>>>>"""
FULL = {
    "rec_id": 1, "paper_id": "p", "clash": "x",
    "metadata": {"title": "t", "authors": [None, {"first": "A", "middle": [], "affiliation": {"institution": " ", "location": {"country": "X"}}}, {"first": None, "middle": None, "affiliation": {"institution": "", "location": None}}]},
    "body_text": [{"text": "  ", "section": "s", "cite_spans": [{"start_pos": 1, "text": "z"}]}, {"text": "w", "section": None, "cite_spans": [None, {"start_pos": 2, "text": None}]}, None],
    "bib_entries": {"b0": {"title": "q", "authors": [{"last": "L"}, None]}, "b1": None},
}
LINKS = {("author", "", "1"), ("author", "", "2"), ("affiliation", "1", "0"), ("paragraph", "", "1"), ("cite_span", "1", "1"), ("bib_entry", "", "b0"), ("bib_author", "b0", "0")}


def raw(spark, *bodies):
    return spark.createDataFrame([(100 + k, b) for k, b in enumerate(bodies)], "rec_id long, body string")


def test_links_of_a_record_with_gaps(spark):
    typed = spark.createDataFrame([FULL, {"rec_id": 2}, {"rec_id": 3, "metadata": {"title": None, "authors": []}, "body_text": [], "bib_entries": {}}], SCHEMA)
    got = paper_links(paper_nodes(typed, raw(spark))).collect()
    assert len(got) == len(LINKS) and {(r.child, r.parent_key, r.child_key) for r in got} == LINKS and {r.rec_id for r in got} == {1}


def test_json_gives_the_same_links(spark):
    body = {k: v for k, v in FULL.items() if k != "rec_id"}
    one = {"metadata": {"authors": {"first": "A"}}, "body_text": {"text": "x", "cite_spans": {"text": "c"}}, "bib_entries": [1]}
    typed = spark.createDataFrame([], SCHEMA)
    got = paper_links(paper_nodes(typed, raw(spark, json.dumps(body), json.dumps(one), None, "", "{", "[1]", "null", '{"metadata": "x", "body_text": 3}'))).collect()
    assert {(r.child, r.parent_key, r.child_key) for r in got if r.rec_id == 100} == LINKS
    assert {(r.child, r.parent_key, r.child_key) for r in got if r.rec_id == 101} == {("author", "", "0"), ("paragraph", "", "0"), ("cite_span", "0", "0")}
    assert {r.rec_id for r in got} == {100, 101}


def test_tables_join_on_labels(spark):
    typed = spark.createDataFrame([FULL], SCHEMA)
    t = record_tables(typed, "rec_id", ["metadata.authors", "metadata.authors.affiliation", "body_text", "body_text.cite_spans", "bib_entries.authors"])
    assert [(r.label, r.parent_label, r.institution, r.location_country) for r in t["metadata.authors.affiliation"].orderBy("label").collect()] == [("1.0", "1", " ", "X"), ("2.0", "2", "", None)]
    joined = t["body_text.cite_spans"].alias("c").join(t["body_text"].alias("p"), (t["body_text.cite_spans"].parent_label == t["body_text"].label))
    assert joined.count() == 2
    assert t["records"].columns == ["rec_id", "paper_id", "clash", "metadata_title"] and [r.last for r in t["bib_entries.authors"].collect()] == ["L"]


def test_generic_paths_and_labels(spark):
    df = spark.createDataFrame([(1, [{"b": [{"c": "x"}]}])], "id long, a array<struct<b: array<struct<c: string>>>>")
    rows = dewey_nodes(df, "id", [Wanted("a"), Wanted("a.b")])
    assert sorted((r.path, tuple(r.label), r.filled) for r in rows.collect()) == [("a", ("0",), False), ("a.b", ("0", "0"), True)]
    assert rows.select(parent_label(rows.label).alias("p")).where("size(p) = 0").count() == 1


def test_tables_of_both_inputs(spark):
    typed = spark.createDataFrame([FULL], SCHEMA)
    body = {k: v for k, v in FULL.items() if k != "rec_id"}
    odd = {"paper_id": 7, "metadata": {"title": ["t"], "authors": {"first": "A\ud800", "middle": "M", "affiliation": "x"}}, "body_text": [{"text": "x", "cite_spans": {"start_pos": "3"}}, "y", None], "bib_entries": {"b": 1, "c": {"title": None}, "d": None}}
    t = paper_tables(typed, raw(spark, json.dumps(body), json.dumps(odd), None, "", "{", "[1]", "null", '{"metadata": "x", "body_text": 3}'))
    for name, table in t.items():
        rows = {k: [tuple(r)[1:] for r in table.where(f"rec_id = {k}").sort(*table.columns[1:2]).collect()] for k in (1, 100)}
        assert rows[1] and rows[1] == rows[100], name
    assert [r.rec_id for r in t["records"].sort("rec_id").collect()] == [1, 100, 101, 107]
    only = {n: [tuple(r)[1:] for r in x.where("rec_id = 101").sort("label").collect()] for n, x in t.items() if n != "records"}
    assert only["metadata.authors"] == [("0", "", "0", "A\ufffd", ["M"], None, None)] and only["metadata.authors.affiliation"] == []
    assert only["body_text"] == [("0", "", "0", "x", None), ("1", "", "1", None, None)] and only["body_text.cite_spans"] == [("0.0", "0", "0", 3, None)]
    assert only["bib_entries"] == [("b", "", "b", None), ("c", "", "c", None)]


def test_tables_have_the_labels_of_the_nodes(spark, data):
    typed, bodies = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("pdf_json", "raw_json"))
    nodes = {(r.rec_id, r.path, ".".join(r.label)) for r in paper_nodes(typed, bodies).collect()}
    tables = paper_tables(typed, bodies)
    assert nodes == {(r.rec_id, path, r.label) for path, t in tables.items() if path not in ("records", "abstract") for r in t.select("rec_id", "label").collect()}
    assert {r.rec_id for r in tables["records"].collect()} >= {r[0] for r in nodes} and {r.rec_id for r in bodies.collect()} & {r[0] for r in nodes}


def test_one_pass_gives_the_same_tables_and_no_leaf_is_lost(spark, data):
    typed, bodies = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("pdf_json", "raw_json"))
    one, each = paper_tables(typed, bodies, one_pass=True), paper_tables(typed, bodies)
    assert set(one) == set(each) and len(one) == 8
    for name in each:
        assert one[name].columns == each[name].columns
        assert sorted(map(str, one[name].collect())) == sorted(map(str, each[name].collect())), name

    def leaves(v, at_root=False):
        if isinstance(v, dict):
            return sum(leaves(x) for k, x in v.items() if not (at_root and k == "rec_id"))
        if isinstance(v, list):
            return sum(leaves(x) for x in v) if any(isinstance(x, (dict, list)) for x in v) else bool([x for x in v if x is not None])
        return int(v is not None)

    true = sum(leaves(r.asDict(recursive=True), True) for r in typed.collect())
    tables = paper_tables(typed, bodies.limit(0), one_pass=True)
    links = {"rec_id", "label", "parent_label", "ordinal"}
    # the authors' table repeats the leaves of its affiliations
    got = sum(leaves({k: v for k, v in r.asDict(recursive=True).items() if k not in links and not k.startswith("affiliation_")}) for t in tables.values() for r in t.collect())
    assert got == true
