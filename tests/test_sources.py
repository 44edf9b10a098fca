import json
import os
import subprocess
import sys

import pytest

from inkwell.plans.campaign import Point, event_log_summary, points
from inkwell.sources import files, readers, writers
from inkwell.streaming import wordcounts


def test_catalogue_with_quoted_lines(spark, tmp_path):
    path = tmp_path / "metadata.csv"
    path.write_text('cord_uid,title,abstract\na,"two\nlines, ""quoted""",NA\nb,,nan\nc," kept ",x\n', encoding="utf-8")
    out = readers.read_catalogue(spark, str(path), ["cord_uid", "title", "abstract"]).collect()
    assert [tuple(r) for r in out] == [("a", 'two\nlines, "quoted"', None), ("b", None, None), ("c", " kept ", "x")]


def test_papers_from_files(spark, tmp_path):
    (tmp_path / "pdf_json").mkdir()
    good = {"paper_id": "p1", "metadata": {"title": "t", "authors": [{"first": "A", "last": "B", "affiliation": {}}, {"affiliation": {"institution": " I ", "location": {"country": "X"}}}]}, "body_text": [{"text": " ", "section": "s"}, {"text": "words", "section": " "}]}
    (tmp_path / "pdf_json" / "p1.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "pdf_json" / "p2.json").write_text("<html>")
    papers = readers.read_papers(spark, str(tmp_path / "pdf_json"))
    catalogue = spark.createDataFrame([("u", "pdf_json/p1.json; pdf_json/p2.json;", None)], "cord_uid string, pdf_json_files string, pmc_json_files string")
    assert [tuple(r) for r in readers.catalogue_paragraphs(catalogue, papers).collect()] == [("u", "p1", "pdf", 1, None, "words")]
    assert [tuple(r) for r in readers.catalogue_authors(catalogue, papers).orderBy("author_idx").collect()] == [("u", "p1", 0, None, None, None), ("u", "p1", 1, "I", "X", None)]
    assert [tuple(r)[1:] for r in readers.author_rows(papers, "paper_id").collect()] == [(0, None, None, None), (1, "I", "X", None)]


def test_path_list(spark):
    df = spark.createDataFrame([(" a ; b;;",), (None,), ("",)], "p string")
    assert [r.x for r in df.select(readers.path_list(df.p).alias("x")).collect()] == [["a", "b"], [], []]


def test_vectors_keep_odd_words(spark, tmp_path):
    (tmp_path / "m.vec").write_text('3 2\n" 1 2\nnan 3 4\nw 5 x\n')
    assert [(r.word, r.vec) for r in readers.read_vectors(spark, str(tmp_path / "m.vec")).collect()] == [('"', [1.0, 2.0]), ("nan", [3.0, 4.0]), ("w", [5.0, None])]


def test_sample_is_repeatable(spark):
    df = spark.range(100)
    one = readers.sample(df, 10, 1).collect()
    assert one == readers.sample(df.repartition(7), 10, 1).collect() and one != readers.sample(df, 10, 2).collect()


def test_missing_columns_and_config(spark, data, tmp_path):
    with pytest.raises(ValueError, match="nothing"):
        readers.read_columns(spark, f"{data}/papers.parquet", ["title", "nothing"])
    (tmp_path / "c").write_text("# hosts\n\na, b,c\n")
    assert readers.config_values(tmp_path / "none", tmp_path / "c") == ["a", "b", "c"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "x string, n int")
    writers.write_parquet(df, str(tmp_path / "t"), 1)
    assert files.folder_size(str(tmp_path / "t"))[0] >= 2 and spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert "a\\|b" in writers.markdown_table(df)
    writers.append_row(tmp_path / "m.csv", {"a": 1})
    writers.append_row(tmp_path / "m.csv", {"a": 2})
    assert (tmp_path / "m.csv").read_text().split() == ["a", "1", "2"]
    assert writers.write_summary(df.agg({"n": "sum"}), tmp_path / "s.json", extra="e")["extra"] == "e"
    with pytest.raises(ValueError):
        writers.guard_output(str(tmp_path), str(tmp_path / "in"))
    with pytest.warns(UserWarning):
        writers.guard_output(str(tmp_path / "in" / "x"), str(tmp_path / "in"))
    with pytest.raises(ValueError):
        writers.write_parquet(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "t" / "below"))
    writers.report(tmp_path / "r.md", "Title", {"Words": "few", "Rows": df})
    assert (tmp_path / "r.md").read_text().startswith("# Title\n\n## Words\n\nfew\n\n## Rows\n\n| x | n |")
    assert sum(r.n_rows for r in files.rows_per_file(spark, str(tmp_path / "t")).collect()) == 2


def test_campaign_points():
    assert [p.partitions for p in points(Point(), partitions=[4, 8, 16])] == [8, 4, 16]


def test_running_count(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("virus host",)], "text string").write.parquet(src)
    q = wordcounts.into_memory(wordcounts.counts(spark, src, "text string", "text"), "running", str(tmp_path / "ck"))
    q.processAllAvailable()
    spark.createDataFrame([("virus",)], "text string").write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert {r.word: r["count"] for r in spark.table("running").collect()} == {"virus": 2, "host": 1}


def test_numbered_files(spark, tmp_path):
    path = str(tmp_path / "parts")
    end = 0
    for b in range(4):
        end = writers.append_batch(spark.range(b * 900, b * 900 + 900, 1, 3).coalesce(3), path, end, rows_per_group=100)
    names = files.data_files(spark, path)
    assert end == 12 and [n.rsplit("/", 1)[1] for n in names] == [f"part.{k}.parquet" for k in range(12)]
    assert files.footers(names[0].removeprefix("file:"))[0]["row_groups"] == 3
    assert files.partition_slice(spark, path, 9, 12).agg({"id": "min"}).first()[0] == 2700 and files.partition_slice(spark, path, 12, 13).count() == 0
    assert files.read_in_groups(spark, names, 5).rdd.getNumPartitions() == 5 and files.read_in_groups(spark, names, 99).count() == 3600
    writers.append_batch(spark.range(2700, 3600, 1, 3), path, 9)  # the last batch again
    assert spark.read.parquet(path).count() == 3600
    assert [len(g) for g in files.even_groups(range(11), 4)] == [3, 3, 3, 2] and files.file_number("a/part-00010-c000.zstd.parquet")[0] >= 0


def test_landed_catalogue(spark, tmp_path):
    (tmp_path / "m.csv").write_text('cord_uid,title\na,"two\nlines"\nb,NA\n')
    out = readers.landed_catalogue(spark, str(tmp_path / "m.csv"), str(tmp_path / "bronze"), ["cord_uid", "title"], 2)
    assert sorted(map(tuple, out.collect())) == [("a", "two\nlines"), ("b", None)]


def test_event_log_summary():
    task = lambda stage, ms, rss, failed=False: {"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Task Info": {"Executor ID": "1", "Failed": failed}, "Task Metrics": {"Executor Run Time": ms, "Disk Bytes Spilled": 2_000_000, "Shuffle Write Metrics": {"Shuffle Bytes Written": 500_000}}, "Task Executor Metrics": {"JVMHeapMemory": rss}}
    lines = [json.dumps(x) for x in (task(0, 1500, 3e8), task(0, 500, 2e8, True), {"Event": "SparkListenerStageExecutorMetrics", "Executor ID": "2", "Executor Metrics": {"ProcessTreePythonRSSMemory": 1e8}}, {"Event": "other"})]
    out = event_log_summary(lines)
    assert out["stages"] == {0: {"tasks": 2, "failed": 1, "task_seconds": 2.0, "longest": 1.5, "spilled_mb": 4.0, "shuffled_mb": 1.0}}
    assert out["executors"] == {"1": {"heap_mb": 300.0}, "2": {"python_mb": 100.0}}


def test_campaign_measures_what_ran(data, tmp_path):
    """In a process of its own, as each point has a session of its own."""
    code = f"""
import json, sys
from inkwell.plans.campaign import Point, measure, points
from inkwell.session import get_session
def session(p):
    return get_session("campaign", f"local[{{p.cores}}]", **{{"spark.sql.shuffle.partitions": str(p.shards), "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file:{tmp_path}", "spark.eventLog.compress": "false"}})
rows = measure(session, "{data}/paragraphs.parquet", "{tmp_path}/out", points(Point(cores=2, partitions=2, shards=2), partitions=[2, 4]) + [Point(curve="none", cores=2, shards=2)], "{tmp_path}/m.csv")
rows += measure(session, "{tmp_path}/nothing", "{tmp_path}/out", [Point(cores=2, shards=2)], "{tmp_path}/m.csv")
print(json.dumps(rows))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=300)
    rows = json.loads(done.stdout.strip().splitlines()[-1])
    assert [r["error"] for r in rows] == ["", "", "", "AnalysisException"] and [r["partitions"] for r in rows][:2] == [2, 4]
    assert all(r["seconds"] > 0 for r in rows[:3]) and len((tmp_path / "m.csv").read_text().splitlines()) == 5
    logs = [x for x in tmp_path.rglob("*") if x.is_file() and ("app-" in x.name or "local-" in x.name or "events_" in x.name) and not x.name.endswith(".crc")]
    assert logs and any(event_log_summary(x.read_text().splitlines())["stages"] for x in logs)
