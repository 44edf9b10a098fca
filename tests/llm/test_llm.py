"""Operators for training text: nulls, empty tables, ties, repeated rows, clashing columns, and results against brute force."""

import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import canonical, encodings, leaks, names, neighbours, packing, scans, survivors, term_counts
from inkwell.llm import queries as Q

# --- 1: survivors ---------------------------------------------------------------------------------------------------

P1 = "row_id long, cord_uid string, para_idx int, source string, section string, text string, parsed_at timestamp, n_rows int, rank string"


def p1_rows():
    from datetime import datetime as t

    return [
        (1, "a", 0, "pdf", "S", "wrong text", t(2021, 1, 2), 1, "x"), (2, "a", 0, " PMC", " ", "right", t(2021, 1, 1), 1, "x"), (3, "a", 0, "pmc", None, "right", None, 1, "x"),
        (4, "a", 1, None, "z", " ", None, 1, "x"), (5, "a", 1, "other", None, None, t(2022, 1, 1), 1, "x"),
        (6, None, 0, "pmc", "q", "t", None, 1, "x"), (7, None, 0, "pmc", "q", "t", None, 1, "x"), (7, None, 0, "pmc", "q", "t", None, 1, "x"), (8, "b", 0, "pdf", "alone", "alone", None, 1, "x"),
    ]


def test_survivors_follow_the_stated_order(spark):
    df = spark.createDataFrame(p1_rows(), P1)
    out = survivors.best_records(df, ["cord_uid", "para_idx"], "row_id", "text", ["section"], "source", ["pmc", "pdf"], "parsed_at")
    got = {(r.cord_uid, r.para_idx): (r.n_rows, r.text, r.text_row_id, r.section, r.section_row_id) for r in out.collect()}
    assert got == {("a", 0): (3, "right", 2, "S", 1), ("a", 1): (2, None, 5, "z", 4), (None, 0): (3, "t", 6, "q", 6)}
    assert survivors.best_records(df.limit(0), ["cord_uid", "para_idx"], "row_id", "text", ["section"], "source", ["pmc", "pdf"], "parsed_at").count() == 0


def claims(n=3000, seed=1):
    """Two good sources and one that is wrong in 40 % of its claims."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        for s, wrong in (("good", 0.05), ("fair", 0.1), ("bad", 0.4)):
            if rng.random() < 0.9:
                rows.append((k, s, f"false {k} {s}" if rng.random() < wrong else f"true {k}"))
    return rows


def test_em_tells_good_from_bad_sources(spark):
    df = spark.createDataFrame(claims(), "k long, source string, v string")
    q = survivors.fit_sources(df, ["k"], ["v"], "source", ["good", "fair", "bad"])
    trust = dict(zip(q.sources, q.trust("v")))
    assert trust["good"] > trust["fair"] > trust["bad"]
    rows = survivors.judged_values(df, ["k"], ["v"], "source", q).collect()
    right = lambda r: r.value == f"true {r.k}"
    assert sum(right(r) == r.judged_true for r in rows) / len(rows) > 0.87
    assert sum(right(r) for r in rows if r.judged_true) / sum(r.judged_true for r in rows) > 0.95


def test_survivors_are_chosen_by_the_model(spark):
    """Two sources a group, the worse one later: only what EM learns about the sources can choose rightly."""
    rng, rows = random.Random(6), []
    for k in range(2_000):
        three = rng.random() < 0.4
        for s, wrong, day in (("good", 0.03, 1), ("fair", 0.1, 2), ("bad", 0.5, 3)):
            if three or s != "fair":
                rows.append((k, s, f"false {k} {s}" if rng.random() < wrong else f"TRUE, {k}", f"2021-01-0{day}", 1))
    rows += [(None, "good", "x", None, 1), (None, "bad", " ", None, 1), (None, None, "!", None, 1), (9_000, "good", None, None, 1)]
    df = spark.createDataFrame(rows, "k long, source string, v string, t string, n_rows int").withColumn("t", F.to_timestamp("t"))
    q = survivors.fit_sources(df, ["k"], ["v"], "source")
    assert sorted(q.sources) == ["bad", "fair", "good", "other"]
    flat = survivors._start(q.sources, ["v"])
    share = lambda model: sum(r.v == f"TRUE, {r.k}" for r in survivors.survivors(df, ["k"], ["v"], "source", "t", q=model).where("k < 9000").collect()) / 2_000
    assert share(q) > 0.9 > 0.8 > share(flat)
    rest = {r.k: (r.n_rows, r.v) for r in survivors.survivors(df, ["k"], ["v"], "source", "t", q=q).where("k IS NULL OR k = 9000").collect()}
    assert rest == {None: (3, "x"), 9_000: (1, None)}
    assert survivors.survivors(df.limit(0), ["k"], ["v"], "source", "t").count() == 0


def test_survivors_with_clashing_names(spark):
    df = spark.createDataFrame([("k", "pdf", "v", "x", 1)], "field string, source string, value string, odds string, n long")
    assert [tuple(r) for r in survivors.survivors(df, ["field"], ["value"], "source").collect()] == [("k", 1, "v")]
    judged = survivors.judged_values(df, ["field"], ["value"], "source")
    assert judged.columns == ["field_", "field", "value", "probability", "judged_true"] and judged.first()[:3] == ("k", "value", "v")


def test_a_field_may_keep_several_values(spark):
    """Authors named by several good sources are all kept, one named by a bad source alone isn't."""
    rng, rows = random.Random(5), []
    for k in range(1_500):
        for s in ("a", "b", "c"):
            rows += [(k, s, f"{x} {k}") for x in ("first", "second") if rng.random() < 0.9]
        rows += [(k, "bad", f"{x} {k}") for x in ("first", "wrong") if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k long, source string, v string")
    out = survivors.survivors(df, ["k"], ["v"], "source", several=("v",)).collect()
    assert sum(set(r.v) == {f"first {r.k}", f"second {r.k}"} for r in out) / len(out) > 0.9


def test_em_on_spark_equals_em_on_the_driver(spark, monkeypatch):
    df = spark.createDataFrame(claims(300), "k long, source string, v string")
    one = survivors.fit_sources(df, ["k"], ["v"], "source", ["good", "fair"], iterations=5)
    monkeypatch.setattr(survivors, "PATTERN_LIMIT", 0)
    two = survivors.fit_sources(df, ["k"], ["v"], "source", ["good", "fair"], iterations=5)
    assert np.allclose(one.sensitivity["v"], two.sensitivity["v"]) and np.allclose(one.specificity["v"], two.specificity["v"])


# --- 2: neighbours --------------------------------------------------------------------------------------------------


def vectors(n=1200, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    return np.concatenate([base + rng.normal(scale=0.12 * k, size=base.shape) for k in range(4)]).astype(np.float32)


def test_neighbours_recall(spark):
    v = vectors()
    df = spark.createDataFrame([(f"u{k:05d}", [float(x) for x in row], "x", 1) for k, row in enumerate(v)], "id string, vec array<float>, same string, code int")
    got = {(r.id, r.other) for r in neighbours.nearest(df, "id", "vec", 3).where("cosine >= 0.8").collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    true = {(f"u{a:05d}", f"u{b:05d}") for a in range(len(v)) for b in np.argsort(-s[a])[:3] if s[a, b] >= 0.8}
    assert len(true) > 1000 and len(got & true) / len(true) >= 0.95 and len(got - true) <= 0.02 * len(got)


def test_equal_odd_and_missing_vectors(spark):
    rows = [(f"c{k}", [1.0, 2.0, 0.0]) for k in range(40)] + [("s", [2.0, 4.0, 0.0]), ("z", [0.0, 0.0, 0.0]), ("n", None), ("short", [1.0]), ("nan", [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), ("near", [1.0, 2.1, 0.0]), ("c0", [1.0, 2.0, 0.0])]
    out = neighbours.nearest(spark.createDataFrame(rows, "id string, vec array<double>"), "id", "vec", 3).collect()
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        by[r.id].append(r.other)
    assert by["c5"] == ["c0", "c1", "c10"] and by["s"] == ["c0", "c1", "c10"] and by["near"] == ["c0", "c1", "c10"]
    assert not {"z", "n", "short", "nan", None} & (set(by) | {x for v in by.values() for x in v}) and len(by) == 42
    assert neighbours.nearest(spark.createDataFrame([], "id string, vec array<float>"), "id", "vec").count() == 0


def test_full_buckets_are_scored_whole(spark, monkeypatch):
    """Near copies and the rest, with buckets of any size taken as full ones: the same neighbours."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 90)
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=(1, 24)) + 0.01 * rng.normal(size=(300, 24)), rng.normal(size=(100, 24))]).astype(np.float32)
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "id long, vec array<float>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    best = {a: set(np.argsort(-s[a])[:3].tolist()) for a in range(300)}
    for hot in (20, 10**6):
        got = defaultdict(set)
        for r in neighbours.nearest(df, "id", "vec", 3, hot_rows=hot).collect():
            got[r.id].add(r.other)
        assert sum(len(best[a] & got[a]) for a in best) >= 0.99 * 900


def test_two_blocks_scored_whole():
    u = vectors(800, 16)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    x, y = u[:300], u[300:]
    a, b, c = neighbours.block_neighbours(x, y, 3, False, chunk=128)
    s = x @ y.T
    assert all(np.allclose(np.sort(c[a == k])[-3:], np.sort(s[k])[-3:], atol=1e-5) for k in range(300))
    assert all(np.allclose(np.sort(c[b == k])[-3:], np.sort(s[:, k])[-3:], atol=1e-5) for k in range(500))
    assert len(set(zip(a.tolist(), b.tolist()))) == len(a)


def test_pigeonhole_finds_every_code_within_the_radius(spark):
    """Codes that differ in 3 m - 1 bits or less are filed under a common key, however the bits are chosen."""
    rng, (m, bits) = np.random.default_rng(2), neighbours.scheme(400)
    on = rng.integers(0, 2, (300, m * bits))
    other = on.copy()
    for row in other:
        row[rng.choice(m * bits, rng.integers(0, 3 * m), replace=False)] ^= 1
    parts = lambda x: (x.reshape(len(x), m, bits) @ (1 << np.arange(bits))).tolist()
    df = spark.createDataFrame(list(zip(parts(on), parts(other))), "x array<long>, y array<long>")
    keys = [df.select(F.col(c).alias("parts")).select(neighbours.filed(m, bits).alias("k")).collect() for c in ("x", "y")]
    assert all(set(a.k) & set(b.k) and len(set(a.k)) == m * (bits + 1) for a, b in zip(*keys))
    assert neighbours.scheme(1 << 20) == (18, 21) and neighbours.scheme(0) == (8, 8)


# --- 3: scans -------------------------------------------------------------------------------------------------------

WORDS = "the clinical modern infection of severe mortality remained associated with early recovery and supported vaccination under routine surveillance whereas community-acquired cohort levels without immunity".split()


@pytest.fixture(scope="module")
def lexicon(spark):
    rng = random.Random(4)
    rows = [(" ".join(rng.choices(WORDS, k=40)),) for _ in range(400)]
    heads = [f"{a} et al. / J {b} Med {n} ({2000 + n}) {n}–{n + 9}" for n, (a, b) in enumerate(zip(["Fipave", "Gorlan", "Tirsen", "Abelko"] * 3, ["Bivi", "Soma", "Kelo"] * 4))]
    heads += [f"{a} and {b}" for a in ("Doseziova", "Belkar", "Timore") for b in ("Morazaova", "Sulven")]
    pages = [("\n".join([" ".join(rng.choices(WORDS, k=9)), h, " ".join(rng.choices(WORDS, k=9))]),) for h in heads]
    return scans.lexicon_of(spark.createDataFrame(rows + pages + [("et al. in J Med and",)] * 60, "text string"), "text")


@pytest.mark.parametrize(
    "damaged, whole, kinds",
    [
        ("severe infec-\ntion remained", "severe infection remained", ["hyphen"]),
        ("severe infec\xad\r\ntion remained", "severe infection remained", ["hyphen"]),
        ("the community-\nacquired cohort", "the community-acquired cohort", []),
        ("the sevcre infecti0n", "the severe infection", ["ocr"]),
        ("the w i t h o u t immunity", "the without immunity", ["ocr"]),
        ("the mort ality of", "the mortality of", ["ocr"]),
        ("early recovery\nFipave et al. / J Bivi Med 22 (2022) 478–488\nand supported", "early recovery and supported", ["header"]),
        ("early recovery\nDOSEZIOVA AND MORAZAOVA\nand supported", "early recovery and supported", ["header"]),
        ("early recovery\n- 676 -\nand supported", "early recovery and supported", ["page"]),
        ("early recovery\n431\nand supported", "early recovery and supported", ["page"]),
        ("of the cohort (n =\n431\n) and", "of the cohort (n = 431 ) and", []),
        ("early recovery remained\nsevere infection\nand supported", "early recovery remained severe infection and supported", []),
        ("the clinical infecton of", "the clinical infection of", ["ocr"]),
        ("early rcovery and", "early recovery and", ["ocr"]),
        ("early Rcovery and", "early Rcovery and", []),
        ("zapebo rcovery zapebi", "zapebo rcovery zapebi", []),
        ("the clinical\ncohort H5N8 p53", "the clinical cohort H5N8 p53", []),
        ("the zapebovir cohort Müller", "the zapebovir cohort Müller", []),
        ("", "", []),
        (None, None, []),
    ],
)
def test_scan_repair(lexicon, damaged, whole, kinds):
    assert scans.repair(damaged, lexicon) == (whole, kinds)


def test_trie_retrieval_is_complete(lexicon):
    for w in ("infecti0n", "modem", "rnodern", "sevcre", "recovcry"):
        found = {v for _, v in lexicon.search(w)}
        assert found, w
    assert {v for _, v in lexicon.search("recovery", 1.0)} >= {"recovery"} and {v for _, v in lexicon.search("recoverx", 1.0)} == {"recovery"}


def test_misreadings_within_the_budget_are_all_retrieved(lexicon):
    words = [w for w in lexicon.count if len(w) >= 6]
    for w in words[:12]:
        for wrong in {w[:2] + w[3:], w[:2] + "x" + w[2:], w[:2] + "x" + w[3:]}:
            near = {v for v in lexicon.count if len(v) >= 3 and _levenshtein(wrong, v) <= 1}
            assert near <= {v for _, v in lexicon.search(wrong, 1.0)}


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_planted_scan_damage_is_found(spark, data):
    for r in Q.p3_recall(spark, data).collect():
        assert r.n_damaged >= 5 and r.recall >= (0.5 if r.kind == "edit" else 0.9), r


def test_repaired_keeps_other_columns(spark, lexicon):
    df = spark.createDataFrame([(1, "a sevcre infection", "mine"), (2, None, "x"), (2, None, "x")], "k int, text string, kinds string")
    out = scans.repaired(df, "text", lexicon).orderBy("k").collect()
    assert [(r.k, r.repaired_text, r.kinds) for r in out] == [(1, "a severe infection", ["ocr"]), (2, None, []), (2, None, [])]
    assert scans.vocabulary(df.limit(0), "text")[0] == [] and scans.repair("any text", scans.Lexicon([])) == ("any text", [])


# --- 5: names -------------------------------------------------------------------------------------------------------


def test_variants_of_names(spark):
    org = ["Bravik General Hospital", "Hospital General de Bravik", "Gen. Hosp. Bravik", "Barvik General Hospital", "BRAGH", "bravik general hospital", "Bravik Gneral Hospital", "Bravik General Hospital (BR)"]
    others = ["University of Bravik", "Bravik Univ", "Bravik Medical University", "Oldmarsh General Hospital", "Oldmarsh Gen. Hosp"]
    rows = [(n, "Bravik" if "Oldmarsh" not in n else None, 7) for n in org + others for _ in range(2)] + [(None, "Bravik", 1), (" ", None, 1), ("???", None, 1)]
    df = spark.createDataFrame(rows, "inst string, town string, n_rows int")
    out = {r.name: r.entity for r in names.linked_names(df, "inst", "town").collect()}
    assert len({out[n] for n in org}) == 1 and len({out[n] for n in others}) == 3 and out["University of Bravik"] == out["Bravik Univ"]
    assert {out[n] for n in org} & {out[n] for n in others} == set() and " " not in out
    pairs = names.name_pairs(names.linked_names(df, "inst", "town")).collect()
    assert len(pairs) == 28 + 1 + 1 and all(r.name_a < r.name_b for r in pairs)
    assert names.linked_names(df.limit(0), "inst", "town").count() == 0


def linked(spark, rows):
    return {r.name: r.entity for r in names.linked_names(spark.createDataFrame(rows, "inst string, town string"), "inst", "town").collect()}


def test_a_typing_error_in_many_spellings_is_no_place_of_its_own(spark):
    wrong = ["Pewnarren University", "University of Pewnarren", "PEWNARREN UNIVERSITY", "Univ. Pewnarren"]
    out = linked(spark, [("Penwarren University", "Penwarren")] + [(n, None) for n in wrong])
    assert len(set(out.values())) == 1
    forms = ["{} University", "University of {}", "{} Univ.", "Univ. {}", "Univ {}", "{} univ", "U. of {}", "Univ. of {}", "{} UNIVERSITY", "University {}", "{} university", "university of {}"]
    out = linked(spark, [(f.format("Penwarren"), None) for f in forms] + [(n, None) for n in wrong])
    assert len(set(out.values())) == 1
    out = linked(spark, [(f.format(x), None) for f in forms for x in ("Penwarren", "Pewnarren")])
    assert len(set(out.values())) == 2  # as well supported: two places


def test_rounds_go_on_until_nothing_merges(spark, monkeypatch):
    rounds = []
    real = names._moves

    def one_at_a_time(full, state):
        rounds.append(1)
        moves = real(full, state)
        return None if moves is None else moves.orderBy("entity").limit(1)

    monkeypatch.setattr(names, "_moves", one_at_a_time)
    wrong = ["Penwarrem", "Penwarrin", "Panwarren", "Penwaren", "Pnwarren", "Penwarten", "Penvarren", "Pemwarren", "Penwarrn", "Penqarren"]
    out = linked(spark, [("Penwarren University", "Penwarren")] + [(f"{w} University", None) for w in wrong])
    assert len(set(out.values())) == 1 and len(rounds) > len(wrong)


def test_every_place_of_a_block_is_compared(spark):
    # Tavrin shares one key with both, "tavin"; Stavin is better supported but farther
    forms = ["{} University", "University of {}", "{} Univ.", "Univ. {}", "Univ {}", "{} univ"]
    out = linked(spark, [(f.format(p), p) for p, n in (("Tavlin", 2), ("Stavin", 6)) for f in forms[:n]] + [("Tavrin Univ", None)])
    assert out["Tavrin Univ"] == out["Tavlin University"] != out["Stavin University"]


def test_spelling_without_place_is_blocked_by_settlement(spark):
    rows = [("Bravik University", "Bravik"), ("The University", "Bravik"), ("The University", "Bravik"), ("Hospital", "Bravik"), ("Bravik Hospital", "Bravik"), ("Univ.", "Bravik"), ("Univ.", "Oldmarsh")]
    out = linked(spark, rows)
    assert out["The University"] == out["Bravik University"] and out["Hospital"] == out["Bravik Hospital"] != out["Bravik University"]
    assert out["Univ."] == "Univ."  # of two towns


def test_general_words_are_learned(spark):
    towns = ["Bravik", "Oldmarsh", "Tavlin", "Penwarren", "Sarvany", "Cardavel", "Kestby", "Lamorra", "Voderford", "Pellano"]
    rows = [(f"{kind} {t}", t) for t in towns for kind in ("Museum of", "Ministry")] + [("Minisrty Bravik", "Bravik"), ("Oldmarsh Museum", None), ("North Halvard Museum", "North Halvard")]
    out = linked(spark, rows)
    assert out["Museum of Bravik"] != out["Ministry Bravik"] == out["Minisrty Bravik"] and out["Oldmarsh Museum"] == out["Museum of Oldmarsh"]
    df = spark.createDataFrame(rows, "name string, settle string")
    assert names.generic_words(df) == ["ministry", "museum"] and names.generic_words(df.limit(0)) == []


def test_mentions_and_many_spellings(spark, monkeypatch):
    links = spark.createDataFrame([(f"n{k}", "e", 1) for k in range(30)] + [("Bravik Hospital", "h", 5), ("other", "o", 1)], "name string, entity string, n_rows long")
    df = spark.createDataFrame([("Dept. of X, BRAVIK hospital., Bravik, Egypt", 1), ("Egypt", 1), (None, 1), ("", 1), ("other, n3", 1)], "affiliation string, entity int")
    assert {r.mention: (r.entity, r.name) for r in names.linked_mentions(df, "affiliation", links).collect()} == {"Dept. of X, BRAVIK hospital., Bravik, Egypt": ("h", "Bravik Hospital"), "other, n3": ("o", "other")}
    whole = sorted(map(tuple, names.name_pairs(links).collect()))
    monkeypatch.setattr(names, "PAIR_ROWS", 4)
    assert len(whole) == 435 and whole == sorted(map(tuple, names.name_pairs(links).collect()))


def test_new_misspellings_are_linked(spark, data):
    r = Q.p5_recall(spark, data).first()
    assert r.n_variants >= 20 and r.recall >= 0.9


def test_name_parts():
    assert names.parse("Acad. of Med. Scienaes North Halvard")[:2] == ("academy medical science", "north halvard")
    assert names.parse("Universität Tarrington")[:2] == ("university", "tarrington") and names.parse("U. of Tarrington")[2] == "UTAR"
    assert names.distance("abcd", "acbd") == 1 and names.distance("", "ab") == 2


# --- 6: canonical values --------------------------------------------------------------------------------------------

COUNTRIES = [("IRN", "Iran", ["Islamic Republic of Iran"]), ("IRQ", "Iraq", None), ("USA", "United States", ["USA"]), ("GBR", "United Kingdom", ["UK", "Wales"]), ("ISL", "Iceland", []), ("IRL", "Ireland", []), ("CHN", "China", ["P.R. China"])]


def test_canonical_values(spark):
    entries = spark.createDataFrame(COUNTRIES, "iso3 string, name string, alt_names array<string>")
    typed = {"Iran": "IRN", "Iraq;": "IRQ", "U. S. A.": "USA", "untied states": "USA", "Iceland": "ISL", "Ireland 123": "IRL", "Chnia": "CHN", "P.R.  CHINA": "CHN", "Varnholt, China": "CHN", "UK / China": "GBR", "not stated": "NONE", "???": "NONE", "": "NONE", "WALES": "GBR", "unknown": "NONE"}
    df = spark.createDataFrame([(v, 1) for v in typed for _ in range(2)] + [(None, 1)], "country string, score int")
    got = {r.value: (r.iso3, r.n_rows) for r in canonical.canonical(df, "country", entries, "iso3", "name", "alt_names").collect()}
    assert got == {v: (k, 2) for v, k in typed.items()}
    assert canonical.canonical(df.limit(0), "country", entries, "iso3", "name", "alt_names").count() == 0
    assert {r.iso3 for r in canonical.canonical(df, "country", entries.limit(0), "iso3", "name", "alt_names").collect()} == {"NONE"}


# --- 7: term counts -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("spill_rows", [10, 1_500_000])
def test_terms_equal_a_plain_count(spark, spill_rows):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(150)] + ["a", "9", "x-ray", "Über", "H5N8"]
    rows = [(k, None if k % 17 == 0 else "hot" if k % 2 else f"d{rng.randrange(40)}", None if k % 13 == 0 else " ".join(rng.choices(vocabulary, k=20)), "clash") for k in range(400)]
    df = spark.createDataFrame(rows + rows[:5], "row_id long, cord_uid string, text string, term string")
    got = {r.term: (r.n_occurrences, r.n_records, r.mark) for r in term_counts.term_frequencies(df, "text", "cord_uid", "row_id", spill_rows=spill_rows).collect()}
    n, docs = Counter(), defaultdict(set)
    for _, d, t, _ in rows + rows[:5]:
        for w in re.findall("[a-z0-9]+", (t or "").lower()):
            if len(w) >= 2 and re.search("[a-z]", w):
                n[w] += 1
                if d is not None:
                    docs[w].add(d)
    every = len(set().union(*docs.values()))
    mark = lambda w: "rare" if len(docs[w]) <= 2 else "common" if len(docs[w]) > every / 2 else None
    assert got == {w: (n[w], len(docs[w]), mark(w)) for w in n}


def test_a_record_of_a_hundredth_of_the_rows_is_spread(spark):
    rows = [(k, "big" if k < 20 else f"d{k}", "same words here") for k in range(2_000)]
    df = spark.createDataFrame(rows, "row_id long, cord_uid string, text string")
    base = df.select(F.col("cord_uid").alias("r"), F.xxhash64("row_id").alias("s"), F.col("text").alias("t"))
    at = {parts: term_counts.placed_by_record(base, 2_000, parts).where("r = 'big'").select(F.spark_partition_id().alias("p")).distinct().count() for parts in (8, 128)}
    assert at[8] == 1 and at[128] > 5
    spark.conf.set("spark.sql.shuffle.partitions", "128")
    try:
        got = {r.term: (r.n_occurrences, r.n_records) for r in term_counts.term_frequencies(df, "text", "cord_uid", "row_id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {w: (2_000, 1_981) for w in ("same", "words", "here")}


def test_no_terms(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "1 2 3")], "row_id long, cord_uid string, text string")
    assert term_counts.term_frequencies(df, "text", "cord_uid", "row_id").count() == 0
    assert term_counts.term_frequencies(df.limit(0), "text", "cord_uid").count() == 0


# --- 8: packing -----------------------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.randrange(1, 60))), rng.choice([0, 3, 40, 77, 250]), "x") for k in range(3000)] + [(5000, "long", 205, "x"), (5001, None, None, "x"), (5002, "", 0, "x"), (5003, "two words", None, "x"), (5003, "two words", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, container string")
    out = packing.packed(df, "doc_id", "text", "n_tokens", 100).collect()
    held, sizes = defaultdict(list), defaultdict(list)
    for r in out:
        held[r.container].append(r)
        sizes[r.item].append((r.piece, r.first_token, r.n_tokens))
    assert max(sum(x.n_tokens for x in v) for v in held.values()) <= 100
    assert all(sorted(x.position for x in v) == list(range(len(v))) for v in held.values())
    assert sorted(sizes[5000]) == [(0, 0, 100), (1, 100, 100), (2, 200, 5)] and sizes[5001] == [(0, 0, 0)] and sizes[5003] == [(0, 0, 2)] * 2
    assert sum(r.n_tokens for r in out) == sum(r[2] or 0 for r in rows) + 4
    assert all(len(v) == 1 for k, v in sizes.items() if k < 3000 and rows[k][2] <= 100)
    assert packing.packed(df.limit(0), "doc_id", "text", "n_tokens").count() == 0


def test_containers_hold_like_texts(spark):
    rng = random.Random(3)
    topics = [[f"t{t}w{k}" for k in range(40)] for t in range(12)]
    rows = [(k, " ".join(rng.choices(topics[k % 12], k=30)), 30) for k in range(1_200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    r = packing.locality(packing.packed(df, "doc_id", "text", "n_tokens", 300), df, "doc_id", "text").first()
    assert r.in_container > 2 * r.any_two and r.containers >= 120


def test_locality_of_nothing(spark):
    kind = "doc_id long, text string, n_tokens int"
    for rows, n in (([], 0), ([(1, "a", 1), (2, None, None), (3, "", 0), (4, "x y " * 3_000, None)], 0)):
        df = spark.createDataFrame(rows, kind)
        assert tuple(packing.locality(packing.packed(df, "doc_id", "text", "n_tokens"), df, "doc_id", "text").first()) == (n, None, None)


def test_hilbert_neighbours_touch():
    n = 3
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = grid[np.argsort(packing.hilbert(grid.astype(np.int64), n))]
    assert sorted(packing.hilbert(grid.astype(np.int64), n).tolist()) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# --- 9: leaks -------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(9)
    vocabulary = [f"word{k}" for k in range(4000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    items = {k: text(rng.choice([45, 80, 150])) for k in range(30)}
    docs, true = [], set()
    for k in range(300):
        w, i = text(rng.choice([0, 30, 300, 2500])), k % 30
        own = items[i]
        if k % 3 == 0:
            cut = own[: int(0.6 * len(own))]
            at = rng.randrange(len(w) + 1)
            docs.append((k, " ".join(w[:at] + [x if n % 9 else "other" for n, x in enumerate(cut)] + w[at:])))
            true.add((k, i))
        elif k % 3 == 1:
            docs.append((k, ", ".join(w + own[:9])))  # a short quotation
        else:
            a, b = own[: len(own) // 3], own[-len(own) // 3 :]
            docs.append((k, " ".join(a).upper() + ". " + " ".join(text(20)) + "\n" + " ".join(b)))
            true.add((k, i))
    df = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string").withColumn("item", F.lit("clash"))
    it = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(77, " ".join(items[0])), (78, None), (79, " ")], "item_id long, passage string")
    got = {(r.doc, r.item) for r in leaks.leaked_items(df, "doc_id", "text", it, "item_id", "passage").collect()}
    true |= {(d, 77) for d, i in true if i == 0}
    assert got == true
    assert leaks.leaked_items(df.limit(0), "doc_id", "text", it, "item_id", "passage").count() == 0
    assert leaks.leaked_items(df, "doc_id", "text", it.limit(0), "item_id", "passage").count() == 0


def test_stretches_far_apart_are_chained():
    item, other = np.arange(1, 101, dtype=np.int64), iter(range(1_000, 100_000))
    fill = lambda n: [next(other) for _ in range(n)]
    between = [x for _ in range(90) for x in [*fill(20), *item[95:]]]  # a stock run of the item, again and again
    doc = np.array([*fill(30), *item[10:32], *between, *fill(20), *item[40:62], *fill(30)], dtype=np.uint64)
    assert leaks.share(item, doc) == 0.44
    hits = np.flatnonzero(np.isin(leaks.shingle_hashes(doc), leaks.shingle_hashes(item)))
    assert leaks.share(item, leaks.spread_out(leaks.cut_down(doc, hits))) == 0.44


def test_hundreds_of_stock_runs_between_two_stretches(spark):
    rng = random.Random(12)
    vocabulary = [f"word{k}" for k in range(9_000)]
    item = rng.sample(vocabulary, 100)
    between = [x for _ in range(300) for x in [*rng.choices(vocabulary, k=20), *item[60:65]]]
    doc = [*rng.choices(vocabulary, k=50), *item[:32], *between, *item[66:98], *rng.choices(vocabulary, k=50)]
    df = spark.createDataFrame([(1, " ".join(doc)), (2, " ".join(between))], "doc_id long, text string")
    it = spark.createDataFrame([("a", " ".join(item))], "item_id string, passage string")
    rows = leaks.leaked_items(df, "doc_id", "text", it, "item_id", "passage").collect()
    assert [(r.doc, r.item) for r in rows] == [(1, "a")] and rows[0].share >= 0.64


def test_short_items_and_repeated_documents(spark):
    df = spark.createDataFrame([(1, "they said open the gate at once"), (1, "they said open the gate at once"), (None, "Open, THE gate"), (3, "open gate the"), (4, "lone")], "doc_id long, text string")
    it = spark.createDataFrame([(1, "open the gate"), (2, "Open the gate"), (3, "lone"), (4, "")], "item_id long, passage string")
    got = sorted((str(r.doc), r.item, r.share) for r in leaks.leaked_items(df, "doc_id", "text", it, "item_id", "passage").collect())
    assert got == [("1", 1, 1.0), ("1", 1, 1.0), ("1", 2, 1.0), ("1", 2, 1.0), ("4", 3, 1.0), ("None", 1, 1.0), ("None", 2, 1.0)]


def test_a_leaky_filter_loses_and_adds_nothing(spark, data, monkeypatch):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")
    found = lambda: sorted(map(tuple, leaks.leaked_items(docs, "doc_id", "text", items, "item_id", "passage").collect()))
    one = found()
    monkeypatch.setattr(leaks, "BITS_A_KEY", 1)
    assert one and one == found()


def test_leaks_equal_brute_force(spark, data):
    docs = [(r.doc_id, r.w) for r in spark.read.parquet(f"{data}/documents.parquet").where("length(text) > 0").select("doc_id", leaks.words(F.col("text")).alias("w")).collect()]
    items = [(r.item_id, r.w) for r in spark.read.parquet(f"{data}/eval_items.parquet").select("item_id", leaks.words(F.col("passage")).alias("w")).collect()]
    shingles = {i: set(leaks.shingle_hashes(np.array(w)).tolist()) for i, w in items}
    true = set()
    for d, w in docs:
        own = set(leaks.shingle_hashes(np.array(w)).tolist())
        true |= {(d, i) for i, x in items if own & shingles[i] and leaks.share(np.array(x), np.array(w)) >= 0.4}
    assert true == {(r.doc_id, r.item_id) for r in Q.p9_found(spark, data).collect()}


# --- 10: encodings --------------------------------------------------------------------------------------------------

CLEAN = [
    "Die Größe der Stichprobe überstieg die Zahl künftiger Fälle.", "L’âge médian des décès a été réduit à l’hôpital.", "El número de niños según el género y la señal débil.", "At 52 ± 3 × 10³ cells, TNF-α was “weak” – see Fig. 2.",
    "Клиническое течение болезни не изменила число новых случаев.", "Â and Ã are letters of the transcription key.", "Field notes list «MAÇû and «LÂ» as site labels.", "├── plate_01 and └── plate_02 hold the raw counts.", "The error scales with √n, not with n².", "A ATENÇÃO NÃO MUDOU.",
    "Price: £40 or €45 © Lindhavn Archive.",
]


@pytest.fixture(scope="module")
def model():
    return encodings.ChainClassifier([*CLEAN[:5] * 20, *CLEAN, *encodings.SEEDS])


@pytest.mark.parametrize("s", CLEAN)
def test_clean_text_stays(model, s):
    assert encodings.repair_text(s, model) == (s, [], False)


@pytest.mark.parametrize("chain", ["utf-8>cp1252", "utf-8>latin-1", "utf-8>cp1252 twice", "utf-8>mac-roman", "utf-8>cp850", "utf-8>cp437"])
@pytest.mark.parametrize("s", CLEAN[:4])
def test_chains_are_undone(model, chain, s):
    bad = encodings.garble(s, chain)
    if bad is None or bad == s:
        return
    assert encodings.repair_text(f"Plain before. {bad} Größe after.", model)[0] == f"Plain before. {s} Größe after."


def test_cyrillic_lost_and_partly_garbled(model):
    assert encodings.repair_text(encodings.garble(CLEAN[4], "cp1251>cp1252"), model)[0] == CLEAN[4]
    assert encodings.repair_text("El an�lisis", model)[2] is True
    assert encodings.repair_text("un prélèvement répété a confirmÃ© le degrÃ© Ã\xa0 l’échelle", model)[0] == "un prélèvement répété a confirmé le degré à l’échelle"


@pytest.mark.parametrize("chain", [f"cp1252>{x}" for x in ("cp1251", "koi8-r", "mac-roman", "cp437", "cp850")])
def test_single_wrong_letters_are_restored(spark, chain):
    model = encodings.ChainClassifier([*CLEAN[:5] * 20, *CLEAN, *encodings.SEEDS])
    whole = "Plain before. Die gefährdeten Ärzte für die Größe. Un résumé naïve."
    bad = encodings.garble(whole, chain)
    assert encodings.repair_text(bad, model) == (whole, [chain], False)
    rows = [(1, encodings.garble("The résumé of it.", chain)), (2, "The résumé of it."), (3, "IgGом и COVIDом, mean±sd of NFκB, deﬁne the ﬂow, Smith‡")]
    assert [r.doc for r in encodings.garbled_texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", model).collect()] == [1]


def test_garbled_rows(spark, model):
    rows = [(1, encodings.garble(CLEAN[0], "utf-8>cp1252")), (2, CLEAN[0]), (3, None), (4, ""), (1, encodings.garble(CLEAN[0], "utf-8>cp1252")), (5, "x" * 50_000 + encodings.garble(" é à ü ö.", "utf-8>latin-1"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(0))
    assert sorted(r.doc for r in encodings.garbled_texts(df, "doc_id", "text", model).collect()) == [1, 1, 5]
    assert encodings.garbled_texts(df.limit(0), "doc_id", "text").count() == 0


# --- queries --------------------------------------------------------------------------------------------------------


def test_garbled_on_purpose_is_found(spark, data):
    rows = [r for r in Q.p10_recall(spark, data).collect() if r.chain.startswith("utf-8")]
    n = sum(r.n_garbled for r in rows)
    assert n >= 20 and sum(r.n_found for r in rows) / n >= 0.9


def test_recall_of_nothing(spark):
    docs, a = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(None, None), ("x", None), (" ", "t")], "n string, s string")
    lex = scans.lexicon_of(docs, "text")
    assert lex.headers == frozenset() and scans.recall(docs, "doc_id", "text", lex).count() == 0
    assert encodings.recall(docs, "doc_id", "text", encodings.fit(docs, "doc_id", "text")).count() == 0
    assert tuple(names.recall(a, "n", "s").first()) == (0, 0, None)


def test_importing_needs_no_session():
    code = "import __spark_entry__ as e\nassert 'p5_recall' in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))).returncode == 0


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_llm_query(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    assert df.count() >= 0
    wanted = {"p1_found": "cord_uid para_idx text_row_id section_row_id", "p2_found": "uid_a uid_b", "p3_found": "tab rec_id para_idx kind", "p5_found": "name_a name_b", "p6_found": "country iso3", "p7_found": "term mark", "p9_found": "doc_id item_id", "p10_found": "doc_id"}
    if name in wanted:
        assert df.columns == wanted[name].split()


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_llm_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for table in ("paragraphs", "authors", "countries", "documents", "title_vectors", "eval_items"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    rel = con.sql(Q.SQL[name])
    df = Q.QUERIES[name](spark, data).select(*rel.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, map(tuple, rel.fetchall())))
