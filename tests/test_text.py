import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import text, words

HARD = ["", " ", " x\t", "µ-opioid ³H ﬁbre", "Å Å", "가", "½ ™", "é", "İstanbul", "n​x", "ß ÿ Ü", "αβγ Έ", "中文", "x‑y", "\U0001d54f", None]


def ask(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_nfkc_is_unicode_nfkc(spark):
    assert ask(spark, HARD, text.nfkc) == [None if v is None else unicodedata.normalize("NFKC", v) for v in HARD]


def test_plain_characters_normalise_alone():
    for k in range(0x10000):
        c = chr(k)
        if re.match(f"[{text.PLAIN}]", c):
            assert len(unicodedata.normalize("NFKC", c)) == 1 and unicodedata.category(c)[0] != "M"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=20, max_size=60))
def test_nfkc_of_any_text(spark, values):
    assert ask(spark, values, text.nfkc) == [unicodedata.normalize("NFKC", v) for v in values]


def test_strip_and_collapse(spark):
    values = ["  a  b\t\n", "", None, "　"]
    assert ask(spark, values, text.strip) == ["a  b", "", None, ""]
    assert ask(spark, values, text.clean_str) == ["a  b", None, None, None]
    assert ask(spark, values, text.title_norm) == ["a b", None, None, None]


def test_accent_key(spark):
    assert ask(spark, ["España", "Côte d'Ivoire", "São-Tomé 12", None], text.accent_key) == ["espana", "cote d ivoire", "sao tome", None]


def python_tokens(t):
    t = re.sub(r"(?s)\\documentclass.*?\\end\{document\}", " ", t)
    t = unicodedata.normalize("NFKC", t).lower().translate({ord(a): b for a, b in zip(text.FOLD_FROM, text.FOLD_TO)})
    return [w for w in re.findall(words.TOKEN, t) if len(w) >= 2 and w not in words.STOPWORDS and w not in words.ARTIFACTS]


def test_tokens_as_python_finds_them(spark):
    values = [
        "The SARS–CoV-2 virus and TNF-α were measured at 5 µg/mL in Müller's study.", "Straße ÿ-form naïve", r"before \documentclass{x} junk \end{document} after", "", "2020 95 a1 b-/c x", "Fig. 3 et al", "“quoted” l’été",
    ]
    assert ask(spark, values, words.tokens) == [python_tokens(v) for v in values]
    assert "tnf-α" in python_tokens(values[0]) and "μg/ml" in python_tokens(values[0])


def test_stopword_file():
    assert words.parse_stopwords(["# no", "", " Virus "], with_default=False) == ["virus"]
    assert "the" in words.parse_stopwords(["virus"])
    assert len(words.STOPWORDS) == 157 and len(words.ARTIFACTS) == 11 and len(words.TITLE_STOPWORDS) == 72
