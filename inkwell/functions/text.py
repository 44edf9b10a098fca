"""Text functions: JVM expressions throughout; only Unicode normalisation goes to Python, and only for non-ASCII values."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NON_ASCII = r"[^\x00-\x7F]"


#: Ranges of frequent characters that NFKC leaves alone or turns into one other character (checked by a test).
PLAIN = "\x00-\x7f\xa0-\xa7\xa9-\xae\xb0-\xb3\xb5-\xb7\xb9-\xbb\xbf-\xffΑ-ΡΣ-Ωα-ωА-яёЁ‐-―‘-‟†-•€−≈≤≥"


@lru_cache
def _singles() -> tuple[str, str]:
    """Characters of PLAIN that NFKC turns into one other, and those."""
    ranges = [(PLAIN[k], PLAIN[k + 2]) if PLAIN[k + 1 : k + 2] == "-" and PLAIN[k] != "-" else (PLAIN[k], PLAIN[k]) for k in range(len(PLAIN)) if PLAIN[k] != "-" and PLAIN[k - 1 : k] != "-"]
    all_plain = [chr(x) for a, b in ranges for x in range(ord(a), ord(b) + 1)]
    changed = {c: n for c in all_plain if (n := unicodedata.normalize("NFKC", c)) != c}
    return "".join(changed), "".join(changed.values())


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def beyond_ascii(c: Column) -> Column:
    """The non-ASCII characters of a value: what slower tests are then made on."""
    return F.regexp_replace(c, r"[\x00-\x7f]+", "")


def _translate(c: Column, single: str, to: str) -> Column:
    """translate() for non-ASCII characters, left out for values that have none of them."""
    return F.when(beyond_ascii(c).rlike(f"[{single}]"), F.translate(c, single, to)).otherwise(c)


def nfkc(c: Column) -> Column:
    """NFKC form. Only values with characters beyond PLAIN, which may need the full algorithm, leave the JVM."""
    needs = beyond_ascii(c).rlike(f"[^{PLAIN}]")
    return F.when(needs, _nfkc(F.when(needs, c))).otherwise(_translate(c, *_singles()))


def accent_fold(c: Column) -> Column:
    """Without combining marks (NFKD)."""
    return F.when(c.rlike(NON_ASCII), _fold(F.when(c.rlike(NON_ASCII), c))).otherwise(c)


def strip(c: Column) -> Column:
    """Without white space of any Unicode kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def clean_str(c: Column) -> Column:
    """Stripped; empty becomes null."""
    return F.nullif(strip(c), F.lit(""))


def title_norm(c: Column) -> Column:
    return F.nullif(collapse(F.lower(strip(c))), F.lit(""))


def accent_key(c: Column) -> Column:
    """Key for matching typed names: no accents, lower case, letters and single spaces only."""
    return F.trim(F.regexp_replace(F.lower(accent_fold(c)), "[^a-z ]+", " "))


#: Characters folded to plain ones (fixed values): hyphens, single quotes, double quotes.
FOLD_FROM = "‐‑‒–—―−‘’‚‛“”„"
FOLD_TO = "-------''''\"\"\""


def fold_punctuation(c: Column) -> Column:
    return _translate(c, FOLD_FROM, FOLD_TO)


def without_latex(c: Column) -> Column:
    cut = F.regexp_replace(c, r"(?s)\\documentclass.*?\\end\{document\}", " ")
    return F.when(c.contains("\\documentclass"), cut).otherwise(c)


def sanitize(c: Column, unicode_form: bool = True) -> Column:
    """LaTeX blocks out, NFKC, lower case, punctuation folded; the order matters."""
    out = without_latex(c)
    return fold_punctuation(F.lower(nfkc(out) if unicode_form else out))


def sanitized(df: DataFrame, text: str, name: str, *keep: str) -> DataFrame:
    """``keep`` and the sanitized text as ``name``. Each step is a projection of its own, so none is worked out several times."""
    out = df.select(*keep, without_latex(F.col(text)).alias(name))
    for step in (nfkc, F.lower, fold_punctuation):
        out = out.select(*keep, step(F.col(name)).alias(name))
    return out
