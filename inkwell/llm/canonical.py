"""Freely typed values -> entries of a reference list, by a character n-gram inverted index and weighted cosine.

Values are made distinct first, so the work depends on the number of spellings only. A value is cut into the parts it
may name entries in ("town, country"), each part is normalised (accents, case, dots of abbreviations, digits) and looked
up: an index from grams to entries retrieves candidates, the cosine of the grams' inverse-frequency weights scores them, and
those that reach ``threshold`` are checked letter by letter. The best one left is accepted if it leads the next entry by
``margin``. The first part with an accepted entry decides.

Grams are pairs of letters up to GAP places apart, whatever the distance, with the ends marked: a missing, doubled, wrong or
swapped letter leaves most of a name's pairs. Grams that no entry has weigh half of what the rarest weighs, as they are most
often errors. The threshold lies below the cosine of nearly all names with one such error, and the check keeps what is no name
out: equal, or one error in names of four letters or more, and one more for each LETTERS_AN_ERROR letters beyond these.

Null values are left out; blank ones and those without letters mean no entry. Equal scores of two entries mean none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import accent_fold
from inkwell.session import written

NONE = "NONE"
THRESHOLD, MARGIN = 0.3, 0.05
GAP, LETTERS_AN_ERROR = 4, 6
#: Separators between several names in one value (a pattern).
SEPARATORS = r"[,;/|()&\n\t]|\s[-–—]\s"


def normal(c: Column) -> Column:
    """Lower case, no accents, abbreviations closed up ('U. S. A.' -> 'usa'), letters and single spaces only."""
    letters = F.trim(F.regexp_replace(F.lower(accent_fold(c)), r"[^a-z. ]+", " "))
    closed = F.regexp_replace(letters, r"\b([a-z])\. ?(?=[a-z]\b)", "$1")
    closed = F.regexp_replace(closed, r"(?<=\b[a-z]) (?=[a-z]\b)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(closed, r"\.", " "), " +", " "))


def grams(c: Column) -> Column:
    """Pairs of letters up to GAP places apart, with multiplicity; the two end marks alone are no pair."""
    padded = F.concat(F.lit("^"), c, F.lit("$"))
    n = F.length(padded)
    pairs = F.flatten(
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, F.least(n, i + GAP)), lambda j: F.concat(F.substring(padded, i, F.lit(1)), F.substring(padded, j, F.lit(1)))))
    )
    return F.filter(pairs, lambda g: g != "^$")


def near(a: Column, b: Column) -> Column:
    """Equal, or so many letters missing, added or wrong as the shorter name allows, or two neighbours swapped."""
    short = F.least(F.length(a), F.length(b))
    swapped = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    allowed = F.greatest(F.lit(1), F.floor(short / LETTERS_AN_ERROR))
    return (a == b) | ((short >= 3) & (F.greatest(F.length(a), F.length(b)) >= 4) & ((F.levenshtein(a, b) <= allowed) | swapped))


def _weights(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.select(*keys, F.explode(grams(F.col("part"))).alias("gram")).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("tf"))


def canonical(values: DataFrame, value: str, entries: DataFrame, key: str, name: str, others: str | None = None, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(value, key, score, part, n_rows): one row for each distinct value; key is NONE if it names no entry.

    ``others``: column of ``entries`` with an array of further names.
    """
    names = entries.select(F.col(key).alias("k"), F.explode(F.concat(F.array(name), F.coalesce(F.col(others), F.array().cast("array<string>"))) if others else F.array(name)).alias("n"))
    names = written(names.select("k", normal(F.col("n")).alias("part")).where("part <> ''").distinct(), "names")
    entry_grams = _weights(names, ["k", "part"])
    n_names = names.count()
    idf = entry_grams.groupBy("gram").agg(F.log(F.lit(n_names + 1.0) / F.count(F.lit(1))).alias("idf"))
    unseen = F.log(F.lit(n_names + 1.0)) / 2
    index = entry_grams.join(idf, "gram").select("gram", "k", F.col("part").alias("entry"), "idf", (F.col("tf") * F.col("idf")).alias("w"))
    length = index.groupBy("k", "entry").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("entry_length"))
    index = written(index.join(length, ["k", "entry"]).select("gram", "k", "entry", "idf", (F.col("w") / F.col("entry_length")).alias("we")), "index")

    distinct = written(values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n_rows")), "values")
    parts = distinct.select("value", F.posexplode(F.split("value", SEPARATORS)).alias("pos", "part")).select("value", "pos", normal(F.col("part")).alias("part")).where("part <> ''")
    parts = written(parts, "parts")
    typed = _weights(parts.select("part").distinct(), ["part"]).join(index.select("gram", "idf").distinct(), "gram", "left").select("part", "gram", (F.col("tf") * F.coalesce("idf", unseen)).alias("w"))
    typed = written(typed, "typed")
    typed_length = typed.groupBy("part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    scored = typed.join(index, "gram").groupBy("part", "k", "entry").agg(F.sum(F.col("w") * F.col("we")).alias("dot")).join(typed_length, "part")
    scored = scored.withColumn("score", F.col("dot") / F.col("length")).where((F.col("score") >= threshold) & near(F.col("part"), F.col("entry")))
    scored = written(scored.groupBy("part", "k").agg(F.max("score").alias("score")), "scored")
    # best and next best entry of each part: two aggregates, no list of candidates is kept
    best = scored.groupBy("part").agg(F.max_by("k", F.struct("score", "k")).alias("k"), F.max("score").alias("score"))
    rest = scored.join(best.select("part", F.col("k").alias("bk")), "part").where("k <> bk").groupBy("part").agg(F.max("score").alias("second"))
    accepted = best.join(rest, "part", "left").where(F.col("score") - F.coalesce("second", F.lit(0.0)) >= margin)
    first = parts.join(accepted, "part").groupBy("value").agg(F.min_by(F.struct("k", "score", "part"), "pos").alias("f"))
    return distinct.join(first, "value", "left").select(
        "value", F.coalesce("f.k", F.lit(NONE)).alias(key), F.col("f.score").alias("score"), F.col("f.part").alias("part"), "n_rows"
    )
