"""One surviving record for each group of duplicates, by a latent two-sided quality model of the sources.

Every distinct value of a field within a group is a fact that is either true or not. A source that has the field filled
in for the group asserts the facts it gives and denies the group's others. Expectation-maximisation over all facts finds
each source's sensitivity (how often it asserts a true fact) and specificity (how often it keeps silent about a false
one) and from them each fact's probability. A field may keep several values: all that are judged true.

``survivors`` builds the surviving record from these probabilities: of a field with one value the most probable one, of a
field that may have several all that are judged true. ``best_records`` is the other way to choose, for tables whose owner
has fixed the order of the sources: a plain rule in which nothing is learned.

The sources are those that the data name; the MAX_SOURCES - 1 with most rows have a class each, the others share one.

The facts are reduced to patterns (asserting sources, sources that could have asserted) with a count, so an iteration
reads a table whose size depends on the number of sources only. Up to PATTERN_LIMIT patterns it runs on the driver,
beyond that as Spark jobs over the written pattern table. It starts from the vote of the sources, and a source is held to
be no worse than chance about false values (specificity of LEAST_SPECIFICITY at least): without both, a bad source that
often stands alone can be taken for the only true one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.session import written

PATTERN_LIMIT = 50_000
BLANK = r"(?U)^\s*$"
#: Beta priors: sensitivity, specificity and truth, as pseudo-counts (yes, no).
PRIOR_SENSITIVITY, PRIOR_SPECIFICITY, PRIOR_TRUE = (8.0, 2.0), (18.0, 2.0), (6.0, 4.0)
LEAST_SPECIFICITY = 0.5
MAX_SOURCES = 62


def filled(c: Column) -> Column:
    return F.coalesce(~c.rlike(BLANK), F.lit(False))


def same_value(c: Column, ignore: str | None = None) -> Column:
    """Values that differ only in case, white space, hyphenation and punctuation count as one; so do those without letters and digits that are equal.

    ``ignore``: a pattern of marks that are no part of the value.
    """
    kept = F.regexp_replace(F.lower(c), ignore, "") if ignore else F.lower(c)
    bare = F.regexp_replace(kept, r"[^\p{L}\p{N}]+", "")
    return F.xxhash64(F.when(bare != "", bare).otherwise(F.regexp_replace(F.lower(c), r"(?U)\s+", "")))


def tidy_source(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


@dataclass
class SourceQuality:
    """What EM found: by field, the sources' sensitivity and specificity and the share of true facts."""

    sources: list[str]
    sensitivity: dict[str, list[float]] = dc_field(default_factory=dict)
    specificity: dict[str, list[float]] = dc_field(default_factory=dict)
    true_share: dict[str, float] = dc_field(default_factory=dict)
    iterations: int = 0

    def trust(self, name: str) -> list[float]:
        """Youden's index of each source for a field."""
        return [a + b - 1 for a, b in zip(self.sensitivity[name], self.specificity[name])]

    def log_odds(self, name: str, asserted: Column, able: Column) -> Column:
        """Log odds that a fact is true, from the bit masks of asserting and able sources."""
        share = self.true_share[name]
        out = F.lit(math.log(share / (1 - share)))
        for k, (sens, spec) in enumerate(zip(self.sensitivity[name], self.specificity[name])):
            bit = F.lit(1 << k).cast("long")
            yes, no = math.log(sens / (1 - spec)), math.log((1 - sens) / spec)
            out = out + F.when(asserted.bitwiseAND(bit) != 0, F.lit(yes)).when(able.bitwiseAND(bit) != 0, F.lit(no)).otherwise(F.lit(0.0))
        return out


def _start(sources: list[str], fields: list[str]) -> SourceQuality:
    mean = lambda p: p[0] / (p[0] + p[1])
    n = len(sources)
    return SourceQuality(sources, {f: [mean(PRIOR_SENSITIVITY)] * n for f in fields}, {f: [mean(PRIOR_SPECIFICITY)] * n for f in fields}, {f: mean(PRIOR_TRUE) for f in fields})


def _update(q: SourceQuality, name: str, sums: dict[str, float], per: list[tuple[float, float, float, float]]) -> float:
    """M step. per: for each source (true asserted, true able, false silent, false able). Returns the largest change."""
    change, old = 0.0, (q.sensitivity[name], q.specificity[name])
    q.sensitivity[name] = [(PRIOR_SENSITIVITY[0] + ta) / (sum(PRIOR_SENSITIVITY) + t) for ta, t, _, _ in per]
    q.specificity[name] = [max(LEAST_SPECIFICITY, (PRIOR_SPECIFICITY[0] + fs) / (sum(PRIOR_SPECIFICITY) + f)) for _, _, fs, f in per]
    q.true_share[name] = (PRIOR_TRUE[0] + sums["true"]) / (sum(PRIOR_TRUE) + sums["all"])
    for a, b in zip(old, (q.sensitivity[name], q.specificity[name])):
        change = max([change, *(abs(x - y) for x, y in zip(a, b))])
    return change


def _fit_local(rows: list, q: SourceQuality, fields: list[str], iterations: int, tolerance: float) -> SourceQuality:
    import numpy as np

    bits = np.arange(len(q.sources))
    data = {}
    for f in fields:
        own = [r for r in rows if r["field"] == f]
        a, b = (np.array([r[c] for r in own], dtype=np.int64) for c in ("asserted", "able"))
        data[f] = ((a[:, None] >> bits) & 1, (b[:, None] >> bits) & 1, np.array([r["n"] for r in own], dtype=float)) if own else None
    for q.iterations in range(1, iterations + 1):
        change = 0.0
        for f in fields:
            if data[f] is None:
                continue
            a, b, n = data[f]
            sens, spec, share = np.array(q.sensitivity[f]), np.array(q.specificity[f]), q.true_share[f]
            odds = math.log(share / (1 - share)) + (a * np.log(sens / (1 - spec)) + (b - a) * np.log((1 - sens) / spec)).sum(1)
            p = 1 / (1 + np.exp(-odds)) if q.iterations > 1 else (a.sum(1) + 1) / (b.sum(1) + 2)
            t, u = (n * p)[:, None], (n * (1 - p))[:, None]
            per = list(zip((t * a).sum(0), (t * b).sum(0), (u * (b - a)).sum(0), (u * b).sum(0)))
            change = max(change, _update(q, f, {"true": float((n * p).sum()), "all": float(n.sum())}, per))
        if change < tolerance:
            break
    return q


def _fit_spark(patterns: DataFrame, q: SourceQuality, fields: list[str], iterations: int, tolerance: float) -> SourceQuality:
    for q.iterations in range(1, iterations + 1):
        change = 0.0
        for f in fields:
            p = 1 / (1 + F.exp(-q.log_odds(f, F.col("asserted"), F.col("able")))) if q.iterations > 1 else (F.bit_count("asserted") + 1) / (F.bit_count("able") + 2)
            scored = patterns.where(F.col("field") == f).select("*", (F.col("n") * p).alias("t"), (F.col("n") * (1 - p)).alias("u"))
            aggs = [F.sum("t").alias("true"), F.sum("n").alias("all")]
            for k in range(len(q.sources)):
                bit = F.lit(1 << k).cast("long")
                yes, able = F.col("asserted").bitwiseAND(bit) != 0, F.col("able").bitwiseAND(bit) != 0
                aggs += [F.sum(F.when(yes, F.col("t")).otherwise(0.0)), F.sum(F.when(able, F.col("t")).otherwise(0.0)), F.sum(F.when(able & ~yes, F.col("u")).otherwise(0.0)), F.sum(F.when(able, F.col("u")).otherwise(0.0))]
            row = scored.agg(*aggs).first()
            if row["all"]:
                values = list(row)[2:]
                change = max(change, _update(q, f, {"true": row["true"], "all": float(row["all"])}, [tuple(values[4 * k : 4 * k + 4]) for k in range(len(q.sources))]))
        if change < tolerance:
            break
    return q


def source_class(source: Column, sources: list[str]) -> Column:
    """Position of the tidied source among ``sources``; anything else, null too, is the class after the last."""
    out = F.lit(len(sources))
    for k in reversed(range(len(sources))):
        out = F.when(source == sources[k], F.lit(k)).otherwise(out)
    return out


def sources_of(df: DataFrame, source: str) -> list[str]:
    """The tidied sources that the data name, most rows first; at most MAX_SOURCES - 1."""
    named = df.select(tidy_source(F.col(source)).alias("s")).where("s <> ''").groupBy("s").count()
    return [r.s for r in named.orderBy(F.desc("count"), "s").limit(MAX_SOURCES - 1).collect()]


def _named(keys: list[str], taken: tuple[str, ...]) -> list[Column]:
    """The numbered key columns under the keys' own names; a name that is taken gets the suffix ``_``."""
    return [F.col(f"_{n}").alias(f"{k}_" if k in taken else k) for n, k in enumerate(keys)]


def facts(df: DataFrame, keys: list[str], fields: list[str], source: str, sources: list[str], updated: str | None = None, ignore: str | None = None, trust: dict[str, list[float]] | None = None) -> DataFrame:
    """(_0, _1 ... for the keys, field, fact, asserted, able): each distinct value in a group with the sources that give it and could have.

    ``trust`` (by field and source) adds ``value``, the spelling of the most trusted source that gives it (of several the longest,
    then the alphabetically first), and ``last``, when it was given last. Two aggregations with partial sums; a hot group is reduced before the shuffle and never collected.
    """
    cls = source_class(tidy_source(F.col(source)), sources)
    bit = F.element_at(F.array(*[F.lit(1 << k).cast("long") for k in range(len(sources) + 1)]), cls + 1)
    said = [F.struct(F.lit(f).alias("field"), F.when(filled(F.col(f)), same_value(F.col(f), ignore)).alias("fact"), *([F.col(f).cast("string").alias("value"), F.element_at(F.array(*[F.lit(round(-t, 6)) for t in trust[f]]), cls + 1).alias("rank")] if trust else [])) for f in fields]
    claims = df.select(*[F.col(k).alias(f"_{n}") for n, k in enumerate(keys)], bit.alias("b"), (F.col(updated).cast("timestamp") if updated else F.lit(None).cast("timestamp")).alias("t"), F.explode(F.array(*said)).alias("c")).where("c.fact IS NOT NULL")
    group = [f"_{n}" for n in range(len(keys))]
    more = [F.min_by("c.value", F.struct(F.col("c.rank"), -F.length("c.value"), F.col("c.value"))).alias("value"), F.max("t").alias("last")] if trust else []
    given = claims.groupBy(*group, F.col("c.field").alias("field"), F.col("c.fact").alias("fact")).agg(F.bit_or("b").alias("asserted"), *more)
    same = [*group, "field"]
    plain = claims.groupBy(*group, F.col("c.field").alias("field")).agg(F.bit_or("b").alias("able")) if trust else given.groupBy(*same).agg(F.bit_or("asserted").alias("able"))
    able = plain.select(*[F.col(k).alias(f"{k}_") for k in same], "able")
    cond = F.lit(True)
    for k in same:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return given.join(able, cond).select(*group, "field", "fact", "asserted", "able", *(["value", "last"] if trust else []))


def fit_sources(df: DataFrame, keys: list[str], fields: list[str], source: str, sources: list[str] | None = None, iterations: int = 30, tolerance: float = 1e-4, ignore: str | None = None) -> SourceQuality:
    """Sensitivity and specificity of the sources (default: those the data name) and of the class of all others, over all groups.

    At most MAX_SOURCES - 1 sources can be declared. Empty input leaves the priors.
    """
    sources = sources_of(df, source) if sources is None else sources
    if len(sources) + 1 > MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES - 1} sources")
    patterns = written(facts(df, keys, fields, source, sources, ignore=ignore).groupBy("field", "asserted", "able").agg(F.count(F.lit(1)).alias("n")), "patterns")
    q = _start([*sources, "other"], fields)
    if patterns.count() <= PATTERN_LIMIT:
        return _fit_local(patterns.collect(), q, fields, iterations, tolerance)
    return _fit_spark(patterns, q, fields, iterations, tolerance)


def patterns(df: DataFrame, keys: list[str], fields: list[str], source: str, sources: list[str] | None = None, ignore: str | None = None) -> DataFrame:
    """(field, asserted, able, n): what EM reads, with the sources' names, comma-separated in alphabetical order."""
    sources = sources_of(df, source) if sources is None else sources
    names = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(1 << k).cast("long").alias("b")) for k, s in enumerate([*sources, "other"])])
    said = lambda mask: F.array_join(F.array_sort(F.transform(F.filter(names, lambda x: x["b"].bitwiseAND(F.col(mask)) != 0), lambda x: x["s"])), ",")
    counted = facts(df, keys, fields, source, sources, ignore=ignore).groupBy("field", "asserted", "able").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("field", said("asserted").alias("asserted"), said("able").alias("able"), "n")


def _judged(df: DataFrame, keys: list[str], fields: list[str], source: str, q: SourceQuality, updated: str | None, ignore: str | None) -> DataFrame:
    odds = F.lit(0.0)
    for f in fields:
        odds = F.when(F.col("field") == f, q.log_odds(f, F.col("asserted"), F.col("able"))).otherwise(odds)
    return facts(df, keys, fields, source, q.sources[:-1], updated, ignore, {f: q.trust(f) for f in fields}).withColumn("odds", odds)


def judged_values(df: DataFrame, keys: list[str], fields: list[str], source: str, q: SourceQuality | None = None, ignore: str | None = None) -> DataFrame:
    """(keys, field, value, probability, judged_true): every value of every group; several may be judged true.

    A key that has the name of one of these columns gets the suffix ``_``.
    """
    q = q or fit_sources(df, keys, fields, source, ignore=ignore)
    p = 1 / (1 + F.exp(-F.col("odds")))
    return _judged(df, keys, fields, source, q, None, ignore).select(*_named(keys, ("field", "value", "probability", "judged_true")), "field", "value", F.round(p, 6).alias("probability"), (p > 0.5).alias("judged_true"))


def survivors(
    df: DataFrame, keys: list[str], fields: list[str], source: str, updated: str | None = None, several: tuple[str, ...] = (), q: SourceQuality | None = None, ignore: str | None = None
) -> DataFrame:
    """One record per group: (keys, n_rows, and each field), built from the facts' probabilities under the quality model.

    A field of ``several`` keeps all values judged true as an array, most probable first (if none is, the most probable
    one); any other the most probable value. Equal odds go to the value given last, then to the alphabetically last one. Blank
    and null values are no facts; a field without any is null (an empty array). Null keys are a group, repeated rows are rows.
    """
    q = q or fit_sources(df, keys, fields, source, ignore=ignore)
    group = [f"_{n}" for n in range(len(keys))]
    named = [F.col(k).alias(g) for g, k in zip(group, keys)]
    judged = _judged(df, keys, fields, source, q, updated, ignore).select(*group, "field", "value", F.round("odds", 9).alias("odds"), "last", F.lit(None).cast("long").alias("n"))
    rows = df.groupBy(*named).agg(F.count(F.lit(1)).alias("n")).select(*group, F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("odds"), F.lit(None).cast("timestamp").alias("last"), "n")
    aggs = [F.max("n").alias("_n")]
    for k, f in enumerate(fields):
        own = F.col("field") == f
        aggs.append(F.max_by("value", F.when(own, F.struct("odds", F.col("last").isNotNull(), "last", "value"))).alias(f"_f{k}"))
        if f in several:
            aggs.append(F.array_sort(F.collect_list(F.when(own & (F.col("odds") > 0), F.struct((-F.col("odds")).alias("o"), F.col("value").alias("v"))))).alias(f"_s{k}"))
    out = judged.unionByName(rows).groupBy(*group).agg(*aggs)
    kept = []
    for k, f in enumerate(fields):
        best = F.col(f"_f{k}")
        if f in several:
            best = F.when(F.size(f"_s{k}") > 0, F.transform(f"_s{k}", lambda x: x["v"])).when(best.isNotNull(), F.array(best)).otherwise(F.array().cast("array<string>"))
        kept.append(best.alias(f))
    return out.select(*_named(keys, ("n_rows",)), F.col("_n").alias("n_rows"), *kept)


def best_records(df: DataFrame, keys: list[str], row_id: str, main: str, others: list[str], source: str, sources: list[str], updated: str, least_rows: int = 2, with_values: bool = True) -> DataFrame:
    """One row per group of ``least_rows`` rows or more: (keys, n_rows, main, <main>_row_id, and for each other field its value and row).

    Without ``with_values`` only the rows' ids are given, and no text is shuffled.

    The order within a group: main field not blank first; ``sources`` in their declared order, then any other; later
    ``updated`` first, null last; smaller ``row_id`` first. ``main`` comes from the first row, another field from the first
    row where it isn't blank (row -1 and null if there is none). Null keys form a group of their own, as in GROUP BY;
    repeated rows are rows.
    """
    order = F.struct(
        (~filled(F.col(main))).alias("blank"), source_class(tidy_source(F.col(source)), sources).alias("rank"), F.col(updated).isNull().alias("no_time"), (-F.unix_micros(F.col(updated).cast("timestamp"))).alias("age"), F.col(row_id).alias("row")
    )
    kept = lambda name: F.struct(F.col(row_id).alias("row"), *([F.col(name).alias("value")] if with_values else []))
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min_by(kept(main), order).alias("_main")]
    for o in others:
        aggs.append(F.min_by(kept(o), F.when(filled(F.col(o)), order)).alias(f"_o_{o}"))
    group = [f"_{n}" for n in range(len(keys))]
    out = df.groupBy(*[F.col(k).alias(g) for g, k in zip(group, keys)]).agg(*aggs).where(F.col("n_rows") >= least_rows)
    return out.select(
        *[F.col(g).alias(k) for g, k in zip(group, keys)],
        "n_rows",
        *([F.col("_main.value").alias(main)] if with_values else []),
        F.col("_main.row").alias(f"{main}_row_id"),
        *[c for o in others for c in (*([F.col(f"_o_{o}.value").alias(o)] if with_values else []), F.coalesce(F.col(f"_o_{o}.row"), F.lit(-1).cast("long")).alias(f"{o}_row_id"))],
    )
