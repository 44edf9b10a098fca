"""Variant spellings of organisations: merge-and-rematch entity resolution.

Work is done on distinct spellings. Each spelling is parsed into the kind of organisation (a set of institution words: those of
WORDS, which also resolves abbreviations and translations, and those that the names themselves show to be general, as they
stand with GENERIC_LEAST settlements and GENERIC_SHARE of them or more and in none of these settlements' names; single typing
errors are resolved), the place (what is left), its initials (type
initials with the first three letters of the place) and the settlement its rows name most often. Entities start as
spellings with equal kind and place. In every round the entities' merged profiles (all their places, settlements and
initials) enter blocking: by kind and place with up to two letters left out, by kind and settlement, and by initials.
An entity whose place no settlement confirms joins the nearest entity of its block that is confirmed or far better supported
(SUPPORT_RATIO times its spellings; with few spellings any established one); other entities of the same kind in different places never join each other, and
different kinds never do. Merging goes on until a round brings nothing new.

Of a block only the best entity of each place stays as a possible target, so its size doesn't matter. A spelling without a
readable place takes the settlement that nearly all of its rows name (SETTLED) as its place. Nulls and blank names are no spellings.
Repeated rows only add to counts; ties go to the better supported, then to the alphabetically first entity.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.text import accent_fold
from inkwell.session import written

#: Institution words: as typed -> canonical words (fixed values).
WORDS = {
    "university": ["university"], "univ": ["university"], "universidad": ["university"], "universite": ["university"], "universitat": ["university"], "universita": ["university"], "universidade": ["university"],
    "medical": ["medical"], "med": ["medical"], "medizinische": ["medical"], "medicine": ["medical"], "academy": ["academy"], "acad": ["academy"], "academia": ["academy"],
    "sciences": ["science"], "science": ["science"], "sci": ["science"], "school": ["school"], "sch": ["school"], "public": ["public"], "publ": ["public"], "pub": ["public"],
    "health": ["health"], "hlth": ["health"], "institute": ["institute"], "inst": ["institute"], "instituto": ["institute"], "institut": ["institute"],
    "technology": ["technology"], "technol": ["technology"], "tech": ["institute", "technology"], "national": ["national"], "natl": ["national"], "nacional": ["national"],
    "virology": ["virology"], "virol": ["virology"], "hospital": ["hospital"], "hosp": ["hospital"], "general": ["general"], "gen": ["general"],
    "childrens": ["children"], "children": ["children"], "child": ["children"], "kids": ["children"], "sph": ["school", "public", "health"],
    "college": ["college"], "coll": ["college"], "center": ["centre"], "centre": ["centre"], "ctr": ["centre"], "department": ["department"], "dept": ["department"], "faculty": ["faculty"], "laboratory": ["laboratory"], "lab": ["laboratory"],
}
STOP = {"of", "the", "de", "la", "le", "der", "des", "du", "and", "for", "fur", "di", "do", "da"}
ESTABLISHED = 3
#: How many times the spellings of an unconfirmed entity another unconfirmed one must have to be its right name.
SUPPORT_RATIO = 3
#: Least share of a spelling's rows with a settlement that must name one settlement to make it the spelling's place.
SETTLED = 0.8
#: Settlements, and share of all settlements, that a general word stands with; this bounds their number.
GENERIC_LEAST, GENERIC_SHARE = 8, 0.02
#: Spellings of an entity that are paired in one task.
PAIR_ROWS = 2_000


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c)).replace("ø", "o").replace("ß", "ss")


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance (neighbours swapped count one)."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


_near: dict[str, str | None] = {}


def institution_word(token: str) -> str | None:
    """The key of WORDS that the token is, or is a typing error of."""
    if token in WORDS:
        return token
    if token not in _near:
        if len(_near) > 200_000:
            _near.clear()
        found = None
        if len(token) >= 3:
            best = min(((distance(token, w), -len(w), w) for w in WORDS if abs(len(w) - len(token)) <= 2 and len(w) >= 3), default=None)
            if best:
                d, size = best[0], min(len(token), len(best[2]))
                if d == 1 and (size >= 5 or size >= 3 and sorted(token) == sorted(best[2]) or size == 4 and token[0] == best[2][0]) or d == 2 and size >= 7:
                    found = best[2]
        _near[token] = found
    return _near[token]


def loose_word(token: str) -> str | None:
    """The key of WORDS one typing error away from a short token that is known not to belong to the place."""
    best = min(((distance(token, w), w[0] != token[0], -len(w), w) for w in WORDS if abs(len(w) - len(token)) <= 1 and len(w) >= 3), default=None)
    return best[3] if best and best[0] <= 1 else None


def parse(name: str, settlement: str = "", generic: frozenset[str] = frozenset()) -> tuple[str, str, str, str]:
    """(kind, place, initials, acronym): kind is the sorted institution words; a bare acronym has neither kind nor place.

    ``settlement`` (folded) tells words of the place from badly typed institution words. ``generic``: further institution words.
    """
    here = settlement.split()
    text = re.sub(r"\s*\([^)]*\)\s*$", "", name)
    folded = fold(text)
    tokens = re.findall(r"[a-z0-9]+", re.sub(r"['’`]", "", folded))
    if len(tokens) == 1 and re.fullmatch(r"[A-Z]{3,10}", text.strip()) and tokens[0] not in WORDS:
        return "", "", "", text.strip()
    kind: set[str] = set()
    place: list[str] = []
    initials = ""
    for k, t in enumerate(tokens):
        if t in STOP:
            continue
        if t == "u" and k + 1 < len(tokens) and len(tokens[k + 1]) <= 3 and distance(tokens[k + 1], "of") <= 1:
            t = "univ"
        w = institution_word(t)
        if w is None and t not in here and (g := t if t in generic else next((x for x in sorted(generic) if len(t) >= 6 and abs(len(x) - len(t)) <= 1 and distance(t, x) == 1), None)):
            kind.add(g)
            initials += g[0]
            continue
        if w is None and here and not any(distance(t, x) <= max(1, len(x) // 3) for x in here):
            w = loose_word(t)
            if w is None and len(t) <= 3:
                continue  # a badly typed "of" or "the"
        elif w is None and not here and len(t) <= 4 and any(len(x) >= 7 and not institution_word(x) for x in tokens):
            # beside a long word that can only be the place
            w = loose_word(t)
            w = w if w and w[0] == t[0] and len(t) >= 3 else None
            if w is None and len(t) <= 2:
                continue
        if w:
            kind.update(WORDS[w])
            initials += "".join(x[0] for x in WORDS[w])
        else:
            if not place:
                initials += t[:3]
            place.append(t)
    if not kind and len(place) == 1 and 3 <= len(place[0]) <= 9 and place[0] not in here:
        return "", "", "", place[0].upper()
    return " ".join(sorted(kind)), " ".join(place), initials.upper(), ""


def left_out(s: str) -> list[str]:
    """``s`` and ``s`` without one letter, for longer ones also without two."""
    one = {s[:k] + s[k + 1 :] for k in range(len(s))} if len(s) >= 5 else set()
    two = {t[:k] + t[k + 1 :] for t in one for k in range(len(t))} if len(s) >= 8 else set()
    return sorted({s} | one | two)


def generic_words(spelled: DataFrame) -> list[str]:
    """Words that stand with many settlements and aren't part of their names, from (name, settle)."""
    tokens = lambda c: F.regexp_extract_all(F.lower(accent_fold(F.col(c))), F.lit("[a-z0-9]+"), F.lit(0))
    rows = spelled.where("settle IS NOT NULL").select("settle", F.explode(F.array_except(tokens("name"), tokens("settle"))).alias("w")).where(F.length("w") >= 4)
    counts = rows.groupBy("w").agg(F.count_distinct("settle").alias("n"))
    every = spelled.agg(F.count_distinct("settle")).first()[0]
    found = counts.where(F.col("n") >= max(GENERIC_LEAST, int(GENERIC_SHARE * every)))
    return sorted(r.w for r in found.collect() if institution_word(r.w) is None and r.w not in STOP)


def profiles(df: DataFrame, name: str, settlement: str | None) -> DataFrame:
    """(name, n_rows, settle, kind, place, initials, acronym, variants): one row for each distinct spelling."""
    rows = df.select(F.col(name).alias("name"), (F.col(settlement) if settlement else F.lit(None)).cast("string").alias("settle")).where(r"name IS NOT NULL AND name RLIKE '(?U)[^\\s]'")
    counted = rows.groupBy("name", "settle").agg(F.count(F.lit(1)).alias("n"))
    said = F.when(F.col("settle").isNotNull(), F.col("n"))
    spelled = counted.groupBy("name").agg(F.sum("n").alias("n_rows"), F.max_by("settle", F.when(F.col("settle").isNotNull(), F.struct("n", "settle"))).alias("settle"), (F.max(said) / F.sum(said)).alias("settled"))
    spelled = written(spelled, "spelled")
    generic = frozenset(generic_words(spelled))

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            settle = [" ".join(re.findall(r"[a-z0-9]+", fold(s))) if isinstance(s, str) else "" for s in pdf["settle"]]
            parsed = [parse(x, s, generic) for x, s in zip(pdf["name"], settle)]
            places = []
            for (kind, place, _, _), s, sure in zip(parsed, settle, pdf["settled"] >= SETTLED):
                # the place as the rows' settlement spells it, where they are close
                near = s and place and distance(place, s) <= max(1, min(4, len(s) // 3))
                places.append(s if near or kind and not place and sure else place)
            yield pd.DataFrame(
                {
                    "name": pdf["name"], "n_rows": pdf["n_rows"], "settle": settle, "kind": [p[0] for p in parsed], "place": places, "typed": [p[1] for p in parsed],
                    "initials": [p[2] for p in parsed], "acronym": [p[3] for p in parsed], "variants": [left_out(x) if x else [] for x in places],
                }
            )

    return spelled.repartition(max(1, spelled.sparkSession.sparkContext.defaultParallelism)).mapInPandas(
        run, "name string, n_rows long, settle string, kind string, place string, typed string, initials string, acronym string, variants array<string>"
    )


def linked_names(df: DataFrame, name: str, settlement: str | None = None, max_rounds: int | None = None) -> DataFrame:
    """(name, entity, n_rows): every distinct spelling with its entity, named by one of its spellings.

    Rounds go on until nothing merges, or for ``max_rounds``. They end: moves lead to confirmed or better supported entities.
    """
    known = written(profiles(df, name, settlement), "names")
    parsed = known.where("acronym = '' AND place <> '' AND kind <> ''")
    first = parsed.groupBy("kind", "place").agg(F.min("name").alias("entity"))
    members = parsed.join(first, ["kind", "place"]).select("name", "entity").unionByName(known.where("NOT (acronym = '' AND place <> '' AND kind <> '')").select("name", F.col("name").alias("entity")))
    members = written(members, "members")
    size = members.select("entity").distinct().count()
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        full = members.join(known, "name")
        state = full.groupBy("entity").agg(
            F.count(F.lit(1)).alias("support"),
            F.max(F.when((F.col("place") == F.col("settle")) & (F.col("typed") == F.col("place")) & (F.col("place") != ""), 1).otherwise(0)).alias("confirmed"),
            F.max_by("place", F.struct((F.col("place") == F.col("settle")).cast("int"), "n_rows", "name")).alias("main"),
            F.max("kind").alias("kind"),
            F.max(F.when(F.col("kind") == "", F.col("acronym")).otherwise("")).alias("acronym"),
            F.max(F.when(F.col("acronym") != "", F.col("settle"))).alias("acronym_settle"),
        ).withColumn("strong", (F.col("support") >= ESTABLISHED) | (F.col("confirmed") == 1))
        state = written(state, "state")
        moves = _moves(full, state)
        if moves is None:
            break
        renamed = members.join(moves, "entity", "left").select("name", F.coalesce("target", "entity").alias("entity"))
        members = written(renamed, "members")
        now = members.select("entity").distinct().count()
        if now == size:
            break
        size = now
    return members.join(known.select("name", "n_rows"), "name")


def _moves(full: DataFrame, state: DataFrame) -> DataFrame | None:
    """(entity, target): where unconfirmed entities go in this round; no target moves itself."""
    with_place = full.where("acronym = '' AND place <> '' AND kind <> ''")
    near_place = with_place.select("entity", F.explode("variants").alias("v"), "kind").select("entity", F.concat_ws("|", "kind", "v").alias("key"))
    settled = with_place.where("settle <> ''").select("entity", F.concat_ws("|", "kind", F.lit("in"), "settle").alias("key"))
    keys = near_place.unionByName(settled).distinct()
    keyed = keys.join(state.select("entity", "support", "confirmed", "strong", "main"), "entity")
    # entities with equal places are equally near, so the best of each place stands for all; the rest of a block is compared
    centre = keyed.where("strong").groupBy("key", F.col("main").alias("at")).agg(F.max_by(F.struct("entity", "main", "support", "confirmed", "strong"), F.struct("confirmed", "support", "entity")).alias("c"))
    better = f"c.confirmed = 1 OR c.support >= {SUPPORT_RATIO} * support OR c.strong AND NOT strong"
    weak = keyed.where("confirmed = 0").join(centre, "key").where("c.entity <> entity").where(better)
    near = weak.select("entity", F.col("c.entity").alias("target"), (-F.col("c.support")).alias("order"), F.levenshtein(F.col("main"), F.col("c.main")).alias("d"), F.length("main").alias("len")).where("d <= CASE WHEN len >= 8 THEN 3 ELSE 2 END")
    placed = near.groupBy("entity").agg(F.min_by("target", F.struct("d", "order", "target")).alias("target"))
    # acronyms: to the entity that has these initials, in the settlement the acronym's rows name if they name one
    initials = with_place.select("entity", F.col("initials").alias("acronym")).where("length(acronym) >= 3").distinct().join(state.select("entity", "support", "main", "strong"), "entity").where("strong")
    acronyms = state.where("acronym <> '' AND kind = ''").select(F.col("entity").alias("a"), "acronym", "acronym_settle")
    fits = acronyms.join(initials, "acronym").where("coalesce(acronym_settle, '') = '' OR acronym_settle = main OR levenshtein(acronym_settle, main) <= 2")
    short = fits.groupBy("a").agg(F.max_by("entity", F.struct("support", "entity")).alias("target"), F.count_distinct("main").alias("n")).where("n = 1").select(F.col("a").alias("entity"), "target")
    moves = written(placed.unionByName(short), "moves")
    if moves.isEmpty():
        return None
    # a chain of moves ends at its first established target; two that move to each other: the smaller name stays
    onward = moves.select(F.col("entity").alias("target"), F.col("target").alias("next"))
    return moves.join(onward, "target", "left").where("next IS NULL OR (next = entity AND target < entity)").select("entity", "target")


def name_pairs(links: DataFrame) -> DataFrame:
    """(name_a, name_b): every two spellings of an entity, by code point; grows with the spellings of one organisation.

    An entity with many spellings is dealt out to several tasks of PAIR_ROWS of them each, all beside all others.
    """
    sizes = links.groupBy("entity").agg(F.ceil(F.count(F.lit(1)) / PAIR_ROWS).cast("int").alias("parts"))
    members = links.select("entity", "name").join(sizes, "entity")
    a = members.select("entity", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"), F.col("name").alias("name_a"))
    b = members.select("entity", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("name").alias("name_b"))
    return a.join(b, ["entity", "part"]).where("name_a < name_b").select("name_a", "name_b")


def linked_mentions(df: DataFrame, text: str, links: DataFrame) -> DataFrame:
    """(mention, entity, name): each distinct text that names a linked organisation in one of its comma-separated parts.

    A part counts as a spelling that it equals up to case, accents and edge punctuation; of several parts the first. Texts
    that name none, null and blank ones give no row.
    """
    key = lambda c: F.regexp_replace(F.lower(accent_fold(c)), r"(?U)^[\s,;.\-]+|[\s,;.\-]+$", "")
    parts = df.where(F.col(text).isNotNull()).select(F.col(text).alias("mention")).distinct().select("mention", F.posexplode(F.split("mention", ",")).alias("at", "part"))
    known = links.select(key(F.col("name")).alias("key"), "name", "entity", "n_rows").where("key <> ''").groupBy("key").agg(F.max_by(F.struct("entity", "name"), F.struct("n_rows", "name")).alias("k"))
    found = parts.select("mention", "at", key(F.col("part")).alias("key")).join(known, "key").groupBy("mention").agg(F.min_by("k", "at").alias("k"))
    return found.select("mention", "k.entity", "k.name")


def misspelled(name: str, key: int) -> str:
    """Another spelling of a name: two letters swapped, one left out or doubled in its longest word, or capitals and full stops; by ``key``."""
    words = name.split(" ")
    at = max(range(len(words)), key=lambda k: (len(words[k]), -k))
    w, kind = words[at], key % 4
    if len(w) < 6 or kind == 3:
        return name.upper() + "."
    k = 1 + (key // 4) % (len(w) - 3)
    words[at] = w[:k] + w[k + 1] + w[k] + w[k + 2 :] if kind == 0 else w[:k] + w[k + 1 :] if kind == 1 else w[:k] + w[k] + w[k:]
    return " ".join(words)


@F.pandas_udf(T.StringType())
def _misspelled(names: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series([misspelled(n, k) for n, k in zip(names, keys)], dtype=object)


def recall(df: DataFrame, name: str, settlement: str) -> DataFrame:
    """(n_variants, n_linked, recall): a new misspelling of each spelling, without a settlement, is linked with it or not.

    Misspellings that are spellings themselves take no part.
    """
    given = df.select(F.col(name).alias("name"), F.col(settlement).alias("settle")).where("name IS NOT NULL")
    made = given.where("settle IS NOT NULL").select("name").distinct().select("name", _misspelled("name", F.pmod(F.xxhash64("name"), F.lit(1 << 20)).cast("int")).alias("variant"))
    made = written(made.join(given.select(F.col("name").alias("variant")).distinct(), "variant", "left_anti"), "variants")
    links = written(linked_names(given.unionByName(made.select(F.col("variant").alias("name"), F.lit(None).cast("string").alias("settle"))), "name", "settle").select("name", "entity"), "links")
    pairs = made.join(links, "name").join(links.select(F.col("name").alias("variant"), F.col("entity").alias("other")), "variant")
    return pairs.agg(F.count(F.lit(1)).alias("n_variants"), F.count_if(F.col("entity") == F.col("other")).alias("n_linked"), F.round(F.avg((F.col("entity") == F.col("other")).cast("int")), 4).alias("recall"))
