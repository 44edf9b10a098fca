"""Text of scanned pages: find and repair broken words, misread letters, running headers and page numbers, then reflow.

The vocabulary is taken from the corpus itself: every word and hyphenated compound, and every pair of neighbouring words,
is counted over all texts, and those that make up at least VOCABULARY_SHARE of the paragraphs' number are kept, so the list
that travels to the workers is bounded by (words per paragraph / share) entries, whatever the corpus is.

A word that isn't ordinary is looked up by intersecting a weighted Levenshtein automaton with a trie of the vocabulary: an
inserted, missing or wrong letter costs EDIT, a confusion of scanning (READ_AS) only CONFUSION, and the budget grows with
the word's length, so retrieval is complete for up to two confusions, for one free edit from EDIT_LETTERS letters on and for
one of each from LONG_LETTERS letters on. Candidates must be far more frequent than the word itself; they are ranked by cost, by
whether they are usual beside the neighbouring words, by whether they occur elsewhere in the paragraph, and by frequency.
A free edit is taken only in words without capitals, which may be names, and only where a neighbour confirms it (both
neighbours, if a letter is another one or only the word's ending differs: those are most often other words or inflection).
Torn words are joined likewise.

Running headers are learned: a line's template keeps frequent words, marks and the places of other words and numbers. A
template that is filled in in many ways by short lines in the middle of paragraphs is page furniture, as no sentence is
broken off there in the same form again and again. Copies of a line count once.

Lines that are page furniture are removed before words broken at line ends are joined; a hyphen that belongs to the
wording (the compound is more usual than the joined word) stays. At last the lines are joined to one paragraph.

Null and empty texts have no damage and stay. Ties are broken by the alphabet. Repeated rows are treated one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.session import received, send

VOCABULARY_SHARE, LEAST_COUNT = 2e-4, 6
#: How many times more frequent the true word must be than what was read.
FREQUENCY_RATIO = 12
#: What is read -> what stands on the page (fixed values).
READ_AS = {
    "1": ["l", "i"], "|": ["l", "i"], "!": ["l", "i"], "l": ["i"], "i": ["l"], "í": ["i"], "ì": ["i"], "ï": ["i"], "0": ["o"], "ó": ["o"],
    "5": ["s"], "$": ["s"], "6": ["b"], "9": ["g"], "q": ["g"], "@": ["a"], "á": ["a"], "à": ["a"], "4": ["a"], "8": ["b"], "3": ["e"], "é": ["e"], "€": ["e"],
    "c": ["e"], "e": ["c"], "b": ["h"], "h": ["b"], "rn": ["m"], "m": ["rn"], "cl": ["d"], "d": ["cl"], "ii": ["u"], "vv": ["w"], "nn": ["m"], "li": ["h"], "tl": ["d"], "ü": ["u", "ii"],
    "ﬁ": ["fi"], "ﬂ": ["fl"], "ﬀ": ["ff"], "ﬃ": ["ffi"], "ﬄ": ["ffl"], "7": ["t"], "f": ["t"], "ri": ["n"], "2": ["z"],
}
CONFUSION, EDIT = 0.45, 1.0
#: Budgets: two confusions; one free edit; a free edit and a confusion; and the letters from which on the last two hold.
BUDGET, EDIT_BUDGET, LONG_BUDGET = 0.9, 1.0, 1.45
EDIT_LETTERS, LONG_LETTERS = 6, 9
#: A template needs this share of the paragraphs' number in different lines; its words are so many times the least count.
TEMPLATE_SHARE, LEAST_LINES, TEMPLATE_WORD = 5e-4, 3, 8
#: A line shorter than this share of the widest line of its paragraph is short.
SHORT = 0.8
BREAKS = "-‐\xad¬"
LINES = re.compile(r"\r\n|[\n\r\x0c]")
WORD = re.compile(r"[^\W\d_]+(?:[-‐][^\W\d_]+)*")
#: Runs that may be one misread word: letters, digits and look-alike signs.
RUN = re.compile(r"[@$|€]?[^\W_]+(?:[-‐@$|!€]+[^\W_]+|[@$|€](?=[\s.,;:)]|$))*")
SPACED = re.compile(r"(?<!\S)[^\W_@](?: [^\W_]| @){3,}(?![^\s.,;:)])")
#: After these a hyphen at the line end hangs, as in "pre- and post-exposure".
HANGING = re.compile(r"(?:and|or|to|und|oder|et|ou|y|o|e)\b")
PAGE = re.compile(r"\s*(?:[-–—]\s*\d{1,4}\s*[-–—]|(?:page|seite|página)\s+\d{1,4}(?:\s+(?:of|von|de)\s+\d{1,4})?|pp?\.\s*\d{1,4}|\d{1,4})\s*", re.I)
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}++(?:[-‐]\p{L}++)*+"), F.lit(0))


def vocabulary(texts: DataFrame, text: str) -> tuple[list[tuple[str, int]], int, list[int]]:
    """(ordinary words and compounds of the corpus with their counts, least count of an ordinary word, hashes of usual pairs).

    The bound on their number is in the module's text. Words and pairs are counted in one pass, with partial sums; a pair is
    a 64-bit hash, as it is only ever looked up.
    """
    n = texts.count()
    least = max(LEAST_COUNT, int(VOCABULARY_SHARE * n))
    w = F.col("w")
    beside = F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("b"))
    found = texts.where(F.length(text) > 0).select(words_of(F.col(text)).alias("w")).select(F.inline(beside).alias("a", "b"))
    one = F.struct(F.col("a").alias("w"), F.lit(None).cast("long").alias("h"))
    two = F.struct(F.lit(None).cast("string").alias("w"), F.when(F.col("b").isNotNull(), F.xxhash64("a", "b")).alias("h"))
    counted = found.select(F.inline(F.array(one, two))).where("w IS NOT NULL OR h IS NOT NULL").groupBy("w", "h").count().where(F.col("count") >= least)
    rows = counted.collect()
    return sorted((r.w.replace("‐", "-"), int(r["count"])) for r in rows if r.w is not None), least, sorted(r.h for r in rows if r.w is None)


def pair_hash(a: str, b: str) -> int:
    """Spark's xxhash64 of two strings."""
    import xxhash

    h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def template(line: str, frequent: set[str] | frozenset[str]) -> str:
    """The line's form: frequent words and marks as they are, ``N`` for runs of other words, ``#`` for numbers."""
    out: list[str] = []
    for t in TOKEN.findall(line.lower()):
        x = "#" if t[0].isdigit() else t if not t[0].isalpha() or t in frequent else "N"
        if not out or x != out[-1] or x not in "N#":
            out.append(x)
    return " ".join(out)


def _is_form(form: str) -> bool:
    """Whether a template has words, open places, and doesn't end in a broken word."""
    parts = form.split(" ")
    return len(parts) > 2 and ("N" in parts or "#" in parts) and any(p[0].isalpha() for p in parts) and parts[-1] not in BREAKS


def header_templates(texts: DataFrame, text: str, lexicon: Lexicon) -> list[str]:
    """Templates of running headers, learned from the short lines within paragraphs of all texts.

    Their number is bounded by (short lines per paragraph / TEMPLATE_SHARE).
    """
    sent = send(texts.sparkSession, lexicon.frequent)

    def forms(batches: Iterator) -> Iterator:
        import pyarrow as pa

        frequent = received(sent)
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                lines = [x.strip() for x in LINES.split(t) if x.strip()]
                wide = max(map(len, lines), default=0)
                out += [(f, x) for x in lines[:-1] if len(x) < SHORT * wide and not PAGE.fullmatch(x) and _is_form(f := template(x, frequent))]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["form", "line"])

    broken = texts.where(F.col(text).rlike(LINES.pattern)).select(text)
    found = broken.mapInArrow(forms, "form string, line string").groupBy("form", F.xxhash64("line").alias("h")).agg(F.lit(1)).groupBy("form").count()
    least = max(LEAST_LINES, int(TEMPLATE_SHARE * lexicon.texts))
    return sorted(r.form for r in found.where(F.col("count") >= least).collect())


class Lexicon:
    """Trie of the ordinary words; finds what a misread word may have been."""

    def __init__(self, counted: list[tuple[str, int]], least: int = LEAST_COUNT, pairs: list[int] | tuple = (), headers: list[str] | tuple = ()):
        self.count: dict[str, int] = {}
        for w, n in counted:
            self.count[w] = self.count.get(w, 0) + n
        self.least, self.pairs, self.headers = least, frozenset(pairs), frozenset(headers)
        self.texts = least / VOCABULARY_SHARE if least > LEAST_COUNT else 0
        self.frequent = frozenset(w for w, n in self.count.items() if n >= TEMPLATE_WORD * least)
        self._grow()
        #: ordinary words that aren't a frequent misreading of a far more usual word
        self.good = {w for w in self.count if len(w) < 4 or not self._dominated(w)}
        #: ordinary words that begin or end a far more usual word, as pieces of torn words do
        self.fragile = {x for v, n in self.count.items() for k in range(2, len(v) - 1) for x in (v[:k], v[k:]) if n >= FREQUENCY_RATIO * self.count.get(x, n)}
        self.usual = self.good - self.fragile

    def _grow(self) -> None:
        self.trie: dict = {}
        for w in self.count:
            if len(w) >= 3:
                node = self.trie
                for c in w:
                    node = node.setdefault(c, {})
                node[""] = w
        self.cache: dict[tuple[str, bool], list[tuple[float, str]]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("trie", "cache")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._grow()

    def _dominated(self, w: str) -> bool:
        return any(v != w and self.count[v] >= FREQUENCY_RATIO * self.count[w] for _, v in self.search(w))

    def search(self, w: str, budget: float = BUDGET) -> list[tuple[float, str]]:
        """All (cost, word) of the vocabulary within the budget, by walking trie and automaton together."""
        best: dict[str, float] = {}
        size = len(w)
        stack = [(self.trie, 0, 0.0)]
        while stack:
            node, i, cost = stack.pop()
            while True:  # along the path on which letters agree; its branches go onto the stack
                if i == size and "" in node and cost < best.get(node[""], 9.0):
                    best[node[""]] = cost
                if i < size and cost + CONFUSION <= budget:
                    for read in (w[i], w[i : i + 2]):
                        for true in READ_AS.get(read, ()) if i + len(read) <= size else ():
                            n = node
                            for c in true:
                                n = n.get(c)
                                if n is None:
                                    break
                            else:
                                stack.append((n, i + len(read), cost + CONFUSION))
                if cost + EDIT <= budget:
                    spent = cost + EDIT
                    for c, n in node.items():
                        if not c:
                            continue
                        if i < size and self._goes_on(n, w, i + 1, spent, budget):
                            stack.append((n, i + 1, spent))
                        if self._goes_on(n, w, i, spent, budget):
                            stack.append((n, i, spent))
                    if i < size and self._goes_on(node, w, i + 1, spent, budget):
                        stack.append((node, i + 1, spent))
                node = node.get(w[i]) if i < size else None
                if node is None:
                    break
                i += 1
        return sorted((c, v) for v, c in best.items())

    @staticmethod
    def _goes_on(node: dict, w: str, i: int, cost: float, budget: float) -> bool:
        """Whether the state has any way on: the next letter agrees, or a further step is within the budget."""
        if (w[i] in node) if i < len(w) else ("" in node):
            return True
        return cost + EDIT <= budget or cost + CONFUSION <= budget and (w[i : i + 1] in READ_AS or w[i : i + 2] in READ_AS)

    def meant(self, w: str, around: set[str] | None = None, before: str = "", after: str = "", free: bool = True) -> str | None:
        """The ordinary word that ``w`` (lower case) is a misreading of, or None.

        ``before`` and ``after``: the words beside it; ``free``: whether free edits are taken.
        """
        if w in self.good or len(w) < 3:
            return None
        free = free and len(w) >= EDIT_LETTERS and w.isalpha() and w not in self.count
        if (w, free) not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            own = self.count.get(w, self.least / 2)
            budget = BUDGET if not free else LONG_BUDGET if len(w) >= LONG_LETTERS else EDIT_BUDGET
            self.cache[w, free] = [
                (c, v) for c, v in self.search(w, budget)
                if c > 0 and len(v) >= 4 and (c < EDIT or v in self.frequent) and self.count[v] >= FREQUENCY_RATIO * min(own, self.count[v] if not w.isalpha() else own)
            ]
        found = self.cache[w, free]
        if not found:
            return None
        beside = {v: (pair_hash(before, v) in self.pairs) + (pair_hash(v, after) in self.pairs) for _, v in found} if found[-1][0] >= EDIT or len(found) > 1 else {}
        found = [(c, v) for c, v in found if c < EDIT or beside[v] > (len(w) == len(v) or _ending(w, v))]
        if not found:
            return None
        return min(found, key=lambda x: (x[0], -beside.get(x[1], 0), not (around and x[1] in around), -self.count[x[1]], x[1]))[1]

    def torn(self, left: str, right: str) -> str | None:
        """The ordinary word that ``left right`` is when put together, if it is far more usual than one of the two."""
        one = left + right
        word = one if one in self.good else self.meant(one, free=False)
        if word is None or len(word) < 5:
            return None
        rarer = min(self.count.get(left, 0), self.count.get(right, 0))
        return word if self.count[word] >= FREQUENCY_RATIO * max(rarer, self.least / 2) else None

    def joined(self, left: str, right: str) -> bool:
        """Whether a word broken as left-right at a line end was one word (True) or has a hyphen of its own."""
        one, two = self.count.get(left + right, 0), self.count.get(f"{left}-{right}", 0)
        if one or two:
            return one >= two
        if self.meant(left + right, free=False):
            return True
        if self.meant(f"{left}-{right}", free=False):
            return False
        return not (left.split("-")[-1] in self.good and right.split("-")[0] in self.good and len(left) > 2)


def _ending(w: str, v: str) -> bool:
    """Whether two words differ in their last two letters only."""
    n = min(len(w), len(v)) - 2
    return w[:n] == v[:n]


def furniture(lines: list[str], k: int, lexicon: Lexicon) -> str | None:
    """'header', 'page' or None for line k."""
    line = lines[k].strip()
    if not line:
        return None
    if PAGE.fullmatch(line):
        if line.isdigit():  # unless it goes with what stands before or after it
            before = next((x.strip() for x in reversed(lines[:k]) if x.strip()), "")
            after = next((x.strip() for x in lines[k + 1 :] if x.strip()), "")
            year = re.search(r"\byears?$", before) and re.fullmatch(r"(?:19|20)\d\d", line)
            wanted = re.search(r"[=<>±×~≈≥≤(]$", before) and not after[:1].isdigit()
            unit = re.match(r"[%±×°)]", after) and not before[-1:].isdigit()
            if (year or wanted or unit) and k and lines[k - 1].strip():
                return None
        return "page"
    return "header" if lexicon.headers and template(line, lexicon.frequent) in lexicon.headers else None


def _like(true: str, read: str) -> str:
    if read.isupper() and len(read) > 1:
        return true.upper()
    return true[0].upper() + true[1:] if read[:1].isupper() else true


def repair(text: str | None, lexicon: Lexicon) -> tuple[str | None, list[str]]:
    """(repaired text, kinds of damage found)."""
    if not text:
        return text, []
    kinds: set[str] = set()
    lines = LINES.split(text)
    if len(lines) > 1:
        kept = []
        for k in range(len(lines)):
            what = furniture(lines, k, lexicon)
            if what:
                kinds.add(what)
            elif lines[k].strip():
                kept.append(lines[k])
        out = kept[0] if kept else ""
        for line in kept[1:]:
            head = out.rstrip(" \t")
            nxt = line.lstrip(" \t")
            if head[-1:] and head[-1] in BREAKS and (left := re.search(r"[^\W_]+(?:[-‐@][^\W_]+)*$", head[:-1])) and (right := re.match(r"[^\W_]+(?:[@-][^\W_]+)*", nxt)) and not nxt[0].isupper() and not (HANGING.match(nxt) and (left[0] + right[0]).lower() not in lexicon.count):
                a, b = left[0].lower(), right[0].lower()
                soft = head[-1] in "\xad¬"
                if lexicon.joined(a, b) or (soft and not lexicon.count.get(f"{a}-{b}", 0)):
                    kinds.add("hyphen")
                    out = head[:-1] + nxt
                else:
                    out = head[:-1] + "-" + nxt
            elif head[-1:] and head[-1] in "-‐" and re.search(r"[^\W_]$", head[:-1]) and nxt[:1].isalnum() and not HANGING.match(nxt):
                out = head[:-1] + "-" + nxt
            else:
                out = f"{head} {nxt}"
        text = out
    fixed = _letters(text, lexicon)
    if fixed is not None:
        kinds.add("ocr")
        text = fixed
    return text, sorted(kinds)


BEFORE, AFTER = re.compile(r"([^\W\d_]+) $"), re.compile(r" ([^\W\d_]+)")


def _beside(text: str, a: int, b: int) -> tuple[str, str]:
    """The words before ``a`` and after ``b`` in lower case, '' where there is none."""
    before, after = BEFORE.search(text[max(0, a - 40) : a]), AFTER.match(text, b)
    return before[1].lower() if before else "", after[1].lower() if after else ""


def _letters(text: str, lexicon: Lexicon) -> str | None:
    """The text with misread and torn words put right, or None if there are none."""
    usual, changed = lexicon.usual, False
    around = set(re.findall(r"[^\W\d_]+", text.lower()))

    def close(m: re.Match) -> str:
        nonlocal changed
        one = m[0].replace(" ", "")
        for x, word, y in (("", one, ""), (one[0] + " ", one[1:], ""), ("", one[:-1], " " + one[-1])):  # an "a" may stand beside it
            if word.lower() in lexicon.good or lexicon.meant(word.lower(), free=False):
                changed = True
                return x + word + y
        return m[0]

    if SPACED.search(text):
        text = SPACED.sub(close, text)
    odd = [m for m in RUN.finditer(text) if m[0].lower() not in usual]
    if not odd:
        return text if changed else None
    edits: list[tuple[int, int, str]] = []
    for m in odd:
        w, a, b = m[0], m.start(), m.end()
        low = w.lower().replace("‐", "-")
        if edits and edits[-1][1] > a:
            continue
        true = lexicon.meant(low, around, *_beside(text, a, b), free=w.islower()) if len(low) >= 4 and sum(c.isalpha() for c in low) >= 2 and not (w.isupper() and not w.isalpha()) else None
        if true and sum(c.isdigit() for c in low) <= 2:
            edits.append((a, b, _like(true, w)))
            continue
        if not w.isalpha():
            continue
        # torn: with the word before or after, if together they are an ordinary word
        after = re.match(r" ([^\W_]+)", text[b : b + 40])
        before = re.search(r"(?<![^\s(“\"])([^\W\d_]+) $", text[max(0, a - 40) : a])
        for x, y, start, stop in ([(w, after[1], a, b + after.end())] if after else []) + ([(before[1], w, a - len(before[0]), b)] if before else []):
            word = lexicon.torn(x.lower(), y.lower()) if text[stop : stop + 1] not in ("-", "‐") and (x.isupper() or y.islower()) else None
            if word and (not edits or edits[-1][1] <= start):
                edits.append((start, stop, _like(word, x)))
                break
    if not edits:
        return text if changed else None
    out, at = [], 0
    for a, b, new in edits:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def lexicon_of(corpus: DataFrame, text: str, scanned: DataFrame | None = None) -> Lexicon:
    """The lexicon of a corpus with the header templates of its ``scanned`` texts (default: all)."""
    lexicon = Lexicon(*vocabulary(corpus, text))
    lexicon.headers = frozenset(header_templates(corpus if scanned is None else scanned, text, lexicon))
    return lexicon


def repaired(df: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """``df`` with ``repaired_text`` and ``kinds`` (array) added: one narrow pass. Columns of those names are replaced."""
    sent = send(df.sparkSession, lexicon)
    rest = [c for c in df.columns if c not in ("repaired_text", "kinds")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema.fields)
    at = rest.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lex = received(sent)
        for batch in batches:
            done = [repair(t, lex) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([t for t, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.string()))], names=[*rest, "repaired_text", "kinds"]
            )

    return df.select(*rest).mapInArrow(run, f"{schema}, repaired_text string, kinds array<string>")


DAMAGE = ("hyphen", "ocr", "edit", "header", "page")


def damaged(text: str, key: int, lexicon: Lexicon) -> tuple[str, str] | None:
    """(the text with one damage, its kind of DAMAGE), chosen by ``key``; None where the text has no place for it.

    ``edit`` is a dropped letter, ``ocr`` a confusion of READ_AS. The text comes in lines, as a page has them.
    """
    kind, key = DAMAGE[key % len(DAMAGE)], key // len(DAMAGE)
    tokens = text.split(" ")
    long = [k for k, w in enumerate(tokens) if len(w) >= 8 and w.isalpha() and w.islower() and w in lexicon.frequent and w in lexicon.usual and 0 < k < len(tokens) - 1]
    if not long or len(tokens) < 20:
        return None
    k = long[key % len(long)]
    w = tokens[k]
    if kind == "hyphen":
        tokens[k] = f"{w[: len(w) // 2]}-\n{w[len(w) // 2 :]}"
    elif kind == "edit":
        at = 2 + key % (len(w) - 5)
        tokens[k] = w[:at] + w[at + 1 :]
    elif kind == "ocr":
        read = [(at, r, true) for r, all_true in READ_AS.items() for true in all_true for at in range(1, len(w)) if w.startswith(true, at) and at + len(true) < len(w)]
        if not read:
            return None
        at, r, true = read[key % len(read)]
        tokens[k] = w[:at] + r + w[at + len(true) :]
    lines, line = [], []
    for t in tokens:
        line.append(t)
        if sum(map(len, line)) > 70:
            lines.append(" ".join(line))
            line = []
    lines += [" ".join(line)] if line else []
    if kind in ("header", "page"):
        forms = sorted(lexicon.headers)
        if len(lines) < 3 or kind == "header" and not forms:
            return None
        new = f"- {1 + key % 900} -"
        if kind == "header":
            new = " ".join("Vorrelan" if x == "N" else str(2 + key % 97) if x == "#" else x for x in forms[key % len(forms)].split(" "))
        lines.insert(1 + key % (len(lines) - 2), new)
    bad = "\n".join(lines)
    return (bad, kind) if kind in ("header", "page", "hyphen") or tokens[k] not in lexicon.count else None


def recall(clean: DataFrame, row: str, text: str, lexicon: Lexicon) -> DataFrame:
    """(kind, n_damaged, n_found, n_restored, recall): clean texts damaged on purpose, and how many are found and restored.

    ``clean`` texts with a line break or with a finding of their own take no part.
    """
    sent = send(clean.sparkSession, lexicon)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lex = received(sent)
        for batch in batches:
            out = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bad = damaged(t, key & 0xFFFFFFFF, lex)
                if bad and not repair(t, lex)[1]:
                    fixed, kinds = repair(bad[0], lex)
                    out.append((bad[1], ("ocr" if bad[1] == "edit" else bad[1]) in kinds, fixed == t))
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], k) for n, k in enumerate((pa.string(), pa.bool_(), pa.bool_()))], names=["kind", "found", "whole"])

    tried = clean.where((F.length(text) > 0) & ~F.col(text).rlike(LINES.pattern)).select(F.xxhash64(row), text).mapInArrow(run, "kind string, found boolean, whole boolean")
    return tried.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_damaged"), F.count_if("found").alias("n_found"), F.count_if("whole").alias("n_restored"), F.round(F.avg(F.col("found").cast("int")), 4).alias("recall")
    )
