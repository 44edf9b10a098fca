"""Text that was decoded with the wrong encoding: find it, undo the chain of wrong steps, restore what can be restored.

A multinomial classifier (naive Bayes over hashed byte bigrams) is trained on synthetically garbled sentences: sentences
of a bounded sample (about SAMPLE_ROWS texts, by the hash of their ids) are put through every chain of CHAINS, so each example's
exact chain is known. The counts are made and summed in Spark; the driver gets the table of (chain, bucket).

Every text with a non-ASCII character is then scored word by word, "clean" being one of the classes. Where a word is more
probable under some chain than as clean text, its sentence is classified, and the most probable chain that each step decodes
strictly and that gives plausible text is undone, layer by layer until none is left. Western text of one byte a character that
was read with another such set (WESTERN) is undone word by word, as its wrong characters are single ones.

Null and empty texts are left alone. A sentence with U+FFFD, or with a mis-read quotation mark that has lost its last
byte, counts as garbled; its other characters stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import received, send, task_slots

SAMPLE_ROWS, SAMPLE_SENTENCES = 3_000, 12
BUCKETS = 1 << 14
SMOOTHING = 0.02
#: Bytes that are scored at a time, so that the arrays stay small.
SCREEN_BYTES = 1 << 21
NON_ASCII = r"[^\x00-\x7f]"
#: What follows a non-ASCII character that is odd in its word: Cyrillic touching Latin letters, a sign between letters, an
#: accented capital after a small letter. Signs that stand between letters in correct text as well are left out.
_SIGN = r"[^\x00-\x7fÀ-ÖØ-öø-ɏЀ-ӿ\u0300-\u036f’‘“”‐-―…·´±≤≥×°µ®™ﬀ-ﬄ\u00a0\u00ad\u2000-\u200b�]"
ODD = rf"[^\x00-\x7f](?:(?<=[Ѐ-ӿ])(?=[A-Za-z])|(?<=[A-Za-z][Ѐ-ӿ])|(?<=[A-Za-z]{_SIGN})(?=[a-z])|(?<=[a-z][À-ÖØ-Þ]))"
#: Where words end: white space, quotation marks and dashes, which may be correct beside a garbled word.
GAPS = re.compile(r"([ \t\r\n’‘“”«»–—]+)")


def _cp1252(b: bytes) -> str:
    """windows-1252 whose five undefined bytes become the control characters of the same number, as lenient readers do."""
    out = b.decode("cp1252", "replace")
    return out if "�" not in out else "".join(c if c != "�" else chr(b[k]) for k, c in enumerate(out))


def _to_cp1252(s: str) -> bytes:
    try:
        return s.encode("cp1252")
    except UnicodeEncodeError:
        return b"".join(bytes([ord(c)]) if c in "\x81\x8d\x8f\x90\x9d" else c.encode("cp1252") for c in s)


def _codec(name: str) -> tuple[Callable[[bytes], str], Callable[[str], bytes]]:
    if name == "cp1252":
        return _cp1252, _to_cp1252
    return (lambda b: b.decode(name)), (lambda s: s.encode(name))


#: Chains of wrong steps: each step is (encoding the bytes were in, encoding they were read with).
CHAINS = {
    "utf-8>cp1252": [("utf-8", "cp1252")],
    "utf-8>latin-1": [("utf-8", "latin-1")],
    "utf-8>cp1252 twice": [("utf-8", "cp1252"), ("utf-8", "cp1252")],
    "utf-8>latin-1 twice": [("utf-8", "latin-1"), ("utf-8", "latin-1")],
    "utf-8>mac-roman": [("utf-8", "mac-roman")],
    "utf-8>cp437": [("utf-8", "cp437")],
    "utf-8>cp850": [("utf-8", "cp850")],
    "utf-8>cp1251": [("utf-8", "cp1251")],
    "utf-8>koi8-r": [("utf-8", "koi8-r")],
    "utf-8>cp1250": [("utf-8", "cp1250")],
    "cp1251>cp1252": [("cp1251", "cp1252")],
    "koi8-r>cp1252": [("koi8-r", "cp1252")],
    "cp1251>koi8-r": [("cp1251", "koi8-r")],
    "koi8-r>cp1251": [("koi8-r", "cp1251")],
    "cp1252>cp1251": [("cp1252", "cp1251")],
    "cp1252>koi8-r": [("cp1252", "koi8-r")],
    "cp1252>mac-roman": [("cp1252", "mac-roman")],
    "cp1252>cp437": [("cp1252", "cp437")],
    "cp1252>cp850": [("cp1252", "cp850")],
}
#: Chains that leave single wrong characters in Western text; of these, the ones that leave Cyrillic letters.
WESTERN = {c for c in CHAINS if c.startswith("cp1252>")}
TO_CYRILLIC = {"cp1252>cp1251", "cp1252>koi8-r"}
#: Log odds in favour of a chain where one or two letters fit several: Windows sets are taken for each other most often.
USUAL = {"cp1252>cp1251": 3.0}
CLEAN = "clean"


def garble(s: str, chain: str) -> str | None:
    """``s`` put through the chain; None if a step can't represent it."""
    try:
        for real, read in CHAINS[chain]:
            s = _codec(read)[0](_codec(real)[1](s))
    except UnicodeError:
        return None
    return s


def undo(s: str, chain: str) -> str | None:
    """The text before the chain, if every step decodes strictly and leads back to ``s``; else None."""
    t = s
    try:
        for real, read in reversed(CHAINS[chain]):
            t = _codec(real)[0](_codec(read)[1](t))
    except UnicodeError:
        return None
    return t if t != s and garble(t, chain) == s else None


def sentences(text: str) -> list[str]:
    """Pieces that joined give the text again: cut after line breaks and after a full stop, '?' or '!' with a space."""
    return [x for x in re.split(r"(?<=[.!?])(?= )|(?<=\n)", text) if x]


def bigrams(s: str):
    """Bucket of each byte bigram that touches a byte above 127."""
    import numpy as np

    b = np.frombuffer(s.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int64)
    if len(b) < 2:
        return b[:0]
    keep = (b[:-1] > 127) | (b[1:] > 127)
    return ((b[:-1] * 257 + b[1:])[keep] * 40_503) % BUCKETS


def garbled_counts(clean: list[str]):
    """(counts of each bucket for clean text and for each chain, characters of the clean text) of sentences, garbled ones left out."""
    import numpy as np

    counts, known = np.zeros((1 + len(CHAINS), BUCKETS)), set()
    for s in clean:
        if re.search("[\x80-\x9f�]", s) or any(undo(w, c) for c in CHAINS if c.startswith("utf-8") for w in s.split(" ") if re.search(r"[^\x00-\x7f]{2}", w)) or re.search("[a-z][Ѐ-ӿ]|[Ѐ-ӿ][a-z]", s):
            continue  # garbled already
        known.update(c for c in s if c > "\x9f")
        np.add.at(counts[0], bigrams(s), 1)
        for k, chain in enumerate(CHAINS, 1):
            bad = garble(s, chain)
            if bad is not None and bad != s and (chain.startswith("utf-8") or _mostly_cyrillic(s) != (chain in WESTERN)):
                np.add.at(counts[k], bigrams(bad), 1)
    return counts, known


class ChainClassifier:
    """Multinomial naive Bayes: log probability of each bucket for each chain."""

    def __init__(self, clean: list[str] | tuple = (), counts=None, known: set[str] | None = None):
        import numpy as np

        self.names = [CLEAN, *CHAINS]
        own, self.known = garbled_counts(list(clean))
        self.known |= {c for x in SEEDS for c in x if c > "\x7f"} | (known or set())
        total = own + SMOOTHING + (0 if counts is None else counts)
        self.log = np.log(total / total.sum(1, keepdims=True)).astype(np.float32)
        self.against_clean = self.log[1:] - self.log[0]

    def suspects(self, data, offsets):
        """For each text of an Arrow string array's bytes: whether some word is more probable under a chain than as clean text."""
        import numpy as np

        out, first, n = np.zeros(len(offsets) - 1, dtype=bool), 0, len(offsets) - 1
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SCREEN_BYTES, side="right")) - 1)
            b = data[offsets[first] : offsets[last]].astype(np.int64)
            ends = np.zeros(len(b) + 1, dtype=np.int64)
            np.add.at(ends, offsets[first : last + 1] - offsets[first], 1)
            text = np.cumsum(ends[:-1]) - 1 + first
            gap, sign = b <= 32, np.zeros(len(b), dtype=bool)
            mark = np.flatnonzero((b[:-2] == 0xE2) & (b[1:-1] == 0x80))  # quotation marks, dashes and the like tell nothing
            for k in range(3):
                sign[mark + k] = True
            gap |= sign
            touched = ((b[:-1] > 127) | (b[1:] > 127)) & ~(sign[:-1] | sign[1:])
            pair = np.flatnonzero(touched & (text[:-1] == text[1:])) if len(b) else b
            if len(pair):
                bucket = ((b[pair] * 257 + b[pair + 1]) * 40_503) % BUCKETS
                word = (np.cumsum(gap) + text)[np.where(gap[pair], pair + 1, pair)]  # a pair with a gap belongs to the word beside it
                starts = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (text[pair[1:]] != text[pair[:-1]])])
                likely = np.add.reduceat(self.against_clean[:, bucket], starts, axis=1).max(0) > 0
                out[text[pair[starts[likely]]]] = True
            first = last
        return out

    def suspect(self, parts: list[str]) -> list[bool]:
        """For each piece of a text whether it has a suspect word."""
        import numpy as np

        encoded = [s.encode("utf-8", "surrogatepass") for s in parts]
        data = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        return self.suspects(data, np.cumsum([0, *map(len, encoded)])).tolist()

    def ranked(self, s: str) -> list[tuple[str, float]]:
        import numpy as np

        score = self.log[:, bigrams(s)].sum(1)
        return [(self.names[k], float(score[k])) for k in np.argsort(-score)]

    def repair(self, s: str) -> tuple[str, list[str]]:
        """The restored sentence and the chains that were undone, layer by layer until none is left."""
        undone, seen = [], {s}
        while (found := self._one(s)) is not None and found[0] not in seen:
            s = found[0]
            seen.add(s)
            undone.append(found[1])
        return s, undone

    def _one(self, s: str) -> tuple[str, str] | None:
        """One chain undone over the whole sentence or, where garbling begins or ends within it, over the words it hit."""
        ranked = self.ranked(s)
        clean = next(v for n, v in ranked if n == CLEAN)
        for name, value in ranked:
            if name == CLEAN:
                continue
            if name.startswith("utf-8"):
                t = undo(s, name)
                if t is not None and self.plausible(t) and value > clean:
                    return t, name
            elif name not in WESTERN and value > clean and (t := undo(s, name)) is not None and _mostly_cyrillic(t):
                return t, name
        parts = re.split(r"([ \t\r\n]+)", s)
        odd = [k for k, w in enumerate(parts) if re.search(r"[^\x00-\x7f]{2}", w)]
        for name, _ in ranked:
            if not name.startswith("utf-8"):
                continue
            fixed = {k: t for k in odd if (t := undo(parts[k], name)) is not None and self.plausible(t)}
            if fixed:
                scores = dict(self.ranked(" ".join(parts[k] for k in fixed)))
                if scores[name] > scores[CLEAN]:
                    return "".join(fixed.get(k, w) for k, w in enumerate(parts)), name
        return self.western(s)

    def western(self, s: str, known: frozenset[str] = frozenset()) -> tuple[str, str] | None:
        """One of WESTERN undone over the words it hit; a sentence without odd words needs a chain ``known`` from its text."""
        parts = GAPS.split(s)
        beyond = [k for k, w in enumerate(parts) if re.search(r"[^\x00-\x7f]", w)]
        odd = [k for k in beyond if re.search(ODD, parts[k]) and len(re.findall("[A-Za-z]", parts[k])) >= 2]
        if not beyond or not odd and not known:
            return None
        best = None
        for name in sorted(WESTERN if odd else known):
            fixed = {k: t for k in odd if (t := undo(parts[k], name)) is not None and _western_word(t)}
            if odd:
                # signs of writing tell nothing of the chain
                scores = dict(self.ranked(re.sub(r"[‘’“”–—…«»]", "", " ".join(parts[k] for k in fixed))))
                if not fixed or scores[name] <= scores[CLEAN]:
                    continue
            sure = len(fixed), dict(self.ranked(" ".join(fixed.values())))[CLEAN] + USUAL.get(name, 0.0)
            for k in beyond:
                t = undo(parts[k], name) if k not in odd else None
                if t is not None and self.plausible(t):
                    if name in TO_CYRILLIC:
                        hit = len(re.findall("[Ѐ-ӿ]", parts[k])) in (1, 2)
                    else:
                        scores = dict(self.ranked(f" {parts[k]} "))
                        hit = _western_word(t) and scores[name] > scores[CLEAN]
                    if hit:
                        fixed[k] = t
            # of several chains the one that explains most words, and gives the most usual ones
            if fixed and (best is None or sure > best[0]):
                best = sure, "".join(fixed.get(k, w) for k, w in enumerate(parts)), name
        return best and best[1:]

    def plausible(self, t: str) -> bool:
        """Whether every non-ASCII character is a usual letter or one that clean text of the sample has."""
        return all(c < "\x80" or c in self.known or "À" <= c <= "ſ" or "Α" <= c <= "ӿ" for c in t)


def _mostly_cyrillic(s: str) -> bool:
    letters = [c for c in s if c.isalpha()]
    return bool(letters) and sum("Ѐ" <= c <= "ӿ" for c in letters) > 0.6 * len(letters)


def _western_word(t: str) -> bool:
    """Whether beside signs of writing all non-ASCII characters are Western letters, and none is a capital after a small letter."""
    return all(c < "\x80" or "À" <= c <= "ÿ" and c not in "×÷" or c in "’‘“”„–—…«»" for c in t) and not re.search("[a-zß-ÿ][A-ZÀ-Þ]", t)


def fit(docs: DataFrame, doc_id: str, text: str, sample_rows: int = SAMPLE_ROWS) -> ChainClassifier:
    """Trained on the sentences with non-ASCII characters of about ``sample_rows`` texts, chosen by the hash of their ids.

    At most SAMPLE_SENTENCES sentences of each of at most 4 * sample_rows texts are taken. They are garbled and counted in
    the tasks; what the driver gets is bounded by the chains, the buckets and the characters there are.
    """
    import numpy as np

    part = max(1, docs.count() // sample_rows)
    pieces = F.filter(F.split(text, r"(?<=[.!?]) |(?<=\n)"), lambda x: x.rlike(NON_ASCII) & (F.length(x) < 600))
    chosen = docs.where(F.pmod(F.xxhash64(doc_id), F.lit(part)) == 0).where(F.col(text).rlike(NON_ASCII)).select(text).limit(4 * sample_rows)
    clean = chosen.select(F.explode(F.slice(pieces, 1, SAMPLE_SENTENCES)).alias("s")).select(F.trim("s").alias("s")).distinct()

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, known = np.zeros((1 + len(CHAINS), BUCKETS)), set()
        for batch in batches:
            counts, chars = garbled_counts(batch.column(0).to_pylist())
            total += counts
            known |= chars
        k, at = np.nonzero(total)
        chars = np.array(sorted(map(ord, known)), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[k, np.full(len(chars), -1)], pa.int32()), pa.array(np.r_[at, chars], pa.int64()), pa.array(np.r_[total[k, at], np.ones(len(chars))])], names=["k", "at", "n"])

    rows = clean.repartition(task_slots(docs.sparkSession)).mapInArrow(count, "k int, at long, n double").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    k, at, n = (rows.column(c).to_numpy() for c in ("k", "at", "n"))
    counts = np.zeros((1 + len(CHAINS), BUCKETS))
    counts[k[k >= 0], at[k >= 0]] = n[k >= 0]
    return ChainClassifier(SEEDS, counts, {chr(x) for x in at[k < 0]})


#: Sentences with the characters of languages that a sample may lack (fixed values).
SEEDS = [
    "Клиническое течение болезни не изменила длительность лечения среди пожилых людей.",
    "Größe, Übertragung, ungefähr, Maßnahmen und Ärzte für ältere Patienten.",
    "L’âge médian des décès a été considérablement réduit; naïve, façade, où, hôpital.",
    "El número de hospitalizaciones según el género: señal, daño, crónica, día décimo.",
    "A região amazônica, condições de saúde, diagnóstico clínico e avaliação do médico.",
    "La qualità della ventilazione può spiegare perciò l’età; già, martedì, comorbilità.",
    "“quoted” – the authors’ term — 5 µg, ± 0.2 °C, × 10³, ≥ 0.05, α β γ κ, £40 €45 ©.",
]


def repair_text(text: str, model: ChainClassifier) -> tuple[str, list[str], bool]:
    """(restored text, chains, whether characters are lost for good)."""
    if not text or text.isascii():
        return text, [], False
    out, chains, lost = sentences(text), [], False
    for k, odd in enumerate(model.suspect(out)):
        s = out[k]
        lost = lost or "�" in s or bool(re.search(r"â€(?=[\s.,;:)]|$)", s))
        if odd:
            out[k], undone = model.repair(s)
            chains += undone
    known = frozenset(chains) & WESTERN
    if known:
        out = [found[0] if not s.isascii() and not _mostly_cyrillic(s) and (found := model.western(s, known)) else s for s in out]
    return "".join(out), sorted(set(chains)), lost


def garbled_texts(docs: DataFrame, doc_id: str, text: str, model: ChainClassifier | None = None) -> DataFrame:
    """(doc, chains, lost, restored): one row for each text that was garbled wholly or in places.

    Narrow: one pass, no shuffle. All texts with a non-ASCII character are scored, as whole arrays of bytes; those with a
    suspect word, or with U+FFFD, are decoded and repaired. Rows with the same id are judged one by one.
    """
    model = model or fit(docs, doc_id, text)
    sent = send(docs.sparkSession, model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        m = received(sent)
        for batch in batches:
            keep, chains, lost, restored = [], [], [], []
            column = batch.column(1)
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            wanted = pc.match_substring(column, "�").to_numpy(zero_copy_only=False).astype(bool)
            if data is not None and len(column):
                wanted |= m.suspects(np.frombuffer(data, dtype=np.uint8), offsets)
            for k in np.flatnonzero(wanted).tolist():
                fixed, found, gone = repair_text(column[k].as_py(), m)
                if found or gone:
                    keep.append(k)
                    chains.append(found)
                    lost.append(gone)
                    restored.append(fixed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(chains, pa.list_(pa.string())), pa.array(lost, pa.bool_()), pa.array(restored, pa.string())], names=["doc", "chains", "lost", "restored"]
            )

    picked = docs.where(F.col(text).rlike(NON_ASCII)).select(F.col(doc_id).alias("doc"), F.col(text).alias("t"))
    return picked.mapInArrow(run, f"doc {kind}, chains array<string>, lost boolean, restored string")


def recall(docs: DataFrame, doc_id: str, text: str, model: ChainClassifier) -> DataFrame:
    """(chain, n_garbled, n_found, n_restored, recall): clean texts garbled on purpose, and how many are found and wholly restored.

    The id's hash picks the chain and whether the whole text or one of its sentences is garbled. Texts that are garbled
    already, and those the chain can't represent or leaves as they are, take no part.
    """
    sent = send(docs.sparkSession, model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m, names = received(sent), list(CHAINS)
        for batch in batches:
            out = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key &= 0x7FFFFFFF
                chain, key = names[key % len(names)], key // len(names)
                parts = sentences(t)
                usable = [k for k, s in enumerate(parts) if not s.isascii()]
                at = usable if key % 2 else usable[key // 2 % len(usable) :][:1] if usable else []
                bad = {k: garble(parts[k], chain) for k in at}
                if not bad or None in bad.values() or all(bad[k] == parts[k] for k in at) or repair_text(t, m)[1:] != ([], False):
                    continue
                fixed, found, lost = repair_text("".join(bad.get(k, s) for k, s in enumerate(parts)), m)
                out.append((chain, bool(found or lost), fixed == t))
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], k) for n, k in enumerate((pa.string(), pa.bool_(), pa.bool_()))], names=["chain", "found", "whole"])

    tried = docs.where(F.col(text).rlike(NON_ASCII)).select(F.xxhash64(doc_id), text).mapInArrow(run, "chain string, found boolean, whole boolean")
    return tried.groupBy("chain").agg(
        F.count(F.lit(1)).alias("n_garbled"), F.count_if("found").alias("n_found"), F.count_if("whole").alias("n_restored"), F.round(F.avg(F.col("found").cast("int")), 4).alias("recall")
    )
