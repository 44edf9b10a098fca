"""Tokenisers of the word count and the title task, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import fold_punctuation, nfkc, sanitize

# --- fixed values: word lists and patterns ---------------------------------------------------------------------------
LETTER = "a-zà-öø-þα-ω"
TOKEN = f"[{LETTER}][{LETTER}0-9]*(?:[-/][{LETTER}0-9]+)*"
MIN_LENGTH = 2
STOPWORDS = """
a about above across after again against all also am among an and any are as at be
because been before being below besides between both but by can could despite did do
does doing down during each either every few for from further had has have having he
her here hers herself him himself his how however i if in into is it its itself just may
many me might more most much must my myself neither no nor not now of off on once one
only or other our ours ourselves out over own per several shall she should since so some
such than that the their theirs them themselves then there therefore these they this
those three through throughout thus to too toward towards two under until up upon us
very via was we were what when where whether which while who whom why will with within
without would you your yours yourself yourselves
""".split()
ARTIFACTS = "et al fig figs figure figures table tables eq eqn respectively".split()

PLAIN_TOKEN = "[a-z][a-z0-9]+(?:[-/][a-z0-9]+)*"
PLAIN_STOPWORDS = """
a about above after again against all am an and any are as at be because been
before being below between both but by can could did do does doing down during
each few for from further had has have having he her here hers herself him
himself his how i if in into is it its itself just me more most my myself no
nor not now of off on once only or other our ours ourselves out over own same
she should so some such than that the their theirs them themselves then there
these they this those through to too under until up very was we were what when
where which while who whom why will with you your yours yourself yourselves
also al et fig figure table using use used may one two three however within
without among across per
""".split()

TITLE_STOPWORDS = """
the of and in to a an is are was were be
for on with by as at from that this these
those it its or not no but if then than so
such can could may might will would shall should
has have had do does did we our you your they
their he she his her i my me us am been
being into over under between during through about
""".split()
# ----------------------------------------------------------------------------------------------------------------------


def _kept(tokens: Column, ignored: list[str], min_length: int) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) >= min_length) & ~t.isin(ignored))


def tokens(text: Column, ignored: list[str] | None = None, min_length: int = MIN_LENGTH) -> Column:
    """Words of a paragraph: Latin, accented Latin and Greek letters, digits inside, joined by '-' or '/'."""
    return tokens_of_sanitized(sanitize(text), ignored, min_length)


def tokens_of_sanitized(text: Column, ignored: list[str] | None = None, min_length: int = MIN_LENGTH) -> Column:
    return _kept(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), STOPWORDS + ARTIFACTS if ignored is None else ignored, min_length)


def plain_tokens(text: Column, stopwords: list[str] | None = None, min_length: int = 2, pattern: str = PLAIN_TOKEN) -> Column:
    """The earlier tokeniser: ASCII letters only, own word list, LaTeX left in."""
    return _kept(F.regexp_extract_all(fold_punctuation(F.lower(nfkc(text))), F.lit(pattern), F.lit(0)), PLAIN_STOPWORDS if stopwords is None else stopwords, min_length)


def title_tokens(title_norm: Column) -> Column:
    return _kept(F.regexp_extract_all(title_norm, F.lit("[a-z]{2,}"), F.lit(0)), TITLE_STOPWORDS, 2)


def parse_stopwords(lines: list[str], with_default: bool = True) -> list[str]:
    """A word list with one word a line; '#' begins a comment line. Joined with the default list unless told otherwise."""
    own = {x for x in (line.strip().lower() for line in lines) if x and not x.startswith("#")}
    return sorted(own | (set(PLAIN_STOPWORDS) if with_default else set()))
