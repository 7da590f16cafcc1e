"""Quality rules: a table of thresholds compiled into one Spark projection.

``RULES`` names a ratio, its lower and its upper bound.  ``measures`` writes the
counts of a text as built-in functions over its array of words and its array of
lines; ``verdicts`` turns the table into one boolean expression over them.  No
user function, no shuffle: a row's result depends on the row alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import SPACES, let, words

#: fixed values of the base rules: fewest words, window, highest share (percent) of repeated words
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOLS = "#*$%&|<>"
#: fixed values: frequent short words of English, German, French and Spanish
STOP_WORDS = (
    "the", "of", "and", "to", "is", "in", "it", "that", "was", "with", "for", "on", "are", "be", "this", "by",
    "der", "die", "das", "und", "von", "mit", "den", "dem", "nicht", "ein", "eine", "im", "zu", "auf", "sich",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "est", "dans", "pour", "par", "pas",
    "el", "los", "las", "del", "y", "no", "se", "para", "con", "una", "por")


#: fixed values: letters of these four languages besides A to Z; a text with others is in a language
#: whose stop words the table doesn't have
ACCENTED = "ÄÖÜäöüßẞÀÂÆÇÈÉÊËÎÏÔŒÙÛŸàâæçèéêëîïôœùûÿÁÍÑÓÚáíñóúªº"


@dataclass(frozen=True)
class Rule:
    """``low <= top / bottom <= high`` over measures; a text with less than ``least`` of
    ``bottom`` passes, and so does one where another measure, ``beyond``, exceeds the
    share ``limit`` of the characters of its words."""
    name: str
    top: str
    bottom: str
    low: float
    high: float
    least: int = 1
    beyond: str | None = None
    limit: float = 0.0


#: the table of thresholds
RULES = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols to words", "n_symbols", "n_words", 0.0, 0.1),
    Rule("stop words", "n_stop_words", "n_words", 0.02, 1.0, beyond="n_other_letters", limit=0.01),
    Rule("words in capitals", "n_capital_words", "n_words", 0.0, 0.5),
    Rule("words equal to the one before", "n_same_words", "n_words", 0.0, 0.2),
    Rule("repeated lines", "n_dup_lines", "n_lines", 0.0, 0.5),
    Rule("lines that end in dots", "n_dotted_lines", "n_lines", 0.0, 0.3, least=4),
    Rule("lines that start with a bullet", "n_bullet_lines", "n_lines", 0.0, 0.9, least=4),
)


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words of an array that lie in a ``window``-word window found twice or more.
    Hashes of all windows; only where two are equal are they sorted with their
    places, and the places that repeat cover ``window`` words each, overlaps once."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    def covered(h):
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def again(s):
            same = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                            lambda j: F.get(s, j)["h"].eqNullSafe(F.get(s, j - 1)["h"])
                            | F.get(s, j)["h"].eqNullSafe(F.get(s, j + 1)["h"]))
            return F.array_sort(F.transform(same, lambda j: F.get(s, j)["at"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(let(placed, again), start,
                           lambda acc, at: F.struct((acc["n"] + F.least(F.lit(window), at - acc["last"])).alias("n"),
                                                    at.alias("last")),
                           lambda acc: acc["n"])

    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) < window + 1, F.lit(0)).otherwise(count).cast("long")


def measures(text: Column) -> Column:
    """A struct of counts (longs) of a whole text; a null text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def bare(w):
        return F.lower(F.btrim(w, F.lit(".,;:!?\"'()")))

    def of_words(w):
        capital = F.filter(w, lambda x: (F.length(x) > 1) & (F.upper(x) == x) & (F.lower(x) != x))
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        repeated_words(w).alias("n_repeat_words"),
                        F.size(F.filter(w, lambda x: bare(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
                        F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_same_words"),
                        F.size(capital).cast("long").alias("n_capital_words"))

    def of_lines(x):
        def number(test):
            return F.size(F.filter(x, test)).cast("long")
        return F.struct(F.size(x).cast("long").alias("n_lines"),
                        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                        number(lambda s: F.btrim(s, F.lit(SPACES)).endswith("...")).alias("n_dotted_lines"),
                        number(lambda s: F.btrim(s, F.lit(SPACES)).substr(1, 1).isin("-", "*", "•")).alias("n_bullet_lines"))

    def without(chars):
        return F.length(F.translate(text, chars, "")).cast("long")

    return let(F.struct(let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l")), lambda m: F.struct(
        *(m["w"][c].alias(c) for c in ("n_words", "n_repeat_words", "n_stop_words", "n_same_words", "n_capital_words")),
        *(m["l"][c].alias(c) for c in ("n_lines", "n_dup_lines", "n_dotted_lines", "n_bullet_lines")),
        F.length(F.regexp_replace(text, rf"[A-Za-z{ACCENTED}\P{{L}}]+", "")).cast("long").alias("n_other_letters"),
        without(SPACES).alias("word_chars"), (F.length(text) - without(SYMBOLS)).alias("n_symbols")))


def verdicts(m: Column, rules=RULES) -> tuple[Column, Column]:
    """(base_failed, kept) of a struct of measures."""
    base = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    kept = ~base
    for r in rules:
        top, bottom = m[r.top].cast("double"), m[r.bottom].cast("double")
        passed = (bottom < r.least) | (top >= r.low * bottom) & (top <= r.high * bottom)
        if r.beyond:
            passed |= m[r.beyond].cast("double") > r.limit * m["word_chars"].cast("double")
        kept &= passed
    return base, kept


def quality(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail.  Null and repeated ids have rows
    like any other; other columns are not read; an empty table has no rows.
    """
    m = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m"))
    base, kept = verdicts(F.col("m"), rules)
    counts = (F.col("m")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return m.select("doc_id", *counts, base.alias("base_failed"), kept.alias("kept"))


def keep_quality(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, all their columns as they were.  Null and
    empty texts have too few words and go; repeated rows stay or go alike; an empty table
    stays empty."""
    # one lambda binds the measures: a filter on an alias of them would compute them for every rule
    return docs.where(let(measures(F.col(text_col)), lambda m: verdicts(m, rules)[1]))
