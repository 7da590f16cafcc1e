"""Language identification, words first: a known word scores its log frequency in each
language; an unseen word falls back to its longest known character n-grams.

The model is fitted on labelled rows, a bounded sample of each language's, and is
bounded itself (``WORDS`` words, ``GRAMS`` n-grams of each length).  Counting is a
Spark aggregation of partial counts.  Prediction is one pass, row by row: the
text is counted into distinct words, each word's scores are looked up, or worked
out once per worker and remembered, and the weighted sum decides.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import keep, workers_ready

#: labelled rows of a language that are counted at most, about
SAMPLE_ROWS = 4_000
#: words and n-grams (of each length) that the model keeps, the most frequent ones
WORDS, GRAMS = 60_000, 20_000
LONGEST = 5
#: items of the pooled languages that are added to each one's counts, so that a language of
#: few rows differs from the others by what it has, not by what it lacks
PRIOR = 1_000.0
UNKNOWN = "und"
#: languages that are learned, those with the most labelled rows; with ``WORDS`` and ``GRAMS`` it
#: bounds what the driver gets
LANGUAGES = 100
#: unseen words that a worker remembers
REMEMBERED = 200_000


#: word characters without digits and underscores: letters, and numerals that are neither
LETTERS = re.compile(r"[^\W\d_]+")


ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@cache
def numerals() -> tuple[re.Pattern, re.Pattern]:
    """Word characters that are numbers, but not letters or decimal digits: those of the basic
    plane, whose set is matched by a table, and the others."""
    found = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
    basic = "".join(c for c in found if not ASTRAL.match(c))
    return re.compile(f"[{basic}]+"), re.compile(f"[{''.join(found[len(basic):])}]+")


def words_of(text: str) -> list[str]:
    """Runs of Unicode letters of a whole text, in lower case."""
    low = text.lower()
    if not low.isascii():
        basic, others = numerals()
        if basic.search(low):
            low = basic.sub(" ", low)
        if ASTRAL.search(low):
            low = others.sub(" ", low)
    return LETTERS.findall(low)


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word, from two characters on with a mark at its start and its end."""
    marked = f"_{word}_" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """``langs``; ``words`` and ``grams[n]``: string -> row of ``scores`` (rows x languages,
    log shares)."""
    langs: list
    words: dict
    grams: dict
    scores: np.ndarray


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.n_known = len(model.scores)
        self.scores = np.zeros((self.n_known + REMEMBERED, len(model.langs)))
        self.scores[:self.n_known] = model.scores
        self.unseen: dict = {}

    def _unseen(self, word: str) -> int:
        row = self.unseen.get(word)
        if row is None:
            if len(self.unseen) == REMEMBERED:
                self.unseen.clear()
            row = self.n_known + len(self.unseen)
            self.scores[row] = self._backoff(word)
            self.unseen[word] = row
        return row

    def _backoff(self, word: str):
        """Mean scores of the word's known n-grams of the greatest length that has any;
        nothing known: no evidence."""
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            table = self.m.grams.get(n, {})
            rows = [table[g] for g in grams_of(word, n) if g in table]
            if rows:
                return self.m.scores[rows].mean(axis=0)
        return 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, its share among the languages); ties to the smaller name."""
        counts = Counter(words_of(text)) if text else None
        if not counts or not self.m.langs:
            return UNKNOWN, 0.0
        total, known = np.zeros(len(self.m.langs)), self.m.words
        items = list(counts.items())
        for at in range(0, len(items), REMEMBERED):  # rows stay valid within a block
            block = items[at:at + REMEMBERED]
            if len(self.unseen) + len(block) > REMEMBERED:
                self.unseen.clear()
            rows = [known[w] if w in known else self._unseen(w) for w, _ in block]
            total += np.array([n for _, n in block], dtype=float) @ self.scores[rows]
        best = int(total.argmax())
        return self.m.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def fit(labelled: DataFrame, sample: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """``labelled`` rows -> a model.  Of each language about ``sample`` rows, drawn by a hash
    of the id, are counted whole; rows with a null text or language are left out, and so are
    those of languages beyond the ``LANGUAGES`` with the most rows (ties: by name).
    No such row: a model without languages, which answers ``und``."""
    spark = labelled.sparkSession
    workers_ready(spark)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                           F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, {}, np.zeros((0, 0)))
    shares = F.create_map(*(F.lit(x) for k in langs for x in (k, int(min(1.0, sample / sizes[k]) * 1e6))))
    drawn = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) < shares[F.col("lang")])

    def count_words(batches):
        import pyarrow as pa
        for batch in batches:
            counts: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                 pa.array(list(counts.values()), pa.int64())], names=["lang", "item", "n"])

    def count_grams(batches):
        import pyarrow as pa
        for batch in batches:
            counts: Counter = Counter()
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for k in range(1, LONGEST + 1):
                    for g in grams_of(word, k):
                        counts[lang, g] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                 pa.array(list(counts.values()), pa.int64())], names=["lang", "item", "n"])

    kind = "lang string, item string, n long"
    total = F.sum("n").alias("n")
    words = keep(drawn.select("text", "lang").mapInArrow(count_words, kind).groupBy("lang", "item").agg(total))
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())  # of the rows, some may have no word
    if not langs:
        return Model([], {}, {}, np.zeros((0, 0)))
    grams = keep(words.select("lang", "item", "n").mapInArrow(count_grams, kind).groupBy("lang", "item").agg(total))

    def table(counts: DataFrame, most: int) -> tuple[list, np.ndarray]:
        """The most frequent items, and the log of each one's share by language."""
        top = counts.groupBy("item").agg(F.sum("n").alias("all")).orderBy(F.col("all").desc(), "item").limit(most)
        sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(total).collect()}
        found = counts.join(top.select("item"), "item").collect()  # at most ``most`` x languages
        items = sorted({r["item"] for r in found})
        at, col = {w: i for i, w in enumerate(items)}, {x: i for i, x in enumerate(langs)}
        n = np.zeros((len(items), len(langs)))
        for r in found:
            n[at[r["item"]], col[r["lang"]]] = r["n"]
        pooled = n.sum(axis=1, keepdims=True) / max(1, sum(sums.values()))
        freq = np.log((n + PRIOR * pooled) / (np.array([sums.get(x, 0) for x in langs]) + PRIOR))
        # of the languages, given the item: so that words of different frequency weigh alike
        return items, freq - np.logaddexp.reduce(freq, axis=1, keepdims=True)

    items, scores = table(words, WORDS)
    known, all_scores, by_length = {w: i for i, w in enumerate(items)}, [scores], {}
    base = len(items)
    for n in range(1, LONGEST + 1):
        items, scores = table(grams.where(F.length("item") == n), GRAMS)
        by_length[n] = {g: base + i for i, g in enumerate(items)}
        all_scores.append(scores)
        base += len(items)
    return Model(langs, known, by_length, np.concatenate(all_scores))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, lang_pred, score (0 to 1).

    ``und`` with score 0 where a text is null or has no letter, or the model knows no
    language.  Null and repeated ids have rows like any other; other columns are
    not read; an empty table has no rows.
    """
    spark = docs.sparkSession
    workers_ready(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by WORDS and GRAMS

    def run(batches):
        import pyarrow as pa
        scorer = Scorer(sent.value)
        for batch in batches:
            got = [scorer.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
