"""LM scoring: an interpolated modified Kneser-Ney n-gram model.

A text is its words, A-Z lower-cased, and one end; the context starts with a start
mark.  Words are 64-bit hashes, n-grams hashes of these (at 10^10 n-grams two share
a hash with a chance of some percent).

Counting.  Tasks count the n-grams of up to ``BUFFER`` tokens at a time and send them
by buckets of the n-gram's hash, so that a hot word or context is spread over all
buckets.  A bucket's task merges the counts, writes the sorted n-grams with their
counts, and hands down what the next lower order needs, summed: for the n-gram
without its first word one more distinct extension to the left (the adjusted count of
Kneser and Ney), for the n-gram without its last word the sum and the number of
adjusted counts that are 1, 2 and 3 or more.  Lower orders go the same way down to
the words.  N-grams that begin with the start mark keep their plain counts.  All
n-grams are kept; the tables grow with the corpus.

Scoring.  Discounts of 1, 2, 3+ come from the counts of counts of each order.  Workers
map the tables into memory and look up the distinct n-grams of a batch.  With a the
adjusted count, S the context's sum, N1, N2, N3 its counts of counts:
p(w | context) = (a - D(a)) / S + (D1 N1 + D2 N2 + D3 N3) / S * p(w | shorter context),
and the words are interpolated with 1 / (words + 1), which is an unknown word's share.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import shared_folder, workers_ready
from foldwise.llm.shared_arrays import SortedTable, bucket_of, mixed, pack, unpack, write_arrays

#: the longest n-grams that are counted
ORDER = 2
#: tokens that a task counts before it sends, entries that a bucket's task merges at a time
BUFFER = 2_000_000
#: bytes of text a bucket
BUCKET_BYTES = 32 << 20
#: texts that are cut into words at a time, in bytes
CHUNK = 8 << 20
#: discounts where an order has too few counts of counts for the closed form
FALLBACK = (0.5, 1.0, 1.5)
#: not a word's hash but by chance
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: what a level sums for an n-gram: plain count, adjusted count, and as a context the sum of
#: adjusted counts and how many are 1, 2, 3 or more
STATS = ("raw", "adjusted", "total", "ones", "twos", "more")


# ------------------------------------------------------------------ in tasks

def chunks(texts, most: int = CHUNK):
    """(start, end) of runs of texts of at most ``most`` bytes, or of one text."""
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def hashed_tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, their number in each text) of an Arrow array of strings; a null
    text is empty.  Only distinct words are hashed."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash
    # a slice is copied: cast, it keeps its distance from its array's start, which ascii_lower forgets
    whole = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    body = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(whole, "")))
    split = pc.ascii_split_whitespace(body)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(body), 0).to_numpy(zero_copy_only=False)
    coded = split.flatten().dictionary_encode()
    seen = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()),
                       np.uint64, len(coded.dictionary))
    found = seen[coded.indices.to_numpy()] if len(seen) else np.empty(0, np.uint64)
    if empty.any():  # an empty body splits into one empty word
        found = np.delete(found, (np.cumsum(counts) - counts)[empty & (counts > 0)])
        counts = np.where(empty, 0, counts)
    n = counts + 1
    out = np.full(int(n.sum()), END)
    last = np.cumsum(n) - 1
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner] = found
    return out, n


def gram_hash(words: list) -> np.ndarray:
    """Of n-grams given as columns of word hashes; a single word is its own."""
    h = words[0]
    for w in words[1:]:
        h = mixed(h * np.uint64(0xFF51AFD7ED558CCD) + w)
    return h


def with_starts(tokens: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's tokens after one start mark; the place of each token in its text, from 1 (0: the mark)."""
    at = np.cumsum(n) - n
    marked = np.insert(tokens, at, START) if order > 1 else tokens
    place = np.arange(len(marked)) - np.repeat(np.cumsum(n + (order > 1)) - (n + (order > 1)), n + (order > 1))
    return marked, place if order > 1 else place + 1


def grams(marked: np.ndarray, place: np.ndarray, m: int, first: bool) -> list[np.ndarray]:
    """Columns of the m-grams that end in a token, those that begin with the start mark alone
    if ``first``.  Word by word: the tokens that end one, and m - 1 before."""
    ends = np.flatnonzero(place == m - 1) if first else np.flatnonzero(place >= max(1, m - 1))
    return [marked[ends - back] for back in range(m - 1, -1, -1)]


def summed(words: list, stats: list) -> tuple[list, list, np.ndarray]:
    """Equal n-grams as one, sorted by hash: (words, stats, hashes)."""
    h = gram_hash(words)
    order = np.argsort(h, kind="stable")
    h = h[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    rows = order[starts]
    return ([w[rows] for w in words],
            [np.add.reduceat(s[order], starts) if len(starts) else s for s in stats], h[starts])


def outgoing(level: int, words: list, stats: list, h: np.ndarray, buckets: int):
    """(level, bucket, packed columns) of summed n-grams; equal first words stand together, as runs."""
    of = bucket_of(h, buckets)
    order = np.argsort((of << np.uint64(40)) | (words[0] >> np.uint64(24)))
    of, edges = of[order], np.searchsorted(of[order], np.arange(buckets + 1).astype(np.uint64))
    for b in np.unique(of).astype(np.int64).tolist():
        rows = order[edges[b]:edges[b + 1]]
        yield level, b, pack([c[rows] for c in (*words, *stats)])


class Merger:
    """The n-grams of a bucket, merged as packed rows come."""

    def __init__(self, level: int, buffer: int):
        self.level, self.buffer, self.held, self.n = level, buffer, [], 0
        self.words, self.stats, self.h = [np.empty(0, np.uint64)] * level, [np.empty(0, np.uint64)] * len(STATS), None

    def add(self, raw: bytes) -> None:
        columns = unpack(raw)
        self.held.append(columns)
        self.n += len(columns[0])
        if self.n >= self.buffer:
            self.merge()

    def merge(self) -> None:
        columns = [np.concatenate(c) for c in zip([*self.words, *self.stats], *self.held)]
        self.words, self.stats, self.h = summed(columns[:self.level], columns[self.level:])
        self.held, self.n = [], 0


def lower(words: list, stats: list) -> tuple[list, list, np.ndarray]:
    """What n-grams give to those of one word less."""
    raw, adjusted = stats[0], stats[1]
    event = (adjusted > 0).astype(np.uint64)
    none = np.zeros(len(raw), np.uint64)
    ones, twos = (adjusted == 1).astype(np.uint64), (adjusted == 2).astype(np.uint64)
    suffix = [raw, event, none, none, none, none]
    prefix = [none, none, adjusted, ones, twos, event - ones - twos]
    return summed([np.concatenate(c) for c in zip(words[1:], words[:-1])], [np.concatenate(c) for c in zip(suffix, prefix)])


ROW = "level int, bucket int, packed binary, path string, facts array<long>"


def _rows(rows: list):
    import pyarrow as pa
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)],
                                      names=["level", "bucket", "packed", "path", "facts"])


def count_texts(order: int, buckets: int, buffer: int = BUFFER):
    """For mapInArrow over a column of texts: packed counts of n-grams by bucket."""
    def flush(tokens, n):
        marked, place = with_starts(np.concatenate(tokens), np.concatenate(n), order)
        for m in range(order, 0, -1):
            # shorter n-grams at a text's start have nothing before them that could hand them down
            columns = grams(marked, place, m, first=m < order)
            if m == 1 and order > 1 or not len(columns[0]):
                continue
            one, none = np.ones(len(columns[0]), np.uint64), np.zeros(len(columns[0]), np.uint64)
            words, stats, h = summed(columns, [one, one, none, none, none, none])
            for level, b, raw in outgoing(m, words, stats, h, buckets):
                yield _rows([(level, b, raw, None, None)])

    def run(batches):
        tokens, n, held = [], [], 0
        for batch in batches:
            column = batch.column(0)
            for lo, hi in chunks(column):
                found = hashed_tokens(column.slice(lo, hi - lo))
                tokens.append(found[0])
                n.append(found[1])
                held += len(found[0])
                if held >= buffer:
                    yield from flush(tokens, n)
                    tokens, n, held = [], [], 0
        if held:
            yield from flush(tokens, n)

    return run


def looked_up(level: int, order: int) -> tuple:
    """What scoring asks of a level's n-grams: plain counts of words, sums of contexts."""
    return (STATS if level == 1 else STATS[1:]) if level < order else STATS[:2] if level == 1 else STATS[1:2]


def write_level(folder: str, level: int, order: int, buckets: int, buffer: int = BUFFER):
    """For mapInArrow over the packed rows of one bucket: writes this level's files, hands down the
    level below, lets pass what belongs to others."""
    def close(bucket, merger):
        merger.merge()
        words, stats, h = merger.words, merger.stats, merger.h
        if level > 1:
            w, s, g = lower(words, stats)
            yield from ((m, b, raw, None, None) for m, b, raw in outgoing(level - 1, w, s, g, buckets))
        wanted = looked_up(level, order)
        path = write_arrays(f"{folder}/{level}", bucket, {"key": h} | {k: v for k, v in zip(STATS, stats) if k in wanted})
        adjusted, event = stats[1], stats[1] > 0
        facts = [int((adjusted == k).sum()) for k in (1, 2, 3, 4)] + [
            int(adjusted.sum()), int(event.sum()), int(stats[0].sum())]
        yield level, bucket, None, path, facts

    def run(batches):
        bucket, merger = None, None
        for batch in batches:
            for i in range(batch.num_rows):  # a packed row at a time
                m, b, raw, path, facts = (c[i].as_py() for c in batch.columns)
                if m != level or raw is None:
                    yield _rows([(m, b, raw, path, facts)])
                    continue
                if merger is not None and b != bucket:
                    for row in close(bucket, merger):
                        yield _rows([row])
                    merger = None
                if merger is None:
                    bucket, merger = b, Merger(level, buffer)
                merger.add(raw)
        if merger is not None:
            for row in close(bucket, merger):
                yield _rows([row])

    return run


# ------------------------------------------------------------------ the model

@dataclass
class Order:
    """One order's files and what all its n-grams sum to."""
    paths: dict = field(default_factory=dict)
    facts: list = field(default_factory=lambda: [0] * 7)

    @property
    def discounts(self) -> tuple[float, float, float]:
        return discounts(*self.facts[:4])


@dataclass
class Model:
    """``orders`` from words up; ``buckets`` of every table."""
    order: int
    buckets: int
    orders: list

    @property
    def train_tokens(self) -> int:
        return self.orders[0].facts[6]

    @property
    def vocabulary(self) -> int:
        """Distinct tokens, the end included."""
        return self.orders[0].facts[5]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ by the closed form from counts of counts; ``FALLBACK`` where it can't hold."""
    if not (n1 and n2 and n3):
        return FALLBACK
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return d if all(0 <= x <= k for k, x in enumerate(d, 1)) else FALLBACK


def fit(texts: DataFrame, text_col: str = "text", order: int = ORDER, bucket_bytes: int = BUCKET_BYTES,
        buffer: int = BUFFER) -> Model:
    """Count ``texts`` and write the model into the shared folder.

    A null text counts as an empty one, which is an end alone; repeated rows count each;
    other columns are not read; of an empty table the model knows no word.  The driver
    gets one row a file: its path and the counts of counts.
    """
    spark = texts.sparkSession
    workers_ready(spark)
    column = texts.select(F.col(text_col).cast("string").alias("text"))
    size = column.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    folder = shared_folder(spark, "kneser-ney")
    rows = column.mapInArrow(count_texts(order, buckets, buffer), ROW)
    for level in range(order, 0, -1):
        rows = rows.repartitionById(buckets, F.col("bucket")).mapInArrow(write_level(folder, level, order, buckets, buffer), ROW)
    model = Model(order, buckets, [Order() for _ in range(order)])
    for r in rows.select("level", "bucket", "path", "facts").collect():
        held = model.orders[r["level"] - 1]
        held.paths[r["bucket"]] = r["path"]
        held.facts = [a + b for a, b in zip(held.facts, r["facts"])]
    return model


def _interpolated(a: np.ndarray, d: tuple) -> np.ndarray:
    """a - D(a), 0 for 0."""
    table = np.array([0.0, *d])
    return a - table[np.minimum(a, 3).astype(np.int64)]


def probabilities(model: Model, tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability, plain count) of every token of texts."""
    marked, place = with_starts(tokens, n, model.order)
    token = np.flatnonzero(place >= 1)
    base = model.orders[0]
    tables = [SortedTable(o.paths, model.buckets) for o in model.orders]
    total, kinds = base.facts[4], base.facts[5]

    def found(level: int, h: np.ndarray, names: list) -> list[np.ndarray]:
        unique, back = np.unique(h, return_inverse=True)
        return [v[back] for v in tables[level - 1].lookup(unique, unique, names)]

    raw, a = found(1, marked[token], ["raw", "adjusted"])
    p = np.full(len(token), 1.0 / (kinds + 1))
    if total:
        d = base.discounts
        ones, twos = base.facts[0], base.facts[1]
        p = (_interpolated(a, d) + (d[0] * ones + d[1] * twos + d[2] * (kinds - ones - twos)) * p) / total
    for m in range(2, model.order + 1):
        rows = np.flatnonzero(place[token] >= m - 1)  # tokens with m - 1 words or marks before
        at, d = token[rows], model.orders[m - 1].discounts
        words = [marked[at - back] for back in range(m - 1, -1, -1)]
        context = gram_hash(words[:-1])
        s, ones, twos, more = found(m - 1, context, ["total", "ones", "twos", "more"])
        a, = found(m, gram_hash(words), ["adjusted"])
        known = s > 0
        r, s = rows[known], s[known].astype(float)
        p[r] = (_interpolated(a[known], d) + (d[0] * ones[known] + d[1] * twos[known] + d[2] * more[known]) * p[r]) / s
    return p, raw


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_tokens, n_known (tokens that training has),
    train_tokens, base_score (log10 probability by smoothed word counts), score (by the
    model), perplexity.

    A null text counts as empty: its end alone is scored.  Null and repeated ids have rows;
    other columns are not read; an empty table has no rows.
    """
    workers_ready(docs.sparkSession)
    train, kinds = model.train_tokens, model.vocabulary

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in chunks(texts):
                tokens, n = hashed_tokens(texts.slice(lo, hi - lo))
                p, raw = probabilities(model, tokens, n)
                at = np.cumsum(n) - n
                log = np.add.reduceat(np.log10(p), at)
                base = np.add.reduceat(np.log10((raw + 0.5) / (train + 0.5 * (kinds + 1))), at)
                known = np.add.reduceat((raw > 0).astype(np.int64), at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(known), pa.array(np.full(len(n), train)),
                     pa.array(base), pa.array(log), pa.array(10.0 ** (-log / n))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, "
                                "score double, perplexity double")


def fold_of(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id's text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
