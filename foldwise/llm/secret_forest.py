"""Secret scans: a wide net of candidates, and a random forest that removes the
false positives.

A candidate is a long run of ASCII letters and digits, a value that is assigned to a
credential's name or stands after Bearer, or the password in a URL.  Its features are
its length, its character transitions, how much of it a dictionary covers, the
document's path and the words beside it.  The
forest is fitted by Spark ML on labelled findings, a bounded sample of them, and
carried to the tasks as arrays; scanning is one pass over the texts, row by row,
without a shuffle.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import keep, workers_ready

#: different labelled findings of each label that the forest is fitted on at most
SAMPLE = 10_000
TREES, DEPTH, SEED = 24, 7, 11
#: share of the trees' votes from which a candidate is a secret
VOTES = 0.5
MARK = "[SECRET]"

#: fixed values: words that name a credential, and words that name a placeholder
CREDENTIALS = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "access_key", "auth",
               "authorization", "bearer", "credential", "credentials", "private")
PLACEHOLDERS = ("example", "sample", "dummy", "fake", "placeholder", "changeme", "test", "your", "xxx")
#: fixed values: parts of a path where secrets are made up, and where they are kept
MADE_UP_PATHS = ("test", "example", "sample", "mock", "fixture", "doc")
CONFIG_PATHS = (".env", "conf", ".yml", ".yaml", ".ini", ".properties", ".pem", "settings", "secret", "credential")

RUN = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_+/\-]{20,}={0,2}(?![A-Za-z0-9_=])")
ASSIGNED = re.compile(r"(?i:(?:password|passwd|pass[_-]?phrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credentials?)"
                      r"[\"']?\s{0,2}[:=]{1,2}\s{0,2}[\"']?([^\s\"'`,;<>(){}\[\]]{7,}))")
#: a value of an Authorization header, and one with a digit after Bearer anywhere
HEADER = re.compile(r"(?i:authorization[\"']?\s{0,2}[:=]\s{0,2}[\"']?(?:bearer|basic|token)\s{1,2}([A-Za-z0-9_+/.~\-]{4,}={0,2}))")
BEARER = re.compile(r"(?i:(?<![A-Za-z0-9_])bearer\s{1,2}(?=[A-Za-z_+/.~\-]{0,200}[0-9])([A-Za-z0-9_+/.~\-]{6,}={0,2}))")
#: the password of a URL's user
IN_URL = re.compile(r"://[^\s/:@\"'<>]{0,64}:([^\s/@\"'<>]{3,256})@")
#: one of these is in every text with an assigned value
NAMES = ("passw", "passp", "pass_", "pass-", "pwd", "secret", "token", "api", "access", "auth", "credential")
#: characters beside a candidate that are read for neighbouring words
BESIDE = 80

FEATURES = ("length", "transitions", "digits", "capitals", "entropy", "letter_pairs", "dictionary", "made_up_path",
            "config_path", "credential_before", "placeholder_beside", "assigned", "quoted", "dictionary_beside")


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates in a whole text, in order; of two that overlap, the
    one that starts first, or else the longer one."""
    spans = [m.span() for m in RUN.finditer(text)]
    low = text.lower()
    if any(n in low for n in NAMES):
        spans += [m.span(1) for m in ASSIGNED.finditer(text)]
    if "bearer" in low or "authorization" in low:
        spans += [m.span(1) for p in (HEADER, BEARER) for m in p.finditer(text)]
    if "://" in text and "@" in text:
        spans += [m.span(1) for m in IN_URL.finditer(text)]
    out, last = [], 0
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= last:
            out.append((start, end))
            last = end
    return out


class Dictionary:
    """Words of at least four letters from a vocabulary file of a word tokenizer, and
    how likely a letter follows another in them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        whole = (w.removesuffix("</w>") for w in vocabulary if w.endswith("</w>"))
        self.words = frozenset(w for w in whole if len(w) >= 4 and w.isascii() and w.isalpha())
        self.longest = 12
        pairs = Counter(p for w in self.words for p in zip(w, w[1:]))
        first = Counter()
        for (a, _), n in pairs.items():
            first[a] += n
        self.pairs = {a + b: math.log((n + 1) / (first[a] + 26)) for (a, b), n in pairs.items()}

    def coverage(self, s: str) -> float:
        """Share of the characters that the longest words, from left to right, cover."""
        at = covered = 0
        while at < len(s):
            for n in range(min(self.longest, len(s) - at), 3, -1):
                if s[at:at + n] in self.words:
                    covered += n
                    at += n
                    break
            else:
                at += 1
        return covered / len(s) if s else 0.0


_DICTIONARIES: dict = {}


def dictionary(path: str) -> Dictionary:
    if path not in _DICTIONARIES:
        _DICTIONARIES[path] = Dictionary(path)
    return _DICTIONARIES[path]


def _kind(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def features(text: str, start: int, end: int, path: str | None, words: Dictionary) -> list[float]:
    """Of the candidate ``text[start:end]``, in the order of ``FEATURES``."""
    value = text[start:end]
    n = len(value)
    kinds = [_kind(c) for c in value]
    counts = Counter(value)
    low = value.lower()
    letters = [words.pairs.get(low[i:i + 2], -6.0) for i in range(n - 1) if low[i:i + 2].isalpha()]
    before, after = text[max(0, start - BESIDE):start], text[end:end + BESIDE]
    left = re.findall(r"[a-z_]+", before.lower())[-4:]
    right = re.findall(r"[a-z_]+", after.lower())[:4]
    where = (path or "").lower()
    beside = [w for w in left + right if len(w) >= 4]
    return [
        float(end - start),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        kinds.count(2) / n,
        kinds.count(1) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        sum(letters) / len(letters) if letters else -6.0,
        words.coverage(low),
        float(any(p in where for p in MADE_UP_PATHS)),
        float(any(p in where for p in CONFIG_PATHS)),
        float(any(w.strip("_") in CREDENTIALS for w in left)),
        float(any(w.strip("_") in PLACEHOLDERS for w in left + right) or any(p in low for p in PLACEHOLDERS[:6])),
        float(before.rstrip(" \"'")[-1:] in (":", "=") and bool(before.strip())),
        float(before[-1:] in "\"'`" and before[-1:] == after[:1] and bool(before)),
        sum(w in words.words for w in beside) / max(1, len(beside)),
    ]


# ------------------------------------------------------------------ the forest

@dataclass
class Forest:
    """Trees as arrays: for each tree feature (-1: a leaf), threshold, left, right, vote.
    ``alone``: the share of votes where there are no trees."""
    trees: list = field(default_factory=list)
    alone: float = 0.0

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Share of the trees that vote for a secret."""
        if not self.trees or not len(x):
            return np.full(len(x), self.alone)
        total = np.zeros(len(x))
        for feature, threshold, left, right, vote in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes_left = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += vote[at]
        return total / len(self.trees)


def _arrays(root) -> tuple:
    """A fitted tree's nodes as arrays (at most 2 ** (DEPTH + 1) of them)."""
    nodes: list = []

    def walk(node) -> int:
        at = len(nodes)
        nodes.append(None)
        if node.subtreeDepth() == 0:
            nodes[at] = (-1, 0.0, 0, 0, node.prediction())
        else:
            split = node.split()
            left, right = walk(node.leftChild()), walk(node.rightChild())
            nodes[at] = (split.featureIndex(), split.threshold(), left, right, 0.0)
        return at

    walk(root)
    f, t, l, r, v = zip(*nodes)
    return np.array(f), np.array(t), np.array(l), np.array(r), np.array(v)


def fit_forest(labelled: DataFrame, dictionary_path: str, sample: int = SAMPLE) -> Forest:
    """``labelled`` (text, start, end, path, secret 0/1) -> a forest.

    At most ``sample`` different findings of each label are used, those with the smallest
    hashes of the row; a finding that many rows repeat counts once.  Rows with a null
    text, span or label, or an empty span, are left out.
    Findings of one label only leave nothing to tell apart: the forest has no trees,
    and calls no candidate a secret if no finding was one (or there is no finding, so
    that nothing is redacted unseen), every candidate if each finding was.
    The labelled rows are read once.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    spark = labelled.sparkSession
    workers_ready(spark)
    columns = ["text", "start", "end", "path", "secret"]
    rows = keep(labelled.select(*columns).where(
        "text is not null and start >= 0 and end > start and end <= length(text) and secret in (0, 1)").distinct())

    def run(batches):
        import pyarrow as pa
        known = dictionary(dictionary_path)
        for batch in batches:
            x = [features(t, s, e, p, known) for t, s, e, p in zip(*(batch.column(i).to_pylist() for i in range(4)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.float64())), batch.column(4).cast(pa.float64())], names=["x", "secret"])

    labels = {r["secret"] for r in rows.select("secret").distinct().collect()}
    if len(labels) < 2:
        return Forest(alone=float(max(labels, default=0)))
    drawn = [rows.where(F.col("secret") == k).orderBy(F.xxhash64(*columns), *columns).limit(sample) for k in (0, 1)]
    x = keep(drawn[0].unionByName(drawn[1]).mapInArrow(run, "x array<double>, secret double"))
    learner = RandomForestClassifier(featuresCol="f", labelCol="secret", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
                                     minInstancesPerNode=2)
    model = learner.fit(x.coalesce(4).select(array_to_vector("x").alias("f"), "secret"))
    return Forest([_arrays(t._java_obj.rootNode()) for t in model.trees])


# ------------------------------------------------------------------ scans

def _secrets(texts, paths, forest: Forest, known: Dictionary, votes: float):
    """For each text its (start, end, share of votes), secrets only."""
    spans, x = [], []
    for i, (text, path) in enumerate(zip(texts, paths)):
        for s, e in candidates(text) if text else ():
            spans.append((i, s, e))
            x.append(features(text, s, e, path, known))
    out: list = [[] for _ in texts]
    shares = forest.votes(np.array(x).reshape(-1, len(FEATURES)))
    for (i, s, e), share in zip(spans, shares.tolist()):
        if share >= votes:
            out[i].append((s, e, share))
    return out


def scan(docs: DataFrame, forest: Forest, dictionary_path: str, id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = None, votes: float = VOTES) -> DataFrame:
    """A row per secret: doc_id, start, end (characters), masked (a quarter of it, four characters
    at most, and dots), score.

    Null and empty texts hold none; a null path is an unknown one; repeated rows have
    their findings each; other columns are not read; an empty table has no rows.
    """
    workers_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       (F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")).alias("path"))

    def run(batches):
        import pyarrow as pa
        known = dictionary(dictionary_path)
        for batch in batches:
            ids, texts, paths = (batch.column(i).to_pylist() for i in range(3))
            found = _secrets(texts, paths, forest, known, votes)
            flat = [(d, s, e, t[s:s + min(4, (e - s) // 4)] + "...", v) for d, t, f in zip(ids, texts, found) for s, e, v in f]
            if flat:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat), kinds)],
                                                 names=["doc_id", "start", "end", "masked", "score"])

    return rows.mapInArrow(run, "doc_id long, start long, end long, masked string, score double")


def redact(docs: DataFrame, forest: Forest, dictionary_path: str, text_col: str = "text", path_col: str | None = None,
           votes: float = VOTES, mark: str = MARK) -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mark``; all rows and all other
    columns stay as they were.  Null and empty texts, and texts without secrets, stay too; a
    null path is an unknown one; an empty table stays empty."""
    workers_ready(docs.sparkSession)
    at = docs.columns.index(text_col)
    path_at = docs.columns.index(path_col) if path_col else None

    def run(batches):
        import pyarrow as pa
        known = dictionary(dictionary_path)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            paths = batch.column(path_at).to_pylist() if path_at is not None else [None] * len(texts)
            for i, spans in enumerate(_secrets(texts, paths, forest, known, votes)):
                for s, e, _ in reversed(spans):
                    texts[i] = texts[i][:s] + mark + texts[i][e:]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
