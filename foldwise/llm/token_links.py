"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes.

Both tokenizers cut the same bytes.  Where a token of each ends at the same byte, the
text is cut into groups; every A token of a group is linked with every B token of it.

Merging is in lockstep: the texts of a batch are lanes of one state vector, each with
a pointer into its A and one into its B tokens.  A step compares the ends of all lanes'
current tokens, moves the pointer that is behind (both, where they end together, which
is a cut), emits the cuts and the links of the groups that they close, and drops the
lanes that are through.  A long text is several lanes, parted at ends that both
tokenizers have (probed at every ``LANE``-th token), so a batch takes about ``LANE``
steps however long its longest text is.

Links are counted over the corpus: tasks pre-aggregate the id pairs of each document,
buckets of the A id merge them and mark each A id's most frequent partners, and the
counts lie in sorted arrays that the second pass maps into memory.  An A id has at most
as many partners as B has ids, which bounds a bucket.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.bpe import PLAIN, MemoEncoder, _byte_letters
from foldwise.llm.common import shared_folder, workers_ready
from foldwise.llm.shared_arrays import SortedTable, bucket_of, mixed, pack, unpack, write_arrays

#: A tokens of a lane
LANE = 256
#: lanes that run at a time
LANES = 8_192
#: bytes of text that are aligned at a time
CHUNK = 3 << 20
#: words that a worker remembers before it starts anew, at about 150 bytes a word, and new ones that
#: are encoded in one text
MEMO_WORDS, WORDS_AT_A_TIME = 400_000, 20_000
#: links of a group that are listed one by one; larger groups are counted by distinct ids
LISTED = 1 << 12
#: id pairs that a task holds while it counts
BUFFER = 2_000_000
#: bytes of text a bucket of pair counts, and the most buckets (an A id's pairs share one)
BUCKET_BYTES, MOST_BUCKETS = 256 << 20, 4_096
#: id pairs that are looked up at a time
LOOKED_UP = 1_000_000

_READY: dict = {}


# ------------------------------------------------------------------ tokens and their bytes

class Tokenizers:
    """Ids of space + text by both, and the bytes of each id.

    ``a_path`` is a byte-level BPE of the ``tokenizers`` library, ``b_path`` a model of
    ``sentencepiece`` that adds the space itself.  Neither joins a word to the one before
    it, so the ids of a plain text (single spaces and line ends between visible Latin
    characters) are those of its words.  Words are encoded together, in one text of those
    that are new, and remembered; other texts go through the libraries whole.
    """

    def __init__(self, a_path: str, b_path: str, memo_words: int = MEMO_WORDS):
        import sentencepiece
        self.a = MemoEncoder(a_path, 0)
        self.a.tok.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {c: b for b, c in _byte_letters().items()}
        size = self.a.tok.get_vocab_size()
        self.a_bytes = [bytes(letters[c] for c in t) if t is not None and all(c in letters for c in t) else (t or "").encode()
                        for t in map(self.a.tok.id_to_token, range(size))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        hexed = re.compile("<0x([0-9A-F]{2})>")
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := hexed.fullmatch(p)) and self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.memoizes = self.a.memoizes and not any(re.search("[^▁]▁|\n", p) for p in pieces)
        self.memo_words = memo_words
        self._forget()

    def _forget(self) -> None:
        """``memo``: word -> its row of the ragged arrays of ids."""
        self.memo: dict = {}
        self.n_rows = 0
        self.ids = [[np.empty(0, np.int32)] for _ in range(2)]
        self.counts = [[np.empty(0, np.int32)] for _ in range(2)]

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """By the libraries; None where the text isn't what its tokens join to."""
        a, b = self.a.tok.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw = (" " + text).encode()
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        return np.array(a, np.int32), np.array(b, np.int32)

    def _learn(self, words: list) -> bool:
        """Remember new plain words (one after a \n has it as its first character); the text of all
        of them is cut into their ids at the words' ends.  False if the libraries don't cut there."""
        words = sorted(words, key=lambda w: w[0] == "\n")  # the first follows a space
        if words[0][0] == "\n":
            words.insert(0, "a")
        text = "".join([w if w[0] == "\n" else " " + w for w in words])
        found = self.whole(text[1:])
        if found is None:
            return False
        ends = np.cumsum([len(w.encode()) + (w[0] != "\n") for w in words])
        for ids, size, kept, counts in zip(found, (self.a_size, self.b_size), self.ids, self.counts):
            token_ends = np.cumsum(size[ids])
            at = np.searchsorted(token_ends, ends)
            if (token_ends[at] != ends).any():
                return False
            kept.append(ids)
            counts.append(np.diff(np.r_[-1, at]).astype(np.int32))
        for row, w in enumerate(words, self.n_rows):
            self.memo.setdefault(w, row)
        self.n_rows += len(words)
        return True

    def _rows(self, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these rows, one after another, and the numbers of ids."""
        self.ids[k], self.counts[k] = [np.concatenate(self.ids[k])], [np.concatenate(self.counts[k])]
        counts, ids = self.counts[k][0], self.ids[k][0]
        starts = np.cumsum(counts) - counts
        n = counts[rows].astype(np.int64)
        at = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return ids[at], n

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, B ids, A tokens of each text, B tokens of each text); a text that is null, empty,
        or not what its tokens join to has none."""
        keys = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        plain = [bool(k) and self.memoizes for k in keys]
        if self.n_rows > self.memo_words:
            self._forget()
        new = {w for k, p in zip(keys, plain) if p for w in k if w not in self.memo}
        odd = {w for w in new if not PLAIN.fullmatch(w)}
        if odd:
            plain = [p and odd.isdisjoint(k) for k, p in zip(keys, plain)]
            new = {w for k, p in zip(keys, plain) if p for w in k if w not in self.memo}
        new = sorted(new)
        for at in range(0, len(new), WORDS_AT_A_TIME):
            if not self._learn(new[at:at + WORDS_AT_A_TIME]):
                self._forget()
                plain = [False] * len(texts)
                break
        rows = np.fromiter((self.memo[w] for k, p in zip(keys, plain) if p for w in k), np.int64)
        per_text = np.array([len(k) if p else 0 for k, p in zip(keys, plain)], np.int64)
        out = []
        others = {i: self.whole(t) for i, (t, p) in enumerate(zip(texts, plain)) if t and not p}
        for k in (0, 1):
            ids, n = self._rows(k, rows)
            upto = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(per_text)]]
            per = np.diff(upto)
            if others:
                parts, last = [], 0
                for i, found in others.items():
                    parts += [ids[last:upto[i]]] + ([found[k]] if found else [])
                    last, per[i] = upto[i], len(found[k]) if found else 0
                ids = np.concatenate(parts + [ids[last:]])
            out.append((ids.astype(np.int64), per))
        return out[0][0], out[1][0], out[0][1], out[1][1]


def tokenizers(a_path: str, b_path: str, memo_words: int = MEMO_WORDS) -> Tokenizers:
    """The worker's, made once per process."""
    key = a_path, b_path, memo_words
    if key not in _READY:
        _READY[key] = Tokenizers(*key)
    return _READY[key]


# ------------------------------------------------------------------ lockstep

def lanes(a_end: np.ndarray, b_end: np.ndarray, a_docs: np.ndarray, b_docs: np.ndarray, lane: int = LANE):
    """(first A token, first B token, A token after the last) of each lane.  ``a_end`` and
    ``b_end`` rise over the whole batch; ``a_docs`` and ``b_docs`` are the first tokens of
    the documents, and the number of tokens last."""
    starts = [a_docs[:-1]]
    n = np.diff(a_docs)
    probes = np.repeat(a_docs[:-1], n // lane)
    if len(probes):
        k = np.arange(len(probes)) - np.repeat(np.cumsum(n // lane) - n // lane, n // lane)
        probes = probes + (k + 1) * lane - 1  # tokens that may end a lane
        at = np.minimum(np.searchsorted(b_end, a_end[probes]), len(b_end) - 1)
        starts.append(probes[b_end[at] == a_end[probes]] + 1)
    a = np.unique(np.concatenate(starts))
    a = a[a < len(a_end)]
    b = np.where(a > 0, np.searchsorted(b_end, a_end[a - 1], side="right"), 0)
    return a, b, np.append(a[1:], len(a_end))


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a: np.ndarray, b: np.ndarray, stop: np.ndarray):
    """Merge all lanes at once; both tokens of every lane's last step end together.

    Returns (links of A and of B tokens; groups as first and last A and B token; those
    groups of over ``LISTED`` links, whose links aren't listed)."""
    a, b = a.copy(), b.copy()
    a0, b0 = a.copy(), b.copy()
    links, groups, large = [], [], []
    while len(a):
        ends = a_end[a], b_end[b]
        cut = ends[0] == ends[1]
        at = np.flatnonzero(cut)
        if len(at):
            fa, la, fb, lb = a0[at], a[at], b0[at], b[at]
            groups.append((fa, la, fb, lb))
            n_a, n_b = la - fa + 1, lb - fb + 1
            n = n_a * n_b
            single = n == 1
            links.append((la[single], lb[single]))
            if not single.all():
                many = np.flatnonzero(~single & (n <= LISTED))
                rep = np.repeat(many, n[many])
                off = np.arange(len(rep)) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
                links.append((fa[rep] + off // n_b[rep], fb[rep] + off % n_b[rep]))
                large += [(int(fa[k]), int(la[k]), int(fb[k]), int(lb[k])) for k in np.flatnonzero(n > LISTED)]
        step_a, step_b = ends[0] <= ends[1], ends[1] <= ends[0]
        a, b = a + step_a, b + step_b
        a0, b0 = np.where(cut, a, a0), np.where(cut, b, b0)
        going = a < stop
        if not going.all():
            a, b, a0, b0, stop = (x[going] for x in (a, b, a0, b0, stop))
    empty = [np.empty(0, np.int64)]
    return ([np.concatenate(empty + [x[i] for x in links]) for i in (0, 1)],
            [np.concatenate(empty + [x[i] for x in groups]) for i in range(4)], large)


def _sum_keys(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k = k[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[starts], np.add.reduceat(c[order], starts)


def align(a_ids: np.ndarray, b_ids: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, n_a: np.ndarray, n_b: np.ndarray,
          lane: int = LANE):
    """Align a batch of documents with these ids, sizes of ids in bytes, and numbers of tokens.

    Returns groups (first and last A and B token, by first A token) and, of every document's
    distinct id pairs, the document, the pair (A id * B's ids + B id) and its links."""
    a_end, b_end = np.cumsum(a_size[a_ids]), np.cumsum(b_size[b_ids])
    a_docs, b_docs = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
    width = np.int64(len(b_size))
    per_doc = np.int64(len(a_size)) * width
    doc_of = np.repeat(np.arange(len(n_a)), n_a)
    a, b, stop = lanes(a_end, b_end, a_docs, b_docs, lane)
    keys, counts, groups = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
    for at in range(0, len(a), LANES):
        run = slice(at, at + LANES)
        (la, lb), cuts, large = lockstep(a_end, b_end, a[run], b[run], stop[run])
        groups.append(cuts)
        key = doc_of[la] * per_doc + a_ids[la] * width + b_ids[lb]
        k, c = _sum_keys([key], [np.ones(len(key), np.int64)])
        keys.append(k)
        counts.append(c)
        for fa, ta, fb, tb in large:
            (ia, ca), (ib, cb) = (np.unique(x, return_counts=True) for x in (a_ids[fa:ta + 1], b_ids[fb:tb + 1]))
            keys.append((doc_of[fa] * per_doc + ia[:, None] * width + ib[None, :]).ravel())
            counts.append((ca[:, None] * cb[None, :]).ravel())
    key, count = _sum_keys(keys, counts)
    groups = [np.concatenate([np.empty(0, np.int64)] + [g[i] for g in groups]) for i in range(4)]
    order = np.argsort(groups[0])
    return [g[order] for g in groups], key // per_doc, key % per_doc, count


class GroupText:
    """The text ``a1,a2|b1;a3|b2,b3`` of groups, by a table of each id with what may follow it."""

    def __init__(self, n_a: int, n_b: int):
        import pyarrow as pa
        self.b_from = 2 * n_a
        self.table = pa.array([x for n, ends in ((n_a, b",|"), (n_b, b",;")) for i in range(n) for x in (b"%d%c" % (i, ends[0]), b"%d%c" % (i, ends[1]))],
                              pa.large_binary())

    def of(self, a_ids, b_ids, groups, n_a: np.ndarray, n_b: np.ndarray) -> list:
        """Of each document, as memory views; empty for one without tokens."""
        import pyarrow as pa
        fa, la, fb, lb = groups
        items = np.empty(len(a_ids) + len(b_ids), np.int64)
        sizes_a, sizes_b = la - fa + 1, lb - fb + 1
        a_code, b_code = 2 * a_ids, self.b_from + 2 * b_ids
        a_code[la] += 1
        b_code[lb] += 1
        items[np.arange(len(a_ids)) + np.repeat(fb, sizes_a)] = a_code
        items[np.arange(len(b_ids)) + np.repeat(la + 1, sizes_b)] = b_code
        written = self.table.take(pa.array(items))
        _, offsets, data = written.buffers()
        offsets = np.frombuffer(offsets, np.int64)[:len(items) + 1]
        edges = offsets[np.r_[0, np.cumsum(n_a + n_b)]].tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        return [view[s:max(s, e - 1)] for s, e in zip(edges[:-1], edges[1:])]


def packed_lists(values: np.ndarray, edges: np.ndarray, kind: str):
    """An Arrow array of binary: the values between each two edges, little-endian."""
    import pyarrow as pa
    raw = values.astype(kind).tobytes()
    offsets = (edges * np.dtype(kind).itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())


def unpacked(column, kind: str) -> np.ndarray:
    """All values of such an array, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


# ------------------------------------------------------------------ over the corpus

ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, size long, pairs binary, links binary"
#: of a packed pair and of its links
PAIR, LINKS = "<i8", "<u4"


def _align_rows(a_path: str, b_path: str, spans: bool):
    def run(batches):
        import pyarrow as pa

        from foldwise.llm.kneser_ney import chunks
        both = tokenizers(a_path, b_path)
        text_of = _READY.setdefault((a_path, b_path), GroupText(len(both.a_bytes), len(both.b_bytes)))
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in chunks(texts, CHUNK):
                a_ids, b_ids, n_a, n_b = both.encode(texts.slice(lo, hi - lo).to_pylist())
                groups, doc, pair, count = align(a_ids, b_ids, both.a_size, both.b_size, n_a, n_b)
                written = text_of.of(a_ids, b_ids, groups, n_a, n_b)
                edges = np.searchsorted(doc, np.arange(hi - lo + 1))
                links = np.r_[0, np.cumsum(count)]
                of = np.searchsorted(groups[0], np.r_[0, np.cumsum(n_a)])
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(n_a), pa.array(n_b), pa.array(np.diff(of)),
                           pa.array(links[edges[1:]] - links[edges[:-1]]),
                           pa.array([hashlib.sha256(w).hexdigest() if w else "" for w in written]),
                           pa.array(np.diff(edges)), packed_lists(pair, edges, PAIR), packed_lists(count, edges, LINKS)]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "size", "pairs", "links"]
                if spans:
                    columns.append(pa.array([bytes(w).decode() for w in written]))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
            spans: bool = True) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, size (distinct
    id pairs), pairs and links (little-endian numbers: A id * B's ids + B id, 8 bytes, rising,
    and how often it is linked, 4 bytes), and with ``spans`` the groups as text.  Texts that are null, empty, or not the bytes of their tokens have zeros and ''."""
    workers_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_align_rows(a_path, b_path, spans), f"doc_id {kind}, {ALIGNED}" + ", groups string" * spans)


def count_pairs(pairs: DataFrame, n_a: int, n_b: int, buckets: int, buffer: int = BUFFER) -> SortedTable:
    """Documents of each id pair, from a frame with a column ``pairs``, in files of the shared
    folder: key, count, best (1 for the most frequent pairs of its A id).  The driver gets a row a file."""
    width = np.uint64(n_b)

    def rows(keys, counts):
        import pyarrow as pa
        k, c = _sum_keys(keys, counts)
        of = bucket_of(mixed(k // width), buckets)
        order = np.argsort(of, kind="stable")
        of, k, c = of[order], k[order], c[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
        packed = [pack([k[s:e], c[s:e]]) for s, e in zip(starts[:-1], starts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(of[starts[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    def count(batches):
        keys, counts, held = [], [], 0
        for batch in batches:
            for raw in batch.column(0):
                keys.append(np.frombuffer(raw.as_py(), PAIR).astype(np.uint64))
                counts.append(np.ones(len(keys[-1]), np.uint64))
                held += len(keys[-1])
                if held >= buffer:
                    k, c = _sum_keys(keys, counts)
                    if 2 * len(k) > buffer:  # else go on with the sums
                        yield rows([k], [c])
                        k, c = k[:0], c[:0]
                    keys, counts, held = [k], [c], len(k)
        if held:
            yield rows(keys, counts)

    spark = pairs.sparkSession
    folder = shared_folder(spark, "token-links")

    def write(batches):
        import pyarrow as pa

        def close(bucket, keys, counts):
            k, c = _sum_keys(keys, counts)
            starts = np.flatnonzero(np.r_[True, k[1:] // width != k[:-1] // width])  # sorted by A id first
            best = np.repeat(np.maximum.reduceat(c, starts), np.diff(np.r_[starts, len(k)]))
            path = write_arrays(folder, bucket, {"key": k, "count": c, "best": (c == best).astype(np.uint64)})
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([path])], names=["bucket", "path"])

        bucket, keys, counts, held = None, [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.column(0)[i].as_py()
                if keys and b != bucket:
                    yield close(bucket, keys, counts)
                    keys, counts, held = [], [], 0
                k, c = unpack(batch.column(1)[i].as_py())
                bucket = b
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held >= buffer:
                    k, c = _sum_keys(keys, counts)
                    keys, counts, held = [k], [c], 0
        if keys:
            yield close(bucket, keys, counts)

    sent = pairs.select("pairs").mapInArrow(count, "bucket int, packed binary")
    files = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(write, "bucket int, path string")
    return SortedTable({r["bucket"]: r["path"] for r in files.collect()}, buckets)


def link_report(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is
    the most frequent of its A id in the corpus, ties included), count_sum (the pairs' documents,
    summed over links), groups_sha256.

    Null and empty texts and those that aren't the bytes of their tokens have zeros and '';
    repeated rows count each as a document; null ids have rows; other columns are not read;
    an empty table has no rows.  Alignments are kept in the shared folder between the passes.
    """
    spark = docs.sparkSession
    both = tokenizers(a_path, b_path)
    n_a, n_b = len(both.a_bytes), len(both.b_bytes)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    folder = shared_folder(spark, "token-alignment")
    aligned(docs, a_path, b_path, id_col, text_col, spans=False).write.parquet(folder)
    kept = spark.read.parquet(folder)
    table = count_pairs(kept, n_a, n_b, min(MOST_BUCKETS, max(1, math.ceil(size / bucket_bytes))))
    width = np.uint64(n_b)

    def run(batches):
        import pyarrow as pa
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        for whole in batches:
            part = np.cumsum(whole.column("size").to_numpy()) // LOOKED_UP
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            for batch in (whole.slice(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:])):
                n = batch.column("size").to_numpy()
                keys, links = unpacked(batch.column("pairs"), PAIR).astype(np.uint64), unpacked(batch.column("links"), LINKS).astype(np.uint64)
                unique, back = np.unique(keys, return_inverse=True)
                count, best = (v[back] for v in table.lookup(unique, mixed(unique // width), ["count", "best"]))
                sums = [np.r_[np.uint64(0), np.cumsum(links * v)] for v in (best, count)]
                ends = np.cumsum(n)
                out = [pa.array((s[ends] - s[ends - n]).astype(np.int64)) for s in sums]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:5]] + out + [batch.column(names[-1])], names=names)

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                             "count_sum long, groups_sha256 string")
