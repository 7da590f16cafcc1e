"""SimHash near-duplicates, linked through a generalised pigeonhole search.

A text's fingerprint has bit b set where over half the hashes of its word
shingles have it set.  Two texts link where their fingerprints differ in at most
``distance`` bits; a component is what links reach.

The search works on distinct fingerprints, each once.  The 64 bits are put into
``m`` parts so that correlated bits share a part.  If thresholds t_1..t_m sum to
``distance - m + 1`` then any two fingerprints within ``distance`` are within
t_i in some part i (a part with t_i = -1 isn't probed).  So every fingerprint
may use thresholds of its own: dynamic programming over the parts takes those
with the fewest expected candidates, given how many fingerprints share each of
its part values.  A fingerprint in a crowded part spends its budget on the
others.  Its probes, all values within t_i of its own in part i, join the part
values of all fingerprints; every candidate pair is verified on all 64 bits.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import free_names, keep, workers_ready
from foldwise.llm.components import connected_components

BITS = 64
#: a part value shared by so many times the mean has its own count in the estimates
CROWDED = 8
#: hashes of a text that are counted at a time
BLOCK = 1 << 16


# ------------------------------------------------------------------ fingerprints

def fingerprint(text: str | None, shingle: int) -> int:
    """Of a whole text: A-Z lower-cased, words between ASCII white space, shingles of
    ``shingle`` words with repeats (fewer words: the whole sequence), XXH64 with
    seed 42.  No word: 0.  As a signed 64-bit number."""
    import xxhash
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at:at + BLOCK]
        hashes = np.fromiter([digest(s, 42) for s in part], dtype="<u8", count=len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text",
                 carried: dict | None = None) -> DataFrame:
    """(doc_id, fp) and the ``carried`` columns (name -> a long): a row per row of ``docs``."""
    names = list(carried or {})
    workers_ready(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *(carried[n].alias(n) for n in names))
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{n} long" for n in names)]))


# ------------------------------------------------------------------ parts and thresholds

def bit_pairs(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(number of rows, 64 x 64 counts of rows with both bits set), over all rows."""
    def run(batches):
        import pyarrow as pa
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 1 << 14):
                total += bits[at:at + (1 << 14)].T @ bits[at:at + (1 << 14)]
        at = np.arange(BITS * BITS)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel().astype(np.int64))], names=["at", "n"])

    rows = fps.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS, dtype=np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return fps.count(), out.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` parts of nearly equal width; a part starts at the free bit with the most
    correlation to the other free bits and takes the bit most correlated to it, again
    and again."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for i in range(m):
        width, rest = -(-len(free) // (m - i)), sorted(free)
        part = [max(rest, key=lambda b: corr[b, rest].sum())]
        while len(part) < width:
            part.append(max((b for b in rest if b not in part), key=lambda b: corr[b, part].sum()))
        parts.append(sorted(part))
        free -= set(part)
    return parts


def part_values(fps: np.ndarray, part: list[int]) -> np.ndarray:
    fps, out = fps.astype(np.uint64), np.zeros(len(fps), dtype=np.uint64)
    for j, b in enumerate(part):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out.view(np.int64)


def ball(width: int, radius: int) -> int:
    """Values within ``radius`` bits of one."""
    return sum(comb(width, r) for r in range(radius + 1))


def allocate(crowd: np.ndarray, widths: list[int], mean: list[float], distance: int) -> np.ndarray:
    """Thresholds for each row of ``crowd`` (rows x parts: fingerprints that share the
    row's part value), -1 to ``distance``, summing to ``distance - m + 1``, with the
    least estimated cost: a unit for every probe and every candidate, where a probe
    off the own value meets ``mean`` fingerprints.  Dynamic programming over parts."""
    n, m = crowd.shape
    levels = range(-1, distance + 1)
    cost = np.zeros((m, len(levels), n))
    for i in range(m):
        for t in range(distance + 1):
            cost[i, t + 1] = ball(widths[i], t) + crowd[:, i] + (ball(widths[i], t) - 1) * mean[i]
    goal = distance - m + 1
    best, choice = {0: np.zeros(n)}, []
    for i in range(m):
        step, taken = {}, {}
        for s, c in best.items():
            for t in levels:
                new = c + cost[i, t + 1]
                if s + t not in step:
                    step[s + t], taken[s + t] = new, np.full(n, t)
                else:
                    better = new < step[s + t]
                    step[s + t] = np.where(better, new, step[s + t])
                    taken[s + t] = np.where(better, t, taken[s + t])
        best = step
        choice.append(taken)
    out, left = np.zeros((n, m), dtype=np.int64), np.full(n, goal)
    for i in reversed(range(m)):
        for s, t in choice[i].items():
            out[:, i] = np.where(left == s, t, out[:, i])
        left = left - out[:, i]
    return out


def number_of_parts(n: int, distance: int) -> int:
    """With the least expected cost for a fingerprint among ``n`` evenly spread ones."""
    def cost(m):
        widths = [BITS // m + (i < BITS % m) for i in range(m)]
        mean = [n / 2.0 ** w for w in widths]
        t = allocate(np.array([mean]), widths, mean, distance)[0]
        return sum(ball(w, k) * (1 + n / 2.0 ** w) for w, k in zip(widths, t) if k >= 0)
    return min(range(1, distance + 2), key=cost)


# ------------------------------------------------------------------ links

def links(fps: DataFrame, distance: int) -> DataFrame:
    """``fps`` (fp long, distinct) -> (a, b), a < b: all pairs within ``distance`` bits."""
    n, both = bit_pairs(fps)
    m = number_of_parts(n, distance)
    parts = group_bits(n, both, m)
    widths = [len(p) for p in parts]
    mean = [n / 2.0 ** w for w in widths]

    def split(batches):
        import pyarrow as pa
        for batch in batches:
            own = batch.column(0).to_numpy()
            values = [pa.array(part_values(own, p)) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values], names=["fp", *(f"v{i}" for i in range(m))])

    wide = keep(fps.select("fp").mapInArrow(split, "fp long, " + ", ".join(f"v{i} long" for i in range(m))))
    index = wide.select("fp", F.posexplode(F.array(*(f"v{i}" for i in range(m)))).alias("part", "value"))
    counts = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    crowded = keep(counts.where(F.col("n") > F.array(*(F.lit(CROWDED * max(1.0, x)) for x in mean))[F.col("part")]))
    asked = wide
    for i in range(m):
        here = crowded.where(F.col("part") == i).select(F.col("value").alias(f"v{i}"), F.col("n").alias(f"n{i}"))
        asked = asked.join(here, f"v{i}", "left")
    asked = asked.select("fp", *(f"v{i}" for i in range(m)),
                         *(F.coalesce(F.col(f"n{i}").cast("double"), F.lit(mean[i])).alias(f"n{i}") for i in range(m)))
    masks = [[np.array([0], dtype=np.int64)] for _ in parts]
    for i, w in enumerate(widths):
        for r in range(1, distance + 1):
            more = [sum(1 << j for j in c) for c in combinations(range(w), r)]
            more = np.array([x - (1 << 64) if x >> 63 else x for x in more], dtype=np.int64)
            masks[i].append(np.concatenate([masks[i][-1], more]))

    def probe(batches):
        import pyarrow as pa
        for batch in batches:
            own = batch.column(0).to_numpy()
            crowd = np.stack([batch.column(1 + m + i).to_numpy() for i in range(m)], axis=1)
            levels = allocate(crowd, widths, mean, distance)
            for i in range(m):
                values = batch.column(1 + i).to_numpy()
                for t in range(distance + 1):
                    rows = np.flatnonzero(levels[:, i] == t)
                    step = max(1, 200_000 // len(masks[i][t]))
                    for at in range(0, len(rows), step):
                        some = rows[at:at + step]
                        probes = (values[some, None] ^ masks[i][t][None, :]).ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(probes), i, dtype=np.int32)), pa.array(probes),
                             pa.array(np.repeat(own[some], len(masks[i][t])))], names=["part", "value", "q"])

    probes = asked.mapInArrow(probe, "part int, value long, q long")
    found = probes.join(index, ["part", "value"]).where(
        (F.col("q") != F.col("fp")) & (F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= distance))
    return found.select(F.least("q", "fp").alias("a"), F.greatest("q", "fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, fingerprint (16 lowercase hex digits),
    component_id (the smallest id that links reach, the own one included).

    Null, empty and blank texts share the fingerprint zero.  Repeated rows are
    copies of each other.  A null id has a row, and names a component only if all
    ids in it are null.  Other columns are not read.  An empty table has no rows.
    """
    if distance < 0:
        raise ValueError("distance must not be negative")
    own = keep(fingerprints(docs, shingle, id_col, text_col))
    distinct = keep(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(links(distinct, distance))
    linked = roots.join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "rep")
    named = linked.join(linked.groupBy("root").agg(F.min("rep").alias("name")), "root").select("fp", "name")
    # kept, so that the last join has a plain exchange on both sides and splits a fingerprint of very many rows
    named = keep(distinct.join(named, "fp", "left").select("fp", F.coalesce("name", "rep").alias("component_id")))
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 3, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, null ids last,
    then the smallest hashes of its text and of the whole row.  So no component loses its
    last row, also where rows of different components share an id, and reruns agree.

    Null, empty and blank texts are one component; repeated rows are copies; an empty table
    stays empty; all columns stay as they were.
    """
    if distance < 0:
        raise ValueError("distance must not be negative")
    key, by_text, by_row = free_names(docs, "dedup_id", "dedup_text", "dedup_row")
    whole = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # those that have a hash
    hashes = {by_text: F.xxhash64(F.col(text_col).cast("string")), by_row: F.xxhash64(*whole)}
    own = keep(fingerprints(docs, shingle, id_col, text_col, hashes))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", by_text, by_row)).alias("first")
    firsts = keep(own.groupBy("fp").agg(first))
    roots = connected_components(links(firsts.select("fp"), distance))
    grouped = firsts.join(roots, F.col("node") == F.col("fp"), "left").select(F.coalesce("root", "fp").alias("component"), "first")
    stay = keep(grouped.groupBy("component").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("a"), F.col(f"first.{by_text}").alias("b"), F.col(f"first.{by_row}").alias("c")))
    rows = docs.withColumns({key: F.col(id_col).cast("long"), **hashes})
    kept = rows.join(stay, rows[key].eqNullSafe(stay["a"]) & (rows[by_text] == stay["b"]) & (rows[by_row] == stay["c"]), "left_semi")
    return kept.dropDuplicates([key, by_text, by_row]).select(*docs.columns)
