"""Exact top-k search by inner product, a block at a time.

Vectors are ordered so that similar ones are neighbours (by the nearest of a few
centres, fitted on a bounded sample) and cut into blocks, ranges of that order.  A
block keeps its vectors as a small matrix (a forward index) and the largest and
smallest value of every term.  A query's bound for a block sums, over the terms,
the query's weight times the term's maximum (minimum, for a negative weight).  Blocks
are scored from the greatest bound down until the bound falls below the k-th score,
which starts at the k-th score within the sample, so no better vector is left out.

Spark deals the blocks into ranges and the queries into groups; a task holds one range
and one group.  Each gives k candidates a query at most, and the k best of them are
the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import keep, workers_ready

#: vectors of the sample, centres, vectors of a block, of a range, queries of a group
SAMPLE, CENTRES, BLOCK, RANGE, GROUP = 2048, 48, 64, 16_384, 2048
SCALE = 256


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): floor(256 x) of every component, as longs.  Vectors that are null or
    hold a null or non-finite component, and null ids, are left out."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(
        v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def matrix(arrays, width: int) -> np.ndarray:
    """Rows of longs; shorter vectors end in zeros."""
    if all(len(a) == width for a in arrays):
        return np.array(arrays, dtype=np.int64).reshape(len(arrays), width)
    out = np.zeros((len(arrays), width), dtype=np.int64)
    for row, a in zip(out, arrays):
        row[:len(a)] = a
    return out


def find_centres(x: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Of the sample, by a few rounds of k-means from spread-out rows."""
    centres = x[np.linspace(0, len(x) - 1, min(CENTRES, len(x))).astype(int)]
    for _ in range(rounds):
        near = nearest(x, centres)
        centres = np.array([x[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


class Blocks:
    """A range of blocks; ``search`` prunes by bounds."""

    def __init__(self, rows):
        self.ids = [r[0] for r in rows]
        self.vectors = [r[1] for r in rows]
        self.high = np.stack([v.max(axis=0) for v in self.vectors]).astype(float)
        self.low = np.stack([v.min(axis=0) for v in self.vectors]).astype(float)
        self.visited = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        q = queries.astype(float)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        size = np.abs(q) @ np.maximum(np.abs(self.high), np.abs(self.low)).T
        # beyond 2^50 a sum of doubles may round below the exact one
        return up @ self.high.T + down @ self.low.T + np.where(size < 2.0 ** 50, 0.0, size * 1e-12)

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, floor: float, k: int):
        """(ids, scores) of the k best vectors but the query's own that score ``floor`` or more."""
        ids, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] < floor:
                break
            self.visited += 1
            s = self.vectors[b] @ query
            good = (s >= floor) & (self.ids[b] != query_id)
            if good.any():
                ids, scores = np.concatenate([ids, self.ids[b][good]]), np.concatenate([scores, s[good]])
                top = best_of(ids, scores, k)
                ids, scores = ids[top], scores[top]
                if len(scores) == k:
                    floor = max(floor, scores[-1])
        return ids, scores


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For every vector whose id is divisible by ``every``: query_id, rank (from 1), vec_id,
    score of its k best among all other vectors (fewer, if there are fewer).

    Vectors left out by ``quantised`` take no part; of different lengths, the shorter
    ends in zeros; a repeated id is a candidate for others in each of its rows, never for
    itself, and asks once, by its first row in the order of its components.  Other columns are not read; an empty table has no rows.
    """
    spark = vectors.sparkSession
    workers_ready(spark)
    vecs = keep(quantised(vectors, id_col, vector_col))
    n, width = vecs.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    some = vecs.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample_ids = np.array([r["vec_id"] for r in some], dtype=np.int64)
    sample = matrix([r["v"] for r in some], width)
    centres = find_centres(sample.astype(float)) if n else np.zeros((1, width))

    def place(batches):
        import pyarrow as pa
        for batch in batches:
            x = matrix(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest(x.astype(float), centres))],
                                             names=["vec_id", "v", "cell"])

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, held, cell = TaskContext.get().partitionId(), [], None

        def block():
            ids = np.array([h[0] for h in held], dtype="<i8")
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([ids.tobytes()]), pa.array([matrix([h[1] for h in held], width).tobytes()])],
                names=["part", "ids", "vectors"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (len(held) == BLOCK or row[2] != cell):
                    yield block()
                    held = []
                held.append(row)
                cell = row[2]
        if held:
            yield block()

    ranges = max(1, -(-n // RANGE))
    placed = vecs.mapInArrow(place, "vec_id long, v array<long>, cell long")
    blocks = keep(placed.repartitionByRange(ranges, "cell", "vec_id").sortWithinPartitions("cell", "vec_id").mapInArrow(
        cut, "part long, ids binary, vectors binary"))
    parts = [r["part"] for r in blocks.select("part").distinct().collect()]

    def ask(batches):
        import pyarrow as pa
        for batch in batches:
            ids = batch.column(0).to_pylist()
            x = matrix(batch.column(1).to_pylist(), width)
            floors = []
            for i, q in zip(ids, x):
                scores = np.sort((sample @ q)[sample_ids != i])
                floors.append(int(scores[-k]) if len(scores) >= k else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([q.tobytes() for q in x], pa.binary()), pa.array(floors, pa.int64())],
                names=["query_id", "q", "floor"])

    asked = vecs.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = keep(asked.mapInArrow(ask, "query_id long, q binary, floor long"))
    groups = max(1, -(-queries.count() // GROUP))
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups))
    left = queries.select("*", group.alias("grp"), F.explode(F.array(*map(F.lit, parts or [0])).cast("array<long>")).alias("part"))
    right = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"))

    def search(asked, held):
        import pyarrow as pa
        asked, held = asked.select(["query_id", "q", "floor"]).to_pylist(), held.select(["ids", "vectors"]).to_pylist()
        out: list = []
        if asked and held:
            blocks = Blocks([(np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["vectors"], "<i8").reshape(-1, width)) for b in held])
            for at in range(0, len(asked), 512):
                some = asked[at:at + 512]
                q = np.stack([np.frombuffer(a["q"], "<i8") for a in some])
                for a, query, bounds in zip(some, q, blocks.bounds(q)):
                    floor = -np.inf if a["floor"] is None else a["floor"]
                    ids, scores = blocks.search(a["query_id"], query, bounds, floor, k)
                    out += [(a["query_id"], i, s) for i, s in zip(ids.tolist(), scores.tolist())]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], names=["query_id", "vec_id", "score"])

    found = left.groupBy("part", "grp").cogroup(right.groupBy("part", "grp")).applyInArrow(
        search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # k rows a range
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
