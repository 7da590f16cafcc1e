"""The first rows of each group in a hashed order, marked without sorting the rows (K2-K4).

The order is (md5 of ``seed:key``, key).  The row up to which rows count is found by
histograms: rows of a group by the first 12 bits of the hash, then, of the bin that the cut
lies in, by the next 12; what is left of a group is a few keys (a 16-millionth of its rows),
and they are put in order with their numbers of rows, so a key that very many rows share is
one of them.  The cuts are a row a group, and marking a row compares it with its group's cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.scalar import hash_key
from foldwise.operators.lookup import bounded
from foldwise.operators.ordering import with_global_position
from foldwise.session import ensure_checkpoint_dir

#: bits of a histogram's bins, of which there are two levels, and hexadecimal digits of both
BITS, DIGITS = 12, 6


def _up_to(counts: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """``counts`` with ``_upto``, the rows of the group up to each row in order, its own included.
    The window runs over a group's bins or last keys."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("_upto", F.sum("_n").over(w))


def _hit(counts: DataFrame, groups: list[str], order: list[str], need: Column) -> DataFrame:
    """The row of each group that holds its ``need``-th row, and ``_need``, which of its own that is."""
    return _up_to(counts, groups, order).withColumn("_need", need).where(
        (F.col("_need") > F.col("_upto") - F.col("_n")) & (F.col("_need") <= F.col("_upto"))).withColumn(
        "_need", F.col("_need") - F.col("_upto") + F.col("_n"))


def _of(rows: DataFrame, table: DataFrame, groups: list[str]) -> list[Column]:
    return [rows[g].eqNullSafe(table[f"t{g}"]) for g in groups] or [F.lit(True)]


def _named(table: DataFrame, groups: list[str], **columns) -> DataFrame:
    return bounded(table.select(*[F.col(g).alias(f"t{g}") for g in groups], *[c.alias(n) for n, c in columns.items()]))


def cuts(df: DataFrame, take: Callable[[Column], Column], seed: int, key: str, by=()) -> DataFrame:
    """A row per group with rows to take: ``_g0``, ... (the group, values of ``by``), the last row taken
    as ``_h`` (md5) and ``_k`` (key), ``_need`` of the ``_n`` rows equal to it."""
    ensure_checkpoint_dir(df.sparkSession)
    groups = [f"_g{i}" for i in range(len(by))]
    h = F.coalesce(hash_key(seed, key), F.lit(""))
    prefix = F.coalesce(F.conv(F.substring("_h", 1, DIGITS), 16, 10).cast("long"), F.lit(0))
    rows = df.select(*[F.col(b).alias(g) for b, g in zip(by, groups)], h.alias("_h"), F.col(key).alias("_k")).withColumn(
        "_p", prefix).checkpoint()
    count = F.count(F.lit(1)).alias("_n")
    first = rows.groupBy(*groups, F.shiftright("_p", BITS).alias("_bin")).agg(count)
    every = F.sum("_n").over(Window.partitionBy(*groups))
    one = _named(_hit(first, groups, ["_bin"], take(every).cast("long")), groups, t_bin=F.col("_bin"), t_need=F.col("_need"))
    second = rows.join(one, [*_of(rows, one, groups), F.shiftright(rows["_p"], BITS) == one["t_bin"]]).groupBy(
        *groups, "_p").agg(count, F.first("t_need").alias("_left"))
    two = _named(_hit(second, groups, ["_p"], F.col("_left")), groups, t_p=F.col("_p"), t_need=F.col("_need"))
    last = rows.join(two, [*_of(rows, two, groups), rows["_p"] == two["t_p"]]).groupBy(*groups, "_h", "_k").agg(
        count, F.first("t_need").alias("_left"))
    return _hit(last, groups, ["_h", "_k"], F.col("_left")).select(*groups, "_h", "_k", "_need", "_n")


def mark_first(df: DataFrame, take: Callable[[Column], Column], seed: int = 42, key: str = "row_id", by=(),
               out: str = "is_first") -> DataFrame:
    """``df`` with ``out``: whether the row is one of the first ``take(n)`` of the n rows of its group.

    A NULL key comes first, a NULL group is a group; of rows with equal keys as many are marked
    as there is room for.
    """
    by = list(by)
    cut = cuts(df, take, seed, key, by)
    groups = [f"_g{i}" for i in range(len(by))]
    cut = _named(cut, groups, t_h=F.col("_h"), t_k=F.col("_k"), t_need=F.col("_need"), t_n=F.col("_n"))
    both = df.join(cut, [df[b].eqNullSafe(cut[f"t{g}"]) for b, g in zip(by, groups)] or F.lit(True), "left")
    h = F.coalesce(hash_key(seed, key), F.lit(""))
    before = F.struct(h.alias("h"), F.col(key).alias("k")) < F.struct(F.col("t_h").alias("h"), F.col("t_k").alias("k"))
    same = (h == F.col("t_h")) & F.col(key).eqNullSafe(F.col("t_k"))
    known = F.col("t_h").isNotNull()
    if cut.where("t_need < t_n").isEmpty():
        return both.withColumn(out, known & (before | same)).select(*df.columns, out)
    # a cut through rows of one key: these rows alone are numbered
    split = F.coalesce(known & same & (F.col("t_need") < F.col("t_n")), F.lit(False))
    rest = both.where(~split).withColumn(out, known & (before | same)).select(*df.columns, out)
    tied = with_global_position(both.where(split), [*[F.col(b).asc_nulls_first() for b in by], F.col("t_h").asc()], "_pos")
    start = _named(tied.groupBy(*[F.col(b).alias(g) for b, g in zip(by, groups)]).agg(F.min("_pos").alias("_s")), groups, t_s=F.col("_s"))
    numbered = tied.join(start, [tied[b].eqNullSafe(start[f"t{g}"]) for b, g in zip(by, groups)] or F.lit(True))
    return rest.unionByName(numbered.withColumn(out, F.col("_pos") - F.col("t_s") < F.col("t_need")).select(*df.columns, out))
