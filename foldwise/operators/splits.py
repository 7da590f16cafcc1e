"""Reproducible splits (K1-K6).

Row order for shuffling is ``md5('seed:row_id')``: deterministic, independent
of partitioning, and never ``rand()`` across actions.

* ``mode="hash"``: fold = first 32 bits of the md5 modulo k — a projection, no
  shuffle; fold sizes are only nearly equal.
* ``mode="exact"``: rows are placed in md5 order (distributed sort, see
  ``ordering``) and cut into k blocks whose sizes differ by at most one, the
  first ``n % k`` blocks one row longer (same as SQL ``ntile``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scalar import hash_bucket, hash_fraction, hash_key
from foldwise.operators.ordering import with_global_position
from foldwise.operators.selection import mark_first


def _block_of(pos, n, k: int):
    """ntile-style block (0-based) of 0-based position ``pos`` among ``n`` rows."""
    base = F.floor(n / k)
    rem = n % k
    big = rem * (base + 1)
    return F.when(pos < big, F.floor(pos / (base + 1))).otherwise(
        rem + F.floor((pos - big) / base)).cast("int")


def assign_folds(df: DataFrame, k: int = 5, seed: int = 42, key: str = "row_id",
                 mode: str = "hash", out: str = "fold") -> DataFrame:
    """K1: one fold id in [0, k) per row; same folds for every model and variant."""
    if mode == "hash":
        return df.withColumn(out, hash_bucket(seed, key, k))
    if mode != "exact":
        raise ValueError(f"unknown fold mode {mode!r}")
    placed = with_global_position(df.withColumn("_hk", hash_key(seed, key)),
                                  [F.col("_hk").asc(), F.col(key).asc()], "_pos")
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    return (placed.crossJoin(F.broadcast(n))
                  .withColumn(out, _block_of(F.col("_pos"), F.col("_n"), k))
                  .drop("_hk", "_pos", "_n"))


def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int = 42,
                     key: str = "row_id", mode: str = "exact", out: str = "split") -> DataFrame:
    """K2: the first ``ceil(test_size * n)`` rows in md5 order are ``test``."""
    if mode == "hash":
        return df.withColumn(out, F.when(hash_fraction(seed, key) < test_size, "test")
                             .otherwise("train"))
    marked = mark_first(df, lambda n: F.ceil(n * test_size), seed, key, (), "_first")
    return marked.withColumn(out, F.when(F.col("_first"), "test").otherwise("train")).drop("_first")


def holdout_split(df: DataFrame, val_split: float = 0.1, seed: int = 42,
                  key: str = "row_id", by=(), out: str = "is_val") -> DataFrame:
    """K3: inside each group of ``by`` (e.g. held-out fold) the first
    ``int(n * val_split)`` rows in md5 order are the early-stopping hold-out.

    Groups can be huge (a held-out fold's train part is 80 % of the rows): the cut of each
    is found by histograms of the hash (see ``selection``), without a sort.
    """
    return mark_first(df, lambda n: F.floor(n * val_split), seed, key, by, out)


def stratified_split(df: DataFrame, label: str, test_size: float = 0.2, seed: int = 42,
                     key: str = "row_id", out: str = "split") -> DataFrame:
    """K4: per class, the first ``ceil(test_size * n_class)`` rows in md5
    order are ``test`` (class shares kept).

    The cut of each class is found by histograms of the hash (see ``selection``), without a
    sort, and a hot class is spread over all tasks.
    """
    marked = mark_first(df, lambda n: F.ceil(n * test_size), seed, key, [label], "_first")
    return marked.withColumn(out, F.when(F.col("_first"), "test").otherwise("train")).drop("_first")


def batch_plan(df: DataFrame, batch_size: int, epoch: int = 0, seed: int = 42,
               key: str = "row_id", drop_last: bool = True, out: str = "batch_id") -> DataFrame:
    """K5: random permutation per epoch cut into batches of ``batch_size``;
    the incomplete last batch is dropped (``drop_last``) or kept.  0 = one full batch."""
    if batch_size <= 0:
        return df.withColumn(out, F.lit(0))
    placed = with_global_position(
        df.withColumn("_hk", hash_key(seed * 1000003 + epoch, key)),
        [F.col("_hk").asc(), F.col(key).asc()], "_pos")
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    out_df = (placed.crossJoin(F.broadcast(n))
                    .withColumn(out, F.floor(F.col("_pos") / batch_size).cast("int")))
    if drop_last:
        out_df = out_df.where(F.col(out) < F.floor(F.col("_n") / batch_size))
    return out_df.drop("_hk", "_pos", "_n")


def subsample_by_ids(df: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    """K6: keep rows whose key is in the id table (semi join)."""
    return df.join(ids.select(key).distinct(), key, "left_semi")
