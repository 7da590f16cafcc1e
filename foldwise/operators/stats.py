"""Exact quantiles, summaries, histograms and fit statistics.

Exact quantiles never gather a column into one task: values are first reduced
to (value, count) pairs (map-side partial aggregation, so a hot value is one
row), then placed in a distributed total order (``ordering``), and the two
neighbours of each target rank are picked with a join against a table of
``2 * len(qs)`` target ranks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.ordering import with_global_position


def _pick(placed: DataFrame, targets: DataFrame, keys) -> DataFrame:
    """Interpolated value per target from rows placed at [_r, _r + _cnt)."""
    t = F.broadcast(targets)
    on = [placed[k] == t[k] for k in keys]
    lo = placed.join(t, on + [(placed._r <= t._lo), (t._lo < placed._r + placed._cnt)]).select(
        *[t[k] for k in keys], "q", F.col("_v").alias("_vlo"), "_frac")
    hi = placed.join(t, on + [(placed._r <= t._hi), (t._hi < placed._r + placed._cnt)]).select(
        *[t[k].alias(f"_{k}") for k in keys], F.col("q").alias("_q"), F.col("_v").alias("_vhi"))
    j = lo.join(hi, [lo[k] == hi[f"_{k}"] for k in keys] + [lo["q"] == hi["_q"]])
    return j.select("q", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("value"))


def _target_rows(qs, n: int) -> list[dict]:
    """Of each quantile, the two ranks next to it and how far it lies between them."""
    rows = []
    for i, q in enumerate(qs):
        h = (n - 1) * q
        lo = int(h // 1)
        rows.append({"qi": i, "q": q, "_lo": lo, "_hi": lo if h == lo else lo + 1, "_frac": h - lo})
    return rows


def _targets(spark, qs, n: int):
    rows = [tuple(r.values()) for r in _target_rows(qs, n)]
    return spark.createDataFrame(rows, "qi int, q double, _lo bigint, _hi bigint, _frac double")


def _exact_by_sort(x: DataFrame, qs) -> DataFrame:
    """Every distinct value in a distributed weighted order (one full sort)."""
    spark = x.sparkSession
    vals = x.groupBy("_v").agg(F.count(F.lit(1)).alias("_cnt"))
    placed = with_global_position(vals, [F.col("_v").asc()], "_r", weight_col="_cnt")
    n = placed.agg(F.sum("_cnt")).first()[0] or 0
    if n == 0:
        return spark.createDataFrame([], "q double, value double")
    return _pick(placed.withColumn("qi", F.lit(0)),
                 _targets(spark, qs, n).withColumn("qi", F.lit(0)).dropDuplicates(["q"]), ["qi"])


def quantiles_long(df: DataFrame, col: str, qs, method: str = "exact",
                   accuracy: int = 10000) -> DataFrame:
    """Rows ``(q double, value double)``: linear-interpolated quantiles of ``col``.

    ``method="exact"`` matches pandas ``Series.quantile`` / SQL
    ``quantile_cont``: a ``percentile_approx`` pass brackets each target rank
    (rank error <= n / accuracy), one pass counts the rows below each bracket,
    and only the values inside the brackets (a few n / accuracy rows; a hot
    value is one (value, count) row) are placed in a distributed order.  A
    bracket that fails the runtime check falls back to the full distributed
    sort (``method="sort"``).  ``method="approx"`` returns the sketch values.
    """
    spark = df.sparkSession
    qs = [float(q) for q in qs]
    x = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_v"))
    if method == "approx":
        row = x.agg(F.percentile_approx("_v", qs, accuracy).alias("v"))
        return row.select(F.posexplode("v").alias("i", "value")).select(
            F.element_at(F.array(*[F.lit(q) for q in qs]), F.col("i") + 1).alias("q"),
            F.col("value"))
    if method == "sort":
        return _exact_by_sort(x, qs).checkpoint()
    eps = 2.0 / accuracy
    # one sketch for both ends of every bracket
    ends = [max(q - eps, 0.0) for q in qs] + [min(q + eps, 1.0) for q in qs]
    sk = x.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", ends, accuracy).alias("ends")).first()
    n = sk["n"]
    if n == 0:
        return spark.createDataFrame([], "q double, value double")
    targets = _targets(spark, qs, n)
    lo, hi = sk["ends"][:len(qs)], sk["ends"][len(qs):]
    # rows below and up to each bracket: one row of counts
    n_below = x.agg(*[F.count_if(F.col("_v") < F.lit(lo[i])).alias(f"b{i}") for i in range(len(qs))],
                    *[F.count_if(F.col("_v") <= F.lit(hi[i])).alias(f"u{i}") for i in range(len(qs))]).first()
    if any(n_below[f"b{i}"] > t["_lo"] or n_below[f"u{i}"] <= t["_hi"] for i, t in enumerate(_target_rows(qs, n))):
        return _exact_by_sort(x, qs).checkpoint()
    br = spark.createDataFrame([(i, float(lo[i]), float(hi[i]), int(n_below[f"b{i}"])) for i in range(len(qs))],
                               "qi int, _blo double, _bhi double, _below bigint")
    # values inside any bracket, counted first, then dealt to their brackets (few rows, broadcast)
    inside = [(F.col("_v") >= F.lit(lo[i])) & (F.col("_v") <= F.lit(hi[i])) for i in range(len(qs))]
    some = x.where(reduce(lambda a, b: a | b, inside)).groupBy("_v").agg(F.count(F.lit(1)).alias("_cnt"))
    cand = some.crossJoin(F.broadcast(br)).where((F.col("_v") >= F.col("_blo")) & (F.col("_v") <= F.col("_bhi"))).select("qi", "_v", "_cnt", "_below")
    placed = with_global_position(cand, [F.col("qi").asc(), F.col("_v").asc()], "_pos",
                                  weight_col="_cnt")
    starts = placed.groupBy("qi").agg(F.min("_pos").alias("_start"))
    placed = (placed.join(F.broadcast(starts), "qi")
                    .withColumn("_r", F.col("_pos") - F.col("_start") + F.col("_below")))
    # a few rows, referenced by every later plan (caps, filters, reports):
    # materialize once instead of re-deriving them per reference
    return _pick(placed, targets, ["qi"]).checkpoint()


def quantile_row(df: DataFrame, col: str, qs: dict, method: str = "exact") -> DataFrame:
    """One-row DataFrame with one column per name in ``qs`` (name -> q)."""
    long = quantiles_long(df, col, list(qs.values()), method)
    return long.agg(*[F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(name)
                      for name, q in qs.items()])


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, sample std, min, 25%, 50%, 75%, max in one row."""
    base = df.agg(F.count(col).alias("count"), F.avg(col).alias("mean"),
                  F.stddev_samp(col).alias("std"), F.min(col).cast("double").alias("min"),
                  F.max(col).cast("double").alias("max"))
    qrow = quantile_row(df, col, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return base.crossJoin(qrow).select("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def median(df: DataFrame, col: str) -> DataFrame:
    return quantile_row(df, col, {"median": 0.5})


def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Equal-width bins between min and max; the last bin is closed on the right.

    Returns every bin (empty ones with count 0): ``bin, lo, hi, count``.
    """
    spark = df.sparkSession
    vals = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_x"))
    rng = vals.agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    width = (F.col("_mx") - F.col("_mn"))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_mn")) / width * bins), F.lit(bins - 1)))
    counts = (vals.crossJoin(F.broadcast(rng))
                  .groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(rng)
    return (grid.join(F.broadcast(counts), "bin", "left")
                .select("bin",
                        (F.col("_mn") + width * F.col("bin") / bins).alias("lo"),
                        (F.col("_mn") + width * (F.col("bin") + 1) / bins).alias("hi"),
                        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def fit_stats(df: DataFrame, cols, by=()) -> DataFrame:
    """min, max, mean, population std of each column, per group (one pass)."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("double").alias(f"{c}__min"),
                 F.max(c).cast("double").alias(f"{c}__max"),
                 F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
