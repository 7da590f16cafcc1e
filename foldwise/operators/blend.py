"""Blend weight search (A12, J6) and the linear blend.

With d = y - b and e = a - b, the squared error of ``w*a + (1-w)*b`` is
``Sdd - 2 w Sde + w^2 See``.  One pass collects (n, Sdd, Sde, See) per group;
the 101-point grid is applied to that tiny table, so the data is read once
instead of 101 times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scalar import blend
from foldwise.operators.lookup import bounded


def blend_sufficient_stats(df: DataFrame, by, y: str = "y", a: str = "pred_a",
                           b: str = "pred_b") -> DataFrame:
    d = F.col(y) - F.col(b)
    e = F.col(a) - F.col(b)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(d * d).alias("_dd"),
                               F.sum(d * e).alias("_de"), F.sum(e * e).alias("_ee"))


def weight_grid(df: DataFrame, by, y: str = "y", a: str = "pred_a", b: str = "pred_b",
                steps: int = 101) -> DataFrame:
    """RMSE of every grid weight per group: ``(by..., w, rmse)``."""
    st = blend_sufficient_stats(df, by, y, a, b)
    grid = df.sparkSession.range(steps).select((F.col("id") / F.lit(steps - 1)).alias("w"))
    sse = F.col("_dd") - 2 * F.col("w") * F.col("_de") + F.col("w") * F.col("w") * F.col("_ee")
    # group table x 101 grid points: both sides are small (groups x steps rows).
    return st.crossJoin(F.broadcast(grid)).select(
        *by, "w", F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("_n")).alias("rmse"))


def optimize_weight(df: DataFrame, by, y: str = "y", a: str = "pred_a", b: str = "pred_b",
                    steps: int = 101) -> DataFrame:
    """Per group the w in {0, 1/(steps-1), ..., 1} with the smallest RMSE;
    the smallest w wins a tie."""
    g = weight_grid(df, by, y, a, b, steps)
    key = F.struct(F.col("rmse"), F.col("w"))
    return g.groupBy(*by).agg(F.min_by("w", key).alias("best_w"),
                              F.min("rmse").alias("best_rmse"))


def apply_blend(df: DataFrame, weights: DataFrame, by, a: str = "pred_a", b: str = "pred_b",
                out: str = "pred") -> DataFrame:
    """``w*a + (1-w)*b`` with the group's weight joined in (weights table: one
    row per group, k rows when grouped by fold, a bounded lookup).  A NULL key is a
    group like any other; rows of a group without a weight are left out."""
    by = list(by)
    w = bounded(weights.select(*[F.col(c).alias(f"_w_{c}") for c in by], "best_w"))
    same = [df[c].eqNullSafe(w[f"_w_{c}"]) for c in by]
    return df.join(w, same).drop(*[f"_w_{c}" for c in by]).withColumn(out, blend(F.col("best_w"), a, b))
