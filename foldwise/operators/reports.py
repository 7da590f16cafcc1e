"""Result reports over the long metric table.

Metric tables hold one row per (model, variant, split, metric): tiny next to
the data, but every step is still a DataFrame job (no driver-side pandas).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scalar import display_label

BASELINE = ("rf", "cat")
# Fixed display order of the variants (baseline last), as in the study.
VARIANT_ORDER = ("tgt", "coord_only", "tgt_only", "cat")


def metric_slice(metrics_long: DataFrame, split: str = "test", metric: str = "Adjusted_R2",
                 value_name: str = "adjusted_r2_test", std_name: str = "adjusted_r2_std",
                 exclude_prefix: str | None = None) -> DataFrame:
    """P17 + P20 + S7: one metric on one split; optional ``~startswith`` filter;
    a missing std column (old files) becomes NULL."""
    df = metrics_long.where((F.col("split") == split) & (F.col("metric") == metric))
    if exclude_prefix:
        df = df.where(~F.col("model").startswith(exclude_prefix))
    std = F.col("std") if "std" in metrics_long.columns else F.lit(None).cast("double")
    return df.select("model", "variant", F.col("value").alias(value_name), std.alias(std_name))


def leaderboard(adj: DataFrame, value: str = "adjusted_r2_test") -> DataFrame:
    """Best first (ties by model, variant)."""
    return adj.orderBy(F.col(value).desc(), "model", "variant")


def top_k_with_baseline(adj: DataFrame, k: int = 7, value: str = "adjusted_r2_test",
                        baseline=BASELINE) -> DataFrame:
    """T3 + U1 + P18 + P19: the top k rows plus the baseline row when it is
    not among them, with a display label and a baseline flag.

    The top k is an ordered limit (k rows per task, merged), not a global window.
    """
    top = adj.orderBy(F.col(value).desc(), "model", "variant").limit(k)
    base = adj.where((F.col("model") == baseline[0]) & (F.col("variant") == baseline[1]))
    out = top.unionByName(base).dropDuplicates(["model", "variant"])
    is_base = (F.col("model") == baseline[0]) & (F.col("variant") == baseline[1])
    return (out.withColumn("is_baseline", is_base)
               .withColumn("label", display_label("model", "variant"))
               .orderBy(F.col(value).desc(), "model", "variant"))


def order_by_category(df: DataFrame, col: str, order, keys=()) -> DataFrame:
    """T4: sort by a fixed category order; categories missing from ``df``
    appear as rows of NULLs (reindex semantics)."""
    spark = df.sparkSession
    cat = spark.createDataFrame([(v, i) for i, v in enumerate(order)], f"{col} string, _pos int")
    return cat.join(df, col, "left").orderBy("_pos").drop("_pos")


def mean_std_pivot(metrics_long: DataFrame, metric: str, split: str = "test",
                   variants=VARIANT_ORDER, digits: int = 4) -> DataFrame:
    """Model x variant table of 'mean ± std' text for one metric."""
    cell = F.concat(F.format_number(F.col("value"), digits), F.lit(" ± "),
                    F.format_number(F.coalesce(F.col("std"), F.lit(0.0)), digits))
    df = (metrics_long.where((F.col("split") == split) & (F.col("metric") == metric))
                      .withColumn("_cell", cell))
    return df.groupBy("model").pivot("variant", list(variants)).agg(F.first("_cell"))


def improvement_over_baseline(metrics_long: DataFrame, split: str = "test",
                              baseline=BASELINE) -> DataFrame:
    """Relative RMSE reduction and Adjusted R2 gain of every config
    against the baseline config (self-join to the baseline row)."""
    piv = (metrics_long.where(F.col("split") == split)
                       .groupBy("model", "variant")
                       .pivot("metric", ["RMSE", "Adjusted_R2"]).agg(F.first("value")))
    base = piv.where((F.col("model") == baseline[0]) & (F.col("variant") == baseline[1])).select(
        F.col("RMSE").alias("_b_rmse"), F.col("Adjusted_R2").alias("_b_adj"))
    return (piv.crossJoin(F.broadcast(base))
               .select("model", "variant",
                       ((F.col("_b_rmse") - F.col("RMSE")) / F.col("_b_rmse")).alias("rmse_reduction"),
                       (F.col("Adjusted_R2") - F.col("_b_adj")).alias("adj_r2_gain")))
