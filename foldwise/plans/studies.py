"""The two report studies as one call each.

Both return a dict of DataFrames (lazy; nothing is collected), built from the
same operators the registered queries use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions import scalar as S
from foldwise.operators import features as FE
from foldwise.operators import reports as RP
from foldwise.operators import stats as ST
from foldwise.operators.ordering import global_row_number


def price_distribution_study(raw: DataFrame, price: str = "price", area: str = "sqft_living",
                             outlier_q: float = 0.999, band=(10, 25)) -> dict:
    """Summary, zero count, outlier threshold and rows, histograms (raw,
    positive, top-1 % tail, trimmed), trimmed summary and median, and the
    price vs price-per-area rank band."""
    caps = ST.quantile_row(raw, price, {"cap": outlier_q, "q99": 0.99})
    j = raw.crossJoin(F.broadcast(caps))
    trimmed = j.where((F.col(price) > 0) & (F.col(price) <= F.col("cap")))
    keys = ["row_id"] if "row_id" in raw.columns else []
    ranked = raw.withColumn("price_per_sqft", S.safe_ratio(price, area))
    ranked = global_row_number(ranked, [F.col(price).desc(), *[F.col(k) for k in keys]], "price_rank")
    ranked = global_row_number(ranked, [F.col("price_per_sqft").desc(), *[F.col(k) for k in keys]],
                               "per_sqft_rank")
    lo, hi = band
    return {
        "summary": ST.describe(raw, price),
        "zero_count": raw.agg(F.count_if(F.col(price) == 0).alias("n_zero"), F.count(F.lit(1)).alias("n")),
        "threshold": caps,
        "outliers": j.where(F.col(price) > F.col("cap")).drop("cap", "q99").orderBy(F.col(price).desc()),
        "hist_raw": ST.histogram(raw, price, 100),
        "hist_positive": ST.histogram(FE.keep_positive(raw, price), price, 100),
        "hist_tail": ST.histogram(j.where(F.col(price) > F.col("q99")), price, 40),
        "hist_trimmed": ST.histogram(trimmed, price, 100),
        "trimmed_summary": ST.describe(trimmed, price),
        "trimmed_median": ST.median(trimmed, price),
        "rank_band": ranked.where(F.col("price_rank").between(lo, hi))
                           .withColumn("rank_change", F.col("price_rank") - F.col("per_sqft_rank"))
                           .orderBy("price_rank"),
    }


def result_study(metrics_long: DataFrame, metric: str = "Adjusted_R2", split: str = "test",
                 k: int = 7, baseline=RP.BASELINE) -> dict:
    """Leaderboard, the rf variants in a fixed order, top-k with the
    baseline (all models and non-ensemble models), the mean ± std table and
    the improvement over the baseline."""
    adj = RP.metric_slice(metrics_long, split, metric)
    rf = adj.where(F.col("model") == baseline[0])
    return {
        "leaderboard": RP.leaderboard(adj),
        "rf_variants": RP.order_by_category(rf.drop("model"), "variant", RP.VARIANT_ORDER),
        "top_k": RP.top_k_with_baseline(adj, k, baseline=baseline),
        "top_k_no_ensemble": RP.top_k_with_baseline(
            RP.metric_slice(metrics_long, split, metric, exclude_prefix="ensemble"), k, baseline=baseline),
        "mean_std_table": RP.mean_std_pivot(metrics_long, metric, split),
        "improvement": RP.improvement_over_baseline(metrics_long, split, baseline),
    }
