"""Regression metrics as one aggregate pass per group.

Zero denominators do not raise: MAPE skips zero targets (and reports how many
there were), R2 is NULL when the target is constant, Adjusted R2 is NULL when
``n - p - 1 <= 0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRIC_NAMES = ("RMSE", "MAE", "MAPE", "R2", "Adjusted_R2")
HIGHER_IS_BETTER = {"RMSE": False, "MAE": False, "MAPE": False, "R2": True,
                    "Adjusted_R2": True, "Accuracy": True}


def metric_aggs(y: str = "y", p: str = "pred") -> list[Column]:
    """Sufficient statistics of one group, as aggregate columns, over the rows that
    have both a target and a prediction (``n`` counts these)."""
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    err = F.col(y) - F.col(p)
    y = F.when(both, F.col(y))
    return [
        F.count_if(both).alias("n"),
        F.sum(err * err).alias("_sse"),
        F.avg(F.abs(err)).alias("MAE"),
        F.avg(F.abs(F.try_divide(err, y))).alias("_ape"),
        F.count_if(y == 0).alias("n_zero_target"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
    ]


def finish_metrics(df: DataFrame, n_features) -> DataFrame:
    """Turn the sufficient statistics into RMSE, MAE, MAPE, R2, Adjusted R2."""
    p = n_features if isinstance(n_features, Column) else F.lit(n_features)
    r2 = F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))
    dof = F.col("n") - p - 1
    adj = F.when(dof > 0, F.lit(1.0) - (F.lit(1.0) - F.col("R2")) * (F.col("n") - 1) / dof)
    return (df.withColumn("RMSE", F.sqrt(F.try_divide(F.col("_sse"), F.col("n"))))
              .withColumn("MAPE", F.col("_ape") * 100)
              .withColumn("R2", r2)
              .withColumn("Adjusted_R2", adj)
              .drop("_sse", "_ape", "_sst"))


def regression_metrics(df: DataFrame, by, y: str = "y", p: str = "pred",
                       n_features=0) -> DataFrame:
    """The five metrics per group in one pass (A6-A10 are its columns)."""
    agg = df.groupBy(*by).agg(*metric_aggs(y, p))
    return finish_metrics(agg, n_features)


def with_accuracy(df: DataFrame) -> DataFrame:
    """Notebook form: Accuracy = R2 * 100."""
    return df.withColumn("Accuracy", F.col("R2") * 100)


def to_long(df: DataFrame, keys, metrics=METRIC_NAMES, value: str = "value") -> DataFrame:
    """Wide metric columns -> (keys..., metric, value)."""
    return df.unpivot(list(keys), list(metrics), "metric", value)


def fold_summary(fold_metrics_long: DataFrame, keys, std: str = "pop") -> DataFrame:
    """Mean and (population or sample) std of each metric over folds."""
    sd = F.stddev_pop("value") if std == "pop" else F.stddev_samp("value")
    return fold_metrics_long.groupBy(*keys, "metric").agg(F.avg("value").alias("value"),
                                                         sd.alias("std"))


def winners(summary_long: DataFrame, entity: str = "model") -> DataFrame:
    """Best entity per metric; lower is better for errors, higher for R2.
    Ties go to the smallest entity name."""
    spark = summary_long.sparkSession
    direction = spark.createDataFrame(
        [(m, 1.0 if hib else -1.0) for m, hib in HIGHER_IS_BETTER.items()],
        "metric string, _sign double")
    j = summary_long.join(F.broadcast(direction), "metric")
    return j.groupBy("metric").agg(
        F.min_by(F.col(entity), F.struct((-F.col("_sign") * F.col("value")).alias("s"),
                                         F.col(entity))).alias(entity),
        F.min_by(F.col("value"), F.struct((-F.col("_sign") * F.col("value")).alias("s"),
                                          F.col(entity))).alias("value"))


def argmax_accuracy(df: DataFrame, probs: str, label: str, by=()) -> DataFrame:
    """Accuracy of argmax predictions over an array column."""
    from foldwise.functions.scalar import argmax
    hit = (argmax(probs) == F.col(label)).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def array_loss(pred: str, target: str, loss: str = "mse") -> Column:
    """A20 per-row summed loss over array columns (sum over outputs)."""
    p, t = F.col(pred), F.col(target)
    if loss == "mse":
        return F.aggregate(F.zip_with(p, t, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                           lambda acc, v: acc + v)
    if loss == "l1":
        return F.aggregate(F.zip_with(p, t, lambda a, b: F.abs(a - b)), F.lit(0.0),
                           lambda acc, v: acc + v)
    if loss == "ce":
        # target is a one-hot / probability array, pred are logits
        mx = F.array_max(p)
        lse = F.log(F.aggregate(F.transform(p, lambda a: F.exp(a - mx)), F.lit(0.0),
                                lambda acc, v: acc + v)) + mx
        return F.aggregate(F.zip_with(p, t, lambda a, b: -b * (a - lse)), F.lit(0.0),
                           lambda acc, v: acc + v)
    raise ValueError(f"unknown loss {loss!r}")


def mean_loss(df: DataFrame, pred: str, target: str, loss: str = "mse", by=()) -> DataFrame:
    """Losses by name, sum / n over array predictions (MSE, L1: mean over
    every element; cross-entropy: mean over rows)."""
    return df.groupBy(*by).agg(loss_value(pred, target, loss).alias("loss"))


def loss_value(pred: str, target: str, loss: str = "mse") -> Column:
    """The aggregate behind ``mean_loss``: several losses can share a pass."""
    denom = F.count(F.lit(1)) * (F.lit(1) if loss == "ce" else F.max(F.size(pred)))
    return F.try_divide(F.sum(array_loss(pred, target, loss)), denom)


def loss_gradient(pred: str, target: str, loss: str = "mse") -> Column:
    """Gradient of the summed loss with respect to the outputs."""
    p, t = F.col(pred), F.col(target)
    if loss == "mse":
        return F.zip_with(p, t, lambda a, b: F.lit(2.0) * (a - b))
    if loss == "l1":
        return F.zip_with(p, t, lambda a, b: F.signum(a - b))
    raise ValueError(f"unknown loss {loss!r}")


def target_step(pred: str, target: str, lr: float, loss: str = "mse") -> Column:
    """``H - lr * gradient`` (the next layer target)."""
    return F.zip_with(F.col(pred), loss_gradient(pred, target, loss),
                      lambda a, g: a - F.lit(lr) * g)


# Fixed feature counts of the location-encoding variants (after the variant's drops).
VARIANT_FEATURES = {"cat": 14, "tgt": 17, "coord_only": 15, "tgt_only": 14}


def n_features_table(spark) -> DataFrame:
    return spark.createDataFrame(list(VARIANT_FEATURES.items()), "variant string, n_features int")


def fold_split_metrics(expanded: DataFrame, by, y: str = "y", p: str = "pred",
                       n_features: str = "n_features") -> DataFrame:
    """A11 over a fold-expanded frame: metrics per (by..., heldout, split).

    ``n_features`` names a column that is constant within each group.
    """
    keys = [*by, "heldout", "split"]
    agg = expanded.groupBy(*keys).agg(*metric_aggs(y, p), F.first(n_features).alias("_p"))
    return finish_metrics(agg, F.col("_p")).drop("_p")


def cv_summary(fold_metrics: DataFrame, keys, std: str = "pop") -> DataFrame:
    """Long (keys..., split, metric, value = mean over folds, std)."""
    long = to_long(fold_metrics, [*keys, "heldout", "split"])
    return fold_summary(long, [*keys, "split"], std)
