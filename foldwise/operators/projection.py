"""Principal components fitted on a bounded sample, in two steps.

The sample is the ``sample`` rows with the smallest hashes of their key: the same rows
under any partitioning, and as many however large the table is.  Wide vectors are first
reduced to ``before`` components; both projections are fitted on the sample and applied to
every row in one projection.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scalar import hash_key


def bounded_sample(df: DataFrame, sample: int, key: str, seed: int = 42) -> DataFrame:
    """At most ``sample`` rows, those whose keys have the smallest hashes (ties: by key)."""
    return df.orderBy(hash_key(seed, key), F.col(key).cast("string")).limit(sample)


class Projection:
    """``k`` principal components of an array column, perhaps of its first ``before`` ones."""

    def __init__(self, k: int = 2, sample: int = 10_000, before: int | None = None, seed: int = 42):
        self.k, self.sample, self.before, self.seed = k, sample, before, seed

    def fit(self, df: DataFrame, x: str, key: str) -> "Projection":
        """On a sample of the rows whose array is not null."""
        rows = bounded_sample(df.where(F.col(x).isNotNull()).select(key, x), self.sample, key, self.seed)
        at = rows.select(array_to_vector(F.col(x).cast("array<double>")).alias("v")).checkpoint()
        scaler = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(at)
        at = scaler.transform(at)
        self.mean, self.matrix = scaler.mean.toArray(), np.eye(len(scaler.mean))
        for width in ([self.before] if self.before and self.before < len(self.mean) else []) + [self.k]:
            step = PCA(k=width, inputCol="c", outputCol="p").fit(at)
            at = step.transform(at).select(F.col("p").alias("c"))
            self.matrix, self.explained = self.matrix @ step.pc.toArray(), step.explainedVariance.toArray()
        return self

    def transform(self, df: DataFrame, x: str, out: str = "pc") -> DataFrame:
        """``df`` with the components as an array; a null array stays null."""
        centred = F.zip_with(F.col(x).cast("array<double>"), F.lit(self.mean.tolist()), lambda a, m: a - m)
        parts = [F.aggregate(F.zip_with(centred, F.lit(self.matrix[:, i].tolist()), lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v)
                 for i in range(self.k)]
        return df.withColumn(out, F.when(F.col(x).isNotNull(), F.array(*parts)))
