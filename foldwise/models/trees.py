"""Tree models on Spark ML (M1, M2, M4) and model persistence.

Spark bins continuous features (``maxBins``) while the study's trees split
exactly, and caps depth at 30; scores are near, not equal.
"""

from __future__ import annotations

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressionModel, DecisionTreeRegressor,
                                   GBTRegressionModel, GBTRegressor,
                                   RandomForestRegressionModel, RandomForestRegressor)
from pyspark.sql import Column
from pyspark.sql import functions as F


def decision_tree(max_depth: int = 6, min_leaf: int = 2, max_bins: int = 256, seed: int = 42,
                  features: str = "features", label: str = "label") -> DecisionTreeRegressor:
    """M1: regression tree, depth 6, at least 2 rows per leaf."""
    return DecisionTreeRegressor(featuresCol=features, labelCol=label, maxDepth=max_depth,
                                 minInstancesPerNode=min_leaf, maxBins=max_bins, seed=seed)


def random_forest(num_trees: int = 100, max_depth: int = 30, min_leaf: int = 2,
                  subset: str = "all", max_bins: int = 256, seed: int = 42,
                  features: str = "features", label: str = "label",
                  max_memory_mb: int = 512) -> RandomForestRegressor:
    """M2: forest of 100 trees, every feature considered at each split (the
    study's code uses all features), unlimited depth = Spark's cap of 30.

    ``maxMemoryInMB`` (nodes split per pass) and ``cacheNodeIds`` only change
    how many passes over the data the fit takes, not the model.  Every task of
    a pass holds as much memory, and all tasks of an executor at once.
    """
    return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=num_trees,
                                 maxDepth=max_depth, minInstancesPerNode=min_leaf,
                                 featureSubsetStrategy=subset, maxBins=max_bins, seed=seed,
                                 maxMemoryInMB=max_memory_mb, cacheNodeIds=True,
                                 checkpointInterval=10)


def boosted_trees(rounds: int = 200, step: float = 0.1, max_depth: int = 5, max_bins: int = 256,
                  seed: int = 42, features: str = "features", label: str = "label") -> GBTRegressor:
    """M4: plain boosted trees in one call (Spark's first tree has weight 1, not the step)."""
    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=rounds, stepSize=step,
                        maxDepth=max_depth, maxBins=max_bins, seed=seed)


_LOADERS = {"DecisionTreeRegressionModel": DecisionTreeRegressionModel,
            "RandomForestRegressionModel": RandomForestRegressionModel,
            "GBTRegressionModel": GBTRegressionModel}


def save_model(model, path: str) -> str:
    """Persist a fitted model (overwrite)."""
    model.write().overwrite().save(path)
    return path


def load_model(kind: str, path: str):
    """Load a model saved by ``save_model`` (kind = model class name)."""
    return _LOADERS[kind].load(path)


# ---------------------------------------------------------------- trees as arrays

@dataclass
class PackedTrees:
    """Regression trees one after another as arrays: ``feature`` (-1: a leaf), ``threshold``,
    ``left`` and ``right`` (places in the arrays), ``value``; ``root`` and ``slot`` of each
    tree, trees of a slot in the order in which they are added."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    slot: np.ndarray
    depth: int

    def add_to(self, out: np.ndarray, x: np.ndarray, step: float) -> np.ndarray:
        """``out`` (rows x slots) plus ``step`` times each tree of ``x`` (rows x features)."""
        for root, slot in zip(self.root, self.slot):
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                goes_left = x[np.arange(len(x)), np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f < 0, at, np.where(goes_left, self.left[at], self.right[at]))
            out[:, slot] += step * self.value[at]
        return out


@dataclass
class Nodes:
    """One regression tree, its root first: arrays as in ``PackedTrees``."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int


def tree_nodes(model) -> Nodes:
    """Of a fitted Spark tree with continuous splits."""
    nodes, depth = [], 0

    def walk(node, level: int) -> int:
        nonlocal depth
        at, depth = len(nodes), max(depth, level)
        nodes.append((-1, 0.0, 0, 0, node.prediction()))
        if node.subtreeDepth():
            split = node.split()
            nodes[at] = (split.featureIndex(), split.threshold(), walk(node.leftChild(), level + 1), walk(node.rightChild(), level + 1), 0.0)
        return at

    walk(model._java_obj.rootNode(), 0)
    f, t, l, r, v = zip(*nodes)
    return Nodes(np.array(f, np.int64), np.array(t, float), np.array(l, np.int64), np.array(r, np.int64), np.array(v, float), depth)


def with_trees(df, models, current: str, features: str, step: float):
    """``current`` (an array column, a number a slot) plus ``step`` times the fitted Spark tree of
    each slot: what ``added`` gives, with no Python."""
    out = df
    for i, m in enumerate(models):
        m = m.copy()
        m.setFeaturesCol(features)
        m.setPredictionCol(f"_tree{i}")
        out = m.transform(out)
    sums = F.array(*[F.col(current)[i] + F.lit(float(step)) * F.col(f"_tree{i}") for i in range(len(models))])
    return out.withColumn(current, sums).drop(*[f"_tree{i}" for i in range(len(models))])


def pack_trees(trees, slots) -> PackedTrees:
    """Trees (``Nodes``), and the slot of each."""
    trees = list(trees)
    root = np.cumsum([0] + [len(t.value) for t in trees])[:-1].astype(np.int64)
    def joined(name, shift=False):
        return np.concatenate([getattr(t, name) + (at if shift else 0) for t, at in zip(trees, root)]) if trees else np.empty(0)
    return PackedTrees(joined("feature"), joined("threshold"), joined("left", True), joined("right", True), joined("value"),
                       root, np.array(list(slots), np.int64), max((t.depth for t in trees), default=0))


def added(packed: PackedTrees, start: Column, features: str, step: float) -> Column:
    """``start`` (an array column, a number a slot) plus ``step`` times the trees of the vector
    column ``features``: one projection, evaluated by Arrow batches."""
    @F.pandas_udf("array<double>")
    def run(cur: pd.Series, x: pd.Series) -> pd.Series:
        if not len(cur):
            return pd.Series([], dtype=object)
        out = packed.add_to(np.stack(cur.to_numpy()).astype(float), np.stack(x.to_numpy()).astype(float), step)
        return pd.Series(list(out))

    return run(start, vector_to_array(F.col(features)))
