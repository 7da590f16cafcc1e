"""Boosted trees with continued training (M3), multi-output boosting (M5) and
the single-layer special case with noise-fitted initial trees (M12).

``BoostedStages`` keeps a constant base score and a list of trees; each ``fit_increment`` adds rounds, every round fitting a
``DecisionTreeRegressor`` to the negative gradient of the loss at the current
prediction (squared error by default; a custom objective is a Column function
``gradient(pred, label)``).  Prediction = base + step * sum(tree).  The
working frame's lineage is cut with a reliable ``checkpoint`` every few rounds.

Not reproduced from XGBoost: second-order leaf weights and the L2 leaf term.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.models import store
from foldwise.models.trees import added, pack_trees, tree_nodes, with_trees
from foldwise.session import InheritableThreads, ensure_checkpoint_dir, ship_package


#: slots whose new trees Spark's own models evaluate in the JVM; a plan of more is longer than
#: one pass over all trees by Arrow batches is slow
JVM_SLOTS = 4


def squared_error_gradient(pred: Column, label: Column) -> Column:
    return pred - label


class BoostedStages:
    """M3: boosting that can be continued (each call adds rounds)."""

    def __init__(self, step: float = 0.1, max_depth: int = 5, min_leaf: int = 1,
                 max_bins: int = 256, base_score: float | None = None,
                 gradient: Callable[[Column, Column], Column] | None = None,
                 checkpoint_every: int = 5, seed: int = 42, features: str = "features"):
        self.step, self.max_depth, self.min_leaf, self.max_bins = step, max_depth, min_leaf, max_bins
        self.base_score = base_score
        self.gradient = gradient or squared_error_gradient
        self.checkpoint_every, self.seed, self.features = checkpoint_every, seed, features
        self.trees: list = []

    # -- prediction -------------------------------------------------------
    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """base + step * sum of tree outputs (base score before any fit), in one projection."""
        base = 0.5 if self.base_score is None else self.base_score
        if not self.trees:
            return df.withColumn(out, F.lit(float(base)))
        ship_package(df.sparkSession)
        return df.withColumn(out, added(pack_trees(self.trees, [0] * len(self.trees)), F.array(F.lit(float(base))), self.features, self.step)[0])

    # -- training ---------------------------------------------------------
    def fit_increment(self, df: DataFrame, label: str = "label", rounds: int = 1) -> "BoostedStages":
        """Add ``rounds`` trees fitted on ``df`` (continued training)."""
        ensure_checkpoint_dir(df.sparkSession)
        if self.base_score is None:
            self.base_score = float(df.agg(F.avg(label)).first()[0])
        one = MultiOutputBoosting.__new__(MultiOutputBoosting)
        one.models, one.features = [self], self.features
        one.fit_increment(df.select(self.features, F.array(F.col(label).cast("double")).alias("_labels")), "_labels", rounds)
        return self

    def fit(self, df: DataFrame, label: str = "label", rounds: int = 10,
            init_rounds: int = 0, noise_seed: int = 7) -> "BoostedStages":
        """Optional initial rounds on N(0,1) noise targets (deterministic
        per row), then ``rounds`` rounds toward the label."""
        if init_rounds:
            from foldwise.functions.scalar import hash_normal
            if "row_id" in df.columns:   # noise keyed by the row: same under any partitioning
                noisy = df.withColumn("_noise", hash_normal(noise_seed, "row_id"))
            else:                        # no key: pin generated ids with a checkpoint
                keyed = df.withColumn("_k", F.monotonically_increasing_id()).checkpoint()
                noisy = keyed.withColumn("_noise", hash_normal(noise_seed, "_k"))
            base = self.base_score
            self.base_score = 0.0 if base is None else base
            self.fit_increment(noisy, "_noise", init_rounds)
        return self.fit_increment(df, label, rounds)

    def save(self, path: str, spark) -> None:
        """S11 (see ``store``).  A custom gradient is code and isn't saved: a loaded model
        predicts, and goes on with squared errors."""
        store.save(self, path, spark)

    @classmethod
    def load(cls, path: str, spark) -> "BoostedStages":
        return store.load(path, spark, cls)


class MultiOutputBoosting:
    """M5: one ``BoostedStages`` per output slot of an array label; outputs as an array.

    The slots of a round are fitted side by side on one kept frame (``parallel`` of them at
    a time), and a prediction is one projection over the packed trees of all slots."""

    def __init__(self, n_outputs: int, parallel: int = 8, **kwargs):
        self.models = [BoostedStages(**kwargs) for _ in range(n_outputs)]
        self.features = kwargs.get("features", "features")
        self.parallel = parallel

    parallel = 8

    def fit_increment(self, df: DataFrame, label: str = "label", rounds: int = 1):
        """Add ``rounds`` trees a slot, each fitted to its slot's negative gradient."""
        ensure_checkpoint_dir(df.sparkSession)
        ship_package(df.sparkSession)
        first, slots = self.models[0], range(len(self.models))
        new = [i for i in slots if self.models[i].base_score is None]
        if new:
            means = df.agg(*[F.avg(F.col(label)[i]).alias(f"m{i}") for i in new]).first()
            for i in new:
                self.models[i].base_score = float(means[f"m{i}"])
        work, prev = self.predict(df.select(self.features, F.col(label).alias("_y")), "_cur"), None
        with InheritableThreads(df.sparkSession, max(1, min(self.parallel, len(self.models)))) as pool:
            for r in range(rounds):
                grads = [-m.gradient(F.col("_cur")[i], F.col("_y")[i]) for i, m in enumerate(self.models)]
                # every tree reads the frame several times
                work = work.withColumn("_neg", F.array(*grads)).persist(StorageLevel.MEMORY_AND_DISK)
                frame = work

                def fit_slot(i, frame=frame):
                    m = self.models[i]
                    learner = DecisionTreeRegressor(featuresCol=self.features, labelCol="_neg_grad", maxDepth=m.max_depth,
                                                    minInstancesPerNode=m.min_leaf, maxBins=m.max_bins, seed=m.seed + len(m.trees))
                    return learner.fit(frame.select(self.features, F.col("_neg")[i].alias("_neg_grad")))

                if r == 0 and len(self.models) > 1:
                    frame.count()  # kept before the slots read it side by side
                fitted = pool.map(fit_slot, slots)
                trees = [tree_nodes(t) for t in fitted]
                for m, tree in zip(self.models, trees):
                    m.trees.append(tree)
                if prev is not None:
                    prev.unpersist()
                prev = work
                if r + 1 < rounds:
                    work = work.drop("_neg")
                    if len(slots) <= JVM_SLOTS:
                        work = with_trees(work, fitted, "_cur", self.features, first.step)
                    else:
                        work = work.withColumn("_cur", added(pack_trees(trees, slots), F.col("_cur"), self.features, first.step))
                    if (r + 1) % first.checkpoint_every == 0:
                        work = work.checkpoint()   # reliable: cuts lineage, survives executor loss
                        prev.unpersist()
                        prev = None
        if prev is not None:
            prev.unpersist()
        return self

    def save(self, path: str, spark) -> None:
        """S11 (see ``store``)."""
        store.save(self, path, spark)

    @classmethod
    def load(cls, path: str, spark) -> "MultiOutputBoosting":
        return store.load(path, spark, cls)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Base and trees of every slot, as an array."""
        base = F.array(*[F.lit(0.5 if m.base_score is None else float(m.base_score)) for m in self.models])
        trees = [(t, i) for i, m in enumerate(self.models) for t in m.trees]
        if not trees:
            return df.withColumn(out, base)
        ship_package(df.sparkSession)
        return df.withColumn(out, added(pack_trees(*zip(*trees)), base, self.features, self.models[0].step))
