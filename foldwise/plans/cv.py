"""User-level runs: preprocessing (L1), k-fold CV of one model (L2), the
price / price-per-area stack (L3), the grid (L4), fold evaluation with
timings and saved models (L5) and the full-data map table (L6).

The folded engineered frame is materialized once (checkpoint) and every fold
reads it: fit statistics come from the fold-wise encoders (no k copies), one
model is fitted per held-out fold, predictions of all folds are unioned into
one scored frame and the metrics are one aggregate over it.  A fold's encoded
rows are a projection of that frame with lookups of a few rows, and a tree's
predictions another, so neither is written: what is kept on disk doesn't grow
with the folds, the targets or the variants.
"""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.models import trees as TR
from foldwise.models.boosting import BoostedStages
from foldwise.models.neural import MLPConfig, SparkMLP
from foldwise.operators import blend as BL
from foldwise.operators import encoders as EN
from foldwise.operators import features as FE
from foldwise.operators import metrics as ME
from foldwise.operators import splits as SP
from foldwise.operators.lookup import bounded, discard, kept, tiny
from foldwise.session import InheritableThreads
from foldwise.sources import io as IO


def base_variants(split: DataFrame, target: str = "price", smoothing: float = 10.0) -> dict:
    """The two stored variants of a frame with a ``split`` column: ``cat`` without
    coordinates, ``tgt`` with city and zip encoded by the train rows' target."""
    coded = split.withColumn("_f", (F.col("split") == "test").cast("int")).withColumn("heldout", F.lit(1))
    part = EN.category_partials(coded, FE.ADDRESS_COLS, target, "_f")
    tgt = coded
    for c in FE.ADDRESS_COLS:
        enc, gmean = EN.encoding_tables(part, c, 2, smoothing)
        tgt = EN.apply_encoding(tgt, c, bounded(enc.where("heldout = 1")), gmean.where("heldout = 1"))
    return {"cat": FE.drop_coords(split), "tgt": tgt.drop("_f", "heldout")}


def preprocess(raw: DataFrame, out_path: str | None = None, upper_quantile: float = 0.999):
    """L1: the engineered frame and its 80/20 split; with ``out_path`` the engineered frame
    and the base variants are written below it."""
    features = FE.engineer(raw, upper_quantile)
    eng = kept(features)
    discard(features)
    split = kept(SP.train_test_split(eng, 0.2, 42))
    if out_path:
        IO.write_table(eng, f"{out_path}/engineered")
        IO.write_variants(base_variants(split), f"{out_path}/variants")
    return eng, split


#: learners of Spark ML: their predictions are projections in the JVM
SPARK_TREES = ("dt", "rf", "gbt")


def _estimator(model: str, label: str = "label", **kw):
    if model == "dt":
        return TR.decision_tree(label=label, **kw)
    if model == "rf":
        return TR.random_forest(label=label, **kw)
    if model == "gbt":
        return TR.boosted_trees(label=label, **kw)
    raise ValueError(f"unknown model {model!r}")


class _Fitted:
    """Uniform predict() over Spark ML models, BoostedStages and SparkMLP."""

    def __init__(self, model):
        self.model = model

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        if isinstance(self.model, BoostedStages):
            return self.model.predict(df, out)
        if isinstance(self.model, SparkMLP):
            arr = df.withColumn("_xarr", vector_to_array("features"))
            return self.model.predict(arr, "_xarr", "_mlp_out").withColumn(
                out, F.col("_mlp_out")[0]).drop("_xarr", "_mlp_out")
        m = self.model.copy()
        m.setPredictionCol(out)
        return m.transform(df)


def fit_model(model: str, train: DataFrame, label: str = "label", params: dict | None = None):
    params = dict(params or {})
    if model == "boost":
        rounds = params.pop("rounds", 20)
        return _Fitted(BoostedStages(**params).fit(train, label, rounds))
    if model == "mlp":
        n_in = len(train.select("features").first()[0])
        net = SparkMLP(MLPConfig(input_dim=n_in, **params))
        arr = train.withColumn("_xarr", vector_to_array("features"))
        return _Fitted(net.fit(arr, "_xarr", label, key="row_id"))
    return _Fitted(_estimator(model, label, **params).fit(train))


def save_fitted(fitted: _Fitted, path: str, spark) -> None:
    """Every kind of model that ``fit_model`` makes."""
    m = fitted.model
    if hasattr(m, "write"):
        TR.save_model(m, path)
    elif hasattr(m, "save"):
        m.save(path, spark)
    else:
        raise TypeError(f"{type(m).__name__} can't be saved")


#: rows of a frame whose folds are fitted side by side: each fit keeps its own copy, some 200 bytes a row
SIDE_BY_SIDE_ROWS = 5_000_000


def folds_at_a_time(folded: DataFrame, k: int, parallel: int | None) -> int:
    """Up to ``parallel`` folds (else all) where the frame is small, so that one fold's fit leaves
    cores idle, and one where it fills them: the fits' copies of a large frame would lie on
    disk side by side."""
    few = parallel or folded.rdd.getNumPartitions() <= 4 * folded.sparkSession.sparkContext.defaultParallelism
    return (parallel or k) if few and folded.count() <= SIDE_BY_SIDE_ROWS else 1


def model_path(save_dir: str, model: str, variant: str, target: str, heldout: int) -> str:
    return f"{save_dir}/{model}_{variant}_{target}_fold{heldout}"


def run_folds(folded: DataFrame, model: str, variant: str, k: int, targets=("price",), params: dict | None = None,
              save_dir: str | None = None, parallel: int | None = None, carry=(), measure=None):
    """Fit one model per held-out fold and target, all targets on the same features.

    Location encodings are fitted on the price, whatever the target is.  All predictions
    are added to a fold's encoded rows, so nothing is joined back.  Spark's trees read
    these rows a few times and keep binned ones themselves, so the rows and the
    predictions are computed where they are asked for; other learners' rows are cached
    while they fit, and their predictions are written.
    Returns ``(scored, timing, n_features, measured)``; ``scored`` has ``pred_<target>`` in the
    target's units, ``y_<target>``, and the ``carry`` columns.  ``measure`` makes a table of a
    few rows of a fold's part of it: the pass that predicts a fold's rows, and whose time is
    taken, gives that table, and ``measured`` is those of all folds; without it nothing is
    predicted yet.
    """
    spark = folded.sparkSession
    fp = EN.FoldPreprocessor(k, variant, targets=targets)
    st = fp.fit(folded)
    feats = fp.feature_names(st)

    def one_fold(h: int):
        rows = folded.withColumns({f"y_{t}": F.col(t) for t in targets} | {f"c_{c}": F.col(c) for c in carry})
        parts = [c for t in targets for c in (f"y_{t}", f"{t}__label", f"{t}__min", f"{t}__max")]
        frame = fp.transform(rows, st, h).select(
            "row_id", "heldout", "split", EN.feature_vector(feats).alias("features"), *parts, *[f"c_{c}" for c in carry])
        if model not in SPARK_TREES:
            frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
        train = frame.where(F.col("split") == "train")
        out, seconds = frame, 0.0
        for t in targets:
            # a row without this target has no label to fit
            known = train.where(F.col(f"{t}__label").isNotNull()).withColumnRenamed(f"{t}__label", "label")
            begun = time.perf_counter()
            fitted = fit_model(model, known, "label", params)
            seconds += time.perf_counter() - begun
            out = fitted.predict(out, f"_p_{t}")
            if save_dir:
                save_fitted(fitted, model_path(save_dir, model, variant, t, h), spark)
        begun = time.perf_counter()
        out = out.select("row_id", "heldout", "split", *[f"c_{c}" for c in carry], *[f"y_{t}" for t in targets], *[
            EN.invert_minmax(F.col(f"_p_{t}"), F.col(f"{t}__min"), F.col(f"{t}__max")).alias(f"pred_{t}")
            for t in targets], F.lit(len(feats)).alias("n_features"))
        if model not in SPARK_TREES:
            out = spark.read.parquet(IO.write_table(out, IO.scratch_path(spark, f"predictions-{model}-fold{h}")))
            frame.unpersist()
        table = tiny(measure(out)) if measure else None
        return out, (h, seconds, time.perf_counter() - begun), table

    with InheritableThreads(spark, folds_at_a_time(folded, k, parallel)) as pool:
        results = pool.map(one_fold, range(k))
    scored, timings, tables = zip(*results)
    timing = spark.createDataFrame(timings, "heldout int, fit_seconds double, predict_seconds double")
    return reduce(DataFrame.unionByName, scored), timing, len(feats), reduce(DataFrame.unionByName, tables) if measure else None


def cross_validate(folded: DataFrame, model: str = "dt", variant: str = "tgt", k: int = 5,
                   target: str = "price", params: dict | None = None, parallel: int | None = None,
                   save_dir: str | None = None, metrics_path: str | None = None):
    """L2 (+L5): k-fold CV of one model on one variant.

    Returns ``(scored, fold_metrics, summary)``: predictions back in target
    units for train and test rows of every fold, the per-fold metrics (with
    fit and predict seconds) and the mean / population std over folds.
    ``metrics_path``: a metric table that the summary is appended to (S5).
    """
    def named(rows):
        return rows.withColumnRenamed(f"y_{target}", "y").withColumnRenamed(f"pred_{target}", "pred")

    scored, timing, n, fm = run_folds(folded, model, variant, k, (target,), params, save_dir, parallel,
                                      measure=lambda rows: ME.fold_split_metrics(named(rows), []))
    scored = named(scored)
    fm = (fm.join(F.broadcast(timing), "heldout")   # k rows
            .withColumn("model", F.lit(model)).withColumn("variant", F.lit(variant))
            .withColumn("n_features", F.lit(n)))
    summary = ME.cv_summary(fm.drop("fit_seconds", "predict_seconds", "n_features", "n_zero_target"),
                            ["model", "variant"], "pop")
    if metrics_path:
        IO.save_metrics(summary.withColumn("target", F.lit(target)), metrics_path, run=IO.run_key(
            mode="single", model=model, variant=variant, k=k, target=target, params=params))
    return scored, fm, summary


#: settings of a learner where ``params`` doesn't say otherwise
DEFAULT_SETTINGS = {"dt": {"max_depth": 6, "min_leaf": 2}, "rf": {"num_trees": 100, "max_depth": 30, "min_leaf": 2},
                    "gbt": {"rounds": 200, "step": 0.1, "max_depth": 5}, "boost": {"rounds": 20, "step": 0.1, "max_depth": 5},
                    "mlp": {"hidden_dims": [32, 32], "lr": 1e-2, "epochs": 50, "batch_size": 0}}


def evaluate_folds(folded: DataFrame, model: str, variant: str, save_dir: str, k: int = 5, targets=("price", "price_per_sqft"),
                   area: str = "sqft_living", params: dict | None = None, parallel: int | None = None) -> DataFrame:
    """A row per target, held-out fold and split: the five metrics in the target's own units,
    what the model was given (features, settings as JSON, which encodings), how long fitting and
    predicting took, and where the fold's model is saved."""
    rows = FE.price_per_area(folded, "price", area, "price_per_sqft") if "price_per_sqft" in targets else folded

    def of_targets(scored):
        own = [F.struct(F.lit(t).alias("target"), F.col(f"y_{t}").alias("y"), F.col(f"pred_{t}").alias("pred")) for t in targets]
        parts = scored.select("heldout", "split", "n_features", F.inline(F.array(*own)))
        return ME.fold_split_metrics(parts.where(F.col("y").isNotNull()), ["target"]).drop("n_zero_target")

    _, timing, n, m = run_folds(rows, model, variant, k, targets, params, save_dir, parallel, measure=of_targets)
    settings = json.dumps(DEFAULT_SETTINGS.get(model, {}) | (params or {}) | {"inputs": n}, sort_keys=True)
    path = F.concat(F.lit(f"{save_dir}/{model}_{variant}_"), F.col("target"), F.lit("_fold"), F.col("heldout").cast("string"))
    return m.join(F.broadcast(timing), "heldout").select(  # k rows
        F.lit(model).alias("model"), F.lit(variant).alias("variant"), "target", "heldout", "split", "n",
        F.lit(variant == "coord_only").alias("drop_address"), F.lit(variant in ("cat", "tgt_only")).alias("drop_coord"),
        F.lit(n).alias("n_features"), F.lit(settings).alias("settings"), "fit_seconds", "predict_seconds", path.alias("model_path"),
        *ME.METRIC_NAMES)


def blend_members(both: DataFrame, model: str, variant: str):
    """The stack's second half: ``both`` has y, pred_a (price member) and pred_b (price per
    area x area) for each row, held-out fold and split.  The weight is searched on a
    fold's train predictions and applied to both splits."""
    w = BL.optimize_weight(both.where(F.col("split") == "train"), ["heldout"], "y", "pred_a", "pred_b")
    blended = BL.apply_blend(both, w, ["heldout"])
    fm = ME.fold_split_metrics(blended, [])
    fm = fm.withColumn("model", F.lit(f"ensemble_{model}")).withColumn("variant", F.lit(variant))
    summary = ME.cv_summary(fm.drop("n_zero_target"), ["model", "variant"], "pop")
    return blended, fm, summary, w


def cross_validate_stack(folded: DataFrame, model: str = "dt", variant: str = "tgt", k: int = 5,
                         params: dict | None = None, area: str = "sqft_living", metrics_path: str | None = None):
    """L3: a price model and a price-per-area model on the same price-encoded features
    per fold; the blend weight is searched on each fold's train predictions (in
    dollars, pps predictions times the raw area), then both splits are blended."""
    withpps = FE.price_per_area(folded, "price", area, "price_per_sqft")
    scored, _, _, _ = run_folds(withpps, model, variant, k, ("price", "price_per_sqft"), params, carry=(area,))
    both = scored.select("row_id", "heldout", "split", "n_features", F.col("y_price").alias("y"),
                         F.col("pred_price").alias("pred_a"),
                         (F.col("pred_price_per_sqft") * F.col(f"c_{area}")).alias("pred_b"))
    out = blend_members(both, model, variant)
    if metrics_path:
        IO.save_metrics(out[2].withColumn("target", F.lit("price")), metrics_path, run=IO.run_key(
            mode="stack", model=model, variant=variant, k=k, area=area, params=params))
    return out


def grid(folded: DataFrame, models=("dt", "rf", "boost", "mlp"), variants=EN.VARIANTS,
         modes=("single", "stack"), k: int = 5, params: dict | None = None) -> DataFrame:
    """L4: every (model, variant, mode); returns the long metric table."""
    out = None
    for v in variants:
        for m in models:
            for mode in modes:
                if mode == "single":
                    _, _, s = cross_validate(folded, m, v, k, params=(params or {}).get(m))
                else:
                    _, _, s, _ = cross_validate_stack(folded, m, v, k, (params or {}).get(m))
                out = s if out is None else out.unionByName(s)
    return out


def map_table(engineered: DataFrame, raw: DataFrame, model: str = "dt", variant: str = "tgt",
              params: dict | None = None, q: float = 0.995, clip: float = 3.0) -> DataFrame:
    """L6 + J2: fit on all rows, predict, attach to raw coordinates by row key
    (positive price, actual <= quantile q, coordinates present), z-score
    against the actual (population std) and clip."""
    fp = EN.FoldPreprocessor(2, variant)
    # fit on everything: with fold 1 only, held-out fold 0 is empty and fits on all rows
    everything = engineered.withColumn("fold", F.lit(1))
    st = fp.fit(everything)
    fr = fp.transform(everything, st, 0).select(
        "row_id", EN.feature_vector(fp.feature_names(st)).alias("features"), F.col("price__label").alias("label"), "price__min", "price__max")
    fr = fr if model in SPARK_TREES else kept(fr)  # as in a run over folds
    fitted = fit_model(model, fr, "label", params)
    pred = fitted.predict(fr, "_ps").select(
        "row_id", EN.invert_minmax(F.col("_ps"), F.col("price__min"), F.col("price__max")).alias("pred"))
    placed = kept(FE.keep_positive(raw).select("row_id", F.col("price").alias("actual"), "lat", "long"))  # read by the quantile's passes, too
    coords = placed
    cap = F.broadcast(FE.outlier_cap(coords, "actual", q))
    coords = FE.drop_missing_coords(coords.crossJoin(cap).where(F.col("actual") <= F.col("cap")).drop("cap"))
    j = kept(coords.join(pred, "row_id", "inner"))   # counted, summed up and returned
    # Every coordinate row must find its prediction (row-count check)
    n_coords, n_joined = coords.count(), j.count()
    if n_coords != n_joined:
        raise ValueError(f"Coordinate rows ({n_coords}) do not match predicted rows ({n_joined}).")
    discard(placed)
    return FE.zscore_clip(j, "pred", "actual", clip)
