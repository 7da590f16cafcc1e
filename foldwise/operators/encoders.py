"""Leakage-free fold-wise encoders and scalers.

For held-out fold h the fit rows are ``fold != h``.  Every statistic is built
once from per-fold partials (one ``groupBy(fold, ...)`` pass over the data)
and then combined over the other k-1 folds on tables of k x k (x categories)
rows: no k copies of the data, no subtraction from totals (no cancellation);
variances combine with the parallel (Chan) formula.  Tables of k rows are
broadcast (size bounded by k); per-category tables are bounded lookups (see
``lookup``): broadcast after a check of their rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from foldwise.operators.lookup import bounded, small, tiny

# fixed values of the study's protocol: columns by scaling, encoded columns, variants
MINMAX_COLS = ("x", "y", "z", "condition", "age", "bedrooms", "bathrooms", "floors", "view")
ZSCORE_COLS = ("sqft_living", "sqft_above", "sqft_basement", "log_sqft_lot", "city", "zipcode")
TE_COLS = ("city", "zipcode")
VARIANTS = ("cat", "tgt", "coord_only", "tgt_only")


def heldouts(spark, k: int) -> DataFrame:
    import pyarrow as pa
    return spark.createDataFrame(pa.table({"heldout": pa.array(range(k), pa.int32())})).coalesce(1)


# ---------------------------------------------------------------- E0

def expand_folds(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """One copy of every row per held-out fold, labelled train/test."""
    return (df.crossJoin(F.broadcast(heldouts(df.sparkSession, k)))
              .withColumn("split", F.when(F.col(fold) == F.col("heldout"), "test")
                          .otherwise("train")))


def with_split(df: DataFrame, h: int, fold: str = "fold") -> DataFrame:
    """Rows of held-out fold ``h`` labelled train/test (no copy)."""
    return df.withColumn("heldout", F.lit(h)).withColumn(
        "split", F.when(F.col(fold) == h, "test").otherwise("train"))


# ---------------------------------------------------------------- A1 / E2

def category_stats(df: DataFrame, col: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """A1: mean and count per category plus the smoothed mean
    ``(n*m + s*g) / (n + s)`` with g the overall mean."""
    g = df.agg(F.avg(target).alias("global_mean"))
    per = df.groupBy(col).agg(F.avg(target).alias("mean"), F.count(F.lit(1)).alias("count"),
                              F.sum(target).alias("_sum"))
    return (per.crossJoin(F.broadcast(g))
               .withColumn("smoothed", (F.col("_sum") + smoothing * F.col("global_mean")) /
                           (F.col("count") + smoothing))
               .drop("_sum"))


def category_partials(df: DataFrame, cols, target: str, fold: str = "fold") -> DataFrame:
    """One pass over the data for every category column: per (fold, column,
    category) the target sum and the row count, written once (k x categories
    rows) so all encodings and encoded-column statistics read it.
    Categories are compared as text, so string and code columns mix."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("_cat"))
                                for c in cols]))
    long = df.select(F.col(fold).alias("_f"), F.col(target).alias("_y"), cells.alias("_c"))
    return small(long.groupBy("_f", F.col("_c.column").alias("column"), F.col("_c._cat").alias("_cat"))
                     .agg(F.sum("_y").alias("_s"), F.count(F.lit(1)).alias("_n")))


def encoding_tables(part: DataFrame, col: str, k: int, smoothing: float = 10.0):
    """Per held-out fold, the smoothed mean of each category of ``col`` over
    the other folds, and the other folds' global mean (from the partials)."""
    spark = part.sparkSession
    p = part.where(F.col("column") == col)
    h = F.broadcast(heldouts(spark, k))
    others = p.crossJoin(h).where(F.col("_f") != F.col("heldout"))
    gmean = others.groupBy("heldout").agg((F.sum("_s") / F.sum("_n")).alias("global_mean"))
    per = others.groupBy("heldout", "_cat").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    enc = (per.join(F.broadcast(gmean), "heldout")
              .select("heldout", F.col("_cat").alias(col),
                      ((F.col("_s") + smoothing * F.col("global_mean")) /
                       (F.col("_n") + smoothing)).alias("enc")))
    return enc, gmean


def oof_target_encoding(df: DataFrame, col: str, target: str, k: int,
                        smoothing: float = 10.0, fold: str = "fold"):
    """E2 fit: per held-out fold, smoothed target mean of each category over
    the rows of the other folds.

    Returns ``(enc, gmean)``: ``enc(heldout, <col> as text, enc)`` and
    ``gmean(heldout, global_mean)`` (default for unseen / missing categories).
    """
    return encoding_tables(category_partials(df, [col], target, fold), col, k, smoothing)


def apply_encoding(df: DataFrame, col: str, enc: DataFrame, gmean: DataFrame,
                   out: str | None = None) -> DataFrame:
    """Left lookup join on (heldout, category); unseen or missing -> global mean.  Whole numbers
    are compared as such, all else as text."""
    out = out or col
    kind = df.schema[col].dataType
    text = kind.simpleString() if isinstance(kind, IntegralType) else "string"
    e = enc.select(F.col("heldout").alias("_eh"), F.col(col).cast(text).alias("_cat"),
                   F.col("enc").alias("_enc"))
    g = gmean.select(F.col("heldout").alias("_gh"), F.col("global_mean").alias("_gm"))
    j = (df.join(e, (F.col("heldout") == F.col("_eh")) & (F.col(col).cast(text) == F.col("_cat")), "left")
           .join(F.broadcast(g), F.col("heldout") == F.col("_gh"), "left"))
    return (j.withColumn(out, F.coalesce(F.col("_enc"), F.col("_gm")))
             .drop("_eh", "_cat", "_enc", "_gh", "_gm"))


# ---------------------------------------------------------------- A21 partials

def _moments_by_heldout(part: DataFrame, k: int, keys=()) -> DataFrame:
    """Combine per-fold (n, mean, m2, min, max) rows over folds != heldout."""
    spark = part.sparkSession
    h = F.broadcast(heldouts(spark, k))
    others = part.crossJoin(h).where(F.col("_f") != F.col("heldout"))
    g = ["heldout", *keys]
    tot = others.groupBy(*g).agg(
        F.sum("_n").alias("n"),
        (F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).alias("mean"),
        F.min("_min").alias("min"), F.max("_max").alias("max"))
    m2 = (others.join(tot.select(*g, F.col("mean").alias("_gm")), g)
                .groupBy(*g).agg(F.sum(F.col("_m2") + F.col("_n") *
                                       (F.col("_mean") - F.col("_gm")) ** 2).alias("m2")))
    return tot.join(m2, g).select(*g, "n", "mean", "min", "max",
                                  F.sqrt(F.col("m2") / F.col("n")).alias("std"))


def fold_fit_stats(df: DataFrame, cols, k: int, fold: str = "fold") -> DataFrame:
    """A21 per held-out fold: ``(heldout, column, n, mean, min, max, std)``
    of each raw column over the train rows (population std)."""
    long = df.select(F.col(fold).alias("_f"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("_cv")).select("_f", "_cv.column", "_cv.v")
    part = tiny(long.groupBy("_f", "column").agg(  # k x columns rows, read twice below
        F.count("v").alias("_n"), F.avg("v").alias("_mean"),
        (F.var_pop("v") * F.count("v")).alias("_m2"), F.min("v").alias("_min"),
        F.max("v").alias("_max")))
    return _moments_by_heldout(part, k, ["column"])


def encoded_fit_stats(part: DataFrame, col: str, enc: DataFrame, k: int) -> DataFrame:
    """Fit statistics of an encoded column over train rows, from the
    (fold, category) counts of ``category_partials``: within a (fold,
    category) cell the encoded value is constant, so n, mean, m2, min, max
    are exact and no pass over the data is needed."""
    cells = part.where(F.col("column") == col).select("_f", "_cat", F.col("_n").alias("_cnt"))
    h = heldouts(part.sparkSession, k)
    cells = cells.crossJoin(F.broadcast(h)).where(F.col("_f") != F.col("heldout"))
    e = enc.select("heldout", F.col(col).cast("string").alias("_cat"), "enc")
    cells = cells.join(e, ["heldout", "_cat"], "inner")
    tot = cells.groupBy("heldout").agg(
        F.sum("_cnt").alias("n"), (F.sum(F.col("_cnt") * F.col("enc")) / F.sum("_cnt")).alias("mean"),
        F.min("enc").alias("min"), F.max("enc").alias("max"))
    m2 = (cells.join(tot.select("heldout", F.col("mean").alias("_gm")), "heldout")
               .groupBy("heldout").agg(F.sum(F.col("_cnt") * (F.col("enc") - F.col("_gm")) ** 2)
                                       .alias("m2")))
    return tot.join(m2, "heldout").select(
        "heldout", F.lit(col).alias("column"), "n", "mean", "min", "max",
        F.sqrt(F.col("m2") / F.col("n")).alias("std"))


# ---------------------------------------------------------------- E3/E4/E5 expressions

def minmax_expr(c: str):
    """(x - min) / span, span 0 -> 1 (a constant column maps to 0)."""
    span = F.col(f"{c}__max") - F.col(f"{c}__min")
    return (F.col(c) - F.col(f"{c}__min")) / F.when(span == 0, F.lit(1.0)).otherwise(span)


def zscore_expr(c: str):
    """(x - mean) / population std, std 0 -> 1."""
    sd = F.col(f"{c}__std")
    return (F.col(c) - F.col(f"{c}__mean")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)


def invert_minmax(v, lo, hi):
    """E5 inverse: v * (max - min) + min."""
    return v * (hi - lo) + lo


def scaling_arrays(scale: DataFrame, features, minmax_cols, zscore_cols) -> DataFrame:
    """Per held-out fold, what ``scaled`` subtracts from each feature and divides it by (min and
    span, mean and std; a divisor of 0 -> 1; 0 and 1 for a column that isn't scaled)."""
    shifts, spans = [], []
    for c in features:
        shift, span = F.lit(0.0), F.lit(1.0)
        if c in minmax_cols:
            shift, span = F.col(f"{c}__min"), F.col(f"{c}__max") - F.col(f"{c}__min")
        if c in zscore_cols:
            shift, span = F.col(f"{c}__mean"), F.col(f"{c}__std")
        shifts.append(shift)
        spans.append(F.when(span == 0, F.lit(1.0)).otherwise(span))
    return scale.select("heldout", F.array(*shifts).alias("_shift"), F.array(*spans).alias("_span"))


def scaled_array(features):
    """The features as one array, scaled by the row's ``_shift`` and ``_span``.  Loops over arrays: an
    expression a feature, each over four joined statistics, makes a method that is too long for
    the JVM to compile, and every row is interpreted."""
    values = F.array(*[F.col(c).cast("double") for c in features])
    return F.zip_with(F.zip_with(values, "_shift", lambda v, s: v - s), "_span", lambda v, s: v / s)


def wide_stats(stats_long: DataFrame, cols) -> DataFrame:
    """(heldout, column, ...) -> one row per heldout with ``<c>__min`` etc."""
    aggs = []
    for c in cols:
        for s in ("min", "max", "mean", "std"):
            aggs.append(F.max(F.when(F.col("column") == c, F.col(s))).alias(f"{c}__{s}"))
    return stats_long.groupBy("heldout").agg(*aggs)


def feature_vector(names) -> Column:
    """The columns as one dense vector.  A missing number fails the job, as in ``VectorAssembler``, which
    makes an object of each row and its numbers on the way."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in names])
    return array_to_vector(F.when(missing, F.raise_error(F.lit("a row without a number in one of its features has no vector")))
                            .otherwise(F.array(*names)))


# ---------------------------------------------------------------- E9

def equal_width_codes(value, lo, hi, bins: int = 5):
    """Right-closed equal-width bin codes 0..bins-1 over [lo, hi];
    values outside the range -> NULL; a constant range -> the middle bin."""
    w = (hi - lo) / bins
    code = F.greatest(F.ceil((value - lo) / w) - 1, F.lit(0))
    return (F.when(hi == lo, F.lit(bins // 2))
             .when((value < lo) | (value > hi), F.lit(None))
             .otherwise(F.least(code, F.lit(bins - 1))).cast("int"))


# ---------------------------------------------------------------- E6 / E11

def variant_columns(variant: str, base_features) -> list[str]:
    """Feature list of a location-encoding variant; unknown -> ValueError."""
    feats = list(base_features)
    if variant == "cat":
        return [c for c in feats if c not in ("x", "y", "z")]
    if variant == "tgt":
        return feats
    if variant == "coord_only":
        return [c for c in feats if c not in TE_COLS]
    if variant == "tgt_only":
        return [c for c in feats if c not in ("x", "y", "z")]
    raise ValueError(f"no location encoding named {variant!r}; known: {', '.join(VARIANTS)}")


BASE_FEATURES = ("bedrooms", "bathrooms", "sqft_living", "floors", "waterfront", "view",
                 "condition", "sqft_above", "sqft_basement", "city", "x", "y", "z", "zipcode",
                 "log_sqft_lot", "was_renovated", "age")


@dataclass
class FoldState:
    """Fitted per-fold tables of a FoldPreprocessor."""
    k: int
    variant: str
    features: list
    encodings: dict = field(default_factory=dict)   # col -> (enc, gmean)
    scale: DataFrame | None = None                  # one row per heldout
    target: DataFrame | None = None                 # heldout, <target>__min, <target>__max
    numbers: dict = field(default_factory=dict)     # heldout -> what scale and target have of it
    age_range: DataFrame | None = None


class FoldPreprocessor:
    """Encode -> MinMax -> Z-score -> optional age bins -> variant drops,
    every statistic fitted on the train rows of each held-out fold.

    Location encodings average ``target``; ``targets`` are the columns to predict,
    whose MinMax-scaled values become ``<t>__label`` (``label`` for the first)."""

    def __init__(self, k: int = 5, variant: str = "tgt", target: str = "price", targets=None,
                 smoothing: float = 10.0, minmax_cols=MINMAX_COLS, zscore_cols=ZSCORE_COLS,
                 age_bins: bool = False, age_fit_on: str = "train", fold: str = "fold",
                 base_features=BASE_FEATURES):
        if variant not in VARIANTS:
            raise ValueError(f"no location encoding named {variant!r}; known: {', '.join(VARIANTS)}")
        self.k, self.variant, self.target, self.smoothing = k, variant, target, smoothing
        self.targets = tuple(targets or (target,))
        self.minmax_cols, self.zscore_cols = tuple(minmax_cols), tuple(zscore_cols)
        self.age_bins, self.age_fit_on, self.fold = age_bins, age_fit_on, fold
        self.base_features = tuple(base_features)

    def fit(self, df: DataFrame) -> FoldState:
        feats = variant_columns(self.variant, [c for c in self.base_features if c in df.columns])
        st = FoldState(self.k, self.variant, feats)
        encode = self.variant != "cat"
        te_cols = [c for c in TE_COLS if c in feats] if encode else []
        # pass 1: (fold, column, category) partials for every encoded column
        if te_cols:
            part = category_partials(df, te_cols, self.target, self.fold)
            for c in te_cols:
                st.encodings[c] = encoding_tables(part, c, self.k, self.smoothing)
        scaled = [c for c in (*self.minmax_cols, *self.zscore_cols) if c in feats]
        raw_cols = [c for c in scaled if c not in te_cols]
        # pass 2: moments of every raw scaled column and of the target
        raw = fold_fit_stats(df, [*raw_cols, *self.targets], self.k, self.fold)
        parts = [raw.where(~F.col("column").isin(*self.targets))] if raw_cols else []
        for c in te_cols:
            if c in scaled:
                parts.append(encoded_fit_stats(part, c, st.encodings[c][0], self.k))
        stats_long = parts[0]
        for p in parts[1:]:
            stats_long = stats_long.unionByName(p)
        st.scale = wide_stats(stats_long, scaled)
        st.target = raw.groupBy("heldout").agg(*[
            F.max(F.when(F.col("column") == t, F.col(s))).alias(f"{t}__{s}")
            for t in self.targets for s in ("min", "max")])
        if self.age_bins and "age" in df.columns:
            st.age_range = fold_fit_stats(df, ["age"], self.k, self.fold).select(
                "heldout", F.col("min").alias("age__lo"), F.col("max").alias("age__hi"))
        return self._materialize(st)

    @staticmethod
    def _materialize(st: FoldState) -> FoldState:
        """Write the small fitted tables once (k rows, or k x categories), so
        every pass of a model fit reads them instead of re-aggregating the data."""
        st.encodings = {c: (bounded(e), tiny(g)) for c, (e, g) in st.encodings.items()}
        st.scale = tiny(st.scale)
        st.target = tiny(st.target)
        if st.age_range is not None:
            st.age_range = tiny(st.age_range)
        both = st.scale.join(F.broadcast(st.target), "heldout").collect()  # a row a fold
        st.numbers = {r["heldout"]: r.asDict() for r in both}
        return st

    def transform(self, df: DataFrame, st: FoldState, heldout: int | None = None) -> DataFrame:
        """Rows with ``heldout, split``, scaled features, and the MinMax-scaled targets
        as labels.  ``heldout=None`` expands all k folds (E0)."""
        out = expand_folds(df, st.k, self.fold) if heldout is None else with_split(
            df, heldout, self.fold)
        for c, (enc, gmean) in st.encodings.items():
            out = apply_encoding(out, c, enc, gmean)
        if heldout in st.numbers and st.age_range is None:
            return self._transform_one(df, out, st, st.numbers[heldout])
        arrays = scaling_arrays(st.scale, st.features, self.minmax_cols, self.zscore_cols)
        out = out.join(F.broadcast(arrays), "heldout").join(F.broadcast(st.target), "heldout")
        if st.age_range is not None:
            out = out.join(F.broadcast(st.age_range), "heldout")
            if self.age_fit_on == "own":
                own = out.groupBy("heldout", "split").agg(F.min("age").alias("_alo"),
                                                          F.max("age").alias("_ahi"))
                out = out.join(F.broadcast(own), ["heldout", "split"])
                lo, hi = F.col("_alo"), F.col("_ahi")
            else:
                lo, hi = F.col("age__lo"), F.col("age__hi")
            out = out.withColumn("age_bin", equal_width_codes(F.col("age"), lo, hi).cast("double"))
        feats = list(st.features) + (["age_bin"] if st.age_range is not None else [])
        keep = [c for c in df.columns if c not in self.base_features]
        scalable = {*self.minmax_cols, *self.zscore_cols}
        fixed = [c for c in feats if c not in scalable]
        labels = {f"{t}__label": minmax_expr(t) for t in self.targets}
        labels["label"] = minmax_expr(self.targets[0])
        rest = [*dict.fromkeys([*keep, "heldout", "split", *fixed, *[f"{t}__{s}" for t in self.targets for s in ("min", "max")]])]
        out = out.select(*rest, scaled_array(st.features).alias("_scaled"), *[v.alias(n) for n, v in labels.items()])
        at = {c: F.col("_scaled")[i].alias(c) for i, c in enumerate(st.features)}
        return out.select(*keep, "heldout", "split", *[F.col(c).cast("double") if c in fixed else at[c] for c in feats],
                          *labels, *[f"{t}__{s}" for t in self.targets for s in ("min", "max")])

    def _transform_one(self, df: DataFrame, out: DataFrame, st: FoldState, numbers: dict) -> DataFrame:
        """What ``transform`` gives for one fold, whose statistics are numbers in the plan: an operation
        or two a feature, which the JVM compiles, and nothing to join."""
        def number(name):
            return F.lit(numbers[name]).cast("double")

        def scaled(c):
            shift, span = number(f"{c}__mean" if c in self.zscore_cols else f"{c}__min"), None
            if c in self.zscore_cols:
                span = numbers[f"{c}__std"]
            elif None not in (numbers[f"{c}__max"], numbers[f"{c}__min"]):
                span = numbers[f"{c}__max"] - numbers[f"{c}__min"]
            return (F.col(c).cast("double") - shift) / F.lit(1.0 if span == 0 else span).cast("double")

        scalable = {*self.minmax_cols, *self.zscore_cols}
        out = out.withColumns({f"{t}__{s}": number(f"{t}__{s}") for t in self.targets for s in ("min", "max")})
        labels = {f"{t}__label": minmax_expr(t) for t in self.targets}
        labels["label"] = minmax_expr(self.targets[0])
        keep = [c for c in df.columns if c not in self.base_features]
        return out.select(*keep, "heldout", "split", *[(scaled(c) if c in scalable else F.col(c).cast("double")).alias(c) for c in st.features],
                          *[v.alias(n) for n, v in labels.items()], *[f"{t}__{s}" for t in self.targets for s in ("min", "max")])

    def feature_names(self, st: FoldState) -> list[str]:
        return list(st.features) + (["age_bin"] if st.age_range is not None else [])


def standardize_full(df: DataFrame, cols) -> DataFrame:
    """Z-score every column on the full data (population std)."""
    st = df.agg(*[F.avg(c).alias(f"{c}__mean") for c in cols],
                *[F.stddev_pop(c).alias(f"{c}__std") for c in cols])
    return (df.crossJoin(F.broadcast(st))
              .withColumns({c: zscore_expr(c) for c in cols})
              .drop(*[f"{c}__mean" for c in cols], *[f"{c}__std" for c in cols]))
