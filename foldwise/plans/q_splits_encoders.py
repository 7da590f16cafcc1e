"""Queries: splits (K1-K6) and fold-wise encoders / scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.scalar import round_half
from foldwise.operators import encoders as EN
from foldwise.operators import features as FE
from foldwise.operators import splits as SP
from foldwise.operators.lookup import dealt, discard
from foldwise.operators.metrics import regression_metrics
from foldwise.plans.registry import register
from foldwise.plans.sqltext import FOLDED, HASH_FOLD, HASH_KEY, SALES
from foldwise.sources.tables import read_table, sales

K = 5


def _r(c, d=6):
    return round_half(c, d)


def positive_sales(spark, sf_dir):
    return FE.keep_positive(sales(spark, sf_dir))


def folded(spark, sf_dir, mode="hash"):
    """Engineered frame with its fold id, materialized once in the checkpoint
    folder (every fold statistic and fit reads it; lineage is cut)."""
    engineered = FE.engineer(sales(spark, sf_dir))
    rows = dealt(SP.assign_folds(engineered, K, 42, "row_id", mode))
    discard(engineered)
    return rows


# ------------------------------------------------------------------ splits

@register("k1_folds_hash", f"WITH {SALES} SELECT row_id, {HASH_FOLD} AS fold FROM sales")
def k1_folds_hash(spark, sf_dir):
    """K1 (hash mode): fold = md5('42:row_id') first 32 bits mod 5; no shuffle."""
    return SP.assign_folds(sales(spark, sf_dir).select("row_id"), K, 42, mode="hash")


@register("k1_folds_exact", f"""WITH {SALES}
SELECT row_id, CAST(ntile(5) OVER (ORDER BY {HASH_KEY}, row_id) - 1 AS INTEGER) AS fold FROM sales""")
def k1_folds_exact(spark, sf_dir):
    """K1 (exact mode): k blocks in md5 order, sizes differ by at most one."""
    return SP.assign_folds(sales(spark, sf_dir).select("row_id"), K, 42, mode="exact")


@register("k2_train_test", f"""WITH {SALES},
o AS (SELECT row_id, row_number() OVER (ORDER BY {HASH_KEY}, row_id) - 1 AS pos, count(*) OVER () AS n FROM sales)
SELECT row_id, CASE WHEN pos < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM o""")
def k2_train_test(spark, sf_dir):
    """K2: 80/20 split, seed 42; the first ceil(0.2 n) rows in md5 order are test."""
    return SP.train_test_split(sales(spark, sf_dir).select("row_id"), 0.2, 42)


@register("k3_holdout", f"""WITH {SALES},
f AS (SELECT row_id, {HASH_FOLD} AS fold FROM sales WHERE price > 0),
h AS (SELECT CAST(range AS INTEGER) AS heldout FROM range(5)),
t AS (SELECT row_id, heldout,
             row_number() OVER (PARTITION BY heldout ORDER BY {HASH_KEY}, row_id) - 1 AS pos,
             count(*) OVER (PARTITION BY heldout) AS n
      FROM f, h WHERE fold <> heldout)
SELECT row_id, heldout, pos < floor(n * 0.1) AS is_val FROM t""")
def k3_holdout(spark, sf_dir):
    """K3: early-stopping hold-out, int(n * 0.1) rows in md5 order, inside
    each held-out fold's train rows."""
    df = SP.assign_folds(positive_sales(spark, sf_dir).select("row_id"), K, 42)
    train = EN.expand_folds(df, K).where(F.col("split") == "train").select("row_id", "heldout")
    return SP.holdout_split(train, 0.1, 42, by=["heldout"]).select("row_id", "heldout", "is_val")


@register("k4_stratified", """
WITH o AS (SELECT doc_id, quality,
                  row_number() OVER (PARTITION BY quality ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id) - 1 AS pos,
                  count(*) OVER (PARTITION BY quality) AS n
           FROM labels)
SELECT doc_id, quality, CASE WHEN pos < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM o""")
def k4_stratified(spark, sf_dir):
    """K4: stratified 80/20 split of the labels table by quality class."""
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    return SP.stratified_split(lab, "quality", 0.2, 42, key="doc_id").select(
        "doc_id", "quality", "split")


@register("k5_batches", f"""WITH {SALES},
o AS (SELECT row_id, row_number() OVER (ORDER BY md5(concat('{42 * 1000003}:', row_id)), row_id) - 1 AS pos,
             count(*) OVER () AS n FROM sales WHERE price > 0)
SELECT row_id, CAST(floor(pos / 1024) AS INTEGER) AS batch_id FROM o WHERE floor(pos / 1024) < floor(n / 1024)""")
def k5_batches(spark, sf_dir):
    """K5: mini-batch plan (batch 1024, epoch 0), incomplete last batch dropped."""
    return SP.batch_plan(positive_sales(spark, sf_dir).select("row_id"), 1024, epoch=0).select(
        "row_id", "batch_id")


@register("k6_subsample_ids", f"""WITH {SALES},
o AS (SELECT row_id, row_number() OVER (ORDER BY {HASH_KEY}, row_id) - 1 AS pos, count(*) OVER () AS n FROM sales)
SELECT row_id, price FROM sales WHERE row_id IN (SELECT row_id FROM o WHERE pos < ceil(n * 0.2))""")
def k6_subsample_ids(spark, sf_dir):
    """K6: keep the rows whose ids are in an id table (here the K2 test ids)."""
    s = sales(spark, sf_dir)
    ids = SP.train_test_split(s.select("row_id"), 0.2, 42).where(F.col("split") == "test")
    return SP.subsample_by_ids(s, ids).select("row_id", "price")


# ------------------------------------------------------------------ target encoding

_TE_SQL = f"""WITH {SALES},
f AS (SELECT row_id, city, price, {HASH_FOLD} AS fold FROM sales WHERE price > 0),
h AS (SELECT CAST(range AS INTEGER) AS heldout FROM range(5)),
g AS (SELECT heldout, avg(price) AS gm FROM f, h WHERE fold <> heldout GROUP BY heldout),
te AS (SELECT heldout, city, (sum(price) + 10 * any_value(gm)) / (count(*) + 10) AS enc, count(*) AS n_train
       FROM f JOIN g ON f.fold <> g.heldout GROUP BY heldout, city)"""


def _te(spark, sf_dir):
    df = SP.assign_folds(positive_sales(spark, sf_dir).select("row_id", "city", "price"), K, 42)
    enc, gmean = EN.oof_target_encoding(df, "city", "price", K, 10.0)
    return df, enc, gmean


@register("e2_target_encoding", _TE_SQL + " SELECT heldout, city, round(enc, 4) AS enc FROM te")
def e2_target_encoding(spark, sf_dir):
    """Smoothed (s=10) target encoding of city, fitted per held-out fold on the other folds."""
    _, enc, _ = _te(spark, sf_dir)
    return enc.select("heldout", "city", _r("enc", 4).alias("enc"))


@register("e2_oof_metrics", _TE_SQL + """,
scored AS (SELECT f.fold AS heldout, f.price AS y, coalesce(te.enc, g.gm) AS pred
           FROM f JOIN g ON f.fold = g.heldout LEFT JOIN te ON te.heldout = f.fold AND te.city = f.city)
SELECT heldout, count(*) AS n, round(sqrt(avg((y - pred) ^ 2)), 4) AS RMSE, round(avg(abs(y - pred)), 4) AS MAE,
       round(avg(abs((y - pred) / y)) * 100, 6) AS MAPE,
       round(1 - sum((y - pred) ^ 2) / (var_pop(y) * count(*)), 8) AS R2
FROM scored GROUP BY heldout""")
def e2_oof_metrics(spark, sf_dir):
    """E2 + J1 + A11: out-of-fold encoded city used as the predictor of price, metrics per fold."""
    df, enc, gmean = _te(spark, sf_dir)
    test = df.withColumn("heldout", F.col("fold"))
    test = EN.apply_encoding(test, "city", enc, gmean, out="pred")
    m = regression_metrics(test, ["heldout"], "price", "pred")
    return m.select("heldout", "n", _r("RMSE", 4).alias("RMSE"), _r("MAE", 4).alias("MAE"),
                    _r("MAPE", 6).alias("MAPE"), _r("R2", 8).alias("R2"))


@register("a1_category_stats", f"""WITH {SALES},
s AS (SELECT city, price FROM sales WHERE price > 0),
g AS (SELECT avg(price) AS gm FROM s)
SELECT city, round(avg(price), 4) AS mean, count(*) AS count,
       round((sum(price) + 10 * any_value(gm)) / (count(*) + 10), 4) AS smoothed FROM s, g GROUP BY city""")
def a1_category_stats(spark, sf_dir):
    """A1: mean and count per category and the smoothed mean (all rows)."""
    st = EN.category_stats(positive_sales(spark, sf_dir), "city", "price", 10.0)
    return st.select("city", _r("mean", 4).alias("mean"), "count", _r("smoothed", 4).alias("smoothed"))


@register("e0_expand_folds", f"""WITH {SALES},
f AS (SELECT row_id, {HASH_FOLD} AS fold FROM sales WHERE price > 0)
SELECT row_id, fold, CAST(range AS INTEGER) AS heldout, CASE WHEN fold = range THEN 'test' ELSE 'train' END AS split
FROM f, range(5)""")
def e0_expand_folds(spark, sf_dir):
    """Fold-expanded frame, each row labelled train/test for every held-out fold."""
    df = SP.assign_folds(positive_sales(spark, sf_dir).select("row_id"), K, 42)
    return EN.expand_folds(df, K).select("row_id", "fold", "heldout", "split")


# ------------------------------------------------------------------ scalers on the engineered frame

_STATS_SQL = "WITH " + FOLDED + """,
long AS (SELECT heldout, col AS "column", v FROM expanded
         CROSS JOIN LATERAL (VALUES ('x', x), ('y', y), ('z', z), ('condition', CAST(condition AS DOUBLE)),
                             ('age', CAST(age AS DOUBLE)), ('bedrooms', CAST(bedrooms AS DOUBLE)),
                             ('bathrooms', bathrooms), ('floors', floors), ('view', CAST(view AS DOUBLE)),
                             ('sqft_living', sqft_living), ('sqft_above', sqft_above),
                             ('sqft_basement', sqft_basement), ('log_sqft_lot', log_sqft_lot),
                             ('city', CAST(city AS DOUBLE)), ('zipcode', CAST(zipcode AS DOUBLE)),
                             ('price', price)) t(col, v)
         WHERE split = 'train')"""


@register("a21_fold_fit_stats", _STATS_SQL + """
SELECT heldout, "column", count(v) AS n, round(avg(v), 6) AS mean, round(min(v), 8) AS min,
       round(max(v), 8) AS max, round(stddev_pop(v), 6) AS std FROM long GROUP BY heldout, 2""")
def a21_fold_fit_stats(spark, sf_dir):
    """Min, max, mean, population std of every scaled column over each fold's train rows."""
    cols = [*EN.MINMAX_COLS, *EN.ZSCORE_COLS, "price"]
    st = EN.fold_fit_stats(folded(spark, sf_dir), cols, K)
    return st.select("heldout", "column", "n", _r("mean").alias("mean"), _r("min", 8).alias("min"),
                     _r("max", 8).alias("max"), _r("std").alias("std"))


def _fold_frame_sql(variant: str, extra: str = "") -> str:
    """DuckDB text of the E11 fold preprocessing for one variant (brute force over expanded rows)."""
    te = variant != "cat"
    sql = "WITH " + FOLDED + ",\n"
    if te:
        sql += """gm AS (SELECT heldout, avg(price) AS gm FROM expanded WHERE split = 'train' GROUP BY heldout),
tc AS (SELECT e.heldout, city AS cat, (sum(price) + 10 * any_value(gm)) / (count(*) + 10) AS enc
       FROM expanded e JOIN gm ON e.heldout = gm.heldout WHERE split = 'train' GROUP BY e.heldout, city),
tz AS (SELECT e.heldout, zipcode AS cat, (sum(price) + 10 * any_value(gm)) / (count(*) + 10) AS enc
       FROM expanded e JOIN gm ON e.heldout = gm.heldout WHERE split = 'train' GROUP BY e.heldout, zipcode),
enc AS (SELECT e.* REPLACE (coalesce(tc.enc, gm.gm) AS city, coalesce(tz.enc, gm.gm) AS zipcode)
        FROM expanded e JOIN gm ON e.heldout = gm.heldout
        LEFT JOIN tc ON tc.heldout = e.heldout AND tc.cat = e.city
        LEFT JOIN tz ON tz.heldout = e.heldout AND tz.cat = e.zipcode),\n"""
    else:
        sql += "enc AS (SELECT * REPLACE (CAST(city AS DOUBLE) AS city, CAST(zipcode AS DOUBLE) AS zipcode) FROM expanded),\n"
    mm = ["x", "y", "z", "condition", "age", "bedrooms", "bathrooms", "floors", "view"]
    zs = ["sqft_living", "sqft_above", "sqft_basement", "log_sqft_lot", "city", "zipcode"]
    feats = EN.variant_columns(variant, EN.BASE_FEATURES)
    mm = [c for c in mm if c in feats]
    zs = [c for c in zs if c in feats]
    aggs = []
    for c in mm:
        aggs += [f"min({c}) AS {c}__min", f"max({c}) AS {c}__max"]
    for c in zs:
        aggs += [f"avg({c}) AS {c}__mean", f"stddev_pop({c}) AS {c}__std"]
    aggs += ["min(price) AS target__min", "max(price) AS target__max"]
    sql += f"st AS (SELECT heldout, {', '.join(aggs)} FROM enc WHERE split = 'train' GROUP BY heldout),\n"
    cols = []
    for c in feats:
        if c in mm:
            cols.append(f"(CAST({c} AS DOUBLE) - {c}__min) / CASE WHEN {c}__max = {c}__min THEN 1 ELSE {c}__max - {c}__min END AS {c}")
        elif c in zs:
            cols.append(f"({c} - {c}__mean) / CASE WHEN {c}__std = 0 THEN 1 ELSE {c}__std END AS {c}")
        else:
            cols.append(f"CAST({c} AS DOUBLE) AS {c}")
    cols.append("(price - target__min) / CASE WHEN target__max = target__min THEN 1 ELSE target__max - target__min END AS label")
    sql += f"fp AS (SELECT row_id, price, enc.heldout, split, {', '.join(cols)} FROM enc JOIN st ON enc.heldout = st.heldout)\n"
    return sql + extra


def _fold_frame(spark, sf_dir, variant: str):
    df = folded(spark, sf_dir)
    fp = EN.FoldPreprocessor(K, variant)
    st = fp.fit(df)
    return fp.transform(df, st), fp.feature_names(st)


def _round_cols(cols, d=6):
    return ", ".join(f"round({c}, {d}) AS {c}" for c in cols)


@register("e3_minmax_fold", _fold_frame_sql("tgt", "SELECT row_id, heldout, split, "
                                            + _round_cols(["x", "condition", "age", "bedrooms", "bathrooms"]) + " FROM fp"))
def e3_minmax_fold(spark, sf_dir):
    """MinMax scaling fitted on each fold's train rows (test values may leave [0, 1])."""
    df, _ = _fold_frame(spark, sf_dir, "tgt")
    return df.select("row_id", "heldout", "split",
                     *[_r(c).alias(c) for c in ("x", "condition", "age", "bedrooms", "bathrooms")])


@register("e4_zscore_fold", _fold_frame_sql("cat", "SELECT row_id, heldout, split, "
                                           + _round_cols(["sqft_living", "sqft_basement", "log_sqft_lot", "city", "zipcode"]) + " FROM fp"))
def e4_zscore_fold(spark, sf_dir):
    """Z-score (population std) fitted on each fold's train rows (cat variant: codes scaled)."""
    df, _ = _fold_frame(spark, sf_dir, "cat")
    return df.select("row_id", "heldout", "split",
                     *[_r(c).alias(c) for c in ("sqft_living", "sqft_basement", "log_sqft_lot", "city", "zipcode")])


@register("e5_target_scale", _fold_frame_sql("coord_only", """,
ys AS (SELECT heldout, min(price) AS lo, max(price) AS hi FROM expanded WHERE split = 'train' GROUP BY heldout)
SELECT row_id, fp.heldout, split, round(label, 8) AS label, round(label * (hi - lo) + lo, 4) AS price_back
FROM fp JOIN ys ON fp.heldout = ys.heldout"""))
def e5_target_scale(spark, sf_dir):
    """E5: target MinMax-scaled per fold on train rows, and its inverse."""
    df, _ = _fold_frame(spark, sf_dir, "coord_only")
    back = EN.invert_minmax(F.col("label"), F.col("price__min"), F.col("price__max"))
    return df.select("row_id", "heldout", "split", _r("label", 8).alias("label"),
                     _r(back, 4).alias("price_back"))


@register("e6_variant_tgt_only", _fold_frame_sql("tgt_only", "SELECT row_id, heldout, split, "
                                                 + _round_cols(["city", "zipcode", "age"]) + " FROM fp"))
def e6_variant_tgt_only(spark, sf_dir):
    """The tgt_only variant (target-encoded address, no coordinates) per fold."""
    df, feats = _fold_frame(spark, sf_dir, "tgt_only")
    assert "x" not in feats and len(feats) == 14
    return df.select("row_id", "heldout", "split", *[_r(c).alias(c) for c in ("city", "zipcode", "age")])


_ALL17 = list(EN.BASE_FEATURES)


@register("e11_fold_preprocess", _fold_frame_sql("tgt", "SELECT row_id, price, heldout, split, "
                                                 + _round_cols(_ALL17 + ["label"]) + " FROM fp"))
def e11_fold_preprocess(spark, sf_dir):
    """Full fold preprocessing of the tgt variant (encode, MinMax, Z-score, target scale)."""
    df, feats = _fold_frame(spark, sf_dir, "tgt")
    return df.select("row_id", "price", "heldout", "split", *[_r(c).alias(c) for c in feats + ["label"]])


@register("e9_age_bins", "WITH " + FOLDED + """,
r AS (SELECT heldout, min(age) AS lo, max(age) AS hi FROM expanded WHERE split = 'train' GROUP BY heldout)
SELECT row_id, e.heldout, split,
       CAST(CASE WHEN hi = lo THEN 2 WHEN age < lo OR age > hi THEN NULL
                 ELSE least(greatest(ceil((age - lo) / ((hi - lo) / 5)) - 1, 0), 4) END AS INTEGER) AS age_bin
FROM expanded e JOIN r ON e.heldout = r.heldout""")
def e9_age_bins(spark, sf_dir):
    """5 equal-width right-closed age bins, range fitted on each fold's train rows."""
    df = folded(spark, sf_dir)
    rng = EN.fold_fit_stats(df, ["age"], K).select("heldout", F.col("min").alias("lo"),
                                                   F.col("max").alias("hi"))
    ex = EN.expand_folds(df.select("row_id", "fold", "age"), K).join(F.broadcast(rng), "heldout")
    return ex.select("row_id", "heldout", "split",
                     EN.equal_width_codes(F.col("age"), F.col("lo"), F.col("hi"), 5).alias("age_bin"))


@register("e10_standardize_full", "WITH " + FOLDED + """
SELECT row_id, round((sqft_living - avg(sqft_living) OVER ()) / stddev_pop(sqft_living) OVER (), 6) AS sqft_living,
       round((log_sqft_lot - avg(log_sqft_lot) OVER ()) / stddev_pop(log_sqft_lot) OVER (), 6) AS log_sqft_lot
FROM engineered""")
def e10_standardize_full(spark, sf_dir):
    """Plain z-score of columns on the full data (population std)."""
    df = FE.engineer(sales(spark, sf_dir)).select("row_id", "sqft_living", "log_sqft_lot")
    out = EN.standardize_full(df, ["sqft_living", "log_sqft_lot"])
    return out.select("row_id", _r("sqft_living").alias("sqft_living"),
                      _r("log_sqft_lot").alias("log_sqft_lot"))


@register("p9_features_label", "WITH " + FOLDED + """
SELECT row_id, price AS label, 17 AS n_features,
       round(bedrooms + bathrooms + sqft_living + floors + waterfront + view + condition + sqft_above
             + sqft_basement + city + x + y + z + zipcode + log_sqft_lot + was_renovated + age, 4) AS feature_sum
FROM engineered""")
def p9_features_label(spark, sf_dir):
    """Separate the target (label) from the 17 features assembled into one vector."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    eng = FE.engineer(sales(spark, sf_dir))
    v = VectorAssembler(inputCols=list(EN.BASE_FEATURES), outputCol="features").transform(eng)
    arr = vector_to_array("features")
    return v.select("row_id", F.col("price").alias("label"), F.size(arr).alias("n_features"),
                    _r(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), 4).alias("feature_sum"))


@register("u3_split_rows", "WITH " + FOLDED + """
SELECT heldout, split, count(*) AS n, round(sum(price), 2) AS price_sum FROM expanded GROUP BY heldout, split""")
def u3_split_rows(spark, sf_dir):
    """Train and validation rows of every held-out fold in one frame (split column, no union)."""
    ex = EN.expand_folds(folded(spark, sf_dir), K)
    return ex.groupBy("heldout", "split").agg(F.count(F.lit(1)).alias("n"),
                                              _r(F.sum("price"), 2).alias("price_sum"))
