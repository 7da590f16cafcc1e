"""Queries: metrics, fold summaries, blend, stacking and result reports
(A6-A16, A18-A20, A22, A23, J6, P13, P17-P20, T2-T4, U1-U3, M10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import blend as BL
from foldwise.operators import encoders as EN
from foldwise.operators import metrics as ME
from foldwise.operators import reports as RP
from foldwise.operators import splits as SP
from foldwise.operators.lookup import spread, tiny
from foldwise.plans.registry import register
from foldwise.plans.sqltext import HASH_FOLD, SALES, SCORED
from foldwise.sources.tables import read_table, scored

K = 5
MET = ("RMSE", "MAE", "MAPE", "R2", "Adjusted_R2")


def _r(c, d=6):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def _rmet(df, cols=MET, d=6):
    return df.withColumns({c: _r(c, d) for c in cols if c in df.columns})


# ------------------------------------------------------------------ the metric step of the CV study

def scored_folds(spark, sf_dir):
    """Scored rows with their fold, materialized once: the weight fit and the
    fold-expanded metric pass both read it (one scan of the inputs)."""
    return spread(SP.assign_folds(scored(spark, sf_dir), K, 42))


def blend_weights(sf):
    """A12 per (model, variant, heldout): grid weight fitted on the train rows
    of each held-out fold, from per-fold sufficient statistics."""
    st = tiny(BL.blend_sufficient_stats(sf, ["model", "variant", "fold"]))  # configurations x folds
    h = EN.heldouts(sf.sparkSession, K)
    others = st.crossJoin(F.broadcast(h)).where(F.col("fold") != F.col("heldout"))
    comb = others.groupBy("model", "variant", "heldout").agg(
        *[F.sum(c).alias(c) for c in ("_n", "_dd", "_de", "_ee")])
    grid = sf.sparkSession.range(101).select((F.col("id") / F.lit(100)).alias("w"))
    sse = F.col("_dd") - 2 * F.col("w") * F.col("_de") + F.col("w") * F.col("w") * F.col("_ee")
    g = comb.crossJoin(F.broadcast(grid)).withColumn(
        "rmse", F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("_n")))
    return g.groupBy("model", "variant", "heldout").agg(
        F.min_by("w", F.struct("rmse", "w")).alias("best_w"), F.min("rmse").alias("best_rmse"))


def fold_metrics(spark, sf_dir):
    """Single-model rows (pred_a) and ensemble rows (per-fold blend), per (heldout, split)."""
    sf = scored_folds(spark, sf_dir)
    nf = F.broadcast(ME.n_features_table(spark))
    ex = EN.expand_folds(sf, K).join(nf, "variant")
    single = ex.withColumn("pred", F.col("pred_a"))
    w = blend_weights(sf)
    ens = (BL.apply_blend(ex, w, ["model", "variant", "heldout"])
             .withColumn("model", F.concat(F.lit("ensemble_"), F.col("model"))))
    cols = ["model", "variant", "heldout", "split", "y", "pred", "n_features"]
    both = single.select(*cols).unionByName(ens.select(*cols))
    return ME.fold_split_metrics(both, ["model", "variant"])


def metrics_long(spark, sf_dir):
    """metrics_long table: mean and population std over folds, per config and split."""
    s = ME.cv_summary(fold_metrics(spark, sf_dir), ["model", "variant"], "pop")
    return s.withColumn("target", F.lit("price"))


_BASE = f"""WITH {SALES}, {SCORED},
sf AS (SELECT *, {HASH_FOLD} AS fold FROM scored),
h AS (SELECT CAST(range AS INTEGER) AS heldout FROM range(5)),
ex AS MATERIALIZED (SELECT sf.*, heldout, CASE WHEN fold = heldout THEN 'test' ELSE 'train' END AS split FROM sf, h),
nf AS (SELECT * FROM (VALUES ('cat', 14), ('tgt', 17), ('coord_only', 15), ('tgt_only', 14)) t(variant, n_features)),
grid AS (SELECT range / 100 AS w FROM range(101)),
wr AS (SELECT model, variant, heldout, w, sqrt(avg((y - (w * pred_a + (1 - w) * pred_b)) ^ 2)) AS rmse
       FROM ex, grid WHERE split = 'train' GROUP BY model, variant, heldout, w),
bw AS MATERIALIZED (SELECT model, variant, heldout, first(w ORDER BY rmse, w) AS best_w, min(rmse) AS best_rmse
       FROM wr GROUP BY model, variant, heldout),
preds AS (SELECT model, variant, heldout, split, y, pred_a AS pred FROM ex
          UNION ALL
          SELECT 'ensemble_' || ex.model, ex.variant, ex.heldout, split, y, best_w * pred_a + (1 - best_w) * pred_b
          FROM ex JOIN bw ON ex.model = bw.model AND ex.variant = bw.variant AND ex.heldout = bw.heldout),
fm0 AS (SELECT model, variant, heldout, split, count(*) AS n, sqrt(avg((y - pred) ^ 2)) AS RMSE,
               avg(abs(y - pred)) AS MAE, avg(abs((y - pred) / y)) * 100 AS MAPE,
               1 - sum((y - pred) ^ 2) / (var_pop(y) * count(*)) AS R2
        FROM preds GROUP BY model, variant, heldout, split),
fm AS (SELECT fm0.*, CASE WHEN n - n_features - 1 > 0 THEN 1 - (1 - R2) * (n - 1) / (n - n_features - 1) END AS Adjusted_R2
       FROM fm0 JOIN nf USING (variant)),
flong AS (UNPIVOT fm ON RMSE, MAE, MAPE, R2, Adjusted_R2 INTO NAME metric VALUE value),
ml AS (SELECT model, variant, split, metric, avg(value) AS value, stddev_pop(value) AS std
       FROM flong GROUP BY model, variant, split, metric)"""


@register("a11_fold_metrics", _BASE + """
SELECT model, variant, heldout, split, n, round(RMSE, 4) AS RMSE, round(MAE, 4) AS MAE,
       round(MAPE, 6) AS MAPE, round(R2, 8) AS R2, round(Adjusted_R2, 8) AS Adjusted_R2 FROM fm""")
def a11_fold_metrics(spark, sf_dir):
    """A11 (+A6-A10, U3): five metrics per (model, variant, held-out fold, split), single and ensemble."""
    fm = fold_metrics(spark, sf_dir).drop("n_zero_target")
    return fm.withColumns({"RMSE": _r("RMSE", 4), "MAE": _r("MAE", 4), "MAPE": _r("MAPE", 6),
                           "R2": _r("R2", 8), "Adjusted_R2": _r("Adjusted_R2", 8)})


@register("a13_a14_cv_summary", _BASE + """
SELECT model, variant, split, metric, round(value, 4) AS value, round(std, 4) AS std, 'price' AS target FROM ml""")
def a13_a14_cv_summary(spark, sf_dir):
    """A13/A14 (S5 rows): mean and population std of each metric over the 5 folds."""
    ml = metrics_long(spark, sf_dir)
    return ml.select("model", "variant", "split", "metric", _r("value", 4).alias("value"),
                     _r("std", 4).alias("std"), "target")


@register("a12_blend_weight", _BASE + " SELECT model, variant, heldout, best_w, round(best_rmse, 4) AS best_rmse FROM bw")
def a12_blend_weight(spark, sf_dir):
    """Per config and held-out fold, the grid weight (101 steps) with the
    smallest train RMSE of the blend; one pass of sufficient statistics."""
    w = blend_weights(scored_folds(spark, sf_dir))
    return w.select("model", "variant", "heldout", "best_w", _r("best_rmse", 4).alias("best_rmse"))


@register("j6_weight_grid", f"""WITH {SALES}, {SCORED},
grid AS (SELECT range / 100 AS w FROM range(101))
SELECT model, w, round(sqrt(avg((y - (w * pred_a + (1 - w) * pred_b)) ^ 2)), 4) AS rmse FROM scored, grid GROUP BY model, w""")
def j6_weight_grid(spark, sf_dir):
    """RMSE of every grid weight per model (sufficient statistics x 101-step grid)."""
    g = BL.weight_grid(scored(spark, sf_dir), ["model"])
    return g.select("model", "w", _r("rmse", 4).alias("rmse"))


# the sums of a fold's train rows hold all that the search of a weight needs
@register("p13_blend_apply", f"""WITH {SALES}, {SCORED},
sf AS MATERIALIZED (SELECT row_id, model, variant, y, pred_a, pred_b, {HASH_FOLD} AS fold FROM scored),
st AS MATERIALIZED (
  SELECT model, variant, fold, count(*) AS n, sum((y - pred_b) ^ 2) AS dd, sum((y - pred_b) * (pred_a - pred_b)) AS de,
         sum((pred_a - pred_b) ^ 2) AS ee FROM sf GROUP BY ALL),
tr AS MATERIALIZED (
  SELECT model, variant, CAST(range AS INTEGER) AS heldout, sum(n) AS n, sum(dd) AS dd, sum(de) AS de, sum(ee) AS ee
  FROM st, range(5) WHERE fold <> range GROUP BY ALL),
bw AS MATERIALIZED (
  SELECT model, variant, heldout, first(range / 100 ORDER BY sqrt(greatest(dd - 2 * (range / 100) * de + (range / 100) ^ 2 * ee, 0) / n), range) AS best_w
  FROM tr, range(101) GROUP BY ALL)
SELECT row_id, sf.model, heldout, round(best_w * pred_a + (1 - best_w) * pred_b, 4) AS pred
FROM sf JOIN bw ON sf.model = bw.model AND sf.variant = bw.variant AND sf.fold = bw.heldout""")
def p13_blend_apply(spark, sf_dir):
    """Blended out-of-fold prediction w*a + (1-w)*b with the fold's weight joined in."""
    sf = scored_folds(spark, sf_dir)
    w = blend_weights(sf)
    test = sf.withColumn("heldout", F.col("fold"))
    b = BL.apply_blend(test, w, ["model", "variant", "heldout"])
    return b.select("row_id", "model", "heldout", _r("pred", 4).alias("pred"))


def _simple_metric_sql(expr: str, name: str, extra: str = "") -> str:
    return f"""WITH {SALES}, {SCORED}
SELECT model, {expr} AS {name}{extra} FROM scored GROUP BY model"""


@register("a6_rmse", _simple_metric_sql("round(avg((y - pred_a) ^ 2), 2)", "MSE",
                                        ", round(sqrt(avg((y - pred_a) ^ 2)), 4) AS RMSE"))
def a6_rmse(spark, sf_dir):
    """MSE and RMSE per model."""
    m = ME.regression_metrics(scored(spark, sf_dir), ["model"], "y", "pred_a")
    return m.select("model", _r(F.col("RMSE") * F.col("RMSE"), 2).alias("MSE"), _r("RMSE", 4).alias("RMSE"))


@register("a7_mae", _simple_metric_sql("round(avg(abs(y - pred_b)), 4)", "MAE"))
def a7_mae(spark, sf_dir):
    """MAE per model."""
    m = ME.regression_metrics(scored(spark, sf_dir), ["model"], "y", "pred_b")
    return m.select("model", _r("MAE", 4).alias("MAE"))


@register("a8_mape", f"""WITH {SALES},
s AS (SELECT city, price AS y, price * 0.9 + 1000 AS p FROM sales)
SELECT city, round(avg(abs((y - p) / nullif(y, 0))) * 100, 6) AS MAPE, count_if(y = 0) AS n_zero_target
FROM s GROUP BY city""")
def a8_mape(spark, sf_dir):
    """MAPE x 100 per city over all rows; zero targets are skipped and counted."""
    from foldwise.sources.tables import sales
    s = sales(spark, sf_dir).select("city", F.col("price").alias("y"),
                                    (F.col("price") * 0.9 + 1000).alias("p"))
    m = ME.regression_metrics(s, ["city"], "y", "p")
    return m.select("city", _r("MAPE", 6).alias("MAPE"), "n_zero_target")


@register("a9_r2", _simple_metric_sql("round(1 - sum((y - pred_a) ^ 2) / (var_pop(y) * count(*)), 8)", "R2"))
def a9_r2(spark, sf_dir):
    """R2 = 1 - SSres/SStot per model."""
    m = ME.regression_metrics(scored(spark, sf_dir), ["model"], "y", "pred_a")
    return m.select("model", _r("R2", 8).alias("R2"))


@register("a10_adjusted_r2", f"""WITH {SALES}, {SCORED},
nf AS (SELECT * FROM (VALUES ('cat', 14), ('tgt', 17), ('coord_only', 15), ('tgt_only', 14)) t(variant, n_features)),
m AS (SELECT model, variant, count(*) AS n, 1 - sum((y - pred_a) ^ 2) / (var_pop(y) * count(*)) AS r2
      FROM scored GROUP BY model, variant)
SELECT model, variant, round(CASE WHEN n - n_features - 1 > 0 THEN 1 - (1 - r2) * (n - 1) / (n - n_features - 1) END, 8) AS Adjusted_R2
FROM m JOIN nf USING (variant)""")
def a10_adjusted_r2(spark, sf_dir):
    """A10: Adjusted R2 with the variant's feature count; NULL when n - p - 1 <= 0."""
    s = scored(spark, sf_dir).join(F.broadcast(ME.n_features_table(spark)), "variant")
    agg = s.groupBy("model", "variant").agg(*ME.metric_aggs("y", "pred_a"),
                                            F.first("n_features").alias("_p"))
    m = ME.finish_metrics(agg, F.col("_p"))
    return m.select("model", "variant", _r("Adjusted_R2", 8).alias("Adjusted_R2"))


@register("a15_model_mean_sample_std", _BASE + """
SELECT model, metric, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std
FROM flong WHERE split = 'test' AND variant = 'tgt' GROUP BY model, metric""")
def a15_model_mean_sample_std(spark, sf_dir):
    """Mean and sample std over folds, by model (test split, tgt variant)."""
    fm = fold_metrics(spark, sf_dir).where((F.col("split") == "test") & (F.col("variant") == "tgt"))
    long = ME.to_long(fm, ["model", "heldout"])
    s = ME.fold_summary(long, ["model"], "samp")
    return s.select("model", "metric", _r("value", 4).alias("mean"), _r("std", 4).alias("std"))


@register("a16_winners", _BASE + """,
t AS (SELECT model, metric, value FROM ml WHERE split = 'test' AND variant = 'tgt'),
sg AS (SELECT t.*, CASE WHEN metric IN ('R2', 'Adjusted_R2') THEN -value ELSE value END AS s FROM t)
SELECT metric, first(model ORDER BY s, model) AS model, round(first(value ORDER BY s, model), 4) AS value
FROM sg GROUP BY metric""")
def a16_winners(spark, sf_dir):
    """Best model per metric (lower is better for errors, higher for R2)."""
    ml = metrics_long(spark, sf_dir).where((F.col("split") == "test") & (F.col("variant") == "tgt"))
    w = ME.winners(ml.select("model", "metric", "value"))
    return w.select("metric", "model", _r("value", 4).alias("value"))


@register("u2_a18_stacked_mae", f"""WITH {SALES}, {SCORED},
st AS (SELECT model || '_a' AS model, pred_a AS pred, y FROM scored
       UNION ALL SELECT model || '_b', pred_b, y FROM scored)
SELECT model, round(avg(abs(y - pred)), 4) AS MAE FROM st GROUP BY model""")
def u2_a18_stacked_mae(spark, sf_dir):
    """U2 + A18: stack predictions as (model, pred, y), MAE by model, ascending."""
    s = scored(spark, sf_dir)
    st = s.select(F.concat("model", F.lit("_a")).alias("model"), F.col("pred_a").alias("pred"), "y") \
        .unionByName(s.select(F.concat("model", F.lit("_b")).alias("model"),
                              F.col("pred_b").alias("pred"), "y"))
    m = st.groupBy("model").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("MAE"))
    return m.select("model", _r("MAE", 4).alias("MAE")).orderBy("MAE")


# ------------------------------------------------------------------ reports over metrics_long

def _adj(spark, sf_dir, exclude=None):
    return RP.metric_slice(metrics_long(spark, sf_dir), "test", "Adjusted_R2",
                           exclude_prefix=exclude)


@register("t2_leaderboard", _BASE + """
SELECT model, variant, round(value, 6) AS adjusted_r2_test, round(std, 6) AS adjusted_r2_std
FROM ml WHERE split = 'test' AND metric = 'Adjusted_R2'""")
def t2_leaderboard(spark, sf_dir):
    """T2 + P17 + P20: Adjusted R2 on the test split, best first."""
    lb = RP.leaderboard(_adj(spark, sf_dir))
    return lb.withColumns({"adjusted_r2_test": _r("adjusted_r2_test"),
                           "adjusted_r2_std": _r("adjusted_r2_std")})


_TOP7 = """,
adj AS (SELECT model, variant, value AS v, std FROM ml WHERE split = 'test' AND metric = 'Adjusted_R2' {filt}),
rk AS (SELECT *, row_number() OVER (ORDER BY v DESC, model, variant) AS rn FROM adj),
sel AS (SELECT * FROM rk WHERE rn <= 7 OR (model = 'rf' AND variant = 'cat'))
SELECT model, variant, round(v, 6) AS adjusted_r2_test, round(std, 6) AS adjusted_r2_std,
       (model = 'rf' AND variant = 'cat') AS is_baseline,
       replace(model || ' / ' || CASE WHEN contains(variant, 'tgt') AND NOT contains(variant, 'tgt_only')
                                      THEN 'tgt + coord' ELSE variant END, 'mgbdt', 'XGBoost') AS label
FROM sel"""


def _top7(spark, sf_dir, exclude):
    t = RP.top_k_with_baseline(_adj(spark, sf_dir, exclude), 7)
    return t.withColumns({"adjusted_r2_test": _r("adjusted_r2_test"),
                          "adjusted_r2_std": _r("adjusted_r2_std")})


@register("t3_top7_with_baseline", _BASE + _TOP7.format(filt=""))
def t3_top7_with_baseline(spark, sf_dir):
    """T3 + U1 + P18 + P19: top 7 configs plus the rf/cat baseline, display label, baseline flag."""
    return _top7(spark, sf_dir, None)


@register("t3_top7_no_ensemble", _BASE + _TOP7.format(filt="AND NOT starts_with(model, 'ensemble')"))
def t3_top7_no_ensemble(spark, sf_dir):
    """T3 + P17: the same over non-ensemble models only."""
    return _top7(spark, sf_dir, "ensemble")


@register("t4_variant_order", _BASE + """,
o AS (SELECT * FROM (VALUES ('tgt', 0), ('coord_only', 1), ('tgt_only', 2), ('cat', 3), ('geo', 4)) t(variant, pos))
SELECT o.variant, pos, round(value, 6) AS adjusted_r2_test
FROM o LEFT JOIN (SELECT * FROM ml WHERE model = 'rf' AND split = 'test' AND metric = 'Adjusted_R2') m
ON o.variant = m.variant""")
def t4_variant_order(spark, sf_dir):
    """T4: rf variants in a fixed order; a category with no rows ('geo') stays as a NULL row."""
    adj = _adj(spark, sf_dir).where(F.col("model") == "rf").select("variant", "adjusted_r2_test")
    order = list(RP.VARIANT_ORDER) + ["geo"]
    spark_ = adj.sparkSession
    cat = spark_.createDataFrame([(v, i) for i, v in enumerate(order)], "variant string, pos int")
    out = cat.join(adj, "variant", "left").orderBy("pos")
    return out.select("variant", "pos", _r("adjusted_r2_test").alias("adjusted_r2_test"))


@register("a22_mean_std_pivot", _BASE + """
SELECT model,
  max(CASE WHEN variant = 'tgt' THEN printf('%.4f ± %.4f', value, std) END) AS tgt,
  max(CASE WHEN variant = 'coord_only' THEN printf('%.4f ± %.4f', value, std) END) AS coord_only,
  max(CASE WHEN variant = 'tgt_only' THEN printf('%.4f ± %.4f', value, std) END) AS tgt_only,
  max(CASE WHEN variant = 'cat' THEN printf('%.4f ± %.4f', value, std) END) AS cat
FROM ml WHERE split = 'test' AND metric = 'R2' GROUP BY model""")
def a22_mean_std_pivot(spark, sf_dir):
    """Model x variant table of 'mean ± std' (test R2)."""
    return RP.mean_std_pivot(metrics_long(spark, sf_dir), "R2", "test")


@register("a23_improvement", _BASE + """,
p AS (SELECT model, variant, max(CASE WHEN metric = 'RMSE' THEN value END) AS rmse,
             max(CASE WHEN metric = 'Adjusted_R2' THEN value END) AS adj
      FROM ml WHERE split = 'test' GROUP BY model, variant),
b AS (SELECT rmse AS brmse, adj AS badj FROM p WHERE model = 'rf' AND variant = 'cat')
SELECT model, variant, round((brmse - rmse) / brmse, 8) AS rmse_reduction, round(adj - badj, 8) AS adj_r2_gain FROM p, b""")
def a23_improvement(spark, sf_dir):
    """RMSE reduction and Adjusted R2 gain of every config over the rf/cat baseline."""
    imp = RP.improvement_over_baseline(metrics_long(spark, sf_dir))
    return imp.withColumns({"rmse_reduction": _r("rmse_reduction", 8),
                            "adj_r2_gain": _r("adj_r2_gain", 8)})


# ------------------------------------------------------------------ array metrics on embeddings

_EMB = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS p FROM embeddings)"""


def _emb(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    p = F.col("embedding").cast("array<double>")
    onehot = F.transform(p, lambda v, i: F.when(i == F.col("label"), F.lit(1.0)).otherwise(F.lit(0.0)))
    return e.select("vec_id", "label", p.alias("p"), onehot.alias("t"))


@register("a19_argmax_accuracy", f"""WITH {_EMB}
SELECT round(avg(CASE WHEN list_position(p, list_max(p)) - 1 = label THEN 1.0 ELSE 0.0 END), 8) AS accuracy,
       count(*) AS n FROM e""")
def a19_argmax_accuracy(spark, sf_dir):
    """Accuracy of the argmax over the embedding values against the label."""
    acc = ME.argmax_accuracy(_emb(spark, sf_dir), "p", "label")
    return acc.select(_r("accuracy", 8).alias("accuracy"), "n")


@register("a20_losses", f"""WITH {_EMB},
l AS (SELECT p, label, list_max(p) AS mx,
             list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - CASE WHEN i - 1 = label THEN 1.0 ELSE 0.0 END) ^ 2)) AS se,
             list_sum(list_transform(range(1, len(p) + 1), lambda i: abs(p[i] - CASE WHEN i - 1 = label THEN 1.0 ELSE 0.0 END))) AS ae
      FROM e)
SELECT round(sum(se) / sum(len(p)), 8) AS mse, round(sum(ae) / sum(len(p)), 8) AS l1,
       round(avg(mx + ln(list_sum(list_transform(p, lambda v: exp(v - mx)))) - p[label + 1]), 8) AS ce
FROM l""")
def a20_losses(spark, sf_dir):
    """MSE, L1 and cross-entropy over array predictions (sum / n)."""
    e = _emb(spark, sf_dir)
    return e.agg(*[F.round(ME.loss_value("p", "t", kind), 8).alias(kind) for kind in ("mse", "l1", "ce")])


@register("m10_target_step", f"""WITH {_EMB}
SELECT vec_id, i - 1 AS pos, round(p[i] - 0.5 * 2 * (p[i] - CASE WHEN i - 1 = label THEN 1.0 ELSE 0.0 END), 8) AS target
FROM e, unnest(range(1, len(p) + 1)) r(i)""")
def m10_target_step(spark, sf_dir):
    """Next-layer target H - lr * dLoss/dH (summed MSE, lr 0.5) per output slot."""
    e = _emb(spark, sf_dir).withColumn("tgt", ME.target_step("p", "t", 0.5, "mse"))
    return e.select("vec_id", F.posexplode("tgt").alias("pos", "target")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), _r("target", 8).alias("target"))
