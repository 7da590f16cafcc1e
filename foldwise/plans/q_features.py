"""Queries: cleaning, derived features, quantiles, summaries, ranks (P, A2-A5, A17, E1, E8, J3, J4, W, T1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import scalar as S
from foldwise.operators.lookup import bounded
from foldwise.operators import features as FE
from foldwise.operators import stats as ST
from foldwise.operators.ordering import global_row_number
from foldwise.plans.registry import register
from foldwise.plans.sqltext import ENGINEERED, SALES
from foldwise.sources.tables import sales

R8 = 8


def _r(c, d=4):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def engineered(spark, sf_dir):
    return FE.engineer(sales(spark, sf_dir))


@register("p1_cartesian", f"""WITH {SALES}
SELECT row_id, round(cos(radians(lat)) * cos(radians(long)), 8) AS x,
       round(cos(radians(lat)) * sin(radians(long)), 8) AS y, round(sin(radians(lat)), 8) AS z
FROM sales""")
def p1_cartesian(spark, sf_dir):
    """lat/long to unit-sphere x, y, z (null stays null)."""
    df = FE.add_cartesian(sales(spark, sf_dir))
    return df.select("row_id", _r("x", R8).alias("x"), _r("y", R8).alias("y"), _r("z", R8).alias("z"))


@register("p2_positive_price", f"WITH {SALES} SELECT row_id, price FROM sales WHERE price > 0")
def p2_positive_price(spark, sf_dir):
    """Keep rows with a positive price."""
    return FE.keep_positive(sales(spark, sf_dir)).select("row_id", "price")


@register("p3_outlier_report", f"""WITH {SALES},
s AS (SELECT price FROM sales WHERE price > 0),
c AS (SELECT quantile_cont(price, 0.999) AS cap FROM s)
SELECT round(cap, 4) AS cap, count(*) AS n_before, count_if(price > cap) AS removed,
       count_if(price <= cap) AS n_after, max(price) FILTER (WHERE price <= cap) AS max_after
FROM s, c GROUP BY cap""")
def p3_outlier_report(spark, sf_dir):
    """Exact 0.999 quantile cap of positive prices; counts before/after and max kept."""
    _, report, _ = FE.drop_upper_outliers(FE.keep_positive(sales(spark, sf_dir)), "price", 0.999)
    return report.withColumn("cap", _r("cap"))


@register("p3_outlier_dropped", f"""WITH {SALES},
s AS (SELECT row_id, price FROM sales WHERE price > 0),
c AS (SELECT quantile_cont(price, 0.999) AS cap FROM s)
SELECT row_id, price FROM s, c WHERE price > cap""")
def p3_outlier_dropped(spark, sf_dir):
    """Keys of the rows above the cap, largest first."""
    _, _, dropped = FE.drop_upper_outliers(FE.keep_positive(sales(spark, sf_dir)), "price", 0.999)
    return dropped.select("row_id", "price")


@register("p4_zipcode", rf"""WITH {SALES}
SELECT row_id, nullif(regexp_extract(statezip, '(\d{{5}})', 1), '') AS zipcode FROM sales""")
def p4_zipcode(spark, sf_dir):
    """5-digit zip from statezip, no match -> NULL."""
    return sales(spark, sf_dir).select("row_id", S.zip5("statezip").alias("zipcode"))


@register("p5_log_lot", f"WITH {SALES} SELECT row_id, round(ln(1 + sqft_lot), 8) AS log_sqft_lot FROM sales")
def p5_log_lot(spark, sf_dir):
    """P5: log1p of the lot area (replaces sqft_lot)."""
    df = sales(spark, sf_dir)
    df = df.withColumn("log_sqft_lot", F.log1p("sqft_lot")).drop("sqft_lot")
    return df.select("row_id", _r("log_sqft_lot", R8).alias("log_sqft_lot"))


@register("p6_renovated", f"""WITH {SALES}
SELECT row_id, CASE WHEN yr_renovated > 0 THEN 1 ELSE 0 END AS was_renovated FROM sales""")
def p6_renovated(spark, sf_dir):
    """Renovated flag as int."""
    return sales(spark, sf_dir).select("row_id", S.renovated_flag("yr_renovated").alias("was_renovated"))


@register("p7_age", f"""WITH {SALES}
SELECT row_id, year(CAST(date AS TIMESTAMP)) - yr_built AS age FROM sales""")
def p7_age(spark, sf_dir):
    """Age at sale = year(date) - yr_built."""
    return sales(spark, sf_dir).select("row_id", S.age_at_sale("date", "yr_built").alias("age"))


@register("p8_drop_columns", f"""WITH {SALES}
SELECT * EXCLUDE (street, country, statezip, lat, long) FROM sales""")
def p8_drop_columns(spark, sf_dir):
    """Drop address text and coordinate columns."""
    return sales(spark, sf_dir).drop("street", "country", "statezip", "lat", "long")


@register("p11_engineered", f"""WITH {ENGINEERED}
SELECT row_id, price, bedrooms, bathrooms, sqft_living, floors, waterfront, view, condition,
       sqft_above, sqft_basement, city, round(x, 8) AS x, round(y, 8) AS y, round(z, 8) AS z,
       zipcode, round(log_sqft_lot, 8) AS log_sqft_lot, was_renovated, age
FROM engineered""")
def p11_engineered(spark, sf_dir):
    """The whole cleaning chain -> engineered frame (target + 17 features)."""
    df = engineered(spark, sf_dir)
    return df.withColumns({c: _r(c, R8) for c in ("x", "y", "z", "log_sqft_lot")})


@register("p12_price_per_area", f"""WITH {SALES}
SELECT row_id, price / nullif(sqft_living, 0) AS price_per_sqft,
       price / nullif(sqft_living, 0) * sqft_living AS price_back FROM sales""")
def p12_price_per_area(spark, sf_dir):
    """Price per living area and its inverse (pps x area)."""
    df = FE.price_per_area(sales(spark, sf_dir))
    return df.select("row_id", "price_per_sqft",
                     (F.col("price_per_sqft") * F.col("sqft_living")).alias("price_back"))


@register("p14_zscore_clip", f"""WITH {SALES},
s AS (SELECT row_id, price AS y, price * (85e-2 + bedrooms / 4e1) AS pred FROM sales WHERE price > 0),
m AS (SELECT avg(y) AS mu, stddev_pop(y) AS sd FROM s)
SELECT row_id, round((pred - mu) / sd, 6) AS value_zscore,
       round(greatest(least((pred - mu) / sd, 3), -3), 6) AS value_zscore_clipped FROM s, m""")
def p14_zscore_clip(spark, sf_dir):
    """Z-score of a prediction against the actual's mean / population std, clipped to +-3."""
    s = FE.keep_positive(sales(spark, sf_dir)).select(
        "row_id", F.col("price").alias("y"),
        (F.col("price") * (F.lit(0.85) + F.col("bedrooms") / F.lit(40.0))).alias("pred"))
    out = FE.zscore_clip(s, "pred", "y", 3.0)
    return out.select("row_id", _r("value_zscore", 6).alias("value_zscore"),
                      _r("value_zscore_clipped", 6).alias("value_zscore_clipped"))


@register("p15_drop_missing_coords", f"""WITH {SALES}
SELECT row_id FROM sales WHERE lat IS NOT NULL AND long IS NOT NULL""")
def p15_drop_missing_coords(spark, sf_dir):
    """Drop rows with missing coordinates."""
    return FE.drop_missing_coords(sales(spark, sf_dir)).select("row_id")


_RANKS = f"""WITH {SALES},
r AS (SELECT row_id, city, price, sqft_living, price / sqft_living AS pps,
             row_number() OVER (ORDER BY price DESC, row_id) AS price_rank,
             row_number() OVER (ORDER BY price / sqft_living DESC, row_id) AS per_sqft_rank
      FROM sales)"""


def _ranked(spark, sf_dir):
    df = sales(spark, sf_dir).select("row_id", "city", "price", "sqft_living",
                                     S.safe_ratio("price", "sqft_living").alias("pps"))
    df = global_row_number(df, [F.col("price").desc(), F.col("row_id").asc()], "price_rank")
    return global_row_number(df, [F.col("pps").desc(), F.col("row_id").asc()], "per_sqft_rank")


@register("w1_rank_all", _RANKS + " SELECT row_id, price_rank, per_sqft_rank FROM r")
def w1_rank_all(spark, sf_dir):
    """Rank every row by price and by price per area, descending, ties by row order."""
    return _ranked(spark, sf_dir).select("row_id", "price_rank", "per_sqft_rank")


@register("w2_rank_change_band", _RANKS + """
SELECT city, price, sqft_living, round(pps, 6) AS price_per_sqft, price_rank, per_sqft_rank,
       price_rank - per_sqft_rank AS rank_change
FROM r WHERE price_rank BETWEEN 10 AND 25""")
def w2_rank_change_band(spark, sf_dir):
    """W2 + P16: rows ranked 10..25 by price and where they land by price per area."""
    r = _ranked(spark, sf_dir).where(F.col("price_rank").between(10, 25))
    return r.select("city", "price", "sqft_living", _r("pps", 6).alias("price_per_sqft"),
                    "price_rank", "per_sqft_rank",
                    (F.col("price_rank") - F.col("per_sqft_rank")).alias("rank_change")
                    ).orderBy("price_rank")


@register("w3_group_mean", f"""WITH {SALES}
SELECT row_id, city, round(avg(price) OVER (PARTITION BY city), 4) AS city_mean_price FROM sales""")
def w3_group_mean(spark, sf_dir):
    """Mean over the city group attached to every row (aggregate + join,
    not a window over a possibly hot key)."""
    df = sales(spark, sf_dir).select("row_id", "city", "price")
    m = bounded(df.groupBy(F.col("city").alias("_city")).agg(F.avg("price").alias("city_mean_price")))
    return df.join(m, F.col("city").eqNullSafe(F.col("_city"))).select("row_id", "city", _r("city_mean_price").alias("city_mean_price"))


@register("j4_scalar_to_rows", f"""WITH {SALES},
c AS (SELECT quantile_cont(price, 0.999) AS cap, avg(price) AS mu FROM sales)
SELECT row_id, round(price / cap, 8) AS price_over_cap, round(price - mu, 4) AS price_minus_mean,
       price > cap AS above_cap FROM sales, c""")
def j4_scalar_to_rows(spark, sf_dir):
    """One-row statistics (cap, mean) applied to all rows by a broadcast cross join."""
    df = sales(spark, sf_dir).select("row_id", "price")
    one = FE.outlier_cap(df, "price", 0.999).crossJoin(df.agg(F.avg("price").alias("mu")))
    j = df.crossJoin(F.broadcast(one))
    return j.select("row_id", _r(F.col("price") / F.col("cap"), 8).alias("price_over_cap"),
                    _r(F.col("price") - F.col("mu")).alias("price_minus_mean"),
                    (F.col("price") > F.col("cap")).alias("above_cap"))


@register("a2_quantiles", f"WITH {SALES} " + " UNION ALL ".join(
    f"SELECT {q} AS q, round(quantile_cont(price, {q}), 4) AS value FROM sales"
    for q in (0.001, 0.25, 0.5, 0.75, 0.99, 0.995, 0.999)))
def a2_quantiles(spark, sf_dir):
    """A2: exact quantiles with linear interpolation (distributed, no single-task gather)."""
    qs = [0.001, 0.25, 0.5, 0.75, 0.99, 0.995, 0.999]
    return ST.quantiles_long(sales(spark, sf_dir), "price", qs).select("q", _r("value").alias("value"))


@register("a3_describe", f"""WITH {SALES}
SELECT count(price) AS count, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS std,
       min(price) AS min, round(quantile_cont(price, 0.25), 4) AS p25,
       round(quantile_cont(price, 0.5), 4) AS p50, round(quantile_cont(price, 0.75), 4) AS p75,
       max(price) AS max FROM sales""")
def a3_describe(spark, sf_dir):
    """A3: count, mean, sample std, min, quartiles, max of the raw price."""
    d = ST.describe(sales(spark, sf_dir), "price")
    return d.withColumns({c: _r(c) for c in ("mean", "std", "p25", "p50", "p75")})


@register("a4_conditional_counts", f"""WITH {SALES},
c AS (SELECT quantile_cont(price, 0.999) AS cap FROM sales)
SELECT count(*) AS n, count_if(price = 0) AS n_zero, count_if(price > cap) AS n_above_cap,
       count_if(price > 0 AND price <= cap) AS n_trimmed,
       count(*) - count_if(price > 0 AND price <= cap) AS n_dropped FROM sales, c""")
def a4_conditional_counts(spark, sf_dir):
    """A4: zero prices, rows above the cap, before/after trim counts in one aggregate."""
    df = sales(spark, sf_dir).select("price")
    j = df.crossJoin(F.broadcast(FE.outlier_cap(df, "price", 0.999)))
    kept = (F.col("price") > 0) & (F.col("price") <= F.col("cap"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("price") == 0).alias("n_zero"),
                 F.count_if(F.col("price") > F.col("cap")).alias("n_above_cap"),
                 F.count_if(kept).alias("n_trimmed"),
                 (F.count(F.lit(1)) - F.count_if(kept)).alias("n_dropped"))


@register("a5_median_trimmed", f"""WITH {SALES},
c AS (SELECT quantile_cont(price, 0.999) AS cap FROM sales)
SELECT round(median(price), 4) AS median FROM sales, c WHERE price > 0 AND price <= cap""")
def a5_median_trimmed(spark, sf_dir):
    """A5: median of the trimmed prices (0 < price <= 0.999 cap)."""
    df = sales(spark, sf_dir).select("price")
    t = df.crossJoin(F.broadcast(FE.outlier_cap(df, "price", 0.999))).where(
        (F.col("price") > 0) & (F.col("price") <= F.col("cap")))
    return ST.median(t, "price").select(_r("median").alias("median"))


def _hist_sql(where: str, bins: int) -> str:
    return f"""WITH {SALES},
c AS (SELECT quantile_cont(price, 0.999) AS cap, quantile_cont(price, 0.99) AS q99 FROM sales),
v AS (SELECT price AS x FROM sales, c WHERE {where}),
r AS (SELECT min(x) AS mn, max(x) AS mx FROM v),
b AS (SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((x - mn) / (mx - mn) * {bins}), {bins - 1}) END AS INTEGER) AS bin,
             count(*) AS cnt FROM v, r GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
SELECT g.bin, round(mn + (mx - mn) * g.bin / {bins}, 4) AS lo, round(mn + (mx - mn) * (g.bin + 1) / {bins}, 4) AS hi,
       coalesce(cnt, 0) AS count
FROM g CROSS JOIN r LEFT JOIN b ON g.bin = b.bin"""


def _hist(spark, sf_dir, which: str, bins: int):
    df = sales(spark, sf_dir).select("price")
    caps = ST.quantile_row(df, "price", {"cap": 0.999, "q99": 0.99})
    j = df.crossJoin(F.broadcast(caps))
    cond = {"raw": F.lit(True), "positive": F.col("price") > 0,
            "tail": F.col("price") > F.col("q99"),
            "trimmed": (F.col("price") > 0) & (F.col("price") <= F.col("cap"))}[which]
    h = ST.histogram(j.where(cond), "price", bins)
    return h.select("bin", _r("lo").alias("lo"), _r("hi").alias("hi"), "count")


@register("a17_hist_raw", _hist_sql("TRUE", 100))
def a17_hist_raw(spark, sf_dir):
    """100 equal-width bins of the raw price (empty bins kept)."""
    return _hist(spark, sf_dir, "raw", 100)


@register("a17_hist_positive", _hist_sql("price > 0", 100))
def a17_hist_positive(spark, sf_dir):
    """100 bins of positive prices."""
    return _hist(spark, sf_dir, "positive", 100)


@register("a17_hist_tail", _hist_sql("price > q99", 40))
def a17_hist_tail(spark, sf_dir):
    """40 bins of the top 1 % tail."""
    return _hist(spark, sf_dir, "tail", 40)


@register("a17_hist_trimmed", _hist_sql("price > 0 AND price <= cap", 100))
def a17_hist_trimmed(spark, sf_dir):
    """100 bins after dropping zero prices and the top 0.1 %."""
    return _hist(spark, sf_dir, "trimmed", 100)


@register("t1_outlier_rows", f"""WITH {SALES},
c AS (SELECT quantile_cont(price, 0.999) AS cap FROM sales)
SELECT price, bedrooms, bathrooms, sqft_living, city, statezip FROM sales, c WHERE price > cap""")
def t1_outlier_rows(spark, sf_dir):
    """Rows above the 0.999 cap of all prices, largest first, few columns."""
    df = sales(spark, sf_dir)
    j = df.crossJoin(F.broadcast(FE.outlier_cap(df, "price", 0.999)))
    return (j.where(F.col("price") > F.col("cap"))
             .orderBy(F.col("price").desc(), "row_id")
             .select("price", "bedrooms", "bathrooms", "sqft_living", "city", "statezip"))


@register("e1_ordinal_codes", f"""WITH {SALES},
s AS (SELECT row_id, city, nullif(regexp_extract(statezip, '(\\d{{5}})', 1), '') AS zip FROM sales),
cc AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT city AS v FROM s WHERE city IS NOT NULL)),
zc AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT zip AS v FROM s WHERE zip IS NOT NULL))
SELECT row_id, coalesce(cc.code, -1) AS city, coalesce(zc.code, -1) AS zipcode
FROM s LEFT JOIN cc ON s.city = cc.v LEFT JOIN zc ON s.zip = zc.v""")
def e1_ordinal_codes(spark, sf_dir):
    """Ordinal codes by sorted distinct value, missing -> -1 (fitted on all rows)."""
    df = sales(spark, sf_dir).select("row_id", "city", S.zip5("statezip").alias("zipcode"))
    return FE.ordinal_codes(df, ["city", "zipcode"]).select("row_id", "city", "zipcode")


@register("e8_impute_coords", f"""WITH {SALES},
s AS (SELECT row_id, city, cos(radians(lat)) * cos(radians(long)) AS x,
             cos(radians(lat)) * sin(radians(long)) AS y, sin(radians(lat)) AS z FROM sales),
cm AS (SELECT city, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM s GROUP BY city),
f AS (SELECT row_id, coalesce(x, mx) AS x, coalesce(y, my) AS y, coalesce(z, mz) AS z
      FROM s LEFT JOIN cm ON s.city = cm.city),
g AS (SELECT avg(x) AS gx, avg(y) AS gy, avg(z) AS gz FROM f)
SELECT row_id, round(coalesce(x, gx), 8) AS x, round(coalesce(y, gy), 8) AS y, round(coalesce(z, gz), 8) AS z
FROM f, g""")
def e8_impute_coords(spark, sf_dir):
    """City-mean then overall-mean imputation of x, y, z (second mean over the filled column)."""
    df = FE.add_cartesian(sales(spark, sf_dir)).select("row_id", "city", "x", "y", "z")
    f = FE.fill_missing_coords(df)
    return f.select("row_id", _r("x", R8).alias("x"), _r("y", R8).alias("y"), _r("z", R8).alias("z"))
