"""Queries: sources and sinks (S1-S10, J7) — write data derived from the given
tables to the shared scratch folder, read it back through the readers, and
compare with SQL over the original tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.scalar import hash_fraction
from foldwise.operators import encoders as EN
from foldwise.operators import features as FE
from foldwise.operators import splits as SP
from foldwise.operators.lookup import discard, kept
from foldwise.plans.q_metrics_reports import fold_metrics, metrics_long
from foldwise.plans.registry import register
from foldwise.plans.sqltext import ENGINEERED, HASH_KEY, SALES
from foldwise.plans.q_metrics_reports import _BASE as METRIC_CTES
from foldwise.sources import io as IO
from foldwise.sources.tables import read_table, sales

SALES_DDL = ("row_id string, price double, date string, bedrooms int, bathrooms double, "
             "sqft_living double, sqft_lot double, floors double, waterfront int, view int, "
             "condition int, sqft_above double, sqft_basement double, yr_built bigint, "
             "yr_renovated bigint, street string, city string, statezip string, country string, "
             "lat double, long double")


def _r(c, d=6):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


@register("s1_csv_scan", f"WITH {SALES} SELECT * FROM sales")
def s1_csv_scan(spark, sf_dir):
    """S1 + S3: write the raw records as CSV with a header, scan them back with an explicit schema."""
    path = IO.scratch_path(spark, "sales-csv")
    IO.write_table(sales(spark, sf_dir), path, "csv")
    return IO.read_csv(spark, path, SALES_DDL)


@register("s3_engineered_parquet", f"""WITH {ENGINEERED}
SELECT row_id, price, city, zipcode, round(x, 8) AS x, round(log_sqft_lot, 8) AS log_sqft_lot, age FROM engineered""")
def s3_engineered_parquet(spark, sf_dir):
    """S3: write the engineered frame (parquet) and read it back."""
    path = IO.scratch_path(spark, "engineered")
    IO.write_table(FE.engineer(sales(spark, sf_dir)), path)
    df = spark.read.parquet(path)
    return df.select("row_id", "price", "city", "zipcode", _r("x", 8).alias("x"),
                     _r("log_sqft_lot", 8).alias("log_sqft_lot"), "age")


# ------------------------------------------------------------------ S2 / S4

def _variant_frames(spark, sf_dir):
    from foldwise.plans.cv import base_variants
    features = FE.engineer(sales(spark, sf_dir))
    split = kept(SP.train_test_split(features, 0.2, 42))
    discard(features)
    return base_variants(split)


_SPLIT_SQL = f"""WITH {ENGINEERED},
o AS (SELECT *, row_number() OVER (ORDER BY {HASH_KEY}, row_id) - 1 AS pos, count(*) OVER () AS n FROM engineered),
sp AS (SELECT * EXCLUDE (pos, n), CASE WHEN pos < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM o),
gm AS (SELECT avg(price) AS gm FROM sp WHERE split = 'train'),
tc AS (SELECT city AS cat, (sum(price) + 10 * any_value(gm)) / (count(*) + 10) AS enc FROM sp, gm WHERE split = 'train' GROUP BY city),
tz AS (SELECT zipcode AS cat, (sum(price) + 10 * any_value(gm)) / (count(*) + 10) AS enc FROM sp, gm WHERE split = 'train' GROUP BY zipcode),
tgt AS (SELECT sp.* REPLACE (coalesce(tc.enc, gm) AS city, coalesce(tz.enc, gm) AS zipcode)
        FROM sp CROSS JOIN gm LEFT JOIN tc ON sp.city = tc.cat LEFT JOIN tz ON sp.zipcode = tz.cat)"""


@register("s4_variant_shapes", _SPLIT_SQL + """
SELECT 'cat' AS variant, split, count(*) AS rows, 16 AS cols FROM sp GROUP BY split
UNION ALL SELECT 'tgt', split, count(*), 19 FROM tgt GROUP BY split""")
def s4_variant_shapes(spark, sf_dir):
    """Write the cat and tgt variants (raw scale, features + target) under
    variant=/split= partitions and report their shapes."""
    path = IO.scratch_path(spark, "variants")
    shapes = IO.write_variants(_variant_frames(spark, sf_dir), path)
    return shapes.withColumn("cols", F.col("cols").cast("int"))


@register("s2_load_variant", _SPLIT_SQL + """
SELECT row_id, split, round(city, 4) AS city, round(zipcode, 4) AS zipcode, age FROM tgt""")
def s2_load_variant(spark, sf_dir):
    """Load the derived tgt_only variant (tgt files minus x, y, z) from the written partitions."""
    path = IO.scratch_path(spark, "variants")
    IO.write_variants(_variant_frames(spark, sf_dir), path)
    v = IO.load_variant(spark, path, "tgt_only")
    assert "x" not in v.columns and "city" in v.columns
    return v.select("row_id", "split", _r("city", 4).alias("city"), _r("zipcode", 4).alias("zipcode"), "age")


# ------------------------------------------------------------------ S5 / S6 / S7

@register("s5_s7_metric_table", METRIC_CTES + """
SELECT model, variant, split, metric, round(value, 4) AS value, round(std, 4) AS std FROM ml
UNION ALL
SELECT model || '_single', variant, split, metric, round(value, 4), NULL FROM flong WHERE heldout = 0
UNION ALL
SELECT model || '_old', variant, split, metric, round(value, 4), NULL FROM flong WHERE heldout = 1""")
def s5_s7_metric_table(spark, sf_dir):
    """S5 + S7: append CV rows (with std) and single-split rows (blank std) to the metric
    table, read it back, and read an older table, written without a std column."""
    from foldwise.operators.metrics import to_long
    path = IO.scratch_path(spark, "metrics")
    IO.save_metrics(metrics_long(spark, sf_dir), path)
    single = to_long(fold_metrics(spark, sf_dir).where(F.col("heldout") == 0),
                     ["model", "variant", "heldout", "split"])
    single = single.withColumn("model", F.concat("model", F.lit("_single"))).withColumn(
        "target", F.lit("price"))
    IO.save_metrics(single, path, with_std=False)
    old = IO.scratch_path(spark, "metrics-old")
    folds = to_long(fold_metrics(spark, sf_dir).where(F.col("heldout") == 1), ["model", "variant", "heldout", "split"])
    folds.select(F.concat("model", F.lit("_old")).alias("model"), F.lit("price").alias("target"), "variant", "split",
                 "metric", "value").write.parquet(old)
    m = IO.read_metrics(spark, path).unionByName(IO.read_metrics(spark, old), allowMissingColumns=True)
    return m.select("model", "variant", "split", "metric", _r("value", 4).alias("value"),
                    _r("std", 4).alias("std"))


@register("s6_fold_table", METRIC_CTES + """
SELECT model, variant, heldout, split, n, round(RMSE, 4) AS RMSE, round(R2, 8) AS R2 FROM fm""")
def s6_fold_table(spark, sf_dir):
    """Fold-level wide metric table written partitioned by model and read back."""
    path = IO.scratch_path(spark, "fold-metrics")
    IO.write_fold_metrics(fold_metrics(spark, sf_dir), path)
    df = spark.read.parquet(path)
    return df.select("model", "variant", "heldout", "split", "n", _r("RMSE", 4).alias("RMSE"),
                     _r("R2", 8).alias("R2"))


# ------------------------------------------------------------------ S8 / E7

def _orders_lines(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    num = lambda c: F.col(c).cast("string")
    fields = [num("o_orderkey"), num("o_custkey"), F.col("o_orderstatus"), num("o_totalprice"),
              F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"),
              F.col("o_orderpriority"), F.dayofmonth("o_orderdate").cast("string"),
              F.dayofweek("o_orderdate").cast("string"), (F.col("o_orderkey") % 7).cast("string"),
              (F.col("o_custkey") % 11).cast("string"), F.round(F.col("o_totalprice") / 1000).cast("string"),
              F.quarter("o_orderdate").cast("string"), F.dayofyear("o_orderdate").cast("string"),
              F.when(F.col("o_totalprice") < 150000, F.lit("<=50K")).otherwise(F.lit(">50K."))]
    lines = o.select(F.concat_ws(", ", *fields).alias("value"))
    extra = spark.createDataFrame([("|1x3 Cross validator",), ("",), ("   ",)], "value string")
    path = IO.scratch_path(spark, "comma-text")
    lines.unionByName(extra).write.mode("overwrite").text(path)
    cats = {2: "o_orderstatus", 6: "o_orderpriority"}
    descs = None
    for i in range(14):
        if i in cats:
            d = o.select(F.col(cats[i]).alias("v")).distinct().agg(
                F.array_join(F.sort_array(F.collect_list("v")), ", ").alias("desc"))
            d = d.select(F.lit(i).alias("col"), "desc")
        else:
            d = spark.createDataFrame([(i, "C")], "col int, desc string")
        descs = d if descs is None else descs.unionByName(d)
    return path, descs


@register("s8_e7_comma_text", """
WITH st AS (SELECT v, row_number() OVER (ORDER BY v) AS id FROM (SELECT DISTINCT o_orderstatus AS v FROM orders)),
pr AS (SELECT v, row_number() OVER (ORDER BY v) AS id FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)),
w AS (SELECT (SELECT count(*) + 1 FROM st) AS ws, (SELECT count(*) + 1 FROM pr) AS wp)
SELECT o_orderkey AS orderkey, CASE WHEN o_totalprice < 150000 THEN 0 ELSE 1 END AS label,
       CAST(st.id AS DOUBLE) AS status_id, CAST(pr.id AS DOUBLE) AS priority_id,
       CAST(12 + ws + wp AS INTEGER) AS onehot_width, CAST(st.id AS INTEGER) AS status_hot,
       CAST(pr.id AS INTEGER) AS priority_hot, o_totalprice AS totalprice
FROM orders JOIN st ON o_orderstatus = st.v JOIN pr ON o_orderpriority = pr.v, w""")
def s8_e7_comma_text(spark, sf_dir):
    """S8 + E7: comma text with comment and blank lines -> 14 features + 0/1
    label; categorical vocabularies with '?' in slot 0, index and one-hot forms."""
    path, desc = _orders_lines(spark, sf_dir)
    df = IO.read_comma_text(spark, path, desc, 15, onehot=True)
    # one-hot widths from the description: values + the '?' slot
    width = F.size(F.split("desc", ",")) + 1
    w = desc.agg(F.max(F.when(F.col("col") == 2, width)).alias("w_status"),
                 F.max(F.when(F.col("col") == 6, width)).alias("w_prio"))
    x, oh = F.col("x_index"), F.col("x_onehot")
    status_start = F.lit(3)                       # after orderkey, custkey (1-based)
    prio_start = F.col("w_status") + F.lit(6)     # + totalprice, year, month
    return df.crossJoin(F.broadcast(w)).select(
        x[0].cast("bigint").alias("orderkey"), "label", x[2].alias("status_id"),
        x[6].alias("priority_id"), F.size(oh).cast("int").alias("onehot_width"),
        (F.array_position(F.slice(oh, status_start, F.col("w_status")), 1.0) - 1).cast("int").alias("status_hot"),
        (F.array_position(F.slice(oh, prio_start, F.col("w_prio")), 1.0) - 1).cast("int").alias("priority_hot"),
        x[3].alias("totalprice"))


# ------------------------------------------------------------------ S9 / J7

@register("s9_j7_space_text", """
SELECT s_name AS name, r_regionkey AS label, round(s_acctbal, 4) AS x1, CAST(s_nationkey AS DOUBLE) AS x3
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def s9_j7_space_text(spark, sf_dir):
    """S9 + J7: whitespace-delimited 'name f1..f8 class' lines; class name to id
    through the label file (lookup join)."""
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    cls = F.regexp_replace("r_name", " ", "_")
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    vals = [F.col("s_acctbal"), F.col("s_suppkey") / 100, F.col("s_nationkey"), F.col("n_regionkey"),
            F.col("s_acctbal") / 1000, F.col("s_suppkey") % 7, F.col("s_nationkey") / 25, F.lit(0.5)]
    line = F.concat_ws("  ", F.col("s_name"), *[v.cast("double").cast("string") for v in vals], cls)
    dpath, lpath = IO.scratch_path(spark, "space-data"), IO.scratch_path(spark, "space-label")
    j.select(line.alias("value")).write.mode("overwrite").text(dpath)
    r.select(F.concat_ws(" ", F.col("r_regionkey").cast("string"), cls).alias("value")) \
        .write.mode("overwrite").text(lpath)
    df = IO.read_space_text(spark, dpath, lpath)
    return df.select("name", "label", _r(F.col("x")[0], 4).alias("x1"), F.col("x")[2].alias("x3"))


# ------------------------------------------------------------------ S10

@register("s10_hidden_outputs", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS h,
                  CASE WHEN ('0x' || substr(md5(concat('42:', CAST(vec_id AS VARCHAR))), 1, 8))::BIGINT / 4294967296.0 < 0.2
                       THEN 'test' ELSE 'train' END AS phase FROM embeddings)
SELECT vec_id, phase, 1 AS layer, round(list_sum(list_transform(h, lambda v: tanh(v))), 6) AS h_sum,
       CAST(len(h) AS INTEGER) AS h_len FROM e""")
def s10_hidden_outputs(spark, sf_dir):
    """Hidden outputs per phase and layer written partitioned by (phase, layer), one layer read back."""
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    phase = F.when(hash_fraction(42, "vec_id") < 0.2, "test").otherwise("train")
    h0 = e.select(F.col("vec_id").alias("row_id"), phase.alias("phase"), F.lit(0).alias("layer"),
                  F.col("embedding").cast("array<double>").alias("h"))
    h1 = h0.select("row_id", "phase", F.lit(1).alias("layer"),
                   F.transform("h", lambda v: F.tanh(v)).alias("h"))
    path = IO.scratch_path(spark, "hiddens")
    IO.save_hiddens(h0.unionByName(h1), path)
    back = IO.load_hiddens(spark, path, 1)
    return back.select(F.col("row_id").alias("vec_id"), "phase", F.col("layer").cast("int").alias("layer"),
                       _r(F.aggregate("h", F.lit(0.0), lambda a, v: a + v), 6).alias("h_sum"),
                       F.size("h").cast("int").alias("h_len"))
