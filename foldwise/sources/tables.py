"""Readers for the given parquet tables and the fixture views built from them.

``sales`` and ``scored`` are the stand-in inputs of the regression study (see
FIXTURES.md): they only give rows in the schema the jobs expect.  All work of
the library runs on them through the operators, never on how they are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """Parquet scan of one given table; ``columns`` prunes the read schema."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return df


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw housing-like records (FIXTURES.md §3) from lineitem joined to part."""
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_quantity", "l_returnflag", "l_shipdate"])
    pa = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_size"])
    j = li.join(pa, li.l_partkey == pa.p_partkey, "inner")
    no_coord = (F.col("l_orderkey") % 41 == 0) | (F.col("p_brand") == "Brand#25")
    return j.select(
        F.concat_ws("-", _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"),
                    _s("l_suppkey"),
                    F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
                    ).alias("row_id"),
        F.when(F.col("l_orderkey") % 97 == 0, F.lit(0.0))
         .otherwise(F.col("l_extendedprice")).alias("price"),
        F.col("l_shipdate").cast("date").cast("string").alias("date"),
        (F.lit(1) + F.col("l_linenumber")).alias("bedrooms"),
        (F.lit(1.0) + (F.col("l_quantity") % F.lit(4.0)) / F.lit(2.0)).alias("bathrooms"),
        (F.col("l_quantity") * F.lit(50.0)).alias("sqft_living"),
        (F.col("l_quantity") * F.lit(50.0) * (F.lit(1) + F.col("p_size"))).alias("sqft_lot"),
        (F.lit(1.0) + (F.col("l_suppkey") % 3) * F.lit(0.5)).alias("floors"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("waterfront"),
        (F.col("l_linenumber") % 5).alias("view"),
        (F.lit(1) + F.col("p_size") % 5).alias("condition"),
        (F.col("l_quantity") * F.lit(40.0)).alias("sqft_above"),
        (F.col("l_quantity") * F.lit(10.0)).alias("sqft_basement"),
        (F.lit(1900) + F.col("l_partkey") % 95).alias("yr_built"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit(1990) + F.col("l_partkey") % 5)
         .otherwise(F.lit(0).cast("bigint")).alias("yr_renovated"),
        F.concat(_s("l_orderkey"), F.lit(" Main St")).alias("street"),
        F.col("p_brand").alias("city"),
        F.when(F.col("p_size") == 50, F.lit("WA"))
         .otherwise(F.concat(F.lit("WA "), (F.lit(98000) + F.col("p_size")).cast("string"))
                    ).alias("statezip"),
        F.lit("USA").alias("country"),
        F.when(no_coord, F.lit(None).cast("double"))
         .otherwise(F.lit(47.0) + (F.col("l_partkey") % 1000) / F.lit(1000.0)).alias("lat"),
        F.when(no_coord, F.lit(None).cast("double"))
         .otherwise(F.lit(-122.0) - (F.col("l_suppkey") % 100) / F.lit(100.0)).alias("long"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo predictions of two models per row (FIXTURES.md §4)."""
    s = sales(spark, sf_dir).where(F.col("price") > 0)
    return s.select(
        "row_id", "city", "statezip", "sqft_living", F.col("price").alias("y"),
        (F.col("price") * (F.lit(0.85) + F.col("bedrooms") / F.lit(40.0))).alias("pred_a"),
        (F.col("price") * (F.lit(1.15) - F.col("condition") / F.lit(20.0))).alias("pred_b"),
        F.element_at(F.array(*[F.lit(m) for m in ("rf", "dt", "mlp", "gbt")]),
                     (F.col("yr_built") % 4 + 1).cast("int")).alias("model"),
        F.element_at(F.array(*[F.lit(v) for v in ("cat", "tgt", "coord_only", "tgt_only")]),
                     (F.col("bedrooms") % 4 + 1).cast("int")).alias("variant"),
    )


# DuckDB text of the same fixtures, used as CTEs by the oracle SQL.
SALES_SQL = """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                      CAST(l_suppkey AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS row_id,
       CASE WHEN l_orderkey % 97 = 0 THEN 0e0 ELSE l_extendedprice END      AS price,
       CAST(CAST(l_shipdate AS DATE) AS VARCHAR)                            AS date,
       1 + l_linenumber                                                     AS bedrooms,
       1e0 + (l_quantity % 4e0) / 2e0                                       AS bathrooms,
       l_quantity * 50e0                                                    AS sqft_living,
       l_quantity * 50e0 * (1 + p_size)                                     AS sqft_lot,
       1e0 + (l_suppkey % 3) * 5e-1                                         AS floors,
       CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END                       AS waterfront,
       l_linenumber % 5                                                     AS view,
       1 + p_size % 5                                                       AS condition,
       l_quantity * 40e0                                                    AS sqft_above,
       l_quantity * 10e0                                                    AS sqft_basement,
       1900 + l_partkey % 95                                                AS yr_built,
       CASE WHEN l_suppkey % 3 = 0 THEN 1990 + l_partkey % 5 ELSE 0 END     AS yr_renovated,
       concat(CAST(l_orderkey AS VARCHAR), ' Main St')                      AS street,
       p_brand                                                              AS city,
       CASE WHEN p_size = 50 THEN 'WA' ELSE concat('WA ', CAST(98000 + p_size AS VARCHAR)) END AS statezip,
       'USA'                                                                AS country,
       CASE WHEN l_orderkey % 41 = 0 OR p_brand = 'Brand#25' THEN NULL ELSE 47e0 + (l_partkey % 1000) / 1e3 END    AS lat,
       CASE WHEN l_orderkey % 41 = 0 OR p_brand = 'Brand#25' THEN NULL ELSE -122e0 - (l_suppkey % 100) / 1e2 END   AS long
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

SCORED_SQL = """
SELECT row_id, city, statezip, sqft_living, price AS y,
       price * (85e-2 + bedrooms / 4e1)   AS pred_a,
       price * (115e-2 - condition / 2e1) AS pred_b,
       CASE yr_built % 4 WHEN 0 THEN 'rf' WHEN 1 THEN 'dt' WHEN 2 THEN 'mlp' ELSE 'gbt' END AS model,
       CASE bedrooms % 4 WHEN 0 THEN 'cat' WHEN 1 THEN 'tgt' WHEN 2 THEN 'coord_only' ELSE 'tgt_only' END AS variant
FROM sales WHERE price > 0
"""
