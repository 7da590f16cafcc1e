"""Shared DuckDB CTE text for the oracles (fixtures and the engineered frame)."""

from foldwise.sources.tables import SALES_SQL, SCORED_SQL

SALES = f"sales AS ({SALES_SQL})"
SCORED = f"scored AS ({SCORED_SQL})"

HASH_FOLD = "CAST(('0x' || substr(md5(concat('42:', row_id)), 1, 8))::BIGINT % 5 AS INTEGER)"
HASH_KEY = "md5(concat('42:', row_id))"

# P11 chain: coordinates -> positive price -> 0.999 cap -> city/global imputation -> misc.
ENGINEERED = SALES + r""",
e_s0 AS (SELECT * EXCLUDE (lat, long),
                cos(radians(lat)) * cos(radians(long)) AS x,
                cos(radians(lat)) * sin(radians(long)) AS y,
                sin(radians(lat)) AS z
         FROM sales WHERE price > 0),
e_cap AS (SELECT quantile_cont(price, 0.999) AS cap FROM e_s0),
e_s1 AS (SELECT e_s0.* FROM e_s0, e_cap WHERE price <= cap),
e_cm AS (SELECT city AS cm_city, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM e_s1 GROUP BY city),
e_s2 AS (SELECT e_s1.* REPLACE (coalesce(x, mx) AS x, coalesce(y, my) AS y, coalesce(z, mz) AS z)
         FROM e_s1 LEFT JOIN e_cm ON e_s1.city = e_cm.cm_city),
e_gm AS (SELECT avg(x) AS gx, avg(y) AS gy, avg(z) AS gz FROM e_s2),
e_s3 AS (SELECT e_s2.* REPLACE (coalesce(x, gx) AS x, coalesce(y, gy) AS y, coalesce(z, gz) AS z),
                nullif(regexp_extract(statezip, '(\d{5})', 1), '') AS zip
         FROM e_s2, e_gm),
e_cc AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
         FROM (SELECT DISTINCT city AS v FROM e_s3 WHERE city IS NOT NULL)),
e_zc AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
         FROM (SELECT DISTINCT zip AS v FROM e_s3 WHERE zip IS NOT NULL)),
engineered AS (
  SELECT row_id, price, bedrooms, bathrooms, sqft_living, floors, waterfront, view, condition,
         sqft_above, sqft_basement, coalesce(e_cc.code, -1) AS city, x, y, z,
         coalesce(e_zc.code, -1) AS zipcode, ln(1 + sqft_lot) AS log_sqft_lot,
         CASE WHEN yr_renovated > 0 THEN 1 ELSE 0 END AS was_renovated,
         year(CAST(date AS TIMESTAMP)) - yr_built AS age
  FROM e_s3 LEFT JOIN e_cc ON e_s3.city = e_cc.v LEFT JOIN e_zc ON e_s3.zip = e_zc.v)"""

FOLDED = ENGINEERED + f""",
folded AS (SELECT *, {HASH_FOLD} AS fold FROM engineered),
heldout AS (SELECT CAST(range AS INTEGER) AS heldout FROM range(5)),
expanded AS (SELECT folded.*, heldout, CASE WHEN fold = heldout THEN 'test' ELSE 'train' END AS split
             FROM folded, heldout)"""
