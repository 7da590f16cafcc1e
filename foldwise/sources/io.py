"""Sources and sinks (S1-S10): delimited text, partitioned variants, metric tables, hidden outputs.

Everything is written with the DataFrame writer into a shared folder (the
session's checkpoint folder on a cluster, see ``scratch_path``) and read back
with explicit schemas; partition columns give pruning on read.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators.lookup import bounded
from foldwise.session import scratch_path  # noqa: F401  (used from here, too)

METRICS_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("model", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("variant", T.StringType()),
    T.StructField("split", T.StringType()), T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("std", T.DoubleType())])

#: fixed values of the study: variant -> the files that hold it, columns of these that it leaves out
VARIANT_FILES = {
    "cat": ("cat", ()),
    "tgt": ("tgt", ()),
    "coord_only": ("tgt", ("city", "zipcode")),
    "tgt_only": ("tgt", ("x", "y", "z")),
}


# ---------------------------------------------------------------- S1 / S3

def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV scan with a header and an explicit schema (no inference)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=()) -> str:
    """S3: overwrite-write a frame (parquet or csv with header)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


# ---------------------------------------------------------------- S2 / S4

def write_variants(frames: dict, path: str) -> DataFrame:
    """Write each base variant (features + target, raw scale, ``split``
    column) under ``variant=/split=`` partitions; returns the shapes
    (variant, split, rows, cols)."""
    shapes = None
    for variant, df in frames.items():
        # one folder per variant (their column types differ), split partitions inside
        df.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(f"{path}/variant={variant}")
        s = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(variant).alias("variant"), "split", "rows",
            F.lit(len(df.columns) - 1).alias("cols"))
        shapes = s if shapes is None else shapes.unionByName(s)
    return shapes


def load_variant(spark: SparkSession, path: str, variant: str) -> DataFrame:
    """Read a materialized variant (both splits, ``split`` column kept), by its entry
    in ``VARIANT_FILES``; a name without one -> ValueError."""
    try:
        files, left_out = VARIANT_FILES[variant]
    except KeyError:
        raise ValueError(f"no files are known for the variant {variant!r}; known: "
                         f"{', '.join(VARIANT_FILES)}") from None
    stored = spark.read.option("basePath", path).parquet(f"{path}/variant={files}")
    return stored.select(*[c for c in stored.columns if c != "variant" and c not in left_out])


# ---------------------------------------------------------------- S5 / S6 / S7

def run_key(**settings) -> str:
    """A name for a run with these settings: the same settings, the same name."""
    text = json.dumps(settings, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def save_metrics(long: DataFrame, path: str, with_std: bool = True, run: str | None = None) -> None:
    """Append long metric rows (fixed schema).  Rows of a single split
    carry a NULL std; cross-validation rows carry the across-fold std.

    A run's rows lie in a folder of their own, so a run that is repeated or retried under
    the same name replaces its rows and no others; without a name each call is a new run."""
    std = F.col("std").cast("double") if (with_std and "std" in long.columns) else \
        F.lit(None).cast("double")
    out = long.select(F.date_trunc("second", F.current_timestamp()).alias("timestamp"),
                      "model", "target", "variant", "split", "metric",
                      F.col("value").cast("double").alias("value"), std.alias("std"))
    out.write.mode("overwrite").parquet(f"{path}/run={run or uuid.uuid4().hex[:24]}")


def write_fold_metrics(df: DataFrame, path: str) -> None:
    """Fold-level wide metric table, partitioned by model."""
    df.write.mode("overwrite").partitionBy("model").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Read the metric table, whatever runs wrote it; an older table without ``std`` gets a
    NULL std."""
    df = spark.read.option("mergeSchema", True).parquet(path).drop("run")
    if "std" not in df.columns:
        df = df.withColumn("std", F.lit(None).cast("double"))
    return df


# ---------------------------------------------------------------- S8 / E7

def parse_feature_desc(desc: DataFrame) -> DataFrame:
    """Vocabulary table from a feature description ``(col int, desc string)``:
    'C' = numeric, otherwise a comma list of values; slot 0 is reserved for '?'.
    Returns ``(col, value, id)`` for the categorical columns."""
    cat = desc.where(F.trim("desc") != "C")
    vals = cat.select("col", F.posexplode(F.split(F.trim("desc"), ",")).alias("pos", "value"))
    vocab = vals.select("col", F.trim("value").alias("value"), (F.col("pos") + 1).alias("id"))
    q = cat.select("col", F.lit("?").alias("value"), F.lit(0).alias("id"))
    return vocab.unionByName(q)


def read_comma_text(spark: SparkSession, path: str, desc: DataFrame, n_fields: int = 15,
                    onehot: bool = True) -> DataFrame:
    """S8 + E7: comma-delimited lines; comment lines ('|' prefix) and blank lines
    skipped; fields trimmed; exactly ``n_fields`` fields or the job fails; label
    '<=50K...' -> 0 else 1.  Categorical fields become their vocabulary id
    (``x_index``) and, with ``onehot``, one-hot slots (``x_onehot``, numeric
    fields pass through); an unknown value fails the job.

    The vocabulary (from the feature description, not from the data) is one
    broadcast map row, so parsing is row-local: no shuffle.
    """
    n = n_fields - 1
    rows = spark.read.text(path).where(
        (F.length(F.trim("value")) > 0) & ~F.col("value").startswith("|"))
    f = F.split(F.trim("value"), ",")
    parts = rows.select(F.when(F.size(f) == n_fields, f).otherwise(
        F.raise_error(F.concat(F.lit("wrong field count: "), F.size(f).cast("string")))).alias("f"))
    vocab = parse_feature_desc(desc)
    vrow = vocab.agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(":", F.col("col").cast("string"), "value"), "id"))).alias("_vmap"))
    widths = (desc.join(vocab.groupBy("col").agg(F.count(F.lit(1)).alias("w")), "col", "left")
                  .agg(F.sort_array(F.collect_list(F.struct("col", F.coalesce("w", F.lit(0)).alias("w"))))
                       .alias("_ws")))
    meta = vrow.crossJoin(widths).select("_vmap", F.transform("_ws", lambda c: c["w"]).alias("_w"))
    j = parts.crossJoin(F.broadcast(meta))

    def field(i):
        return F.trim(F.element_at("f", i + 1))

    def encode(i):
        key = F.concat_ws(":", i.cast("string"), field(i))
        hit = F.try_element_at("_vmap", key)
        cat = F.when(hit.isNull(), F.raise_error(F.concat(F.lit("unknown value: "), field(i)))
                     ).otherwise(hit.cast("double"))
        return F.when(F.element_at("_w", i + 1) > 0, cat).otherwise(field(i).cast("double"))

    seq = F.sequence(F.lit(0), F.lit(n - 1))
    out = j.select(F.when(field(F.lit(n)).startswith("<=50K"), 0).otherwise(1).alias("label"),
                   F.transform(seq, encode).alias("x_index"), "_w")
    if onehot:
        def expand(v, i):
            w = F.element_at("_w", i + 1)
            return F.when(w > 0, F.transform(F.sequence(F.lit(0), w - 1),
                                             lambda s: F.when(s == v.cast("int"), F.lit(1.0))
                                             .otherwise(F.lit(0.0)))).otherwise(F.array(v))
        out = out.withColumn("x_onehot", F.flatten(F.transform("x_index", expand)))
    return out.drop("_w")


# ---------------------------------------------------------------- S9 / J7

def read_space_text(spark: SparkSession, data_path: str, label_path: str, n_floats: int = 8) -> DataFrame:
    """S9 + J7: whitespace-delimited lines ``name f1..f8 class``; the class name
    is looked up in the label file ``id name`` (lookup join, one row per class).
    A class that the label file lacks fails the job."""
    lab = spark.read.text(label_path).select(F.split(F.trim("value"), " ").alias("c")).select(
        F.col("c")[0].cast("int").alias("label"), F.col("c")[1].alias("_cls"))
    rows = spark.read.text(data_path).where(F.length(F.trim("value")) > 0).select(
        F.split(F.trim("value"), " +").alias("c"))
    rows = rows.select(F.col("c")[0].alias("name"),
                       F.array(*[F.col("c")[i].cast("double") for i in range(1, n_floats + 1)]).alias("x"),
                       F.element_at("c", -1).alias("_cls"))
    known = rows.join(bounded(lab), "_cls", "left")
    unknown = F.raise_error(F.concat(F.lit("class without a label: "), F.coalesce("_cls", F.lit("none"))))
    return known.select("name", "x", F.when(F.col("label").isNull(), unknown.cast("int")).otherwise(
        F.col("label")).alias("label"))


# ---------------------------------------------------------------- S10

def save_hiddens(hiddens: DataFrame, path: str) -> None:
    """Hidden outputs ``(row_id, phase, layer, h array<double>)``, partitioned by phase and layer."""
    hiddens.write.mode("overwrite").partitionBy("phase", "layer").parquet(path)


def load_hiddens(spark: SparkSession, path: str, layer: int) -> DataFrame:
    """One layer for both phases (partition pruning on ``layer``)."""
    return spark.read.parquet(path).where(F.col("layer") == layer)
