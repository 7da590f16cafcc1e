"""What the operators share: names that clash with nothing, tables, shared folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.session import ensure_checkpoint_dir, ship_package

#: the white space between words: space, \t \n \x0b \x0c \r (a Java pattern)
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once (a lambda's argument is bound, while
    an alias may be inlined wherever it is used)."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The ``[^\\x20\\x09-\\x0D]+`` of a text; none for a null text."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE))


def count_words(text: Column) -> Column:
    """Their number, as a long."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, SPACE))).cast("long")


def keep(df: DataFrame) -> DataFrame:
    """The frame, computed now and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def workers_ready(spark: SparkSession) -> None:
    """Python workers can import this package from now on."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
