"""Shared helpers: tables in the cluster's shared folder, and reading inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import shared_folder, stored

__all__ = ["WORD", "numbered", "shared_folder", "stored", "table", "text_or_empty"]

#: Code points that separate words, and the pattern of one word.
WORD = r"[^\x20\x09-\x0D]+"


def numbered(df: DataFrame, number: str, name: str) -> DataFrame:
    """``df`` stored with a number of its own for every row: fixed once written, whatever is computed again later."""
    return stored(df.withColumn(number, F.monotonically_increasing_id()), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
