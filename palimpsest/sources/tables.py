"""Reading Parquet tables and id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.shared import ship


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(line, memory_id) of a text file with one id a line; blank lines are skipped, spaces around ids dropped.

    ``line`` rises in the order of the file within each of its splits, which is the order that orphans are reported in.
    """
    ids = F.trim(F.translate("value", "\t\r", "  "))
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), ids.alias("memory_id")).where("memory_id <> ''")
