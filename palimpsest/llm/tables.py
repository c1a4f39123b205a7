"""What the operators share in handling tables: hidden column names, row order and reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.shared import ship

HIDDEN = "__plm_"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def hidden(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    name, taken = HIDDEN + stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def first_row_order(df: DataFrame, id_col: str, skip: tuple[str, ...] = ()) -> Column:
    """Orders rows by id, nulls last, then by every other column that has an order. Rows that still tie are equal in all of these."""
    rest = [f.name for f in df.schema.fields if f.name != id_col and f.name not in skip and orderable(f.dataType)]
    return F.struct(q(id_col).isNull().alias("a"), q(id_col).alias("b"), *[q(c).alias(f"c{i}") for i, c in enumerate(rest)])
