"""Operator 1, exact dedup: two-pass Bloom filtering finds texts that may be repeated, and only those rows shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bloom import RepeatFilter
from palimpsest.llm.tables import first_row_order, hidden, q, read


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_filter_bytes: int = 256 << 20) -> DataFrame:
    """Rows of ``docs`` without exact copies: of the rows with one text, that with the smallest id stays.

    Pass one streams the 64-bit hash of each text (8 bytes a row, no text) through segmented Bloom filters. Pass two
    probes every row: rows that can't be repeated go straight to the output; the others are compared by their whole
    text. That comparison combines on the map side, so a text with millions of copies sends one row a task.

    Nulls: a row with a null text is no copy of anything and stays. A null id comes after all others. Empty texts are
    copies of each other. Rows with the same text and id: the first by the other columns stays; of rows equal in
    every column one stays. An empty table gives an empty table. All columns are kept, whatever their names.
    """
    h = hidden(docs, "h")
    text = q(text_col)
    hashed = F.when(text.isNotNull(), F.xxhash64(text))
    filt = RepeatFilter(docs.select(hashed.alias(h)), docs.count(), max_bytes=max_filter_bytes)
    flagged = docs.withColumn(h, F.coalesce(filt.hit(hashed), F.lit(False)))
    rest = flagged.where(~F.col(h)).drop(h)
    others = [c for c in docs.columns if c != text_col]
    row, order = F.struct(*[q(c).alias(f"c{i}") for i, c in enumerate(others)]), first_row_order(docs, id_col, (text_col,))
    kept = flagged.where(F.col(h)).groupBy(text.alias("text")).agg(F.min_by(row, order).alias("row"))
    back = [F.col("text").alias(c) if c == text_col else F.col(f"row.c{others.index(c)}").alias(c) for c in docs.columns]
    return rest.unionByName(kept.select(*back))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that exact dedup keeps, with all columns."""
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS r FROM documents
) WHERE r = 1 OR text IS NULL
"""
