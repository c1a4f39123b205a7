"""Operator 6, mixing sources to target weights: histograms of hash buckets give nested thresholds; nothing is sorted but one bucket a source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.tables import hidden, q, read
from palimpsest.llm.textkit import count_tokens
from palimpsest.shared import cut

BUCKETS = 4096
#: The production mix: the source that dominates the crawl counts twice, any other once; 7 tenths of all tokens are wanted.
WEIGHTS, DEFAULT_WEIGHT, SHARE = {"src0": 2}, 1, (7, 10)


def tokens_of(text: Column) -> Column:
    """Words separated by ASCII white space; a null has none. Counted on Arrow buffers, many times faster than splitting in the JVM."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(count_tokens(texts))

    return run(text)


def unit_of(id_col: Column, seed: int) -> Column:
    """60 bits of MD5 over the seed and the id: the place of a row in its source's order of choice."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def mix_sources(docs: DataFrame, weights: dict[str, int] = WEIGHTS, default_weight: int = DEFAULT_WEIGHT, share: tuple[int, int] = SHARE, seed: int = 1, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", max_broadcast_sources: int = 200_000) -> DataFrame:
    """Rows of ``docs`` chosen so that each source has its share of tokens, without repeating any.

    A source with weight w gets the budget ``w * share * all tokens / sum of the weights of the sources present``
    (whole tokens). Rows are taken in the order of a seeded hash of their id while the tokens so far stay within the
    budget; a source with fewer tokens than its budget stays whole. A larger share keeps a superset.

    Tokens are summed by source and hash bucket (4096 a source); running sums find the bucket in which the budget ends,
    only the rows of that bucket are ordered, and what results is one threshold a source that a scan filters by.
    Thresholds are broadcast if there are at most ``max_broadcast_sources`` of them, else joined by shuffle.

    Null sources form a source of their own (default weight). Null or empty texts have no tokens and follow their hash.
    Null ids share one hash. Rows with equal hashes (repeated ids) are taken or left together. A weight of 0 drops
    a source (but for rows without tokens before its first token). An empty table gives an empty table. All columns are kept, whatever their names.
    """
    u, s, t, b, top = (hidden(docs, x) for x in ("u", "s", "t", "b", "limit"))
    hashed = unit_of(q(id_col), seed)
    src = F.coalesce(F.concat(F.lit("="), q(source_col)), F.lit("null"))
    narrow = docs.select(src.alias(s), hashed.alias(u), tokens_of(q(text_col)).alias(t))
    # Texts are read once: what is needed of each row is some 40 bytes, kept in the shared folder.
    narrow = cut(narrow.withColumn(b, F.shiftright(u, 60 - BUCKETS.bit_length() + 1)))
    histogram = narrow.groupBy(s, b).agg(F.sum(t).alias(t), F.count("*").alias("n"))
    weight = F.lit(default_weight).cast("long")
    for name, w in weights.items():
        weight = F.when(F.col(s) == "=" + name, F.lit(w).cast("long")).otherwise(weight)
    by_source = histogram.groupBy(s).agg(F.sum(t).alias("have")).withColumn("w", weight)
    sums = by_source.agg(F.sum("have").alias("all_tokens"), F.sum("w").alias("all_w"))
    budget = by_source.crossJoin(F.broadcast(sums)).select(s, F.expr(f"cast(cast(all_tokens as decimal(38,0)) * {share[0]} * w div ({share[1]} * greatest(all_w, 1)) as bigint)").alias("budget"))
    running = histogram.withColumn("upto", F.sum(t).over(Window.partitionBy(s).orderBy(b)))
    # The first bucket that doesn't fit whole; none: the whole source stays.
    ends = running.join(budget, s).groupBy(s).agg(F.min(F.when(F.col("upto") > F.col("budget"), F.struct(b, (F.col("upto") - F.col(t)).alias("before"), "budget"))).alias("end"))
    ends = ends.select(s, F.col(f"end.{b}").alias("end_bucket"), F.col("end.before").alias("before"), F.col("end.budget").alias("budget"))
    small = histogram.select(s).distinct().count() <= max_broadcast_sources
    hint = F.broadcast if small else (lambda x: x)
    inside = narrow.join(hint(ends), s).where(F.col(b) == F.col("end_bucket"))
    fits = inside.groupBy(s, u, "before", "budget").agg(F.sum(t).alias(t)).withColumn("upto", F.col("before") + F.sum(t).over(Window.partitionBy(s).orderBy(u)))
    last = fits.groupBy(s).agg(F.max(F.when(F.col("upto") <= F.col("budget"), F.col(u))).alias("last"))
    start = F.shiftleft(F.col("end_bucket"), 60 - BUCKETS.bit_length() + 1)
    limit = ends.join(last, s, "left").select(F.col(s).alias(s), F.when(F.col("end_bucket").isNull(), F.lit(1 << 60)).otherwise(F.coalesce("last", start - 1)).alias(top))
    out = docs.withColumn(s, src).withColumn(u, hashed).join(hint(limit), s).where(F.col(u) <= F.col(top))
    return out.select(*[q(c) for c in docs.columns])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the production mix, with all columns."""
    return mix_sources(read(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT *, coalesce('=' || source, 'null') AS s,
    ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS u,
    coalesce(len(list_filter(string_split(translate(text, chr(9) || chr(10) || chr(13) || chr(12) || chr(11), '     '), ' '), lambda w: w <> '')), 0) AS t
  FROM documents
), per AS (SELECT s, sum(t) AS have, CASE s WHEN '=src0' THEN 2 ELSE 1 END AS w FROM d GROUP BY s),
budget AS (SELECT s, ((SELECT sum(have) FROM per) * 7 * w) // (10 * (SELECT sum(w) FROM per)) AS budget FROM per),
r AS (SELECT *, sum(t) OVER (PARTITION BY s ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d)
SELECT doc_id, text, lang, source, n_chars FROM r JOIN budget USING (s) WHERE upto <= budget
"""
