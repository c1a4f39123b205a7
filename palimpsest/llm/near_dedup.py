"""Operator 2, near-dedup: ProbMinHash signatures of weighted shingles, banding, exact verification, components.

The probability Jaccard similarity of two weighted sets is the sum over common elements d of
``1 / sum over d' of max(a(d')/a(d), b(d')/b(d))``. It is the chance that both sets, each drawing an element by its
weights with shared randomness, draw the same. ProbMinHash lets every element send arrivals of a Poisson process with
its weight as rate to random registers; a register keeps the first arrival, and an element stops once its next
arrival is later than the latest time in any register, for nothing after that can win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import textkit as tk
from palimpsest.llm.bloom import RepeatFilter
from palimpsest.llm.components import components
from palimpsest.llm.tables import first_row_order, hidden, q, read
from palimpsest.shared import cut

ROWS, BANDS, THRESHOLD, NGRAM = 5, 30, 0.6, 2


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct word n-grams; a text of fewer words has one shingle of all of them, one without words none."""
    h, doc, _, _ = tk.words(tk.normalise(raw), offsets)
    if not len(h):
        return doc, h, doc
    per = np.bincount(doc, minlength=len(offsets) - 1)
    place = np.arange(len(h)) - np.repeat(np.cumsum(per) - per, per)
    left = per[doc] - place  # words from here to the end of the document
    start = (left >= n) | (place == 0)
    out = h[start]
    at = np.flatnonzero(start)
    for i in range(1, n):
        inside = left[at] > i
        nxt = np.where(inside, h[np.minimum(at + i, len(h) - 1)], np.uint64(0))
        out = tk.mix(out * np.uint64(0xD1342543DE82EF95) + nxt)
    return tk.counted(doc[at], out)


def registers(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """ProbMinHash: (docs, m) keys of the elements that arrived first. Documents without elements keep 0."""
    first, win = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    limit = np.full(docs, np.inf)
    t, rate = np.zeros(len(key)), 1.0 / weight
    step = 0
    while len(key):
        step += 1
        z = tk.mix(key + np.uint64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
        live = t < limit[doc]
        if not live.all():
            doc, key, rate, t, z = doc[live], key[live], rate[live], t[live], z[live]
        slot = doc * m + (tk.mix(z) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, t)
        won = first[slot] == t
        win[slot[won]] = key[won]
        if len(doc):
            some = doc[np.concatenate(([True], doc[1:] != doc[:-1]))]
            limit[some] = first.reshape(docs, m)[some].max(axis=1)
    return win.reshape(docs, m)


def band_hashes(win: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands): one hash for each band of ``rows`` registers."""
    docs, m = win.shape
    x = win.reshape(docs, m // rows, rows)
    out = np.broadcast_to(tk.mix(np.arange(1, m // rows + 1, dtype=np.uint64)), x.shape[:2]).copy()
    for i in range(rows):
        out = tk.mix(out * np.uint64(0xD1342543DE82EF95) + x[:, :, i])
    return out


def similarity(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets with sorted keys."""
    if not len(ka) or not len(kb):
        return 0.0
    at = np.searchsorted(ka, kb)
    hit = (at < len(ka)) & (ka[np.minimum(at, len(ka) - 1)] == kb)
    a, b = wa[at[hit]].astype(float), wb[hit].astype(float)
    if not len(a):
        return 0.0
    only_a, only_b = wa.sum() - a.sum(), wb.sum() - b.sum()
    ratio = a / b
    order = np.argsort(ratio)
    a, b, ratio = a[order], b[order], ratio[order]
    i = np.searchsorted(ratio, ratio, "left")
    above = np.concatenate((np.cumsum(a[::-1])[::-1], [0.0]))[i] + only_a
    below = np.concatenate(([0.0], np.cumsum(b)))[i] + only_b
    return float((1.0 / (above / a + below / b)).sum())


def _sign(rows: int, bands: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch.column(0))
            raw, off, _ = tk.text_buffers(batch.column(1))
            for i, j in tk.pieces(off):
                doc, key, count = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], n)
                has = np.zeros(j - i, bool)
                has[doc] = True
                found = band_hashes(registers(doc, key, count.astype(float), j - i, rows * bands), rows)[has]
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(h[i:j][has], bands))], ["band", "h"])

    return run


def _compare(n: int):
    """Rows (a, s, b, text), sorted so that a centre (b = a) comes before the texts that are compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, ck, cw = None, None, None
        for batch in batches:
            a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            raw, off, _ = tk.text_buffers(batch.column(2))
            oa, ob, os = [], [], []
            for i, j in tk.pieces(off):
                doc, key, count = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], n)
                cut_at = np.searchsorted(doc, np.arange(j - i + 1))
                for x in range(j - i):
                    k, w = key[cut_at[x] : cut_at[x + 1]], count[cut_at[x] : cut_at[x + 1]]
                    if a[i + x] == b[i + x]:
                        centre, ck, cw = a[i + x], k.copy(), w.copy()
                    elif centre == a[i + x]:
                        oa.append(a[i + x])
                        ob.append(b[i + x])
                        os.append(similarity(ck, cw, k, w))
            yield pa.RecordBatch.from_arrays([pa.array(oa, pa.int64()), pa.array(ob, pa.int64()), pa.array(os, pa.float64())], ["a", "b", "similarity"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, n: int = NGRAM, per_centre: int = 2000) -> DataFrame:
    """(a, b, similarity) of the distinct ``pairs`` (a, b) by exact comparison of the texts (h, text).

    Only texts of some pair are shuffled (a Bloom filter leaves out the others). The text of a is sent once to every
    ``per_centre`` partners and held while they stream past it, so no group is held in memory.
    """
    # Few centres have so many partners that they need several parts; counts are combined before they are shuffled.
    large = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_centre).cast("long").alias("parts")).where("parts > 1")
    e = pairs.join(large, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1).cast("long"))).alias("s"))
    roles = cut(e.select("a", "s", F.col("b").alias("h")).unionByName(e.select("a", "s", F.col("a").alias("h")).distinct()))
    ids = roles.select("h").distinct()
    wanted = RepeatFilter(ids.unionByName(ids), ids.count())
    some = texts.where(wanted.hit(F.col("h")))
    rows = roles.join(some, "h").select("a", "s", F.col("h").alias("b"), "text")
    ordered = rows.repartition("a", "s").sortWithinPartitions("a", "s", F.col("b") != F.col("a"))
    return ordered.select("a", "b", "text").mapInArrow(_compare(n), "a long, b long, similarity double")


def _compare_blocks(threshold: float, n: int):
    """Rows (band, o, m, member, h, text) in order of the first four: the texts of a group that are held, then the members that stream past them.

    A text is compared with the held ones of a cluster until one is like it; what is joined already needs no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple[int, int, int] | None = None
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        cluster: list[int] = []  # of each held text
        for batch in batches:
            band, o, m, member, h = (np.asarray(batch.column(i)) for i in range(5))
            raw, off, _ = tk.text_buffers(batch.column(5))
            oa, ob = [], []
            for i, j in tk.pieces(off):
                doc, key, count = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], n)
                cut_at = np.searchsorted(doc, np.arange(j - i + 1))
                for x in range(j - i):
                    at, k, w = (band[i + x], o[i + x], m[i + x]), key[cut_at[x] : cut_at[x + 1]], count[cut_at[x] : cut_at[x + 1]]
                    if at != group:
                        group, held, cluster = at, [], []
                    joined: set[int] = set()
                    for y, (other, ok, ow) in enumerate(held):
                        if cluster[y] not in joined and similarity(ok, ow, k, w) >= threshold:
                            joined.add(cluster[y])
                            if member[i + x] or not at[2]:  # held texts meet in every group of their block, and are reported by the first
                                oa.append(other)
                                ob.append(h[i + x])
                    if member[i + x] == 0:
                        cluster = [len(held) if c in joined else c for c in cluster]
                        held.append((h[i + x], k.copy(), w.copy()))
                        cluster.append(len(held) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(oa, pa.int64()), pa.array(ob, pa.int64())], ["a", "b"])

    return run


def unlike_pairs(buckets: DataFrame, unlike: DataFrame, texts: DataFrame, threshold: float, n: int = NGRAM, block: int = 64) -> DataFrame:
    """(a, b): pairs that join every text of ``unlike`` (c, h) with those like it among the members of its ``buckets`` (band, h, c).

    The unlike texts and the members of a bucket are cut into blocks of about ``block`` by hash. A task holds a block
    of unlike texts while a block of members streams past, so no pair is emitted that isn't found alike, and a text is
    sent to as many tasks as the other side has blocks.
    """
    odd = buckets.join(unlike, ["c", "h"], "left_semi").select("band", "h")
    blocks = lambda df, name: df.groupBy("band").agg(F.ceil(F.count("*") / block).cast("long").alias(name))
    members = buckets.select("band", "h").join(blocks(odd, "no"), "band")
    plan = cut(members.groupBy("band").agg(F.max("no").alias("no"), F.ceil(F.count("*") / block).cast("long").alias("nm")))
    upto = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    place = F.pmod(F.xxhash64("h", F.lit(1)), "no")
    held = odd.join(plan, "band").select("band", place.alias("o"), upto("nm").alias("m"), F.lit(0).alias("member"), "h")
    marks = odd.select(F.col("band").alias("b"), F.col("h").alias("x"))
    passing = buckets.select("band", "h").join(plan, "band").join(marks, (F.col("band") == F.col("b")) & (F.col("h") == F.col("x")), "left")
    passing = passing.select("band", upto("no").alias("o"), F.pmod(F.xxhash64("h", F.lit(2)), "nm").alias("m"), F.lit(1).alias("member"), "h", F.when(F.col("x").isNotNull(), place).alias("own"))
    # Two unlike texts meet once: within their block, or where the one of the lower block is held.
    passing = passing.where("own is null or own > o").drop("own")
    roles = cut(held.unionByName(passing))
    ids = roles.select("h").distinct()
    wanted = RepeatFilter(ids.unionByName(ids), ids.count())
    rows = roles.join(texts.where(wanted.hit(F.col("h"))), "h").select("band", "o", "m", "member", "h", "text")
    # Comparing costs far more than bytes tell, so the number of tasks is given and not left to coalescing by size.
    tasks = max(roles.sparkSession.sparkContext.defaultParallelism, -(-roles.count() // 10_000))
    ordered = rows.repartition(tasks, "band", "o", "m").sortWithinPartitions("band", "o", "m", "member", "h")
    return ordered.mapInArrow(_compare_blocks(threshold, n), "a long, b long")


def near_pairs(texts: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, bands: int = BANDS, n: int = NGRAM) -> DataFrame:
    """(a, b): pairs of text hashes with similarity of at least ``threshold`` that join the same components as all such pairs that share a band.

    In each bucket every text is first compared with the least; a text that is unlike that one is then compared with
    the others of the bucket, block by block. So a bucket of copies takes one comparison a text, and nothing is left out. Least members are
    found by an aggregation that combines before it shuffles and joined back, so a bucket with a third of all texts is
    no single task: that join's other side has one row a bucket, and hot keys of it are split by adaptive execution.
    """
    signed = cut(texts.select("h", "text").mapInArrow(_sign(rows, bands, n), "band long, h long"))
    heads = signed.groupBy("band").agg(F.min("h").alias("c"), F.max("h").alias("top")).where("c < top")
    # Buckets of several texts only, without their least member.
    buckets = cut(signed.join(heads.select(F.col("band"), "c"), "band").where("h <> c"))
    first = cut(verify(buckets.select(F.col("c").alias("a"), F.col("h").alias("b")).distinct(), texts, n))
    unlike = first.where(F.col("similarity") < threshold).select(F.col("a").alias("c"), F.col("b").alias("h"))
    return first.where(F.col("similarity") >= threshold).select("a", "b").unionByName(unlike_pairs(buckets, unlike, texts, threshold, n))


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id", rows: int = ROWS, bands: int = BANDS, n: int = NGRAM) -> DataFrame:
    """Rows of ``docs`` with one row of each group of near copies: that with the smallest id.

    Texts are near copies if the probability Jaccard similarity of their word bigrams, weighted by count, is at least
    ``threshold``; groups are the connected components. Words are compared without case and punctuation. Candidates
    share a band of ``rows`` registers; a pair at the threshold is found with probability 1-(1-threshold**rows)**bands
    (0.91), at 0.7 with 0.996, and all candidates are verified on the whole texts.

    Nulls: a row with a null text stays. A null id comes after all others. Texts without words (empty ones too) are
    near copies only of equal texts. Of repeated rows one stays; ties in the id are decided by the other columns. An
    empty table gives an empty table. All columns are kept, whatever their names. Texts are told apart by 64 bits of
    hash within the groups (two different texts of 30 billion agree in about 24 pairs).
    """
    h = hidden(docs, "h")
    hashed = F.when(q(text_col).isNotNull(), F.xxhash64(q(text_col)))
    repeats = RepeatFilter(docs.select(hashed.alias(h)), docs.count())
    narrow = docs.select(hashed.alias("h"), q(text_col).alias("text")).where("h is not null")
    again = repeats.hit(F.col("h"))
    texts = narrow.where(~again).unionByName(narrow.where(again).groupBy("h").agg(F.first("text").alias("text")))
    groups = cut(components(near_pairs(texts, threshold, rows, bands, n)))
    nodes = groups.select("node")
    grouped = RepeatFilter(nodes.unionByName(nodes), nodes.count())
    flag = hidden(docs, "flag")
    marked = docs.withColumn(h, hashed)
    marked = marked.withColumn(flag, F.coalesce(repeats.hit(F.col(h)) | grouped.hit(F.col(h)), F.lit(False)))
    rest = marked.where(~F.col(flag)).drop(h, flag)
    row = F.struct(*[q(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    one = marked.where(F.col(flag)).select(F.col(h).alias("h"), row.alias("row"), first_row_order(docs, id_col, (text_col,)).alias("o")).groupBy("h").agg(F.min_by("row", "o").alias("row"), F.min("o").alias("o"))
    joined = one.join(groups, one["h"] == groups["node"], "left").select(F.coalesce("root", "h").alias("g"), "row", "o")
    kept = joined.groupBy("g").agg(F.min_by("row", "o").alias("row"))
    return rest.unionByName(kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that near-dedup keeps, with all columns."""
    return near_dedup(read(spark, sf_dir, "documents"))
