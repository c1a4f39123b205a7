"""Operator 4, quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import textkit as tk
from palimpsest.llm.tables import hidden, q, read

WORDS, META, RANK = 1 << 16, 1 << 10, 8
STATS = ("length", "upper", "digit", "symbol", "bang", "pipe", "space", "word_len", "word_len_sd", "line_len", "distinct", "short", "repeated", "wide")
#: Bound on the labelled rows that the model is fitted on.
MAX_LABELLED = 6000
_CLASS = np.zeros((256, 7), np.float32)  # letters, upper, digit, symbol, bang, pipe, space
for _b in range(256):
    _c = chr(_b)
    if _b < 128:
        _CLASS[_b] = [_c.isalpha(), _c.isupper(), _c.isdigit(), not (_c.isalnum() or _c in " \t\r\n.,;:'\"()-?!|"), _c == "!", _c == "|", _c in " \t\r\n"]
_KIND = np.zeros(256, np.int64)  # the same as one code a byte: letter 0, upper 1, digit 2, symbol 3, bang 4, pipe 5, space 6, line end 7, other 8
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 8 if _b >= 128 else 7 if _c == "\n" else 6 if _c in " \t\r" else 5 if _c == "|" else 4 if _c == "!" else 3 if _CLASS[_b][3] else 2 if _c.isdigit() else 1 if _c.isupper() else 0 if _c.isalpha() else 8
_KIND = _KIND.astype(np.int16)


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of the hashed words, with values 1 + ln(count) scaled to length 1, and raw statistics (documents, len(STATS)).

    All are of the whole text. One saturates: of each word that is repeated, at most 50 occurrences count towards ``repeated``, so that a
    long text isn't taken for a repetitive one because of its commonest words.
    """
    n = len(off) - 1
    h, doc, s, e = tk.words(tk.normalise(raw), off)
    d, key, count = tk.counted(doc, h)
    value = 1.0 + np.log(count)
    norm = np.sqrt(np.bincount(d, value * value, n))
    value = value / np.maximum(norm[d], 1e-9)
    size = np.diff(off).astype(float)
    owner = np.repeat(np.arange(n), np.diff(off))
    kinds = np.bincount(owner * 9 + _KIND[raw], minlength=9 * n).reshape(n, 9).astype(float)
    nw = np.bincount(doc, minlength=n).astype(float)
    length = (e - s).astype(float)
    mean = np.bincount(doc, length, n) / np.maximum(nw, 1)
    var = np.bincount(doc, length * length, n) / np.maximum(nw, 1) - mean**2
    byte = np.maximum(size, 1)
    gap = np.minimum(count, 50)
    stats = np.stack([
        np.log1p(size), kinds[:, 1] / np.maximum(kinds[:, 0] + kinds[:, 1], 1), kinds[:, 2] / byte, kinds[:, 3] / byte, kinds[:, 4] / byte, kinds[:, 5] / byte,
        (kinds[:, 6] + kinds[:, 7]) / byte, mean, np.sqrt(np.maximum(var, 0)), np.log1p(size / (kinds[:, 7] + 1)), np.bincount(d, minlength=n) / np.maximum(nw, 1),
        np.bincount(doc, length <= 2, n) / np.maximum(nw, 1), np.bincount(d, (count > 1) * gap, n) / np.maximum(nw, 1), kinds[:, 8] / byte,
    ], axis=1)
    return d, (tk.mix(key) & np.uint64(WORDS - 1)).astype(np.int64), value, stats


def meta_bucket(texts: pa.Array, field: int) -> np.ndarray:
    """One hashed bucket a row for a metadata column; a null has one of its own."""
    raw, off, null = tk.text_buffers(texts)
    out = np.full(len(texts), 2 * field, np.int64)
    h, doc, _, _ = tk.words(tk.normalise(raw), off)
    acc = np.zeros(len(texts), np.uint64)
    np.add.at(acc, doc, h)
    hashed = (tk.mix(acc + np.uint64(field + 1)) % np.uint64(META - 8)).astype(np.int64) + 8
    return np.where(null, out, hashed) + WORDS + len(STATS)


class Machine:
    """score = bias + sum of w x + half of sum over factors of (sum of v x)**2 - sum of (v x)**2."""

    def __init__(self, w: np.ndarray, v: np.ndarray, bias: float, centre: np.ndarray, scale: np.ndarray, threshold: float):
        self.bias, self.centre, self.scale, self.threshold = bias, centre, scale, threshold
        self.table = np.concatenate([v, w[:, None], (v * v).sum(axis=1)[:, None]], axis=1).astype(np.float32)

    def assemble(self, d: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return assemble(d, bucket, value, (np.clip((stats - self.centre) / self.scale, -4, 4) / 2), meta)

    def scores(self, d: np.ndarray, f: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """Linear in the number of features, by the sum-of-squares identity."""
        rows = self.table[f]
        k = rows.shape[1] - 2
        order = np.argsort(d, kind="stable")
        d, rows, x = d[order], rows[order], x[order].astype(np.float32)
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        sums = np.zeros((n, k + 1))
        sums[d[first]] = np.add.reduceat(rows[:, : k + 1] * x[:, None], first, axis=0)
        squares = np.bincount(d, rows[:, k + 1] * x * x, n)
        z = self.bias + sums[:, k] + 0.5 * ((sums[:, :k] ** 2).sum(axis=1) - squares)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def batch(self, text: pa.Array, source: pa.Array, lang: pa.Array) -> np.ndarray:
        raw, off, _ = tk.text_buffers(text)
        m = [meta_bucket(source, 0), meta_bucket(lang, 1)]
        out = np.zeros(len(text))
        for i, j in tk.pieces(off):
            d, b, v, s = features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            out[i:j] = self.scores(*self.assemble(d, b, v, s, [c[i:j] for c in m]), j - i)
        return out


def assemble(d: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k = stats.shape
    rows = np.arange(n)
    return (
        np.concatenate([d, np.repeat(rows, k), *[rows] * len(meta)]),
        np.concatenate([bucket, np.tile(WORDS + np.arange(k), n), *meta]),
        np.concatenate([value, stats.ravel(), *[np.full(n, 0.3)] * len(meta)]),
    )


def fit(docs: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, meta: np.ndarray, y: np.ndarray, keep_rate: float, epochs: int = 10, batch: int = 64, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, classes weighted alike; a fifth of the rows sets the threshold that keeps ``keep_rate`` of the good ones."""
    n = len(y)
    held = np.arange(n) % 5 == 4
    centre, scale = stats[~held].mean(axis=0), stats[~held].std(axis=0) + 1e-6
    std = np.clip((stats - centre) / scale, -4, 4) / 2
    rng = np.random.default_rng(seed)
    size = WORDS + len(STATS) + META
    w, v, bias = np.zeros(size), rng.normal(0, 0.02, (size, RANK)), 0.0
    gw, gv, gb = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    weight = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * (~held).sum()
    train = np.flatnonzero(~held)
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), batch):
            rows = train[at : at + batch]
            d, f, x = assemble(np.repeat(np.arange(len(rows)), [len(docs[r][0]) for r in rows]), np.concatenate([docs[r][0] for r in rows]), np.concatenate([docs[r][1] for r in rows]), std[rows], list(meta[rows].T))
            vx = v[f] * x[:, None]
            s = np.zeros((len(rows), RANK))
            np.add.at(s, d, vx)
            z = bias + np.bincount(d, w[f] * x, len(rows)) + 0.5 * ((s * s).sum(axis=1) - np.bincount(d, (vx * vx).sum(axis=1), len(rows)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            used, inverse = np.unique(f, return_inverse=True)
            dw = np.bincount(inverse, g[d] * x, len(used)) + 1e-6 * w[used]
            dv = np.zeros((len(used), RANK))
            np.add.at(dv, inverse, (g[d] * x)[:, None] * (s[d] - vx))
            dv += 1e-5 * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += g.sum() ** 2
            w[used] -= 0.1 * dw / np.sqrt(gw[used])
            v[used] -= 0.05 * dv / np.sqrt(gv[used])
            bias -= 0.1 * g.sum() / np.sqrt(gb)
    out = Machine(w, v, bias, centre, scale, 0.5)
    if (y[held] == 1).any():
        rows = np.flatnonzero(held)
        d, f, x = assemble(np.repeat(np.arange(len(rows)), [len(docs[r][0]) for r in rows]), np.concatenate([docs[r][0] for r in rows]), np.concatenate([docs[r][1] for r in rows]), std[rows], list(meta[rows].T))
        out.threshold = threshold(out.scores(d, f, x, len(rows)), y[rows], keep_rate)
    return out


def threshold(scores: np.ndarray, y: np.ndarray, keep_rate: float) -> float:
    """The score, 0.5 at most, that keeps ``keep_rate`` of the good rows held out.

    Good rows that score under the median of the bad ones are taken for mislabelled and left aside, or a few of them would let
    nearly everything pass. If all do, the classes can't be told apart and every good row counts.
    """
    good, bad = scores[y == 1], scores[y == 0]
    sure = good[good >= np.median(bad)] if len(bad) else good
    return float(min(0.5, np.quantile(sure if len(sure) else good, 1 - keep_rate)))


def train(docs: DataFrame, labels: DataFrame, keep_rate: float = 0.998, max_labelled: int = MAX_LABELLED, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang") -> Machine | None:
    """A machine fitted on at most ``max_labelled`` labelled rows, those with the least hash of their id; None without labels of both classes."""
    marks = labels.where(q(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(q(id_col).alias("id")).agg(F.min("quality").alias("y"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(q(id_col).alias("id"), q(text_col).alias("text"), _text(docs, source_col).alias("source"), _text(docs, lang_col).alias("lang")).where("text is not null")
    some = rows.join(F.broadcast(marks), "id").select("id", "text", "source", "lang", F.col("y").cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off, _ = tk.text_buffers(b.column(1))
            m = np.stack([meta_bucket(b.column(2), 0), meta_bucket(b.column(3), 1)], axis=1)
            for i, j in tk.pieces(off):
                d, f, v, s = features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                at = np.searchsorted(d, np.arange(j - i + 1))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j].cast(pa.string()), b.column(4)[i:j], lists(f.astype(np.int32)), lists(v.astype(np.float32)), pa.array(s.tolist(), pa.list_(pa.float64())), pa.array(m[i:j].tolist(), pa.list_(pa.int64()))], ["id", "y", "f", "x", "s", "m"])

    t = some.mapInArrow(run, "id string, y int, f array<int>, x array<float>, s array<double>, m array<long>").toArrow()
    y = t.column("y").to_numpy()
    if not len(y) or len(set(y.tolist())) < 2:
        return None
    hashes = [(int(hash_of(i)), i) for i in t.column("id").to_pylist()]
    order = sorted(range(len(y)), key=lambda r: hashes[r])
    f, x = t.column("f").combine_chunks(), t.column("x").combine_chunks()
    docs_ = [(f[r].values.to_numpy().astype(np.int64), x[r].values.to_numpy().astype(float)) for r in order]
    return fit(docs_, np.array(t.column("s").to_pylist())[order], np.array(t.column("m").to_pylist())[order], y[order], keep_rate)


def hash_of(x: str) -> int:
    import zlib

    return zlib.crc32(x.encode())


def _text(df: DataFrame, name: str) -> Column:
    return q(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def score_column(docs: DataFrame, machine: Machine | None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> Column:
    """The chance that a row is of good quality; null without a machine, 0 for texts that are null or have nothing but white space."""
    if machine is None:
        return F.lit(None).cast("double")
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def run(text: pa.Array, source: pa.Array, lang: pa.Array) -> pa.Array:
        return pa.array(shared.value.batch(text, source, lang))

    blank = q(text_col).isNull() | (F.trim(F.translate(q(text_col), "\t\r\n", "   ")) == "")
    return F.when(blank, F.lit(0.0)).otherwise(run(q(text_col), _text(docs, source_col), _text(docs, lang_col)))


def classify(docs: DataFrame, labels: DataFrame, keep_rate: float = 0.998, max_labelled: int = MAX_LABELLED, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, score, keep) of every row: the machine's score and whether it is accepted.

    The machine is fitted on at most ``max_labelled`` rows of ``labels`` (id, quality 0 or 1); every row is scored on
    its whole text. The threshold keeps ``keep_rate`` of the good rows held out, but for those that score like bad ones,
    and is 0.5 at most.

    Nulls: texts that are null or blank score 0 and are rejected; null source or language has a feature of its own; a
    null id is carried; null labels are left out; of several labels of one id the worse counts. Repeated rows score
    alike. Without labels of both classes every row has a null score and is kept. An empty table gives an empty one.
    Columns with other names, whatever they are, are left aside.
    """
    machine = train(docs, labels, keep_rate, max_labelled, text_col, id_col)
    limit = machine.threshold if machine else 0.0
    return docs.select(q(id_col).alias(id_col), score_column(docs, machine, text_col).alias("score")).withColumn("keep", F.coalesce(F.col("score") >= limit, F.lit(True)))


def quality_filter(docs: DataFrame, labels: DataFrame, keep_rate: float = 0.998, max_labelled: int = MAX_LABELLED, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns."""
    machine = train(docs, labels, keep_rate, max_labelled, text_col, id_col)
    if machine is None:
        return docs
    s = hidden(docs, "score")
    return docs.withColumn(s, score_column(docs, machine, text_col)).where(F.col(s) >= machine.threshold).drop(s)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
