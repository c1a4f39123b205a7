"""Operator 5, language identification: averaged embeddings of hashed subwords, a linear softmax, and calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import textkit as tk
from palimpsest.llm.tables import HIDDEN, q, read

BUCKETS, DIM, SIZES = 1 << 17, 16, (3, 4)
#: Bound on the rows of each language that the model is fitted on.
PER_LANGUAGE = 400


def subwords(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every run of 3 or 4 normalised bytes that lies in one word, its edges included."""
    norm = tk.normalise(raw)
    n = len(norm)
    sums, inverse = tk.prefix(norm), tk.powers(n + 1)[1]
    ends = np.repeat(off[1:], np.diff(off))
    docs = np.repeat(np.arange(len(off) - 1), np.diff(off))
    word = norm != 0
    found, owner = [], []
    for size in SIZES:
        if n < size:
            continue
        m = n - size + 1
        ok = np.arange(size, n + 1) <= ends[:m]
        for k in range(1, size - 1):
            ok &= word[k : k + m]
        at = np.flatnonzero(ok)
        h = tk.mix((sums[at + size] - sums[at]) * inverse[at] + np.uint64(size))
        found.append((h & np.uint64(BUCKETS - 1)).astype(np.int64))
        owner.append(docs[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owner), np.concatenate(found)


class Model:
    """The product of embeddings and softmax weights is folded into one table: the mean of its rows gives the logits.

    A last column marks the subwords that were seen in training. A text with fewer of these than texts held out have
    (``usual``) loses confidence in proportion, so a script or language that the model doesn't know is rejected.
    """

    def __init__(self, languages: list[str], table: np.ndarray, seen: np.ndarray, temperature: float, least: float, usual: float):
        self.languages, self.table = languages, np.concatenate([table, seen[:, None]], axis=1).astype(np.float32)
        self.temperature, self.least, self.usual = temperature, least, usual

    def chances(self, mean: np.ndarray) -> np.ndarray:
        z = mean[:, :-1] / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True) * np.minimum(1, mean[:, -1:] / self.usual)

    def batch(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the likeliest language, its calibrated chance) of each text; chance 0 where there is no subword."""
        raw, off, _ = tk.text_buffers(text)
        best, chance = np.zeros(len(text), np.int64), np.zeros(len(text))
        for i, j in tk.pieces(off, 1 << 19):
            d, b = subwords(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            n = np.bincount(d, minlength=j - i)
            mean = np.stack([np.bincount(d, self.table[b, c], j - i) for c in range(self.table.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
            p = self.chances(mean)
            best[i:j] = p.argmax(axis=1)
            chance[i:j] = np.where(n > 0, p.max(axis=1), 0.0)
        return best, chance


def fit(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], precision: float, epochs: int = 6, batch: int = 16, seed: int = 5) -> Model:
    """Stochastic gradient descent in numpy. A fifth of the rows, held out, sets the temperature and the least chance that is accepted."""
    k = len(languages)
    rng = np.random.default_rng(seed)
    e, w = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, k))
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 20 else np.zeros(len(y), bool)
    train = np.flatnonzero(~held)
    touched = np.zeros(BUCKETS, bool)

    def gather(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = np.repeat(np.arange(len(rows)), [len(docs[r][0]) for r in rows])
        b = np.concatenate([docs[r][0] for r in rows])
        c = np.concatenate([docs[r][1] / max(1, docs[r][1].sum()) for r in rows])
        return d, b, c

    rate, steps, done = 2.0, epochs * -(-len(train) // batch), 0
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), batch):
            rows = train[at : at + batch]
            d, b, c = gather(rows)
            touched[b] = True
            x = np.stack([np.bincount(d, e[b, f] * c, len(rows)) for f in range(DIM)], axis=1)
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = p / len(rows)
            lr = rate * (1 - done / steps)
            done += 1
            dx = g @ w.T
            w -= lr * (x.T @ g)
            step = dx[d] * c[:, None] * (-lr * 50)  # each subword is a small part of the mean
            used, inv = np.unique(b, return_inverse=True)
            e[used] += np.stack([np.bincount(inv, step[:, f], len(used)) for f in range(DIM)], axis=1)
    e[~touched] = 0  # subwords that were never seen speak for no language
    model = Model(languages, e @ w, touched.astype(float), 1.0, 0.5, 1.0)
    rows = np.flatnonzero(held)
    if len(rows):
        d, b, c = gather(rows)
        mean = np.stack([np.bincount(d, model.table[b, j] * c, len(rows)) for j in range(k + 1)], axis=1)
        model.usual = float(max(0.1, np.quantile(mean[:, -1], 0.01)))

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(np.maximum(model.chances(mean)[np.arange(len(rows)), y[rows]], 1e-12)).mean()

        model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
        p = model.chances(mean)
        top, right = p.max(axis=1), p.argmax(axis=1) == y[rows]
        order = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(rows) + 1) >= precision)
        # Accept down to the lowest chance at which the accepted rows are still as precise as wanted, and always above a half.
        model.least = float(max(0.5, top[order[good[-1]]])) if len(good) and good[-1] + 1 < len(rows) else 0.5
    return model


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, precision: float = 0.99, text_col: str = "text", id_col: str = "doc_id", label_col: str = "lang") -> Model | None:
    """A model fitted on at most ``per_language`` labelled rows of each language, those with the least hash of id; None without any."""
    rows = docs.select(F.xxhash64(q(id_col), F.lit(3)).alias("o"), q(label_col).alias("y"), q(id_col).alias("id"), q(text_col).isNull().alias("none")).where("y is not null and id is not null and not none").drop("none")
    rank = F.row_number().over(Window.partitionBy("y").orderBy("o", "id"))
    picked = rows.withColumn("r", rank).where(F.col("r") <= per_language).select("id", "o").distinct()
    some = docs.select(q(id_col).alias("id"), q(text_col).alias("text"), q(label_col).alias("y")).where("text is not null and y is not null").join(F.broadcast(picked), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            raw, off, _ = tk.text_buffers(t.column(1))
            for i, j in tk.pieces(off):
                d, b = subwords(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                d, b, n = tk.counted(d, b.astype(np.uint64))
                at = np.searchsorted(d, np.arange(j - i + 1))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.astype(np.int32)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([t.column(3)[i:j], t.column(2)[i:j], lists(b), lists(n)], ["o", "y", "b", "n"])

    t = some.select("id", "text", "y", "o").mapInArrow(run, "o long, y string, b array<int>, n array<int>").toArrow()
    if not len(t):
        return None
    names, o = t.column("y").to_pylist(), t.column("o").to_pylist()
    order = sorted(range(len(names)), key=lambda r: (o[r], names[r]))
    languages = sorted(set(names))
    b, n = t.column("b").combine_chunks(), t.column("n").combine_chunks()
    sets = [(b[r].values.to_numpy().astype(np.int64), n[r].values.to_numpy().astype(float)) for r in order]
    return fit(sets, np.array([languages.index(names[r]) for r in order]), languages, precision)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, precision: float = 0.99, text_col: str = "text", id_col: str = "doc_id", label_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(id, language, confidence) of every row; language is ``und`` where the calibrated confidence is too low.

    A text whose subwords are mostly unknown loses confidence in proportion.
    The model is fitted on at most ``per_language`` rows of each value of ``label_col``; every row is judged by its
    whole text. Confidence is the softmax chance at a temperature fitted on rows held out; the least one accepted
    keeps ``precision`` among the accepted rows held out, and is at least a half.

    Nulls: null texts and texts without any subword are ``und`` with confidence 0. Null labels are left out of the
    fit; a null id is carried. Repeated rows are judged alike; a tie goes to the first language by name. Without any
    labelled row all are ``und``. An empty table gives an empty one. Other columns, whatever their names, are left aside.
    """
    model = model or train(docs, per_language, precision, text_col, id_col, label_col)
    if model is None:
        return docs.select(q(id_col).alias(id_col), F.lit("und").alias("language"), F.lit(0.0).alias("confidence"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<language string, confidence double>")
    def run(text: pa.Array) -> pa.Array:
        m = shared.value
        best, chance = m.batch(text)
        names = [m.languages[i] if c >= m.least else "und" for i, c in zip(best.tolist(), chance.tolist())]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(chance)], ["language", "confidence"])

    r = HIDDEN + "r"
    return docs.select(q(id_col).alias(id_col), run(q(text_col)).alias(r)).select(q(id_col).alias(id_col), F.col(f"{r}.language").alias("language"), F.col(f"{r}.confidence").alias("confidence"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document."""
    return identify(read(spark, sf_dir, "documents"))
