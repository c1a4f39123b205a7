"""Operator 10, approximate nearest neighbours: inverted lists scanned in column blocks of rotated vectors, with early abandoning.

After a random rotation the first d of D columns estimate a whole distance: dist_d * D / d. A candidate is abandoned
once a test says that its distance exceeds the k-th best so far: sqrt(dist_d * D / d) > (1 + e / sqrt(d)) * best. The
number of lists that each query probes is found by measuring recall against exact search for a sample of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.tables import q, read
from palimpsest.shared import cut

K, STEP, EPSILON, TARGET = 10, 16, 1.9, 0.96
#: The lists' centres are fitted on about so many vectors a list; every vector is then indexed.
FIT_A_LIST = 64
#: Numbers in the largest matrix of distances to centres that a task holds.
CELLS = 1 << 23


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)


def _square(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def scan(queries: np.ndarray, qid: np.ndarray, probing: list[np.ndarray], base: np.ndarray, bid: np.ndarray, bounds: np.ndarray, k: int, step: int = STEP, epsilon: float = EPSILON, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k nearest of each query among the lists it probes; inf where there are fewer.

    ``base`` is sorted by list; list i lies at bounds[i]:bounds[i+1] and is probed by the queries probing[i].
    """
    d = base.shape[1]
    cuts = [*range(0, d, step), d]
    if len(cuts) > 2 and cuts[-1] == cuts[-2]:
        cuts.pop()
    top, ids = np.full((len(queries), k), np.inf, np.float32), np.full((len(queries), k), -1, np.int64)
    bn = [_square(base[:, a:b]) for a, b in zip(cuts, cuts[1:])]
    qn = [_square(queries[:, a:b]) for a, b in zip(cuts, cuts[1:])]
    for i, members in enumerate(probing):
        for q0 in range(0, len(members), tile):
            rows = members[q0 : q0 + tile]
            for c0 in range(int(bounds[i]), int(bounds[i + 1]), tile):
                c1 = min(c0 + tile, int(bounds[i + 1]))
                best = top[rows, -1]
                part = np.zeros((len(rows), c1 - c0), np.float32)
                pair: tuple[np.ndarray, np.ndarray] | None = None
                value = part
                for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if pair is None:
                        part += qn[s][rows][:, None] + bn[s][c0:c1] - 2 * (queries[rows, a:b] @ base[c0:c1, a:b].T)
                    else:
                        diff = queries[rows[pair[0]], a:b] - base[c0 + pair[1], a:b]
                        value = value + np.einsum("ij,ij->i", diff, diff)
                    if b == d:
                        break
                    limit = best * np.float32((1 + epsilon / b**0.5) ** 2 * b / d)
                    if pair is None:
                        alive = part <= limit[:, None]
                        if np.count_nonzero(alive) < 0.2 * alive.size:  # few are left: go on with these alone
                            pair = np.nonzero(alive)
                            value = part[pair]
                        else:
                            part[~alive] = np.inf
                    else:
                        keep = value <= limit[pair[0]]
                        pair, value = (pair[0][keep], pair[1][keep]), value[keep]
                if pair is None:
                    part[qid[rows][:, None] == bid[c0:c1]] = np.inf
                    part = np.maximum(part, 0)
                    if part.shape[1] > k:
                        near = np.argpartition(part, k - 1, axis=1)[:, :k]
                        part, found = np.take_along_axis(part, near, 1), bid[c0:c1][near]
                    else:
                        found = np.broadcast_to(bid[c0:c1], part.shape)
                    hit = np.flatnonzero(part.min(axis=1) <= best)
                    if len(hit):
                        both, names = np.concatenate([top[rows[hit]], part[hit]], axis=1), np.concatenate([ids[rows[hit]], found[hit]], axis=1)
                        order = np.lexsort((names, both), axis=1)[:, :k]
                        top[rows[hit]], ids[rows[hit]] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
                    continue
                keep = (value <= best[pair[0]]) & (qid[rows[pair[0]]] != bid[c0 + pair[1]])
                p, x, v = pair[0][keep], bid[c0 + pair[1][keep]], np.maximum(value[keep], 0)
                if len(p):
                    hit = np.unique(p)
                    w = np.concatenate([np.repeat(hit, k), p])
                    v, x = np.concatenate([top[rows[hit]].ravel(), v]), np.concatenate([ids[rows[hit]].ravel(), x])
                    order = np.lexsort((x, v, w))
                    place = np.arange(len(w)) - np.repeat(np.searchsorted(w[order], hit), np.bincount(np.searchsorted(hit, w)))
                    kept = order[place < k]
                    top[rows[hit]], ids[rows[hit]] = v[kept].reshape(-1, k), x[kept].reshape(-1, k)
    return top, ids


def _steps(x: np.ndarray, centres: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances to the centres, less a constant for each row, for as many rows at a time as make CELLS numbers."""
    size, step = _square(centres), max(1, CELLS // len(centres))
    for a in range(0, len(x), step):
        part = slice(a, min(a + step, len(x)))
        yield part, size - 2 * (x[part] @ centres.T)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for part, dist in _steps(x, centres):
        out[part] = dist.argmin(axis=1)
    return out


def _lloyd(vectors: DataFrame, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd steps over the vectors given: partial sums by list are combined before they reach the driver."""
    n, d = centres.shape
    for _ in range(rounds):
        c = vectors.sparkSession.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], c=c) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((n, d)), np.zeros(n, np.int64)
            for b in batches:
                x = _matrix(b.column(0), d)
                near = _nearest(x, c.value)
                np.add.at(total, near, x)
                count += np.bincount(near, minlength=n)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"list": pa.array(used), "n": pa.array(count[used]), "sum": pa.array(total[used].tolist(), pa.list_(pa.float64()))})

        parts = vectors.select("v").mapInArrow(sums, "list long, n long, sum array<double>")
        added = F.array(*[F.sum(F.col("sum")[i]) for i in range(d)])
        centres = centres.copy()
        for r in parts.groupBy("list").agg(F.sum("n").alias("n"), added.alias("sum")).toLocalIterator():
            centres[r["list"]] = np.array(r["sum"]) / r["n"]
    return centres.astype(np.float32)


def _exact(vectors: DataFrame, queries: np.ndarray, qid: np.ndarray, k: int) -> tuple[dict[int, list[int]], float]:
    """The exact k nearest ids of a few queries, and the share of them that the scan with its tests finds; every partition sends its best k of both."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, qid))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, name = shared.value
        for b in batches:
            y, ids = _matrix(b.column(1), x.shape[1]), np.asarray(b.column(0))
            for tested in (False, True):
                dist, near = scan(x, name, [np.arange(len(x))], y, ids, np.array([0, len(y)]), k, epsilon=EPSILON if tested else 1e6)
                yield pa.RecordBatch.from_pydict({"q": pa.array(np.repeat(np.arange(len(x)), k)), "tested": pa.array(np.full(len(x) * k, tested)), "id": pa.array(near.ravel()), "dist": pa.array(dist.ravel().astype(float))})

    rows = vectors.select("id", "v").mapInArrow(best, "q long, tested boolean, id long, dist double").where("dist < 1e30")
    merged = rows.groupBy("q", "tested").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "id"))), 1, k).alias("near"))
    found = {(r["q"], r["tested"]): [x["id"] for x in r["near"]] for r in merged.toLocalIterator()}
    exact = {i: near for (i, tested), near in found.items() if not tested}
    kept = sum(len({*near} & {*found.get((i, True), ())}) for i, near in exact.items())
    return exact, kept / max(1, sum(map(len, exact.values())))


def neighbours(table: DataFrame, k: int = K, target: float = TARGET, calibration: int = 256, block_rows: int = 8192, query_rows: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding", asks: Column | None = None, seed: int = 1) -> DataFrame:
    """(vec_id, neighbours, distances) for every row with an id (or those where ``asks``, a condition on ``table``, holds): its ``k`` nearest other rows of the table by Euclidean distance.

    Vectors go to about sqrt(n) lists (k-means, fitted on about FIT_A_LIST vectors a list, chosen by hash; every vector
    is indexed). For ``calibration`` queries exact search shows which lists hold the neighbours and how many of them
    the tests lose, and every query probes as many of its nearest lists as give those queries a recall of ``target``
    (well spread vectors need half of the lists, clustered ones a few). Lists that lie together form blocks of about
    ``block_rows`` vectors, and a query is sent once to each block that it probes. Lists too large for a block are
    split, the queries of a block come in parts of ``query_rows``, and distances to centres are worked out for a few
    rows at a time, so no task grows with the data.

    Ids may have any type that can be sorted. Nulls and faults: rows with a null id can't be named and are left out,
    and a condition that is null doesn't hold. Of rows with one id the least vector counts, and the id asks if any of them does. Rows
    with a null vector, null or non-finite components, or a length other than the commonest have empty lists and are
    nobody's neighbours. Equal vectors are neighbours at distance 0; ties go by id. Fewer than k others give
    shorter lists; an empty table gives an empty one. Columns with other names, whatever they are, are left aside.
    """
    spark = table.sparkSession
    wanted = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    rows = table.where(q(id_col).isNotNull()).select(q(id_col).alias("name"), q(vec_col).cast("array<float>").alias("v"), wanted.alias("asks")).groupBy("name").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    numbers = isinstance(table.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if numbers:
        rows = rows.withColumn("id", F.col("name").cast("long"))
    else:  # numbers in the order of the names stand in for them
        rows = cut(rows.orderBy("name").withColumn("id", F.monotonically_increasing_id()))
    fine = F.coalesce(F.size("v") > 0, F.lit(False)) & ~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    rows = cut(rows.withColumn("fine", fine))
    kind = table.schema[id_col].dataType.simpleString()
    common = rows.where("fine").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = f"cast(array() as array<{kind}>) neighbours", "cast(array() as array<double>) distances"
    if common is None:
        return rows.where("asks").selectExpr("name vec_id", *empty)
    d, n = common["d"], common["count"]
    good = F.col("fine") & (F.size("v") == d)
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.float32)
    turned = spark.sparkContext.broadcast(turn)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), d) @ turned.value
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, d), pa.int32()), pa.array(x.ravel())), b.column(2)], ["id", "v", "asks"])

    vectors = cut(rows.where(good).select("id", "v", "asks").mapInArrow(rotate, "id long, v array<float>, asks boolean"))
    lists = max(1, round(n**0.5))
    start = np.stack([np.array(r["v"], np.float32) for r in vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(lists).toLocalIterator()])
    some = F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(1 << 32)) < min(1 << 32, (FIT_A_LIST * lists << 32) // n)
    centres = _lloyd(vectors.where(some), start, 4)
    # Lists that lie together are numbered together, so that a query's lists share blocks.
    centres = centres[np.argsort(_near_order(centres), kind="stable")]
    lists = len(centres)

    sample = vectors.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(calibration).collect()
    sq, sid = np.array([r["v"] for r in sample], np.float32), np.array([r["id"] for r in sample])
    exact, kept = _exact(vectors, sq, sid, k)
    c = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), d)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(_nearest(x, c.value).astype(np.int32))], ["id", "v", "asks", "list"])

    placed = cut(vectors.mapInArrow(assign, "id long, v array<float>, asks boolean, list int"))
    wanted = sorted({x for near in exact.values() for x in near})  # at most k for each calibration query
    found = {r["id"]: r["list"] for r in placed.join(F.broadcast(spark.createDataFrame([(int(x),) for x in wanted] or [(-1,)], "id long")), "id").select("id", "list").collect()}
    ranks = np.argsort(np.argsort(_square(centres) - 2 * (sq @ centres.T), axis=1), axis=1)
    need = np.sort([ranks[i, found[x]] + 1 for i, near in exact.items() for x in near]) if wanted else np.array([1])
    probes = int(min(lists, need[min(len(need) - 1, int(np.ceil(target / max(kept, target) * len(need))))]))

    # Blocks: consecutive lists up to block_rows; a larger list has several blocks of its own.
    size = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().toLocalIterator():
        size[r["list"]] = r["count"]
    first, parts, at, filled = np.zeros(lists, np.int64), np.ones(lists, np.int64), 0, 0
    for i in range(lists):
        if filled and filled + size[i] > block_rows:
            at, filled = at + 1, 0
        first[i], parts[i] = at, max(1, -(-size[i] // (2 * block_rows)))
        if parts[i] > 1:
            at, filled = at + parts[i], 0
        else:
            filled += size[i]
    plan = spark.sparkContext.broadcast((first, parts))

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, p = plan.value
        for b in batches:
            ids, x = np.asarray(b.column(0)), _matrix(b.column(1), d)
            for part, dist in _steps(x, c.value):
                probe = np.argpartition(dist, probes - 1, axis=1)[:, :probes] if probes < lists else np.broadcast_to(np.arange(lists), dist.shape)
                row, lst = np.repeat(np.arange(len(dist)), probes), probe.ravel()
                times = p[lst]
                row, lst = np.repeat(row, times), np.repeat(lst, times)
                blk = f[lst] + np.arange(len(lst)) - np.repeat(np.cumsum(times) - times, times)
                order = np.lexsort((lst, blk, row))
                row, lst, blk = row[order], lst[order], blk[order]
                new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (blk[1:] != blk[:-1]))))
                off = pa.array(np.append(new, len(row)), pa.int32())
                vecs = b.column(1).slice(part.start, part.stop - part.start).take(pa.array(row[new]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[part][row[new]]), vecs, pa.array(blk[new]), pa.ListArray.from_arrays(off, pa.array(lst.astype(np.int32)))], ["id", "v", "block", "probe"])

    asked = cut(placed.where("asks").select("id", "v").mapInArrow(to_blocks, "id long, v array<float>, block long, probe array<int>"))
    waves = asked.groupBy("block").agg(F.ceil(F.count("*") / query_rows).cast("long").alias("waves"))
    homes = spark.createDataFrame([(i, int(first[i]), int(parts[i])) for i in range(lists)], "list int, first long, parts long")
    home = placed.join(F.broadcast(homes), "list").select("id", "v", "list", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))
    base = home.join(F.broadcast(waves), "block").withColumn("wave", F.explode(F.sequence(F.lit(0).cast("long"), F.col("waves") - 1))).drop("waves")
    asking = asked.join(F.broadcast(waves), "block").withColumn("wave", F.pmod(F.xxhash64("id"), F.col("waves"))).drop("waves")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        schema = pa.schema([("id", pa.int64()), ("near", pa.list_(pa.int64())), ("dist", pa.list_(pa.float64()))])
        if not len(left) or not len(right):
            return schema.empty_table()
        lst = left.column("list").to_numpy()
        order = np.lexsort((left.column("id").to_numpy(), lst))
        x, bid, lst = _matrix(left.column("v"), d)[order], left.column("id").to_numpy()[order], lst[order]
        own, bounds = np.unique(lst, return_index=True)
        probe = right.column("probe").combine_chunks()
        flat, owner = probe.flatten().to_numpy(), np.repeat(np.arange(len(probe)), np.diff(probe.offsets.to_numpy()))
        by = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[by], own), np.searchsorted(flat[by], own, "right")
        members = [owner[by[a:b]] for a, b in zip(*cuts)]
        qid = right.column("id").to_numpy()
        dist, near = scan(_matrix(right.column("v"), d), qid, members, x, bid, np.append(bounds, len(x)), k)
        has = np.isfinite(dist)
        off = pa.array(np.concatenate(([0], np.cumsum(has.sum(axis=1)))), pa.int32())
        return pa.Table.from_arrays([pa.array(qid), pa.ListArray.from_arrays(off, pa.array(near[has])), pa.ListArray.from_arrays(off, pa.array(dist[has].astype(float)))], schema=schema)

    partial = base.groupBy("block", "wave").cogroup(asking.groupBy("block", "wave")).applyInArrow(search, "id long, near array<long>, dist array<double>")
    pairs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("dist"), F.col("near")))))
    best = partial.groupBy("id").agg(F.slice(pairs, 1, k).alias("b")).withColumn("b", F.transform("b", lambda x: F.struct(F.sqrt(x["dist"]).alias("dist"), x["near"].alias("near"))))
    if numbers:
        best = best.select(F.col("id").cast(kind).alias("vec_id"), F.col("b.near").cast(f"array<{kind}>").alias("neighbours"), F.col("b.dist").alias("distances"))
    else:
        names = rows.select("id", "name")
        pair = best.select("id", F.posexplode_outer("b").alias("at", "x")).select("id", "at", "x.dist", F.col("x.near").alias("near"))
        pair = pair.join(names.select(F.col("id").alias("near"), F.col("name").alias("other")), "near", "left")
        back = pair.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "dist", "other")))).alias("b"))
        best = back.join(names, "id").select(F.col("name").alias("vec_id"), F.col("b.other").alias("neighbours"), F.col("b.dist").alias("distances"))
    return best.unionByName(rows.where(~good & F.col("asks")).selectExpr("name vec_id", *empty))


def _near_order(x: np.ndarray) -> np.ndarray:
    """Numbers for points such that near points have near numbers: halves along the direction of the largest spread, again and again."""
    out = np.zeros(len(x), np.int64)

    def halve(rows: np.ndarray, at: int) -> None:
        if len(rows) < 2:
            out[rows] = at
            return
        y = x[rows] - x[rows].mean(axis=0)
        axis = y[np.argmax(_square(y))]
        rows = rows[np.argsort(y @ axis, kind="stable")]
        mid = len(rows) // 2
        halve(rows[:mid], at)
        halve(rows[mid:], at + mid)

    halve(np.arange(len(x)), 0)
    return np.argsort(np.argsort(out, kind="stable"), kind="stable")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours, among all embeddings, of every embedding whose id is divisible by 100."""
    return neighbours(read(spark, sf_dir, "embeddings"), asks=q("vec_id") % 100 == 0)
