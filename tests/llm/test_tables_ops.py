import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing, neighbours, packing, registry, sharding
from tests.conftest import DATA
from tests.llm.conftest import make
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    check(registry.QUERIES[name](spark, DATA), registry.ORACLE_SQL[name], DATA)


def test_every_operator_has_its_query():
    assert sorted({int(n[2:].split("_")[0]) for n in registry.QUERIES}) == list(range(1, 11))


def test_mixing_messy(spark, messy):
    out = mixing.mix_sources(messy, weights={}, share=(1, 1))
    assert out.columns == messy.columns
    assert 0 < out.count() <= messy.count()
    assert mixing.mix_sources(messy.where("false")).count() == 0
    # all tokens wanted many times over: everything stays, ties and nulls too
    assert mixing.mix_sources(messy, weights={}, share=(100, 1)).count() == messy.count()


def test_mixing_is_nested_and_within_budget(spark):
    rng = random.Random(1)
    docs = make(spark, [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), "en", rng.choice("aaaaab")) for i in range(3000)])
    tokens = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in docs.collect()}
    total = sum(n for _, n in tokens.values())
    before = set()
    for share in (1, 3, 6):
        kept = {r["doc_id"] for r in mixing.mix_sources(docs, weights={"a": 1, "b": 1}, share=(share, 10)).collect()}
        assert before <= kept
        before = kept
        for s in "ab":
            have = sum(n for x, n in tokens.values() if x == s)
            got = sum(tokens[d][1] for d in kept if tokens[d][0] == s)
            budget = total * share // 20
            assert got <= budget and (got == have or got > budget - 60)
    assert mixing.mix_sources(docs, weights={"a": 0, "b": 1}, share=(1, 1)).where("source = 'a'").count() == 0


def test_mixing_without_broadcast_is_alike(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(mixing.mix_sources(docs)) == ids(mixing.mix_sources(docs, max_broadcast_sources=0))


def optimum(sizes, capacity):
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= sizes[i]:
                rest = list(bins)
                rest.remove(room)
                put(i + 1, [*rest, room - sizes[i]])
        put(i + 1, [*bins, capacity - sizes[i]])

    put(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([10, 20, 50])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
        bins = packing.complete(sizes, capacity, 100_000)
        assert Counter(x for b in bins for x in b) == Counter(sizes) and all(sum(b) <= capacity for b in bins)
        assert len(bins) == optimum(sizes, capacity)


def test_bin_completion_beats_best_fit():
    rng = random.Random(4)
    for _ in range(30):
        sizes = []
        for _ in range(8):  # eight bins that are exactly full
            a, b = sorted(rng.sample(range(100, 900), 2))
            sizes += [a, b - a, 1000 - b]
        assert len(packing.complete(sizes, 1000, 200_000)) == 8 < len(packing.best_fit(sorted(sizes, reverse=True), 1000))


@pytest.mark.parametrize("least,most,saved", [(300, 1200, 7), (250, 1000, 10)])
def test_bin_completion_saves_bins_at_production_size(least, most, saved):
    rng = random.Random(1)
    sizes = [rng.randint(least, most) for _ in range(packing.BLOCK)]
    bins = packing.pack_block(np.array(sizes), packing.CAPACITY)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= packing.CAPACITY for b in bins)
    assert len(bins) <= len(packing.best_fit(sorted(sizes, reverse=True), packing.CAPACITY)) - saved


def covered(rows):
    """(id, token ranges) of all sequences."""
    out = defaultdict(list)
    for r in rows:
        assert len(r["doc_ids"]) == len(r["starts"]) == len(r["lengths"]) and sum(r["lengths"]) == r["used"]
        for d, s, n in zip(r["doc_ids"], r["starts"], r["lengths"]):
            out[d].append((s, n))
    return out


def test_packing_holds_every_token_once(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = packing.pack(docs, capacity=300, block=50).collect()
    assert all(0 < r["used"] <= 300 for r in rows) and len({r["sequence"] for r in rows}) == len(rows)
    parts = covered(rows)
    total = 0
    for r in docs.collect():
        at = 0
        for s, n in sorted(parts.pop(r["doc_id"], [])):
            assert s == at
            at += n
        assert at == len(r["text"].split())
        total += at
    assert not parts and len(rows) <= 1.05 * total / 300 + docs.count() / 50 + 1


def test_packing_messy(spark, messy):
    parts = covered(packing.pack(messy, capacity=1000).collect())
    assert sum(n for _, n in parts[1]) == 20 and sum(n for _, n in parts[None]) == 10
    assert not {3, 4, 5, 6} & set(parts) and sum(n for _, n in parts[7]) == 120_000
    assert packing.pack(messy.where("false")).count() == 0


def test_differencing_by_hand():
    sums, part, slot = sharding.differencing(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))
    sums = sums[0]
    assert abs(sums[0] - sums[1]) == 2 and sums.sum() == 30  # the textbook case
    assert [sum(x for x, s in zip((8, 7, 6, 5, 4), slot[:, 0]) if s == k) for k in (0, 1)] == sums.tolist()
    assert sharding.differencing(np.array([[5, 0, 0]]))[0].tolist() == [[5, 0, 0]]
    sums, part, slot = sharding.differencing(np.array([[8, 0], [7, 0], [1, 0], [1, 0]]), leave=3)
    assert sums.tolist() == [[1, 0], [1, 0], [8, 7]] and part.tolist() == [2, 2, 0, 1] and slot[:, 0].tolist() == [0, 1, 0, 0]


def plain_differencing(sizes, k):
    """Sums of the parts by the definition: the two of the largest spread are combined, until one is left."""
    parts = [[n] + [0] * (k - 1) for n in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: max(p) - min(p))
        a, b = sorted(parts.pop(), reverse=True), sorted(parts.pop())
        parts.append([x + y for x, y in zip(a, b)])
    return sorted(parts[0])


def best_spread(sizes, k):
    best = [sum(sizes)]

    def put(i, sums):
        if i == len(sizes):
            best[0] = min(best[0], max(sums) - min(sums))
            return
        for j in {s: j for j, s in enumerate(sums)}.values():
            sums[j] += sizes[i]
            put(i + 1, sums)
            sums[j] -= sizes[i]

    put(0, [0] * k)
    return best[0]


def test_differencing_against_exhaustive_search():
    rng = random.Random(6)
    exact = greedy_worse = 0
    for _ in range(200):
        k, sizes = rng.choice((2, 3, 4)), [rng.randint(1, 60) for _ in range(rng.randint(1, 8))]
        v = np.zeros((len(sizes), k), np.int64)
        v[:, 0] = sizes
        sums, part, slot = sharding.differencing(v)
        assert len(sums) == 1 and not part.any()
        filled = [sum(n for n, s in zip(sizes, slot[:, 0]) if s == j) for j in range(k)]
        assert filled == sums[0].tolist()  # the places are those of a partition with these sums
        spread, best = max(filled) - min(filled), best_spread(sorted(sizes, reverse=True), k)
        assert spread >= best
        exact += spread == best
        greedy = [0] * k
        for n in sorted(sizes, reverse=True):
            greedy[greedy.index(min(greedy))] += n
        greedy_worse += (max(greedy) - min(greedy) > spread) - (max(greedy) - min(greedy) < spread)
    assert exact >= 100 and greedy_worse > 0


def test_shards_of_one_node_are_those_of_plain_differencing(spark):
    rng = random.Random(8)
    sizes = rng.sample(range(10**4, 10**6), 60)
    docs = make(spark, [(i, "x" * n) for i, n in enumerate(sizes)])
    rows = sharding.shard(docs, shards=5).collect()
    got = Counter()
    for r in rows:
        got[r["shard"]] += sizes[r["doc_id"]]
        assert r["bytes"] == sizes[r["doc_id"]]
    assert sorted(got.values()) == plain_differencing(sizes, 5)


def test_sharding_balances_better_than_hashing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hashed = Counter()
    for r in docs.selectExpr("pmod(xxhash64(text), 8) as s", "octet_length(text) as n").collect():
        hashed[r["s"]] += r["n"]
    assert max(hashed.values()) - min(hashed.values()) > 0.1 * sum(hashed.values()) / 8
    for fan, spread in ((2048, 0.001), (150, 0.02), (40, 0.1)):  # one node, two levels, and three of very small nodes
        rows = sharding.shard(docs, shards=8, fan=fan).collect()
        assert len(rows) == docs.count()
        size = Counter()
        for r in rows:
            size[r["shard"]] += r["bytes"]
        assert len(size) == 8 and max(size.values()) - min(size.values()) < spread * sum(size.values()) / 8
    home = defaultdict(set)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        home[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in home.values())


def test_sharding_messy(spark, messy):
    rows = sharding.shard(messy, shards=3).collect()
    assert len(rows) == messy.count() and {r["shard"] for r in rows} <= {0, 1, 2}
    assert len({r["shard"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert sharding.shard(messy.where("false")).count() == 0
    assert sharding.shard(messy, shards=1).select("shard").distinct().count() == 1


def exact_neighbours(x, k):
    d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


def recall(rows, ids, x, k):
    want, hit = exact_neighbours(x, k), 0
    got = {r["vec_id"]: r for r in rows}
    for i, name in enumerate(ids):
        r = got[name]
        assert len(set(r["neighbours"])) == len(r["neighbours"]) == k and name not in r["neighbours"]
        assert r["distances"] == sorted(r["distances"])
        hit += (np.array(r["distances"]) <= want[i, -1] + 1e-4).sum()
    return hit / (k * len(ids))


def test_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = df.toPandas()
    assert recall(neighbours.neighbours(df).collect(), p["vec_id"].tolist(), np.stack(p["embedding"]).astype(float), 10) >= 0.9


def test_neighbours_of_the_registered_queries(spark):
    """Every row whose id is divisible by 100 asks, against all rows."""
    p = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.stack(p["embedding"]).astype(float), p["vec_id"].to_numpy()
    got = {r["vec_id"]: r for r in neighbours.op10_neighbours(spark, "/root/testdata/sf0.1").collect()}
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 100 == 0)
    at, hit = {i: k for k, i in enumerate(ids.tolist())}, 0
    for i, r in got.items():
        far = np.sqrt(((x - x[at[i]]) ** 2).sum(1))
        assert i not in r["neighbours"] and np.allclose([far[at[j]] for j in r["neighbours"]], r["distances"], atol=1e-3)
        hit += (np.array(r["distances"]) <= np.sort(np.delete(far, at[i]))[9] + 1e-4).sum()
    assert hit >= 0.9 * 10 * len(got)


def test_neighbours_by_text_ids(spark):
    rows = [("a", [0.0, 0.0]), ("b", [0.0, 0.0]), ("é", [3.0, 4.0]), ("", [0.0, 1.0]), ("z", None), (None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    out = {r["vec_id"]: (r["neighbours"], r["distances"]) for r in neighbours.neighbours(df, k=2).collect()}
    assert set(out) == {"a", "b", "é", "", "z"} and out["z"] == ([], [])
    assert out[""] == (["a", "b"], [1.0, 1.0]) and out["a"] == (["b", ""], [0.0, 1.0])
    some = neighbours.neighbours(df, k=1, asks=F.when(F.col("vec_id") == "é", F.lit(True))).collect()
    assert [(r["vec_id"], r["neighbours"]) for r in some] == [("é", [""])]
    short = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "vec_id int, embedding array<double>")
    out = neighbours.neighbours(short)
    assert out.schema["neighbours"].dataType.elementType.simpleString() == "int" and {r["vec_id"]: r["neighbours"] for r in out.collect()} == {1: [2], 2: [1]}


def test_neighbours_with_split_lists_and_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(600, 24)) * 0.01 + 3, rng.normal(size=(12, 1, 24)).repeat(40, 1).reshape(-1, 24) + rng.normal(size=(480, 24)) * 0.1]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    rows = neighbours.neighbours(df, k=5, block_rows=40, query_rows=100).collect()
    assert recall(rows, list(range(len(x))), x.astype(float), 5) >= 0.9


def test_neighbours_messy(spark):
    schema = "vec_id long, embedding array<float>, label int, id string, v int, list int, block string"
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0]), (3, [3.0, 4.0]), (4, None), (5, [1.0]), (6, [float("nan"), 0.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, 1, "x", 1, 1, "b") for r in rows], schema)
    out = {r["vec_id"]: r for r in neighbours.neighbours(df, k=5).collect()}
    assert set(out) == set(range(1, 10))
    assert (out[1]["neighbours"], out[1]["distances"]) == ([2, 3], [0.0, 5.0]) and out[3]["neighbours"] == [1, 2]
    assert all(out[i]["neighbours"] == [] for i in (4, 5, 6, 7, 8, 9))
    assert neighbours.neighbours(df.where("false")).count() == 0
    assert neighbours.neighbours(df.where("vec_id = 4")).first()["neighbours"] == []
    assert neighbours.neighbours(df.where("vec_id = 1")).first()["neighbours"] == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "vec_id long, embedding array<float>")
    assert {tuple(r["distances"]) for r in neighbours.neighbours(same, k=3).collect()} == {(0.0, 0.0, 0.0)}


def test_scan_without_pruning_is_exact():
    rng = np.random.default_rng(3)
    base, q = rng.normal(size=(700, 40)).astype(np.float32), rng.normal(size=(50, 40)).astype(np.float32)
    args = (q, np.full(50, -5), [np.arange(50)] * 3, base, np.arange(700), np.array([0, 200, 500, 700]), 7)
    want = np.sort(np.sqrt(((q[:, None] - base) ** 2).sum(2)), axis=1)[:, :7]
    exact, _ = neighbours.scan(*args, epsilon=1e6, tile=64)
    assert np.allclose(np.sqrt(exact), want, atol=1e-3)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0].astype(np.float32)
    fast, _ = neighbours.scan(q @ turn, *args[1:3], base @ turn, *args[4:], tile=64)
    assert (np.sqrt(fast) <= want[:, -1:] + 1e-3).mean() > 0.95


def least_of_groups(rows, pairs):
    """Ids that stay: of rows (id -> text), the least of each set of texts that ``pairs`` of texts join."""
    parent = {}

    def find(t):
        while parent.setdefault(t, t) != t:
            t = parent[t]
        return t

    for a, b in pairs:
        parent[find(a)] = find(b)
    first = {}
    for i in sorted(rows):
        first.setdefault(find(rows[i]), i)
    return set(first.values())


def plain_mix_of(rows, weights=mixing.WEIGHTS, share=mixing.SHARE):
    """Ids that the mix keeps, by sorting each source."""
    import hashlib

    size = {i: len(r["text"].split()) for i, r in rows.items()}
    sources = {r["source"] for r in rows.values()}
    total, kept = sum(size.values()), set()
    for s in sources:
        budget, upto = total * share[0] * weights.get(s, 1) // (share[1] * sum(weights.get(x, 1) for x in sources)), 0
        for i in sorted((i for i in rows if rows[i]["source"] == s), key=lambda i: hashlib.md5(f"1:{i}".encode()).hexdigest()[:15]):
            upto += size[i]
            if upto > budget:
                break
            kept.add(i)
    return kept


def verified_pairs(rows, threshold=0.6):
    """Pairs of texts that are similar by the definition, all compared."""
    from tests.llm.test_dedup import brute_fast, grams

    texts = sorted({r["text"] for r in rows.values()})
    sets = {t: grams(t) for t in texts}
    return [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if sets[a].keys() & sets[b].keys() and brute_fast(sets[a], sets[b]) >= threshold]


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as cp
    from palimpsest.llm import near_dedup, quality

    assert [n for n, _ in cp.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "pack"] and cp.ORACLE_SQL is None
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    said = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept, columns = docs, docs.columns
    for name, stage in cp.STAGES[:4]:
        before = {r["doc_id"]: r for r in kept.collect()}
        now = stage(spark, kept, DATA).cache()
        after = {r["doc_id"]: r for r in now.collect()}
        assert now.columns == columns and all(after[d] == before[d] for d in after)
        if name == "quality":
            # the features and the machine are held against plain Python and the sum over pairs elsewhere
            assert set(after) == {r["doc_id"] for r in quality.classify(kept, labels).where("keep").collect()}
            bad = {d for d in before if said.get(d) == 0}
            assert len(bad - set(after)) >= 0.8 * len(bad) and not [d for d in set(before) - set(after) if said.get(d) == 1]
        elif name == "exact_dedup":
            assert set(after) == least_of_groups({d: r["text"] for d, r in before.items()}, [])
        elif name == "near_dedup":
            texts = kept.select(F.xxhash64("text").alias("h"), "text").dropDuplicates(["h"]).cache()
            text_of = {r["h"]: r["text"] for r in texts.collect()}
            found = [(text_of[r["a"]], text_of[r["b"]]) for r in near_dedup.near_pairs(texts).collect()]
            every = verified_pairs(before)
            assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in every}
            plain = {d: r["text"] for d, r in before.items()}
            assert set(after) == least_of_groups(plain, found)
            # what hashing misses of all pairs is next to nothing
            assert len(set(after) ^ least_of_groups(plain, every)) <= 0.02 * len(before)
        else:
            assert set(after) == plain_mix_of(before)
        kept = now
    parts = covered(cp.STAGES[4][1](spark, kept, DATA).collect())
    assert {d: sum(n for _, n in p) for d, p in parts.items()} == {r["doc_id"]: len(r["text"].split()) for r in kept.collect()}
    last = cp.run(spark, DATA).collect()
    assert covered(last) == parts
    import os

    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    left = [sorted(os.listdir(f"{folder}/{f}")) for f in os.listdir(folder) if f.startswith("pipeline-")]
    assert left and all(names == ["4-pack"] for names in left)  # what later stages don't read is removed


def test_pipeline_stages_messy(spark, messy):
    """Null ids, null and long texts, ties, repeated rows, extra columns with clashing names; then nothing at all."""
    import corpus_pipeline as cp

    for docs in (messy, messy.where("false")):
        rows = docs.count()
        for _, stage in cp.STAGES[:4]:
            out = stage(spark, docs, DATA).cache()
            assert out.columns == messy.columns and out.count() <= rows
            docs, rows = out, out.count()
        assert (cp.STAGES[4][1](spark, docs, DATA).count() > 0) == (docs.where("text rlike '[^ \\n\\t]'").count() > 0)
