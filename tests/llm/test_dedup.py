import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import textkit as tk
from palimpsest.llm.bloom import RepeatFilter
from palimpsest.llm.components import components
from palimpsest.llm.exact_dedup import exact_dedup
from palimpsest.llm.near_dedup import band_hashes, near_dedup, near_pairs, registers, shingles, similarity, unlike_pairs
from tests.conftest import DATA
from tests.llm.conftest import make


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


def plain(*xs):
    return [(x is None, x or 0) for x in sorted(xs, key=lambda v: (v is None, v or 0))]


def test_exact_messy(spark, messy):
    out = exact_dedup(messy)
    assert out.columns == messy.columns and out.schema == messy.schema
    # 1 stays of its four copies, 4 of the empty ones, both null texts stay
    assert ids(out) == plain(1, 3, None, 4, 6, 7, 8, 9, 10, 11)


def test_exact_empty(spark, messy):
    assert exact_dedup(messy.where("false")).count() == 0


def test_exact_with_a_full_filter_is_still_exact(spark):
    rng = random.Random(1)
    rows = [(i, f"t{rng.randrange(400)}") for i in range(1000)]
    small = exact_dedup(make(spark, rows), max_filter_bytes=8)
    want = {}
    for i, t in rows:
        want.setdefault(t, i)
    assert ids(small) == plain(*want.values())


def clash(spark):
    """Documents with columns that operators might use themselves."""
    rows = [(1, "a b c d", "en", "x"), (2, "a b c d", "en", "x"), (3, "e f g h", "en", "y"), (4, None, None, None)]
    names = ["h", "flag", "text", "row", "u", "s", "t", "b", "limit", "score", "picked", "new", "r", "block", "H", "a", "c"]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *[f"{i} as `__plm_{n}`" for i, n in enumerate(dict.fromkeys(x.lower() for x in names))], "'x' as h", "1 as root", "2 as node", "3 as band")


def test_columns_with_hidden_names_are_kept(spark):
    from palimpsest.llm import langid, mixing, packing, pseudonyms, quality, sharding

    docs = clash(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    for out in (exact_dedup(docs), near_dedup(docs), mixing.mix_sources(docs, share=(1, 1)), quality.quality_filter(docs, labels)):
        assert out.columns == docs.columns and out.count() >= 0
    assert ids(exact_dedup(docs)) == ids(near_dedup(docs)) == plain(1, 3, 4)
    for out in (packing.pack(docs), pseudonyms.pseudonymise(docs), langid.identify(docs), sharding.shard(docs, shards=2)):
        assert out.count() > 0


def test_smaller_filters_take_fewer_probes_and_lose_nothing(spark):
    rows = list(range(30_000)) + list(range(10_000))
    df = spark.createDataFrame([(x * 0x9E3779B97F4A7C15 % 2**64 - 2**63,) for x in rows], "h long").repartition(4)
    repeated = {h for h, n in Counter(r["h"] for r in df.collect()).items() if n > 1}
    through = []
    for limit, probes in ((1 << 20, 4), (4100, 2), (1300, 1), (64, 1)):
        f = RepeatFilter(df, len(rows), segment_rows=1 << 12, max_bytes=limit)
        hit = {r["h"] for r in df.where(f.hit(F.col("h"))).collect()}
        assert repeated <= hit and f.probes == probes and f.bytes <= max(limit, 8 * 16) + 8
        through.append((len(hit) - len(repeated)) / 20_000)
    assert through[0] < 0.01 and through[1] < 0.45 and through[2] < 0.75


def test_filter_finds_all_repeats_and_few_others(spark):
    rows = list(range(20_000)) + list(range(0, 20_000, 50))
    df = spark.createDataFrame([(x * 0x9E3779B97F4A7C15 % 2**64 - 2**63,) for x in rows], "h long").repartition(8)
    f = RepeatFilter(df, len(rows), segment_rows=1024)
    hit = {r["h"] for r in df.where(f.hit(F.col("h"))).collect()}
    repeated = {h for h, n in Counter(r["h"] for r in df.collect()).items() if n > 1}
    assert repeated <= hit and len(hit) < len(repeated) + 300


def test_components_against_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_words_match_plain_python():
    texts = ["Hello, World! hello", "", "a", "ÉTÉ été", "x" * 5000, "  ", "end of.one\nstart"]
    raw, off, _ = tk.text_buffers(pa.array(texts))
    h, doc, s, e = tk.words(tk.normalise(raw), off)
    low = tk.normalise(raw)
    got = [(int(d), bytes(low[a:b]).decode()) for d, a, b in zip(doc, s, e)]
    assert got == [(0, "hello"), (0, "world"), (0, "hello"), (2, "a"), (3, "été"), (3, "été"), (4, "x" * 5000), (6, "end"), (6, "of"), (6, "one"), (6, "start")]
    assert h[0] == h[2] and h[4] == h[5] and len(set(h.tolist())) == 9
    sliced = pa.array(["zz", *texts]).slice(1)
    assert tk.words(tk.normalise(tk.text_buffers(sliced)[0]), tk.text_buffers(sliced)[1])[0].tolist() == h.tolist()
    assert tk.count_tokens(pa.array([" a  b\tc", None, "", "x", "\n"])).tolist() == [3, 0, 0, 1, 0]


def brute(a, b):
    """Probability Jaccard by its definition."""
    out = 0.0
    for d in a.keys() & b.keys():
        out += 1 / sum(max(a.get(x, 0) / a[d], b.get(x, 0) / b[d]) for x in a.keys() | b.keys())
    return out


def grams(text, n=2):
    low = tk.normalise(np.frombuffer(text.encode(), np.uint8)).tobytes()
    w = low.replace(b"\0", b" ").split()
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def test_similarity_is_exact_and_signatures_estimate_it():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(120)]
        other = [rng.choice(words) if rng.random() < 0.15 else x for x in base]
        ta, tb = " ".join(base), " ".join(other)
        raw, off, _ = tk.text_buffers(pa.array([ta, tb]))
        doc, key, count = shingles(raw, off)
        a, b = doc == 0, doc == 1
        s = similarity(key[a], count[a], key[b], count[b])
        assert s == pytest.approx(brute(grams(ta), grams(tb)))
        win = registers(doc, key, count.astype(float), 2, 2000)
        assert abs((win[0] == win[1]).mean() - s) < 0.06


def test_bands_of_equal_sets_agree():
    raw, off, _ = tk.text_buffers(pa.array(["a b c d", "A, b. C d!", "p q r s"]))
    doc, key, count = shingles(raw, off)
    h = band_hashes(registers(doc, key, count.astype(float), 3, 20), 5)
    assert (h[0] == h[1]).all() and not (h[0] == h[2]).any()


def test_near_messy(spark, messy):
    out = near_dedup(messy)
    assert out.columns == messy.columns
    # the two very long texts are near copies; null texts stay; blank texts equal only their like
    assert ids(out) == plain(1, 3, None, 4, 6, 7, 9, 10, 11)
    assert near_dedup(messy.where("false")).count() == 0


def test_near_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    sets = {r["doc_id"]: grams(r["text"]) for r in rows}
    first = {}
    for r in rows:
        first.setdefault(r["text"], r["doc_id"])
    keys = sorted(first.values())
    pairs = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a].keys() & sets[b].keys() and brute_fast(sets[a], sets[b]) >= 0.6:
                pairs.add((a, b))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = docs.select(F.xxhash64("text").alias("h"), "text").dropDuplicates(["h"])
    name = {r["h"]: r["d"] for r in docs.select(F.xxhash64("text").alias("h"), F.col("doc_id").alias("d")).orderBy(F.desc("d")).collect()}
    found = {tuple(sorted((name[r["a"]], name[r["b"]]))) for r in near_pairs(texts).collect()}
    assert found <= pairs  # verified on whole texts
    groups = lambda ps: sorted({frozenset(g) for g in merge(ps)}, key=sorted)
    want, got = groups(pairs), groups(found)
    together = sum(any(w <= g for g in got) for w in want)
    assert together >= 0.9 * len(want)
    assert near_dedup(docs).count() <= len(keys)


def brute_fast(a, b):
    common = a.keys() & b.keys()
    if sum(min(a[x], b[x]) for x in common) < 0.3 * max(sum(a.values()), sum(b.values())):
        return 0.0
    return brute(a, b)


def merge(pairs):
    groups = []
    for a, b in pairs:
        hit = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in hit] + [set().union({a, b}, *hit)]
    return groups


@pytest.mark.parametrize("block", [2, 5, 64])
def test_unlike_texts_of_a_bucket_join_as_all_their_pairs_do(spark, block):
    """One bucket that holds everything, its least text like none: components of what is found are those of all pairs."""
    rng = random.Random(7)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    boiler, texts = words(40), ["least of all"]
    for size in (1, 1, 6, 9, 14):
        base = words(40)
        for _ in range(size):  # each is like some of its kind and not like others
            texts.append(" ".join(boiler + [w if rng.random() > 0.12 else words(1)[0] for w in base]))
    sets = [grams(t) for t in texts]
    every = [(i, j) for i in range(1, len(texts)) for j in range(i + 1, len(texts)) if brute(sets[i], sets[j]) >= 0.6]
    buckets = spark.createDataFrame([(5, i, 0) for i in range(1, len(texts))], "band long, h long, c long")
    table = spark.createDataFrame(list(enumerate(texts)), "h long, text string")
    for odd in (range(1, len(texts)), range(1, len(texts), 3)):  # all unlike the least text, and some of them
        want = [(i, j) for i, j in every if i in odd or j in odd]
        got = unlike_pairs(buckets, spark.createDataFrame([(0, i) for i in odd], "c long, h long"), table, 0.6, block=block).collect()
        pairs = [tuple(sorted((r["a"], r["b"]))) for r in got]
        assert set(pairs) <= set(want) and len(pairs) == len(set(pairs)) <= len(want)
        assert sorted(map(sorted, merge(pairs))) == sorted(map(sorted, merge(want)))
    assert len(every) > 60 and unlike_pairs(buckets, spark.createDataFrame([], "c long, h long"), table, 0.6).count() == 0


def test_unlike_texts_in_one_bucket_are_all_compared(spark):
    """Two pairs of copies that share a boilerplate: each pair is found whichever text is least."""
    rng = random.Random(5)
    make_text = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))
    boiler = " ".join(f"common{i}" for i in range(60))
    a, b = make_text(), make_text()
    rows = [(1, f"{boiler} {a}"), (2, f"{boiler} {b}"), (3, f"{boiler} {a} x"), (4, f"{boiler} {b} y")]
    assert ids(near_dedup(make(spark, rows), threshold=0.8, rows=1, bands=40)) == plain(1, 2)
