import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import ed25519
from palimpsest.functions.digest import DIGESTS, blake3_finish, blake3_heads, blake3_many, blake3_resume, blake3_states, digest_udf, labelled
from palimpsest.functions.records import CHECKPOINT, canonical, parse, uuid7, violations, write_record
from palimpsest.operators import chain

SEED = bytes(range(32))
KEY = ed25519.public_key(SEED)
ONE = lambda x: DIGESTS["blake3"]([x])[0]


def ledger(spark, n=5, digest="blake3"):
    batch = spark.createDataFrame([(i, f"rec-{i}", "write", "t", canonical(write_record(f"text {i}", {"source_type": "user_input", "source_id": "s"}, created_at="2026-01-01T00:00:00Z", record_id=f"rec-{i}")), "2026-01-01T00:00:00+00:00") for i in range(n)], "order long, record_id string, kind string, namespace string, payload_json string, created_at string")
    return chain.append(batch, SEED, digest=digest)


def test_blake3_vectors():
    data = lambda n: bytes(i % 251 for i in range(n))
    assert blake3_many([b""])[0].hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    known = {1: "2d3adedff11b61f1", 1024: "42214739f095a406", 1025: "d00278ae47eb27b3", 2048: "e776b6028c7cd22a", 2049: "5f4d72f40d7a5f82", 3073: "7124b49501012f81", 31744: "62b6960e1a44bcc1"}
    assert {n: d.hex()[:16] for n, d in zip(known, blake3_many([data(n) for n in known]))} == known
    assert labelled("blake3", [b"The capital of France is Paris."]) == ["blake3:b47501560477d97bfbaab27a3d82f39fa46f96d74a621440d990b01cc201a582"]


def test_blake3_in_parts():
    data = lambda n: bytes(i % 251 for i in range(n))
    sizes = [0, 1, 64, 65, 1023, 1024, 1025, 2048, 3073, 5000]
    whole = blake3_many([data(n) for n in sizes])
    assert [blake3_finish([], data(n)) for n in sizes] == whole == [blake3_many([data(n)])[0] for n in sizes]
    heads = blake3_heads([data(n) for n in sizes])
    for n, h in zip(sizes, heads):
        tail = data(n)[1024 * len(h) :] + b"more"
        assert blake3_finish(h, tail) == blake3_many([data(n) + b"more"])[0]


def test_digest_column_keeps_nulls(spark):
    got = [r[0] for r in spark.createDataFrame([("",), (None,)], "x string").select(digest_udf()(F.col("x"))).collect()]
    assert got == ["blake3:af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", None]


def test_ed25519_vector_and_refusals():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert ed25519.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    s = ed25519.sign(seed, b"")
    assert s.startswith("ed25519:e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    key = ed25519.public_key(seed)
    assert ed25519.verify(key, b"", s)
    for bad in (None, "", s[8:], "ed25519:zz", s[:-2], s[:-1] + ("0" if s[-1] != "0" else "1")):
        assert not ed25519.verify(key, b"", bad)
    assert not ed25519.verify(key, b"x", s)


def test_ids_sort():
    ids = [uuid7() for _ in range(10_000)]
    assert ids == sorted(ids) and len(set(ids)) == len(ids)
    assert ids[0][14] == "7" and ids[0][19] in "89ab"


def test_canonical_form():
    r = write_record("The capital of France is Paris.", {"source_id": "s1", "source_type": "document_ingest", "metadata": {"b": 2, "a": 1}}, created_at="2026-01-15T12:00:00Z", record_id="r1")
    text = canonical(r | {"entry_hash": "x", "source": r["source"] | {"signature": "y"}})
    assert json.loads(text) == r and '"metadata":{"a":1,"b":2}' in text and text == canonical(json.loads(text))
    assert r["content_hash"].startswith("blake3:b4750156")


def test_canonical_bytes_are_pinned():
    """Digest of the bytes that other implementations write for this record."""
    seen = "2026-01-15T12:00:00Z"
    source = {"metadata": {"b": 2, "a": 1}, "source_id": "src-fixed-001", "locator": "file:///poison.md", "source_type": "document_ingest", "trust_score": 0.2, "first_seen": seen}
    text = "The capital of France is Paris."
    r = write_record(text, source, namespace="demo", created_at=seen, record_id="rec-fixed-001", derived_from=["rec-000"], memory_id="mem-1")
    for spelling in (r, dict(reversed(list(r.items()))), r | {"signature": "x", "merkle_leaf": "y"}):
        assert hashlib.sha256(canonical(spelling).encode()).hexdigest() == "4a9fd618eb43ac579db6ba6c0cbf4bfb426b25e15127f8fdab028fb313446c05"


@given(st.dictionaries(st.text(max_size=5), st.one_of(st.integers(), st.text(max_size=5), st.none()), max_size=6))
def test_key_order_does_not_matter(d):
    assert canonical(d) == canonical(dict(reversed(list(d.items()))))


@pytest.mark.parametrize("bad", [{"trust_score": 1.5}, {"source_type": "moon"}, {"trust_level": "some"}])
def test_bad_sources_are_refused(bad):
    with pytest.raises(ValueError):
        write_record("x", {"source_type": "user_input"} | bad, created_at="2026-01-01T00:00:00Z")


def test_size_limit_includes_its_boundary():
    ok = {"source_type": "user_input"}
    write_record("é" * 5, ok, created_at="", max_content=10)
    with pytest.raises(ValueError):
        write_record("é" * 5 + "x", ok, created_at="", max_content=10)
    with pytest.raises(ValueError):
        write_record("x", ok, created_at="", content_hash="blake3:00")
    with pytest.raises(ValueError):
        write_record("x", ok, created_at="", colour="red")


def test_parse_and_invariants(spark):
    p = parse(ledger(spark, 3))
    assert [r["content"] for r in p.orderBy("seq").collect()] == ["text 0", "text 1", "text 2"]
    assert violations(p).count() == 0
    bad = p.unionByName(p.limit(1)).withColumn("trust_score", F.lit(2.0)).withColumn("content", F.lit("other"))
    assert {r["rule"] for r in violations(bad).collect()} == {"trust_score", "content_hash", "record_id"}


@pytest.mark.parametrize("digest", ["blake3", "sha256"])
def test_untouched_chain(spark, digest):
    r = chain.verify_chain(ledger(spark, 9, digest), KEY, digest).first()
    assert r["ok"] and r["rows_checked"] == 9


def test_appending_goes_on_from_the_last_row(spark):
    first = ledger(spark, 3)
    last = first.orderBy(F.desc("seq")).first()
    batch = spark.createDataFrame([(0, "more", "write", "t", "{}", "2026-01-01T00:00:00+00:00")], "order long, record_id string, kind string, namespace string, payload_json string, created_at string")
    both = first.unionByName(chain.append(batch, SEED, after=(last["seq"], last["entry_hash"])))
    assert chain.verify_chain(both, KEY).first()["rows_checked"] == 4


def test_tampering(spark):
    l = ledger(spark, 5)
    edited = l.withColumn("payload_json", F.when(F.col("seq") == 2, F.lit("{}")).otherwise(F.col("payload_json")))
    r = chain.verify_chain(edited, KEY).first()
    assert (r["ok"], r["seq"], r["kind"], r["rows_checked"]) == (False, 2, "edit", 1)
    r = chain.verify_chain(l.where("seq <> 3"), KEY).first()
    assert (r["seq"], r["kind"], r["rows_checked"]) == (4, "gap", 2)
    r = chain.verify_chain(l.where("seq <> 1"), KEY).first()
    assert (r["seq"], r["kind"]) == (2, "gap")
    r = chain.verify_chain(l, ed25519.public_key(bytes(32))).first()
    assert (r["seq"], r["kind"], r["rows_checked"]) == (1, "forgery", 0)
    assert chain.verify_chain(l.where("false"), KEY).first()["ok"]


def test_merkle_checkpoint(spark):
    l = ledger(spark, 5)
    none = spark.createDataFrame([], CHECKPOINT)
    assert not chain.verify_merkle(l, none, KEY).first()["ok"]
    assert chain.verify_merkle(l.where("false"), none, KEY).first()["ok"]
    cp = chain.checkpoint(l, SEED, 1, "2026-01-01T00:00:00+00:00")
    assert chain.verify_merkle(l, cp, KEY).first()["detail"] == "ok"
    assert "4 rows" in chain.verify_merkle(l.where("seq < 5"), cp, KEY).first()["detail"]
    forged = l.withColumn("entry_hash", F.when(F.col("seq") == 2, F.lit("blake3:00")).otherwise(F.col("entry_hash")))
    assert "recomputed root" in chain.verify_merkle(forged, cp, KEY).first()["detail"]
    assert "signature" in chain.verify_merkle(l, cp, ed25519.public_key(bytes(32))).first()["detail"]
    assert chain.verify(l, cp, KEY).first()["ok"]
    r = chain.verify(l.where("seq <> 3"), cp, KEY).first()
    assert not r["ok"] and "chain diverges" in r["summary"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 9, 16, 17, 33])
def test_blocks_give_the_root_of_one_tree(spark, n):
    rows = spark.createDataFrame([(i, f"leaf-{i}") for i in range(n)], "seq long, entry_hash string")
    root, total = chain.merkle_root(rows, block=4)
    assert total == n and root == chain.compute_root([f"leaf-{i}".encode() for i in range(n)])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 16, 17])
def test_proofs(n):
    leaves = [f"leaf-{i}".encode() for i in range(n)]
    root = chain.compute_root(leaves)
    for i in range(n):
        proof = chain.inclusion_proof(leaves, i)
        assert chain.verify_proof(leaves[i], proof, root) and not chain.verify_proof(b"other", proof, root)
    with pytest.raises(IndexError):
        chain.inclusion_proof(leaves, n)


def test_checkpoint_cadence():
    assert [n for n in range(2000) if chain.due(n, n + 1, 500)] == [499, 999, 1499, 1999]
    assert not chain.due(0, 10, 0)
    assert set(DIGESTS) == {"blake3", "sha256"}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 6, 7, 12, 33])
def test_peaks_give_the_root_of_one_tree(n):
    leaves, peaks = [f"leaf-{i}".encode() for i in range(n)], []
    for x in leaves:
        chain.push(peaks, 1, ONE(chain.leaf(x)), ONE)
    assert chain.peaks_root(peaks, ONE) == chain.compute_root(leaves) and len(peaks) == bin(n).count("1")


@pytest.mark.parametrize("first,last", [(1, 3), (1, 16), (3, 21), (4, 4), (5, 8)])
def test_new_rows_go_on_with_a_tree(spark, first, last):
    leaves, peaks = [f"leaf-{i}".encode() for i in range(1, last + 1)], []
    for x in leaves[: first - 1]:
        chain.push(peaks, 1, ONE(chain.leaf(x)), ONE)
    rows = spark.createDataFrame([(i, f"leaf-{i}") for i in range(first, last + 1)], "seq long, entry_hash string").repartition(3)
    for size, node in chain.new_nodes(rows, block=4):
        chain.push(peaks, size, node, ONE)
    assert chain.peaks_root(peaks, ONE) == chain.compute_root(leaves)


def test_tampering_is_found_in_any_storage_order(spark):
    rows = ledger(spark, 40).cache()
    for parts in (1, 7):
        mixed = rows.orderBy(F.xxhash64("seq")).repartition(parts)
        assert chain.verify_chain(mixed, KEY).first()["rows_checked"] == 40
        swapped = mixed.withColumn("prev_hash", F.when(F.col("seq") == 23, F.lit("blake3:00")).otherwise(F.col("prev_hash")))
        signed = mixed.withColumn("signature", F.when(F.col("seq").isin(9, 31), F.lit("ed25519:00")).otherwise(F.col("signature")))
        got = [chain.verify_chain(x, KEY).first() for x in (swapped, signed, mixed.where("seq not in (12, 30)"), mixed.unionByName(mixed.where("seq = 20")))]
        assert [(r["seq"], r["kind"], r["rows_checked"]) for r in got] == [(23, "edit", 22), (9, "forgery", 8), (13, "gap", 11), (20, "gap", 20)]


def test_payloads_are_not_shuffled_to_be_verified(spark, tmp_path):
    ledger(spark, 12).repartition(16).write.parquet(str(tmp_path / "l"))
    stored = spark.read.parquet(str(tmp_path / "l"))
    seen = []
    real = type(stored).repartitionByRange
    try:
        type(stored).repartitionByRange = lambda self, *a: seen.append(self.columns) or real(self, *a)
        assert chain.verify_chain(stored, KEY).first()["ok"]
    finally:
        type(stored).repartitionByRange = real
    assert seen and all("payload_json" not in c for c in seen)


def test_blake3_goes_on_from_whole_blocks():
    data = lambda n: bytes(i % 251 for i in range(n))
    sizes = [0, 1, 63, 64, 65, 960, 1000, 1023, 1024, 1025, 1087, 2048, 3073, 4096, 7168, 20000]
    for tail in (1, 71, 1100, 2500):
        got = [blake3_resume(state, n, data(n)[n // 64 * 64 :] + b"x" * tail) for n, state in zip(sizes, blake3_states([data(n) for n in sizes]))]
        assert got == blake3_many([data(n) + b"x" * tail for n in sizes])


@pytest.mark.parametrize("digest", ["blake3", "sha256"])
def test_a_chain_is_linked_in_pieces(spark, digest):
    """Orders that occur twice keep all their rows; no task links more than a piece."""
    texts = ["x" * (97 * i % 1500) + f"é{i}" for i in range(60)]
    batch = spark.createDataFrame([(i // 2, f"rec-{i}", "write", "t", x, "2026-01-01T00:00:00+00:00") for i, x in enumerate(texts)], "order long, record_id string, kind string, namespace string, payload_json string, created_at string").repartition(5)
    got = chain.append(batch, SEED, after=(7, "x:00"), digest=digest, piece=9000)
    assert len(got.inputFiles()) > 3
    rows = sorted(got.collect(), key=lambda r: r["seq"])
    assert [r["seq"] for r in rows] == list(range(8, 68)) and sorted(r["payload_json"] for r in rows) == sorted(texts)
    assert [int(r["record_id"][4:]) // 2 for r in rows] == [i // 2 for i in range(60)]
    at = 7, "x:00"
    for r in rows:
        want = chain.linked([r.asDict()], SEED, at, digest)[0]
        assert tuple(r) == want
        at = r["seq"], r["entry_hash"]
