import random

import pytest

from palimpsest.operators import graph
from palimpsest.plans import forensics as fx

EDGE = "src string, dst string, edge_type string"


def edges(spark, *pairs):
    return spark.createDataFrame([(p[0], p[1], p[2] if len(p) > 2 else "DERIVED_FROM") for p in pairs], EDGE)


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def found(df):
    return {r["node"] for r in df.collect()}


def test_diamond(spark):
    e = edges(spark, "ac", "bc", "cd", "ab", "bd")
    assert found(graph.reach(e, nodes(spark, "d"), forward=False)) == {"a", "b", "c"}
    assert found(graph.reach(e, nodes(spark, "a"))) == {"a", "b", "c", "d"}


def test_depth_and_types(spark):
    e = edges(spark, "ab", "bc", "cd")
    assert found(graph.reach(e, nodes(spark, "d"), forward=False, max_depth=1)) == {"c"}
    assert found(graph.reach(e, nodes(spark, "d"), forward=False, max_depth=2)) == {"b", "c"}
    t = edges(spark, ("a", "b", "DERIVED_FROM"), ("x", "b", "CONTEXTUALIZED"))
    assert found(graph.reach(t, nodes(spark, "b"), forward=False, types=("DERIVED_FROM",))) == {"a"}
    assert found(graph.reach(t, nodes(spark, "b"), forward=False, types=("CONTEXTUALIZED",))) == {"x"}


def test_cycle_ends_and_start_is_left_out_backwards(spark):
    e = edges(spark, "ab", "bc", "ca")
    assert found(graph.reach(e, nodes(spark, "a"))) == {"a", "b", "c"}
    assert found(graph.reach(e, nodes(spark, "a"), forward=False)) == {"b", "c"}


def test_seed_without_edges(spark):
    e = edges(spark, "ab")
    assert found(graph.reach(e, nodes(spark, "z"))) == {"z"}
    assert found(graph.reach(e, nodes(spark, "z"), forward=False)) == set()


def test_random_graphs_against_plain_search(spark):
    rng = random.Random(4)
    pairs = [(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(60)]
    e = edges(spark, *pairs)
    starts = [str(i) for i in range(0, 40, 7)]
    rows = graph.reach(e, spark.createDataFrame([(s, s) for s in starts], "root string, node string")).collect()
    for s in starts:
        seen, stack = {s}, [s]
        while stack:
            x = stack.pop()
            for a, b in pairs:
                if a == x and b not in seen:
                    seen.add(b)
                    stack.append(b)
        assert {r["node"] for r in rows if r["root"] == s} == seen


LEDGER = "seq long, record_id string, kind string, namespace string, source_id string, source_type string, locator string, trust_level string, memory_id string, content string, query string, summary string, reason string, created_at string, derived_from array<string>, caused_by_retrieval array<string>, returned array<string>, context_retrievals array<string>, affected array<string>"


def incident(spark):
    row = lambda seq, rid, kind, **k: (seq, rid, kind, k.get("ns", "t"), k.get("src"), k.get("type"), None, k.get("trust"), k.get("mem"), k.get("content"), k.get("query"), k.get("summary"), k.get("reason"), f"2026-01-01T00:00:0{seq}Z", k.get("derived", []), [], k.get("returned", []), k.get("ctx", []), k.get("affected", []))
    rows = [
        row(1, "poison", "write", src="evil-doc", type="document_ingest", trust="untrusted", content="The capital of France is Berlin", mem="kept-1"),
        row(2, "derived", "write", src="user", type="user_input", trust="trusted", content="Noted: France, Berlin", derived=["poison", "ghost"]),
        row(3, "read", "retrieval", query="capital?", returned=["derived"]),
        row(4, "act", "action", summary="answered Berlin", ctx=["read"]),
    ]
    return spark.createDataFrame(rows, LEDGER)


def test_incident(spark):
    ledger = incident(spark)
    e = graph.derive_edges(ledger)
    assert {(r["src"], r["dst"]) for r in e.collect()} == {("poison", "derived"), ("derived", "read"), ("read", "act")}
    assert [r["src"] for r in graph.dangling_edges(ledger).collect()] == ["ghost"]
    roots = fx.trace(ledger, e, nodes(spark, "act")).orderBy("rank").collect()
    assert [(r["record_id"], r["centrality"]) for r in roots] == [("poison", 3), ("derived", 2)]
    assert found(fx.blast_radius(ledger, e, "evil-doc")) == {"poison", "derived", "read", "act"}
    assert found(fx.blast_radius(ledger, e, "ghost")) == set()
    assert found(fx.rollback_plan(ledger, e, "evil-doc", scope="t")) == {"poison", "derived", "read", "act"}
    assert found(fx.rollback_plan(ledger, e, "evil-doc", scope="other")) == set()
    assert [r["record_id"] for r in fx.timeline(ledger, "France").orderBy("timestamp", "seq").collect()] == ["poison", "derived"]
    assert fx.trace(ledger, e, nodes(spark, "nobody")).count() == 0
    states = {r["node"]: r["state"] for r in fx.effective_state(ledger, nodes(spark, "poison", "nobody")).collect()}
    assert states == {"poison": "active", "nobody": "expired"}


def test_unknown_ends_are_an_error(spark):
    ledger = incident(spark)
    with pytest.raises(graph.UnknownNode):
        graph.add_edges(graph.derive_edges(ledger), edges(spark, ("poison", "ghost", "INFLUENCED")), ledger)
    twice = edges(spark, ("act", "poison", "INFLUENCED"), ("act", "poison", "INFLUENCED"))
    assert graph.add_edges(graph.derive_edges(ledger), twice, ledger).count() == 4


def test_reconcile_keeps_duplicates(spark):
    ids = spark.createDataFrame([(0, "kept-1"), (1, "orphan-99"), (2, "orphan-99")], "line long, memory_id string")
    assert [r["memory_id"] for r in fx.reconcile(incident(spark), ids).orderBy("line").collect()] == ["orphan-99", "orphan-99"]
