import json

import pytest

from palimpsest.capture import Recorder, Sidecar, files_changed, payloads
from palimpsest.functions.records import violations
from palimpsest.profile import Profile
from palimpsest.sources import calls

AGENT = {"source_type": "agent_self", "source_id": "agent", "trust_level": "semi_trusted", "locator": "agent://1"}


class Memory:
    def __init__(self):
        self.kept = {}

    def add(self, text, **_):
        if text == "refused":
            raise ValueError(text)
        self.kept[f"m{len(self.kept)}"] = text
        return {"results": [{"id": list(self.kept)[-1]}]}

    def search(self, query):
        return {"results": [{"id": i, "score": 1.0} for i, t in self.kept.items() if query in t]}

    def count(self):
        return len(self.kept)


def test_a_wrapped_client_is_recorded(spark, tmp_path):
    p = Profile.create(spark, str(tmp_path / "p"), every=0)
    memory = Memory()
    r = Recorder(p, calls.MEM0, AGENT, batch=100)
    w = r.wrap(memory)
    result = w.add("the river rose")
    assert result == {"results": [{"id": "m0"}]} and w.count() == 1
    with pytest.raises(ValueError):
        w.add("refused")
    assert w.search("river")["results"][0]["id"] == "m0"
    assert r.flush() == 2 and r.flush() == 0
    rows = p.records().orderBy("seq").collect()
    assert [(x["kind"], x["content"], x["memory_id"], x["query"], x["returned"], x["scores"]) for x in rows] == [("write", "the river rose", "m0", None, None, None), ("retrieval", None, None, "river", ["m0"], [1.0])]
    assert rows[0]["source_id"] == "agent" and p.verify().first()["chain_ok"] and violations(p.records()).count() == 0


def test_batches_are_flushed_by_themselves(spark, tmp_path):
    p = Profile.create(spark, str(tmp_path / "p"), every=0)
    r = Recorder(p, calls.MEM0, AGENT, batch=3)
    w = r.wrap(Memory())
    for i in range(7):
        w.add(f"note {i}")
    assert p.rows().count() == 6 and r.flush() == 1
    assert [x["content"] for x in p.records().orderBy("seq").collect()] == [f"note {i}" for i in range(7)]


def test_gateway_and_sidecar_live(spark, tmp_path):
    p = Profile.create(spark, str(tmp_path / "p"), every=0)
    tool = calls.WriteMap(lambda: calls._get("kwargs", "$.text"), lambda: calls._get("result", "$.id"))
    r = Recorder(p, calls.gateway({"remember": tool}, {}), AGENT)
    answer = {"id": "1"}
    assert r.call_tool(lambda t, a: answer, "remember", {"text": "t"}) is answer and r.call_tool(lambda t, a: 5, "weather", {}) == 5
    assert r.flush() == 1
    sent = []

    def store(op, payload):
        sent.append((op, payload))
        if payload.get("text") == "down":
            raise OSError("down")
        return {"matches": [{"id": "x"}]}

    s = Sidecar(p, store, AGENT, content=lambda x: x["text"], query=lambda x: x["q"], returned=lambda x: [m["id"] for m in x["matches"]])
    s.handle("upsert", {"text": "kept"})
    s.handle("query", {"q": "kept?"})
    s.handle("stats", {})
    with pytest.raises(OSError):
        s.handle("upsert", {"text": "down"})  # recorded all the same, as it is before it is forwarded
    rows = p.records().orderBy("seq").collect()
    assert [(x["kind"], x["content"] or x["query"]) for x in rows] == [("write", "t"), ("write", "kept"), ("retrieval", "kept?"), ("write", "down")]
    assert sent[0][1] == {"text": "kept", calls.TAG: rows[1]["record_id"]} and rows[1]["memory_id"] is None and sent[2] == ("stats", {})


def test_watched_files_reach_the_ledger(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "MEMORY.md").write_text("one")
    p = Profile.create(spark, str(tmp_path / "p"), every=0)
    n, snap = files_changed(p, str(tmp_path / "w"))
    assert n == 1
    snap = spark.createDataFrame(snap.collect(), snap.schema)
    assert files_changed(p, str(tmp_path / "w"), snap)[0] == 0
    row = p.records().first()
    assert (row["content"], row["source_type"]) == ("one", "file_read") and row["locator"].endswith("MEMORY.md") and row["locator"] == row["memory_id"] == row["source_id"]
    assert json.loads(p.rows().first()["payload_json"])["memory_type"] == "procedural"


def test_payloads_keep_invariants(spark):
    bad = spark.createDataFrame([(1, "write", "x" * 20, None)], "call_id long, kind string, content string, memory_id string")
    with pytest.raises(Exception, match="larger than the limit"):
        payloads(bad, AGENT, max_content=10).collect()
