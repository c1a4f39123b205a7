"""Capture front ends and backend adapters: mappings from a log of calls to writes and retrievals.

A log has a row for each call: (call_id, method, args, kwargs, result, failed), the middle three as JSON text. A call
that failed leaves no record, and one whose method isn't mapped passes through.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.tables import read
from palimpsest.store import Files

TAG = "palimpsest_record_id"
Extract = Callable[[], Column]


def _get(column: str, path: str) -> Column:
    """A value at a path as text; objects and lists as JSON text."""
    return F.get_json_object(column, path)


def _is_list(x: Column) -> Column:
    return F.coalesce(x.startswith("["), F.lit(False))


def _strings(x: Column) -> Column:
    return F.from_json(x, "array<string>")


def _joined(x: Column) -> Column:
    """A text, or the items of a list a line each; of items that are objects their content."""
    one = lambda i: F.when(i.startswith("{"), F.coalesce(F.get_json_object(i, "$.content"), F.lit(""))).otherwise(i)
    return F.when(_is_list(x), F.array_join(F.transform(_strings(x), one), "\n")).otherwise(F.coalesce(x, F.lit("")))


@dataclass(frozen=True)
class WriteMap:
    content: Extract
    memory_id: Extract = lambda: F.lit(None).cast("string")


@dataclass(frozen=True)
class ReadMap:
    query: Extract
    returned: Extract
    scores: Extract = lambda: F.array().cast("array<double>")


@dataclass(frozen=True)
class Adapter:
    name: str
    writes: dict[str, WriteMap] = field(default_factory=dict)
    reads: dict[str, ReadMap] = field(default_factory=dict)


def mapped(log: DataFrame, adapter: Adapter) -> DataFrame:
    """(call_id, kind, content, memory_id, query, returned, scores) of the calls that are memory reads or writes."""
    text, ids, nums = F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<double>")
    out = {"kind": text, "content": text, "memory_id": text, "query": text, "returned": ids, "scores": nums}
    for method, m in adapter.writes.items():
        on = F.col("method") == method
        out |= {k: F.when(on, v).otherwise(out[k]) for k, v in (("kind", F.lit("write")), ("content", m.content()), ("memory_id", m.memory_id()))}
    for method, m in adapter.reads.items():
        on = F.col("method") == method
        out |= {k: F.when(on, v).otherwise(out[k]) for k, v in (("kind", F.lit("retrieval")), ("query", m.query()), ("returned", m.returned()), ("scores", m.scores()))}
    names = [*adapter.writes, *adapter.reads]
    return log.where(F.col("method").isin(*names) & ~F.col("failed")).select("call_id", *[v.alias(k) for k, v in out.items()])


def _items(*paths: str) -> Column:
    """The first of these lists that isn't empty, else the result itself if it is a list."""
    found = F.coalesce(*[F.when((_get("result", p) != "[]") & _is_list(_get("result", p)), _get("result", p)) for p in paths], F.when(_is_list(F.col("result")), F.col("result")))
    return F.coalesce(_strings(found), F.array().cast("array<string>"))


def _ids(items: Column) -> Column:
    return F.filter(F.transform(items, lambda i: F.get_json_object(i, "$.id")), lambda x: x.isNotNull())


def _scores(items: Column) -> Column:
    return F.filter(F.transform(items, lambda i: F.get_json_object(i, "$.score").cast("double")), lambda x: x.isNotNull())


_M0 = lambda: _items("$.results", "$.memories")
_M0_READ = ReadMap(query=lambda: F.coalesce(_get("args", "$[0]"), _get("kwargs", "$.query"), F.lit("")), returned=lambda: _ids(_M0()), scores=lambda: _scores(_M0()))
MEM0 = Adapter("mem0", {"add": WriteMap(lambda: _joined(F.coalesce(_get("args", "$[0]"), _get("kwargs", "$.messages"))), lambda: F.when(F.size(_M0()) > 0, F.get_json_object(_M0()[0], "$.id")).otherwise(_get("result", "$.id")))}, {"search": _M0_READ, "get_all": _M0_READ})


def _inner(path: str) -> Column:
    """The first inner list of a list of lists, or the list itself."""
    x = _get("result", path)
    return F.coalesce(_strings(F.when(x.startswith("[["), F.get_json_object(x, "$[0]")).otherwise(F.when(_is_list(x), x))), F.array().cast("array<string>"))


def _first_or_text(x: Column) -> Column:
    return F.when(_is_list(x), F.get_json_object(x, "$[0]")).otherwise(x)


CHROMA = Adapter(
    "chroma",
    {"add": WriteMap(lambda: _joined(F.coalesce(_get("kwargs", "$.documents"), _get("args", "$[0]"))), lambda: _first_or_text(_get("kwargs", "$.ids")))},
    {"query": ReadMap(lambda: F.coalesce(_first_or_text(_get("kwargs", "$.query_texts")), F.lit("")), lambda: _inner("$.ids"), lambda: F.transform(_inner("$.distances"), lambda d: d.cast("double")))},
)

_LAST = lambda: F.coalesce(F.element_at(_strings(F.when(F.col("args") != "[]", F.col("args"))), -1), F.lit(""))
_LETTA_READ = ReadMap(query=lambda: F.coalesce(_get("kwargs", "$.query"), _LAST()), returned=lambda: _ids(F.coalesce(_strings(F.when(_is_list(F.col("result")), F.col("result"))), F.array().cast("array<string>"))))
LETTA = Adapter("letta", {"insert_archival_memory": WriteMap(lambda: F.coalesce(_get("kwargs", "$.memory"), _LAST()), lambda: F.when(_is_list(F.col("result")), _get("result", "$[0].id")).otherwise(_get("result", "$.id")))}, {"get_archival_memory": _LETTA_READ, "search_archival_memory": _LETTA_READ})


def gateway(write_tools: dict[str, WriteMap], read_tools: dict[str, ReadMap]) -> Adapter:
    """Tool calls of a gateway: the log's method is the tool's name and kwargs are its arguments."""
    return Adapter("gateway", write_tools, read_tools)


def sidecar(log: DataFrame, upserts: dict[str, WriteMap], queries: dict[str, ReadMap], record_id: Column) -> tuple[DataFrame, DataFrame]:
    """(records, forwarded): an upsert is recorded before it is forwarded, so also if it then fails, without a memory id and with the record's id added to its payload; queries are recorded after."""
    writes = mapped(log.where(F.col("method").isin(*upserts)).withColumn("failed", F.lit(False)), Adapter("sidecar", {m: WriteMap(w.content) for m, w in upserts.items()})).withColumn("record_id", record_id)
    reads = mapped(log, Adapter("sidecar", {}, queries)).withColumn("record_id", record_id)
    tagged = F.to_json(F.map_concat(F.from_json("kwargs", "map<string,string>"), F.create_map(F.lit(TAG), record_id)))
    forwarded = log.withColumn("kwargs", F.when(F.col("method").isin(*upserts), tagged).otherwise(F.col("kwargs")))
    return writes.unionByName(reads), forwarded


def inserts(rows: DataFrame, content: str, memory_id: str | None = None) -> DataFrame:
    """Writes from explicit inserts of a table (a vector column of a relational store)."""
    return rows.select(F.lit("write").alias("kind"), F.col(content).alias("content"), (F.col(memory_id).cast("string") if memory_id else F.lit(None).cast("string")).alias("memory_id"))


def searches(rows: DataFrame, query: str, returned: str, scores: str) -> DataFrame:
    """Retrievals from explicit searches."""
    return rows.select(F.lit("retrieval").alias("kind"), F.col(query).alias("query"), F.col(returned).cast("array<string>").alias("returned"), F.col(scores).cast("array<double>").alias("scores"))


WATCHED = tuple(f"{name}.md" for name in ("AGENTS", "CLAUDE", "MEMORY"))


def scan_files(spark: SparkSession, root: str, snapshot: DataFrame | None = None, max_bytes: int = 5 << 20) -> tuple[DataFrame, DataFrame]:
    """(records, new snapshot) of the watched memory files directly in ``root``: those that are new or changed since ``snapshot`` (path, digest). Larger ones are skipped before their content is read."""
    there = set(Files(spark, root).names(""))
    paths = [f"{root.rstrip('/')}/{name}" for name in WATCHED if name in there]
    if paths:
        files = spark.read.format("binaryFile").load(paths).where(F.col("length") <= max_bytes)
    else:
        files = spark.createDataFrame([], "path string, content binary")
    now = files.select("path", F.sha2("content", 256).alias("digest"), F.decode("content", "UTF-8").alias("content"))
    if snapshot is not None:
        now_changed = now.join(snapshot.select("path", F.col("digest").alias("was")), "path", "left").where("was is null or was <> digest").drop("was")
    else:
        now_changed = now
    records = now_changed.select(F.lit("write").alias("kind"), "content", F.col("path").alias("locator"), F.lit("file_read").alias("source_type"), F.lit("procedural").alias("memory_type"))
    return records, now.select("path", "digest")


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _log(df: DataFrame, method: str, args: Column, kwargs: Column, result: Column) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("call_id"), F.lit(method).alias("method"), args.alias("args"), kwargs.alias("kwargs"), result.alias("result"), F.lit(False).alias("failed"))


_NONE = json.dumps({})


def mem0_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of a memory client's calls made of the test tables."""
    d, c = read(spark, sf, "documents"), read(spark, sf, "conversations").where("role = 'user'")
    result = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.expr("named_struct('results', array(named_struct('id', 'mem-' || doc_id)))"))).otherwise(F.lit(_NONE))
    hits = F.to_json(F.expr("named_struct('results', array(named_struct('id', 'mem-' || turn, 'score', 0.5D), named_struct('id', 'mem-' || conv_id, 'score', 0.25D)))"))
    return _log(d, "add", F.to_json(F.array(F.expr("array(named_struct('role', 'user', 'content', text))"))), F.lit(_NONE), result).unionByName(_log(c, "search", F.to_json(F.array("text")), F.lit(_NONE), hits))


def chroma_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of a vector store's calls made of the test tables."""
    d, c = read(spark, sf, "documents"), read(spark, sf, "conversations").where("role = 'user'")
    adds = _log(d, "add", F.lit("[]"), F.to_json(F.expr("named_struct('documents', array(text, lang), 'ids', array('c' || doc_id, 'd' || doc_id))")), F.lit(_NONE))
    asks = _log(c, "query", F.lit("[]"), F.to_json(F.expr("named_struct('query_texts', array(text))")), F.to_json(F.expr("named_struct('ids', array(array('c' || turn, 'c' || conv_id)), 'distances', array(array(0.1D, 0.2D)))")))
    return adds.unionByName(asks)


def letta_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of an archival memory's calls made of the test tables."""
    d, c = read(spark, sf, "documents"), read(spark, sf, "conversations").where("role = 'user'")
    adds = _log(d, "insert_archival_memory", F.to_json(F.array(F.lit("agent"), F.col("text"))), F.lit(_NONE), F.to_json(F.expr("array(named_struct('id', 'p' || doc_id))")))
    asks = _log(c, "search_archival_memory", F.to_json(F.array(F.lit("agent"))), F.to_json(F.struct(F.col("text").alias("query"))), F.to_json(F.expr("array(named_struct('id', 'p' || turn), named_struct('id', 'p' || conv_id))")))
    return adds.unionByName(asks)
