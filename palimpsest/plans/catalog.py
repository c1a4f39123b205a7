"""The queries over the fixture ledger and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import ed25519, records
from palimpsest.functions import text as tx
from palimpsest.operators import chain, graph
from palimpsest.operators import detectors as det
from palimpsest.plans import forensics as fx
from palimpsest.plans import similarity as sim
from palimpsest.sources import calls, fixture
from palimpsest.shared import cut
from palimpsest.sources.tables import read

TOPIC, DRIFT_NEAR, DRIFT_FAR = "that this for with thing", 0.3, 0.6
QUERY = "that this for with thing"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _one(spark: SparkSession, *nodes: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "node string")


def _edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ledger = fixture.ledger(spark, sf)
    return ledger, graph.derive_edges(ledger)


def _rolled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Ledger and edges after the rollback of src3."""
    ledger, edges = _edges(spark, sf)
    rb = fixture.rollback_row(fx.blast_radius(ledger, edges, "src3"))
    after = ledger.unionByName(rb, allowMissingColumns=True)
    return after, graph.derive_edges(after)


@query(fixture.ROWS + "\nSELECT seq, record_id, kind, namespace, created_at FROM ledger0")
def ledger_scan(spark: SparkSession, sf: str) -> DataFrame:
    return fixture.ledger(spark, sf).select("seq", "record_id", "kind", "namespace", "created_at")


@query(fixture.ROWS + "\nSELECT kind, count(*) AS n FROM ledger0 GROUP BY kind")
def kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fixture.ledger(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query(fixture.ROWS + "\nSELECT seq, record_id, source_id, source_type, locator, trust_level, trust_score, content, derived_from FROM ledger0 WHERE record_id = 'w000000051'")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return fixture.ledger(spark, sf).where("record_id = 'w000000051'").select("seq", "record_id", "source_id", "source_type", "locator", "trust_level", "trust_score", "content", "derived_from")


@query(fixture.ROWS + "\nSELECT seq, record_id, kind FROM ledger0 ORDER BY seq DESC LIMIT 1")
def last_entry(spark: SparkSession, sf: str) -> DataFrame:
    return fixture.ledger(spark, sf).agg(F.max_by(F.struct("seq", "record_id", "kind"), "seq").alias("r")).select("r.*")


@query(fixture.EDGES + "\nSELECT * FROM edges")
def edges_derived(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)[1]


@query(fixture.EDGES + "\nSELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type")
def edge_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)[1].groupBy("edge_type").agg(F.count("*").alias("n"))


@query(fixture.RAW_EDGES + "\nSELECT * FROM raw_edges WHERE src NOT IN (SELECT record_id FROM ledger0)")
def edges_dangling(spark: SparkSession, sf: str) -> DataFrame:
    return graph.dangling_edges(fixture.ledger(spark, sf))


@query(fixture.EDGES + "\nSELECT src, dst, edge_type FROM edges WHERE src IN ('w000000001', 'w000000003', 'w000000010')")
def neighbours_out(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(_edges(spark, sf)[1], _one(spark, "w000000001", "w000000003", "w000000010")).select("src", "dst", "edge_type")


@query(fixture.EDGES + "\nSELECT src, dst, edge_type FROM edges WHERE edge_type = 'DERIVED_FROM' AND dst IN ('w000000003', 'w000000009', 'w000000030')")
def neighbours_in_typed(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(_edges(spark, sf)[1], _one(spark, "w000000003", "w000000009", "w000000030"), out=False, types=("DERIVED_FROM",)).select("src", "dst", "edge_type")


def _closure(seed: str, where: str = "true", edges: str = "edges") -> str:
    return f",\nc(node) AS ({seed} UNION SELECT e.dst FROM c JOIN {edges} e ON e.src = c.node WHERE {where})"


_HIT = "SELECT record_id FROM {of} WHERE kind = 'write' AND (record_id = '{s}' OR source_id = '{s}' OR source_type = '{s}' OR locator = '{s}')"
_SRC3 = _HIT.format(of="ledger0", s="src3")


@query(fixture.EDGES + _closure(_SRC3) + "\nSELECT src, dst, edge_type FROM edges WHERE src IN (SELECT node FROM c) AND dst IN (SELECT node FROM c)")
def subgraph(spark: SparkSession, sf: str) -> DataFrame:
    ledger, edges = _edges(spark, sf)
    return graph.induced(edges, fx.blast_radius(ledger, edges, "src3"))


_TWO = "SELECT unnest(['w000000001', 'w000000002'])"


@query(fixture.EDGES + _closure(_TWO) + "\nSELECT node FROM c")
def closure_forward(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reach(_edges(spark, sf)[1], _one(spark, "w000000001", "w000000002"))


@query(fixture.EDGES + _closure(_TWO, "e.edge_type = 'DERIVED_FROM'") + "\nSELECT node FROM c")
def closure_forward_typed(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reach(_edges(spark, sf)[1], _one(spark, "w000000001", "w000000002"), types=("DERIVED_FROM",))


_ACTION = "SELECT min(record_id) AS node FROM ledger0 WHERE kind = 'action'"
_BACK = f",\nc(node, depth) AS (SELECT node, 0 FROM ({_ACTION}) UNION SELECT e.src, depth + 1 FROM c JOIN edges e ON e.dst = c.node WHERE depth < {{depth}})"


def _first_action(ledger: DataFrame) -> DataFrame:
    return ledger.where("kind = 'action'").agg(F.min("record_id").alias("node"))


@query(fixture.EDGES + _BACK.format(depth=99) + f"\nSELECT DISTINCT node FROM c WHERE node NOT IN ({_ACTION})")
def closure_backward(spark: SparkSession, sf: str) -> DataFrame:
    ledger, edges = _edges(spark, sf)
    return graph.reach(edges, _first_action(ledger), forward=False)


@query(fixture.EDGES + _BACK.format(depth=2) + f"\nSELECT DISTINCT node FROM c WHERE node NOT IN ({_ACTION})")
def closure_backward_depth2(spark: SparkSession, sf: str) -> DataFrame:
    ledger, edges = _edges(spark, sf)
    return graph.reach(edges, _first_action(ledger), forward=False, max_depth=2)


_RING = ("w000000000", "w000000001", "w000000002")
_CYCLE = ",\nring AS (SELECT src, dst, edge_type FROM edges UNION SELECT * FROM (VALUES ('w000000000', 'w000000001', 'INFLUENCED'), ('w000000001', 'w000000002', 'INFLUENCED'), ('w000000002', 'w000000000', 'INFLUENCED')))"


@query(fixture.EDGES + _CYCLE + _closure("SELECT 'w000000001'", edges="ring") + "\nSELECT node FROM c")
def closure_cycle(spark: SparkSession, sf: str) -> DataFrame:
    ledger, edges = _edges(spark, sf)
    ring = spark.createDataFrame([(_RING[i], _RING[(i + 1) % 3], "INFLUENCED") for i in range(3)], "src string, dst string, edge_type string")
    return graph.reach(graph.add_edges(edges, ring, ledger), _one(spark, "w000000001"))


@query(fixture.EDGES + ",\nc(root, node) AS (SELECT record_id, record_id FROM ledger0 WHERE kind = 'action' UNION SELECT c.root, e.src FROM c JOIN edges e ON e.dst = c.node)\nSELECT root, count(*) - 1 AS n FROM c GROUP BY root")
def ancestor_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many ancestors every action has: all closures in one."""
    ledger, edges = _edges(spark, sf)
    starts = ledger.where("kind = 'action'").select(F.col("record_id").alias("root"), F.col("record_id").alias("node"))
    return graph.reach(edges, starts, forward=False, include_seeds=True).groupBy("root").agg((F.count("*") - 1).alias("n"))


@query(fixture.EDGES + _closure(_SRC3) + "\nSELECT node FROM c")
def blast_radius(spark: SparkSession, sf: str) -> DataFrame:
    return fx.blast_radius(*_edges(spark, sf), "src3")


@query(fixture.EDGES + _closure(_HIT.format(of="ledger0", s="web_fetch")) + "\nSELECT node FROM c")
def blast_radius_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return fx.blast_radius(*_edges(spark, sf), "web_fetch")


@query(fixture.ROLLED + _closure(_HIT.format(of="ledger", s="src3"), edges="edges2") + "\nSELECT node FROM c")
def blast_radius_after_rollback(spark: SparkSession, sf: str) -> DataFrame:
    """The rollback is a descendant of what it rolled back."""
    return fx.blast_radius(*_rolled(spark, sf), "src3")


_TRACE = (
    _BACK.format(depth=99)
    + """,
up AS (SELECT l.* FROM ledger0 l WHERE kind = 'write' AND record_id IN (SELECT node FROM c)),
d(root, node) AS (SELECT record_id, record_id FROM up UNION SELECT d.root, e.dst FROM d JOIN edges e ON e.src = d.node),
roots AS (SELECT record_id, source_id, source_type, trust_level, created_at, (SELECT count(*) - 1 FROM d WHERE d.root = up.record_id) AS centrality FROM up),
ranked AS (SELECT *, row_number() OVER (ORDER BY CASE trust_level WHEN 'quarantined' THEN 0 WHEN 'untrusted' THEN 1 WHEN 'semi_trusted' THEN 2 WHEN 'trusted' THEN 3 WHEN 'system' THEN 4 ELSE 1 END, created_at DESC, centrality DESC, record_id)::INTEGER AS rank FROM roots)"""
)


@query(fixture.EDGES + _TRACE + "\nSELECT * FROM ranked")
def trace_roots(spark: SparkSession, sf: str) -> DataFrame:
    ledger, edges = _edges(spark, sf)
    return fx.trace(ledger, edges, _first_action(ledger))


@query(fixture.EDGES + _TRACE + "\nSELECT * FROM ranked WHERE rank = 1")
def trace_primary(spark: SparkSession, sf: str) -> DataFrame:
    return trace_roots(spark, sf).where("rank = 1")


@query(fixture.ROWS + "\nSELECT created_at AS timestamp, seq, kind, record_id, coalesce(nullif(content, ''), nullif(query, ''), nullif(summary, ''), '') AS text FROM ledger0 WHERE contains(lower(coalesce(nullif(content, ''), nullif(query, ''), nullif(summary, ''), '')), 'than the')")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return fx.timeline(fixture.ledger(spark, sf).withColumn("reason", F.lit(None).cast("string")), "Than The")


@query("SELECT 'm' || doc_id AS memory_id, doc_id AS line FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT 'orphan-' || (k % 5), 1000000000 + k FROM range(6) t(k)")
def reconcile_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Backend ids that no write accounts for; one of them comes twice."""
    ids = read(spark, sf, "documents").select(F.expr("'m' || doc_id").alias("memory_id"), F.col("doc_id").alias("line")).unionByName(spark.range(6).select(F.expr("'orphan-' || (id % 5)").alias("memory_id"), F.expr("1000000000 + id").alias("line")))
    return fx.reconcile(fixture.ledger(spark, sf), ids)


@query(fixture.ROWS + "\nSELECT DISTINCT memory_id FROM ledger0 WHERE kind = 'write' AND memory_id <> ''")
def known_memory_ids(spark: SparkSession, sf: str) -> DataFrame:
    return fx.known_memory_ids(fixture.ledger(spark, sf))


_PLAN = _closure(_SRC3 + " UNION SELECT record_id FROM ledger0 WHERE record_id = 'src3'")


@query(fixture.EDGES + _PLAN + "\nSELECT node FROM c")
def rollback_plan(spark: SparkSession, sf: str) -> DataFrame:
    return fx.rollback_plan(*_edges(spark, sf), "src3")


@query(fixture.EDGES + _PLAN + "\nSELECT node FROM c JOIN ledger0 ON record_id = node WHERE namespace = 'en'")
def rollback_plan_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return fx.rollback_plan(*_edges(spark, sf), "src3", scope="en")


@query(fixture.EDGES + _closure("SELECT record_id FROM ledger0 WHERE record_id = 'w000000003'") + "\nSELECT node FROM c")
def rollback_plan_record(spark: SparkSession, sf: str) -> DataFrame:
    return fx.rollback_plan(*_edges(spark, sf), "w000000003")


@query(fixture.ROLLED + "\nSELECT DISTINCT unnest(affected) AS node FROM ledger")
def rolled_back_ids(spark: SparkSession, sf: str) -> DataFrame:
    return fx.rolled_back_ids(_rolled(spark, sf)[0])


@query(fixture.ROLLED + "\nSELECT node, CASE WHEN node IN (SELECT node FROM hit) THEN 'rolled_back' WHEN node IN (SELECT record_id FROM ledger) THEN 'active' ELSE 'expired' END AS state FROM (SELECT record_id AS node FROM ledger UNION ALL SELECT 'ghost-' || doc_id FROM documents WHERE doc_id % 17 = 0)")
def effective_state(spark: SparkSession, sf: str) -> DataFrame:
    ledger, _ = _rolled(spark, sf)
    ids = ledger.select(F.col("record_id").alias("node")).unionByName(read(spark, sf, "documents").where("doc_id % 17 = 0").select(F.expr("'ghost-' || doc_id").alias("node")))
    return fx.effective_state(ledger, ids)


def _flat(found: DataFrame, *keys: str) -> DataFrame:
    return found.select("detector_name", "severity", "record_id", *[F.col("evidence")[k].alias(k) for k in keys])


_W = fixture.ROWS + ",\nws AS (SELECT * FROM ledger0 WHERE kind = 'write')"
_EXT = ", ".join(f"'{t}'" for t in det.EXTERNAL)
_D1 = f"SELECT 'provenance_missing' AS detector_name, CASE WHEN source_type IN ({_EXT}) THEN 'HIGH' ELSE 'INFO' END AS severity, record_id, source_type, trust_level FROM ws WHERE coalesce(locator, '') = ''"


@query(_W + "\n" + _D1)
def det_provenance_missing(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(det.provenance_missing(det.writes(fixture.ledger(spark, sf))), "source_type", "trust_level")


def _re2(p: str) -> str:
    return "(?i)" + p.replace("'", "''")


_FIRSTS = "list_filter([" + ", ".join(f"regexp_extract(content, '{_re2(p)}')" for p in tx.INJECTION) + "], lambda x: x <> '')"
_D2 = f"SELECT 'injection_scan' AS detector_name, 'HIGH' AS severity, record_id, array_to_string({_FIRSTS}, '|') AS matches FROM ws WHERE len({_FIRSTS}) > 0"


@query(_W + "\n" + _D2)
def det_injection(spark: SparkSession, sf: str) -> DataFrame:
    found = det.injection_scan(det.writes(fixture.ledger(spark, sf)))
    return found.select("detector_name", "severity", "record_id", F.array_join(F.from_json(F.col("evidence")["matches"], "array<string>"), "|").alias("matches"))


_HIDDEN = "list_sort(list_distinct(list_transform(regexp_extract_all(content, '[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{E0000}-\\x{E007F}]'), lambda c: 'U+' || CASE WHEN unicode(c) < 65536 THEN lpad(upper(to_hex(unicode(c))), 4, '0') ELSE upper(to_hex(unicode(c))) END)))"
_D3 = f"SELECT 'unicode_smuggling' AS detector_name, 'HIGH' AS severity, record_id, array_to_string({_HIDDEN}, '|') AS code_points FROM ws WHERE len({_HIDDEN}) > 0"


@query(_W + "\n" + _D3)
def det_unicode(spark: SparkSession, sf: str) -> DataFrame:
    found = det.unicode_smuggling(det.writes(fixture.ledger(spark, sf)))
    return found.select("detector_name", "severity", "record_id", F.array_join(F.from_json(F.col("evidence")["code_points"], "array<string>"), "|").alias("code_points"))


def _count(p: str) -> str:
    return f"len(regexp_extract_all(content, '{p}'))"


_SECRETS, _PII = " + ".join(_count(p) for p in tx.SECRETS.values()), " + ".join(_count(p) for p in tx.PII.values())
_D4 = f"SELECT 'secrets_pii' AS detector_name, CASE WHEN {_SECRETS} > 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, record_id, {_count(tx.SECRETS['aws_access_key'])} AS aws_access_key, {_count(tx.PII['email'])} AS email FROM ws WHERE {_SECRETS} + {_PII} > 0"


@query(_W + "\n" + _D4)
def det_secrets_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = det.secrets_pii(det.writes(fixture.ledger(spark, sf)))
    n = lambda m, k: F.coalesce(F.from_json(F.col("evidence")[m], "map<string,long>")[k], F.lit(0)).alias(k)
    return found.select("detector_name", "severity", "record_id", n("secrets", "aws_access_key"), n("pii", "email"))


def _rate(ts: str) -> str:
    return f"""WITH e AS (SELECT event_id, event_type AS namespace, user_id::VARCHAR AS source_id, {ts} AS ts FROM events)
SELECT a.event_id, a.namespace, a.source_id, count(*) AS in_window FROM e a JOIN e b ON a.namespace = b.namespace AND a.source_id = b.source_id
  AND b.ts >= a.ts - INTERVAL 86400 SECOND AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id))
GROUP BY ALL HAVING count(*) > 2"""


def _events(spark: SparkSession, sf: str, ts: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", F.col("event_type").alias("namespace"), F.col("user_id").cast("string").alias("source_id"), F.expr(ts).alias("ts"))
    return det.in_window(e, 86400, order="event_id").where("in_window > 2").select("event_id", "namespace", "source_id", "in_window")


@query(_rate("ts"))
def det_write_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts over the events table: more than two of a kind by one user within a day."""
    return _events(spark, sf, "ts")


@query(_rate("date_trunc('hour', ts)"))
def det_write_rate_ties(spark: SparkSession, sf: str) -> DataFrame:
    """The same with equal timestamps, which count in their order of arrival."""
    return _events(spark, sf, "date_trunc('hour', ts)")


_D5 = """SELECT 'write_rate' AS detector_name, 'MEDIUM' AS severity, record_id, source_id, in_window AS writes_in_window FROM (
  SELECT a.record_id, a.source_id, count(*) AS in_window FROM ws a JOIN ws b ON a.namespace = b.namespace AND a.source_id IS NOT DISTINCT FROM b.source_id
    AND b.created_at::TIMESTAMP >= a.created_at::TIMESTAMP - INTERVAL {seconds} SECOND AND (b.created_at < a.created_at OR (b.created_at = a.created_at AND b.seq <= a.seq)) GROUP BY ALL) WHERE in_window > {most}"""


@query(_W + "\n" + _D5.format(seconds=3600, most=5))
def det_write_rate_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The detector itself over all writes: more than five of one source in one namespace within an hour."""
    found = det.write_rate(det.writes(fixture.ledger(spark, sf)), 3600, 5)
    return found.select("detector_name", "severity", "record_id", F.col("evidence")["source_id"].alias("source_id"), F.col("evidence")["writes_in_window"].cast("long").alias("writes_in_window"))


_BAD = "(coalesce(trust_level IN ('untrusted', 'quarantined'), false) OR locator IS NULL)"
_D6 = f"""SELECT record_id, source_id, prior, posterior FROM (
  SELECT record_id, source_id, bad, CASE WHEN k = 1 THEN first ELSE list_reduce(list_prepend(first, list_transform(seen[1:k-1], lambda x: x::DOUBLE)), lambda p, x: CASE WHEN x = 1 THEN p * 0.75 ELSE least(1.0, p + (1 - p) * 0.1) END) END AS prior,
    list_reduce(list_prepend(first, list_transform(seen, lambda x: x::DOUBLE)), lambda p, x: CASE WHEN x = 1 THEN p * 0.75 ELSE least(1.0, p + (1 - p) * 0.1) END) AS posterior
  FROM (SELECT record_id, source_id, {_BAD} AS bad, first_value(trust_score) OVER o AS first, list(CASE WHEN {_BAD} THEN 1 ELSE 0 END) OVER o AS seen, row_number() OVER o AS k
    FROM ws WINDOW o AS (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) WHERE bad"""


_LEVEL6 = "CASE WHEN posterior < 0.3 THEN 'HIGH' WHEN posterior < 0.6 THEN 'MEDIUM' ELSE 'INFO' END"


@query(_W + f"\nSELECT record_id, source_id, {_LEVEL6} AS severity, (prior * 1000003)::BIGINT AS prior_scaled, (posterior * 1000003)::BIGINT AS posterior_scaled, true AS evidence_fits FROM ({_D6})")
def det_trust_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with severity; their rounded evidence beside the scores that it was rounded from."""
    w = cut(det.writes(fixture.ledger(spark, sf)))
    scored = det.trust_posterior(w).select(F.col("record_id").alias("scored"), "source_id", "prior", "posterior")
    found = det.trust_scoring(w).select("record_id", "severity", "evidence").join(scored, F.col("record_id") == F.col("scored"))
    whole = lambda c: F.rint(F.col(c) * 1000003).cast("long").alias(f"{c}_scaled")
    near = lambda c: F.abs(F.col("evidence")[c].cast("double") - F.col(c)) < 5.001e-7
    return found.select("record_id", "source_id", "severity", whole("prior"), whole("posterior"), (near("prior") & near("posterior") & F.col("evidence")["source_id"].eqNullSafe(F.col("source_id"))).alias("evidence_fits"))


_STOP = ", ".join(f"'{w}'" for w in sorted(tx.STOP))


def _cells(of: str, key: str, text: str) -> str:
    return f"""SELECT {key}, ('0x' || substr(sha256(t), 1, 8))::BIGINT % {tx.DIM} AS bucket, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM {of}) WHERE t NOT IN ({_STOP}) GROUP BY 1, 2"""


@query(_W + "\n" + _cells("ws", "record_id", "content"))
def token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tx.sparse(det.writes(fixture.ledger(spark, sf)), ["record_id"], "content")


def _like(topic: str) -> str:
    return f""",
cells AS ({_cells("ws", "record_id", "content")}),
want AS ({_cells(f"(SELECT '{topic}' AS topic)", "topic", "topic")}),
norms AS (SELECT record_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM cells GROUP BY 1),
sims AS (SELECT c.record_id, sum(c.n * want.n)::DOUBLE / (any_value(norms.norm) * (SELECT sqrt(sum(n * n)::DOUBLE) FROM want)) AS cosine FROM cells c JOIN want USING (bucket) JOIN norms ON norms.record_id = c.record_id GROUP BY 1)"""


@query(_W + _like(QUERY) + "\nSELECT seq, s.record_id, (cosine * 1000000)::BIGINT AS cosine_millionths FROM sims s JOIN ws USING (record_id) WHERE cosine >= 0.3")
def similarity_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return sim.retrieve(fixture.ledger(spark, sf), QUERY).select("seq", "record_id", F.rint(F.col("cosine") * 1000000).cast("long").alias("cosine_millionths"))


@query(fixture.ROLLED + ",\nws AS (SELECT * FROM ledger WHERE kind = 'write')" + _like(QUERY) + "\nSELECT seq, s.record_id FROM sims s JOIN ws USING (record_id) WHERE cosine >= 0.3 AND s.record_id NOT IN (SELECT node FROM hit)")
def similarity_retrieval_safe(spark: SparkSession, sf: str) -> DataFrame:
    return sim.retrieve(_rolled(spark, sf)[0], QUERY, respect_rollback=True).select("seq", "record_id")


@query(
    _W
    + _like(TOPIC)
    + f""",
cl AS (SELECT ws.* FROM ws JOIN sims USING (record_id) WHERE cosine >= {DRIFT_NEAR}),
u AS (SELECT c.record_id, c.bucket, c.n / norm AS x, cl.trust_level FROM cells c JOIN norms USING (record_id) JOIN cl USING (record_id)),
m AS (SELECT bucket, sum(x) AS c FROM u WHERE trust_level IN ('trusted', 'system') GROUP BY 1),
s AS (SELECT u.record_id, sum(x * coalesce(c, 0)) / (SELECT sqrt(sum(c * c)) FROM m) AS similarity FROM u LEFT JOIN m USING (bucket) WHERE trust_level IN ('untrusted', 'quarantined', 'semi_trusted') GROUP BY 1)
SELECT created_at AS timestamp, seq, record_id, source_id, trust_level, (similarity * 1000)::BIGINT AS similarity_thousandths FROM s JOIN cl USING (record_id) WHERE similarity < {DRIFT_FAR}"""
)
def drift_events(spark: SparkSession, sf: str) -> DataFrame:
    got = sim.drift_events(fixture.ledger(spark, sf), TOPIC, DRIFT_NEAR, DRIFT_FAR)
    return got.select("timestamp", "seq", "record_id", "source_id", "trust_level", F.rint(F.col("similarity") * 1000).cast("long").alias("similarity_thousandths"))


_D7 = f""",
cells AS ({_cells("ws", "record_id", "content")}),
norms AS (SELECT record_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM cells GROUP BY 1),
pairs AS (SELECT s.record_id, t.record_id AS other FROM (SELECT * FROM ws WHERE trust_level IN ('untrusted', 'quarantined', 'semi_trusted')) s
  JOIN (SELECT * FROM ws WHERE trust_level IN ('trusted', 'system')) t ON s.namespace = t.namespace AND t.seq < s.seq
  JOIN cells a ON a.record_id = s.record_id JOIN cells b ON b.record_id = t.record_id AND a.bucket = b.bucket JOIN norms x ON x.record_id = s.record_id JOIN norms y ON y.record_id = t.record_id
  GROUP BY 1, 2 HAVING sum(a.n * b.n)::DOUBLE / (any_value(x.norm) * any_value(y.norm)) >= 0.5),
m AS (SELECT p.record_id, c.bucket, sum(c.n / norm) AS v FROM pairs p JOIN cells c ON c.record_id = p.other JOIN norms z ON z.record_id = p.other GROUP BY 1, 2),
sc AS (SELECT m.record_id, sum(coalesce(c.n, 0) / norms.norm * v) / sqrt(sum(v * v)) AS similarity FROM m JOIN norms ON norms.record_id = m.record_id LEFT JOIN cells c ON c.record_id = m.record_id AND c.bucket = m.bucket GROUP BY 1)"""


@query(_W + _D7 + "\nSELECT record_id, source_id, 'HIGH' AS severity, (similarity * 1000)::BIGINT AS similarity_thousandths, true AS evidence_fits FROM sc JOIN ws USING (record_id) WHERE similarity < 0.8")
def det_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with severity; their rounded evidence beside the similarity that it was rounded from."""
    w = cut(det.writes(fixture.ledger(spark, sf)))
    scores = cut(det.drift_scores(w, by_counts=True))
    scored = scores.select(F.col("record_id").alias("scored"), "source_id", "similarity")
    found = det.drift(w, scores=scores).select("record_id", "severity", "evidence").join(scored, F.col("record_id") == F.col("scored"))
    fits = (F.abs(F.col("evidence")["similarity"].cast("double") - F.col("similarity")) < 5.001e-5) & F.col("evidence")["source_id"].eqNullSafe(F.col("source_id"))
    return found.select("record_id", "source_id", "severity", F.rint(F.col("similarity") * 1000).cast("long").alias("similarity_thousandths"), fits.alias("evidence_fits"))


_PACK = " UNION ALL ".join(f"SELECT detector_name, severity FROM ({d})" for d in (_D1, _D2, _D3, _D4, _D5.format(seconds=60, most=5), f"SELECT 'trust_scoring' AS detector_name, {_LEVEL6} AS severity FROM ({_D6})", "SELECT 'drift' AS detector_name, 'HIGH' AS severity FROM sc WHERE similarity < 0.8"))


@query(_W + _D7 + f"\nSELECT detector_name, severity, CASE severity WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM ({_PACK}) GROUP BY ALL")
def findings_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    """What the default pack of seven detectors finds."""
    found = det.run_pack(cut(fixture.ledger(spark, sf)))
    level = F.when(F.col("severity").isin("HIGH", "CRITICAL"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    return found.groupBy("detector_name", "severity", level.alias("level")).agg(F.count("*").alias("n"))


#: The chain over all documents in SHA-256, row by row as it is defined.
_LINKS = """WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY doc_id) AS seq, to_json({'kind': 'write', 'record_id': 'w' || doc_id, 'content': text})::VARCHAR AS payload FROM documents),
c(seq, payload, entry_hash, prev_hash) AS (SELECT seq, payload, 'sha256:' || sha256(payload), NULL::VARCHAR FROM p WHERE seq = 1
  UNION ALL SELECT p.seq, p.payload, 'sha256:' || sha256(p.payload || c.entry_hash), c.entry_hash FROM c JOIN p ON p.seq = c.seq + 1)"""


def _sha_chain(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    name = F.concat(F.lit("w"), F.col("doc_id").cast("string"))
    payload = F.to_json(F.struct(F.lit("write").alias("kind"), name.alias("record_id"), F.col("text").alias("content")))
    return cut(chain.append(d.select(F.col("doc_id").alias("order"), name.alias("record_id"), F.lit("write").alias("kind"), F.col("lang").alias("namespace"), payload.alias("payload_json"), F.lit("2024-01-01T00:00:00+00:00").alias("created_at")), _SEED, digest="sha256"))


@query(_LINKS + "\nSELECT seq, entry_hash, prev_hash FROM c")
def chain_links(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes and links of a chain over all documents, as the engine builds it."""
    return _sha_chain(spark, sf).select("seq", "entry_hash", "prev_hash")


@query(
    _LINKS
    + """,
t AS (SELECT 'edited' AS tampering, seq, CASE WHEN seq % 50 = 5 THEN '{}' ELSE payload END AS payload, entry_hash, prev_hash FROM c
  UNION ALL SELECT 'removed', seq, payload, entry_hash, prev_hash FROM c WHERE seq % 70 <> 7
  UNION ALL SELECT 'linked wrongly', seq, payload, CASE WHEN seq % 90 = 9 THEN 'sha256:' || sha256(payload || 'sha256:00') ELSE entry_hash END, CASE WHEN seq % 90 = 9 THEN 'sha256:00' ELSE prev_hash END FROM c
  UNION ALL SELECT 'none', seq, payload, entry_hash, prev_hash FROM c),
f AS (SELECT *, 'sha256:' || sha256(payload || coalesce(prev_hash, '')) <> entry_hash AS edit, prev_hash IS DISTINCT FROM lag(entry_hash) OVER (PARTITION BY tampering ORDER BY seq) AS gap, row_number() OVER (PARTITION BY tampering ORDER BY seq) - 1 AS before FROM t),
w AS (SELECT tampering, arg_min({'seq': seq, 'rows': before, 'kind': CASE WHEN edit THEN 'edit' ELSE 'gap' END}, seq) FILTER (WHERE edit OR gap) AS x, count(*) AS n FROM f GROUP BY tampering)
SELECT tampering, x IS NULL AS ok, coalesce(x.rows, n) AS rows_checked, x.seq AS seq, x.kind AS kind FROM w UNION ALL SELECT 'other key', false, 0, 1, 'forgery'"""
)
def chain_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """The first divergence that the engine finds in tampered copies of a whole chain: many rows are tampered with in each."""
    rows, key, other = _sha_chain(spark, sf), ed25519.public_key(_SEED), ed25519.public_key(bytes(32))
    on = lambda n: F.col("seq") % n == n // 10
    relinked = F.concat(F.lit("sha256:"), F.sha2(F.concat("payload_json", F.lit("sha256:00")).cast("binary"), 256))
    cases = {
        "none": (rows, key),
        "edited": (rows.withColumn("payload_json", F.when(on(50), F.lit("{}")).otherwise(F.col("payload_json"))), key),
        "removed": (rows.where(~on(70)), key),
        "linked wrongly": (rows.withColumn("entry_hash", F.when(on(90), relinked).otherwise(F.col("entry_hash"))).withColumn("prev_hash", F.when(on(90), F.lit("sha256:00")).otherwise(F.col("prev_hash"))), None),
        "other key": (rows, other),
    }
    out = None
    for name, (ledger, k) in cases.items():
        r = chain.verify_chain(ledger, k, "sha256").select(F.lit(name).alias("tampering"), "ok", "rows_checked", "seq", "kind")
        out = r if out is None else out.unionByName(r)
    return out


@query(_LINKS + "\nSELECT seq, sha256('\\x00'::BLOB || encode(entry_hash)) AS leaf_hash FROM c")
def merkle_leaf_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """The leaf of every row of the chain."""
    return chain.leaves(_sha_chain(spark, sf), "sha256").select("seq", F.lower(F.hex("leaf")).alias("leaf_hash"))


@query(
    _LINKS
    + """,
up(level, i, h) AS (SELECT 0, seq - 1, unhex(sha256('\\x00'::BLOB || encode(entry_hash))) FROM c
  UNION ALL SELECT level + 1, i // 2, CASE WHEN count(*) = 2 THEN unhex(sha256('\\x01'::BLOB || first(h ORDER BY i) || last(h ORDER BY i))) ELSE first(h ORDER BY i) END FROM up GROUP BY level, i // 2 HAVING (SELECT count(*) FROM up) > 1)
SELECT 'sha256:' || lower(hex(h)) AS root, (SELECT count(*) FROM c) AS leaf_count FROM up WHERE level = (SELECT max(level) FROM up)"""
)
def merkle_root(spark: SparkSession, sf: str) -> DataFrame:
    """The root over the whole chain."""
    root, n = chain.merkle_root(_sha_chain(spark, sf), digest="sha256", block=64)
    return spark.createDataFrame([(f"sha256:{root.hex()}", n)], "root string, leaf_count long")


@query("SELECT 'write' AS kind, text AS content, CASE WHEN doc_id % 2 = 0 THEN 'mem-' || doc_id END AS memory_id, NULL::VARCHAR AS query, NULL::VARCHAR AS returned FROM documents UNION ALL SELECT 'retrieval', NULL, NULL, text, 'mem-' || turn || '|mem-' || conv_id FROM conversations WHERE role = 'user'")
def adapter_mem0_map(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of a memory client, mapped to writes and retrievals."""
    return calls.mapped(calls.mem0_log(spark, sf), calls.MEM0).select("kind", "content", "memory_id", "query", F.when(F.col("kind") == "retrieval", F.array_join("returned", "|")).alias("returned"))


@query("SELECT 'write' AS kind, text || chr(10) || lang AS content, 'c' || doc_id AS memory_id, NULL::VARCHAR AS query, NULL::VARCHAR AS returned FROM documents UNION ALL SELECT 'retrieval', NULL, NULL, text, 'c' || turn || '|c' || conv_id FROM conversations WHERE role = 'user'")
def adapter_chroma_map(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of a vector store with lists of lists, mapped to writes and retrievals."""
    return calls.mapped(calls.chroma_log(spark, sf), calls.CHROMA).select("kind", "content", "memory_id", "query", F.when(F.col("kind") == "retrieval", F.array_join("returned", "|")).alias("returned"))


_CALLS_LETTA = "SELECT 'write' AS kind, text AS content, 'p' || doc_id AS memory_id, NULL::VARCHAR AS query, NULL::VARCHAR AS returned FROM documents UNION ALL SELECT 'retrieval', NULL, NULL, text, 'p' || turn || '|p' || conv_id FROM conversations WHERE role = 'user'"


@query(_CALLS_LETTA)
def adapter_letta_map(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of an archival memory, mapped to writes and retrievals."""
    return calls.mapped(calls.letta_log(spark, sf), calls.LETTA).select("kind", "content", "memory_id", "query", F.when(F.col("kind") == "retrieval", F.array_join("returned", "|")).alias("returned"))


@query(fixture.EDGES + _BACK.format(depth=99) + "\nSELECT src, dst, edge_type FROM edges WHERE src IN (SELECT node FROM c) AND dst IN (SELECT node FROM c)")
def trace_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges among an action and its ancestors, as drawn in a report."""
    ledger, edges = _edges(spark, sf)
    start = _first_action(ledger)
    return graph.induced(edges, fx.ancestors(edges, start).unionByName(start).distinct()).select("src", "dst", "edge_type")


@query(fixture.ROLLED + "\nSELECT src, dst, edge_type FROM edges2 WHERE edge_type = 'ROLLED_BACK_BY'")
def rollback_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that an applied rollback adds."""
    return _rolled(spark, sf)[1].where("edge_type = 'ROLLED_BACK_BY'")


@query(_W + "\nSELECT record_id, 'trust_score' AS rule FROM ws WHERE (trust_score + CASE WHEN seq % 10 = 1 THEN 0.5 ELSE 0 END) > 1 UNION ALL SELECT record_id, 'trust_level' FROM ws WHERE seq % 50 = 1 UNION ALL SELECT record_id, 'content_size' FROM ws WHERE octet_length(encode(content)) > 8000")
def invariant_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Writes that break an invariant, on a copy of the ledger with some scores and levels spoiled."""
    w = det.writes(fixture.ledger(spark, sf))
    spoiled = w.withColumn("trust_score", F.col("trust_score") + F.when(F.col("seq") % 10 == 1, 0.5).otherwise(0.0)).withColumn("trust_level", F.when(F.col("seq") % 50 == 1, F.lit("none")).otherwise(F.col("trust_level")))
    return records.violations(spoiled, max_content=8000)


_SEED = bytes(range(32))


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as a signed chain."""
    d = read(spark, sf, "documents")
    payload = F.to_json(F.struct(F.lit("write").alias("kind"), F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("record_id"), F.col("lang").alias("namespace"), F.col("text").alias("content"), F.struct(F.col("source").alias("source_id")).alias("source")))
    batch = d.select(F.col("doc_id").alias("order"), F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("record_id"), F.lit("write").alias("kind"), F.col("lang").alias("namespace"), payload.alias("payload_json"), F.lit("2024-01-01T00:00:00+00:00").alias("created_at"))
    return cut(chain.append(batch, _SEED))


@query("SELECT true AS ok, count(*) AS rows_checked FROM documents")
def chain_verified(spark: SparkSession, sf: str) -> DataFrame:
    """A signed BLAKE3 chain over all documents, built and verified."""
    return chain.verify_chain(_chain(spark, sf), ed25519.public_key(_SEED)).select("ok", "rows_checked")


@query("SELECT 'whole' AS state, true AS ok, count(*) AS leaf_count, 'ok' AS detail FROM documents UNION ALL SELECT 'cut short', false, count(*), 'ledger has ' || (count(*) - 3) || ' rows but checkpoint committed ' || count(*) FROM documents UNION ALL SELECT 'changed', false, count(*), 'recomputed root does not match signed checkpoint' FROM documents")
def merkle_verified(spark: SparkSession, sf: str) -> DataFrame:
    """The latest checkpoint against the whole ledger, one without its last rows and one with a changed hash."""
    rows, key = _chain(spark, sf), ed25519.public_key(_SEED)
    point = chain.checkpoint(rows, _SEED, 1, "2024-01-01T00:00:00+00:00")
    n = rows.count()
    cases = {"whole": rows, "cut short": rows.where(F.col("seq") <= n - 3), "changed": rows.withColumn("entry_hash", F.when(F.col("seq") == 2, F.lit("blake3:00")).otherwise(F.col("entry_hash")))}
    out = None
    for name, ledger in cases.items():
        r = chain.verify_merkle(ledger, point, key).select(F.lit(name).alias("state"), "ok", "leaf_count", "detail")
        out = r if out is None else out.unionByName(r)
    return out


@query("SELECT 'w' || doc_id AS record_id, lang AS namespace, source AS source_id, text AS content FROM documents")
def payload_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of the stored payloads."""
    return records.parse(_chain(spark, sf)).select("record_id", "namespace", "source_id", "content")
