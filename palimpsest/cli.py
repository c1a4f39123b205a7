"""Command line: python -m palimpsest.cli COMMAND --profile FOLDER."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile

from pyspark.sql import SparkSession

from palimpsest import export, replay
from palimpsest.operators import graph
from palimpsest.plans import forensics as fx
from palimpsest.plans import similarity as sim
from palimpsest.profile import Profile, home
from palimpsest.sources.tables import id_list

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("version", "init", "demo", "verify", "trace", "blast-radius", "drift", "timeline", "rollback", "report", "reconcile"):
        s = sub.add_parser(name)
        s.add_argument("--profile", default=home())
        if name in ("trace", "report"):
            s.add_argument("--action", required=True)
            s.add_argument("--format", default="md", choices=("md", "json", "mermaid", "dot") if name == "trace" else ("md", "json", "sarif"))
        if name == "blast-radius":
            s.add_argument("--source", required=True)
        if name in ("drift", "timeline"):
            s.add_argument("--topic", required=True)
        if name == "rollback":
            s.add_argument("--to", required=True)
            s.add_argument("--scope")
            s.add_argument("--apply", action="store_true")
            s.add_argument("--reason", default="")
        if name == "reconcile":
            s.add_argument("--ids-file", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit codes: 0 fine, 1 tampering or orphans found, 2 no profile."""
    a = parser().parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    spark = spark or SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "demo":
        r = replay.run(Profile.create(spark, tempfile.mkdtemp(prefix="palimpsest-demo-"), every=1))
        print(f"harmful before: {r['harmful_before']}, after: {r['harmful_after']}; root cause {r['primary']}; blast radius {len(r['blast'])}; rolled back {len(r['affected'])}; verified {r['verified']}")
        return 0 if r["verified"] and not r["harmful_after"] else 1
    if a.command == "init":
        print(Profile.create(spark, a.profile).public_key.hex())
        return 0
    profile = Profile(spark, a.profile)
    if not profile.exists:
        print(f"no profile at {a.profile}; run init first", file=sys.stderr)
        return 2
    if a.command == "verify":
        v = profile.verify().first()
        print(("PASS " if v["ok"] else "FAIL ") + v["summary"])
        return 0 if v["ok"] else 1
    records = profile.records()
    if a.command == "timeline":
        for r in fx.timeline(records, a.topic).orderBy("timestamp", "seq").toLocalIterator():
            print(r["timestamp"], r["kind"], r["record_id"], r["text"][:80])
        return 0
    if a.command == "drift":
        for r in sim.drift_events(records, a.topic).orderBy("timestamp", "seq").toLocalIterator():
            print(r["timestamp"], r["record_id"], r["source_id"], r["trust_level"], r["similarity"])
        return 0
    if a.command == "reconcile":
        orphans = [r["memory_id"] for r in fx.reconcile(records, id_list(spark, a.ids_file)).orderBy("line").collect()]
        print("\n".join(orphans) if orphans else "no orphans")
        return 1 if orphans else 0
    if a.command == "rollback":
        affected, event = profile.rollback(a.to, scope=a.scope, dry_run=not a.apply, reason=a.reason)
        print(f"{'applied ' + event if event else 'dry run'}: {len(affected)} records", *affected, sep="\n")
        return 0
    edges = profile.edges()
    if a.command == "blast-radius":
        found = sorted(r["node"] for r in fx.blast_radius(records, edges, a.source).collect())
        print(f"{len(found)} records", *found, sep="\n")
        return 0
    start = spark.createDataFrame([(a.action,)], "node string")
    roots = fx.trace(records, edges, start).orderBy("rank").collect()
    if a.command == "trace":
        if a.format == "json":
            print(json.dumps({"action_id": a.action, "roots": [r.asDict() for r in roots]}, indent=2))
        elif a.format == "md":
            print("\n".join(f"{r['rank']}. `{r['record_id']}` {r['trust_level']} {r['source_id']} ({r['centrality']})" for r in roots) or "no origin found")
        else:
            nodes = fx.ancestors(edges, start).unionByName(start).distinct()
            triples = sorted((r["src"], r["dst"], r["edge_type"]) for r in graph.induced(edges, nodes).collect())
            print(export.mermaid(triples) if a.format == "mermaid" else export.dot(triples))
        return 0
    if a.format == "sarif":
        print(json.dumps(export.sarif(profile.findings(), VERSION), indent=2))
        return 0
    selector = roots[0]["source_id"] if roots else a.action
    blast = fx.blast_radius(records, edges, selector).count()
    affected, _ = profile.rollback(selector)
    v = profile.verify().first()
    if a.format == "json":
        print(json.dumps({"action_id": a.action, "roots": [r.asDict() for r in roots], "blast_radius": blast, "rollback": affected, "integrity": v.asDict()}, indent=2))
    else:
        print(export.incident_markdown(a.action, roots, blast, affected, None, v["ok"], v["summary"]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
