"""The operators as calls that answer with an envelope: ``status``, ``summary`` and rows.

Errors are data: an unknown seed or an unreadable graph gives ``status: error``
with what could have been meant, never an exception. ``partial`` says that a
limit cut the answer short or that some findings could not be placed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import diff, edges as E, pack, resolve, supplement, symbols, traverse, triage
from .schema import MEMBER_RELATIONS, TRAVERSAL_RELATIONS
from .sinks import tables
from .sources import files, graph as G, scanners

#: Rows an answer shows of a list; ``count`` tells how many there are.
SHOWN = 200


class Unresolved(Exception):
    def __init__(self, query: str, near: list[dict]) -> None:
        super().__init__(f"{query!r} names no single node")
        self.near = near


def enveloped(fn: Callable[..., dict]) -> Callable[..., dict]:
    @wraps(fn)
    def run(*args, **more) -> dict:
        try:
            found = fn(*args, **more)
        except Unresolved as e:
            return {"status": "error", "summary": str(e), "candidates": e.near}
        except (KeyError, ValueError, OSError) as e:
            return {"status": "error", "summary": str(e)}
        return {"status": "ok"} | found

    return run


def _rows(df: DataFrame, *order: str) -> dict:
    """Some rows and the number of all."""
    rows = (df.orderBy(*order) if order else df).limit(SHOWN + 1).collect()
    return {"rows": [r.asDict(True) for r in rows[:SHOWN]], "count": df.count() if len(rows) > SHOWN else len(rows)}


@dataclass
class Session:
    """A graph and, where operators read sources, the root of the tree it was made from."""

    spark: SparkSession
    path: str
    root: str | None = None

    def graph(self) -> G.Graph:
        if self.path.endswith(".json"):
            if not G.readable(self.spark, self.path):
                raise ValueError(f"{self.path} is no readable graph")
            return G.read_graph(self.spark, self.path)
        return G.Graph(self.spark.read.parquet(f"{self.path}/nodes"), self.spark.read.parquet(f"{self.path}/edges"))

    def files(self) -> DataFrame:
        if not self.root:
            raise ValueError("a root folder is needed to read sources")
        return files.scan(self.spark, self.root)

    def _asked(self, *queries: str) -> DataFrame:
        return self.spark.createDataFrame([(q, q) for q in queries], "query_id string, query string")

    def seeds(self, g: G.Graph, *queries: str) -> DataFrame:
        """``query_id, id`` of queries that each name one node."""
        found = {r.query_id: r.id for r in resolve.resolve(self._asked(*queries), g.nodes).select("query_id", "id").collect()}
        for q in queries:
            if q not in found:
                near = resolve.candidates(self._asked(q), g.nodes, 10).join(g.nodes.select("id", "label", "source_file"), "id").orderBy("rank")
                raise Unresolved(q, [r.asDict() for r in near.select("id", "label", "source_file", "match").collect()])
        return self.spark.createDataFrame([(q, found[q]) for q in queries], "query_id string, id string")

    @enveloped
    def search(self, query: str, limit: int = 25) -> dict:
        g = self.graph()
        out = resolve.candidates(self._asked(query), g.nodes, limit).join(g.nodes.select("id", "label", "source_file", "source_location"), "id").drop("query_id")
        found = _rows(out, "rank")
        return {"summary": f"{found['count']} candidates for {query!r}"} | found

    @enveloped
    def relations(self) -> dict:
        counted = self.graph().edges.groupBy("relation").agg(F.count("*").alias("n"), F.min("edge_pos").alias("first"))
        found = _rows(counted.withColumn("followed", F.col("relation").isin(*TRAVERSAL_RELATIONS)).orderBy(F.desc("n"), "first").drop("first"))
        return {"summary": f"{found['count']} relations"} | found

    @enveloped
    def blast_radius(self, query: str, depth: int = 2, direction: str = "up", relations: tuple[str, ...] = (), max_nodes: int | None = 500, containment: bool = False) -> dict:
        g = self.graph()
        followed = traverse.relation_set(relations or TRAVERSAL_RELATIONS, MEMBER_RELATIONS if containment else ())
        reach = traverse.radius(g.nodes, g.edges, self.seeds(g, query), depth, direction, followed, max_nodes)
        closure = traverse.closure_edges(g.edges, reach)
        found = _rows(traverse.ordered(reach).join(g.nodes.select("id", "label", "source_file"), "id").drop("query_id"), "pos")
        exposed = [r.id for r in traverse.taint_exposed(closure)[1].orderBy("id").limit(SHOWN).collect()]
        cut = bool(found["rows"] and found["rows"][0]["truncated"])
        return {"status": "partial" if cut else "ok", "summary": f"{found['count']} nodes within {depth} hops {direction}" + (", truncated" if cut else ""), "edges": closure.count(), "taint_exposed": exposed} | found

    @enveloped
    def overrides(self, query: str) -> dict:
        g = self.graph()
        found = _rows(traverse.overrides(g.nodes, g.edges, self.seeds(g, query)).drop("query_id"), "owning_class", "id")
        return {"summary": f"{found['count']} overrides of {query!r}"} | found

    @enveloped
    def triage(self, report: str, depth: int = 2, max_nodes: int | None = 300, relations: tuple[str, ...] = TRAVERSAL_RELATIONS) -> dict:
        g = self.graph()
        out = triage.triage(G.read_report(self.spark, report), g.nodes, g.edges, depth, relations=relations, max_nodes=max_nodes).cache()
        lost = out.where("seed is null").count()
        lines = [r.text for r in triage.summarize(out).orderBy("query_id").collect()]
        return {"status": "partial" if lost else "ok", "summary": "\n".join(lines)} | _rows(out, "query_id")

    @enveloped
    def context(self, query: str, budget: int = 6000, index_budget: int = 300, order: str = "mention-first", depth: int = 2) -> dict:
        g, tree = self.graph(), self.files()
        defs = symbols.definitions(tree)
        p = pack.context_pack(g.nodes, g.edges, self.seeds(g, query), tree, defs, depth, budget=budget, index_budget=index_budget, order=order)
        text = pack.render(p, tree).head()
        found = _rows(p.rows.drop("query_id"), "rank")
        lists = {name: _rows(getattr(p, name).drop("query_id"))["rows"] for name in ("unresolved", "omitted", "unmodelled", "tests", "call_sites", "siblings")}
        partial = bool(lists["omitted"] or lists["unresolved"])
        return {"status": "partial" if partial else "ok", "summary": f"{sum(r['tier'] == 'body' for r in found['rows'])} bodies; tokens counted as chars/4", "text": text.text if text else ""} | found | lists

    def _merged(self, g: G.Graph, findings: DataFrame, out: str | None) -> dict:
        merged, report = E.merge(g.edges, E.validated(E.resolve_findings(findings, g.nodes)))
        counts = {r.reason: r.n for r in report.collect()}
        if out:
            tables.write_graph(G.Graph(g.nodes, merged.withColumn("edge_pos", F.coalesce("edge_pos", F.lit(1 << 40)))), out)
        refused = {k: n for k, n in counts.items() if k not in ("applied", "removed")}
        return {"status": "partial" if refused else "ok", "summary": ", ".join(f"{k} {n}" for k, n in sorted(counts.items())), "report": counts}

    @enveloped
    def inject(self, findings: str, kind: str = "neutral", rules: tuple[str, ...] = (), assume_taint: bool = False, out: str | None = None) -> dict:
        """``kind``: neutral, semgrep, flows or coverage."""
        g = self.graph()
        read = {
            "neutral": lambda: G.read_findings(self.spark, findings), "semgrep": lambda: scanners.semgrep_findings(scanners.read_semgrep(self.spark, findings), rules, assume_taint)[0],
            "flows": lambda: scanners.flow_findings(scanners.read_flows(self.spark, findings)),
            "coverage": lambda: scanners.coverage_findings(scanners.read_coverage(self.spark, findings)).select("*", F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("double").alias("confidence_score"), F.lit(False).alias("skip_self"), F.monotonically_increasing_id().alias("pos")),
        }
        if kind not in read:
            raise ValueError(f"kind must be one of {sorted(read)}, not {kind!r}")
        return self._merged(g, read[kind](), out)

    @enveloped
    def test_link(self, strip_dots: bool = False) -> dict:
        found = _rows(E.unique_name_links(self.graph().nodes, strip_dots), "test_id")
        return {"summary": f"{found['count']} tests named after one node"} | found

    @enveloped
    def config_scan(self) -> dict:
        tree = self.files()
        links = files.env_reads(tree).select(F.struct("file", "line").alias("source"), "key")
        found = _rows(E.key_links(links, files.env_definitions(tree).select(F.struct("file", "line").alias("target"), "key")), "key")
        return {"summary": f"{found['count']} reads of defined variables"} | found

    @enveloped
    def supplement(self, out: str | None = None) -> dict:
        g = self.graph()
        nodes, edges, skipped = supplement.compute(g.nodes, symbols.definitions(self.files()))
        if out:
            tables.write_graph(G.Graph(g.nodes.unionByName(nodes, allowMissingColumns=True), g.edges.unionByName(edges, allowMissingColumns=True)), out)
        reasons = {r.supplement_reason: r["count"] for r in nodes.groupBy("supplement_reason").count().collect()}
        return {"summary": f"{sum(reasons.values())} nodes, {edges.count()} edges, {skipped.count()} skipped", "reasons": reasons}

    @enveloped
    def edge_diff(self, action: str, query: str, snapshot: str) -> dict:
        """``snapshot`` keeps a node's edges; ``check`` holds them against what they are now."""
        g = self.graph()
        prints = diff.fingerprints(g.edges, self.seeds(g, query).select("id"))
        if action == "snapshot":
            tables.write_snapshot(prints, snapshot)
            return {"summary": f"edges of {query!r} kept"}
        if action != "check":
            raise ValueError(f"action must be snapshot or check, not {action!r}")
        found = _rows(diff.fingerprint_diff(self.spark.read.parquet(snapshot), prints), "id")
        return {"summary": "no difference" if not found["count"] else f"edges of {found['count']} nodes differ", "clean": not found["count"]} | found


def exit_code(answer: dict) -> int:
    """0, 1 on an error, 2 where edges differ."""
    return 1 if answer["status"] == "error" else 2 if answer.get("clean") is False else 0
