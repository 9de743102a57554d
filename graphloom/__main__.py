"""``python -m graphloom COMMAND --graph graph.json ...``: one answer as JSON; exit code 0, 1 on an error, 2 where edges differ."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .api import Session, exit_code
from .operators.rank import ORDERS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description="Questions about a property graph.")
    p.add_argument("--graph", required=True, help="a graph.json, or a folder with nodes and edges")
    p.add_argument("--root", help="the source tree")
    p.add_argument("--master", default=None, help="Spark master, local[*] unless set")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        for key, value in options.items():
            flag = "--" + key.replace("_", "-")
            if isinstance(value, bool):
                s.add_argument(flag, action="store_true", dest=key)
            elif isinstance(value, tuple):
                s.add_argument(flag, action="append", default=None, dest=key)
            else:
                s.add_argument(flag, type=int if isinstance(value, int) else str, default=value, dest=key)
        return s

    add("search", "query", limit=25)
    add("relations")
    add("blast-radius", "query", depth=2, direction="up", relations=(), max_nodes=500, containment=False)
    add("overrides", "query")
    add("triage", "report", depth=2, max_nodes=300)
    add("context", "query", budget=6000, index_budget=300, order=ORDERS[0], depth=2)
    add("inject", "findings", kind="neutral", rules=(), assume_taint=False, out=None)
    add("test-link", strip_dots=False)
    add("config-scan")
    add("supplement", out=None)
    add("edge-diff", "action", "query", "snapshot")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = vars(parser().parse_args(argv))
    path, root, master, command = (args.pop(k) for k in ("graph", "root", "master", "command"))
    if spark is None:
        builder = SparkSession.builder.appName("graphloom")
        spark = (builder.master(master) if master else builder).getOrCreate()
    args = {k: tuple(v) if isinstance(v, list) else v for k, v in args.items() if v is not None}
    answer = getattr(Session(spark, path, root), command.replace("-", "_"))(**args)
    print(json.dumps(answer, indent=1, default=str))
    return exit_code(answer)


if __name__ == "__main__":
    sys.exit(main())
