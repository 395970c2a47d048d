"""python -m tracewell COMMAND --repo PATH --store PATH: the workspace's reading commands, a table or JSON lines each.

Exit codes: 0, 1 for wrong use, 2 where nothing was recorded.
"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewell")
    p.add_argument("--repo", default=".")
    p.add_argument("--store", default=".tracewell")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"log": ["-n"], "report": ["--format"], "show": ["target"], "blame": ["place"], "ask": ["question"], "export": [], "doctor": [], "reindex": [], "adopt": []}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .plans.report import render_html, render_markdown
    from .plans.workspace import TargetError, Workspace

    spark = SparkSession.builder.appName("tracewell").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    w = Workspace(spark, args.repo, args.store)
    try:
        if args.command == "report":
            r = w.report()
            rows, sums = [x.asDict() for x in r["timeline"].orderBy("walk_pos").limit(300).collect()], r["totals"].first().asDict()
            print((render_html if args.format == "html" else render_markdown)(rows, sums))
            return 0
        if args.command == "blame":
            path, _, line = args.place.rpartition(":")
            df = w.blame(path, int(line))
        else:
            df = {"log": lambda: w.log(**({"limit": args.n} if args.n else {})), "show": lambda: w.show(args.target), "ask": lambda: w.ask(args.question), "export": w.export, "doctor": w.doctor, "reindex": w.reindex, "adopt": w.adopt}[args.command]()
    except (TargetError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    rows = df.toJSON().toLocalIterator() if args.json or args.command == "export" else (" | ".join(map(str, r)) for r in df.toLocalIterator())
    n = 0
    for n, row in enumerate(rows, 1):  # noqa: B007
        print(row)
    return 2 if not n and args.command in ("show", "blame", "ask", "export") else 0


if __name__ == "__main__":
    sys.exit(main())
