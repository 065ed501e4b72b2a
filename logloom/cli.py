"""Commands: report, detectors, explain, bind.

    python -m logloom.cli report --root DIR [--by rule|repo|stance] [--since DAY] [--stance a=b] [--detectors FILE] [--json]
    python -m logloom.cli explain --root DIR [--session ID] [--detector ID] [--key TURN:CALL]
    python -m logloom.cli bind --rules FILE [--rules FILE ...]
    python -m logloom.cli detectors [--detectors FILE]

Exit codes: 0 done, 1 done with problems reported, 2 not possible.
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys


def since(text: str) -> str | int:
    """A day, or a number of days of up to three digits (a bare year would be ambiguous)."""
    if re.fullmatch(r"\d{1,3}", text):
        return int(text)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return text
    raise argparse.ArgumentTypeError("a day YYYY-MM-DD or a number of days")


def stance(text: str) -> tuple[str, str]:
    name, eq, value = text.partition("=")
    if not (name and eq and value):
        raise argparse.ArgumentTypeError("DIMENSION=VARIANT")
    return name, value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logloom")
    sub = p.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--detectors", action="append", default=[], metavar="FILE")
    shared.add_argument("--no-config", action="store_true", help="the shipped detectors only")
    shared.add_argument("--plugins", action="store_true")
    scan = argparse.ArgumentParser(add_help=False)
    scan.add_argument("--root", required=True)
    scan.add_argument("--runtime", choices=("claude-code", "codex", "gemini"))
    scan.add_argument("--since", type=since)
    scan.add_argument("--stance", type=stance, action="append", default=[])
    r = sub.add_parser("report", parents=[shared, scan])
    r.add_argument("--by", choices=("rule", "repo", "stance"), default="rule")
    r.add_argument("--min-sessions", type=int, default=20)
    r.add_argument("--frequent-share", type=float, default=0.30)
    r.add_argument("--min-opportunities", type=int, default=20)
    r.add_argument("--json", action="store_true")
    e = sub.add_parser("explain", parents=[shared, scan])
    e.add_argument("--session")
    e.add_argument("--detector")
    e.add_argument("--key")
    b = sub.add_parser("bind")
    b.add_argument("--rules", action="append", required=True, metavar="FILE")
    b.add_argument("--json", action="store_true")
    sub.add_parser("detectors", parents=[shared])
    return p


def _registry(args):
    from logloom import registry
    from logloom.plans import yamlsubset

    found = registry.default()
    for path in [] if args.no_config else args.detectors:
        try:
            found.extend(yamlsubset.entries(yamlsubset.load(path)))
        except (OSError, ValueError) as e:
            found.errors.append((path, str(e)))
    if args.plugins:
        found.load_plugins()
    return found


def _show(rows: list[dict], as_json: bool) -> None:
    if as_json:
        print(json.dumps(rows, sort_keys=True, default=str))
        return
    if not rows:
        print("nothing")
        return
    names = list(rows[0])
    cells = [[("" if r[n] is None else f"{r[n]:.2f}" if isinstance(r[n], float) else ", ".join(r[n]) if isinstance(r[n], list) else str(r[n])) for n in names] for r in rows]
    widths = [max(len(n), *(len(c[k]) for c in cells)) for k, n in enumerate(names)]
    for line in [names, *cells]:
        print("  ".join(c.ljust(w) for c, w in zip(line, widths)).rstrip())


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "detectors":
        found = _registry(args)
        _show([{"detector": d.id, "rule": d.rule, "event": d.event, "gate": "=".join([d.gate[0], "|".join(d.gate[1] or ["*"])]) if d.gate else ""} for d in found.detectors()], False)
        for name, reason in found.errors:
            print(f"{name}: {reason}", file=sys.stderr)
        return int(bool(found.errors))
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    if args.command == "bind":
        from logloom.detectors import SHAPES
        from logloom.operators.binder import bind_rules

        try:
            files = [(p, open(p, encoding="utf-8-sig").read()) for p in args.rules]
        except OSError as e:
            print(e, file=sys.stderr)
            return 2
        _show([r.asDict() for r in bind_rules(spark.createDataFrame(files, "path string, text string"), SHAPES).orderBy("path", "anchor").collect()], args.json)
        return 0
    if not os.path.isdir(args.root):
        print(f"{args.root}: no such folder", file=sys.stderr)
        return 2
    from logloom.operators import explain, measure
    from logloom.sources.sessions import scan
    from logloom.storage import materialize

    found = _registry(args)
    data = scan(spark, args.root, args.runtime, args.since)
    only = {args.detector} if args.command == "explain" and args.detector else None
    detectors, stances = found.detectors(only), dict(args.stance)
    events = data.events
    if args.command == "explain" and args.session:  # filters reach the events before anything is parsed
        from pyspark.sql import functions as F

        events = events.where((F.col("session_id") == args.session) | (F.concat_ws(":", "runtime", "session_id") == args.session))
    events = materialize(measure.parsed_events(events), "events")
    if args.command == "explain":
        hits = measure.find_hits(events, detectors, stances)
        _show([r.asDict() for r in explain.explain(hits, events, args.session, args.detector, args.key).collect()], False)
        return 0
    rows = materialize(measure.measure(data.sessions, events, detectors, stances), "rows")
    if args.by == "rule":
        out = measure.report_by_rule(rows, [d.id for d in detectors], found.fold(), args.min_sessions, args.frequent_share, args.min_opportunities).orderBy("detector")
    else:
        out = measure.report_by_group(rows, args.by).orderBy("key")
    _show([r.asDict() for r in out.collect()], args.json)
    problems = [(r["path"], r["error"]) for r in data.errors.orderBy("path").collect()] + found.errors
    for name, reason in problems:
        print(f"{name}: {reason}", file=sys.stderr)
    return int(bool(problems))


if __name__ == "__main__":
    sys.exit(main())
