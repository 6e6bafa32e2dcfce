"""Command line: ``validate-plan``, ``compare``, ``explain``, ``audit`` over a fixture, ``audit-windows`` over JSON lines.

Exit codes: 0 valid, 1 an invalid result, 2 usage, input or parse errors (a JSON error on stderr).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .operators.comparison import compare
from .plans.comparison import Normalization, Plan, Scope, Selector
from .sources import exports
from .sources.windows import fixture, read_jsonl


class _Usage(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise _Usage(message)


def _parser() -> argparse.ArgumentParser:
    p = _Parser(prog="tidemark", add_help=False)
    commands = p.add_subparsers(dest="command", required=True, parser_class=_Parser)
    for name in ("validate-plan", "compare", "explain", "audit"):
        c = commands.add_parser(name)
        c.add_argument("fixture")
        if name == "compare":
            c.add_argument("--format", choices=("json", "markdown", "llm-context"), default="json")
        if name == "audit":
            c.add_argument("--out", required=True)
    c = commands.add_parser("audit-windows")
    c.add_argument("windows")
    c.add_argument("--target", required=True)
    c.add_argument("--against", required=True, action="append")
    c.add_argument("--window")
    c.add_argument("--comparator", action="append")
    c.add_argument("--live-horizon", type=int)
    c.add_argument("--strict", action="store_true")
    c.add_argument("--out", required=True)
    return p


def main(args: list[str], spark: SparkSession | None = None, out=sys.stdout, err=sys.stderr) -> int:
    try:
        a = _parser().parse_args(args)
        spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if a.command == "audit-windows":
            windows = read_jsonl(spark, a.windows, a.window)
            n = Normalization(open_policy="ClipToHorizon", horizon=a.live_horizon) if a.live_horizon is not None else Normalization()
            plan = Plan("audit", Selector.for_source(a.target), tuple(map(Selector.for_source, a.against)), Scope(a.window), n, tuple(a.comparator or ("overlap", "residual", "coverage")), a.strict)
        else:
            with open(a.fixture, encoding="utf-8") as f:
                windows, plan, _ = fixture(spark, f.read())
        if a.command == "validate-plan":
            found = plan.validate()
            print(json.dumps({"isValid": not any(d.severity == "Error" for d in found), "diagnostics": [d.code for d in found], "plan": exports.plan_document(plan)}, indent=2), file=out)
            return int(any(d.severity == "Error" for d in found))
        result = compare(windows, plan)
        if a.command == "compare":
            print({"json": exports.result_json, "markdown": exports.markdown, "llm-context": exports.llm_context}[a.format](result), file=out)
        elif a.command == "explain":
            print(exports.explain(result), file=out)
        else:
            print(json.dumps(exports.audit_bundle(result, a.out), indent=2), file=out)
        return 0 if result.is_valid else 1
    except (_Usage, OSError, ValueError, PySparkException) as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e)}), file=err)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
