"""Deterministic exports of plans and results.

Documents (JSON, Markdown, HTML, context for language models) hold collected rows and are for results of a size that a
person reads; ``MOST_ROWS`` bounds each family, and a larger one raises.  ``write_lines`` writes any number of rows.
"""

from __future__ import annotations

import html
import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.comparison import Builder, Result
from ..plans.comparison import Plan, catalog

MOST_ROWS = 100_000
SCHEMA = "tidemark.comparison"


class ExportError(ValueError):
    """The plan holds selectors that only exist at run time."""


def guard(plan: Plan) -> None:
    if not plan.serializable():
        raise ExportError("; ".join(f"{d.code}: {d.message}" for d in plan.validate() if d.code == "NonSerializableSelector"))


def _dump(document: dict) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False, default=str)


def plan_document(plan: Plan) -> dict:
    selector = lambda s: None if s is None else {"name": s.name, "description": s.description, "isSerializable": s.serializable}
    n = plan.normalization
    return {
        "schema": f"{SCHEMA}.plan", "schemaVersion": 0, "name": plan.name, "isStrict": plan.strict, "target": selector(plan.target), "against": [selector(s) for s in plan.against],
        "scope": None if plan.scope is None else {"window": plan.scope.window, "segments": [list(x) for x in plan.scope.segments], "tags": [list(x) for x in plan.scope.tags], "key": plan.scope.key, "partition": plan.scope.partition, "axis": plan.scope.axis},
        "normalization": {"axis": n.axis, "openWindowPolicy": n.open_policy, "openWindowHorizon": n.horizon, "nullTimestampPolicy": n.null_time, "knownAt": n.known_at, "coalesceAdjacent": n.coalesce_adjacent, "duplicateWindowPolicy": n.duplicates},
        "comparators": list(plan.comparators),
    }


def plan_json(plan: Plan) -> str:
    guard(plan)
    return _dump(plan_document(plan))


def _collected(rows: DataFrame) -> list[dict]:
    ordered = rows.orderBy(*[c for c, kind in rows.dtypes if not kind.startswith("array")], *[F.array_join(c, "|") for c, kind in rows.dtypes if kind == "array<string>"])
    found = [r.asDict(True) for r in ordered.limit(MOST_ROWS + 1).collect()]
    if len(found) > MOST_ROWS:
        raise ExportError(f"more than {MOST_ROWS} rows: write them with write_lines")
    return found


def families(result: Result) -> dict[str, list[dict]]:
    """Rows of each comparator in order; ``rowId`` is the comparator's name and the row's place."""
    return {d.text: [{"rowId": f"{d.name}[{i}]", **r} for i, r in enumerate(_collected(result.rows(d.text)))] for d in result.declarations}


def result_document(result: Result) -> dict:
    guard(result.plan)
    rows = families(result)
    return {
        "schema": f"{SCHEMA}.result", "schemaVersion": 0, "isValid": result.is_valid, "plan": plan_document(result.plan),
        "diagnostics": [{"code": d.code, "severity": d.severity, "message": d.message, "path": d.path} for d in result.diagnostics],
        "excluded": _collected(result.excluded) if result.plan.target is not None else [],
        "summaries": [{"comparatorName": name, "rowCount": len(r)} for name, r in rows.items()],
        "coverageSummaries": _collected(result.coverage_summary()) if "coverage" in rows else [], "leadLagSummaries": [r for found in result.lead_lag_summaries() for r in _collected(found)], "rows": rows,
    }


def result_json(result: Result) -> str:
    return _dump(result_document(result))


def lines(result: Result) -> DataFrame:
    """One JSON text a row: the summary, then the families' rows in the catalog's order."""
    guard(result.plan)
    out = result.summary().select(F.to_json(F.struct(F.lit("summary").alias("type"), "*")).alias("value"))
    for d in sorted(result.declarations, key=lambda d: catalog().index(d.name)):
        rows = result.rows(d.text)
        out = out.union(rows.select(F.to_json(F.struct(F.lit(d.name).alias("type"), *rows.columns)).alias("value")))
    return out


def write_lines(result: Result, path: str) -> None:
    lines(result).write.text(path)


def explain_plan(plan: Plan, markdown: bool = True) -> str:
    """The plan by itself; no job is run."""
    h, n = "## " if markdown else "", plan.normalization
    found = plan.validate() + plan.criticise()
    out = [f"{'# ' if markdown else ''}Plan {plan.name}", "", f"{h}Selectors", f"- target: {plan.target.description if plan.target else 'none'}", *[f"- against: {s.description}" for s in plan.against]]
    out += ["", f"{h}Scope", *([f"- {k}: {v}" for k, v in vars(plan.scope).items() if v] if plan.scope else ["- all windows"])]
    out += ["", f"{h}Normalization", *[f"- {k}: {v}" for k, v in vars(n).items()], "", f"{h}Comparators", *([f"- {c}" for c in plan.comparators] or ["- none"])]
    return "\n".join([*out, "", f"{h}Diagnostics", *([f"- {d.severity} {d.code}: {d.message}" for d in found] or ["- none"]), ""])


def explain_prepared(result: Result, markdown: bool = True) -> str:
    """What became of the windows, and how many each selector takes; both are counted where the windows are."""
    h = "## " if markdown else ""
    left_out = result.excluded.groupBy("severity", "code").agg(F.count("*").alias("n")).collect()  # as many rows as codes
    taken = result.normalized.groupBy("side", "selector").agg(F.count("*").alias("n"), F.count_if("provisional").alias("open")).collect()  # a row for each selector
    out = [f"{'# ' if markdown else ''}Prepared {result.plan.name}", "", f"{h}Excluded", *([f"- {r.severity} {r.code}: {r.n}" for r in sorted(left_out)] or ["- none"])]
    return "\n".join([*out, "", f"{h}Selected", *([f"- {r.side} {r.selector}: {r.n} windows, {r.open} clipped" for r in sorted(taken, key=lambda r: (r.side != 'Target', r.selector))] or ["- none"]), ""])


def explain_aligned(result: Result, markdown: bool = True) -> str:
    """Segments by what is active in them."""
    h, t, a = "## " if markdown else "", F.size("targets") > 0, F.size("againsts") > 0
    kind = F.when(t & a, "both sides").when(t, "target only").otherwise("against only")
    found = result.segments.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col("range_end") - F.col("range_start")).alias("length")).orderBy("kind").collect()
    return "\n".join([f"{'# ' if markdown else ''}Aligned {result.plan.name}", "", f"{h}Segments", *([f"- {r.kind}: {r.n}, length {r.length}" for r in found] or ["- none"]), ""])


def explain(result: Result, markdown: bool = True) -> str:
    """Plan, diagnostics and row counts in stages."""
    h = "## " if markdown else ""
    counts = {r.comparator: r.row_count for r in result.summary().collect()} if result.declarations else {}
    p = result.plan
    out = [f"{'# ' if markdown else ''}Comparison {p.name}", "", f"{h}Plan", f"- target: {p.target.description if p.target else 'none'}", *[f"- against: {s.description}" for s in p.against], f"- scope: {(p.scope.window if p.scope else None) or 'all windows'}", f"- comparators: {', '.join(p.comparators)}"]
    out += ["", f"{h}Diagnostics", *([f"- {d.severity} {d.code}: {d.message}" for d in result.diagnostics] or ["- none"])]
    out += ["", f"{h}Rows", *[f"- {name}: {n}" for name, n in sorted(counts.items())], "", f"valid: {str(result.is_valid).lower()}", ""]
    return "\n".join(out)


def markdown(result: Result) -> str:
    guard(result.plan)
    return explain(result)


def debug_html(result: Result) -> str:
    """A page of its own: summary, a timeline bar for each row with a range, the windows' contexts as bands, aligned segments,
    diagnostics, the plan."""
    guard(result.plan)
    rows = families(result)
    ranged = [(name, r) for name, found in rows.items() for r in found if r.get("range_start") is not None]
    low, high = min((r["range_start"] for _, r in ranged), default=0), max((r["range_end"] for _, r in ranged), default=1)
    scale = 100 / max(1, high - low)
    bars = "".join(
        f'<div class="r"><span>{html.escape(name)} {html.escape(str(r.get("key", "")))}</span><i style="margin-left:{(r["range_start"] - low) * scale:.2f}%;width:{max(0.2, (r["range_end"] - r["range_start"]) * scale):.2f}%" title="[{r["range_start"]}, {r["range_end"]})"></i></div>'
        for name, r in ranged
    )
    context = F.array_join(F.transform("segments", lambda s: F.concat(s["name"], F.lit("="), F.coalesce(s["value"], F.lit("none")))), ", ")
    cells = lambda values: "<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in values) + "</tr>"
    bands = "".join(cells(r.values()) for r in _collected(result.normalized.where("size(segments) > 0").select("key", "range_start", "range_end", "side", "source", context.alias("context"))))
    aligned = "".join(cells(r.values()) for r in _collected(result.segments.select("key", "range_start", "range_end", F.size("targets").alias("targets"), F.size("againsts").alias("againsts"))))
    summary = "".join(f"<tr><td>{html.escape(name)}</td><td>{len(found)}</td></tr>" for name, found in rows.items())
    notes = "".join(f"<li>{html.escape(d.severity)} {html.escape(d.code)}: {html.escape(d.message)}</li>" for d in result.diagnostics)
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(result.plan.name)}</title><style>.r{{font:12px sans-serif}}.r i{{display:block;height:8px;background:#47c}}</style><h1>{html.escape(result.plan.name)}</h1><table>{summary}</table><section id="timeline">{bars}</section><h2>Contexts</h2><table id="bands">{bands}</table><h2>Aligned segments</h2><table id="aligned">{aligned}</table><h2>Diagnostics</h2><ul>{notes}</ul><h2>Plan</h2><pre id="metadata">{html.escape(_dump(plan_document(result.plan)))}</pre>'


def llm_context(result: Result) -> str:
    """Instructions, summary, Markdown, the full result and a document for each row."""
    full = result_document(result)
    text = lambda r: "; ".join(f"{k}: {v}" for k, v in r.items() if k != "rowId" and v is not None)
    rows = [{"id": r["rowId"], "family": name, "text": text(r)} for name, found in full["rows"].items() for r in found]
    return _dump({
        "schema": f"{SCHEMA}.context", "instructions": "Ranges are half-open. Rows are evidence; do not infer rows that are not listed.", "summary": full["summaries"],
        "markdown": markdown(result), "result": full, "rowDocuments": rows,
    })


@dataclass(frozen=True)
class ExportOptions:
    """What a run writes besides its result: files of the driver's file system, or nothing where no path is given."""

    html: str | None = None
    llm: str | None = None

    def __post_init__(self):
        if any(path is not None and not path.strip() for path in (self.html, self.llm)):
            raise ValueError("a path to export to is not blank")


def run(builder: Builder, options: ExportOptions, horizon=None) -> Result:
    """Run the comparison (live, if a horizon is given) and write what the options ask for."""
    result = builder.run() if horizon is None else builder.run_live(horizon)
    for path, text in ((options.html, debug_html), (options.llm, llm_context)):
        if path is not None:
            os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(text(result))
    return result


def audit_bundle(result: Result, folder: str) -> dict:
    """comparison.json, .md, .html, .llm.json and manifest.json in a folder of the driver's file system."""
    os.makedirs(folder, exist_ok=True)
    texts = {"comparison.json": result_json(result), "comparison.md": markdown(result), "comparison.html": debug_html(result), "comparison.llm.json": llm_context(result)}
    for name, text in texts.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    document = json.loads(texts["comparison.json"])
    provisional = sum(r.get("finality") == "Provisional" for rows in document["rows"].values() for r in rows)
    manifest = {"schema": f"{SCHEMA}.audit", "isValid": result.is_valid, "artifacts": sorted(texts), "rowCounts": {s["comparatorName"]: s["rowCount"] for s in document["summaries"]}, "provisionalRowCount": provisional}
    with open(os.path.join(folder, "manifest.json"), "w", encoding="utf-8") as f:
        f.write(_dump(manifest))
    return manifest
