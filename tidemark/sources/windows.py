"""Windows from JSON lines, contract fixtures and hand-made rows."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..plans.comparison import Activity, Normalization, Plan, Scope, Selector, as_of, lead_lag

_VALUE = "array<struct<name:string,value:string,parentName:string>>"
LINE = f"windowName string, key string, source string, partition string, startPosition long, endPosition long, segments {_VALUE}, tags {_VALUE}"


def read_jsonl(spark: SparkSession, path: str, window: str | None = None) -> DataFrame:
    """One window a line; blank lines are skipped, a missing end is open, ``window`` names those without a name.

    A line that is no window fails the job that reads it; the message names the JSON path, the file and the line's text
    (lines of a distributed file have no number).
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"), F.from_json("value", f"{LINE}, _bad string", options).alias("w"))
    rows = rows.select("value", "file", "w.*").withColumn("windowName", F.coalesce("windowName", F.lit(window)))
    wrong = [
        (F.col("_bad").isNotNull(), "$: expected a window"), (F.coalesce(F.trim("windowName"), F.lit("")) == "", "$.windowName: missing, and no window is named"),
        *[(F.col(c).isNull(), f"$.{c}: missing") for c in ("key", "source", "startPosition")],
        (F.coalesce(F.col("endPosition") < F.col("startPosition"), F.lit(False)), "$.endPosition: before startPosition"),
    ]
    message = F.coalesce(*[F.when(condition, F.lit(text)) for condition, text in wrong])
    failed = F.raise_error(F.concat(message, F.lit(" in "), "file", F.lit(": "), F.substring("value", 1, 200))).cast("boolean")
    rows = rows.where(F.when(message.isNotNull(), failed).otherwise(True))
    part = lambda c, kind: F.coalesce(F.transform(c, lambda s: F.struct(s["name"].alias("name"), F.lit("string").alias("value_type"), s["value"].alias("value"), *([s["parentName"].alias("parent_name")] if kind == "segment" else []))), schema.no_segments() if kind == "segment" else schema.no_tags())
    named = rows.select(F.col("windowName").alias("window_name"), "key", "source", "partition", F.col("startPosition").alias("start_position"), F.col("endPosition").alias("end_position"), part("segments", "segment").alias("segments"), part("tags", "tag").alias("tags"))
    return schema.completed(named)


def typed(value: object) -> tuple[str, str | None]:
    if isinstance(value, bool):
        return "bool", str(value).lower()
    return ("long" if isinstance(value, int) else "double" if isinstance(value, float) else "string"), None if value is None else str(value)


@dataclass
class HistoryBuilder:
    """Windows without events, for tests and fixtures."""

    rows: list[tuple] = field(default_factory=list)

    def closed(self, window: str, key: str, start: int, end: int, source: str | None = None, partition: str | None = None, segments=(), tags=()) -> HistoryBuilder:
        if end < start:
            raise ValueError("a window ends before it starts")
        return self._add(window, key, start, end, source, partition, segments, tags)

    def open(self, window: str, key: str, start: int, source: str | None = None, partition: str | None = None, segments=(), tags=()) -> HistoryBuilder:
        return self._add(window, key, start, None, source, partition, segments, tags)

    def _add(self, window, key, start, end, source, partition, segments, tags):
        if key is None:
            raise ValueError("a window has a key")
        s = [(name, *typed(value), rest[0] if rest else None) for name, value, *rest in segments]
        t = [(name, *typed(value)) for name, value in tags]
        self.rows.append((window, key, source, partition, start, end, s, t))
        return self

    def build(self, spark: SparkSession) -> DataFrame:
        kinds = f"window_name string, key string, source string, partition string, start_position long, end_position long, segments array<{schema.SEGMENT}>, tags array<{schema.TAG}>"
        return schema.completed(spark.createDataFrame(self.rows, kinds))


class FixtureError(ValueError):
    """A fixture of the wrong shape; the message begins with the JSON path."""


def _want(value, kind, path: str, optional: bool = False):
    if value is None and optional:
        return None
    if not isinstance(value, kind) or kind is int and isinstance(value, bool):
        raise FixtureError(f"{path}: expected {getattr(kind, '__name__', kind)}")
    return value


def fixture(spark: SparkSession, text: str) -> tuple[DataFrame, Plan, dict]:
    """Windows, plan and expectations of a contract fixture; it is one small document, checked on the driver."""
    doc = _want(json.loads(text), dict, "$")
    _want(doc.get("schema"), str, "$.schema")
    _want(doc.get("schemaVersion"), int, "$.schemaVersion")
    builder = HistoryBuilder()
    for i, w in enumerate(_want(doc.get("windows"), list, "$.windows")):
        at = f"$.windows[{i}]"
        _want(w, dict, at)
        start, end = _want(w.get("startPosition"), int, at + ".startPosition"), _want(w.get("endPosition"), int, at + ".endPosition", True)
        if end is not None and end < start:
            raise FixtureError(f"{at}.endPosition: before startPosition")
        segments = [(s["name"], s.get("value"), s.get("parentName")) for s in _want(w.get("segments"), list, at + ".segments", True) or []]
        tags = [(s["name"], s.get("value")) for s in _want(w.get("tags"), list, at + ".tags", True) or []]
        builder._add(_want(w.get("windowName"), str, at + ".windowName"), _want(w.get("key"), str, at + ".key"), start, end, _want(w.get("source"), str, at + ".source"), _want(w.get("partition"), str, at + ".partition", True), segments, tags)
    p = _want(doc.get("plan"), dict, "$.plan")
    if p.get("againstCohort"):
        c = _want(p["againstCohort"], dict, "$.plan.againstCohort")
        against = (Selector.for_cohort(tuple(_want(c.get("sources"), list, "$.plan.againstCohort.sources")), Activity(_want(c.get("activity"), str, "$.plan.againstCohort.activity"), c.get("count"))).named(c.get("name") or "cohort"),)
    else:
        against = tuple(Selector.for_source(s) for s in _want(p.get("againstSources"), list, "$.plan.againstSources"))
    pairs = lambda name: tuple((s["name"], s.get("value")) for s in _want(p.get(name), list, f"$.plan.{name}", True) or [])
    live = _want(p.get("liveHorizonPosition"), int, "$.plan.liveHorizonPosition", True)
    plan = Plan(
        _want(p.get("name"), str, "$.plan.name"), Selector.for_source(_want(p.get("targetSource"), str, "$.plan.targetSource")), against,
        Scope(_want(p.get("scopeWindow"), str, "$.plan.scopeWindow", True), pairs("scopeSegments"), pairs("scopeTags")),
        Normalization(open_policy="ClipToHorizon", horizon=live) if live is not None else Normalization(), tuple(_want(p.get("comparators"), list, "$.plan.comparators")), bool(p.get("strict")),
    )
    return builder.build(spark), plan, doc.get("expected") or {}


__all__ = ["FixtureError", "HistoryBuilder", "as_of", "fixture", "lead_lag", "read_jsonl"]
