"""Preparation and alignment: windows to normalised ranges to elementary segments.

Alignment numbers the distinct boundaries of each scope; a window then covers a run of numbers, so what it covers follows
from two equi-joins and an explode bounded by the output.  There is no range join and no quadratic scan of a scope.
``sweep`` gives counts without identifiers from running sums, for metrics that need no lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.comparison import Plan

SCOPE = ["window_name", "key", "partition", "segment_key"]
GROUP = ["window_name", "key", "partition"]


def prepared(windows: DataFrame, plan: Plan) -> DataFrame:
    """Every window with what became of it: ``code`` (null, a diagnostic, or ``OutOfScope``), ``severity`` and the range."""
    n = plan.normalization
    start, end = ("start_position", "end_position") if n.axis == "position" else ("start_time", "end_time")
    number = lambda c: F.unix_micros(c) if n.axis == "time" else c.cast("long")
    horizon = F.lit(n.horizon) if n.axis == "position" else F.lit(n.horizon).cast("timestamp")
    is_open = F.col("end_position").isNull()
    future = F.coalesce("end_position", "start_position") > n.known_at if isinstance(n.known_at, int) else F.lit(False)
    clip = n.open_policy == "ClipToHorizon" and n.horizon is not None
    upto = F.when(is_open, horizon).otherwise(F.col(end)) if clip else F.col(end)
    untimed = F.col(start).isNull() | (~is_open & F.col(end).isNull())
    scope = plan.scope.predicate() if plan.scope else F.lit(True)
    steps = [
        (future, "FutureWindowExcluded", "Warning"), (~scope, "OutOfScope", "Info"),
        *([] if clip else [(is_open, "OpenWindowsWithoutPolicy", "Error")]),
        (untimed, "MissingEventTime", "Error" if n.null_time == "Reject" else "Warning"), (upto < F.col(start), "InvalidRangeDuration", "Error"),
    ]
    code, severity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, name, level in reversed(steps):
        code, severity = F.when(condition, F.lit(name)).otherwise(code), F.when(condition, F.lit(level)).otherwise(severity)
    return windows.withColumns({"code": code, "severity": severity, "range_start": number(F.col(start)), "range_end": number(upto), "provisional": is_open})


def normalized(windows: DataFrame, plan: Plan) -> DataFrame:
    """One row for each side and selector that takes a window."""
    sides = [("Target", plan.target), *(("Against", s) for s in plan.against)]
    taken = F.array(*[F.when(s.predicate, F.struct(F.lit(side).alias("side"), F.lit(s.name).alias("selector"))) for side, s in sides if s is not None])
    rows = prepared(windows, plan).where("code IS NULL").withColumn("_t", F.explode(F.filter(taken, lambda x: x.isNotNull())))
    rows = rows.select(*SCOPE, "source", "segments", "tags", "record_id", F.array("record_id").alias("record_ids"), "range_start", "range_end", "provisional", "_t.side", "_t.selector")
    if plan.normalization.duplicates == "Reject":
        rows = deduplicated(rows)
    if plan.normalization.coalesce_adjacent:
        rows = coalesced(rows)
    return rows


_SAME = [*SCOPE, "source", "side", "selector"]
_IDENTITY = [*GROUP, "source", "side", "selector", "range_start", "range_end", "provisional"]


def deduplicated(rows: DataFrame) -> DataFrame:
    """One of the rows that agree in selector, window, key, source, partition, range and whether the end is provisional.

    Segments and tags do not make rows different; of rows that do agree the first context and identifier stays.
    """
    own = Window.partitionBy(*_IDENTITY).orderBy("segment_key", F.to_json("tags"), "record_id")
    return rows.withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")


def duplicate_diagnostics(rows: DataFrame) -> DataFrame:
    """code, severity, path, message: a warning for each group of rows that ``deduplicated`` makes one."""
    twice = rows.groupBy(*_IDENTITY).agg(F.count("*").alias("n"), F.min("record_id").alias("id")).where("n > 1")
    return twice.select(F.lit("duplicate_window").alias("code"), F.lit("Warning").alias("severity"), F.concat(F.lit("window["), "id", F.lit("]")).alias("path"), F.concat(F.col("n").cast("string"), F.lit(" windows are alike")).alias("message"))


def coalesced(rows: DataFrame) -> DataFrame:
    """Rows that meet end to start, merged; their identifiers are concatenated."""
    own = Window.partitionBy(*_SAME, "_tags").orderBy("range_start", "range_end", "record_id")
    rows = rows.withColumn("_tags", F.to_json("tags"))
    rows = rows.withColumn("_new", F.coalesce(F.col("range_start") != F.lag("range_end").over(own), F.lit(True)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("range_start", "range_end", "record_id"))), lambda x: x["record_id"])
    out = rows.groupBy(*_SAME, "_tags", "_island").agg(
        F.first("segments").alias("segments"), F.first("tags").alias("tags"), ids.alias("record_ids"),
        F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end"), F.bool_or("provisional").alias("provisional"),
    )
    return out.withColumn("record_id", F.array_join("record_ids", "+")).select(*rows.drop("_tags", "_new", "_island").columns)


#: Width of the stretches of an axis that ``numbered`` spreads over tasks: none has more distinct points than this.
STRETCH = 1 << 16


def numbered(points: DataFrame, scope: list[str], spread: bool) -> DataFrame:
    """Distinct points (scope, at) with their place ``n`` in the scope and the next point ``upto``.

    With ``spread`` a scope is cut into stretches of its axis that are numbered apart; what one task sees of a whole scope
    is one row for each stretch.
    """
    if not spread:
        own = Window.partitionBy(*scope).orderBy("at")
        return points.withColumns({"n": F.row_number().over(own), "upto": F.lead("at").over(own)})
    points = points.withColumn("stretch", F.floor(F.col("at") / STRETCH))
    own = Window.partitionBy(*scope).orderBy("stretch")
    each = points.groupBy(*scope, "stretch").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select(*scope, "stretch", before.alias("before"), F.lead("first").over(own).alias("next"))
    inside = Window.partitionBy(*scope, "stretch").orderBy("at")
    points = points.withColumns({"n": F.row_number().over(inside), "upto": F.lead("at").over(inside)}).join(each, [*scope, "stretch"])
    return points.select(*scope, "at", (F.col("n") + F.col("before")).alias("n"), F.coalesce("upto", "next").alias("upto"))


def aligned(rows: DataFrame, scope: list[str] = SCOPE, spread: bool = False) -> DataFrame:
    """Elementary segments of each scope with what is active: targets and againsts (sorted structs), range_start, range_end.

    ``spread`` is for few scopes with very many boundaries each: no task has to number all of a scope's.
    """
    ranged = rows.where("range_end IS NOT NULL")
    safe = lambda t: [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"{t}{i}") for i, c in enumerate(scope)]  # noqa: E731  null-safe equality as plain equality, for hash joins
    points = ranged.select(*safe("p"), F.explode(F.array("range_start", "range_end")).alias("at")).distinct()
    p = numbered(points, [f"p{i}" for i in range(len(scope))], spread).select(*[f"p{i}" for i in range(len(scope))], "at", "n", "upto")
    keyed = ranged.where("range_end > range_start").select("*", *safe("k"))
    on = lambda t: [F.col(f"k{i}") == F.col(f"{t}{i}") for i in range(len(scope))]
    first = p.toDF(*[f"f{i}" for i in range(len(scope))], "f_at", "f_n", "f_upto")
    last = p.toDF(*[f"l{i}" for i in range(len(scope))], "l_at", "l_n", "l_upto")
    spans = keyed.join(first, [*on("f"), F.col("range_start") == F.col("f_at")]).join(last, [*on("l"), F.col("range_end") == F.col("l_at")])
    entry = F.struct("source", F.col("range_start").alias("start"), F.col("range_end").alias("end"), "selector", "record_id", "provisional")
    cells = spans.select(*scope, *[f"k{i}" for i in range(len(scope))], "side", entry.alias("e"), F.explode(F.sequence(F.col("f_n"), F.col("l_n") - 1)).alias("n"))
    of = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("e"))))
    segments = cells.groupBy(*scope, *[f"k{i}" for i in range(len(scope))], "n").agg(of("Target").alias("targets"), of("Against").alias("againsts"))
    segments = segments.join(first, [*on("f"), F.col("n") == F.col("f_n")])
    return segments.select(*scope, F.col("f_at").alias("range_start"), F.col("f_upto").alias("range_end"), "targets", "againsts")


def active_against(plan: Plan) -> Column:
    """Whether the against side counts as active in a segment: by a cohort's rule, or if there is any window."""
    cohort = plan.cohort()
    if cohort is None:
        return F.size("againsts") > 0
    return cohort[1].holds(F.size(F.array_distinct(F.transform("againsts", lambda a: a["source"]))), len(cohort[0]))


def sweep(rows: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """Segments with numbers of active targets and againsts only, by running sums over boundary deltas."""
    t, a = ((F.col("side") == side).cast("int") for side in ("Target", "Against"))
    ends = F.array(F.struct(F.col("range_start").alias("at"), t.alias("dt"), a.alias("da")), F.struct(F.col("range_end").alias("at"), (-t).alias("dt"), (-a).alias("da")))
    points = rows.where("range_end IS NOT NULL").select(*scope, F.inline(ends)).groupBy(*scope, "at").agg(F.sum("dt").alias("dt"), F.sum("da").alias("da"))
    own = Window.partitionBy(*scope).orderBy("at")
    out = points.withColumns({"n_target": F.sum("dt").over(own), "n_against": F.sum("da").over(own), "range_end": F.lead("at").over(own)})
    return out.where("range_end IS NOT NULL AND (n_target > 0 OR n_against > 0)").select(*scope, F.col("at").alias("range_start"), "range_end", "n_target", "n_against")
