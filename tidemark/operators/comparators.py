"""Comparators: one function for each family of rows, over aligned segments or normalised ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.comparison import Declaration, Plan
from .align import GROUP, active_against

ROWS = [*GROUP, "segment_key", "range_start", "range_end"]


def ids(column: str) -> Column:
    return F.transform(column, lambda e: e["record_id"])


def _provisional(column: str) -> Column:
    return F.exists(column, lambda e: e["provisional"])


def _finality(condition: Column) -> Column:
    return F.when(condition, "Provisional").otherwise("Final").alias("finality")


def _has(column: str) -> Column:
    return F.size(column) > 0


def overlap(seg: DataFrame, plan: Plan) -> DataFrame:
    return seg.where(_has("targets") & active_against(plan)).select(*ROWS, ids("targets").alias("target_ids"), ids("againsts").alias("against_ids"), _finality(_provisional("targets") | _provisional("againsts")))


def residual(seg: DataFrame, plan: Plan) -> DataFrame:
    doubt = _provisional("targets") | (_provisional("againsts") if plan.cohort() else F.lit(False))
    return seg.where(_has("targets") & ~active_against(plan)).select(*ROWS, ids("targets").alias("target_ids"), _finality(doubt))


def missing(seg: DataFrame, plan: Plan) -> DataFrame:
    return seg.where(~_has("targets") & active_against(plan)).select(*ROWS, ids("againsts").alias("against_ids"), _finality(_provisional("againsts")))


def coverage(seg: DataFrame, plan: Plan) -> DataFrame:
    length = (F.col("range_end") - F.col("range_start")).cast("double")
    return seg.where(_has("targets")).select(
        *ROWS, length.alias("target_magnitude"), F.when(active_against(plan), length).otherwise(0.0).alias("covered_magnitude"),
        ids("targets").alias("target_ids"), ids("againsts").alias("against_ids"), _finality(_provisional("targets") | _provisional("againsts")),
    )


def coverage_summary(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(*GROUP).agg(F.sum("target_magnitude").alias("target_magnitude"), F.sum("covered_magnitude").alias("covered_magnitude"))
    return out.withColumn("coverage_ratio", F.when(F.col("target_magnitude") == 0, 0.0).otherwise(F.col("covered_magnitude") / F.col("target_magnitude")))


def gap(seg: DataFrame, plan: Plan) -> DataFrame:
    """Holes between neighbouring segments of a window, key and partition; segment contexts are one after the other."""
    own = Window.partitionBy(*GROUP).orderBy("segment_key", "range_start")
    rows = seg.withColumn("next", F.lead("range_start").over(own)).where("range_end < next")
    return rows.select(*GROUP, F.col("range_end").alias("range_start"), F.col("next").alias("range_end"), F.lit("Final").alias("finality"))


def symmetric_difference(seg: DataFrame, plan: Plan) -> DataFrame:
    side = F.when(_has("targets") & ~active_against(plan), "Target").when(~_has("targets") & active_against(plan), "Against")
    return seg.withColumn("side", side).where("side IS NOT NULL").select(*ROWS, "side", ids("targets").alias("target_ids"), ids("againsts").alias("against_ids"), _finality(_provisional("targets") | _provisional("againsts")))


def containment(seg: DataFrame, plan: Plan) -> DataFrame:
    """Contained where any against window is active, else a row for each target by where in it the segment lies."""
    rows = seg.where(_has("targets"))
    inside = rows.where(_has("againsts")).select(*ROWS, F.lit("Contained").alias("status"), ids("targets").alias("target_ids"), ids("againsts").alias("container_ids"), _finality(_provisional("targets") | _provisional("againsts")))
    each = rows.where(~_has("againsts")).withColumn("t", F.explode("targets"))
    status = F.when(F.col("range_start") == F.col("t.start"), "LeftOverhang").when(F.col("range_end") == F.col("t.end"), "RightOverhang").otherwise("NotContained")
    outside = each.select(*ROWS, status.alias("status"), F.array("t.record_id").alias("target_ids"), F.array().cast("array<string>").alias("container_ids"), _finality(F.col("t.provisional")))
    return inside.union(outside)


SEGMENT_ROWS = {"overlap": overlap, "residual": residual, "missing": missing, "coverage": coverage, "gap": gap, "symmetric-difference": symmetric_difference, "containment": containment}


def _around(rows: DataFrame, target_point: str, against_point: str, tie: str) -> DataFrame:
    """Targets with the nearest against group at or before (``before``) and at or after (``after``) their point.

    One union, one shuffle by (window, key, partition) and a sort by the point each way, instead of a join of every pair.
    """
    t = rows.where(f"side = 'Target' AND {target_point} IS NOT NULL").select(*GROUP, F.col(target_point).alias("at"), F.struct("record_id", "provisional").alias("t"), F.lit(None).cast("struct<at:bigint,n:bigint,id:string,provisional:boolean>").alias("a"))
    first = F.min(F.struct("record_id", "provisional")) if tie == "id" else F.min_by(F.struct("record_id", "provisional"), F.struct("source", "range_start", "range_end", "record_id"))
    a = rows.where(f"side = 'Against' AND {against_point} IS NOT NULL").groupBy(*GROUP, F.col(against_point).alias("at")).agg(F.count("*").alias("n"), first.alias("f"))
    a = a.select(*GROUP, "at", F.lit(None).cast("struct<record_id:string,provisional:boolean>").alias("t"), F.struct("at", "n", F.col("f.record_id").alias("id"), F.col("f.provisional").alias("provisional")).alias("a"))
    # running values, each in its own order: a frame up to the end would be evaluated anew for every row
    upto = lambda order: F.last("a", ignorenulls=True).over(Window.partitionBy(*GROUP).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    both = t.union(a).withColumns({"before": upto(F.col("at")), "after": upto(F.col("at").desc())})
    return both.where("t IS NOT NULL")


def lead_lag(rows: DataFrame, d: Declaration) -> DataFrame:
    """For each target transition the nearest against transition; of two as near the earlier."""
    point = "range_start" if d.mode == "Start" else "range_end"
    near = _around(rows, point, point, "order")
    take_before = F.col("after").isNull() | (F.col("before").isNotNull() & (F.col("at") - F.col("before.at") <= F.col("after.at") - F.col("at")))
    near = near.withColumn("m", F.when(take_before, F.col("before")).otherwise(F.col("after")))
    delta = F.col("at") - F.col("m.at")
    direction = F.when(delta.isNull(), "MissingComparison").when(delta == 0, "Equal").when(delta < 0, "TargetLeads").otherwise("TargetLags")
    return near.select(
        *GROUP, F.lit(d.mode).alias("transition"), F.lit(d.axis).alias("axis"), F.col("at").alias("target_point"), F.col("m.at").alias("comparison_point"), delta.alias("delta"),
        F.lit(d.tolerance).cast("long").alias("tolerance"), F.coalesce(F.abs(delta) <= d.tolerance, F.lit(False)).alias("is_within"), direction.alias("direction"),
        F.col("t.record_id").alias("target_id"), F.col("m.id").alias("against_id"), _finality(F.col("t.provisional") | F.coalesce(F.col("m.provisional"), F.lit(False))),
    )


def lead_lag_summary(rows: DataFrame) -> DataFrame:
    count = lambda d: F.count_if(F.col("direction") == d)
    return rows.groupBy("transition", "axis", "tolerance").agg(
        F.count("*").alias("row_count"), count("TargetLeads").alias("lead_count"), count("TargetLags").alias("lag_count"), count("Equal").alias("equal_count"), count("MissingComparison").alias("missing_count"),
        F.count_if(~F.col("is_within")).alias("outside_count"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"),
    )


def as_of(rows: DataFrame, d: Declaration) -> DataFrame:
    """Each target start with the against start that the direction asks for, within the tolerance."""
    near = _around(rows, "range_start", "range_start", "id")
    down, up = F.col("at") - F.col("before.at"), F.col("after.at") - F.col("at")
    if d.mode == "Previous":
        near = near.withColumn("m", F.col("before"))
    elif d.mode == "Next":
        near = near.withColumn("m", F.col("after"))
    else:
        tied = (F.col("before.at") != F.col("after.at")) & (down == up)
        both = F.struct(F.when(F.col("before.id") <= F.col("after.id"), F.col("before.at")).otherwise(F.col("after.at")).alias("at"), (F.col("before.n") + F.col("after.n")).alias("n"), F.least("before.id", "after.id").alias("id"), (F.col("before.provisional") | F.col("after.provisional")).alias("provisional"))
        near = near.withColumn("m", F.when(tied, both).when(F.col("after").isNull() | (down <= up), F.col("before")).otherwise(F.col("after")))
    near = near.withColumn("distance", F.abs(F.col("at") - F.col("m.at")))
    rejected = F.col("m").isNull() & F.col("after").isNotNull() if d.mode == "Previous" else F.lit(False)
    status = (
        F.when(rejected, "FutureRejected").when(F.col("m").isNull() | (F.col("distance") > d.tolerance), "NoMatch").when(F.col("m.n") > 1, "Ambiguous").when(F.col("distance") == 0, "Exact").otherwise("Matched")
    )
    near = near.withColumn("status", status)
    matched = F.col("status").isin("Exact", "Matched", "Ambiguous")
    return near.select(
        *GROUP, F.lit(d.axis).alias("axis"), F.lit(d.mode).alias("direction"), F.col("at").alias("target_point"), F.when(matched, F.col("m.at")).alias("matched_point"),
        F.when(rejected, up).otherwise(F.col("distance")).alias("distance"), F.lit(d.tolerance).cast("long").alias("tolerance"), "status",
        F.col("t.record_id").alias("target_id"), F.when(matched, F.col("m.id")).alias("matched_id"), _finality(F.col("t.provisional") | F.coalesce(matched & F.col("m.provisional"), F.lit(False))),
    )


def cohort_evidence(seg: DataFrame, plan: Plan) -> DataFrame:
    """The rule, required and active counts and active sources of each segment with a window of either side."""
    sources, activity = plan.cohort()
    active = F.sort_array(F.array_distinct(F.transform("againsts", lambda a: a["source"])))
    rows = seg.where(_has("targets") | _has("againsts")).withColumn("sources", active)
    rows = rows.select(*ROWS, F.lit(str(activity)).alias("rule"), F.lit(activity.required(len(sources))).cast("long").alias("required"), F.size("sources").cast("long").alias("active_count"), activity.holds(F.size("sources"), len(sources)).alias("is_active"), F.array_join("sources", ",").alias("active_sources"))
    text = F.concat(F.lit("rule="), "rule", F.lit("; required="), F.col("required").cast("string"), F.lit("; activeCount="), F.col("active_count").cast("string"), F.lit("; isActive="), F.col("is_active").cast("string"), F.lit("; activeSources="), "active_sources")
    return rows.withColumn("evidence", text)


def row_counts(seg: DataFrame, plan: Plan, names: list[str]) -> DataFrame:
    """comparator, row_count of the families that follow from each segment by itself, in one pass over the segments."""
    t, a, active = _has("targets"), _has("againsts"), active_against(plan)
    rows = {
        "overlap": t & active, "residual": t & ~active, "missing": ~t & active, "coverage": t, "symmetric-difference": (t & ~active) | (~t & active),
        "containment": F.when(t & ~a, F.size("targets")).when(t, 1),
    }
    names = list(dict.fromkeys(names))
    counts = seg.agg(*[F.coalesce(F.sum(rows[n].cast("long")), F.lit(0)).alias(n) for n in names])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("comparator"), F.col(f"`{n}`").alias("row_count")) for n in names])))


#: Families that ``row_counts`` counts.
COUNTED = ("overlap", "residual", "missing", "coverage", "symmetric-difference", "containment")


def as_of_diagnostics(rows: DataFrame) -> DataFrame:
    """code, severity, path, message: a warning for each as-of row with several equally eligible matches."""
    message = F.lit("several transitions are equally eligible; the match taken is deterministic")
    return rows.where("status = 'Ambiguous'").select(F.lit("AmbiguousAsOfMatch").alias("code"), F.lit("Warning").alias("severity"), F.concat(F.lit("asof["), "target_id", F.lit("]")).alias("path"), message.alias("message"))


def total_length(rows: DataFrame) -> int:
    """Positions, or microseconds, that range rows cover in all."""
    return rows.agg(F.coalesce(F.sum(F.col("range_end") - F.col("range_start")), F.lit(0))).first()[0]


def total_magnitude(rows: DataFrame, which: str) -> float:
    """The ``target`` or ``covered`` magnitude of coverage rows in all."""
    if which not in ("target", "covered"):
        raise ValueError(f"coverage rows have no {which} magnitude")
    return rows.agg(F.coalesce(F.sum(f"{which}_magnitude"), F.lit(0.0))).first()[0]
