"""A comparison from plan to result: lazy tables for each family of rows, and one probe for the error gate."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import timedelta
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.comparison import Activity, Declaration, Diagnostic, Plan, Scope, Selector
from . import align, comparators

#: Comparators whose rows are ranges that add up.
RANGED = ("overlap", "residual", "missing", "coverage", "gap", "symmetric-difference")


@dataclass
class Result:
    """Rows are built when asked for; an error leaves every family empty."""

    plan: Plan
    windows: DataFrame
    diagnostics: list[Diagnostic]
    declarations: list[Declaration]
    blocked: bool
    _built: dict[str, DataFrame] = field(default_factory=dict)

    @cached_property
    def normalized(self) -> DataFrame:
        return align.normalized(self.windows, self.plan)

    @cached_property
    def segments(self) -> DataFrame:
        rows = align.aligned(self.normalized)
        return rows.limit(0) if self.blocked else rows

    @cached_property
    def excluded(self) -> DataFrame:
        return align.prepared(self.windows, self.plan).where("code IS NOT NULL").select("window_name", "key", "source", "start_position", "record_id", "code", "severity")

    def rows(self, declaration: str) -> DataFrame:
        """The rows of one of the plan's comparators."""
        if declaration not in self._built:
            d = next(d for d in self.declarations if d.text == declaration)
            if d.name in comparators.SEGMENT_ROWS:
                rows = comparators.SEGMENT_ROWS[d.name](self.segments, self.plan)
            else:
                rows = (comparators.lead_lag if d.name == "lead-lag" else comparators.as_of)(self.normalized, d)
                rows = rows.limit(0) if self.blocked else rows
            self._built[declaration] = rows
        return self._built[declaration]

    def summary(self) -> DataFrame:
        """comparator, row_count of every known comparator; families of segments are counted in one pass."""
        counted = [d.text for d in self.declarations if d.name in comparators.COUNTED]
        out = comparators.row_counts(self.segments, self.plan, counted) if counted else None
        for d in self.declarations:
            if d.name not in comparators.COUNTED:
                n = self.rows(d.text).agg(F.lit(d.text).alias("comparator"), F.count("*").alias("row_count"))
                out = n if out is None else out.union(n)
        return out

    def row_diagnostics(self) -> DataFrame:
        """code, severity, path, message of what only the rows tell: windows that are alike, ambiguous as-of matches."""
        plain = replace(self.plan, normalization=replace(self.plan.normalization, duplicates="Preserve", coalesce_adjacent=False))
        out = align.duplicate_diagnostics(align.normalized(self.windows, plain))
        for d in self.declarations:
            if d.name == "asof":
                out = out.union(comparators.as_of_diagnostics(self.rows(d.text)))
        return out

    def _total(self, declaration: str, axis: str) -> int:
        if self.plan.normalization.axis != axis:
            raise ValueError(f"the rows are not on the {axis} axis")
        if declaration not in RANGED:
            raise ValueError(f"{declaration} rows have no total length")
        return comparators.total_length(self.rows(declaration))

    def total_position_length(self, declaration: str) -> int:
        """Positions that the rows of a comparator cover in all."""
        return self._total(declaration, "position")

    def total_time_duration(self, declaration: str) -> timedelta:
        """The time that the rows of a comparator cover in all."""
        return timedelta(microseconds=self._total(declaration, "time"))

    def coverage_summary(self) -> DataFrame:
        return comparators.coverage_summary(self.rows("coverage"))

    def lead_lag_summaries(self) -> list[DataFrame]:
        return [comparators.lead_lag_summary(self.rows(d.text)) for d in self.declarations if d.name == "lead-lag"]

    def row_finalities(self) -> DataFrame:
        """row_type, row_id, version, finality, reason: identifiers are hashes of the rows, so no row is renumbered."""
        out = None
        for d in self.declarations:
            rows = self.rows(d.text)
            own = rows.select(F.lit(d.name).alias("row_type"), F.sha2(F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != "finality"])), 256).alias("row_id"), F.lit(1).cast("long").alias("version"), "finality")
            out = own if out is None else out.union(own)
        return out.withColumn("reason", F.when(F.col("finality") == "Final", "all windows are closed").otherwise("an open window was clipped to the horizon"))

    def errors(self) -> list[Diagnostic]:
        return [d for d in self.diagnostics if d.severity == "Error"]

    def warnings(self) -> list[Diagnostic]:
        return [d for d in self.diagnostics if d.severity == "Warning"]

    @property
    def is_valid(self) -> bool:
        return not self.errors()


def compare(windows: DataFrame, plan: Plan) -> Result:
    """Validate and gate the plan.  Preparing diagnostics is one aggregate by code; rows wait until they are asked for."""
    found = plan.validate() + plan.criticise()
    structural = any(d.severity == "Error" for d in found)
    if plan.target is not None:
        soft = "Error" if plan.strict else "Warning"
        codes = align.prepared(windows, plan).where("code IS NOT NULL AND code <> 'OutOfScope'").groupBy("code", "severity").agg(F.count("*").alias("n")).collect()  # as many rows as codes
        found += [Diagnostic(r.code, f"{r.n} windows", r.severity) for r in sorted(codes)]
        if any(r.code == "OpenWindowsWithoutPolicy" for r in codes):
            found.append(Diagnostic("UnboundedOpenDuration", "open windows have no end to compare", soft))
    blocked = structural or any(d.severity == "Error" for d in found)
    declarations, unknown = [], []
    for text in plan.comparators:
        d = Declaration.parse(text)
        (declarations if d else unknown).append(d or Diagnostic("UnknownComparator", f"no comparator {text}"))
    return Result(plan, windows, found + unknown, declarations, blocked)


@dataclass(frozen=True)
class Builder:
    """Fluent plan building over a window table."""

    windows: DataFrame
    plan: Plan

    def target(self, name: str, selector: Selector) -> Builder:
        return replace(self, plan=replace(self.plan, target=selector.named(name)))

    def against(self, name: str, selector: Selector) -> Builder:
        return replace(self, plan=replace(self.plan, against=(*self.plan.against, selector.named(name))))

    def against_cohort(self, name: str, sources: tuple[str, ...], activity: Activity) -> Builder:
        return self.against(name, Selector.for_cohort(tuple(sources), activity))

    def within(self, **scope) -> Builder:
        return replace(self, plan=replace(self.plan, scope=Scope(**scope)))

    def normalize(self, **options) -> Builder:
        return replace(self, plan=replace(self.plan, normalization=replace(self.plan.normalization, **options)))

    def using(self, *comparators: str) -> Builder:
        return replace(self, plan=replace(self.plan, comparators=comparators))

    def strict(self) -> Builder:
        return replace(self, plan=replace(self.plan, strict=True))

    def build(self) -> Plan:
        """The plan as it stands, whether it can run or not."""
        return self.plan

    def validate(self) -> list[Diagnostic]:
        """What is wrong with the plan by itself; no job is run."""
        return self.plan.validate() + self.plan.criticise()

    def prepare(self) -> DataFrame:
        """The windows that the plan takes, normalised, one row for each side and selector."""
        return align.normalized(self.windows, self.plan)

    def prepare_live(self, horizon) -> DataFrame:
        return self.normalize(open_policy="ClipToHorizon", horizon=horizon).prepare()

    def run(self) -> Result:
        return compare(self.windows, self.plan)

    def run_live(self, horizon) -> Result:
        return self.normalize(open_policy="ClipToHorizon", horizon=horizon).run()


def comparison(windows: DataFrame, name: str) -> Builder:
    return Builder(windows, Plan(name))
