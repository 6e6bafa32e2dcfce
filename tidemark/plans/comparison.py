"""Comparison plans: selectors, scope, normalisation, declarations, validation and the critic.  Nothing here runs a job."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.history import has

BUILT_IN = ("overlap", "residual", "missing", "coverage", "gap", "symmetric-difference", "containment")
#: Diagnostic codes, by number.
CODES = (
    "Unknown", "MissingName", "MissingTarget", "MissingAgainst", "MissingComparator", "NonSerializableSelector", "MissingScope", "MixedTimeAxes",
    "OpenWindowsWithoutPolicy", "MissingEventTime", "InvalidRangeDuration", "ClippedWindow", "UnknownComparator", "AmbiguousAsOfMatch", "MissingLineage",
    "FutureWindowExcluded", "KnownAtRequiresProcessingPosition", "RuntimeNonSerializablePlan", "BroadSelector", "FutureLeakageRisk",
    "LiveFinalityWithoutHorizon", "UnboundedOpenDuration", "MixedClockRisk",
)


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    severity: str = "Error"
    path: str = ""


@dataclass(frozen=True)
class Activity:
    """How many distinct member sources of a cohort must be active."""

    name: str
    count: int | None = None

    def __post_init__(self):
        if self.name not in ("any", "all", "none", "at-least", "at-most", "exactly"):
            raise ValueError(f"unknown cohort activity {self.name}")
        if (self.name in ("at-least", "at-most", "exactly")) != (self.count is not None) or self.name == "at-least" and self.count < 1 or (self.count or 0) < 0:
            raise ValueError("the activity's count is wrong")

    def required(self, members: int) -> int:
        return {"any": 1, "all": members, "none": 0}.get(self.name, self.count)

    def holds(self, active: Column, members: int) -> Column:
        n = self.required(members)
        return active >= n if self.name in ("any", "at-least") else active <= n if self.name == "at-most" else active == n

    def __str__(self):
        return self.name if self.count is None else f"{self.name}:{self.count}"


@dataclass(frozen=True)
class Selector:
    """A named predicate over windows; a runtime-only one can't be exported."""

    name: str
    predicate: Column
    description: str
    serializable: bool = True
    cohort: tuple[tuple[str, ...], Activity] | None = None

    @staticmethod
    def everything(name: str, description: str = "everything") -> Selector:
        return Selector(name, F.lit(True), description)

    @staticmethod
    def for_window(name: str) -> Selector:
        return Selector(name, F.col("window_name") == name, f"window = {name}")

    @staticmethod
    def for_key(key: str) -> Selector:
        return Selector(key, F.col("key") == key, f"key = {key}")

    @staticmethod
    def for_source(source: str) -> Selector:
        return Selector(source, F.col("source") == source, f"source = {source}")

    @staticmethod
    def for_sources(*sources: str) -> Selector:
        if not sources:
            raise ValueError("no sources")
        return Selector(", ".join(sources), F.col("source").isin(*sources), f"source in {', '.join(sources)}")

    @staticmethod
    def for_cohort(sources: tuple[str, ...], activity: Activity) -> Selector:
        if not sources or activity.count is not None and activity.count > len(sources):
            raise ValueError("a cohort has sources, and no more are asked for than it has")
        return replace(Selector.for_sources(*sources), description=f"cohort {activity} of {', '.join(sources)}", cohort=(tuple(sources), activity))

    @staticmethod
    def for_partition(partition: str) -> Selector:
        return Selector(partition, F.col("partition") == partition, f"partition = {partition}")

    @staticmethod
    def for_positions(start: int, end: int | None = None) -> Selector:
        p = F.col("start_position")
        return Selector("positions", (p >= start) & (p < end if end is not None else F.lit(True)), f"start position in [{start}, {'' if end is None else end})")

    @staticmethod
    def for_times(start, end=None) -> Selector:
        t = F.col("start_time")
        inside = (t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp") if end is not None else F.lit(True))
        return Selector("times", F.coalesce(inside, F.lit(False)), f"start time in [{start}, {'' if end is None else end})")

    @staticmethod
    def runtime_only(name: str, predicate: Column, description: str = "runtime predicate") -> Selector:
        return Selector(name, predicate, description, False)

    def named(self, name: str) -> Selector:
        return replace(self, name=name)

    def __and__(self, other: Selector) -> Selector:
        return Selector(f"{self.name} and {other.name}", self.predicate & other.predicate, f"({self.description}) and ({other.description})", self.serializable and other.serializable)

    def __or__(self, other: Selector) -> Selector:
        return Selector(f"{self.name} or {other.name}", self.predicate | other.predicate, f"({self.description}) or ({other.description})", self.serializable and other.serializable)


@dataclass(frozen=True)
class Scope:
    """Conjunctive filter for both sides."""

    window: str | None = None
    segments: tuple[tuple[str, object], ...] = ()
    tags: tuple[tuple[str, object], ...] = ()
    key: str | None = None
    partition: str | None = None
    axis: str = "position"

    def predicate(self) -> Column:
        out = F.lit(True)
        for c, v in (("window_name", self.window), ("key", self.key), ("partition", self.partition)):
            if v is not None:
                out = out & F.coalesce(F.col(c) == v, F.lit(False))
        for array, pairs in (("segments", self.segments), ("tags", self.tags)):
            for name, value in pairs:
                out = out & has(array, name, value)
        return out


@dataclass(frozen=True)
class Normalization:
    axis: str = "position"
    open_policy: str = "RequireClosed"
    horizon: object = None
    null_time: str = "Reject"
    known_at: int | None = None
    coalesce_adjacent: bool = False
    duplicates: str = "Preserve"


@dataclass(frozen=True)
class Declaration:
    """A parsed comparator: name, and for point comparators transition or direction, axis and tolerance."""

    text: str
    name: str
    mode: str | None = None
    axis: str = "position"
    tolerance: int = 0

    @staticmethod
    def parse(text: str) -> Declaration | None:
        if text in BUILT_IN:
            return Declaration(text, text)
        parts = text.split(":")
        modes = {"lead-lag": ("Start", "End"), "asof": ("Previous", "Next", "Nearest")}
        axes = {"ProcessingPosition": "position", "Timestamp": "time"}
        if len(parts) == 4 and parts[1] in modes.get(parts[0], ()) and parts[2] in axes and parts[3].isdigit():
            return Declaration(text, parts[0], parts[1], axes[parts[2]], int(parts[3]))
        return None


def is_known(text: str) -> bool:
    """Whether the catalog has this comparator, with valid settings."""
    return Declaration.parse(text) is not None


def catalog() -> tuple[str, ...]:
    """The comparators by name; the last two take a mode, an axis and a tolerance."""
    return (*BUILT_IN, "lead-lag", "asof")


def lead_lag(transition: str, tolerance: int = 0, axis: str = "ProcessingPosition") -> str:
    return f"lead-lag:{transition}:{axis}:{tolerance}"


def as_of(direction: str, tolerance: int, axis: str = "ProcessingPosition") -> str:
    return f"asof:{direction}:{axis}:{tolerance}"


@dataclass(frozen=True)
class Plan:
    name: str
    target: Selector | None = None
    against: tuple[Selector, ...] = ()
    scope: Scope | None = None
    normalization: Normalization = field(default_factory=Normalization)
    comparators: tuple[str, ...] = ()
    strict: bool = False

    def cohort(self) -> tuple[tuple[str, ...], Activity] | None:
        return self.against[0].cohort if len(self.against) == 1 else None

    def serializable(self) -> bool:
        return all(s.serializable for s in (*([self.target] if self.target else []), *self.against))

    def validate(self) -> list[Diagnostic]:
        soft, out = "Error" if self.strict else "Warning", []
        if not self.name.strip():
            out.append(Diagnostic("MissingName", "a plan has a name", path="name"))
        if self.target is None:
            out.append(Diagnostic("MissingTarget", "a plan has a target", path="target"))
        elif not self.target.serializable:
            out.append(Diagnostic("NonSerializableSelector", "the target can't be exported", soft, "target"))
        if not self.against:
            out.append(Diagnostic("MissingAgainst", "a plan has something to compare with", path="against"))
        out += [Diagnostic("NonSerializableSelector", f"{s.name} can't be exported", soft, f"against[{i}]") for i, s in enumerate(self.against) if not s.serializable]
        if self.scope is None:
            out.append(Diagnostic("MissingScope", "a plan has a scope", path="scope"))
        if not self.comparators:
            out.append(Diagnostic("MissingComparator", "a plan has comparators", path="comparators"))
        n = self.normalization
        if self.scope is not None and self.scope.axis != n.axis:
            out.append(Diagnostic("MixedTimeAxes", "scope and normalisation differ in their axis", path="scope"))
        if n.known_at is not None and not isinstance(n.known_at, int):
            out.append(Diagnostic("KnownAtRequiresProcessingPosition", "known-at is a position", path="normalization"))
        return out

    def criticise(self) -> list[Diagnostic]:
        """Analytical risks: warnings, or errors of a strict plan."""
        soft, n, out = "Error" if self.strict else "Warning", self.normalization, []
        if not self.serializable():
            out.append(Diagnostic("RuntimeNonSerializablePlan", "the plan can't be exported", soft))
        if self.scope is None or not (self.scope.window or "").strip():
            out.append(Diagnostic("BroadSelector", "the scope takes every window", soft, "scope"))
        if n.known_at is None and any(c.startswith("asof:") for c in self.comparators):
            out.append(Diagnostic("FutureLeakageRisk", "a point-in-time lookup without known-at", soft))
        if n.open_policy == "ClipToHorizon" and n.horizon is None:
            out.append(Diagnostic("LiveFinalityWithoutHorizon", "open windows are clipped to no horizon", soft))
        if n.horizon is not None and (n.axis == "time") == isinstance(n.horizon, int):
            out.append(Diagnostic("MixedClockRisk", "the horizon is of another clock than the windows", soft))
        return out
