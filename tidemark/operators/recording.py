"""Recording: events to transitions and windows, and their roll-ups, as lazy plans of window functions.

One shuffle by (key, source, partition) for a definition, one by (parent, source, partition, context) for each level of
roll-up.  Positions come from the source; nothing is numbered globally.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema


@dataclass(frozen=True)
class Segment:
    """A value whose change splits an active window; children name their parent."""

    name: str
    value: Column
    value_type: str = "string"
    children: tuple[Segment, ...] = ()

    def flat(self, parent: str | None = None) -> list[tuple[str, Column, str, str | None]]:
        return [(self.name, self.value, self.value_type, parent), *(x for c in self.children for x in c.flat(self.name))]


@dataclass(frozen=True)
class Tag:
    name: str
    value: Column
    value_type: str = "string"


@dataclass(frozen=True)
class Projection:
    """Which segments a roll-up takes from its children: a non-empty ``preserve`` is an allow-list, ``drop`` wins."""

    preserve: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)
    transform: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def check(self, names: list[str]) -> list[str]:
        if set(self.preserve) & set(self.drop) or set(self.drop) & (set(self.rename) | set(self.transform)):
            raise ValueError("a segment is dropped and used")
        out = [self.rename.get(n, n) for n in names if (not self.preserve or n in self.preserve) and n not in self.drop]
        if len(set(out)) != len(out):
            raise ValueError("two segments get one name")
        return out

    def apply(self, segments: Column) -> Column:
        names = F.transform(segments, lambda s: s["name"])
        keep = lambda name: (F.lit(True) if not self.preserve else name.isin(*self.preserve)) & (~name.isin(*self.drop) if self.drop else F.lit(True))

        def renamed(name: Column) -> Column:
            out = name
            for a, b in self.rename.items():
                out = F.when(name == a, F.lit(b)).otherwise(out)
            return out

        def value(s: Column) -> Column:
            out = s["value"]
            for name, f in self.transform.items():
                out = F.when(s["name"] == name, f(s["value"])).otherwise(out)
            return out

        def one(s: Column) -> Column:
            parent = F.when(keep(s["parent_name"]) & F.array_contains(names, s["parent_name"]), renamed(s["parent_name"]))
            return F.struct(renamed(s["name"]).alias("name"), s["value_type"].alias("value_type"), value(s).alias("value"), parent.alias("parent_name"))

        return F.transform(F.filter(segments, lambda s: keep(s["name"])), one)


@dataclass(frozen=True)
class RollUp:
    """A parent window over its children's activity; ``active`` takes the numbers of active and of known children."""

    name: str
    key: Column
    active: Callable[[Column, Column], Column]
    projection: Projection = Projection()
    roll_ups: tuple[RollUp, ...] = ()


def any_active(active: Column, total: Column) -> Column:
    return active > 0


def all_active(active: Column, total: Column) -> Column:
    return (total > 0) & (active == total)


@dataclass(frozen=True)
class WindowDefinition:
    name: str
    key: Column
    active: Column
    segments: tuple[Segment, ...] = ()
    tags: tuple[Tag, ...] = ()
    roll_ups: tuple[RollUp, ...] = ()

    def flat_segments(self):
        flat = [x for s in self.segments for x in s.flat()]
        if len({n for n, *_ in flat}) != len(flat):
            raise ValueError(f"segment names of {self.name} are not unique")
        if len({t.name for t in self.tags}) != len(self.tags):
            raise ValueError(f"tag names of {self.name} are not unique")
        return flat


class TypedWindow:
    """A window defined by a class: ``name``, ``key`` and ``active`` as Columns, and what a definition may have besides."""

    name: str
    segments: tuple[Segment, ...] = ()
    tags: tuple[Tag, ...] = ()
    roll_ups: tuple[RollUp, ...] = ()

    def key(self) -> Column:
        raise NotImplementedError

    def active(self) -> Column:
        raise NotImplementedError

    def definition(self) -> WindowDefinition:
        return WindowDefinition(self.name, self.key(), self.active(), self.segments, self.tags, self.roll_ups)


def paired(states: DataFrame) -> DataFrame:
    """Windows from observed states: each opening with the next row that opens or closes in its history."""
    own = Window.partitionBy("key", "source", "partition", "ctx").orderBy("pos", "sq")
    rows = states.where("opened OR closed").withColumns({
        "end_position": F.lead("pos").over(own), "end_time": F.lead("ts").over(own), "next_active": F.lead("opened").over(own), "next_segments": F.lead("segments").over(own),
    }).where("opened")
    split = F.col("next_active") & ~F.col("rolled")
    changes = F.filter(
        F.zip_with("segments", "next_segments", lambda a, b: F.struct(a["name"].alias("segment_name"), a["value"].alias("previous_value"), b["value"].alias("current_value"))),
        lambda c: ~c["previous_value"].eqNullSafe(c["current_value"]),
    )
    rows = rows.select(
        "window_name", "key", "source", "partition", F.col("pos").alias("start_position"), "end_position", F.col("ts").alias("start_time"), "end_time", "segments", "tags",
        F.when(F.col("end_position").isNull(), F.lit(None)).when(split, "SegmentChanged").otherwise("ActivePredicateEnded").alias("boundary_reason"),
        F.when(split, changes).otherwise(F.array().cast(f"array<{schema.CHANGE}>")).alias("boundary_changes"),
    )
    return schema.completed(rows)


@dataclass(frozen=True)
class Pipeline:
    """Definitions over one event table; ``position`` is a unique, increasing column of it.

    Without ``record`` there are transitions only, and the history of windows stays empty.
    """

    definitions: tuple[WindowDefinition, ...]
    position: Column
    source: Column | None = None
    partition: Column | None = None
    event_time: Column | None = None
    record: bool = True

    def __post_init__(self):
        names = [n for d in self.metadata() for n in d.names()]
        if len(set(names)) != len(names):
            raise ValueError("window names are not unique")

    def metadata(self) -> list[Metadata]:
        tree = lambda r: Metadata(r.name, tuple(tree(x) for x in r.roll_ups))
        return [Metadata(d.name, tuple(tree(r) for r in d.roll_ups)) for d in self.definitions]

    def transitions(self, events: DataFrame) -> DataFrame:
        """Opened and Closed rows of every window and roll-up: window_name, key, source, partition, kind, position, time, order, segments, tags."""
        out = None
        for states in self._states(events):
            rows = states.where("opened OR closed")
            closed = rows.where("closed").select("window_name", "key", "source", "partition", F.lit("Closed").alias("kind"), "pos", "ts", (F.col("sq") * 2).alias("ord"), F.col("old_segments").alias("segments"), F.col("old_tags").alias("tags"))
            opened = rows.where("opened").select("window_name", "key", "source", "partition", F.lit("Opened").alias("kind"), "pos", "ts", (F.col("sq") * 2 + 1).alias("ord"), "segments", "tags")
            both = closed.union(opened)
            out = both if out is None else out.union(both)
        return out

    def windows(self, events: DataFrame) -> DataFrame:
        """Recorded windows in the canonical columns; open ones have no end."""
        out = None
        for states in self._states(events):
            rows = paired(states)
            out = rows if out is None else out.union(rows)
        return out if self.record else out.limit(0)

    def _states(self, events: DataFrame):
        """For each window and roll-up the rows where its state was observed."""
        for d in self.definitions:
            observed = self._observed(events, d)
            yield observed.select("window_name", "key", "source", "partition", F.lit("").alias("ctx"), "pos", F.lit(0).alias("sq"), "ts", "segments", "tags", "opened", "closed", "old_segments", "old_tags", F.lit(False).alias("rolled"))
            for k, r in enumerate(d.roll_ups):
                names = [n for n, *_ in d.flat_segments()]
                yield from self._rolled(self._children(observed), r, str(k), names, True)

    def _observed(self, events: DataFrame, d: WindowDefinition) -> DataFrame:
        """One row for each event: activity now and before, and where a window opens or closes."""
        segments = [schema.segment(n, v, p, t) for n, v, t, p in d.flat_segments()]
        none = F.lit(None).cast("string")
        rows = events.select(
            F.lit(d.name).alias("window_name"), d.key.cast("string").alias("key"),
            (self.source.cast("string") if self.source is not None else none).alias("source"), (self.partition.cast("string") if self.partition is not None else none).alias("partition"),
            self.position.cast("long").alias("pos"), (self.event_time.cast("timestamp") if self.event_time is not None else F.lit(None).cast("timestamp")).alias("ts"),
            F.coalesce(d.active, F.lit(False)).alias("active"),
            (F.array(*segments) if segments else schema.no_segments()).alias("segments"),
            (F.array(*[schema.tag(t.name, t.value, t.value_type) for t in d.tags]) if d.tags else schema.no_tags()).alias("tags"),
            *self._parents(d.roll_ups, "p"),
        ).withColumn("key", F.when(F.col("key").isNull(), F.raise_error(F.lit(f"null key in {d.name}"))).otherwise(F.col("key")))
        rows = rows.withColumn("segment_key", schema.segment_key(F.col("segments")) if segments else F.lit(""))
        own = Window.partitionBy("key", "source", "partition").orderBy("pos")
        rows = rows.withColumns({"was": F.lag("active", 1, False).over(own), "old_key": F.lag("segment_key").over(own), "old_segments": F.lag("segments").over(own), "old_tags": F.lag("tags").over(own)})
        split = F.col("active") & F.col("was") & (F.col("segment_key") != F.col("old_key"))
        return rows.withColumns({"split": split, "opened": (F.col("active") & ~F.col("was")) | split, "closed": (F.col("was") & ~F.col("active")) | split})

    def _parents(self, roll_ups, prefix: str) -> list[Column]:
        out = []
        for k, r in enumerate(roll_ups):
            out += [r.key.cast("string").alias(f"{prefix}{k}"), *self._parents(r.roll_ups, f"{prefix}{k}_")]
        return out

    def _children(self, observed: DataFrame) -> DataFrame:
        """What a roll-up observes of its children: a split is the old context ending and the new one beginning."""
        now = F.struct(F.lit(1).alias("sq"), F.when(F.col("active"), F.col("segments")).when(F.col("was"), F.col("old_segments")).otherwise(schema.no_segments()).alias("segments"), F.col("active").alias("active"), (F.col("opened") | F.col("closed")).alias("changed"))
        before = F.struct(F.lit(0).alias("sq"), F.col("old_segments").alias("segments"), F.lit(False).alias("active"), F.lit(True).alias("changed"))
        parents = [c for c in observed.columns if c[0] == "p" and c[1:2].isdigit()]
        rows = observed.select(F.col("key").alias("child"), "source", "partition", "pos", "ts", *parents, F.when(F.col("split"), F.array(before, now)).otherwise(F.array(now)).alias("obs"))
        return rows.select("child", "source", "partition", "pos", "ts", *parents, F.inline("obs"))

    def _rolled(self, children: DataFrame, r: RollUp, at: str, names: list[str], together: bool = False):
        """States of a roll-up and of those over it; the rows of a child may lie ``together`` in one task already."""
        names = r.projection.check(names)
        rows = children.withColumn("key", F.col(f"p{at}")).withColumn("segments", r.projection.apply(F.col("segments")))
        rows = rows.withColumn("ctx", schema.segment_key(F.col("segments")))
        if not together:  # one shuffle serves all windows below; constants are no keys
            rows = rows.repartition("key", *[c for c in ("source", "partition") if getattr(self, c) is not None], "ctx")
        # a split whose two contexts project to one is one observation of an active child
        same = Window.partitionBy("child", "key", "source", "partition", "pos", "ctx")
        rows = rows.withColumn("twin", F.count("*").over(same)).where("twin = 1 OR sq = 1").drop("twin")
        child = Window.partitionBy("key", "source", "partition", "ctx", "child").orderBy("pos", "sq")
        before = F.lag(F.col("active").cast("int")).over(child)
        rows = rows.withColumns({"d": F.col("active").cast("int") - F.coalesce(before, F.lit(0)), "new": before.isNull().cast("int")})
        own = Window.partitionBy("key", "source", "partition", "ctx").orderBy("pos", "sq")
        so_far = own.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({"ac": F.sum("d").over(so_far), "tc": F.sum("new").over(so_far)})
        rows = rows.withColumn("state", F.coalesce(F.last(F.when(F.col("changed"), r.active(F.col("ac"), F.col("tc"))), ignorenulls=True).over(so_far), F.lit(False)))
        rows = rows.withColumn("old", F.lag("state", 1, False).over(own))
        rows = rows.withColumns({"opened": F.col("state") & ~F.col("old"), "closed": F.col("old") & ~F.col("state")})
        yield rows.select(F.lit(r.name).alias("window_name"), "key", "source", "partition", "ctx", "pos", "sq", "ts", "segments", schema.no_tags().alias("tags"), "opened", "closed", F.col("segments").alias("old_segments"), schema.no_tags().alias("old_tags"), F.lit(True).alias("rolled"))
        if r.roll_ups:
            deeper = [c for c in rows.columns if c.startswith(f"p{at}_")]
            parents = rows.select(F.col("key").alias("child"), "source", "partition", "pos", "ts", *deeper, "sq", "segments", F.col("state").alias("active"), (F.col("opened") | F.col("closed")).alias("changed"))
            for k, x in enumerate(r.roll_ups):
                yield from self._rolled(parents, x, f"{at}_{k}", names)


@dataclass(frozen=True)
class Metadata:
    name: str
    roll_ups: tuple[Metadata, ...] = ()

    def names(self) -> list[str]:
        return [self.name, *(n for r in self.roll_ups for n in r.names())]
