"""Reads over recorded windows: filters, snapshots, summaries, annotations, pairwise overlaps and residuals."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ["window_name", "key", "partition", "segment_key"]


def has(array: str, name: str, value: object) -> Column:
    """Some element of segments or tags has this name and value (of this type)."""
    kind = "bool" if isinstance(value, bool) else "long" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
    text = None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return F.exists(array, lambda s: (s["name"] == name) & s["value"].eqNullSafe(F.lit(text)) & (F.lit(value is None) | (s["value_type"] == kind)))


def ordered(windows: DataFrame) -> DataFrame:
    """The deterministic order: name, key, source, partition, start, end with open windows last, identifier."""
    nulls = [F.col(c).asc_nulls_first() for c in ("window_name", "key", "source", "partition", "start_position")]
    return windows.orderBy(*nulls, F.col("end_position").asc_nulls_last(), "record_id")


@dataclass(frozen=True)
class Query:
    """A conjunctive filter over windows, or over a snapshot of them."""

    rows: DataFrame
    is_snapshot: bool = False

    def where(self, condition: Column) -> Query:
        return replace(self, rows=self.rows.where(condition))

    def window(self, name: str) -> Query:
        return self.where(F.col("window_name") == name)

    def key(self, key: str) -> Query:
        return self.where(F.col("key") == key)

    def source(self, source: str | None) -> Query:
        return self.where(F.col("source").eqNullSafe(F.lit(source)))

    lane = source

    def partition(self, partition: str | None) -> Query:
        return self.where(F.col("partition").eqNullSafe(F.lit(partition)))

    def segment(self, name: str, value: object) -> Query:
        return self.where(has("segments", name, value))

    def tag(self, name: str, value: object) -> Query:
        return self.where(has("tags", name, value))

    def _closed(self) -> Column:
        return F.col("finality") == "Final" if self.is_snapshot else F.col("end_position").isNotNull()

    def windows(self) -> DataFrame:
        return ordered(self.rows)

    def closed_windows(self) -> DataFrame:
        return ordered(self.rows.where(self._closed()))

    def open_windows(self) -> DataFrame:
        return ordered(self.rows.where(~self._closed()))

    def latest_window(self) -> DataFrame:
        """The last row in the deterministic order."""
        keys = [F.col(c).desc_nulls_last() for c in ("window_name", "key", "source", "partition", "start_position")]
        return self.rows.orderBy(*keys, F.col("end_position").desc_nulls_first(), F.desc("record_id")).limit(1)

    def at(self, horizon, axis: str = "position") -> Query:
        if self.is_snapshot:
            raise ValueError("the query already reads a snapshot")
        return Query(snapshot_at(self.rows, horizon, axis), True)


def snapshot_at(windows: DataFrame, horizon, axis: str = "position") -> DataFrame:
    """Windows that began by the horizon, with range_start, range_end and finality as seen from it."""
    start, end = ("start_position", "end_position") if axis == "position" else ("start_time", "end_time")
    h = F.lit(horizon) if axis == "position" else F.lit(horizon).cast("timestamp")
    seen = windows.where(F.col(start).isNotNull() & (F.col(start) <= h))
    final = F.coalesce(F.col(end) <= h, F.lit(False))
    return seen.withColumns({"range_start": F.col(start), "range_end": F.when(final, F.col(end)).otherwise(h), "finality": F.when(final, "Final").otherwise("Provisional")})


def summarize(rows: DataFrame, array: str, name: str, axis: str = "position") -> DataFrame:
    """value, record/final/provisional counts, measured count and total by a segment's or tag's value.

    ``rows`` are windows or a snapshot; a value counts once for each record; positions, or microseconds of time.
    """
    snapshot = "finality" in rows.columns
    start, end = ("range_start", "range_end") if snapshot else ("start_position", "end_position") if axis == "position" else ("start_time", "end_time")
    final = F.col("finality") == "Final" if snapshot else F.col("end_position").isNotNull()
    number = lambda c: F.unix_micros(c) if axis != "position" else F.col(c)
    values = F.array_distinct(F.transform(F.filter(array, lambda s: s["name"] == name), lambda s: F.struct(s["value_type"], s["value"])))
    each = rows.withColumn("_v", F.explode(values))
    measured = F.col(start).isNotNull() & F.col(end).isNotNull()
    return each.groupBy(F.col("_v.value").alias("value")).agg(
        F.count("*").alias("record_count"), F.count_if(final).alias("final_count"), F.count_if(~final).alias("provisional_count"),
        F.count_if(measured).alias("measured_count"), F.coalesce(F.sum(F.when(measured, number(end) - number(start))), F.lit(0)).cast("long").alias("total_length"),
    )


START = ["window_name", "key", "source", "partition", "start_position"]


def annotated(annotations: DataFrame) -> DataFrame:
    """Revisions of append-only notes on start identities: ``annotations`` has START, name, value, known_at and seq."""
    own = Window.partitionBy(*START, "name").orderBy("seq")
    return annotations.withColumn("revision", F.row_number().over(own))


AXES = ("position", "time")


def annotate(windows: DataFrame, name: str, value: str | None, known_at: Column | None = None, axis: str = "position", existing: DataFrame | None = None) -> DataFrame:
    """The ``existing`` notes and one more on each of ``windows``: START, name, value, known_at, axis, revision.

    ``known_at`` is a position, or a timestamp on the axis of time (kept in microseconds); without it a note has no axis.
    The revision is one more than the window's notes of that name before it.
    """
    if axis not in AXES:
        raise ValueError(f"no axis {axis}")
    at = F.lit(None) if known_at is None else known_at if axis == "position" else F.unix_micros(known_at.cast("timestamp"))
    own = F.lit(None if known_at is None else axis).cast("string")
    new = windows.select(*START, F.lit(name).alias("name"), F.lit(value).cast("string").alias("value"), at.cast("long").alias("known_at"), own.alias("axis"))
    if existing is None:
        return new.withColumn("revision", F.lit(1).cast("long"))
    counts = existing.where(F.col("name") == name).groupBy(*START).agg(F.max("revision").alias("before"))
    n, c = new.alias("n"), counts.alias("c")
    new = n.join(c, [F.col(f"n.{k}").eqNullSafe(F.col(f"c.{k}")) for k in START], "left").select("n.*", (F.coalesce("c.before", F.lit(0)) + 1).cast("long").alias("revision"))
    return existing.select(*new.columns).union(new)


def annotations_known_at(annotations: DataFrame, horizon, axis: str = "position") -> DataFrame:
    """Notes known by the horizon, on its axis; those without ``known_at`` are none.  Notes without a column ``axis`` are of positions."""
    if axis not in AXES:
        raise ValueError(f"no axis {axis}")
    own = F.col("axis") if "axis" in annotations.columns else F.lit("position")
    upto = F.lit(horizon) if axis == "position" else F.unix_micros(F.lit(horizon).cast("timestamp"))
    return annotations.where((own == axis) & (F.col("known_at") <= upto))


def annotations_for(windows: DataFrame, annotations: DataFrame) -> DataFrame:
    """Notes of the windows, joined null-safely on the start identity."""
    w, a = windows.alias("w"), annotations.alias("a")
    on = [F.col(f"w.{c}").eqNullSafe(F.col(f"a.{c}")) for c in START]
    return w.join(a, on).select(*[F.col(f"w.{c}") for c in (*START, "record_id")], "a.name", "a.value", "a.known_at", "a.revision")


def find_overlaps(windows: DataFrame) -> DataFrame:
    """Closed pairs of one scope that intersect, sources alike or not: ids in deterministic order, and the intersection.

    Each window is listed in the time buckets it touches and a pair is emitted in the bucket where its
    intersection begins, so a long history of one key is split over many tasks.
    """
    closed = windows.where("end_position IS NOT NULL AND end_position > start_position")
    # buckets about as wide as the mean window, so that a window lies in few of them
    width = F.greatest(F.lit(1), F.ceil(F.avg(F.col("end_position") - F.col("start_position")) * 2))
    widths = F.broadcast(closed.groupBy("window_name").agg(width.cast("long").alias("width")))
    rows = closed.join(widths, "window_name").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_position") / F.col("width")), F.floor((F.col("end_position") - 1) / F.col("width")))))
    a, b = rows.alias("a"), rows.alias("b")
    order = lambda t: F.struct(*[F.coalesce(F.col(f"{t}.{c}").cast("string"), F.lit("")) for c in ("source",)], F.col(f"{t}.start_position"), F.col(f"{t}.end_position"), F.col(f"{t}.record_id"))
    start = F.greatest("a.start_position", "b.start_position")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in SCOPE] + [
        F.col("a.bucket") == F.col("b.bucket"), F.col("a.start_position") < F.col("b.end_position"), F.col("b.start_position") < F.col("a.end_position"),
        order("a") < order("b"), F.col("a.bucket") == F.floor(start / F.col("a.width")),
    ]
    return a.join(b, on).select("a.window_name", "a.key", "a.partition", F.col("a.record_id").alias("first_id"), F.col("b.record_id").alias("second_id"), F.col("a.source").alias("first_source"), F.col("b.source").alias("second_source"), start.alias("range_start"), F.least("a.end_position", "b.end_position").alias("range_end"))


def find_residuals(windows: DataFrame, source: str) -> DataFrame:
    """What is left of the source's closed windows without all other sources' windows in their scope."""
    closed = windows.where("end_position IS NOT NULL AND end_position > start_position")
    target = closed.where(F.col("source") == source)
    other = closed.where(~F.col("source").eqNullSafe(F.lit(source)))
    # the covered stretches of a scope: islands of the others, merged by a running maximum
    by = Window.partitionBy(*SCOPE).orderBy("start_position", "end_position")
    top = F.max("end_position").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = other.select(*SCOPE, "start_position", "end_position").withColumn("begins", (top.isNull() | (F.col("start_position") > top)).cast("int"))
    islands = islands.withColumn("island", F.sum("begins").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*SCOPE, "island").agg(F.min("start_position").alias("i_start"), F.max("end_position").alias("i_end"))
    # islands lie one after the other, so those that a target meets have the numbers between two running values: the last
    # island that ends by the target's start (excluded), and the last that starts before its end
    own = ["record_id", "start_position", "end_position"]
    none = [F.lit(None).cast(target.schema[c].dataType).alias(c) for c in own]
    event = lambda at, turn, ended, begun, t_end, *ids: [F.col(at).alias("at"), F.lit(turn).alias("turn"), ended.alias("ended"), begun.alias("begun"), F.lit(t_end).alias("t_end"), *ids]
    no, number = F.lit(None).cast("long"), F.col("island")
    events = islands.select(*SCOPE, *event("i_end", 0, number, no, None, *none)).union(islands.select(*SCOPE, *event("i_start", 3, no, number, None, *none)))
    events = events.union(target.select(*SCOPE, *event("end_position", 1, no, no, True, *own))).union(target.select(*SCOPE, *event("start_position", 2, no, no, False, *own)))
    upto = Window.partitionBy(*SCOPE).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumns({"ended": F.coalesce(F.last("ended", ignorenulls=True).over(upto), F.lit(0)), "begun": F.coalesce(F.last("begun", ignorenulls=True).over(upto), F.lit(0))})
    met = events.where("t_end IS NOT NULL").groupBy(*SCOPE, *own).agg(F.max(F.when(~F.col("t_end"), F.col("ended"))).alias("lo"), F.max(F.when(F.col("t_end"), F.col("begun"))).alias("hi"))
    met = met.withColumn("number", F.explode_outer(F.when(F.col("hi") > F.col("lo"), F.sequence(F.col("lo") + 1, F.col("hi")))))
    t, i = met.alias("t"), islands.alias("i")
    on = [F.col(f"t.{c}").eqNullSafe(F.col(f"i.{c}")) for c in SCOPE] + [F.col("t.number") == F.col("i.island")]
    hit = t.join(i, on, "left").groupBy("t.window_name", "t.key", "t.partition", "t.record_id", "t.start_position", "t.end_position").agg(F.sort_array(F.collect_list(F.when(F.col("i.i_start").isNotNull(), F.struct("i.i_start", "i.i_end")))).alias("cover"))
    starts = F.concat(F.array(F.col("start_position")), F.transform("cover", lambda c: c["i_end"]))
    ends = F.concat(F.transform("cover", lambda c: c["i_start"]), F.array(F.col("end_position")))
    pieces = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda p: p["s"] < p["e"])
    return hit.select("window_name", "key", "partition", "record_id", F.inline(pieces)).toDF("window_name", "key", "partition", "record_id", "range_start", "range_end")
