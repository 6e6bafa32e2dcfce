"""Recording from a stream: transitions of every window, with state for each (key, source, partition).

State holds one small row for each key that has been seen; RocksDB keeps it off the heap.  The transitions go to a table;
roll-ups (``rolled_up``) and comparisons are batch plans over it, run from ``foreachBatch`` or at a live horizon.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schema
from ..operators.recording import Pipeline, RollUp, paired

TRANSITIONS = "window_name string, key string, source string, partition string, kind string, pos long, ts timestamp, segment_key string, start_position long, segments string, tags string, parent string"


class Recorder(StatefulProcessor):
    """Opened and Closed rows of one window; a change of the segment context closes and opens again.

    A key whose first event is not active gives a Seen row, so that roll-ups know the child.
    """

    def __init__(self, name: str):
        self.name = name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "start_position long, segment_key string, last long, segments string, tags string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        held = self.state.get() if self.state.exists() else None
        start, context, last, segments, tags = held if held is not None else (None, None, None, None, None)
        out = []
        events = pd.concat(list(rows)).sort_values("pos", kind="stable")
        for pos, ts, active, own, own_segments, own_tags, parent in zip(*(events[c] for c in ("pos", "ts", "active", "segment_key", "segments", "tags", "parent"))):
            if last is not None and pos <= last:
                raise ValueError(f"position {pos} comes after {last}")
            if last is None and not active:
                out.append((self.name, *key, "Seen", int(pos), ts, "", None, "[]", "[]", parent))
            last = int(pos)
            if start is not None and (not active or own != context):
                out.append((self.name, *key, "Closed", int(pos), ts, context, start, segments, tags, parent))
                start = None
            if active and start is None:
                start, context, segments = int(pos), own, own_segments
                out.append((self.name, *key, "Opened", int(pos), ts, context, start, segments, own_tags, parent))
            tags = own_tags
        self.state.update((start, context, last, segments, tags))
        columns = [c.split(" ")[0] for c in TRANSITIONS.split(", ")]
        yield pd.DataFrame(out, columns=columns)

    def close(self) -> None:
        pass


def transitions(
    events: DataFrame, name: str, key: Column, active: Column, position: Column, source: Column | None = None, partition: Column | None = None, event_time: Column | None = None,
    segments: Column | None = None, tags: Column | None = None, parent: Column | None = None,
) -> DataFrame:
    """The stream of transitions of one window over a stream of events; ``parent`` is the key of its roll-ups."""
    none = F.lit(None).cast("string")
    text = lambda c: (c if c is not None else none).cast("string")
    rows = events.select(
        text(key).alias("key"), text(source).alias("source"), text(partition).alias("partition"),
        position.cast("long").alias("pos"), (event_time if event_time is not None else F.lit(None)).cast("timestamp").alias("ts"), F.coalesce(active, F.lit(False)).alias("active"),
        (schema.segment_key(segments) if segments is not None else F.lit("")).alias("segment_key"),
        (F.to_json(segments) if segments is not None else F.lit("[]")).alias("segments"), (F.to_json(tags) if tags is not None else F.lit("[]")).alias("tags"), text(parent).alias("parent"),
    )
    grouped = rows.groupBy("key", "source", "partition")
    found = grouped.transformWithStateInPandas(statefulProcessor=Recorder(name), outputStructType=TRANSITIONS, outputMode="Append", timeMode="None")
    return found.withColumns({"segments": F.from_json("segments", f"array<{schema.SEGMENT}>"), "tags": F.from_json("tags", f"array<{schema.TAG}>")})


def windows_of(recorded: DataFrame) -> DataFrame:
    """Windows, in the canonical columns, from a table of transitions: each Opened row with the next Closed row of its key."""
    opened = F.col("kind") == "Opened"
    return paired(_split(recorded).select(
        "window_name", "key", "source", "partition", F.lit("").alias("ctx"), "pos", "sq", "ts", "segments", "tags", (opened | F.col("split")).alias("opened"), (F.col("kind") == "Closed").alias("closed"), F.lit(False).alias("rolled"),
    ).where("NOT (sq = 1 AND split)"))


def _split(recorded: DataFrame) -> DataFrame:
    """The transitions with ``sq``; a Closed row whose key opens again at its position is a split, with the new context."""
    own = Window.partitionBy("window_name", "key", "source", "partition").orderBy("pos", "sq")
    rows = recorded.withColumn("sq", (F.col("kind") == "Opened").cast("int"))
    closes = (F.col("kind") == "Closed") & (F.lead("pos").over(own) == F.col("pos"))
    opens = (F.col("kind") == "Opened") & (F.lag("pos").over(own) == F.col("pos")) & (F.lag("kind").over(own) == "Closed")
    after = {c: F.when(closes, F.lead(c).over(own)).otherwise(F.col(c)) for c in ("segments", "tags")}
    return rows.withColumns({"split": F.coalesce(closes | opens, F.lit(False)), **after})


def rolled_up(recorded: DataFrame, r: RollUp, segment_names: tuple[str, ...] = ()) -> DataFrame:
    """Windows of a roll-up, and of those over it, of the transitions of one window; the children's parent is the one that was recorded with them.

    A roll-up over another takes its key from the columns that the table has.
    """
    pipeline = Pipeline((), F.col("pos"), F.col("source"), F.col("partition"))
    active, changed = F.col("kind") == "Opened", F.col("kind") != "Seen"
    parents = [F.col("parent").alias("p0"), *pipeline._parents(r.roll_ups, "p0_")]
    children = recorded.select(F.col("key").alias("child"), "source", "partition", "pos", "ts", *parents, active.cast("int").alias("sq"), "segments", active.alias("active"), changed.alias("changed"))
    out = None
    for states in pipeline._rolled(children, r, "0", list(segment_names)):
        rows = paired(states)
        out = rows if out is None else out.union(rows)
    return out


def for_each_batch(recorded_path: str, then: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: append the batch's transitions, then run ``then`` over all of them.

    The batch's number is part of its folder, so a batch that is run again replaces itself.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{recorded_path}/batch={number}")
        then(batch.sparkSession.read.option("basePath", recorded_path).parquet(recorded_path).drop("batch"), number)

    return run


def emissions(opened: dict[str, Callable] | None = None, closed: dict[str, Callable] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands each window's transitions of a batch to its callback, by window name.

    A callback gets the rows as a DataFrame, opened ones apart from closed ones, so what it does with them stays distributed.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        for kind, callbacks in (("Opened", opened or {}), ("Closed", closed or {})):
            for name, callback in callbacks.items():
                callback(rows.where((F.col("kind") == kind) & (F.col("window_name") == name)))
        rows.unpersist()

    return run
