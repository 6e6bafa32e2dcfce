"""Analytics over comparisons: source matrix, hierarchy, changelog and lane liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import SCOPE, aligned, sweep


def source_matrix(windows: DataFrame, window_name: str, sources: list[str]) -> DataFrame:
    """One row for each ordered pair of sources, from one sweep over a pair table instead of a comparison for each."""
    spark = windows.sparkSession
    pairs = F.broadcast(spark.createDataFrame([(a, b) for a in sources for b in sources], "target string, against string"))  # as many rows as the caller's list squared
    own = windows.where((F.col("window_name") == window_name) & F.col("source").isin(*sources))
    state = own.groupBy("source").agg(F.bool_or(F.col("end_position").isNull()).alias("open"))
    off = F.broadcast(spark.createDataFrame([(s, a, b, side) for a in sources for b in sources if a != b for s, side in ((a, "Target"), (b, "Against"))], "source string, target string, against string, side string"))
    ranged = own.where("end_position IS NOT NULL").select(*SCOPE, "source", F.col("start_position").alias("range_start"), F.col("end_position").alias("range_end"))
    seg = sweep(ranged.join(off, "source"), ["target", "against", *SCOPE])
    t, a, length = F.col("n_target") > 0, F.col("n_against") > 0, F.col("range_end") - F.col("range_start")
    cells = seg.groupBy("target", "against").agg(F.count_if(t & a).alias("o"), F.count_if(t & ~a).alias("r"), F.count_if(~t & a).alias("m"), F.count_if(t).alias("c"), F.sum(F.when(t, length)).alias("total"), F.sum(F.when(t & a, length)).alias("covered"))
    have = lambda side: F.broadcast(state.select(F.col("source").alias(side), F.col("open").alias(f"{side}_open"), F.lit(True).alias(f"{side}_has")))  # noqa: E731  a row for each source
    out = pairs.join(have("target"), "target", "left").join(have("against"), "against", "left").join(cells, ["target", "against"], "left")
    diagonal = F.col("target") == F.col("against")
    blocked = diagonal | F.coalesce("target_open", F.lit(False)) | F.coalesce("against_open", F.lit(False))
    number = lambda c: F.when(blocked, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    has = lambda side: F.coalesce(f"{side}_has", F.lit(False))
    ratio = F.when(diagonal, F.when(has("target"), 1.0)).when(blocked, None).when(F.coalesce("total", F.lit(0)) > 0, F.coalesce("covered", F.lit(0)) / F.col("total"))
    return out.select(
        "target", "against", diagonal.alias("is_diagonal"), has("target").alias("target_has_windows"), has("against").alias("against_has_windows"),
        number("o").alias("overlap_rows"), number("r").alias("residual_rows"), number("m").alias("missing_rows"), number("c").alias("coverage_rows"), ratio.alias("coverage_ratio"),
    )


def cell(matrix: DataFrame, target: str, against: str) -> DataFrame:
    return matrix.where((F.col("target") == target) & (F.col("against") == against))


def hierarchy(windows: DataFrame, parent: str, child: str) -> DataFrame:
    """What closed child windows explain of closed parent windows, by source and partition."""
    side = F.when(F.col("window_name") == parent, "Target").otherwise("Against")
    rows = windows.where(F.col("window_name").isin(parent, child) & F.col("end_position").isNotNull())
    rows = rows.select("source", "partition", F.col("start_position").alias("range_start"), F.col("end_position").alias("range_end"), side.alias("side"), "window_name", "record_id", F.lit("").alias("selector"), F.lit(False).alias("provisional"))
    if parent == child:
        raise ValueError("parent and child are one window")
    seg = aligned(rows.withColumn("lane", F.col("source")), ["lane", "partition"], spread=True)
    t, a = F.size("targets") > 0, F.size("againsts") > 0
    kind = F.when(t & a, "ParentExplained").when(t, "UnexplainedParent").otherwise("OrphanChild")
    sorted_ids = lambda c: F.sort_array(F.transform(c, lambda e: e["record_id"]))
    return seg.select(kind.alias("kind"), F.col("lane").alias("source"), "partition", "range_start", "range_end", sorted_ids("targets").alias("parent_ids"), sorted_ids("againsts").alias("child_ids"))


def hierarchy_diagnostics(windows: DataFrame, parent: str, child: str) -> DataFrame:
    """code, severity, path, message: a warning for each side of a hierarchy that has no windows at all."""
    there = windows.agg(F.count_if(F.col("window_name") == parent).alias("p"), F.count_if(F.col("window_name") == child).alias("c"))
    side = lambda n, path, what: F.struct((F.col(n) == 0).alias("none"), F.lit(path).alias("path"), F.lit(f"no {what} windows").alias("message"))
    rows = there.select(F.inline(F.array(side("p", "parentWindowName", "parent"), side("c", "childWindowName", "child contribution"))))
    return rows.where("none").select(F.lit("MissingLineage").alias("code"), F.lit("Warning").alias("severity"), "path", "message")


def changelog(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Entries that turn the finality rows ``previous`` into ``current``: row_type, row_id, version, finality, supersedes, reason."""
    p, c = previous.alias("p"), current.alias("c")
    both = p.join(c, (F.col("p.row_type") == F.col("c.row_type")) & (F.col("p.row_id") == F.col("c.row_id")), "full_outer")
    new, gone = F.col("p.row_id").isNull(), F.col("c.row_id").isNull()
    differs = (F.col("p.finality") != F.col("c.finality")) | (F.col("p.reason") != F.col("c.reason"))
    rows = both.where(new | gone | differs)
    return rows.select(
        F.coalesce("c.row_type", "p.row_type").alias("row_type"), F.coalesce("c.row_id", "p.row_id").alias("row_id"),
        F.when(new, F.col("c.version")).otherwise(F.col("p.version") + 1).cast("long").alias("version"),
        F.when(new, F.col("c.finality")).when(gone, "Retracted").otherwise("Revised").alias("finality"),
        F.when(~new, F.col("p.row_id")).alias("supersedes"), F.when(gone, "the row is no longer there").otherwise(F.col("c.reason")).alias("reason"),
    )


def replay(previous: DataFrame, entries: DataFrame) -> DataFrame:
    """The finality rows after the entries: the last version of each row, without retracted ones; revised rows are final."""
    columns = ["row_type", "row_id", "version", "finality", "supersedes", "reason"]
    start = previous.select(*[F.col(c) if c in previous.columns else F.lit(None).cast("string").alias(c) for c in columns])
    rank = F.row_number().over(Window.partitionBy("row_type", "row_id").orderBy(F.desc("version"), F.desc("_new")))
    rows = start.withColumn("_new", F.lit(0)).union(entries.select(*columns).withColumn("_new", F.lit(1))).withColumn("_k", rank)
    rows = rows.where("_k = 1 AND finality <> 'Retracted'")
    return rows.withColumn("finality", F.when(F.col("finality") == "Revised", "Final").otherwise(F.col("finality"))).select(*columns)


def silences(beats: DataFrame, lane: Column, at: Column, threshold: int, horizon: Column, lanes: DataFrame | None = None, started_at: Column | None = None) -> DataFrame:
    """Silence intervals of each lane: (lane, silent_from, silent_until), microseconds; null where it still lasts.

    A lane is silent ``threshold`` microseconds after its last beat (or after ``started_at`` for one of ``lanes``), up to
    its next beat, as far as the horizon sees.
    """
    rows = beats.select(lane.cast("string").alias("lane"), at.cast("long").alias("at"))
    if lanes is not None and started_at is not None:
        rows = lanes.select(F.col("lane").cast("string").alias("lane"), started_at.cast("long").alias("at")).union(rows)
    rows = rows.where(F.col("at") <= horizon).withColumn("next", F.lead("at").over(Window.partitionBy("lane").orderBy("at")))
    silent = F.col("at") + threshold
    return rows.where(silent <= F.coalesce(F.col("next") - 1, horizon)).select("lane", silent.alias("silent_from"), F.col("next").alias("silent_until"))


def liveness_signals(beats: DataFrame, lane: Column, at: Column, lanes: DataFrame, threshold: int, started_at: int, horizon: int, every: int = 1) -> DataFrame:
    """State changes of the tracked ``lanes``: lane, is_silent, occurred_at, evaluated_at, threshold.

    A lane's first beat and each beat after a silence say that it is alive.  Lanes are checked at ``started_at`` and each
    ``every`` after it, up to the horizon, after the beats of that instant: a check finds a lane silent once ``threshold``
    has passed since its last beat (or the start), and dates the silence there.  A beat before the start, a beat of a lane
    that is not tracked and a lane that is listed twice are errors.
    """
    if threshold <= 0 or every <= 0:
        raise ValueError("threshold and interval of checks must be greater than zero")
    if horizon < started_at:
        raise ValueError("the horizon is earlier than the start")
    refused = lambda text: F.raise_error(F.lit(text)).cast("long")
    tracked = lanes.select(F.col("lane").cast("string").alias("lane")).groupBy("lane").agg(F.count("*").alias("n"))
    start = tracked.select("lane", F.when(F.col("n") > 1, refused("a lane is listed twice")).otherwise(F.lit(started_at)).cast("long").alias("at"), F.lit(True).alias("start"))
    seen = beats.select(lane.cast("string").alias("lane"), at.cast("long").alias("at")).where(F.col("at") <= horizon)
    seen = seen.join(tracked, "lane", "left").select("lane", F.when(F.col("n").isNull(), refused("a lane is not tracked")).when(F.col("at") < started_at, refused("a beat is earlier than the start")).otherwise(F.col("at")).alias("at"), F.lit(False).alias("start"))
    order = Window.partitionBy("lane").orderBy("at", F.desc("start"))
    rows = start.union(seen).withColumn("silent_at", F.col("at") + threshold).withColumn("next", F.lead("at").over(order))
    rows = rows.withColumn("check", F.expr(f"{started_at} + (silent_at - {started_at} + {every - 1}) div {every} * {every}"))
    rows = rows.withColumn("silent", (F.col("check") <= horizon) & F.coalesce(F.col("check") < F.col("next"), F.lit(True)))
    rows = rows.withColumn("alive", ~F.col("start") & F.coalesce(F.lag(F.col("silent") | F.col("start")).over(order), F.lit(False)))
    signal = lambda when, silent, occurred, evaluated: F.when(when, F.struct(F.lit(silent).alias("is_silent"), F.col(occurred).alias("occurred_at"), F.col(evaluated).alias("evaluated_at")))
    both = F.array_compact(F.array(signal(F.col("alive"), False, "at", "at"), signal(F.col("silent"), True, "silent_at", "check")))
    return rows.select("lane", F.inline(both)).withColumn("threshold", F.lit(threshold).cast("long"))
