"""Registered queries over ``events`` and the SQL that gives the same rows.

Adapter: position = event_id + 1, key = 'k' || user_id % 40, source = 'lane-' || event_id % 3, active = value > 20, segment
phase, tag type, roll-up parents 'p' || user_id % 5 and 'g' || user_id % 2; the live horizon is the last position + 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import align, analytics, comparators, history
from .operators.comparison import Result, compare
from .operators.recording import Pipeline, Projection, RollUp, Segment, Tag, WindowDefinition, all_active, any_active
from .plans.comparison import Activity, Normalization, Plan, Scope, Selector, as_of, lead_lag

NAME, TARGET, OTHERS = "HighValue", "lane-0", ("lane-1", "lane-2")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def pipeline(segments: bool = False, tags: bool = False, timed: bool = False, roll_ups: tuple[RollUp, ...] = ()) -> Pipeline:
    """The adapter as a pipeline."""
    phase = F.when(F.col("event_type").isin("click", "view"), "x").otherwise("y")
    definition = WindowDefinition(
        NAME, F.concat(F.lit("k"), F.pmod(F.col("user_id"), F.lit(40))), F.col("value") > 20,
        (Segment("phase", phase, children=(Segment("tone", F.upper(phase)),)),) if segments else (), (Tag("type", F.col("event_type")),) if tags else (), roll_ups,
    )
    return Pipeline((definition,), F.col("event_id") + 1, F.concat(F.lit("lane-"), F.pmod(F.col("event_id"), F.lit(3))), event_time=F.col("ts").cast("timestamp") if timed else None)


def windows(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return pipeline(**options).windows(events(spark, sf_dir))


def horizon(spark: SparkSession, sf_dir: str) -> int:
    """The last position + 1: one aggregate over one column."""
    return (events(spark, sf_dir).agg(F.max("event_id")).first()[0] or 0) + 2


def plan(spark: SparkSession, sf_dir: str, against: tuple[Selector, ...] | None = None, **normalization) -> Plan:
    against = against or tuple(Selector.for_source(s) for s in OTHERS)
    n = Normalization(**({"open_policy": "ClipToHorizon", "horizon": horizon(spark, sf_dir)} | normalization))
    return Plan("lanes", Selector.for_source(TARGET), against, Scope(NAME, axis=n.axis), n)


def ids(c: str):
    return F.array_join(c, "|").alias(c)


BASE = ["window_name", "key", "source", "start_position", "end_position", "record_id"]
RANGE = ["window_name", "key", "range_start", "range_end"]


def _aligned(spark, sf_dir, against=None, **n):
    p = plan(spark, sf_dir, against, **n)
    return align.aligned(align.normalized(windows(spark, sf_dir), p)), p


def _result(spark, sf_dir, *comparators_, against=None) -> Result:
    """The engine's own way: plan, validation, the error gate, then rows."""
    return compare(windows(spark, sf_dir), replace(plan(spark, sf_dir, against), comparators=comparators_))


def _rows(spark, sf_dir, name, against=None):
    return _result(spark, sf_dir, name, against=against).rows(name)


# --- SQL pieces ------------------------------------------------------------------------------------------------


def _f(name: str, value: str) -> str:
    return f"'{name}=' || length({value}) || ':' || {value} || ';'"


def _sql_windows(segments: bool = False, tags: bool = False, timed: bool = False) -> str:
    """Common table expressions e (events), t (state changes) and w (windows with identifiers)."""
    text = lambda c: f"coalesce('System.String:' || {c}, '<null>')"
    time = lambda c: f"coalesce(strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00', '<null>')" if timed else "'<null>'"
    split = "OR (active AND prev AND phase <> prev_phase)" if segments else ""
    seg = (
        _f("segments-count", "'2'") + " || " + _f("segment-name", "'phase'") + " || " + _f("segment-value", "('System.String:' || phase)") + " || " + _f("segment-parent", "'<null>'")
        + " || " + _f("segment-name", "'tone'") + " || " + _f("segment-value", "('System.String:' || upper(phase))") + " || " + _f("segment-parent", "'phase'")
    ) if segments else _f("segments-count", "'0'")
    tag = _f("tags-count", "'1'") + " || " + _f("tag-name", "'type'") + " || " + _f("tag-value", "('System.String:' || tag)") if tags else _f("tags-count", "'0'")
    change = lambda name, a, b: _f("boundary-change-name", f"'{name}'") + " || " + _f("boundary-change-previous", text(a)) + " || " + _f("boundary-change-current", text(b))
    changes = f"CASE WHEN reason = 'SegmentChanged' THEN {_f('boundary-changes-count', chr(39) + '2' + chr(39))} || {change('phase', 'phase', 'next_phase')} || {change('tone', 'upper(phase)', 'upper(next_phase)')} ELSE {_f('boundary-changes-count', chr(39) + '0' + chr(39))} END"
    fields = [
        _f("window", f"'{NAME}'"), _f("key", text("key")), _f("source", text("source")), _f("partition", "'<null>'"), _f("start-position", "CAST(start_position AS VARCHAR)"),
        _f("end-position", "coalesce(CAST(end_position AS VARCHAR), '<open>')"), _f("start-time", time("start_time")), _f("end-time", time("end_time")),
        _f("end-status", "(CASE WHEN end_position IS NULL THEN 'open' ELSE 'closed' END)"), seg, tag, _f("boundary-reason", "coalesce(reason, '<null>')"), changes,
    ]
    return f"""
e AS (SELECT event_id + 1 AS pos, 'k' || (user_id % 40) AS key, 'lane-' || (event_id % 3) AS source, coalesce(value > 20, false) AS active,
             CASE WHEN event_type IN ('click', 'view') THEN 'x' ELSE 'y' END AS phase, event_type AS tag, 'p' || (user_id % 5) AS parent, 'g' || (user_id % 2) AS grand, ts FROM events),
c AS (SELECT *, lag(active, 1, false) OVER s AS prev, lag(phase) OVER s AS prev_phase FROM e WINDOW s AS (PARTITION BY key, source ORDER BY pos)),
t AS (SELECT *, lead(pos) OVER s AS end_position, lead(ts) OVER s AS end_time, lead(active) OVER s AS next_active, lead(phase) OVER s AS next_phase
      FROM c WHERE active <> prev {split} WINDOW s AS (PARTITION BY key, source ORDER BY pos)),
r AS (SELECT '{NAME}' AS window_name, key, source, pos AS start_position, end_position, ts AS start_time, end_time, phase, next_phase, tag, parent, grand,
             CASE WHEN end_position IS NULL THEN NULL WHEN next_active THEN 'SegmentChanged' ELSE 'ActivePredicateEnded' END AS reason FROM t WHERE active),
w AS (SELECT *, sha256({' || '.join(fields)}) AS record_id FROM r)"""


W = "WITH " + _sql_windows()
#: n: normalised rows; seg: elementary segments with sorted identifiers, on open windows clipped at the horizon.
NORMAL = W + f""",
h AS (SELECT max(event_id) + 2 AS h FROM events),
n AS (SELECT window_name, key, source, record_id, start_position AS s, coalesce(end_position, h) AS e, end_position IS NULL AS open, CASE WHEN source = '{TARGET}' THEN 'T' ELSE 'A' END AS side FROM w, h)"""
SEG = NORMAL + """,
pts AS (SELECT DISTINCT window_name, key, unnest([s, e]) AS p FROM n),
sg AS (SELECT window_name, key, p AS range_start, lead(p) OVER (PARTITION BY window_name, key ORDER BY p) AS range_end FROM pts),
seg AS (SELECT sg.window_name, sg.key, range_start, range_end, count(*) FILTER (side = 'T') AS n_t, count(*) FILTER (side = 'A') AS n_a, count(DISTINCT source) FILTER (side = 'A') AS n_s,
               coalesce(string_agg(record_id, '|' ORDER BY source, s, e) FILTER (side = 'T'), '') AS target_ids, coalesce(string_agg(record_id, '|' ORDER BY source, s, e) FILTER (side = 'A'), '') AS against_ids,
               coalesce(string_agg(DISTINCT source, ',' ORDER BY source) FILTER (side = 'A'), '') AS sources, coalesce(bool_or(open) FILTER (side = 'T'), false) AS t_open, coalesce(bool_or(open) FILTER (side = 'A'), false) AS a_open
        FROM sg JOIN n ON n.key = sg.key AND n.s <= sg.range_start AND n.e >= sg.range_end AND n.s < n.e WHERE range_end IS NOT NULL GROUP BY ALL)"""
_FIN = "CASE WHEN t_open OR a_open THEN 'Provisional' ELSE 'Final' END AS finality"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- recording -------------------------------------------------------------------------------------------------

_BASE_SQL = ", ".join(BASE)


@query(W + f" SELECT {_BASE_SQL} FROM w")
def windows_basic(spark, d):
    return windows(spark, d).select(*BASE)


@query(W + f" SELECT {_BASE_SQL} FROM w WHERE end_position IS NULL")
def windows_open(spark, d):
    return history.Query(windows(spark, d)).open_windows().select(*BASE)


@query("WITH " + _sql_windows(segments=True) + f" SELECT {_BASE_SQL}, phase, reason AS boundary_reason, CASE WHEN reason = 'SegmentChanged' THEN phase || '>' || next_phase ELSE '' END AS change FROM w")
def windows_segmented(spark, d):
    change = F.coalesce(F.concat(F.get("boundary_changes", F.lit(0))["previous_value"], F.lit(">"), F.get("boundary_changes", F.lit(0))["current_value"]), F.lit(""))
    return windows(spark, d, segments=True).select(*BASE, F.col("segments")[0]["value"].alias("phase"), "boundary_reason", change.alias("change"))


@query("WITH " + _sql_windows(tags=True) + f" SELECT {_BASE_SQL}, tag FROM w")
def windows_tagged(spark, d):
    return windows(spark, d, tags=True).select(*BASE, F.col("tags")[0]["value"].alias("tag"))


@query("WITH " + _sql_windows(timed=True) + f" SELECT {_BASE_SQL}, epoch_us(start_time) AS start_us, epoch_us(end_time) AS end_us FROM w")
def windows_event_time(spark, d):
    return windows(spark, d, timed=True).select(*BASE, F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"))


@query("WITH " + _sql_windows(segments=True) + f""" SELECT '{NAME}' AS window_name, key, source, 'Opened' AS kind, pos AS position, phase FROM t WHERE active
UNION ALL SELECT '{NAME}', key, source, 'Closed', pos, prev_phase FROM t WHERE prev""")
def transitions(spark, d):
    return pipeline(segments=True).transitions(events(spark, d)).select("window_name", "key", "source", "kind", F.col("pos").alias("position"), F.col("segments")[0]["value"].alias("phase"))


def _roll_sql(predicate: str, name: str, child: str = "key", parent: str = "parent", obs: str = "o") -> str:
    return f"""
{obs}d AS (SELECT *, CAST(active AS INT) - coalesce(lag(CAST(active AS INT)) OVER s, 0) AS d, CASE WHEN lag(active) OVER s IS NULL THEN 1 ELSE 0 END AS nw FROM {obs} WINDOW s AS (PARTITION BY {parent}, source, {child} ORDER BY pos)),
{obs}c AS (SELECT *, sum(d) OVER s AS ac, sum(nw) OVER s AS tc FROM {obs}d WINDOW s AS (PARTITION BY {parent}, source ORDER BY pos)),
{obs}s AS (SELECT *, coalesce(last_value(CASE WHEN changed THEN {predicate} END IGNORE NULLS) OVER (PARTITION BY {parent}, source ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS state FROM {obs}c),
{obs}p AS (SELECT *, lag(state, 1, false) OVER (PARTITION BY {parent}, source ORDER BY pos) AS old FROM {obs}s),
{obs}w AS (SELECT '{name}' AS window_name, {parent} AS key, source, pos AS start_position, lead(pos) OVER (PARTITION BY {parent}, source ORDER BY pos) AS end_position, state FROM {obs}p WHERE state <> old)"""


_OBS = W + ", o AS (SELECT key, source, pos, parent, grand, active, active <> prev AS changed FROM c),"
_ROLL = ["window_name", "key", "source", "start_position", "end_position"]


def _parent(active, roll_ups=(), projection=Projection()):
    return RollUp("Parent", F.concat(F.lit("p"), F.pmod(F.col("user_id"), F.lit(5))), active, projection, roll_ups)


def _rolled(spark, d, roll_up, **options):
    names = {roll_up.name, *(r.name for r in roll_up.roll_ups)}
    return windows(spark, d, roll_ups=(roll_up,), **options).where(F.col("window_name").isin(*names)).select(*_ROLL)


@query(_OBS + _roll_sql("ac > 0", "Parent") + " SELECT window_name, key, source, start_position, end_position FROM ow WHERE state")
def rollup_any(spark, d):
    return _rolled(spark, d, _parent(any_active))


@query(_OBS + _roll_sql("tc > 0 AND ac = tc", "Parent") + " SELECT window_name, key, source, start_position, end_position FROM ow WHERE state")
def rollup_all(spark, d):
    return _rolled(spark, d, _parent(all_active))


@query(_OBS + _roll_sql("ac >= 2", "Parent") + ", q AS (SELECT parent AS key, source, pos, grand, state AS active, state <> old AS changed FROM op)," + _roll_sql("ac > 0", "Grand", parent="grand", obs="q")
       + " SELECT window_name, key, source, start_position, end_position FROM ow WHERE state UNION ALL SELECT window_name, key, source, start_position, end_position FROM qw WHERE state")
def rollup_two_level(spark, d):
    # the grandparent of a parent is by the event's user, as observed
    grand = RollUp("Grand", F.concat(F.lit("g"), F.pmod(F.col("user_id"), F.lit(2))), any_active)
    return _rolled(spark, d, _parent(lambda a, t: a >= 2, (grand,)))


@query(_OBS + _roll_sql("ac > 0", "Parent") + " SELECT window_name, key, source, start_position, end_position FROM ow WHERE state")
def rollup_projected(spark, d):
    # every segment is dropped, so splits of the children do not show
    return _rolled(spark, d, _parent(any_active, projection=Projection(drop=("phase", "tone"))), segments=True)


# --- history ---------------------------------------------------------------------------------------------------


@query(W + f" SELECT {_BASE_SQL} FROM w WHERE source = '{TARGET}' AND key = 'k7'")
def query_by_source(spark, d):
    return history.Query(windows(spark, d)).window(NAME).key("k7").lane(TARGET).windows().select(*BASE)


@query("WITH " + _sql_windows(segments=True) + f" SELECT {_BASE_SQL} FROM w WHERE phase = 'x'")
def query_by_segment(spark, d):
    return history.Query(windows(spark, d, segments=True)).segment("phase", "x").segment("tone", "X").windows().select(*BASE)


@query("WITH " + _sql_windows(tags=True) + f" SELECT {_BASE_SQL} FROM w WHERE tag = 'click'")
def query_by_tag(spark, d):
    return history.Query(windows(spark, d, tags=True)).tag("type", "click").windows().select(*BASE)


@query(W + f" SELECT {_BASE_SQL} FROM w ORDER BY window_name DESC, key DESC, source DESC, start_position DESC LIMIT 1")
def latest_window(spark, d):
    return history.Query(windows(spark, d)).latest_window().select(*BASE)


@query(W + """, h AS (SELECT (max(event_id) + 1) // 2 AS h FROM events) SELECT record_id, start_position AS range_start, CASE WHEN end_position <= h THEN end_position ELSE h END AS range_end,
CASE WHEN end_position <= h THEN 'Final' ELSE 'Provisional' END AS finality FROM w, h WHERE start_position <= h""")
def snapshot_position(spark, d):
    return history.Query(windows(spark, d)).at((horizon(spark, d) - 1) // 2).windows().select("record_id", "range_start", "range_end", "finality")


@query("WITH " + _sql_windows(timed=True) + """, h AS (SELECT ts AS h FROM events WHERE event_id = (SELECT max(event_id) // 2 FROM events)) SELECT record_id, epoch_us(start_time) AS range_start, CASE WHEN end_time <= h THEN epoch_us(end_time) ELSE epoch_us(h) END AS range_end,
CASE WHEN end_time <= h THEN 'Final' ELSE 'Provisional' END AS finality FROM w, h WHERE start_time <= h""")
def snapshot_time(spark, d):
    rows = events(spark, d).where(F.col("event_id") == (horizon(spark, d) - 2) // 2).select(F.col("ts").cast("timestamp")).first()
    out = history.snapshot_at(windows(spark, d, timed=True), rows[0] if rows else None, "time")
    return out.select("record_id", F.unix_micros("range_start").alias("range_start"), F.unix_micros("range_end").alias("range_end"), "finality")


_SUM = "count(*) AS record_count, count(end_position) AS final_count, count(*) - count(end_position) AS provisional_count, count(end_position) AS measured_count, CAST(coalesce(sum(end_position - start_position), 0) AS BIGINT) AS total_length"


@query("WITH " + _sql_windows(segments=True) + f" SELECT phase AS value, {_SUM} FROM w GROUP BY phase")
def summarize_segment(spark, d):
    return history.summarize(windows(spark, d, segments=True), "segments", "phase")


@query("WITH " + _sql_windows(tags=True) + f" SELECT tag AS value, {_SUM} FROM w GROUP BY tag")
def summarize_tag(spark, d):
    return history.summarize(windows(spark, d, tags=True), "tags", "type")


@query(W + """, a AS (SELECT *, 'note-' || (start_position % 2) AS name, start_position + 100 * (i - 1) AS known_at, i AS revision FROM w, range(1, 4) AS g(i)),
h AS (SELECT (max(event_id) + 1) // 2 AS h FROM events) SELECT record_id, name, known_at, revision FROM a, h WHERE known_at <= h""")
def annotations_known_at(spark, d):
    rows = windows(spark, d)
    notes = rows.select(*history.START, F.concat(F.lit("note-"), F.col("start_position") % 2).alias("name"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq"))
    notes = history.annotated(notes.withColumns({"value": F.col("seq").cast("string"), "known_at": F.col("start_position") + 100 * (F.col("seq") - 1)}))
    known = history.annotations_known_at(notes, (horizon(spark, d) - 1) // 2)
    return history.annotations_for(rows, known).select("record_id", "name", "known_at", F.col("revision").cast("long").alias("revision"))


@query(W + """ SELECT a.window_name, a.key, a.record_id AS first_id, b.record_id AS second_id, greatest(a.start_position, b.start_position) AS range_start, least(a.end_position, b.end_position) AS range_end
FROM w a JOIN w b ON a.key = b.key AND a.start_position < b.end_position AND b.start_position < a.end_position AND (a.source, a.start_position) < (b.source, b.start_position)""")
def find_overlaps(spark, d):
    return history.find_overlaps(windows(spark, d)).select("window_name", "key", "first_id", "second_id", "range_start", "range_end")


@query(W + f""", t2 AS (SELECT * FROM w WHERE source = '{TARGET}' AND end_position IS NOT NULL), o AS (SELECT * FROM w WHERE source <> '{TARGET}' AND end_position IS NOT NULL),
p AS (SELECT DISTINCT record_id, key, unnest([t2.start_position, t2.end_position]) AS x FROM t2 UNION SELECT t2.record_id, t2.key, unnest([greatest(o.start_position, t2.start_position), least(o.end_position, t2.end_position)]) FROM t2 JOIN o ON o.key = t2.key AND o.start_position < t2.end_position AND t2.start_position < o.end_position),
g AS (SELECT record_id, key, x AS s, lead(x) OVER (PARTITION BY record_id ORDER BY x) AS e FROM p),
u AS (SELECT * FROM g WHERE e IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.key = g.key AND o.start_position <= g.s AND o.end_position >= g.e))
SELECT record_id, s AS range_start, e AS range_end FROM u""")
def find_residuals(spark, d):
    return history.find_residuals(windows(spark, d), TARGET).select("record_id", "range_start", "range_end")


# --- preparation -----------------------------------------------------------------------------------------------

_NORM = ["side", "selector", "record_id", "range_start", "range_end"]


@query(W + f" SELECT CASE WHEN source = '{TARGET}' THEN 'Target' ELSE 'Against' END AS side, source AS selector, record_id, start_position AS range_start, end_position AS range_end FROM w WHERE end_position IS NOT NULL")
def normalized_closed(spark, d):
    return align.normalized(windows(spark, d), plan(spark, d, open_policy="RequireClosed", horizon=None)).select(*_NORM)


@query(NORMAL + " SELECT CASE side WHEN 'T' THEN 'Target' ELSE 'Against' END AS side, source AS selector, record_id, s AS range_start, e AS range_end, open AS provisional FROM n")
def normalized_clipped(spark, d):
    return align.normalized(windows(spark, d), plan(spark, d)).select(*_NORM, "provisional")


@query(W + ", h AS (SELECT (max(event_id) + 1) // 2 AS h FROM events) SELECT record_id, CASE WHEN coalesce(end_position, start_position) > h THEN 'FutureWindowExcluded' END AS code FROM w, h")
def known_at(spark, d):
    p = plan(spark, d, known_at=(horizon(spark, d) - 1) // 2)
    return align.prepared(windows(spark, d), p).select("record_id", "code")


@query("WITH " + _sql_windows(timed=True) + f" SELECT CASE WHEN source = '{TARGET}' THEN 'Target' ELSE 'Against' END AS side, source AS selector, record_id, epoch_us(start_time) AS range_start, epoch_us(end_time) AS range_end FROM w WHERE end_position IS NOT NULL")
def event_time_axis(spark, d):
    return align.normalized(windows(spark, d, timed=True), plan(spark, d, axis="time", open_policy="RequireClosed", horizon=None)).select(*_NORM)


@query("WITH " + _sql_windows(segments=True) + ", h AS (SELECT max(event_id) + 2 AS h FROM events)" + f""",
i AS (SELECT *, CASE WHEN start_position = lag(end_position) OVER (PARTITION BY key, source, phase ORDER BY start_position) THEN 0 ELSE 1 END AS nw FROM w, h),
j AS (SELECT *, sum(nw) OVER (PARTITION BY key, source, phase ORDER BY start_position) AS isl FROM i)
SELECT key, source, phase, min(start_position) AS range_start, max(coalesce(end_position, h)) AS range_end, string_agg(record_id, '|' ORDER BY start_position) AS record_ids FROM j GROUP BY key, source, phase, isl""")
def coalesce(spark, d):
    # windows split by a segment meet end to start, in other contexts; scopes keep them apart
    rows = align.normalized(windows(spark, d, segments=True), plan(spark, d, coalesce_adjacent=True))
    return rows.select("key", "source", F.col("segments")[0]["value"].alias("phase"), "range_start", "range_end", ids("record_ids"))


@query(NORMAL + " SELECT CASE side WHEN 'T' THEN 'Target' ELSE 'Against' END AS side, key, source, s AS range_start, e AS range_end FROM n")
def dedupe(spark, d):
    twice = windows(spark, d)
    return align.normalized(twice.union(twice), plan(spark, d, duplicates="Reject")).select("side", "key", "source", "range_start", "range_end")


@query(W + " SELECT record_id, CASE WHEN end_position IS NULL THEN 'OpenWindowsWithoutPolicy' END AS code, CASE WHEN end_position IS NULL THEN 'Error' END AS severity FROM w WHERE end_position IS NULL")
def exclusions(spark, d):
    return align.prepared(windows(spark, d), plan(spark, d, open_policy="RequireClosed", horizon=None)).where("code IS NOT NULL").select("record_id", "code", "severity")


# --- comparators -----------------------------------------------------------------------------------------------


@query(SEG + " SELECT window_name, key, range_start, range_end, target_ids, against_ids FROM seg")
def aligned(spark, d):
    seg, _ = _aligned(spark, d)
    return seg.select(*RANGE, F.array_join(comparators.ids("targets"), "|").alias("target_ids"), F.array_join(comparators.ids("againsts"), "|").alias("against_ids"))


@query(SEG + " SELECT window_name, key, range_start, range_end, n_t AS n_target, n_a AS n_against FROM seg")
def sweep(spark, d):
    return align.sweep(align.normalized(windows(spark, d), plan(spark, d))).select(*RANGE, "n_target", "n_against")


@query(SEG + f" SELECT window_name, key, range_start, range_end, target_ids, against_ids, {_FIN} FROM seg WHERE n_t > 0 AND n_a > 0")
def overlap(spark, d):
    return _rows(spark, d, "overlap").select(*RANGE, ids("target_ids"), ids("against_ids"), "finality")


@query(SEG + f" SELECT window_name, key, range_start, range_end, target_ids, {_FIN} FROM seg WHERE n_t > 0 AND n_a = 0")
def residual(spark, d):
    return _rows(spark, d, "residual").select(*RANGE, ids("target_ids"), "finality")


@query(SEG + f" SELECT window_name, key, range_start, range_end, against_ids, {_FIN} FROM seg WHERE n_t = 0 AND n_a > 0")
def missing(spark, d):
    return _rows(spark, d, "missing").select(*RANGE, ids("against_ids"), "finality")


@query(SEG + f" SELECT window_name, key, range_start, range_end, CAST(range_end - range_start AS DOUBLE) AS target_magnitude, CAST(CASE WHEN n_a > 0 THEN range_end - range_start ELSE 0 END AS DOUBLE) AS covered_magnitude, {_FIN} FROM seg WHERE n_t > 0")
def coverage(spark, d):
    return _rows(spark, d, "coverage").select(*RANGE, "target_magnitude", "covered_magnitude", "finality")


_COVERAGE_SUMMARY = """ SELECT window_name, key, CAST(sum(range_end - range_start) AS DOUBLE) AS target_magnitude, CAST(coalesce(sum(range_end - range_start) FILTER (n_a > 0), 0) AS DOUBLE) AS covered_magnitude,
CAST(coalesce(sum(range_end - range_start) FILTER (n_a > 0), 0) AS DOUBLE) / CAST(sum(range_end - range_start) AS DOUBLE) AS coverage_ratio FROM seg WHERE n_t > 0 GROUP BY window_name, key"""


@query(SEG + _COVERAGE_SUMMARY)
def coverage_summary(spark, d):
    """From the sweep: no identifiers are needed."""
    seg = align.sweep(align.normalized(windows(spark, d), plan(spark, d))).where("n_target > 0")
    length = (F.col("range_end") - F.col("range_start")).cast("double")
    rows = seg.withColumns({"target_magnitude": length, "covered_magnitude": F.when(F.col("n_against") > 0, length).otherwise(0.0)})
    return comparators.coverage_summary(rows).drop("partition")


@query(SEG + " SELECT * FROM (SELECT window_name, key, range_end AS range_start, lead(range_start) OVER (PARTITION BY window_name, key ORDER BY range_start) AS range_end FROM seg) WHERE range_start < range_end")
def gap(spark, d):
    return _rows(spark, d, "gap").select(*RANGE)


@query(SEG + f" SELECT window_name, key, range_start, range_end, CASE WHEN n_t > 0 THEN 'Target' ELSE 'Against' END AS side, {_FIN} FROM seg WHERE (n_t > 0) <> (n_a > 0)")
def symmetric_difference(spark, d):
    return _rows(spark, d, "symmetric-difference").select(*RANGE, "side", "finality")


@query(SEG + """ SELECT window_name, key, range_start, range_end, 'Contained' AS status, target_ids FROM seg WHERE n_t > 0 AND n_a > 0
UNION ALL SELECT g.window_name, g.key, range_start, range_end, CASE WHEN n.s = range_start THEN 'LeftOverhang' WHEN n.e = range_end THEN 'RightOverhang' ELSE 'NotContained' END, n.record_id
FROM seg g JOIN n ON n.key = g.key AND n.side = 'T' AND n.s <= range_start AND n.e >= range_end AND n.s < n.e WHERE n_a = 0""")
def containment(spark, d):
    return _rows(spark, d, "containment").select(*RANGE, "status", ids("target_ids"))


def _nearest_sql(point: str) -> str:
    return NORMAL + f""", a AS (SELECT key, {point} AS p, min_by(record_id, (source, s, e)) AS id FROM n WHERE side = 'A' GROUP BY key, {point}),
m AS (SELECT n.key, n.record_id AS target_id, n.{point} AS target_point, (SELECT max(p) FROM a WHERE a.key = n.key AND p <= n.{point}) AS lo, (SELECT min(p) FROM a WHERE a.key = n.key AND p >= n.{point}) AS hi FROM n WHERE side = 'T'),
x AS (SELECT *, CASE WHEN hi IS NULL OR (lo IS NOT NULL AND target_point - lo <= hi - target_point) THEN lo ELSE hi END AS comparison_point FROM m),
y AS (SELECT x.*, target_point - comparison_point AS delta, a.id AS against_id FROM x LEFT JOIN a ON a.key = x.key AND a.p = comparison_point),
z AS (SELECT *, CASE WHEN delta IS NULL THEN 'MissingComparison' WHEN delta = 0 THEN 'Equal' WHEN delta < 0 THEN 'TargetLeads' ELSE 'TargetLags' END AS direction, coalesce(abs(delta) <= 20, false) AS is_within FROM y)"""


_LL = ["key", "target_id", "target_point", "comparison_point", "delta", "direction", "is_within", "against_id"]


def _lead_lag(spark, d, transition):
    return _rows(spark, d, lead_lag(transition, 20))


@query(_nearest_sql("s") + f" SELECT {', '.join(_LL)} FROM z")
def lead_lag_start(spark, d):
    return _lead_lag(spark, d, "Start").select(*_LL)


@query(_nearest_sql("e") + f" SELECT {', '.join(_LL)} FROM z")
def lead_lag_end(spark, d):
    return _lead_lag(spark, d, "End").select(*_LL)


@query(_nearest_sql("s") + """ SELECT 'Start' AS transition, 'position' AS axis, CAST(20 AS BIGINT) AS tolerance, count(*) AS row_count, count(*) FILTER (direction = 'TargetLeads') AS lead_count, count(*) FILTER (direction = 'TargetLags') AS lag_count,
count(*) FILTER (direction = 'Equal') AS equal_count, count(*) FILTER (direction = 'MissingComparison') AS missing_count, count(*) FILTER (NOT is_within) AS outside_count, min(delta) AS min_delta, max(delta) AS max_delta FROM z""")
def lead_lag_summary(spark, d):
    return comparators.lead_lag_summary(_lead_lag(spark, d, "Start"))


def _asof_sql(direction: str) -> str:
    pick = {"Previous": "lo", "Next": "hi", "Nearest": "CASE WHEN hi IS NULL OR target_point - lo <= hi - target_point THEN lo ELSE hi END"}[direction]
    tie = "lo IS NOT NULL AND hi IS NOT NULL AND lo <> hi AND target_point - lo = hi - target_point" if direction == "Nearest" else "false"
    rejected = "p IS NULL AND hi IS NOT NULL" if direction == "Previous" else "false"
    return NORMAL + f""", a AS (SELECT key, s AS p, count(*) AS k, min(record_id) AS id FROM n WHERE side = 'A' GROUP BY key, s),
m AS (SELECT n.key, n.record_id AS target_id, n.s AS target_point, (SELECT max(p) FROM a WHERE a.key = n.key AND p <= n.s) AS lo, (SELECT min(p) FROM a WHERE a.key = n.key AND p >= n.s) AS hi FROM n WHERE side = 'T'),
x AS (SELECT *, {pick} AS p, {tie} AS tied FROM m),
y AS (SELECT x.key, target_id, target_point, hi, x.p, tied, CASE WHEN tied THEN b.k + c.k ELSE a.k END AS k, CASE WHEN tied THEN least(b.id, c.id) ELSE a.id END AS id, CASE WHEN tied AND c.id < b.id THEN hi ELSE x.p END AS q
      FROM x LEFT JOIN a ON a.key = x.key AND a.p = x.p LEFT JOIN a b ON b.key = x.key AND b.p = lo LEFT JOIN a c ON c.key = x.key AND c.p = hi),
z AS (SELECT *, CASE WHEN {rejected} THEN 'FutureRejected' WHEN p IS NULL OR abs(target_point - p) > 30 THEN 'NoMatch' WHEN k > 1 THEN 'Ambiguous' WHEN p = target_point THEN 'Exact' ELSE 'Matched' END AS status FROM y)
SELECT key, target_id, target_point, CASE WHEN status IN ('Exact', 'Matched', 'Ambiguous') THEN q END AS matched_point, CASE WHEN status = 'FutureRejected' THEN hi - target_point ELSE abs(target_point - p) END AS distance, status,
CASE WHEN status IN ('Exact', 'Matched', 'Ambiguous') THEN id END AS matched_id FROM z"""


def _asof(spark, d, direction):
    return _rows(spark, d, as_of(direction, 30)).select("key", "target_id", "target_point", "matched_point", "distance", "status", "matched_id")


@query(_asof_sql("Previous"))
def asof_previous(spark, d):
    return _asof(spark, d, "Previous")


@query(_asof_sql("Next"))
def asof_next(spark, d):
    return _asof(spark, d, "Next")


@query(_asof_sql("Nearest"))
def asof_nearest(spark, d):
    return _asof(spark, d, "Nearest")


@query(_asof_sql("Nearest").rpartition("SELECT key, target_id")[0] + "SELECT 'AmbiguousAsOfMatch' AS code, 'asof[' || target_id || ']' AS path FROM z WHERE status = 'Ambiguous'")
def asof_diagnostics(spark, d):
    return _result(spark, d, as_of("Nearest", 30)).row_diagnostics().select("code", "path")


_COUNTS = [("overlap", "n_t > 0 AND n_a > 0"), ("residual", "n_t > 0 AND n_a = 0"), ("missing", "n_t = 0 AND n_a > 0"), ("coverage", "n_t > 0")]


@query(SEG + " " + " UNION ALL ".join(f"SELECT '{n}' AS row_type, {_FIN}, count(*) AS n FROM seg WHERE {c} GROUP BY ALL" for n, c in _COUNTS))
def row_finality(spark, d):
    rows = _result(spark, d, *(n for n, _ in _COUNTS)).row_finalities()
    return rows.groupBy("row_type", "finality").agg(F.count("*").alias("n"))


@query(SEG + " " + " UNION ALL ".join(f"SELECT '{n}' AS comparator, count(*) AS row_count FROM seg WHERE {c}" for n, c in _COUNTS))
def comparator_summary(spark, d):
    return _result(spark, d, *(n for n, _ in _COUNTS)).summary()


# --- cohorts ---------------------------------------------------------------------------------------------------


def _cohort(spark, d, name, count=None):
    return _rows(spark, d, "residual", (Selector.for_cohort(OTHERS, Activity(name, count)).named("others"),)).select(*RANGE, ids("target_ids"), "finality")


def _cohort_sql(active: str) -> str:
    return SEG + f" SELECT window_name, key, range_start, range_end, target_ids, {_FIN} FROM seg WHERE n_t > 0 AND NOT ({active})"


def _add_cohorts():
    for suffix, name, count, sql in (("any", "any", None, "n_s >= 1"), ("all", "all", None, "n_s = 2"), ("none", "none", None, "n_s = 0"), ("at_least", "at-least", 2, "n_s >= 2"), ("at_most", "at-most", 1, "n_s <= 1"), ("exactly", "exactly", 1, "n_s = 1")):

        def run(spark, d, name=name, count=count):
            return _cohort(spark, d, name, count)

        run.__name__ = f"cohort_{suffix}"
        query(_cohort_sql(sql))(run)


_add_cohorts()


@query(SEG + """ SELECT window_name, key, range_start, range_end, 'rule=at-least:2; required=2; activeCount=' || n_s || '; isActive=' || CASE WHEN n_s >= 2 THEN 'true' ELSE 'false' END || '; activeSources=' || coalesce(sources, '') AS evidence FROM seg""")
def cohort_evidence(spark, d):
    seg, p = _aligned(spark, d, (Selector.for_cohort(OTHERS, Activity("at-least", 2)),))
    return comparators.cohort_evidence(seg, p).select(*RANGE, "evidence")


# --- analytics -------------------------------------------------------------------------------------------------


@query(W + """, l AS (SELECT DISTINCT 'lane-' || i AS source FROM range(4) AS g(i)), n AS (SELECT * FROM w WHERE end_position IS NOT NULL AND key <> 'k0'),
pr AS (SELECT a.source AS target, b.source AS against FROM l a, l b), o AS (SELECT source, bool_or(end_position IS NULL) AS open FROM w GROUP BY source),
ps AS (SELECT DISTINCT target, against, key, unnest([start_position, end_position]) AS p FROM pr JOIN w ON w.source IN (target, against) AND target <> against WHERE end_position IS NOT NULL),
sg AS (SELECT target, against, key, p AS s, lead(p) OVER (PARTITION BY target, against, key ORDER BY p) AS e FROM ps),
cv AS (SELECT g.*, EXISTS (SELECT 1 FROM w WHERE w.key = g.key AND w.source = target AND start_position <= s AND end_position >= e) AS t, EXISTS (SELECT 1 FROM w WHERE w.key = g.key AND w.source = against AND start_position <= s AND end_position >= e) AS a FROM sg g WHERE e IS NOT NULL),
ct AS (SELECT target, against, count(*) FILTER (t AND a) AS o, count(*) FILTER (t AND NOT a) AS r, count(*) FILTER (a AND NOT t) AS m, count(*) FILTER (t) AS c, sum(e - s) FILTER (t AND a) AS cov, sum(e - s) FILTER (t) AS tot FROM cv GROUP BY ALL),
fin AS (SELECT pr.target, pr.against, pr.target = pr.against AS dg, x.source IS NOT NULL AS th, y.source IS NOT NULL AS ah, pr.target = pr.against OR coalesce(x.open, false) OR coalesce(y.open, false) AS bl, ct.* EXCLUDE (target, against)
        FROM pr LEFT JOIN o x ON x.source = pr.target LEFT JOIN o y ON y.source = pr.against LEFT JOIN ct ON ct.target = pr.target AND ct.against = pr.against)
SELECT target, against, dg AS is_diagonal, th AS target_has_windows, ah AS against_has_windows, CASE WHEN bl THEN 0 ELSE coalesce(o, 0) END AS overlap_rows, CASE WHEN bl THEN 0 ELSE coalesce(r, 0) END AS residual_rows,
CASE WHEN bl THEN 0 ELSE coalesce(m, 0) END AS missing_rows, CASE WHEN bl THEN 0 ELSE coalesce(c, 0) END AS coverage_rows, CASE WHEN dg THEN CASE WHEN th THEN 1.0::DOUBLE END WHEN bl THEN NULL WHEN coalesce(tot, 0) > 0 THEN CAST(coalesce(cov, 0) AS DOUBLE) / CAST(tot AS DOUBLE) END AS coverage_ratio FROM fin""")
def source_matrix(spark, d):
    return analytics.source_matrix(windows(spark, d), NAME, [TARGET, *OTHERS, "lane-3"])


@query(_OBS + _roll_sql("ac >= 2", "Parent") + """, n AS (SELECT source, start_position AS s, end_position AS e, 'P' AS side FROM ow WHERE state AND end_position IS NOT NULL UNION ALL SELECT source, start_position, end_position, 'C' FROM w WHERE end_position IS NOT NULL),
pts AS (SELECT DISTINCT source, unnest([s, e]) AS p FROM n), sg AS (SELECT source, p AS s, lead(p) OVER (PARTITION BY source ORDER BY p) AS e FROM pts),
g AS (SELECT sg.source, sg.s, sg.e, count(*) FILTER (side = 'P') AS np, count(*) FILTER (side = 'C') AS nc FROM sg JOIN n ON n.source = sg.source AND n.s <= sg.s AND n.e >= sg.e GROUP BY ALL)
SELECT CASE WHEN np > 0 AND nc > 0 THEN 'ParentExplained' WHEN np > 0 THEN 'UnexplainedParent' ELSE 'OrphanChild' END AS kind, source, s AS range_start, e AS range_end, np AS n_parents, nc AS n_children FROM g""")
def hierarchy(spark, d):
    rows = analytics.hierarchy(windows(spark, d, roll_ups=(_parent(lambda a, t: a >= 2),)), "Parent", NAME)
    return rows.select("kind", "source", "range_start", "range_end", F.size("parent_ids").cast("long").alias("n_parents"), F.size("child_ids").cast("long").alias("n_children"))


_FINALITIES = """, h AS (SELECT (max(event_id) // 4) * 2 + 1 AS h1, (max(event_id) // 2) * 2 AS h2 FROM events)"""


def _halves(spark, d):
    n = horizon(spark, d) - 2
    return _finalities(spark, d, n // 4 * 2 + 1), _finalities(spark, d, n // 2 * 2)


def _finalities(spark, d, at):
    """Finality rows of a snapshot; identifiers are start identities, so that later rows do not renumber earlier ones."""
    rows = history.snapshot_at(windows(spark, d), at)
    reason = F.concat(F.lit("ends at "), F.col("range_end").cast("string"))
    return rows.select(F.lit("window").alias("row_type"), F.concat_ws("/", "key", "source", "start_position").alias("row_id"), F.lit(1).cast("long").alias("version"), "finality", reason.alias("reason"))


_SNAP = "SELECT key || '/' || source || '/' || start_position AS row_id, CASE WHEN end_position <= {h} THEN 'Final' ELSE 'Provisional' END AS finality, 'ends at ' || CASE WHEN end_position <= {h} THEN end_position ELSE {h} END AS reason FROM w, h WHERE start_position <= {h}"
_LOG = W + _FINALITIES + f""", p AS ({_SNAP.format(h='h1')}), q AS ({_SNAP.format(h='h2')}),
g AS (SELECT 'window' AS row_type, coalesce(q.row_id, p.row_id) AS row_id, CASE WHEN p.row_id IS NULL THEN CAST(1 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS version, CASE WHEN p.row_id IS NULL THEN q.finality WHEN q.row_id IS NULL THEN 'Retracted' ELSE 'Revised' END AS finality,
      p.row_id AS supersedes, CASE WHEN q.row_id IS NULL THEN 'the row is no longer there' ELSE q.reason END AS reason
      FROM p FULL JOIN q ON p.row_id = q.row_id WHERE p.row_id IS NULL OR q.row_id IS NULL OR p.finality <> q.finality OR p.reason <> q.reason)"""


@query(_LOG + " SELECT * FROM g")
def changelog_create(spark, d):
    return analytics.changelog(*_halves(spark, d))


@query(_LOG + """ SELECT row_type, row_id, version, CASE finality WHEN 'Revised' THEN 'Final' ELSE finality END AS finality, reason FROM g WHERE finality <> 'Retracted'
UNION ALL SELECT 'window', row_id, CAST(1 AS BIGINT), finality, reason FROM p WHERE row_id NOT IN (SELECT row_id FROM g)""")
def changelog_replay(spark, d):
    before, after = _halves(spark, d)
    return analytics.replay(before, analytics.changelog(before, after)).drop("supersedes")


@query("""WITH b AS (SELECT 'k' || (user_id % 40) AS lane, event_id AS p FROM events), m AS (SELECT max(event_id) AS h FROM events),
n AS (SELECT lane, p, lead(p) OVER (PARTITION BY lane ORDER BY p) AS nx FROM b)
SELECT lane, p + 100 AS silent_from, nx AS silent_until FROM n, m WHERE p + 100 <= coalesce(nx - 1, h)""")
def liveness_silence(spark, d):
    return analytics.silences(events(spark, d), F.concat(F.lit("k"), F.pmod(F.col("user_id"), F.lit(40))), F.col("event_id"), 100, F.lit(horizon(spark, d) - 2))


@query("""WITH l AS (SELECT DISTINCT 'k' || (user_id % 40) AS lane FROM events), m AS (SELECT max(event_id) AS h FROM events),
b AS (SELECT lane, CAST(0 AS BIGINT) AS p, true AS s FROM l UNION ALL SELECT 'k' || (user_id % 40), event_id, false FROM events),
n AS (SELECT lane, p, s, p + 100 AS q, (p + 149) // 50 * 50 AS c, lead(p) OVER o AS nx, lag(s) OVER o AS fst FROM b WINDOW o AS (PARTITION BY lane ORDER BY p, s DESC)),
g AS (SELECT n.*, c <= h AND c < coalesce(nx, c + 1) AS silent FROM n, m),
a AS (SELECT g.*, lag(silent) OVER (PARTITION BY lane ORDER BY p, s DESC) AS after FROM g)
SELECT lane, false AS is_silent, p AS occurred_at, p AS evaluated_at, CAST(100 AS BIGINT) AS threshold FROM a WHERE NOT s AND (fst OR after)
UNION ALL SELECT lane, true, q, c, CAST(100 AS BIGINT) FROM a WHERE silent""")
def liveness_signals(spark, d):
    lane = F.concat(F.lit("k"), F.pmod(F.col("user_id"), F.lit(40)))
    lanes = events(spark, d).select(lane.alias("lane")).distinct()
    return analytics.liveness_signals(events(spark, d), lane, F.col("event_id"), lanes, 100, 0, horizon(spark, d) - 2, every=50)
