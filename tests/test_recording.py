"""Recording and roll-ups against a plain state machine; history reads."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark import Pipeline, Projection, RollUp, Segment, Tag, WindowDefinition, all_active, any_active
from tidemark.operators import history
from tidemark.sources.windows import HistoryBuilder


def made(spark, seed, n=150):
    rng = random.Random(seed)
    rows = [(i + 1, rng.choice("kl"), rng.choice(["s", "t", None]), rng.random() < 0.6, rng.choice("xy"), rng.choice("pq")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "pos long, key string, source string, on boolean, phase string, zone string").repartition(4)


def machine(rows, segments):
    state, out = {}, []
    for pos, key, source, on, phase, _ in rows:
        held = state.get((key, source))
        if held and (not on or segments and phase != held[1]):
            out.append((key, source, held[0], pos, held[1] if segments else None, "SegmentChanged" if on else "ActivePredicateEnded"))
            del state[key, source]
            held = None
        if on and not held:
            state[key, source] = (pos, phase)
    return sorted(out + [(k, s, p, None, ph if segments else None, None) for (k, s), (p, ph) in state.items()], key=str)


def definition(segments=False, **more):
    return WindowDefinition("W", F.col("key"), F.col("on"), (Segment("phase", F.col("phase")),) if segments else (), (Tag("zone", F.col("zone")),), **more)


@pytest.mark.parametrize("segments", [False, True])
def test_windows_equal_a_state_machine(spark, segments):
    rows, events = made(spark, 5)
    w = Pipeline((definition(segments),), F.col("pos"), F.col("source")).windows(events)
    got = sorted([(r.key, r.source, r.start_position, r.end_position, r.segments[0].value if segments else None, r.boundary_reason) for r in w.collect()], key=str)
    assert got == machine(rows, segments)
    opened = {r[0]: r[5] for r in rows}
    assert all(r.tags[0].value == opened[r.start_position] for r in w.collect()) and w.select("record_id").distinct().count() == len(got)


@pytest.mark.parametrize(("rule", "test"), [(any_active, lambda a, t: a > 0), (all_active, lambda a, t: t > 0 and a == t)])
def test_roll_up_equals_a_state_machine(spark, rule, test):
    rows, events = made(spark, 6)
    rows = [(p, k + z, s, o, ph, z) for p, k, s, o, ph, z in rows]
    events = events.withColumn("key", F.concat("key", "zone"))
    pipe = Pipeline((definition(roll_ups=(RollUp("Zone", F.col("zone"), rule),)),), F.col("pos"), F.col("source"))
    got = sorted([(r.key, r.source, r.start_position, r.end_position) for r in pipe.windows(events).where("window_name = 'Zone'").collect()], key=str)
    children, parents, out = {}, {}, []
    for pos, key, source, on, _, zone in rows:
        own = children.setdefault((zone, source), {})
        changed = on != own.get(key, False)
        own[key] = on
        if changed:
            now = test(sum(own.values()), len(own))
            if now and (zone, source) not in parents:
                parents[zone, source] = pos
            elif not now and (zone, source) in parents:
                out.append((zone, source, parents.pop((zone, source)), pos))
    assert got == sorted(out + [(z, s, p, None) for (z, s), p in parents.items()], key=str)


def test_projection():
    p = Projection(preserve=("phase", "tone"), drop=("tone",), rename={"phase": "state"})
    with pytest.raises(ValueError):
        p.check(["phase", "tone"])
    assert Projection(rename={"phase": "state"}).check(["phase", "tone"]) == ["state", "tone"]
    with pytest.raises(ValueError):
        Projection(rename={"phase": "tone"}).check(["phase", "tone"])


def test_projected_contexts(spark):
    rows = [(1, "d", "s", True, "x", "z"), (2, "d", "s", True, "y", "z"), (3, "d", "s", False, "y", "z")]
    events = spark.createDataFrame(rows, "pos long, key string, source string, on boolean, phase string, zone string")

    def zones(projection):
        pipe = Pipeline((definition(True, roll_ups=(RollUp("Zone", F.col("zone"), any_active, projection),)),), F.col("pos"))
        return sorted((r.start_position, r.end_position, [s.value for s in r.segments]) for r in pipe.windows(events).where("window_name = 'Zone'").collect())

    assert zones(Projection()) == [(1, 2, ["x"]), (2, 3, ["y"])] and zones(Projection(drop=("phase",))) == [(1, 3, [])]
    assert zones(Projection(transform={"phase": F.upper})) == [(1, 2, ["X"]), (2, 3, ["Y"])]


def test_definitions_are_checked(spark):
    with pytest.raises(ValueError):
        Pipeline((definition(), definition()), F.col("pos"))
    with pytest.raises(PySparkException):
        Pipeline((definition(),), F.col("pos")).windows(spark.createDataFrame([(1, None, "s", True, "x", "z")], "pos long, key string, source string, on boolean, phase string, zone string")).collect()
    assert [n for m in Pipeline((definition(roll_ups=(RollUp("Z", F.col("zone"), any_active),)),), F.col("pos")).metadata() for n in m.names()] == ["W", "Z"]


def test_history_reads(spark):
    w = HistoryBuilder().closed("W", "k", 1, 5, "a", segments=[("phase", "x"), ("n", 1)]).closed("W", "k", 3, 9, "b", tags=[("hot", True)]).open("W", "k", 4, "a").closed("V", "k", 1, 2).build(spark)
    q = history.Query(w)
    assert q.window("W").closed_windows().count() == 2 and q.open_windows().count() == 1 and q.lane("a").segment("phase", "x").windows().count() == 1
    assert q.segment("n", "1").windows().count() == 0 and q.segment("n", 1).windows().count() == 1 and q.tag("hot", True).windows().count() == 1 and q.source(None).windows().count() == 1
    assert q.latest_window().first().start_position == 3 and q.window("W").lane("a").latest_window().first().end_position is None
    snap = {(r.source, r.start_position): (r.range_end, r.finality) for r in q.window("W").at(6).windows().collect()}
    assert snap == {("a", 1): (5, "Final"), ("b", 3): (6, "Provisional"), ("a", 4): (6, "Provisional")}
    with pytest.raises(ValueError):
        q.at(6).at(5)
    s = history.summarize(w, "segments", "phase").first()
    assert (s.value, s.record_count, s.total_length) == ("x", 1, 4)
    assert [tuple(r) for r in history.find_residuals(HistoryBuilder().closed("W", "k", 1, 9, "a").closed("W", "k", 2, 4, "b").closed("W", "k", 3, 5, "c").build(spark), "a").select("range_start", "range_end").orderBy("range_start").collect()] == [(1, 2), (5, 9)]


def test_annotations(spark):
    w = HistoryBuilder().closed("W", "k", 1, 5).build(spark)
    notes = spark.createDataFrame([("W", "k", None, None, 1, "note", "one", 3, 1), ("W", "k", None, None, 1, "note", "two", None, 2)], "window_name string, key string, source string, partition string, start_position long, name string, value string, known_at long, seq long")
    notes = history.annotated(notes)
    assert sorted((r.value, r.revision) for r in history.annotations_for(w, notes).collect()) == [("one", 1), ("two", 2)]
    assert [r.value for r in history.annotations_known_at(notes, 5).collect()] == ["one"]


def test_annotate_appends(spark):
    import datetime

    w = HistoryBuilder().closed("W", "k", 1, 5).closed("W", "l", 2, 6).build(spark)
    notes = history.annotate(w, "note", "one", F.lit(3))
    notes = history.annotate(w.where("key = 'k'"), "note", "two", F.lit("2024-01-02"), "time", notes)
    notes = history.annotate(w, "note", "three", existing=notes)
    found = lambda rows: sorted((r.key, r.value, r.revision) for r in rows.collect())
    assert found(notes) == [("k", "one", 1), ("k", "three", 3), ("k", "two", 2), ("l", "one", 1), ("l", "three", 2)]
    assert found(history.annotations_known_at(notes, 3)) == [("k", "one", 1), ("l", "one", 1)] and found(history.annotations_known_at(notes, 2)) == []
    assert found(history.annotations_known_at(notes, datetime.datetime(2024, 1, 3), "time")) == [("k", "two", 2)]
    assert history.annotations_for(w, notes).count() == 5
    for call in (lambda: history.annotate(w, "n", "v", axis="unknown"), lambda: history.annotations_known_at(notes, 1, "unknown")):
        with pytest.raises(ValueError):
            call()
