"""Comparators, cohorts, known-at, live horizons and analytics on small hand-made histories."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import Activity, Scope, Selector, as_of, comparison, lead_lag
from tidemark.operators import align, analytics, comparators
from tidemark.sources.windows import HistoryBuilder

NAME = "DeviceOffline"


def history(spark, rows):
    """(source, start, end) of one device."""
    b = HistoryBuilder()
    for source, start, end, *rest in rows:
        extra = dict(zip(("segments", "tags"), rest))
        b.closed(NAME, "d", start, end, source, **extra) if end is not None else b.open(NAME, "d", start, source, **extra)
    return b.build(spark)


def run(spark, rows, *names, against=("b",), cohort=None, strict=False, window=NAME, live=None, **n):
    b = comparison(history(spark, rows), "test").target("a", Selector.for_source("a")).within(window=window).using(*names).normalize(**n)
    b = b.against_cohort("c", against, cohort) if cohort else b
    for s in () if cohort else against:
        b = b.against(s, Selector.for_source(s))
    b = b.strict() if strict else b
    return b.run_live(live) if live is not None else b.run()


def ranges(df, *more):
    return sorted((r.range_start, r.range_end, *(r[m] for m in more)) for r in df.collect())


def test_basic_overlap(spark):
    r = run(spark, [("a", 1, 5), ("b", 3, 7)], "overlap", "residual", "coverage", "missing", "symmetric-difference")
    assert r.is_valid
    assert ranges(r.rows("overlap")) == [(3, 5)] and ranges(r.rows("residual")) == [(1, 3)] and ranges(r.rows("missing")) == [(5, 7)]
    assert ranges(r.rows("symmetric-difference"), "side") == [(1, 3, "Target"), (5, 7, "Against")]
    assert {x.comparator: x.row_count for x in r.summary().collect()} == {"overlap": 1, "residual": 1, "coverage": 2, "missing": 1, "symmetric-difference": 2}
    assert r.coverage_summary().first().coverage_ratio == 0.5
    assert comparators.total_length(r.rows("overlap")) == 2


def test_segments_keep_scopes_apart(spark):
    x, y = [("lifecycle", "Incident"), ("stage", "Escalated", "lifecycle")], [("lifecycle", "Normal")]
    r = comparison(history(spark, [("a", 1, 5, x, [("fleet", "critical")]), ("b", 1, 5, y, [("fleet", "critical")])]), "s").target("a", Selector.for_source("a")).against("b", Selector.for_source("b"))
    r = r.within(window=NAME, segments=(("lifecycle", "Incident"), ("stage", "Escalated")), tags=(("fleet", "critical"),)).using("residual").run()
    assert ranges(r.rows("residual")) == [(1, 5)]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("a", 2, 4), ("b", 1, 5)], [(2, 4, "Contained")]),
        ([("a", 1, 7), ("b", 3, 5)], [(1, 3, "LeftOverhang"), (3, 5, "Contained"), (5, 7, "RightOverhang")]),
        ([("a", 1, 7), ("b", 1, 3), ("b", 3, 7)], [(1, 3, "Contained"), (3, 7, "Contained")]),
        ([("a", 1, 9), ("b", 2, 3), ("b", 5, 6)], [(1, 2, "LeftOverhang"), (2, 3, "Contained"), (3, 5, "NotContained"), (5, 6, "Contained"), (6, 9, "RightOverhang")]),
    ],
)
def test_containment(spark, rows, want):
    assert ranges(run(spark, rows, "containment").rows("containment"), "status") == want


def test_gap(spark):
    assert ranges(run(spark, [("a", 1, 3), ("b", 5, 7)], "gap").rows("gap")) == [(3, 5)]
    assert ranges(run(spark, [("a", 1, 3)], "gap").rows("gap")) == []


@pytest.mark.parametrize(
    ("rows", "members", "activity", "length"),
    [
        ([("a", 1, 11), ("b", 1, 6), ("c", 6, 11)], ("b", "c"), Activity("any"), 0),
        ([("a", 1, 11), ("b", 1, 6), ("c", 6, 11)], ("b", "c"), Activity("all"), 10),
        ([("a", 1, 11), ("b", 1, 11), ("c", 1, 6), ("d", 6, 11)], ("b", "c", "d"), Activity("at-least", 2), 0),
        ([("a", 1, 11), ("b", 1, 11), ("c", 1, 6)], ("b", "c"), Activity("at-most", 1), 5),
        ([("a", 1, 11), ("b", 1, 11), ("c", 1, 6)], ("b", "c"), Activity("exactly", 1), 5),
        ([("a", 1, 11), ("b", 1, 6)], ("b", "c"), Activity("none"), 5),
    ],
)
def test_cohorts(spark, rows, members, activity, length):
    assert comparators.total_length(run(spark, rows, "residual", against=members, cohort=activity).rows("residual")) == length


def test_cohort_rules_are_checked():
    for bad in (("at-least", None), ("any", 1), ("at-least", 0), ("most", None)):
        with pytest.raises(ValueError):
            Activity(*bad)
    with pytest.raises(ValueError):
        Selector.for_cohort(("b",), Activity("at-least", 2))


def test_known_at_leaves_the_future_out(spark):
    r = run(spark, [("a", 1, 6), ("b", 1, 6), ("c", 1, 11)], "residual", against=("b", "c"), cohort=Activity("at-least", 2), known_at=6)
    assert comparators.total_length(r.rows("residual")) == 5 and [d.code for d in r.warnings()] == ["FutureWindowExcluded"]


def test_open_windows(spark):
    blocked = run(spark, [("a", 1, None)], "residual")
    assert not blocked.is_valid and blocked.rows("residual").count() == 0 and {"OpenWindowsWithoutPolicy", "UnboundedOpenDuration"} <= {d.code for d in blocked.diagnostics}
    live = run(spark, [("a", 1, None)], "residual", live=10)
    assert ranges(live.rows("residual"), "finality") == [(1, 10, "Provisional")]
    assert not run(spark, [("a", 11, None)], "residual", live=10).is_valid


def test_point_comparators(spark):
    r = run(spark, [("a", 10, 20), ("b", 7, 19), ("b", 14, 30)], lead_lag("Start", 2), lead_lag("End", 2), as_of("Previous", 5), as_of("Next", 3), as_of("Nearest", 5))
    start, end = r.rows(lead_lag("Start", 2)).first(), r.rows(lead_lag("End", 2)).first()
    assert (start.comparison_point, start.delta, start.direction, start.is_within) == (7, 3, "TargetLags", False)
    assert (end.comparison_point, end.delta, end.direction, end.is_within) == (19, 1, "TargetLags", True)
    assert [(x.status, x.distance) for x in (r.rows(as_of(d, t)).first() for d, t in (("Previous", 5), ("Next", 3), ("Nearest", 5)))] == [("Matched", 3), ("NoMatch", 4), ("Matched", 3)]
    tie = run(spark, [("a", 10, 20), ("b", 8, 9), ("b", 12, 13)], as_of("Nearest", 5), lead_lag("Start"), as_of("Previous", 9), "nonsense")
    assert tie.rows(as_of("Nearest", 5)).first().status == "Ambiguous" and tie.rows(lead_lag("Start")).first().comparison_point == 8
    assert [d.code for d in tie.errors()] == ["UnknownComparator"]
    assert run(spark, [("a", 10, 20), ("b", 12, 13)], as_of("Previous", 9)).rows(as_of("Previous", 9)).first().status == "FutureRejected"
    assert run(spark, [("a", 10, 20)], lead_lag("Start")).rows(lead_lag("Start")).first().direction == "MissingComparison"


def test_validation_and_critic(spark):
    assert [d.code for d in comparison(history(spark, []), "").plan.validate()] == ["MissingName", "MissingTarget", "MissingAgainst", "MissingScope", "MissingComparator"]
    broad = run(spark, [("a", 1, 5), ("b", 3, 7)], "overlap", window=None, strict=True)
    assert [d.code for d in broad.errors()] == ["BroadSelector"] and broad.rows("overlap").count() == 0
    assert "FutureLeakageRisk" in [d.code for d in run(spark, [("a", 1, 5)], as_of("Previous", 1)).warnings()]
    p = comparison(history(spark, []), "x").target("t", Selector.runtime_only("odd", F.col("start_position") % 2 == 1)).within(window="w", axis="time").using("gap").plan
    assert {"NonSerializableSelector", "MixedTimeAxes"} <= {d.code for d in p.validate()} and "RuntimeNonSerializablePlan" in [d.code for d in p.criticise()]


def test_selectors_compose(spark):
    w = history(spark, [("a", 1, 5), ("b", 3, 7), ("c", 9, 12)])
    both = Selector.for_positions(2, 10) & (Selector.for_source("b") | Selector.for_sources("c", "d"))
    assert w.where(both.predicate).count() == 2 and both.serializable and w.where(Scope(key="d").predicate()).count() == 3


def test_coalesce_and_duplicates(spark):
    r = run(spark, [("a", 1, 3), ("a", 3, 6), ("b", 1, 6)], "overlap", coalesce_adjacent=True)
    assert ranges(r.rows("overlap")) == [(1, 6)] and r.rows("overlap").first().target_ids[0].count("+") == 1
    w = history(spark, [("a", 1, 3)])
    p = run(spark, [("a", 1, 3)], "overlap", duplicates="Reject").plan
    assert align.normalized(w.union(w), p).count() == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_alignment_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), s := rng.randint(0, 40), s + rng.randint(0, 12)) for _ in range(40)]
    r = run(spark, rows, "overlap", "residual", "missing", against=("b", "c"))
    points = sorted({p for _, s, e in rows for p in (s, e)})
    want = {"overlap": [], "residual": [], "missing": []}
    for x, y in zip(points, points[1:]):
        t = any(s <= x and y <= e for n, s, e in rows if n == "a")
        a = any(s <= x and y <= e for n, s, e in rows if n != "a")
        if t or a:
            want["overlap" if t and a else "residual" if t else "missing"].append((x, y))
    assert {n: ranges(r.rows(n)) for n in want} == want
    swept = align.sweep(r.normalized)
    assert ranges(swept) == sorted(sum(want.values(), []))


def test_hierarchy(spark):
    def kinds(parent, child):
        b = HistoryBuilder().closed("P", "p", *parent, "a").closed("C", "c", *child, "a")
        return ranges(analytics.hierarchy(b.build(spark), "P", "C"), "kind")

    assert [k for *_, k in kinds((1, 7), (3, 5))] == ["UnexplainedParent", "ParentExplained", "UnexplainedParent"]
    assert [k for *_, k in kinds((3, 5), (1, 7))] == ["OrphanChild", "ParentExplained", "OrphanChild"]


def test_matrix(spark):
    cells = {(r.target, r.against): r for r in analytics.source_matrix(history(spark, [("a", 1, 5), ("b", 3, 7), ("c", 1, None)]), NAME, ["a", "b", "c", "d"]).collect()}
    ab = cells["a", "b"]
    assert (ab.overlap_rows, ab.residual_rows, ab.missing_rows, ab.coverage_ratio) == (1, 1, 1, 0.5)
    assert cells["a", "a"].coverage_ratio == 1.0 and cells["d", "d"].coverage_ratio is None and cells["a", "c"].overlap_rows == 0 and len(cells) == 16


def test_changelog_and_convergence(spark):
    live, done = run(spark, [("a", 1, None), ("b", 1, 4)], "residual", live=8).row_finalities(), run(spark, [("a", 1, 9), ("b", 1, 4)], "residual").row_finalities()
    entries = analytics.changelog(live, done)
    assert sorted(r.finality for r in entries.collect()) == ["Final", "Retracted"]
    after = analytics.replay(live, entries).select("row_id", "finality")
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, done.select("row_id", "finality").collect()))
    same = live.withColumn("finality", F.lit("Final"))
    assert analytics.changelog(live, same).first().finality == "Revised" and analytics.replay(live, analytics.changelog(live, same)).first().finality == "Final"


def test_silences(spark):
    beats = spark.createDataFrame([("a", 0), ("a", 5), ("a", 30), ("b", 28)], "lane string, at long")
    lanes = spark.createDataFrame([("a",), ("b",), ("c",)], "lane string")
    got = analytics.silences(beats, F.col("lane"), F.col("at"), 10, F.lit(35), lanes, F.lit(0))
    assert sorted(((r.lane, r.silent_from, r.silent_until) for r in got.collect()), key=str) == [("a", 15, 30), ("b", 10, 28), ("c", 10, None)]


def test_numbering_in_stretches(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("P" if i % 3 else "C", "a" if i % 2 else "b", None if i % 5 else "q", s, s + rng.randint(1, 40)) for i in range(80) for s in [rng.randint(-50, 300)]]
    b = HistoryBuilder()
    for name, source, partition, start, end in rows:
        b.closed(name, "k", start, end, source, partition)
    windows = b.build(spark)
    text = lambda: sorted(str(r) for r in analytics.hierarchy(windows, "P", "C").collect())
    whole = text()
    monkeypatch.setattr(align, "STRETCH", 16)
    assert text() == whole
    monkeypatch.setattr(align, "numbered", lambda points, scope, spread, own=align.numbered: own(points, scope, False))
    assert text() == whole
