"""Diagnostics of rows, duplicates, cohort evidence, linear comparators, and the helpers around results."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tests.test_comparison import HistoryBuilder
from tidemark import Selector, comparison
from tidemark import testing
from tidemark.operators import align, analytics, comparators, history
from tidemark.operators.recording import Pipeline, TypedWindow, WindowDefinition
from tidemark.plans.comparison import Activity, catalog, is_known, lead_lag
from tidemark.plans.extensions import Extension
from tidemark.sources import exports
from tidemark.streaming import recorder


def plain(windows, *names, **normalization):
    b = comparison(windows, "c").target("a", Selector.for_source("a")).against("b", Selector.for_source("b")).within(window="W")
    return b.normalize(**normalization).using(*names) if normalization else b.using(*names)


def test_duplicates_are_found_whatever_their_tags(spark):
    windows = HistoryBuilder().closed("W", "k", 1, 5, "a").closed("W", "k", 1, 5, "a").closed("W", "k", 2, 4, "b").build(spark)
    tagged = windows.withColumn("record_id", F.monotonically_increasing_id().cast("string"))
    result = plain(tagged, "overlap").run()
    assert [(r.code, r.severity) for r in result.row_diagnostics().collect()] == [("duplicate_window", "Warning")]
    assert align.normalized(tagged, plain(tagged, "overlap", duplicates="Reject").plan).where("side = 'Target'").count() == 1
    rows = align.normalized(tagged, plain(tagged, "overlap").plan).where("side = 'Target'")
    apart = rows.unionByName(rows.withColumn("provisional", F.lit(True)))
    assert align.deduplicated(apart).count() == 2  # a clipped end is not a closed one
    assert align.deduplicated(rows.withColumn("segment_key", F.col("record_id"))).count() == 1


def test_cohort_evidence_of_segments_without_a_target(spark):
    windows = HistoryBuilder().closed("W", "k", 1, 3, "a").closed("W", "k", 2, 6, "b").build(spark)
    plan = comparison(windows, "c").target("a", Selector.for_source("a")).against_cohort("rest", ("b", "c"), Activity("any")).within(window="W").using("residual").plan
    seg = align.aligned(align.normalized(windows, plan))
    assert sorted((r.range_start, r.range_end, r.active_count) for r in comparators.cohort_evidence(seg, plan).collect()) == [(1, 2, 0), (2, 3, 1), (3, 6, 1)]


def test_ambiguous_as_of_and_missing_lineage(spark):
    windows = HistoryBuilder().closed("W", "k", 10, 12, "a").closed("W", "k", 8, 9, "b").closed("W", "k", 12, 13, "b").build(spark)
    found = plain(windows, "asof:Nearest:ProcessingPosition:5").run().row_diagnostics().collect()
    assert [(r.code, r.path[:5]) for r in found] == [("AmbiguousAsOfMatch", "asof[")]
    assert sorted(r.path for r in analytics.hierarchy_diagnostics(windows, "P", "C").collect()) == ["childWindowName", "parentWindowName"]
    assert analytics.hierarchy_diagnostics(windows, "W", "W").collect() == []


def test_residuals_of_many_islands(spark):
    rng = random.Random(3)
    b, want = HistoryBuilder(), {}
    spans = {s: [] for s in "abc"}
    for s in "abc":
        at = 0
        for _ in range(40):
            at += rng.randint(1, 6)
            end = at + rng.randint(1, 8)
            spans[s].append((at, end))
            b = b.closed("W", "k", at, end, s)
            at = end
    covered = {x for s in "bc" for i, j in spans[s] for x in range(i, j)}
    for i, j in spans["a"]:
        want |= {x: None for x in range(i, j) if x not in covered}
    got = [x for r in history.find_residuals(b.build(spark), "a").collect() for x in range(r.range_start, r.range_end)]
    assert sorted(got) == sorted(want)


def test_summary_equals_the_rows(spark):
    windows = HistoryBuilder().closed("W", "k", 1, 5, "a").closed("W", "k", 3, 8, "b").closed("W", "k", 12, 14, "a").build(spark)
    names = ("overlap", "residual", "missing", "coverage", "gap", "symmetric-difference", "containment")
    result = plain(windows, *names).run()
    assert {r.comparator: r.row_count for r in result.summary().collect()} == {n: result.rows(n).count() for n in names}
    rows = result.rows("coverage")
    assert (comparators.total_magnitude(rows, "target"), comparators.total_magnitude(rows, "covered")) == (6.0, 2.0)
    with pytest.raises(ValueError):
        comparators.total_magnitude(rows, "other")


def test_stages_and_assertions(spark, tmp_path):
    windows = HistoryBuilder().closed("W", "k", 1, 5, "a").closed("W", "k", 3, 8, "b").build(spark)
    b = plain(windows, "overlap", "nonsense")
    assert b.build().name == "c" and b.prepare().count() == 2 and b.prepare_live(9).count() == 2
    assert [d.code for d in comparison(windows, "c").validate() if d.severity == "Error"]
    result = b.run()
    assert testing.assert_diagnostic(result, "UnknownComparator").code == "UnknownComparator"
    testing.assert_row_count(result, "overlap", 1)
    testing.assert_snapshot(result, "overlap", f"{tmp_path}/s.json")
    testing.assert_snapshot(result, "overlap", f"{tmp_path}/s.json")
    for check in (lambda: testing.assert_row_count(result, "overlap", 2), lambda: testing.assert_no_diagnostics(result), lambda: testing.assert_valid(comparison(windows, "c").run())):
        with pytest.raises(AssertionError):
            check()
    clock = testing.VirtualClock(3)
    assert clock.advance_by(2) == 5 and clock.advance_to(9) == clock.horizon == 9
    with pytest.raises(ValueError):
        clock.advance_to(8)


def test_extension_descriptors():
    e = Extension("x", "X").with_selector("s", "takes s").with_comparator("c:1", "compares").with_metadata_key("m")
    assert (e.selectors, e.comparators, e.metadata_keys) == ((("s", "takes s"),), (("c:1", "compares"),), ("m",))
    with pytest.raises(ValueError):
        e.with_selector(" ", "no")


def test_typed_windows_and_callbacks(spark):
    class High(TypedWindow):
        name = "High"

        def key(self):
            return F.col("k")

        def active(self):
            return F.col("v") > 5

    events = spark.createDataFrame([(1, "a", 9), (2, "a", 1), (3, "b", 8)], "pos long, k string, v int")
    pipeline = Pipeline((High().definition(),), F.col("pos"))
    assert sorted((r.key, r.start_position, r.end_position) for r in pipeline.windows(events).collect()) == [("a", 1, 2), ("b", 3, None)]
    seen = []
    told = {"High": lambda rows: seen.append(sorted(r.key for r in rows.collect()))}
    recorder.emissions(told, told)(pipeline.transitions(events), 0)
    assert seen == [["a", "b"], ["a"]]


def test_nearest_takes_time_in_proportion(spark):
    def seconds(n):
        rows = spark.range(n).select(
            F.lit("W").alias("window_name"), F.lit("k").alias("key"), F.lit(None).cast("string").alias("partition"), F.when(F.col("id") % 2 == 0, "Target").otherwise("Against").alias("side"),
            F.lit("s").alias("source"), (F.col("id") * 3).alias("range_start"), (F.col("id") * 3 + 2).alias("range_end"), F.col("id").cast("string").alias("record_id"), F.lit(False).alias("provisional"),
        )
        began = time.time()
        comparators._around(rows, "range_start", "range_start", "id").agg(F.count("before"), F.count("after")).collect()
        return time.time() - began

    seconds(1_000)
    assert seconds(40_000) < 12 * max(seconds(5_000), 0.5)


def _signals(beats, lanes, threshold, start, horizon, every):
    """The state machine, one check and one beat after the other; beats of an instant come before its check."""
    out, last, silent, known = [], dict.fromkeys(lanes, start), dict.fromkeys(lanes, False), dict.fromkeys(lanes, False)
    for now in range(start, horizon + 1):
        for lane, at in beats:
            if at == now:
                last[lane] = at
                if silent[lane] or not known[lane]:
                    out.append((lane, False, at, at))
                silent[lane], known[lane] = False, True
        for lane in lanes if (now - start) % every == 0 else ():
            if not silent[lane] and now >= last[lane] + threshold:
                silent[lane] = known[lane] = True
                out.append((lane, True, last[lane] + threshold, now))
    return sorted(out)


def test_liveness_signals(spark):
    rng = random.Random(4)
    lanes = ["a", "b", "c", "never"]
    beats = sorted({(rng.choice(lanes[:3]), rng.randint(5, 300)) for _ in range(60)} | {("a", 5)}, key=lambda x: x[1]) + [("a", 900)]
    rows = lambda b: spark.createDataFrame(b, "lane string, at long")
    tracked = lambda names: spark.createDataFrame([(x,) for x in names], "lane string")
    ask = lambda b, names, *more: analytics.liveness_signals(rows(b), F.col("lane"), F.col("at"), tracked(names), *more)
    for threshold, start, horizon, every in ((7, 5, 300, 1), (10, 3, 290, 4), (25, 5, 60, 10)):
        got = ask(beats, lanes, threshold, start, horizon, every).collect()
        assert sorted((r.lane, r.is_silent, r.occurred_at, r.evaluated_at) for r in got) == _signals(beats, lanes, threshold, start, horizon, every)
    assert ask([], [], 5, 0, 10).collect() == []
    for wrong in ((0, 0, 9), (5, 9, 3)):
        with pytest.raises(ValueError):
            ask(beats, lanes, *wrong)
    for b, names, start in (([("x", 9)], ["a"], 0), ([("a", 1)], ["a"], 5), ([("a", 9)], ["a", "a"], 0)):
        with pytest.raises(Exception, match="lane|start"):
            ask(b, names, 5, start, 50).collect()


def test_totals_keep_to_their_axis(spark):
    windows = HistoryBuilder().closed("W", "k", 1, 5, "a").closed("W", "k", 3, 8, "b").build(spark)
    result = plain(windows, "overlap", "residual", "containment").run()
    assert (result.total_position_length("overlap"), result.total_position_length("residual")) == (2, 2)
    for wrong in (lambda: result.total_time_duration("overlap"), lambda: result.total_position_length("containment")):
        with pytest.raises(ValueError):
            wrong()


def test_lines_in_the_catalogs_order_and_export_options(spark, tmp_path):
    windows = HistoryBuilder().closed("W", "k", 1, 5, "a").closed("W", "k", 3, 8, "b").build(spark)
    b = plain(windows, lead_lag("Start", 5), "coverage", "overlap")
    result = exports.run(b, exports.ExportOptions(html=f"{tmp_path}/x/c.html"))
    assert (tmp_path / "x" / "c.html").read_text().startswith("<!doctype html>") and os.listdir(tmp_path) == ["x"]
    types = [json.loads(r.value)["type"] for r in exports.lines(result).collect()]
    assert list(dict.fromkeys(types)) == ["summary", "overlap", "coverage", "lead-lag"]
    document = exports.result_document(result)
    assert len(document["coverageSummaries"]) == result.coverage_summary().count() and len(document["leadLagSummaries"]) == 1
    with pytest.raises(ValueError):
        exports.ExportOptions(llm=" ")


def test_catalog_and_recording_off(spark):
    assert all(map(is_known, (*catalog()[:7], lead_lag("End", 3), "asof:Next:Timestamp:0"))) and not any(map(is_known, ("asof", "nonsense", "lead-lag:Up:Timestamp:1")))
    events = spark.createDataFrame([(1, "k", True), (2, "k", False)], "pos long, key string, on boolean")
    silent = Pipeline((WindowDefinition("W", F.col("key"), F.col("on")),), F.col("pos"), record=False)
    assert silent.windows(events).collect() == [] and silent.transitions(events).count() == 2
