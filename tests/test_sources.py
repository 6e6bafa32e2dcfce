"""Fixtures, JSON lines, exports, command line, temporal values and the streaming recorder."""

import io
import json

import pytest
from pyspark.sql import functions as F

from tidemark import Selector, WindowDefinition, compare, comparison
from tidemark.cli import main
from tidemark.functions import temporal
from tidemark.functions.temporal import Point, Range
from tidemark.operators.recording import Pipeline
from tidemark.sources import exports
from tidemark.sources.windows import FixtureError, HistoryBuilder, fixture, read_jsonl


def document(windows=((1, 5, "provider-a"), (3, 7, "provider-b")), **plan):
    rows = [{"windowName": "DeviceOffline", "key": "device-1", "source": s, "startPosition": a, "endPosition": b} for a, b, s in windows]
    base = {"name": "p", "targetSource": "provider-a", "againstSources": ["provider-b"], "scopeWindow": "DeviceOffline", "comparators": ["overlap", "residual", "coverage"]}
    return json.dumps({"schema": "fixture", "schemaVersion": 0, "name": "x", "windows": rows, "plan": base | plan})


def test_contract_fixtures(spark):
    r = compare(*fixture(spark, document())[:2])
    assert r.is_valid and {x.comparator: x.row_count for x in r.summary().collect()} == {"overlap": 1, "residual": 1, "coverage": 2}
    three = ((1, 11, "provider-a"), (1, 6, "provider-b"), (6, 11, "provider-c"))
    r = compare(*fixture(spark, document(three, comparators=["residual"], againstCohort={"name": "any", "sources": ["provider-b", "provider-c"], "activity": "any"}))[:2])
    assert r.is_valid and r.rows("residual").count() == 0
    r = compare(*fixture(spark, document(scopeWindow=None, strict=True, comparators=["overlap"]))[:2])
    assert not r.is_valid and [d.code for d in r.errors()] == ["BroadSelector"]


@pytest.mark.parametrize(("text", "path"), [("{}", "$.schema"), (document(((5, 1, "a"),)), "$.windows[0].endPosition"), (document(name=3), "$.plan.name")])
def test_fixture_errors_name_the_path(spark, text, path):
    with pytest.raises(FixtureError, match=path.replace("$", r"\$").replace("[", r"\[").replace("]", r"\]")):
        fixture(spark, text)


def test_jsonl(spark, tmp_path):
    f = tmp_path / "w.jsonl"
    f.write_text('{"key":"k","source":"a","startPosition":1,"endPosition":5}\n\n{"windowName":"V","key":"k","source":"b","startPosition":3,"segments":[{"name":"p","value":"x"}]}\n')
    rows = {r.window_name: r for r in read_jsonl(spark, str(f), "W").collect()}
    assert rows["W"].end_position == 5 and rows["V"].end_position is None and rows["V"].segments[0].value == "x"


@pytest.mark.parametrize(
    ("line", "path"),
    [("[1]", r"\$: expected"), ('{"key":"k","source":"a","startPosition":"x"}', r"\$: expected"), ('{"source":"a","startPosition":1}', r"\$\.key"), ('{"key":"k","startPosition":1}', r"\$\.source"), ('{"key":"k","source":"a"}', r"\$\.startPosition"), ('{"key":"k","source":"a","startPosition":5,"endPosition":1}', r"\$\.endPosition.*w\.jsonl")],
)
def test_jsonl_errors_name_path_and_file(spark, tmp_path, line, path):
    f = tmp_path / "w.jsonl"
    f.write_text('{"key":"k","source":"a","startPosition":1}\n' + line + "\n")
    with pytest.raises(Exception, match=path):
        read_jsonl(spark, str(f), "W").collect()
    err = io.StringIO()
    assert main(["audit-windows", str(f), "--window", "W", "--target", "a", "--against", "b", "--out", str(tmp_path / "o")], spark, io.StringIO(), err) == 2 and json.loads(err.getvalue())["error"]


def test_jsonl_without_a_window_name(spark, tmp_path):
    f = tmp_path / "w.jsonl"
    f.write_text('{"key":"k","source":"a","startPosition":1}\n')
    with pytest.raises(Exception, match="no window is named"):
        read_jsonl(spark, str(f)).count()


def test_explain_stages(spark):
    b = HistoryBuilder().closed("W", "k", 1, 5, "a", segments=[("phase", "x")]).closed("W", "k", 3, 7, "b").closed("V", "k", 1, 2, "a")
    r = comparison(b.build(spark), "x").target("t", Selector.for_source("a")).against("b", Selector.for_source("b")).within(window="W").using("overlap").run()
    assert "- target: source = a" in exports.explain_plan(r.plan) and "## Comparators\n- overlap" in exports.explain_plan(r.plan)
    prepared = exports.explain_prepared(r)
    assert "OutOfScope: 1" in prepared and "- Target t: 1 windows, 0 clipped" in prepared and "- Against b: 1 windows" in prepared
    assert "- target only: 1, length 4" in exports.explain_aligned(r) and "- against only: 1, length 4" in exports.explain_aligned(r, markdown=False)
    page = exports.debug_html(r)
    assert "phase=x" in page and all(f'id="{part}"' in page for part in ("timeline", "bands", "aligned", "metadata"))


def test_exports_are_stable(spark, tmp_path):
    results = [compare(*fixture(spark, document())[:2]) for _ in range(2)]
    for f in (exports.result_json, exports.markdown, exports.debug_html, exports.llm_context):
        assert f(results[0]) == f(results[1])
    d = json.loads(exports.result_json(results[0]))
    assert d["isValid"] and d["rows"]["overlap"][0]["range_start"] == 3 and d["rows"]["overlap"][0]["rowId"] == "overlap[0]"
    assert [x["id"] for x in json.loads(exports.llm_context(results[0]))["rowDocuments"]] == ["overlap[0]", "residual[0]", "coverage[0]", "coverage[1]"]
    assert exports.lines(results[0]).count() == 3 + 4
    manifest = exports.audit_bundle(results[0], str(tmp_path / "audit"))
    assert manifest["rowCounts"] == {"overlap": 1, "residual": 1, "coverage": 2} and (tmp_path / "audit" / "manifest.json").exists()
    odd = comparison(HistoryBuilder().build(spark), "x").target("t", Selector.runtime_only("odd", F.lit(True))).against("b", Selector.for_source("b")).within(window="W").using("gap")
    with pytest.raises(exports.ExportError):
        exports.result_json(odd.run())


def test_command_line(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(document())
    bad.write_text(document(scopeWindow=None, strict=True))
    run = lambda *a: (main(list(a), spark, out := io.StringIO(), err := io.StringIO()), out.getvalue(), err.getvalue())
    assert run("validate-plan", str(good))[0] == 0 and run("compare", str(good), "--format", "markdown")[1].startswith("# Comparison p")
    assert run("compare", str(bad))[0] == 1 and run("explain", str(good))[0] == 0 and run("audit", str(good), "--out", str(tmp_path / "a"))[0] == 0
    assert run("compare", str(tmp_path / "none.json"))[0] == 2 and run("nonsense")[0] == 2 and json.loads(run("nonsense")[2])["error"]
    lines = tmp_path / "w.jsonl"
    lines.write_text('{"key":"k","source":"a","startPosition":1,"endPosition":5}\n{"key":"k","source":"b","startPosition":3}\n')
    args = ["audit-windows", str(lines), "--window", "W", "--target", "a", "--against", "b", "--out", str(tmp_path / "b")]
    assert run(*args)[0] == 1 and run(*args, "--live-horizon", "9")[0] == 0


def test_temporal_values(spark):
    p = Point
    assert Range(p(1), p(5)).overlaps(Range(p(4))) and not Range(p(1), p(5)).contains(p(5)) and Range(p(1), p(5)).length == 4 and Range(p(1), p(1)).is_empty
    for bad in (lambda: p(1) < p(1, "time"), lambda: Range(p(5), p(1)), lambda: Range(p(1)).length, lambda: p(1, "x")):
        with pytest.raises(ValueError):
            bad()
    row = spark.range(1).select(temporal.intersection(*map(F.lit, (1, 5, 3, 9))).alias("i"), temporal.difference(*map(F.lit, (1, 9, 3, 5))).alias("d"), temporal.contains(*map(F.lit, (1, 5, 5))).alias("c")).first()
    assert tuple(row.i) == (3, 5) and [tuple(x) for x in row.d] == [(1, 3), (5, 9)] and row.c is False


def test_streaming_recorder_equals_batch(spark, tmp_path):
    from tidemark.streaming import recorder

    rows = [(i, f"k{i % 3}", i * 7 % 10 > 4, "xy"[i // 5 % 2]) for i in range(60)]
    events = spark.createDataFrame(rows, "pos long, key string, on boolean, phase string")
    for k in range(3):
        events.where(f"pos >= {20 * k} AND pos < {20 * k + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, seen = str(tmp_path / "out"), []
    found = recorder.transitions(stream, "W", F.col("key"), F.col("on"), F.col("pos"))
    q = found.writeStream.foreachBatch(recorder.for_each_batch(out, lambda df, n: seen.append(n))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and seen == [0, 1, 2]
    got = recorder.windows_of(spark.read.parquet(out))
    want = Pipeline((WindowDefinition("W", F.col("key"), F.col("on")),), F.col("pos")).windows(events)
    columns = ["window_name", "key", "start_position", "end_position"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_streaming_recorder_with_contexts_tags_and_roll_ups(spark, tmp_path):
    from tidemark import RollUp, Segment, Tag, all_active, any_active, schema
    from tidemark.streaming import recorder

    rows = [(i, f"k{i % 4}", i * 7 % 10 > 3, "xy"[i // 9 % 2], f"t{i % 3}", f"g{i % 2}") for i in range(80)]
    events = spark.createDataFrame(rows, "pos long, key string, on boolean, phase string, kind string, group string")
    for k in range(4):
        events.where(f"pos >= {20 * k} AND pos < {20 * k + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    segments, tags = F.array(schema.segment("phase", F.col("phase"))), F.array(schema.tag("kind", F.col("kind")))
    roll_ups = (RollUp("Any", F.col("group"), any_active), RollUp("All", F.col("group"), all_active))
    for name, split in (("split", True), ("plain", False)):
        out = str(tmp_path / name)
        found = recorder.transitions(stream, "W", F.col("key"), F.col("on"), F.col("pos"), segments=segments if split else None, tags=tags, parent=F.col("group"))
        q = found.writeStream.foreachBatch(recorder.for_each_batch(out, lambda df, n: None)).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        recorded = spark.read.parquet(out).drop("batch")
        names = ("phase",) if split else ()
        got = recorder.windows_of(recorded)
        for r in roll_ups:
            got = got.union(recorder.rolled_up(recorded, r, names))
        definition = WindowDefinition("W", F.col("key"), F.col("on"), (Segment("phase", F.col("phase")),) if split else (), (Tag("kind", F.col("kind")),), roll_ups)
        want = Pipeline((definition,), F.col("pos")).windows(events)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
