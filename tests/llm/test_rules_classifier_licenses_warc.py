"""Quality rules, classifier, licence scans and WARC on small tables and against plain versions."""

import base64
import hashlib
import re
import textwrap
import zlib
from pathlib import Path

import duckdb
import pytest

from tidemark.llm import classifier, licenses, quality_rules, store, warc

DATA = "/root/testdata/sf0.01"
HARD = [None, "", " \n\t", "a b c", "one two " * 40, "x " * 7, ("same line here\n" * 5) + "other " * 30, "# * $ % & | < > " * 5, "w" * 5000, "é ü ñ z " * 12, "a\x0bb\x0cc\rd " * 10, " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"w{i}" for i in range(12))]
SCHEMA = "doc_id long, text string, words string, n_words int"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(HARD)] + [(3, HARD[3], "clash", 1), (None, "x", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = quality_rules.judged(quality_rules.ledger(docs), "v1").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            m = plain(HARD[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
            assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0]) and not (r.base_failed and r.kept)
    assert quality_rules.judged(quality_rules.ledger(docs.limit(0)), "v1").collect() == []
    kept = quality_rules.kept_documents(docs, "v1")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_ablations(spark):
    ledger = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (8,)], "fail_bits int")
    rows = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablations(ledger, "base").collect()}
    assert rows == {"too_few_words": (3, 2), "repeated_windows": (1, 0)}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", ["op2_quality_rules", "op6_license_scan", "op9_warc"])
def test_whole_tables_equal_sql(spark, duck, name):
    from tidemark.llm import queries

    df, want = queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r.doc_id: r for r in classifier.classified(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    kept = classifier.kept(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got.values())


def test_classifier_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s", 0), (None, "x", "s", 0), (1, "", "s", 0)], "doc_id long, text string, score string, label int")
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert [r.score for r in classifier.classified(docs, none).collect()] == [0.5] * 3
    some = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    assert classifier.classified(docs, some).count() == 3 and classifier.classified(docs.limit(0), some).count() == 0


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"][2]
    texts = [mit, "Copyright (c) 2020 Somebody Else\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE"), mit + " more", "prose\n * Licensed under CC BY-NC 4.0\nend", None, "", "(c) 2021 me"]
    rows = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, line string")).collect()}
    assert [rows[i].license_id for i in range(7)] == ["MIT", "MIT", None, None, None, None, None] and rows[3].line_licenses == "CC-BY-NC-4.0" and rows[3].n_license_lines == 1
    known = spark.createDataFrame([("own", "My   own, LICENCE!")], "license_id string, text string")
    assert licenses.scanned(spark.createDataFrame([(1, "my own license")], "doc_id long, text string"), known).first().license_id == "own"
    assert licenses.scanned(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def _wrapped(text, width, mark=""):
    return "\n\n".join("\n".join(mark + line for q in p.split("\n") for line in textwrap.wrap(q, width)) for p in text.split("\n\n"))


def test_licenses_at_any_width(spark):
    whole = {name: texts[-1] for name, texts in licenses.KNOWN.items() if "\n\n" in texts[-1]}
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "Zlib"} <= set(whole)
    own = {name: text.replace("(c) the authors", "(C) 2019-2024, Some Body <a@b.org>\nAll rights reserved.") for name, text in whole.items()}
    texts = [(name, _wrapped(text, width, mark)) for forms in (whole, own) for name, text in forms.items() for width in range(50, 101) for mark in ("", " * ")]
    texts += [(name, text.partition("\n\n")[2]) for name, text in whole.items()] + [("MIT", whole["MIT"].replace("(c) the authors", "2020 X"))]
    texts += [(None, text.replace("without", "with", 1)) for text in whole.values()] + [(None, text[: len(text) // 2]) for text in whole.values()]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scanned(docs).collect()}
    assert [(i, got[i]) for i in range(len(texts))] == [(i, name) for i, (name, _) in enumerate(texts)]


COMMON = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not COMMON.exists(), reason="the system has no licence texts")
def test_long_licenses_by_digest(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = {COMMON.joinpath(f).read_text(encoding="utf-8"): name for f, name in files.items() if COMMON.joinpath(f).exists()}
    rows = [(name, form) for text, name in there.items() for form in (text, text.upper(), text.replace("\n", "\n\n  "))] + [(None, text + "\nand more") for text in there]
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and all(r.doc_id == r.license_id for r in got)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (3, "http://b/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (4, "http://c", None), (5, "http://d", ""), (5, "http://d", ""), (None, "http://e", "only"), (6, "http://f", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha1 string").repartition(3)
    manifest = warc.write_archives(pages)
    got = {(r.page_id, r.payload_bytes): r for r in warc.digests(spark, manifest).collect()}
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert [(got[i, 9].record_type, got[i, 9].refers_to) for i in (1, 2, 3)] == [("revisit", 3), ("revisit", 3), ("response", None)] and got[1, 9].payload_digest == digest("<p>é</p>")
    assert got[4, 0].record_type == "revisit" and got[5, 0].record_type == "response" and got[None, 4].record_type == "response" and (6, 3_000_000) in got
    nested = warc.transactions(warc.read_archives(spark, manifest, with_payload=True)).collect()
    assert len(nested) == len(rows) and all(n.request and n.response and n.metadata for n in nested)
    assert sorted(bytes(n.response.payload).decode() for n in nested if n.response.record_type == "response") == sorted(["<p>é</p>", "", "", "only", "x" * 3_000_000])
    small = warc.digests(spark, warc.write_archives(pages.where("page_id < 4"), min_bytes=100)).collect()
    assert {r.record_type for r in small} == {"response"}
    assert warc.digests(spark, warc.write_archives(pages.limit(0))).collect() == []


def test_foreign_records_are_refused(tmp_path):
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")
    uri = f"file://{tmp_path}/x.warc.gz"
    with store.open_out(uri) as f:
        f.write(warc.record("metadata", "<urn:x>", [], b"a: b")[:-9])
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(store.open_in(uri)))
