"""Removal of repeated strings against brute force, and the merge sort by itself."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import lcp_sort, suffix_dedup


def covered(texts):
    """Each text's bytes, and a mark for each byte that a repeated string covers."""
    data = [(t or "").encode() for t in texts]
    n = suffix_dedup.LENGTH
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        yield d, gone


def kept_bytes(texts):
    return [bytes(b for b, g in zip(d, gone) if not g) for d, gone in covered(texts)]


def brute(texts):
    out = []
    for d, gone in covered(texts):
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passage, base = prose(60), prose(200)
    texts = [prose(rng.randint(1, 200)) for _ in range(10)]
    texts += [prose(20) + passage[rng.randint(0, 40) :] + prose(20) for _ in range(6)]
    for _ in range(6):  # near copies
        words = base.split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(200)] = "zz"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0], base[:450], prose(5) + "ab " * 150 + prose(5), "x" * 700, "x" * 199, None, "", passage[:100], passage[20:240], "one " * 3]
    texts.append("q" + texts[1][30:231] + "r")
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(texts)], "doc_id long, text string, sha string, t int").repartition(3)
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def test_segments_and_fingerprints_equal_by_chance(spark):
    texts = corpus(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({"segment": 300}, {"bits": 1}):
        rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(docs, **options).collect()}
        assert [rows[i] for i in range(len(texts))] == brute(texts), options


def test_whole_table(spark):
    from tidemark.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert [rows[d.doc_id] for d in docs] == brute([d.text for d in docs])


def test_columns_of_any_name(spark):
    text = "a passage that is long enough " * 9
    names = ["t", "data", "sha", "text", "spans", "whole", "a.b", "k0", "m0", "first", "x`y"]
    rows = [tuple([f"{c}{i}" if c != "text" else (f"{i} " + text if i else None) for c in names]) for i in range(3)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c.replace('`', '``')}` string" for c in names)).select("*", F.lit(1).alias("doc_id"))
    got = suffix_dedup.without_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple([("" if i == 0 else f"{i}") if c == "text" else v for c, v in zip(names, r)]) + (1,) for i, r in enumerate(rows))


def test_repeated_keys(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    groups = [rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) for _ in range(5)]
    groups[0][:5], groups[1][7], groups[2][:2] = groups[3][:5], groups[4][0], np.uint64(42)
    rows = spark.createDataFrame([(g, bytearray(k.tobytes())) for g, k in enumerate(groups)], "g long, keys binary")
    got = {r.g: sorted(np.frombuffer(b"".join(r.found), dtype=np.uint64).tolist()) for r in suffix_dedup.repeated_keys(rows).collect()}
    assert got == {0: sorted(groups[3][:5].tolist()), 3: sorted(groups[3][:5].tolist()), 1: [int(groups[4][0])], 4: [int(groups[4][0])], 2: [42]}


def test_nulls_repeats_and_nothing(spark):
    long = "word " * 3 + "unique text " * 30
    docs = spark.createDataFrame([(None, long), (None, long), (1, long), (1, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.removed(docs).collect()) == [(0, 0, 0), (375, 375, 1), (375, 375, 1), (375, 375, 1)]
    assert suffix_dedup.removed(docs.limit(0)).collect() == []
    assert [tuple(r) for r in suffix_dedup.without_repeats(docs).orderBy("doc_id").collect()][-1] == (1, "")


@pytest.mark.parametrize("seed", range(20))
def test_loser_tree_merges(seed):
    rng = random.Random(seed)
    runs, everything = [], []
    for _ in range(rng.randint(1, 7)):
        strings = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 60))})
        everything += strings
        blob, before = [], b""
        for s in strings:
            n = lcp_sort.common(before, s)
            blob += [lcp_sort._HEAD.pack(n, len(s) - n, False, 0, 0, 0), s[n:]]
            before = s
        runs.append(lcp_sort.Run(b"".join(blob)))
    got = list(lcp_sort.merged(runs))
    assert [g[0] for g in got] == sorted(everything)
    assert all(g[1] == lcp_sort.common(a[0], g[0]) for a, g in zip(got, got[1:]))


def test_common_prefix():
    assert lcp_sort.common(b"", b"x") == 0 and lcp_sort.common(b"a" * 70 + b"b", b"a" * 70 + b"c", 3) == 70 and lcp_sort.common(b"ab", b"abc") == 2
