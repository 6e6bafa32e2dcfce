"""The Jaccard join against brute force over whole texts."""

import math
import random

import pytest

from tidemark.llm import chosen_path


def shingles(text):
    words = (text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Per row: links, and the group's smallest identifier."""
    sets = [shingles(t) for _, t, *_ in rows]
    n, root = len(rows), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = sorted((top(i), top(j)))
                root[y] = x
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, least.get(top(i)) if sets[i] else d, links[i]) for i, (d, *_) in enumerate(rows)) if all(d is not None for d, *_ in rows) else [(d, least.get(top(i)) if sets[i] else d, links[i]) for i, (d, *_) in enumerate(rows)]


def corpus(seed, near=40, chain=True):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    prose = lambda n: [word() for _ in range(n)]
    common, texts = prose(12), []
    for _ in range(30):
        texts.append(" ".join(common + prose(rng.randint(1, 120))))
    base = prose(300)
    for _ in range(near):  # one large group of different near copies
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(300)] = word()
        texts.append(" ".join(t))
    texts += [texts[3]] * 4 + ["a b", "a  b\n", "a b c d e", "", " \n", "x"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def result(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, fp string, c int").repartition(3)
    return sorted((r.doc_id, r.class_id, r.n_links) for r in chosen_path.jaccard_join(docs, **options).collect())


@pytest.mark.parametrize("limits", [(200, 5, 128), (6, 2, 8)])
def test_equals_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("LIMIT", "DEPTH", "BLOCK"), limits):
        monkeypatch.setattr(chosen_path, name, value)
    rows = corpus(7)
    assert result(spark, rows) == brute(rows)


def test_nulls_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (None, None)], "doc_id long, text string")
    rows = chosen_path.jaccard_join(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.class_id or 0, r.n_links) for r in rows) == [(False, 1, 1, 2), (False, 1, 1, 2), (False, 2, 2, 0), (True, 0, 0, 0), (True, 0, 1, 2)]
    kept = chosen_path.first_of_groups(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == [(False, 1, "a b c d e f"), (False, 2, ""), (True, 0, "")]
    assert chosen_path.jaccard_join(docs.limit(0)).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in chosen_path.jaccard_join(docs).collect()) == brute(rows)


def test_recall_is_computed():
    assert chosen_path.survival(1.0, 1) == 1.0 and 0.6 < chosen_path.survival(0.8, 3) < 0.7
    assert (1 - chosen_path.survival(0.8, 3)) ** chosen_path.runs_for(0.9995, 0.8) <= 0.0005


def test_recall_holds_for_the_deepest_splits_and_shared_minima():
    runs, n = chosen_path.runs_for(0.9995, 0.8), 64
    missed = sum(math.comb(n, a) * 0.8**a * 0.2 ** (n - a) * (1 - chosen_path.survival(a / n, chosen_path.DEPTH + 1)) ** runs for a in range(n + 1))
    assert missed <= 0.0005


def test_rows_written_do_not_grow_with_the_splits_of_a_large_group(spark, monkeypatch):
    """Near copies that are one component already are not split again, in groups of ten and twenty times the limit."""
    counts, written = [], chosen_path.store.written
    monkeypatch.setattr(chosen_path.store, "written", lambda spark, df, name: counts.append((name, t := written(spark, df, name))) or t)
    monkeypatch.setattr(chosen_path, "LIMIT", 20)
    for near in (200, 400):
        counts.clear()
        rows = corpus(11, near=near)
        assert result(spark, rows) == brute(rows)
        first, *further = [t.count() for name, t in counts if name == "paths"]
        assert first > 18 * near and sum(further) < 2 * first, (near, first, further)


def test_known_sets_are_compared_with_the_others_only():
    import numpy as np
    import pyarrow as pa

    a, b = (np.arange(64, dtype=np.uint32) + k for k in (0, 1000))
    half = np.where(np.arange(64) < 40, a, b)
    rows = [(7, c, s.astype(np.uint32).tobytes(), known) for c, s, known in [(1, b, False), (2, a, True), (3, a, True), (4, a, False), (5, half, False), (6, b + 5000, True)]]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["path", "c", "sig", "known"])
    links = {(u, v) for out in chosen_path._link_buckets([batch]) for u, v in zip(*(x.to_pylist() for x in out.columns))}
    assert links == {(4, 2), (5, 2)}  # 2, 3 and 6 are known to be one tree; 1 agrees with 24 of the minima of 5


@pytest.mark.parametrize("depth", [1, 2])
def test_large_buckets_at_the_last_split_lose_no_link(spark, monkeypatch, depth):
    for name, value in {"LIMIT": 4, "DEPTH": depth, "SPREAD": 0}.items():  # no bucket ends before the last split
        monkeypatch.setattr(chosen_path, name, value)
    rows = corpus(13, near=60)
    assert result(spark, rows) == brute(rows)
