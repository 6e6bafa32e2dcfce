"""Registered queries that SQL can't express, over whole tables, against the library or brute force."""

import hashlib
import struct
import zlib

import pytest

from tests.llm.test_nn_descent import brute
from tests.llm.test_tokens import BYTE, WORD, library
from tidemark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]


def little(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_op1_pieces_hold_each_id_once(spark, texts):
    lib, end = library(BYTE), {}
    ids = {d: lib.encode(t, add_special_tokens=False).ids + [1] for d, t in texts}
    for p in sorted(queries.op1_packing(spark, DATA).collect(), key=lambda p: (p.doc_id, p.start)):
        assert p.start == end.get(p.doc_id, 0) and p.doc_tokens == len(ids[p.doc_id])
        end[p.doc_id] = p.start + p.length
        assert p.ids_crc32 == zlib.crc32(little(ids[p.doc_id][p.start : p.start + p.length]))
    assert end == {d: len(x) for d, x in ids.items()}


def test_op4_equals_brute_force(spark):
    vectors = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = queries.op4_embedding_near_dedup(spark, DATA).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(tuple(r) for r in got) == brute(vectors)


def test_op5_equals_the_library(spark, texts):
    lib, before, want = library(WORD), 0, []
    for d, t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids + [1]
        want.append((d, before, len(ids), zlib.crc32(little(ids))))
        before += len(ids)
    got = queries.op5_token_output(spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == want


def test_op7_equals_the_library(spark, texts):
    lib, want = library(WORD), []
    for d, t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(little(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = queries.op7_bpe(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(tuple(r) for r in got) == want
