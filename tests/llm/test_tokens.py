"""Packing, shards and BPE against the tokenizers library."""

import hashlib
import random
import struct
import zlib

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, sstable, tokens

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
HARD = [
    None, "", " ", "\n\n", "a", " a b  c\n\nd \n e\t\tf ", "don't we'll  I'M", "naïve café ÅNGSTRÖM İstanbul ΣΑΣ ǅ", "x<|endoftext|>y <|endoftext|> z<|startoftext|>",
    "foo \nbar\n baz\r\n\r\nqux", "日本語 テスト 🙂🙂 é ́x", "a b  c\x1cd\x85e", "1234 12.5% ½ Ⅷ ²", "under_score -- ... !!!***", "w" * 3000, "ab " * 3000, "tab\tsep\x0bvt\x0cff",
]
ROWS = [(i, t, "clash", 1) for i, t in enumerate(HARD)] + [(3, HARD[4], "clash", 2), (None, "no id", "x", 3)]
SCHEMA = "doc_id long, text string, part string, n_tokens int"


def library(name):
    t = Tokenizer.from_file(tokens.resolve(name))
    t.no_padding()
    t.no_truncation()
    return t


def random_texts(n, seed=5):
    """Texts of few kinds of characters in all orders: white space of all sorts, contractions, marks, special tokens."""
    rng = random.Random(seed)
    parts = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "\x00", "a", "b", "'s", "'", "x", "1", "½", ".", ",", "-", "é", "ê", "Ø", "İ", "Σ", "\u0301", "日", "<|endoftext|>", "<|end"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_batches_give_the_librarys_ids(name):
    lib, own = library(name), tokens.ChunkEncoder(name)
    texts = HARD + random_texts(4000)
    for _ in range(2):  # the second time with known words
        ids, sizes = own.encode_all(pa.array(texts, pa.string()))
        at = 0
        for text, n in zip(texts, sizes.tolist()):
            assert ids[at : at + n].tolist() == lib.encode(text or "", add_special_tokens=False).ids, text
            at += n
        assert at == len(ids)
    assert [own.encode(t) for t in HARD] == [lib.encode(t or "", add_special_tokens=False).ids for t in HARD]


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 200)
    lib, own = library(BYTE), tokens.ChunkEncoder(BYTE)
    for seed in range(4):
        texts = [" ".join(f"w{seed}x{i}" + "abc"[i % 3] for i in range(150))] * 2 + ["the word " * 3]
        ids, sizes = own.encode_all(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in lib.encode(t, add_special_tokens=False).ids]
        assert all(half is None or len(half[0]) <= 100 for half in own.known.halves)


def test_batches_are_cut_by_bytes():
    batch = pa.record_batch([pa.array([1, 2, 3, 4, 5]), pa.array(["a" * 90, None, "b" * 9, "c" * 500, ""])], names=["i", "t"])
    assert [b.num_rows for b in tokens.small_batches(batch, 1, 100)] == [3, 1, 1]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_own_bpe_equals_the_library(name):
    lib, own = library(name), bpe.Codec(tokens.resolve(name))
    for text in HARD:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False), text


def test_packing_is_a_cut_of_the_concatenation(spark):
    lib = library(BYTE)
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    rows = packing.with_crc(packing.pack(docs, BYTE, length=64)).collect()
    want = {}
    for doc_id, text, *_ in ROWS:
        want.setdefault(doc_id, []).append(lib.encode(text or "", add_special_tokens=False).ids + [1])
    at = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    fill = {}
    for s, o, n in at:
        assert o == fill.get(s, 0)
        fill[s] = o + n
    assert all(n == 64 for s, n in fill.items() if s != max(fill)) and sorted(fill) == list(range(max(fill) + 1))
    assert sum(fill.values()) == sum(len(x) for v in want.values() for x in v)
    for r in rows:
        assert any(len(ids) == r.doc_tokens and zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) == r.ids_crc32 for ids in want[r.doc_id])


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), BYTE).collect() == []


def test_shards_round_trip(spark):
    lib = library(WORD)
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    manifest = sstable.write_shards(docs, WORD)
    rows = sorted(sstable.digests(spark, manifest).collect(), key=lambda r: r.start)
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert ids == sorted(ids) and len(rows) == len(ROWS)
    before, want = 0, {}
    for doc_id, text, *_ in ROWS:
        want.setdefault(doc_id, []).append(lib.encode(text or "", add_special_tokens=False).ids + [1])
    for r in rows:
        assert r.start == before
        before += r.n_tokens
        assert any(len(x) == r.n_tokens and zlib.crc32(struct.pack(f"<{len(x)}I", *x)) == r.ids_crc32 for x in want[r.doc_id])
    found = [sstable.Shard(r.path) for r in manifest.collect()]
    for doc_id, texts in want.items():
        got = [v for s in found for v in s.get(doc_id)]
        assert sorted(got) == sorted(struct.pack(f"<{len(x)}H", *x) for x in texts)
    assert not any(s.get(10**12) for s in found)


def test_shards_of_nothing(spark):
    manifest = sstable.write_shards(spark.createDataFrame([], SCHEMA), WORD)
    assert manifest.collect() == [] and sstable.digests(spark, manifest).collect() == []


def test_lookup_reads_one_block_of_many(tmp_path):
    from tidemark.llm import store

    uri = f"file://{tmp_path}/x.sst"
    w = sstable.Writer(store.open_out(uri), 2)
    for i in range(-5000, 5000):
        w.add(sstable.key_of(i), struct.pack("<20H", *[i % 60000] * 20))
    w.close()
    s = sstable.Shard(uri)
    assert len(s.blocks) > 3 and [k for k, _ in s.items()] == list(range(-5000, 5000))
    assert all(s.get(i) == [struct.pack("<20H", *[i % 60000] * 20)] for i in (-5000, -1, 0, 4999))
    assert sum(s.may_have(i) for i in range(10_000, 20_000)) < 300


def test_codec_digests(spark):
    lib = library(WORD)
    rows = {(r.doc_id, r.ids_sha256): r for r in bpe.codec_digests(spark.createDataFrame(ROWS, SCHEMA), WORD).collect()}
    for doc_id, text, *_ in ROWS:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        r = rows[doc_id, hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()]
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
