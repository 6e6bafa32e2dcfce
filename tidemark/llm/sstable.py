"""Token-id output as sorted-string-table shards.

Documents are range-partitioned by identifier; each task encodes its range in order and writes one shard: blocks of
prefix-compressed keys with their ids, a sparse index (the last key of each block), a Bloom filter of the keys and a
footer.  A lookup reads footer, index and filter, searches the index by halves and opens one block.

File: ``TMSST001``; blocks (zstd of entries: shared key bytes, further key bytes, value bytes as varints, then the two);
index; filter; footer of fixed size.  Keys: byte 0 for a null identifier, else byte 1 and the 64-bit identifier, sign
bit turned, big-endian, so that byte order is numeric order.  Values: ids, 16-bit little-endian if the vocabulary has
at most 65,536 entries, else 32-bit.

An attempt of a task writes under its own name and the manifest, a table committed by Spark, names the winner's file;
so lost executors and speculative copies leave at most an unnamed file.

Defined results: a null text is an empty one (the end id alone); null identifiers come first; rows with equal
identifiers are all kept, in the order of their ids, and a lookup gives all of them; an empty table gives an empty
manifest; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, tokens

MAGIC = b"TMSST001"
FOOTER = struct.Struct("<QQQQQQI4x8s")
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"
BLOCK_BYTES = 64 << 10
BITS_PER_KEY, PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & ((1 << 64) - 1) | 1
    return [((a + i * b) & ((1 << 64) - 1)) % bits for i in range(PROBES)]


class Writer:
    """One shard, written front to back; holds one block, the index and the keys' probes."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.at, self.pack = out, width, 0, zstandard.ZstdCompressor(level=1).compress
        self.block, self.filled, self.last, self.index, self.keys = [], 0, b"", [], []
        self.n_docs = self.n_tokens = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.filled += len(entry)
        if not self.keys or key != self.last:
            self.keys.append(key)
        self.last = key
        self.n_docs += 1
        self.n_tokens += len(value) // self.width
        if self.filled >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.pack(b"".join(self.block))
            self.index.append((self.last, self.at, len(data)))
            self._put(data)
            self.block, self.filled = [], 0

    def close(self) -> None:
        import numpy as np

        self._flush()
        index_at = self.at
        self._put(b"".join(_varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index))
        bloom_at, bits = self.at, max(64, BITS_PER_KEY * len(self.keys))
        flags = np.zeros(-(-bits // 8) * 8, dtype=np.uint8)
        for key in self.keys:
            flags[_probes(key, bits)] = 1
        self._put(np.packbits(flags, bitorder="little").tobytes())
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, bits, self.n_docs, self.n_tokens, self.width, MAGIC))
        self.out.close()


class Shard:
    """Reads one shard: ``get`` by identifier, ``items`` in order."""

    def __init__(self, uri: str):
        self.file = store.open_in(uri)
        size = self.file.size()
        index_at, index_n, bloom_at, self.bits, self.n_docs, self.n_tokens, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        data, at, self.blocks = self._read(index_at, index_n), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.blocks.append((data[at : at + n], *struct.unpack_from("<QI", data, at + n)))
            at += n + 12
        self.bloom = self._read(bloom_at, -(-self.bits // 8))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, at: int, n: int) -> Iterator[tuple[bytes, bytes]]:
        import zstandard

        data, i, key = zstandard.ZstdDecompressor().decompress(self._read(at, n)), 0, b""
        while i < len(data):
            shared, i = _read_varint(data, i)
            more, i = _read_varint(data, i)
            size, i = _read_varint(data, i)
            key = key[:shared] + data[i : i + more]
            i += more
            yield key, data[i : i + size]
            i += size

    def items(self) -> Iterator[tuple[int | None, bytes]]:
        for _, at, n in self.blocks:
            for key, value in self._entries(at, n):
                yield id_of(key), value

    def may_have(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of all documents of this identifier, as stored."""
        if not self.may_have(doc_id):
            return []
        key, found = key_of(doc_id), []
        i = bisect_left([b[0] for b in self.blocks], key)
        for last, at, n in self.blocks[i:]:
            found += [v for k, v in self._entries(at, n) if k == key]
            if last != key:
                break
        return found


def write_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write all documents; returns the manifest (shard, path, n_docs, n_tokens, n_bytes), shards in identifier order."""
    spark = docs.sparkSession
    store.importable(spark)
    path = path or store.new_dir(spark, "shards")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, task = tokens.encoder(tokenizer), TaskContext.get()
        dtype = np.uint16 if enc.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else np.uint32
        name, writer = f"{path}/shard-{task.partitionId():06d}-{uuid.uuid4().hex[:8]}.sst", None
        for whole in batches:
            for batch in tokens.small_batches(whole, 1):
                ids, counts = tokens.with_end(*enc.encode_all(batch.column(1)), end_id)
                data, at, width = ids.astype(dtype).tobytes(), 0, dtype().itemsize
                for doc_id, n in zip(batch.column(0).to_pylist(), (counts * width).tolist()):
                    writer = writer or Writer(store.open_out(name), width)
                    writer.add(key_of(doc_id), data[at : at + n])
                    at += n
        tokens.tidy()
        if writer:
            writer.close()
            row = [task.partitionId(), name, writer.n_docs, writer.n_tokens, writer.at]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["shard", "path", "n_docs", "n_tokens", "n_bytes"])

    chosen = docs.select(store.column(id_col).cast("long").alias("doc_id"), store.column(text_col).cast("string").alias("text"))
    # equal identifiers may fall on two shards; the text's hash keeps a repeated one from filling a single task
    ranged = chosen.withColumn("h", F.xxhash64("text")).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h"))
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("h")).select("doc_id", "text")
    return store.written(spark, ordered.mapInArrow(run, MANIFEST), "manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """shard, start_in_shard, doc_id, n_tokens, ids (unsigned 32-bit little-endian) of every document, from the files."""
    store.importable(spark)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows(chunk):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "start_in_shard", "doc_id", "n_tokens", "ids"])

        for batch in batches:
            for number, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard, start, chunk, size = Shard(uri), 0, [], 0
                for doc_id, value in shard.items():
                    ids = np.frombuffer(value, dtype=f"<u{shard.width}").astype("<u4").tobytes()
                    chunk.append((number, start, doc_id, len(ids) // 4, ids))
                    start, size = start + len(ids) // 4, size + len(ids)
                    if size > 8 << 20 or len(chunk) >= 5_000:
                        yield rows(chunk)
                        chunk, size = [], 0
                if chunk:
                    yield rows(chunk)

    shards = [(r.shard, r.path) for r in manifest.select("shard", "path").orderBy("shard").collect()]  # a row for each file
    return store.one_per_task(spark, shards, "shard int, path string").mapInArrow(run, "shard int, start_in_shard long, doc_id long, n_tokens long, ids binary")


def digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    totals = [(r.shard, r.n_tokens) for r in manifest.select("shard", "n_tokens").collect()]  # a row for each file
    before = spark.createDataFrame(store.prefix_sums(totals), "shard int, before long")
    return read_shards(spark, manifest).join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", F.crc32("ids").alias("ids_crc32"))
