"""WARC archives: write captures, read them back, assemble transactions.

Writing: payloads are digested where they lie; the digests that occur twice or more (pre-aggregated counts) say which
capture keeps its payload and which revisit it.  Every task writes one archive, a gzip member for each record: the
response or revisit, and a request and a metadata record that name it in ``WARC-Concurrent-To``.  Attempts write under
their own names; the manifest, committed by Spark, names the archives that count.

Reading: an archive is a task; records are parsed from the stream one at a time and digests are checked.  Assembly
joins the three records of a capture through the concurrent-to identifier into one nested row.

A revisit names what it revisits by ``WARC-Refers-To-Target-URI`` and, as an extension field, the identifier of the
page.  Among equal payloads of ``min_bytes`` or more the largest page identifier is the response.

Defined results: a null html is an empty payload; null page identifiers are smaller than others; rows that share the
largest identifier and the payload are all responses; a null url gives no target field; an empty table gives an empty
manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

MANIFEST = "shard int, path string, n_records long, n_bytes long"
RECORD = "record_id string, concurrent_to string, record_type string, target_uri string, page_id string, payload_bytes long, payload_digest string, refers_to string"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(kind: str, record_id: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member; white space that would end a field is made a space."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *fields, ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in lines if v is not None) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8")) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def capture(page_id, url, payload: bytes, sha1_hex: str, keep_id, keep_url, revisit: bool) -> list[bytes]:
    """The three records of one page."""
    own, digest = f"<urn:uuid:{uuid.uuid4()}>", "sha1:" + base32(sha1_hex)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = [("WARC-Target-URI", url)]
    if revisit:
        fields = [*target, ("WARC-Payload-Digest", digest), ("WARC-Profile", REVISIT), ("WARC-Refers-To-Target-URI", keep_url), ("WARC-Refers-To-Date", DATE), ("WARC-Refers-To-Page", keep_id), ("Content-Type", "application/http; msgtype=response")]
        main = record("revisit", own, fields, http)
    else:
        main = record("response", own, [*target, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")], http + payload)
    place = " ".join((url or "/").split())
    asked = record("request", f"<urn:uuid:{uuid.uuid4()}>", [*target, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], f"GET {place} HTTP/1.1\r\n\r\n".encode("utf-8"))
    said = record("metadata", f"<urn:uuid:{uuid.uuid4()}>", [*target, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], (f"page-id: {page_id}\r\n" if page_id is not None else "via: none\r\n").encode())
    return [asked, main, said]


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write all pages; returns the manifest."""
    spark = pages.sparkSession
    store.importable(spark)
    path = path or store.new_dir(spark, "warc")
    payload = F.encode(F.coalesce(store.column(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(store.column(id_col).cast("long").alias("page_id"), store.column(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    repeated = (
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("keep_id"), F.max_by("url", "page_id").alias("keep_url"))
        .where("n > 1").select(F.col("sha1").alias("of"), "keep_id", "keep_url")
    )
    repeated = store.written(spark, repeated, "repeated")  # a stage of its own, so that the join below can split a hot digest

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, out, n, size = TaskContext.get().partitionId(), None, 0, 0
        name = f"{path}/pages-{shard:06d}-{uuid.uuid4().hex[:8]}.warc.gz"
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "of", "keep_id", "keep_url")]
            for row, payload in zip(zip(*columns), batch.column("payload")):
                page_id, url, sha1, of, keep_id, keep_url = row
                out = out or store.open_out(name)
                for data in capture(page_id, url, payload.as_py(), sha1, keep_id, keep_url, of is not None and page_id != keep_id):
                    out.write(data)
                    n, size = n + 1, size + len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((shard, name, n, size), (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["shard", "path", "n_records", "n_bytes"])

    joined = rows.join(repeated, rows.sha1 == repeated["of"], "left")
    return store.written(spark, joined.mapInArrow(run, MANIFEST), "manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, unpacked, one at a time."""
    data = stream.read(chunk)
    while data:
        unpack, parts = zlib.decompressobj(31), []
        while data:
            parts.append(unpack.decompress(data))
            if unpack.eof:
                break
            data = stream.read(chunk)
        if not unpack.eof:
            raise ValueError("the archive ends inside a record")
        yield b"".join(parts)
        data = unpack.unused_data or stream.read(chunk)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def row_of(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, page_id, size, digest, payload = fields["warc-type"], None, None, None, None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != size or base32(hashlib.sha1(payload).hexdigest()) != digest):
            raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    elif kind == "metadata":
        page_id = dict(line.partition(": ")[::2] for line in block.decode().split("\r\n")).get("page-id")
    row = (fields["warc-record-id"], fields.get("warc-concurrent-to"), kind, fields.get("warc-target-uri"), page_id, size, digest, fields.get("warc-refers-to-page"))
    return (*row, payload if kind == "response" else None) if with_payload else row


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of the manifest's archives (columns of RECORD, and payload where asked for)."""
    store.importable(spark)

    def run(batches):
        import pyarrow as pa

        types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_payload
        names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * with_payload

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_in(uri) as stream:
                    for data in members(io.BufferedReader(stream, 1 << 20)):
                        rows.append(row_of(*parse(data), with_payload))
                        held += len(data) if with_payload else 100
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    paths = [(r.path,) for r in manifest.select("shard", "path").orderBy("shard").collect()]  # a row for each archive
    return store.one_per_task(spark, paths, "path string").mapInArrow(run, RECORD + (", payload binary" if with_payload else ""))


def transactions(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, request, response, metadata (null where a record is missing).

    Response stands for the response or revisit record.  Of several records of a kind that name the same capture the
    one of smallest identifier is taken.
    """
    fields = F.struct(*[F.col(c) for c in records.columns])
    of = lambda *kinds: F.min(F.when(F.col("record_type").isin(*kinds), fields))
    key = F.coalesce("concurrent_to", "record_id").alias("capture_id")
    return records.groupBy(key).agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))


def digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture, from the archives."""
    nested = transactions(read_archives(spark, manifest))
    return nested.select(F.col("metadata.page_id").cast("long").alias("page_id"), "response.payload_bytes", "response.payload_digest", "response.record_type", F.col("response.refers_to").cast("long").alias("refers_to"))


_CHARS = ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {s}) & 31 AS INTEGER) + 1, 1)" for s in (15, 10, 5, 0))

#: DuckDB: 40 hexadecimal digits are eight groups of twenty bits, each four characters of base 32.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep_id FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)), lambda v: concat({_CHARS})), '') AS payload_digest,
       CASE WHEN page_id = keep_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep_id THEN keep_id END AS refers_to
FROM g"""
