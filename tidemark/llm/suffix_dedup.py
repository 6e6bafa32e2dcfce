"""Removal of byte strings that repeat, by sorting suffixes.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in the same text or another.

Sorting the suffixes of all positions would move the corpus two hundred times over, so strings that cannot repeat are
dropped first by distributed duplicate detection on fingerprints, which never drops one that does repeat:

1. Each string of LENGTH bytes is assigned to its anchor, the position inside it where a hash of CORE bytes is least.
   Consecutive strings share anchors, and equal strings have the same core at the same place in them.  A run of strings
   with one anchor is a unit; its fingerprints are of the core and of all the unit's bytes.
2. Counted over the corpus (``repeated_keys``: sorted runs of different fingerprints go to ranges, which answer with
   those that occur twice): a core that occurs once drops its unit.  A unit whose bytes occur twice repeats as a whole
   and is one string to sort.  Where units of one core differ, their strings of LENGTH bytes are fingerprinted one by one.
   Of neighbouring strings that occur twice the first and the last cover the same bytes as all (a unit has fewer than
   LENGTH strings), so these two are sorted, each with another place that has its fingerprint.
3. ``lcp_sort`` sorts what is left and decides by comparing bytes.  If it finds any of these strings only once, two
   fingerprints were equal by chance: then all strings of all units whose cores repeat are sorted, so that fingerprints
   neither remove nor keep a byte.

Texts that have an exact copy (by SHA-256) and LENGTH bytes are removed whole without a sort of their strings.

Defined results: a null text is an empty one; nulls and texts under LENGTH bytes lose nothing; repeated rows are exact copies;
null identifiers are results of their own; an empty table gives no rows; other columns, of any name, are ignored by
``removed`` and kept by ``without_repeats``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lcp_sort, store, tokens

LENGTH, CORE = 200, 96
#: Bytes of a text that are hashed at a time, fingerprints of a group, bytes of fingerprints of a range.
SEGMENT, GROUP, RANGE_BYTES = 1 << 22, 200_000, 12 << 20
#: Texts with copies up to which the list of them is broadcast (some 60 bytes each).
MOST_BROADCAST = 200_000
_B = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_TABLES: dict[str, object] = {}


def _tables(n: int):
    """Byte values, and powers of the base and of its inverse, at least ``n`` of each."""
    import numpy as np

    if "bytes" not in _TABLES:
        _TABLES["bytes"] = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if len(_TABLES.get("up", ())) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        inverse = pow(_B, -1, 1 << 64)
        for name, base in (("up", _B), ("down", inverse)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _TABLES[name] = np.multiply.accumulate(p)
    return _TABLES["bytes"], _TABLES["up"], _TABLES["down"]


def prefix_hashes(x):
    """Sums from which the hash of any range of the bytes ``x`` follows; see ``range_hash``."""
    import numpy as np

    values, up, _ = _tables(len(x) + 1)
    p = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(values[x] * up[: len(x)], out=p[1:])
    return p


def range_hash(p, start, end):
    import numpy as np

    h = (p[end] - p[start]) * _tables(len(p))[2][start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def units(data: bytes, segment: int = SEGMENT):
    """lo, hi (first and last start of the strings with one anchor), hash of the core, hash of the unit: arrays."""
    import numpy as np

    parts, n = [], len(data)
    whole = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, n - LENGTH + 1, segment):
        x = whole[at : at + segment + LENGTH - 1]
        p, m = prefix_hashes(x), len(x) - CORE + 1
        starts = np.arange(m)
        h = range_hash(p, starts, starts + CORE)
        low = np.uint64((1 << 24) - 1)
        key = (h & ~low) | starts.astype(np.uint64)  # of equal hashes the leftmost
        span, w = LENGTH - CORE + 1, 1
        while 2 * w <= span:
            key = np.minimum(key[:-w], key[w:])
            w *= 2
        if w < span:
            key = np.minimum(key[: len(key) - (span - w)], key[span - w :])
        anchor = (key & low).astype(np.int64)
        cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        lo, hi = np.append(0, cut), np.append(cut, len(anchor)) - 1
        parts.append((lo + at, hi + at, h[anchor[lo]], range_hash(p, lo, hi + LENGTH)))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*parts))


def union_of(starts, counts):
    """Disjoint starts and ends, in order, from arrays: strings of LENGTH bytes starting at start .. start + count - 1."""
    import numpy as np

    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    ends = np.maximum.accumulate(starts + counts[order] - 1 + LENGTH)
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(new[1:], True)]


def _spread(first, n):
    """first, first + 1, .. of ``n`` each, one run after the other."""
    import numpy as np

    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _member(keys, of):
    """Which of ``keys`` are in the sorted array ``of``."""
    import numpy as np

    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys if len(of) else np.zeros(len(keys), dtype=bool)


def _bytes(*arrays):
    import pyarrow as pa

    return [pa.array([a.tobytes()], pa.binary()) for a in arrays]


def repeated_keys(groups: DataFrame) -> DataFrame:
    """g, found: for each row (g, keys: 64-bit keys as binary) those of its keys that occur twice or more in the table.

    A group sends its different keys, sorted, to ranges of the keys, so a key that very many have is sent once by each
    group; a range answers each group.
    """
    spark = groups.sparkSession
    size = groups.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))

    def ask(batches):
        import numpy as np
        import pyarrow as pa

        bounds = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
        for batch in batches:
            for g, keys in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, count = np.unique(np.frombuffer(keys.as_buffer(), dtype=np.uint64), return_counts=True)
                at = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                rows = [(part, g, keys[a:b].tobytes(), (count[a:b] > 1).tobytes()) for part, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "g", "keys", "twice"])

    def answer(batches):
        import numpy as np
        import pyarrow as pa

        asked, twice = [], []
        for batch in batches:
            for g, keys, many in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                keys = np.frombuffer(keys, dtype=np.uint64)
                asked.append((g, keys))
                twice.append(keys[np.frombuffer(many, dtype=bool)])
        if not asked:
            return
        every = np.sort(np.concatenate([keys for _, keys in asked]))
        twice = np.unique(np.concatenate([*twice, every[1:][every[1:] == every[:-1]]]))
        del every
        for g, keys in asked:
            if len(keys := keys[_member(keys, twice)]):
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), *_bytes(keys)], names=["g", "found"])
        tokens.tidy()

    answers = groups.select("g", "keys").mapInArrow(ask, "part int, g long, keys binary, twice binary").repartition(parts, "part").mapInArrow(answer, "g long, found binary")
    return answers.groupBy("g").agg(F.collect_list("found").alias("found"))


def _unit_groups(segment: int, mask: int):
    """Rows (t, data) to groups of units: g, keys (hashes of the cores), and the units' t, lo, n, fingerprint."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        g, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            t, lo, n, h, uf = (np.concatenate(c) for c in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), *_bytes(h, t, lo.astype(np.int64), n.astype(np.uint8), uf & np.uint64(mask))], names=["g", "keys", "t", "lo", "n", "uf"])

        for batch in batches:
            for t, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                lo, hi, h, uf = units(data.as_buffer(), segment)
                held.append((np.full(len(lo), t, dtype=np.int64), lo, hi - lo + 1, h, uf))
                size += len(lo)
                if size >= GROUP:
                    yield flush()
                    g, size = g + 1, 0
        if held:
            yield flush()
        tokens.tidy()

    return run


def _candidates(batches):
    """Groups with the cores that were found to the units that have one: h, uf, t, lo, n."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for keys, t, lo, n, uf, found in zip(*(batch.column(c).to_pylist() for c in ("keys", "t", "lo", "n", "uf", "found"))):
            h = np.frombuffer(keys, dtype=np.int64)
            some = _member(h.view(np.uint64), np.sort(np.frombuffer(b"".join(found), dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, dtype=k)[some].astype(np.int64)) for x, k in ((keys, np.int64), (uf, np.int64), (t, np.int64), (lo, np.int64), (n, np.uint8))], names=["h", "uf", "t", "lo", "n"])


#: A unit of a text as one number: start, number of strings, whether it repeats as a whole, whether its strings are looked at one by one.
def _packed(lo, n, whole, each):
    return lo * 1024 + n * 4 + whole * 2 + each


def _unpacked(packed):
    import numpy as np

    packed = np.asarray(packed, dtype=np.int64)
    return packed >> 10, (packed >> 2) & 255, (packed & 2) > 0, (packed & 1) > 0


_STRINGS = "s binary, t long, lo long, n long"


def _strings_batch(s, t, lo, n):
    import numpy as np
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(s, pa.binary()), *[pa.array(np.concatenate(x)) for x in (t, lo, n)]], names=["s", "t", "lo", "n"])


def _cut_out(of):
    """Rows (t, data, array) to strings: ``of`` makes starts and counts from the array."""

    def run(batches):
        import numpy as np

        s, t, los, ns = [], [], [], []
        for batch in batches:
            for own, data, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                lo, n = of(found.values.to_numpy())
                for a in range(0, len(lo), 50_000):
                    part, count = lo[a : a + 50_000], n[a : a + 50_000]
                    s += [data[i:j] for i, j in zip(part.tolist(), (part + count - 1 + LENGTH).tolist())]
                    t.append(np.full(len(part), own, dtype=np.int64))
                    los.append(part)
                    ns.append(count)
                    if len(s) >= 50_000:
                        yield _strings_batch(s, t, los, ns)
                        s, t, los, ns = [], [], [], []
        if t:
            yield _strings_batch(s, t, los, ns)

    return run


def _whole(packed):
    lo, n, whole, _ = _unpacked(packed)
    return lo[whole], n[whole]


def _single(packed):
    """Every string of every unit."""
    import numpy as np

    lo, n, _, _ = _unpacked(packed)
    lo = _spread(lo, n)
    return lo, np.ones(len(lo), dtype=np.int64)


def _starts(starts):
    import numpy as np

    return np.sort(starts), np.ones(len(starts), dtype=np.int64)


def _some(rate: int):
    """About one unit in ``rate``."""

    def of(packed):
        import numpy as np

        lo, n, _, _ = _unpacked(packed)
        some = (lo * 0x9E3779B1 + packed * 0x85EBCA77 >> 16) % rate == 0
        return lo[some], np.ones(int(some.sum()), dtype=np.int64)

    return of


def _window_groups(mask: int):
    """Rows (t, data, units) to groups of the strings to look at one by one: g, keys (fingerprints), and the units' t, lo, n."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        g, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            t, lo, n, keys = (np.concatenate(c) for c in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), *_bytes(keys & np.uint64(mask), t, lo, n)], names=["g", "keys", "t", "lo", "n"])

        for batch in batches:
            for own, data, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                lo, n, _, each = _unpacked(found.values.to_numpy())
                lo, n = lo[each], n[each]
                order = np.argsort(lo)
                lo, n = lo[order], n[order]
                text, i = np.frombuffer(data.as_buffer(), dtype=np.uint8), 0
                while i < len(lo):  # units that lie within one segment
                    j = int(np.searchsorted(lo, lo[i] + SEGMENT))
                    p = prefix_hashes(text[lo[i] : lo[j - 1] + n[j - 1] + LENGTH])
                    starts = _spread(lo[i:j] - lo[i], n[i:j])
                    held.append((np.full(j - i, own, dtype=np.int64), lo[i:j], n[i:j], range_hash(p, starts, starts + LENGTH)))
                    size += len(starts)
                    i = j
                    if size >= GROUP:
                        yield flush()
                        g, size = g + 1, 0
        if held:
            yield flush()
        tokens.tidy()

    return run


def _window_candidates(batches):
    """Groups with the fingerprints that were found to the strings that have one: wf, t, at, chosen (no such neighbour on one side)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for keys, t, lo, n, found in zip(*(batch.column(c).to_pylist() for c in ("keys", "t", "lo", "n", "found"))):
            keys, t, lo, n = np.frombuffer(keys, dtype=np.uint64), *(np.frombuffer(x, dtype=np.int64) for x in (t, lo, n))
            some = _member(keys, np.sort(np.frombuffer(b"".join(found), dtype=np.uint64)))
            first = np.zeros(len(keys) + 1, dtype=bool)
            first[np.cumsum(n) - n] = True
            first[-1] = True
            before, after = np.append(False, some[:-1]) & ~first[:-1], np.append(some[1:], False) & ~first[1:]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)[some]), pa.array(np.repeat(t, n)[some]), pa.array(_spread(lo, n)[some]), pa.array((~before | ~after)[some])], names=["wf", "t", "at", "chosen"])


def _grouped(groups: DataFrame, make, schema: str) -> DataFrame:
    """``make`` over the groups that have repeated keys, with these keys."""
    found = repeated_keys(groups).withColumnRenamed("g", "of")
    return groups.join(found, F.col("g") == F.col("of")).drop("g", "of").mapInArrow(make, schema)


def repeats(single: DataFrame, segment: int = SEGMENT, bits: int = 64) -> DataFrame:
    """t, spans (array of start * 256 + number of strings) of the texts (t, data) that have strings that occur elsewhere.

    ``bits`` of the fingerprints of units and strings are used.
    """
    spark, mask = single.sparkSession, (1 << bits) - 1
    groups = store.written(spark, single.mapInArrow(_unit_groups(segment, mask), "g long, keys binary, t binary, lo binary, n binary, uf binary"), "units")
    found = store.written(spark, _grouped(groups, _candidates, "h long, uf long, t long, lo long, n long"), "candidates")
    store.dropped(spark, groups)
    kinds = store.written(spark, found.groupBy("h", "uf").agg(F.count("*").alias("c"), F.min(F.struct("t", "lo")).alias("first")), "kinds")
    cores = kinds.groupBy(F.col("h").alias("core")).agg(F.count("*").alias("kinds"))
    flagged = kinds.join(cores, F.col("h") == F.col("core")).select(F.col("h").alias("fh"), F.col("uf").alias("fuf"), "c", "first", "kinds")
    flagged = store.written(spark, flagged, "flagged")
    own = found.join(flagged, (F.col("h") == F.col("fh")) & (F.col("uf") == F.col("fuf")))
    each = (F.col("kinds") > 1) & (F.col("t") == F.col("first.t")) & (F.col("lo") == F.col("first.lo"))
    lists = own.groupBy("t").agg(F.collect_list(_packed(F.col("lo"), F.col("n"), (F.col("c") > 1).cast("long"), each.cast("long"))).alias("units")).withColumnRenamed("t", "at_t")
    picked = store.written(spark, single.join(lists, F.col("t") == F.col("at_t")).select("t", "data", "units"), "picked")
    store.dropped(spark, found, kinds, flagged)

    windows = store.written(spark, picked.mapInArrow(_window_groups(mask), "g long, keys binary, t binary, lo binary, n binary"), "windows")
    marked = store.written(spark, _grouped(windows, _window_candidates, "wf long, t long, at long, chosen boolean"), "marked")
    store.dropped(spark, windows)
    place = F.struct("t", "at")
    others = marked.groupBy("wf").agg(F.max("chosen").alias("chosen"), F.min(place).alias("a"), F.max(place).alias("b")).where("chosen").select(F.explode(F.array("a", "b")).alias("p")).select("p.t", "p.at")
    wanted = marked.where("chosen").select("t", "at").union(others).distinct()
    wanted = store.written(spark, wanted.groupBy(F.col("t").alias("at_t")).agg(F.collect_list("at").alias("starts")), "wanted")
    store.dropped(spark, marked)
    whole = F.filter("units", lambda u: u.bitwiseAND(F.lit(2)) > 0)
    n_units, n_whole = picked.agg(F.coalesce(F.sum(F.size("units")), F.lit(0)), F.coalesce(F.sum(F.size(whole)), F.lit(0))).first()
    n_wanted = wanted.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0]
    strings = picked.mapInArrow(_cut_out(_whole), _STRINGS).union(picked.join(wanted, F.col("t") == F.col("at_t")).select("t", "data", "starts").mapInArrow(_cut_out(_starts), _STRINGS))
    told = _sorted(picked, strings, n_units, n_whole + n_wanted)
    if told.count() < n_whole + n_wanted:  # fingerprints that are equal by chance
        store.dropped(spark, told)
        told = _sorted(picked, picked.mapInArrow(_cut_out(_single), _STRINGS), n_units, n_units * (LENGTH - CORE))
    spans = store.written(spark, told.groupBy("t").agg(F.collect_list(F.col("lo") * 256 + F.col("n")).alias("spans")), "repeats")
    store.dropped(spark, picked, wanted, told)
    return spans


def _sorted(picked: DataFrame, strings: DataFrame, n_units: int, n_strings: int) -> DataFrame:
    """t, lo, n of the ``strings`` that occur twice or more; the cut points come from a sample of the units of ``picked``."""
    spark = picked.sparkSession
    ranges, parts = lcp_sort.ranges_for(spark, n_strings * (LENGTH + (LENGTH - CORE) // 2))
    some = picked.mapInArrow(_cut_out(_some(max(1, n_units // (ranges * 40)))), _STRINGS)
    sample = [r.s for r in some.select(F.substring("s", 1, 48).alias("s")).limit(ranges * 100).collect()]  # of bounded number and length
    return store.written(spark, lcp_sort.repeated(strings, sample, ranges, parts, LENGTH), "confirmed")


def _left(data: bytes, starts, ends) -> bytes:
    at, parts = 0, []
    for a, b in zip(starts, ends):
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _cut(docs: DataFrame, text_col: str, carry: list[str], make, types: str, options: dict) -> DataFrame:
    """``make(data, starts, ends)`` for every document, as columns m0, m1, .., beside the columns of ``carry`` as k0, k1, .."""
    spark = docs.sparkSession
    store.importable(spark)
    data = F.encode(F.coalesce(store.column(text_col).cast("string"), F.lit("")), "UTF-8")
    names = [f"k{i}" for i in range(len(carry))]
    rows = docs.select(F.monotonically_increasing_id().alias("t"), data.alias("data"), *[store.column(c).alias(k) for c, k in zip(carry, names)])
    rows = store.written(spark, rows.withColumn("sha", F.unhex(F.sha2("data", 256))), "texts")
    copied = rows.where(F.octet_length("data") >= LENGTH).groupBy(F.col("sha").alias("copied")).agg(F.count("*").alias("copies"), F.min("t").alias("first")).where("copies > 1").select("copied", "first")
    copied = store.written(spark, copied, "copied")
    if copied.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        copied = F.broadcast(copied)
    single = rows.where(F.octet_length("data") >= LENGTH).select("t", "data", "sha").join(copied, F.col("sha") == F.col("copied"), "left").where("first IS NULL OR first = t").select("t", "data")
    known = repeats(single, **options).withColumnRenamed("t", "of")
    joined = rows.join(copied, (F.col("sha") == F.col("copied")) & (F.octet_length("data") >= LENGTH), "left").join(known, F.col("t") == F.col("of"), "left")
    joined = joined.select("data", F.col("copied").isNotNull().alias("whole"), "spans", *names)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for data, whole, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if whole:
                    out.append(make(data, [0], [len(data)]))
                elif spans.is_valid:
                    packed = spans.values.to_numpy()
                    out.append(make(data, *(x.tolist() for x in union_of(packed >> 8, packed & 255))))
                else:
                    out.append(make(data, [], []))
            if out:
                columns = [pa.array(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([*batch.columns[3:], *columns], names=[*names, *(f"m{i}" for i in range(len(columns)))])
        tokens.tidy()

    fields = [f"{k} {joined.schema[k].dataType.simpleString()}" for k in names]
    return joined.mapInArrow(run, ", ".join([*fields, *(f"m{i} {kind}" for i, kind in enumerate(types.split()))]))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def make(data, starts, ends):
        import hashlib

        return len(data), sum(ends) - sum(starts), len(starts), hashlib.sha256(_left(data, starts, ends)).hexdigest()

    return _cut(docs, text_col, [id_col], make, "long long long string", options).toDF("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, their columns in order, with the text left over; characters that a cut splits are dropped."""

    def make(data, starts, ends):
        return (_left(data, starts, ends).decode("utf-8", "ignore"),)

    carry = [c for c in docs.columns if c != text_col]
    cut = _cut(docs, text_col, carry, make, "string", options)
    place = {c: f"k{i}" for i, c in enumerate(carry)} | {text_col: "m0"}
    return cut.select(*[F.col(place[c]).alias(c) for c in docs.columns])
