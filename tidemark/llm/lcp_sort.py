"""Distributed merge sort of strings that knows common prefixes.

Each task sorts its strings in runs, front-codes them (length of the prefix shared with the string before, then the
rest) and cuts them at the splitters.  Runs are exchanged front-coded.  A task merges the runs of its range with a
loser tree whose nodes keep the length of the prefix that each loser shares with the string that beat it: two strings
are compared from the shorter known prefix on, and not at all where the lengths decide.

Equal strings of a run are folded into one entry before they are exchanged, so a string that a third of all rows
share reaches its range once for each run.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Strings of a run, bytes of strings of a part, ranges.
RUN_STRINGS, RANGE_BYTES, MOST_RANGES = 60_000, 24 << 20, 1024
_HEAD = struct.Struct("<HH?qqq")  # shared, further length, several in the run, locator (t, lo, n) of one of them


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings that agree up to ``start``."""
    most = min(len(a), len(b))
    while start < most:
        x, y = a[start : start + 32], b[start : start + 32]
        if x != y:
            n = min(len(x), len(y))
            d = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return start + n - (d.bit_length() + 7) // 8
        start += 32
    return most


def entry(shared: int, s: bytes, several: bool, where: tuple) -> bytes:
    """One string of a run, front-coded."""
    return _HEAD.pack(shared, len(s) - shared, several, *where) + s[shared:]


def part_of(where: tuple) -> int:
    return hash(where) & 0x7FFFFFFF


class Run:
    """Reads a front-coded run; ``now`` is the current string or None, ``shared`` its prefix in common with the one before."""

    def __init__(self, blob: bytes):
        self.blob, self.at, self.now, self.shared = blob, 0, b"", 0
        self.advance()

    def advance(self) -> None:
        if self.at >= len(self.blob):
            self.now = None
            return
        self.shared, n, self.several, *self.where = _HEAD.unpack_from(self.blob, self.at)
        at = self.at + _HEAD.size
        self.now = self.now[: self.shared] + self.blob[at : at + n]
        self.at = at + n


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, bool, tuple]]:
    """The strings of all runs in order: string, prefix shared with the one before, several, locator."""
    runs = [r for r in runs if r.now is not None]
    k = 1
    while k < max(2, len(runs)):
        k *= 2
    players: list[Run | None] = [*runs, *[None] * (k - len(runs))]
    known = [0] * k  # prefix that a player shares with the string that last beat it
    losers = [-1] * k

    def beats(i: int, j: int) -> int:
        """The winner; the loser's known prefix is set."""
        a, b = players[i], players[j]
        if b is None or b.now is None:
            return i
        if a is None or a.now is None:
            return j
        if known[i] != known[j]:
            return i if known[i] > known[j] else j
        n = common(a.now, b.now, known[i])
        x, y = a.now, b.now
        first = n == len(x) or n < len(y) and x[n] < y[n]
        if first:
            known[j] = n
            return i
        known[i] = n
        return j

    winners = list(range(k))
    level = [*[0] * k, *winners]
    for node in range(k - 1, 0, -1):
        i, j = level[2 * node], level[2 * node + 1]
        w = beats(i, j)
        level[node], losers[node] = w, j if w == i else i
    top = level[1]
    while (run := players[top]) is not None and run.now is not None:
        yield run.now, known[top], run.several, tuple(run.where)
        run.advance()
        known[top] = run.shared
        node = (k + top) // 2
        while node:
            other = losers[node]
            w = beats(top, other)
            if w == other:
                losers[node], top = top, other
            node //= 2


def ranges_for(spark, size: int) -> tuple[int, int]:
    """Ranges, at most ``MOST_RANGES``, and parts (ranges times the pieces that each is dealt into) for ``size`` bytes of strings."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ranges = min(parts, MOST_RANGES)
    return ranges, ranges * -(-parts // ranges)


def repeated(strings: DataFrame, sample: list[bytes], ranges: int, parts: int, least: int) -> DataFrame:
    """Of rows (s binary, t long, lo long, n long): t, lo, n of those whose string occurs, or begins a longer one, elsewhere.

    ``sample``: beginnings of some of the strings, or of others like them, a few dozen for each of the ``ranges``; a range
    is dealt into parts / ranges pieces by a hash of the first ``least`` bytes, which all strings have.
    """
    spark, pieces = strings.sparkSession, parts // ranges
    cuts = [bytes(x) for x in sorted(sample)]
    shared = spark.sparkContext.broadcast([cuts[len(cuts) * i // ranges] for i in range(1, ranges)] if cuts else [])  # a short string for each range, their number bounded

    def runs(batches):
        import bisect
        import zlib

        import pyarrow as pa
        import zstandard

        cuts, held, pack = shared.value, [], zstandard.ZstdCompressor(level=3).compress

        def flush():
            held.sort()
            entries, decided, i = [], [], 0
            while i < len(held):
                j = i + 1
                while j < len(held) and held[j][0] == held[i][0]:
                    j += 1
                if j > i + 1:
                    decided += [w[1:] for w in held[i + 1 : j]]
                entries.append((held[i][0], j > i + 1, held[i][1:]))
                i = j
            held.clear()
            keys, blobs, a = [], [], 0
            for part in range(len(cuts) + 1):
                b = bisect.bisect_left(entries, cuts[part], key=lambda e: e[0]) if part < len(cuts) else len(entries)
                piece = [zlib.crc32(e[0][:least]) % pieces for e in entries[a:b]] if pieces > 1 else [0] * (b - a)
                for k in range(pieces) if b > a else ():
                    out, before = [], b""
                    for (s, several, where), own in zip(entries[a:b], piece):
                        if own == k:
                            n = common(before, s)
                            out.append(entry(n, s, several, where))
                            before = s
                    if out:
                        keys.append(part * pieces + k)
                        blobs.append(pack(b"".join(out)))
                a = b
            m = len(keys)
            spread = [part_of(w) % parts for w in decided]
            columns = list(zip(*decided)) if decided else ([], [], [])
            return pa.RecordBatch.from_arrays(
                [pa.array(keys + spread, pa.int32()), pa.array(blobs + [None] * len(decided), pa.binary()), *[pa.array([None] * m + list(c), pa.int64()) for c in columns]],
                names=["part", "blob", "t", "lo", "n"],
            )

        for batch in batches:
            held += zip(*[c.to_pylist() for c in batch.columns])
            if len(held) >= RUN_STRINGS:
                yield flush()
        if held:
            yield flush()

    def merge(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        by_part: dict[int, list[Run]] = {}
        for batch in batches:
            told = batch.column(1).is_null()  # decided inside a run
            yield pa.RecordBatch.from_arrays(batch.columns[2:], names=["t", "lo", "n"]).filter(told)
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if blob is not None:
                    by_part.setdefault(part, []).append(Run(unpack(blob)))
        for part in sorted(by_part):
            out, last, last_where, told = [], b"", None, False
            for s, n, several, where in merged(by_part.pop(part)):
                if last_where and not told and n >= len(last):
                    out.append(last_where)
                last, last_where, told = s, where, several or (last_where is not None and n >= len(s))
                if told:
                    out.append(where)
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["t", "lo", "n"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["t", "lo", "n"])

    sent = strings.select("s", "t", "lo", "n").mapInArrow(runs, "part int, blob binary, t long, lo long, n long")
    return sent.repartition(parts, "part").mapInArrow(merge, "t long, lo long, n long")
