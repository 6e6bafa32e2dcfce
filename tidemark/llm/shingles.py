"""Word shingles of whole texts as sets of 64-bit hashes, and their minima under many hash functions.

Words are the runs of ``[^\\x20\\x09-\\x0D]``, as they stand.  A text of fewer words than a shingle has is one shingle of all
of them; a text without words has none.
"""

from __future__ import annotations

from . import tokens

SIZE = 5
COORDINATES = 64
_MIX = 0x9E3779B97F4A7C15


def mix(x):
    """A 64-bit finaliser over numpy arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self):
        import numpy as np

        steps = np.arange(1, 129, dtype=np.uint64)
        self.powers = mix(steps) | np.uint64(1)
        self.factors = mix(steps[:COORDINATES] + np.uint64(1 << 20)) | np.uint64(1)

    def sets_of(self, texts):
        """The distinct shingles, sorted, of each text of an Arrow array: one array for each; the words of a few MB at a time."""
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in tokens.small_batches(pa.record_batch([texts], names=["t"]), 0):
            words, ends = tokens.words_of(batch.column(0))
            different, at = tokens.numbered(words)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in different.to_pylist()), np.uint64, len(different))[at]
            start = 0
            for end in ends.tolist():
                yield self._set(hashes[start:end])
                start = end

    def set_of(self, text: str | None):
        import pyarrow as pa

        return next(self.sets_of(pa.array([text], pa.string())))

    def _set(self, h):
        import numpy as np

        n = len(h)
        if n == 0:
            return h
        if n < SIZE:
            return mix((h * self.powers[:n]).sum(keepdims=True) + np.uint64(n))
        s = h[: n - SIZE + 1] * self.powers[0]
        for k in range(1, SIZE):
            s = s + h[k : n - SIZE + 1 + k] * self.powers[k]
        return np.unique(mix(s))

    def minima(self, shingles):
        """The least value of the set under each of COORDINATES hash functions, 32 bits each."""
        import numpy as np

        least = np.full(COORDINATES, (1 << 64) - 1, dtype=np.uint64)
        for i in range(0, len(shingles), 1024):
            np.minimum(least, (shingles[i : i + 1024, None] * self.factors).min(axis=0), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)


_SHINGLERS: list[Shingler] = []


def shingler() -> Shingler:
    if not _SHINGLERS:
        _SHINGLERS.append(Shingler())
    return _SHINGLERS[0]
