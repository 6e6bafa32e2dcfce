"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text, in four groups of unit length each: words, pairs of neighbouring words, word shapes and pairs of
shapes (a shape has the kinds of the word's characters, runs of one kind reduced to one), every one hashed into
``2 ** BITS`` places, weighted by ``log(1 + count)``.  A score is the sparse dot product with the weights, squashed.

Training reads a bounded sample of the labelled documents: the ``sample`` of smallest identifier hash.  One task trains
on it in that order and returns the weights, whose size is fixed; scoring takes them as a broadcast value and runs over
every whole text where it lies, without a shuffle.

Defined results: a null or empty text has no features and gets the score of the bias; a null identifier is scored and
counts as not held out; of several labels of a document the largest counts, null labels none; without labels every
score is 0.5; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, tokens

#: Hash bits, documents in the training sample, epochs, rates and penalties.
BITS = 18
SAMPLE = 8_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
THRESHOLD = 0.7


def _kinds():
    """For each byte of a text its kind: capital, small letter (all of other scripts' bytes too), digit, or itself."""
    import numpy as np

    kinds = np.arange(256, dtype=np.uint8)
    kinds[ord("A") : ord("Z") + 1], kinds[ord("a") : ord("z") + 1], kinds[ord("0") : ord("9") + 1], kinds[128:] = ord("A"), ord("a"), ord("9"), ord("a")
    return kinds


def shapes(words):
    """The shape of each word of an Arrow array: its bytes' kinds, runs of one kind reduced to one, the first eight, as a number."""
    import numpy as np

    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if len(words) and ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends = ends - ends[0]
    kind, new = _kinds()[data], np.ones(len(data) + 1, dtype=bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[ends] = True
    upto = np.cumsum(new[:-1], dtype=np.int64)
    place = upto - 1 - np.repeat(np.concatenate(([0], upto))[ends[:-1]], np.diff(ends))
    taken = new[:-1] & (place < 8)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(taken, kind.astype(np.uint64) << (np.uint64(8) * np.minimum(place, 7).astype(np.uint64)), np.uint64(0)), dtype=np.uint64)))
    return total[ends[1:]] - total[ends[:-1]]  # sums modulo 2 ** 64 of disjoint bytes


def features(texts):
    """For each text of an Arrow array: places (int32, distinct within a group) and values (float32); a few MB of texts at a time."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    mix = np.uint64(0x9E3779B97F4A7C15)
    for batch in tokens.small_batches(pa.record_batch([texts], names=["t"]), 0):
        words, ends = tokens.words_of(batch.column(0))
        different, at = tokens.numbered(words)
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in different.to_pylist()), np.uint64, len(different))
        s = (shapes(different) * mix) >> np.uint64(48)
        all_h, all_s, start = h[at], s[at], 0
        for end in ends.tolist():
            h, s, start = all_h[start:end], all_s[start:end], end
            if not len(h):
                yield np.empty(0, np.int32), np.empty(0, np.float32)
                continue
            groups = [h, s + np.uint64(1)]
            if len(h) > 1:
                same = (h[1:] == h[:-1]).astype(np.uint64)
                groups += [h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:], (s[:-1] << np.uint64(20)) + (s[1:] << np.uint64(3)) + same + np.uint64(1 << 40)]
            places, values = [], []
            for k, g in enumerate(groups):
                p, n = np.unique(((g ^ np.uint64(k * 0x5851F42D4C957F2D & (1 << 64) - 1)) * mix) >> np.uint64(64 - BITS), return_counts=True)
                v = np.log1p(n)
                places.append(p.astype(np.int32))
                values.append((v / np.sqrt(v @ v)).astype(np.float32))
            yield np.concatenate(places), np.concatenate(values)


def example(places, values):
    """One training example: the groups' values added up by place, and the bias."""
    import numpy as np

    i, back = np.unique(np.append(places, np.int32(1 << BITS)), return_inverse=True)
    return i, np.bincount(back, np.append(values, 1.0)).astype(np.float32)


def score_of(weights, places, values) -> float:
    import numpy as np

    return float(1 / (1 + np.exp(-np.clip(weights[places] @ values + weights[-1], -35, 35))))


def train(examples, epochs: int = EPOCHS):
    """Weights (the last is the bias) from (*example, label 0 or 1), by FTRL-proximal updates in the given order."""
    import numpy as np

    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for i, x, label in examples:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            n_new = n[i] + g * g
            z[i] += g - (np.sqrt(n_new) - np.sqrt(n[i])) / ALPHA * w
            n[i] = n_new
    return weights(np.arange(size)).astype(np.float32)


def remainder(id_col: str) -> Column:
    """crc32 of the identifier as text, modulo 4."""
    return F.crc32(F.coalesce(store.column(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> bytes:
    """Weights as 32-bit floats, from at most ``sample`` labelled documents outside the held-out quarter."""
    store.importable(docs.sparkSession)
    known = labels.where(store.column(label_col).isNotNull() & store.column(id_col).isNotNull() & (remainder(id_col) != 2)).groupBy(store.column(id_col).alias("doc_id")).agg(F.max(store.column(label_col)).cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = F.broadcast(known.orderBy(order, "doc_id").limit(sample))  # at most ``sample`` rows of two numbers
    rows = docs.select(store.column(id_col).alias("doc_id"), store.column(text_col).cast("string").alias("text")).join(chosen, "doc_id")
    bounded = rows.withColumn("o", order).orderBy("o", "doc_id", F.xxhash64("text")).limit(sample)  # repeated rows of a document count too

    def fit(batches):
        import pyarrow as pa

        examples = []
        for batch in batches:
            numbers = zip(*(batch.column(c).to_pylist() for c in ("o", "doc_id", "label")))
            examples += [(*row, *example(p, v)) for row, (p, v) in zip(numbers, features(batch.column("text")))]
        examples.sort(key=lambda e: e[:3])
        if examples:
            yield pa.RecordBatch.from_arrays([pa.array([train([(i, x, label) for _, _, label, i, x in examples]).tobytes()], pa.binary())], names=["weights"])
        tokens.tidy()

    got = bounded.select("o", "doc_id", "text", "label").repartition(1).mapInArrow(fit, "weights binary").collect()
    return got[0].weights if got else bytes(4 * ((1 << BITS) + 1))


def scored(docs: DataFrame, weights: bytes, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The identifier (or the columns of ``carry``) and the score of every document."""
    spark = docs.sparkSession
    store.importable(spark)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w = np.frombuffer(shared.value, dtype=np.float32).astype(np.float64)
        for batch in batches:
            out = [score_of(w, p, v) for p, v in features(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.float64())], names=[*batch.schema.names[1:], "score"])
        tokens.tidy()

    carry = carry or [id_col]
    names = [f"k{i}" for i in range(len(carry))]
    chosen = docs.select(store.column(text_col).cast("string").alias("text"), *[store.column(c).alias(k) for c, k in zip(carry, names)])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(run, f"{fields}, score double").toDF(*carry, "score")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = scored(docs, fitted(docs, labels))
    return rows.select("doc_id", (remainder("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that the classifier predicts to be good."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fitted(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w = np.frombuffer(shared.value, dtype=np.float32).astype(np.float64)
        for batch in batches:
            good = [score_of(w, p, v) >= THRESHOLD for p, v in features(batch.column(at).cast(pa.string()))]
            yield batch.filter(pa.array(good, pa.bool_()))
        tokens.tidy()

    named = docs.toDF(*[f"k{i}" for i in range(len(docs.columns))])  # names with dots can't go through as they are
    return named.mapInArrow(run, named.schema).toDF(*docs.columns)
