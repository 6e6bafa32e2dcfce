"""N-gram Jaccard join by chosen paths, with exact links.

1. Every text becomes its set of word shingles, a fingerprint of the set and 64 minima.  Equal sets form a class; the
   classes go on, with the number of their documents.
2. Chosen paths: each run starts at a root; at a node one coordinate (with probability a quarter two) is sampled by a
   hash of the node, and sets go to the bucket of their value there.  For sets of similarity J this keeps each
   expected number of shared branches at 1.25 J, so pairs of 0.8 survive a split with a bounded probability and
   less similar ones die out.  Buckets of at most ``LIMIT`` sets are compared in full.  Larger ones are compared with
   one of their sets.  The links of all of them, over all runs, give components; in each bucket the sets of its most
   common component, which need no comparison with each other, are compared with all others, in blocks, and the others
   among themselves.  Where that component is less than half of the bucket, or this would write more than ``SPREAD``
   times the bucket's rows, the sets nearly equal to the one set retire and the rest is split again, ``DEPTH`` times at
   most; then it is compared all the same.  Runs are repeated until the computed recall of
   a pair of just the threshold similarity, in large buckets to the end, is at least ``recall``; all runs sample the
   same 64 minima, so it is averaged over how many of them agree.
3. Comparing means counting agreeing minima with a margin of almost five standard deviations.  A bucket gives a
   spanning forest of what it linked, never all its pairs; connected components of the forests are candidate groups.
4. Exact check: the whole shingle sets of each candidate group are intersected, in pairs of blocks of at most
   ``BLOCK`` sets, inside tasks; out of a task come each set's number of links and a forest.  No pair of documents is
   written, whatever the size of the groups.

Result: one row per document: doc_id, class_id (the smallest identifier reachable by links), n_links (other documents of
similarity at or above the threshold, copies included), kept (one document of each group).

Defined results: a null or empty text has no shingles, is in no group and is kept; null identifiers are in groups like others but
never name one unless all are null; repeated rows link to each other, and ``kept`` holds for each copy of a repeated
row that is kept (``first_of_groups`` keeps one); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles, store, tokens
from .components import components

LIMIT, DEPTH, BLOCK = 1000, 5, 128
#: Rows that comparing a large bucket's known component with its other sets may write, as a multiple of its own.
SPREAD = 4
#: Agreeing minima of 64 that make a candidate (at similarity 0.8: 51.2 expected, 3.2 the deviation), and that retire a set.
CANDIDATE, RETIRE = 36, 58
#: Classes in candidate groups (some 100 bytes each) up to which the list of them is broadcast to where the texts lie;
#: beyond, texts are shuffled.
MOST_BROADCAST = 200_000


def survival(similarity: float, depth: int) -> float:
    """Probability that a pair still shares a bucket after ``depth`` splits of one run."""
    q = 1.0
    for _ in range(depth):
        miss = 1 - similarity * q
        q = 1 - (0.75 * miss + 0.25 * miss * miss)
    return q


def recall_of(runs: int, similarity: float, splits: int) -> float:
    """Probability that a pair shares a bucket after ``splits`` splits in one of ``runs`` runs, which all sample the same minima."""
    n, found = shingles.COORDINATES, 0.0
    for agree in range(n + 1):
        chance = math.comb(n, agree) * similarity**agree * (1 - similarity) ** (n - agree)
        found += chance * (1 - (1 - survival(agree / n, splits)) ** runs)
    return found


def runs_for(recall: float, similarity: float, splits: int | None = None) -> int:
    """Runs for pairs that stay in large buckets to the last split (DEPTH + 1 splits: one at the roots)."""
    splits, runs = DEPTH + 1 if splits is None else splits, 1
    while recall_of(runs, similarity, splits) < recall:
        runs += 1
    return runs


def _picks(paths):
    """The coordinates that the nodes of ``paths`` sample: one each, and a second or -1."""
    import numpy as np

    r = shingles.mix(paths + np.uint64(0x1234567))
    n = np.uint64(shingles.COORDINATES)
    first, second = (r % n).astype(np.int64), ((r >> np.uint64(20)) % n).astype(np.int64)
    return first, np.where(((r >> np.uint64(40)) % np.uint64(4) == 0) & (second != first), second, -1)


def _split(batch, runs: int | None):
    """(path, c) of every branch: from the roots of all runs, or from each row's own path."""
    import numpy as np
    import pyarrow as pa

    c = batch.column(batch.schema.get_field_index("c")).to_numpy(zero_copy_only=False)
    sig = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("sig")).to_pylist()), dtype=np.uint32).reshape(len(c), -1)
    out_p, out_c = [], []
    if runs is None:
        starts = [batch.column(batch.schema.get_field_index("path")).to_numpy(zero_copy_only=False).view(np.uint64)]
    else:
        starts = [np.full(len(c), int(shingles.mix(np.array([r + 1], dtype=np.uint64))[0]), dtype=np.uint64) for r in range(runs)]
    rows = np.arange(len(c))
    for at in starts:
        for pick in _picks(at):
            ok = pick >= 0
            value = sig[rows[ok], pick[ok]].astype(np.uint64)
            out_p.append(shingles.mix(at[ok] ^ shingles.mix((pick[ok].astype(np.uint64) << np.uint64(32)) + value + np.uint64(1))).view(np.int64))
            out_c.append(c[ok])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_p)), pa.array(np.concatenate(out_c))], names=["path", "c"])


def forest(n: int, left, right) -> list[int]:
    """The root of each of ``n`` nodes, from pairs (arrays of indices); a root is the smallest node of its tree."""
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(left, right):
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def groups_of(batches, key: int):
    """Lists of rows that share the column ``key``, from batches sorted by it; a group may span batches."""
    held, last = [], None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[key] != last and held:
                yield held
                held = []
            last = row[key]
            held.append(row)
    if held:
        yield held


def _link_buckets(batches):
    """Forests of the buckets (path, c, sig, known; sorted by path): u, v.  The ``known`` sets of a bucket are in one tree already."""
    import numpy as np
    import pyarrow as pa

    us, vs = [], []
    for rows in groups_of(batches, 0):
        if len(rows) < 2:
            continue
        rows.sort(key=lambda r: (not r[3], r[1]))  # a tree's root is its smallest class, in every bucket and run; the known tree comes first
        sig = np.frombuffer(b"".join([r[2] for r in rows]), dtype=np.uint32).reshape(len(rows), -1)
        known = sum(r[3] for r in rows)
        root = np.arange(len(rows))
        root[:known] = 0
        for i in range(max(1, known), len(rows)):
            trees = np.unique(root[:i][(sig[:i] == sig[i]).sum(axis=1) >= CANDIDATE])
            if len(trees):
                root[i] = trees[0]
            if len(trees) > 1:
                root[:i][np.isin(root[:i], trees)] = trees[0]
        for i, r in enumerate(root.tolist()):
            if r != i and i >= known:
                us.append(rows[i][1])
                vs.append(rows[r][1])
        if len(us) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
            us, vs = [], []
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _compare(batches):
    """Agreement of each row's minima with its bucket's leader: path, c, sig, leader, agree."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        sig, lead = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1) for k in (2, 4))
        agree = (sig == lead).sum(axis=1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(agree)], names=["path", "c", "sig", "leader", "agree"])


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th (hash of the text), fp (of the set; null if empty), n, sig."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        own = shingles.shingler()
        for batch in batches:
            fps, ns, sigs = [], [], []
            for s in own.sets_of(batch.column(2)):
                ns.append(len(s))
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(own.minima(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary()), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "th", "fp", "n", "sig"])
        tokens.tidy()

    text = store.column(text_col).cast("string")
    return docs.select(store.column(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id long, th long, fp binary, n long, sig binary")


def candidate_edges(classes: DataFrame, runs: int) -> DataFrame:
    """Forests (u, v) over classes (c, sig) of all buckets of all runs."""
    spark = classes.sparkSession
    near = []

    def roots(batches):
        for batch in batches:
            yield _split(batch, runs)

    def further(batches):
        for batch in batches:
            if batch.num_rows:
                yield _split(batch, None)

    def buckets(paths: DataFrame):
        """Rows (path, c, sig) of buckets of two or more, the small and the large ones."""
        sizes = store.written(spark, paths.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        rows = store.written(spark, paths.join(sizes, "path").join(classes, "c").select("path", "c", "sig", "size"), "buckets")
        return rows.where(F.col("size") <= LIMIT).select("path", "c", "sig"), rows.where(F.col("size") > LIMIT)

    def linked(rows: DataFrame) -> DataFrame:
        return rows.repartition("path").sortWithinPartitions("path").mapInArrow(_link_buckets, "u long, v long")

    def shapes(placed: DataFrame) -> DataFrame:
        """Per large bucket: its most common component, the blocks of its sets and of the others, and whether comparing them ends it."""
        parts = placed.groupBy("path", "component").agg(F.count("*").alias("n")).groupBy("path")
        parts = parts.agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("size"))
        ins, out = F.col("most.n"), F.col("size") - F.col("most.n")
        parts = parts.withColumn("ins", F.ceil(ins / LIMIT)).withColumn("outs", F.ceil(out / LIMIT))
        written = ins * F.col("outs") + out * (F.col("ins") + F.col("outs") - 1)
        return parts.select("path", F.col("most.component").alias("common"), "ins", "outs", ((ins >= out) & (written <= SPREAD * F.col("size"))).alias("ends"))

    def crossed(placed: DataFrame) -> DataFrame:
        """The sets of a bucket's common component, in blocks, with each block of the others; these with each other too."""
        known = F.col("component") == F.col("common")
        own = placed.where("outs > 0").withColumn("known", known).withColumn("i", F.pmod(F.xxhash64("c", "path"), F.when(known, F.col("ins")).otherwise(F.col("outs"))))
        to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        with_others = F.transform(to("outs"), lambda j: F.xxhash64("path", F.lit(0), "i", j))
        with_known = F.transform(to("ins"), lambda j: F.xxhash64("path", F.lit(0), j, "i"))
        among = F.transform(F.filter(to("outs"), lambda j: j != F.col("i")), lambda j: F.xxhash64("path", F.lit(1), F.least("i", j), F.greatest("i", j)))
        return own.select(F.explode(F.when(F.col("known"), with_others).otherwise(F.concat(with_known, among))).alias("path"), "c", "sig", "known")

    def merged(stars: DataFrame, new: DataFrame) -> DataFrame:
        """Components (u, v: the smallest set) of ``stars``, which are components, and the links ``new``."""
        ends = new.join(stars.toDF("u", "a"), "u", "left").join(stars.toDF("v", "b"), "v", "left")
        ends = ends.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")).where("u <> v").distinct()
        ends = store.written(spark, ends, "merges")
        return store.written(spark, components(stars.union(ends)).toDF("u", "v"), "stars") if ends.take(1) else stars

    paths, stars = store.written(spark, classes.mapInArrow(roots, "path long, c long"), "paths"), classes.select(F.col("c").alias("u"), F.col("c").alias("v")).where("false")
    for depth in range(DEPTH + 1):
        small, large = buckets(paths)
        near.append(linked(small.withColumn("known", F.lit(False))))
        if not large.take(1):
            break
        leaders = large.groupBy("path").agg(F.min_by(F.struct("c", "sig"), F.xxhash64("c")).alias("l"))
        leaders = store.written(spark, leaders.select("path", F.col("l.c").alias("leader"), F.col("l.sig").alias("lead_sig")), "leaders")
        seen = large.join(leaders, "path").select("path", "c", "sig", "leader", "lead_sig").mapInArrow(_compare, "path long, c long, sig binary, leader long, agree int")
        seen = store.written(spark, seen, "compared")
        new = seen.where((F.col("agree") >= CANDIDATE) & (F.col("c") != F.col("leader"))).select(F.col("c").alias("u"), F.col("leader").alias("v"))
        stars = merged(stars, new)
        placed = seen.join(stars.withColumnRenamed("u", "c"), "c", "left").select("path", "c", "sig", "agree", F.coalesce("v", "c").alias("component"))
        placed = store.written(spark, placed, "placed")
        shape = store.written(spark, shapes(placed), "shapes")
        placed = placed.join(shape, "path")
        if depth == DEPTH:
            near.append(linked(crossed(placed)))
            break
        if shape.where("ends").take(1):
            near.append(linked(crossed(placed.where("ends"))))
        further_on = placed.where(~F.col("ends") & (F.col("agree") < RETIRE)).select("path", "c", "sig")
        paths = store.written(spark, further_on.mapInArrow(further, "path long, c long"), "paths")
    near.append(stars)
    edges = near[0]
    for e in near[1:]:
        edges = edges.union(e)
    return edges.where("u <> v")


def _exact(threshold: tuple[int, int]):
    """Links of the groups (key, side, c, copies, set; sorted by key): c, links, root."""
    num, den = threshold

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for rows in groups_of(batches, 0):
            rows.sort(key=lambda r: r[2])
            sets = [np.frombuffer(r[4], dtype=np.uint64) for r in rows]
            n, m = np.array([len(s) for s in sets]), len(rows)
            values, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            owner, shared = np.repeat(np.arange(m), n), df > 1  # what one set alone has is in no intersection
            place = np.cumsum(shared) - 1
            keep = shared[column]
            owner, column, width = owner[keep], place[column[keep]], int(shared.sum())
            common = np.zeros((m, m), dtype=np.float32)  # counts below 2 ** 24 are whole
            order = np.argsort(column, kind="stable")
            owner, column = owner[order], column[order]
            for a in range(0, width, 4096):
                i, j = np.searchsorted(column, [a, a + 4096])
                dense = np.zeros((m, min(4096, width - a)), dtype=np.float32)
                dense[owner[i:j], column[i:j] - a] = 1
                common += dense @ dense.T
            inter = common.astype(np.int64)
            link = den * inter >= num * (n[:, None] + n[None, :] - inter)
            np.fill_diagonal(link, False)
            side = np.array([r[1] for r in rows])
            if (side != side[0]).any():  # two blocks: pairs inside a block belong to another group
                link &= side[:, None] != side[None, :]
            links = link @ np.array([r[3] for r in rows], dtype=np.int64)
            left, right = np.nonzero(np.triu(link))
            c = np.array([r[2] for r in rows], dtype=np.int64)
            root = c[forest(m, left.tolist(), right.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(links.astype(np.int64)), pa.array(root)], names=["c", "links", "root"])

    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (4, 5), recall: float = 0.9995) -> DataFrame:
    """doc_id, class_id, n_links, kept of every document; ``threshold`` is a fraction, 4/5 by default."""
    spark = docs.sparkSession
    store.importable(spark)
    signed = store.written(spark, signatures(docs, id_col, text_col), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "th")
    classes = signed.where("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("copies"), F.min(first).alias("rep"), F.any_value("sig").alias("sig"))
    classes = store.written(spark, classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    near = components(candidate_edges(classes.select("c", "sig"), runs_for(recall, threshold[0] / threshold[1])))
    near = store.written(spark, near, "candidates")
    blocks = near.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = near.join(blocks, "component").join(classes.withColumnRenamed("c", "node"), "node")
    members = store.written(spark, members.select(F.col("node").alias("c"), "component", "blocks", "copies", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"), "fp"), "members")

    def whole_sets(batches):
        import hashlib

        import pyarrow as pa

        own = shingles.shingler()
        for batch in batches:
            sets = [s.tobytes() for s in own.sets_of(batch.column(5))]
            keep = [hashlib.blake2b(s, digest_size=16).digest() == fp for s, fp in zip(sets, batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], names=["c", "component", "blocks", "copies", "set"]).filter(pa.array(keep))
        tokens.tidy()

    text = store.column(text_col).cast("string")
    texts = docs.select(store.column(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    listed = F.broadcast(members) if members.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else members
    found = listed.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h"))).select("c", "component", "blocks", "copies", "fp", "text")
    sets = found.mapInArrow(whole_sets, "c long, component long, blocks long, copies long, set binary")
    sets = sets.withColumn("side", F.pmod(F.xxhash64("c"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = sets.select(F.struct("component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")).alias("k"), "side", "c", "copies", "set")
    keyed = keyed.groupBy("k", "side", "c").agg(F.any_value("copies").alias("copies"), F.any_value("set").alias("set"))  # a repeated row of the table gives its set once
    keyed = keyed.select(F.concat_ws(":", "k.component", "k.i", "k.j").alias("key"), "side", "c", "copies", "set")
    exact = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_exact(threshold), "c long, links long, root long")
    exact = store.written(spark, exact, "links")
    linked = components(exact.select(F.col("c").alias("u"), F.col("root").alias("v")))
    links = exact.groupBy("c").agg(F.sum("links").alias("links"))
    named = classes.select("c", "fp", "copies", "rep").join(links, "c", "left").join(linked.withColumnRenamed("node", "c"), "c", "left")
    named = store.written(spark, named.withColumn("component", F.coalesce("component", "c")), "named")
    tops = named.groupBy("component").agg(F.min("rep").alias("top"))
    named = store.written(spark, named.join(tops, "component").select("fp", "top", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    out = signed.select("doc_id", "th", "fp").join(named, "fp", "left")
    is_top = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("th") == F.col("top.th"))
    return out.select(
        "doc_id", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("fp").isNull() | is_top).alias("kept"), F.col("th").alias("text_hash"),
    )


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those whose group has an earlier one: one of each group stays, with all its columns."""
    verdicts = jaccard_join(docs, id_col, text_col, **options)
    kept = verdicts.where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).agg((F.count("*") > 1).alias("_repeated"))
    kept = store.written(docs.sparkSession, kept, "kept")
    names = [f"k{i}" for i in range(len(docs.columns))]
    text = store.column(text_col).cast("string")
    marked = docs.select(F.xxhash64(text).alias("th"), store.column(id_col).cast("long").alias("own"), *[store.column(c).alias(k) for c, k in zip(docs.columns, names)])
    rows = marked.join(kept, F.col("own").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_h")))
    once = rows.where("_repeated").dropDuplicates(["own", "th"])  # repeated rows only: one of them stays
    rows = rows.where("NOT _repeated").union(once)
    return rows.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, names)])
