"""Embedding near-dedup by NN-descent.

Vectors of one label, brought to unit length, get neighbour lists.  The lists start from random-hyperplane trees and are
refined: each vector hands its neighbours, and those that have it as a neighbour, to each other; the ``K`` best of
each list stay.  The rounds end once hardly an entry at the threshold is new, or after ``ROUNDS``.  The edges at the threshold stay and join vectors into groups, each of which is compared in full in pairs of
blocks inside tasks; what leaves a task is each vector's number of links and a spanning forest, never all pairs.
A list whose entries are all at the threshold is saturated, more may follow, also outside its group: groups with such
a list are covered by balls, and every vector of the space that the triangle inequality lets link with a ball is
compared with all its members.
Recall is audited against brute force: the vectors whose identifier is divisible by ``AUDIT`` are compared with all rows
in blocks.  Recall is the mean over those that have links to other vectors than their copies, by space, and while it is too low, the search starts again with more
trees.  Spaces that still fall short after ``ATTEMPTS`` searches are compared in full, exactly.

Equal vectors of a label are one node with a count, so copies cost nothing.  The search uses 32-bit floats; links are
decided by cosine in double precision.

Defined results: null labels, null or zero vectors and vectors with null or non-finite components link with nothing;
vectors link only with those of their length; null identifiers are linked but name a component only if all of it are
null; repeated rows link to each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .chosen_path import forest, groups_of
from .components import components

#: List length, trees of the first search, leaf size, most rounds, block of a group, audit and recall asked for.
K, TREES, LEAF, ROUNDS, BLOCK = 12, 8, 48, 8, 512
#: The rounds end when one changes no more than this part of the entries near the threshold.
CHANGED = 0.001
AUDIT, RECALL, ATTEMPTS = 50, 0.999, 3
#: The search's threshold is lower by this much, for its 32-bit floats.
SLACK = 1e-4
#: Bytes of vectors that are broadcast at once.
CHUNK = 1 << 24


def _unit(vector):
    """The vector at unit length in double precision, or None if it can't link."""
    import numpy as np

    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, dtype=np.float64)
    most = np.abs(v).max()
    if not np.isfinite(most) or most == 0:
        return None
    v = v / most + 0.0
    return v / np.sqrt(v @ v)


def rows_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, space (label and length), fp (of space and direction; null if it can't link), v (unit, doubles)."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            spaces, fps, vs = [], [], []
            for label, vector in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                v = _unit(vector) if label is not None else None
                space = None if v is None else f"{len(v)}:{label}"
                data = None if v is None else v.tobytes()
                spaces.append(space)
                vs.append(data)
                fps.append(None if v is None else hashlib.blake2b(data, digest_size=16, key=hashlib.blake2b(space.encode(), digest_size=32).digest()).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spaces, pa.string()), pa.array(fps, pa.binary()), pa.array(vs, pa.binary())], names=["vec_id", "space", "fp", "v"])

    chosen = vectors.select(store.column(id_col).cast("long").alias("vec_id"), store.column(label_col).cast("string").alias("label"), store.column(vector_col).cast("array<double>").alias("vector"))
    return chosen.mapInArrow(run, "vec_id long, space string, fp binary, v binary")


def _edges_batch(a, b, sim):
    import numpy as np
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(sim))], names=["a", "b", "sim"])


def _join_groups(batches, most: int):
    """Groups (key, c, v, floor; sorted by key): the pairs of a group whose similarity is over the floor of the first."""
    import numpy as np

    out_a, out_b, out_s, size = [], [], [], 0
    for rows in groups_of(batches, 0):
        if len(rows) < 2:
            continue
        c = np.array([r[1] for r in rows], dtype=np.int64)
        v = np.frombuffer(b"".join([r[2] for r in rows]), dtype=np.float64).reshape(len(rows), -1).astype(np.float32)
        floor = np.array([r[3] for r in rows], dtype=np.float32)
        sim = v @ v.T
        np.fill_diagonal(sim, -2)
        if len(rows) > most + 1:  # no more of a row than a list holds
            floor = np.maximum(floor, np.partition(sim, -most, axis=1)[:, -most] - np.float32(1e-7))
        i, j = np.nonzero(sim > floor[:, None])
        out_a.append(c[i])
        out_b.append(c[j])
        out_s.append(sim[i, j])
        size += len(i)
        if size > 100_000:
            yield _edges_batch(out_a, out_b, out_s)
            out_a, out_b, out_s, size = [], [], [], 0
    if size:
        yield _edges_batch(out_a, out_b, out_s)


def _joined(groups: DataFrame, most: int) -> DataFrame:
    """``groups``: key, c, v, floor."""

    def run(batches):
        yield from _join_groups(batches, most)

    return groups.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, sim float")


def _best(edges: DataFrame) -> DataFrame:
    """The K best of each list."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return edges.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("rank", rank).where(F.col("rank") <= K).drop("rank")


def _planted(nodes: DataFrame, trees: int) -> DataFrame:
    """First lists, from trees of random hyperplanes: a leaf's vectors are compared with each other."""
    spark = nodes.sparkSession
    depths = nodes.groupBy("space").agg(F.ceil(F.log2(F.count("*") / LEAF)).alias("depth"))

    def leaves(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            out = []
            for c, space, v, depth in rows:
                v64 = np.frombuffer(v, dtype=np.float64)
                depth = max(0, min(int(depth), 40))
                planes = _planes(len(v64), trees)
                bits = (planes @ v64 > 0).reshape(trees, -1)[:, :depth]
                out += [(f"{space}:{t}:{bits[t].tobytes().hex()}", c, v, -2.0) for t in range(trees)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.string(), pa.int64(), pa.binary(), pa.float32()))], names=["key", "c", "v", "floor"])

    rows = nodes.join(depths, "space").select("c", "space", "v", "depth").mapInArrow(leaves, "key string, c long, v binary, floor float")
    rows = store.written(spark, rows, "leaves")
    sizes = store.written(spark, rows.groupBy("key").agg(F.ceil(F.count("*") / (4 * LEAF)).alias("parts")).where("parts > 1"), "leaf-sizes")
    # a leaf that did not split, of near copies, is compared in parts; refinement joins the parts
    parts = rows.join(sizes, "key", "left").withColumn("key", F.xxhash64("key", F.pmod(F.xxhash64("c", "key"), F.coalesce("parts", F.lit(1)))))
    return _best(_joined(parts.select("key", "c", "v", "floor"), K // 2))


_PLANES: dict[tuple[int, int], object] = {}


def _planes(length: int, trees: int):
    import numpy as np

    if (length, trees) not in _PLANES:
        _PLANES[length, trees] = np.random.default_rng(7).standard_normal((trees * 40, length))
    return _PLANES[length, trees]


def _refined(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """One round: the neighbours of each vector, either way, are compared with each other."""
    floors = lists.groupBy("a").agg(F.when(F.count("*") >= K, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("floor"))
    about = nodes.select("c", "v").join(floors, F.col("c") == F.col("a"), "left").select(F.col("c").alias("u"), "v", F.coalesce("floor", F.lit(-2.0)).cast("float").alias("floor"))
    both = lists.select("a", "b").union(lists.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    # a vector that very many have as a neighbour hands them on in parts
    sizes = both.groupBy("a").agg(F.ceil(F.count("*") / (8 * K)).alias("parts")).withColumnRenamed("a", "at")
    members = both.join(sizes, F.col("a") == F.col("at")).select(F.xxhash64("a", F.pmod(F.xxhash64("b"), "parts")).alias("key"), F.col("b").alias("u"))
    found = _joined(members.join(about, "u").select("key", F.col("u").alias("c"), "v", "floor"), K)
    return _best(lists.union(found))


def _changed(before: DataFrame, after: DataFrame, least: float) -> float:
    """The part of the entries of at least this similarity that a round brought in."""
    close = F.col("sim") >= least
    old = before.where(close).select("a", "b", F.lit(True).alias("old"))
    found = after.where(close).select("a", "b").join(old, ["a", "b"], "left").agg(F.count("*").alias("n"), F.count_if(F.col("old").isNull()).alias("new")).first()
    return found.new / max(found.n, 1)


def _linked(threshold: float):
    """Links of the groups (key, side, c, copies, v; sorted by key): c, links, root."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for rows in groups_of(batches, 0):
            v = np.frombuffer(b"".join([r[4] for r in rows]), dtype=np.float64).reshape(len(rows), -1)
            link = v @ v.T >= threshold
            np.fill_diagonal(link, False)
            side = np.array([r[1] for r in rows])
            if (side != side[0]).any():
                link &= side[:, None] != side[None, :]
            links = link @ np.array([r[3] for r in rows], dtype=np.int64)
            left, right = np.nonzero(np.triu(link))
            c = np.array([r[2] for r in rows], dtype=np.int64)
            root = c[forest(len(rows), left.tolist(), right.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(links.astype(np.int64)), pa.array(root)], names=["c", "links", "root"])

    return run


def _balls(threshold: float):
    """Balls that cover the groups (key, c, v; sorted by key): c, ball (its centre's c), radius (an angle)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for rows in groups_of(batches, 0):
            c = np.array([r[1] for r in rows], dtype=np.int64)
            v = np.frombuffer(b"".join([r[2] for r in rows]), dtype=np.float64).reshape(len(rows), -1)
            ball, radius, left = np.empty_like(c), np.empty(len(c)), np.arange(len(c))
            while len(left):
                sim = v[left] @ v[left[0]]
                near = sim >= threshold
                near[0] = True
                ball[left[near]] = c[left[0]]
                radius[left[near]] = np.arccos(np.clip(sim[near].min(), -1, 1)) + 1e-6
                left = left[~near]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(ball), pa.array(radius)], names=["c", "ball", "radius"])

    return run


def _chunks(table: DataFrame):
    """The rows of ``table`` (with c and v), on the driver, about CHUNK bytes of vectors at a time."""
    parts = -(-(table.agg(F.sum(F.octet_length("v"))).first()[0] or 0) // CHUNK)
    for i in range(parts):
        yield table.where(F.pmod(F.xxhash64("c", F.lit(2)), F.lit(parts)) == i).collect()


def _across(placed: DataFrame, threshold: float) -> DataFrame | None:
    """Links between each full group and all other vectors (placed: c, space, copies, v, component, full): c, links, root."""
    spark = placed.sparkSession
    own = placed.where("full").select("component", "c", "v")
    blocks = own.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    keyed = own.join(blocks, "component").select(F.concat_ws(":", "component", F.pmod(F.xxhash64("c"), "blocks")).alias("key"), "c", "v")
    balls = store.written(spark, keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_balls(threshold), "c long, ball long, radius double"), "balls")
    centres = store.written(spark, balls.where("c = ball").join(placed, "c").select("c", "space", "component", "radius", "v"), "centres")
    pairs = []
    for chunk in _chunks(centres):
        spaces: dict[str, list] = {}
        for r in chunk:
            spaces.setdefault(r.space, []).append((r.c, r.component, r.radius, bytes(r.v)))
        shared = spark.sparkContext.broadcast(spaces)

        def run(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            known: dict[str, tuple] = {}
            for batch in batches:
                by_space: dict[str, list] = {}
                for row in zip(*(x.to_pylist() for x in batch.columns)):
                    if row[0] in shared.value:
                        by_space.setdefault(row[0], []).append(row)
                for space, rows in by_space.items():
                    if space not in known:
                        ball, group, radius, v = zip(*shared.value[space])
                        bound = np.cos(np.minimum(np.array(radius) + np.arccos(threshold), np.pi)) - 1e-9
                        known[space] = np.array(ball), np.array(group), bound, np.frombuffer(b"".join(v), dtype=np.float64).reshape(len(v), -1)
                    ball, group, bound, centre = known[space]
                    for a in range(0, len(rows), 256):
                        _, c, component, full, v = zip(*rows[a : a + 256])
                        x = np.frombuffer(b"".join(v), dtype=np.float64).reshape(len(v), -1)
                        component, full = np.array(component)[:, None], np.array(full)[:, None]
                        # of two full groups the one with the smaller number asks
                        i, j = np.nonzero((x @ centre.T >= bound) & (component != group) & ~(full & (component < group)))
                        yield pa.RecordBatch.from_arrays([pa.array(ball[j]), pa.array(np.array(c)[i])], names=["ball", "c"])

        found = placed.select("space", "c", "component", "full", "v").mapInArrow(run, "ball long, c long")
        pairs.append(store.written(spark, found, "near-balls"))
    if not pairs:
        return None
    found = pairs[0]
    for more in pairs[1:]:
        found = found.union(more)
    blocks = found.groupBy("ball").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    asked = store.written(spark, found.join(blocks, "ball").select("ball", "c", F.pmod(F.xxhash64("c"), "blocks").alias("block")), "asked")
    members = balls.select("ball", "c").join(asked.select("ball", "block").distinct(), "ball").withColumn("side", F.lit(0).cast("long"))
    both = members.union(asked.select("ball", "c", "block", F.lit(1).cast("long").alias("side")).select("ball", "c", "block", "side"))
    keyed = both.join(placed.select("c", "copies", "v"), "c").select(F.concat_ws(":", "ball", "block").alias("key"), "side", "c", "copies", "v")
    return store.written(spark, keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(threshold), "c long, links long, root long"), "across")


def _audit(nodes: DataFrame, links: DataFrame, rows: DataFrame, threshold: float) -> dict[str, float]:
    """By space: the part that was found of the links to other vectors, as a mean over the audit's vectors that have any."""
    spark = nodes.sparkSession
    asked = rows.where(F.col("fp").isNotNull() & (F.col("vec_id") % AUDIT == 0)).select("fp").distinct().join(nodes, "fp").select("c", "space", "v")
    asked = store.written(spark, asked.join(links, "c", "left").withColumn("links", F.coalesce("links", F.lit(0))), "audited")
    true = []
    for chunk in _chunks(asked):
        spaces: dict[str, list] = {}
        for r in chunk:
            spaces.setdefault(r.space, []).append((r.c, bytes(r.v)))
        shared = spark.sparkContext.broadcast(spaces)

        def run(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            known = {}
            for space, own in shared.value.items():
                c, v = zip(*own)
                known[space] = np.array(c), np.frombuffer(b"".join(v), dtype=np.float64).reshape(len(v), -1), np.zeros(len(v), dtype=np.int64)
            for batch in batches:
                by_space: dict[str, list] = {}
                for space, *row in zip(*(x.to_pylist() for x in batch.columns)):
                    if space in known:
                        by_space.setdefault(space, []).append(row)
                for space, own in by_space.items():
                    asks, q, total = known[space]
                    for i in range(0, len(own), 256):
                        c, v, copies = zip(*own[i : i + 256])
                        # a cosine at the threshold may fall to either side, by the order of the sum
                        link = q @ np.frombuffer(b"".join(v), dtype=np.float64).reshape(len(v), -1).T >= threshold + 1e-12
                        total += (link & (asks[:, None] != np.array(c))) @ np.array(copies, dtype=np.int64)
            for asks, _, total in known.values():
                yield pa.RecordBatch.from_arrays([pa.array(asks[total > 0]), pa.array(total[total > 0])], names=["c", "true"])

        true.append(store.written(spark, nodes.select("space", "c", "v", "copies").mapInArrow(run, "c long, true long").groupBy("c").agg(F.sum("true").alias("true")), "true"))
    if not true:
        return {}
    every = true[0]
    for more in true[1:]:
        every = every.union(more)
    part = F.least(F.lit(1.0), F.col("links") / F.col("true"))
    return {r.space: r.part for r in asked.join(every, "c").groupBy("space").agg(F.avg(part).alias("part")).collect()}  # a row for each space


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> tuple[DataFrame, float]:
    """vec_id, n_links, component_id, kept of every vector; and the audit's recall (the least of any space)."""
    spark = vectors.sparkSession
    store.importable(spark)
    rows = store.written(spark, rows_of(vectors, id_col, vector_col, label_col), "vectors")
    nodes = rows.where("fp IS NOT NULL").groupBy("fp").agg(F.any_value("space").alias("space"), F.any_value("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = store.written(spark, nodes.withColumn("c", F.monotonically_increasing_id()), "nodes")
    trees = TREES
    for attempt in range(ATTEMPTS):
        lists = store.written(spark, _planted(nodes, trees), "lists")
        for _ in range(ROUNDS):
            refined = store.written(spark, _refined(nodes, lists), "lists")
            changed, lists = _changed(lists, refined, threshold - SLACK), refined
            if changed <= CHANGED:
                break
        near = store.written(spark, components(lists.where(F.col("sim") >= threshold - SLACK).select("a", "b")), "groups")
        blocks = near.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        own = near.join(blocks, "component").join(nodes, F.col("node") == F.col("c")).select("component", "blocks", "c", "copies", "v")
        own = own.withColumn("side", F.pmod(F.xxhash64("c"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        keyed = own.select(F.concat_ws(":", "component", F.least("side", "other"), F.greatest("side", "other")).alias("key"), "side", "c", "copies", "v")
        exact = store.written(spark, keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(threshold), "c long, links long, root long"), "links")
        saturated = lists.where(F.col("sim") >= threshold - SLACK).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= K)
        full = near.join(saturated, F.col("node") == F.col("a")).select(F.col("component").alias("g"), F.lit(True).alias("full")).distinct()
        placed = nodes.join(near, F.col("node") == F.col("c"), "left").withColumn("component", F.coalesce("component", "c")).join(full, F.col("g") == F.col("component"), "left")
        placed = store.written(spark, placed.select("c", "space", "copies", "v", "component", F.coalesce("full", F.lit(False)).alias("full")), "placed")
        within, across = exact, _across(placed, threshold)
        exact = within if across is None else within.union(across)
        links = exact.groupBy("c").agg(F.sum("links").alias("links"))
        recall = _audit(nodes, links, rows, threshold)
        short = [space for space, found in recall.items() if found < RECALL]
        if not short:
            break
        trees *= 2
        if attempt == ATTEMPTS - 1:  # these spaces are compared in full
            falls = store.written(spark, spark.createDataFrame([(space,) for space in short], "short string"), "short")
            placed = placed.join(falls, F.col("space") == F.col("short"), "left").withColumn("full", F.col("full") | F.col("short").isNotNull())
            across = _across(store.written(spark, placed.drop("short"), "placed"), threshold)
            exact = within.union(across)
            links = exact.groupBy("c").agg(F.sum("links").alias("links"))
            recall = _audit(nodes, links, rows, threshold)
            if min(recall.values()) < RECALL:
                raise RuntimeError(f"the audit found a recall of {min(recall.values())} after exact comparison")
    linked = components(exact.select("c", "root")).withColumnRenamed("node", "c")
    named = nodes.select("c", "fp", "copies", "least").join(links, "c", "left").join(linked, "c", "left").withColumn("component", F.coalesce("component", "c"))
    named = store.written(spark, named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = store.written(spark, named.join(least, "component").select("fp", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    out = rows.select("vec_id", "fp").join(named, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")), min(recall.values(), default=1.0)


def near_duplicates(vectors: DataFrame, **options) -> DataFrame:
    return search(vectors, **options)[0]
