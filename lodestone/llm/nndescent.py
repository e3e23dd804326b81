"""Near-duplicate vectors by NN-descent.

Equal vectors are one node. A first neighbour graph comes from blocks of random-hyperplane buckets; then
every node's neighbours and reverse neighbours meet in turn (the join of neighbours of neighbours) and
each keeps its nearest ``K``. A node all of whose neighbours lie above the threshold is saturated, and its
list grows to ``K_WIDE``. A round meets only around nodes whose neighbours have changed, and rounds go on until the lists gain
next to nothing (the first of them at most ``ROUNDS``, then the audit decides). Edges above the threshold
join nodes to components, and within a component all pairs are compared exactly, block against block,
without emitting them: any link joins two nodes of one component, so link counts are exact there.

A node whose whole list lies above the threshold may have more links than its list holds. Its component is enclosed in a ball
around its root; a node that any member links to lies within the ball's radius and the threshold's angle of the root, so
only nodes found there are compared with the members, exactly, and links that leave the component unite the two. The
recall is audited: ``AUDIT`` nodes are compared with all others; if less than ``RECALL`` of their links, or on average of a
node's links, lie within components, the graph starts again from what it has, with more tables, and after the last start
every component has its ball, so that no link is missing.

Cosines are in double precision. Vectors that are null, empty, zero, or hold a null or a non-finite
component have no links and are components of their own. Vectors may have any number of dimensions. A shorter vector counts as filled up with zeros. A null
id never names a component if another id does. Repeated rows count as vectors of their own and get a row
each. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrow import by_group
from lodestone.llm.common import stage
from lodestone.llm.components import components, of_key

K, K_WIDE, TABLES, ROUNDS, BUCKET, BLOCK = 10, 40, 12, 6, 192, 256
#: Rows of a block in which all pairs are compared.
WIDE_BLOCK = 1024
REVERSE, AUDIT, RECALL, RESTARTS = 64, 256, 0.999, 2
GAIN = 0.002
#: Bytes of vectors that the driver sends out at once to meet all others, and rows of a tile of that product.
SENT, TILE = 8 << 20, 2048
LISTS = T.StructType([T.StructField("node", T.LongType()), T.StructField("nbrs", T.ArrayType(T.LongType())), T.StructField("sims", T.ArrayType(T.DoubleType()))])


def packed(row: list | None, kind: str) -> bytes | None:
    """A vector as bytes, in its own precision: a letter for it, then the numbers. -0.0 becomes 0.0, so equal vectors are equal."""
    return None if row is None else kind.encode() + (np.array(row, kind) + np.array(0, kind)).tobytes()


def units(column: list[bytes]) -> np.ndarray:
    """Rows of unit length in double precision; shorter rows are filled up with zeros. Scaled first, so that squares
    neither overflow nor vanish."""
    rows = [np.frombuffer(b, chr(b[0]), offset=1) for b in column]
    x = np.zeros((len(rows), max(len(r) for r in rows)))
    for k, r in enumerate(rows):
        x[k, : len(r)] = r
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    width = min(x.shape[1], y.shape[1])
    return x[:, :width] @ y[:, :width].T


def nearest(node: np.ndarray, x: np.ndarray, k: int) -> tuple[list, list]:
    """For each row its nearest k other rows, with their cosines."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(k, len(node) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return node[top].tolist(), np.take_along_axis(s, top, 1).tolist()


def _list_batch(node: list, nbrs: list, sims: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(nbrs, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))], names=LISTS.names)


def _local_join(t: pa.Table) -> pa.RecordBatch | None:
    node = t.column("node").to_numpy()
    _, first = np.unique(node, return_index=True)
    if len(first) < 2:
        return None
    node = node[first]
    nbrs, sims = nearest(node, units(t.column("vec").take(pa.array(first)).to_pylist()), K_WIDE if len(first) > BLOCK else 2 * K)
    return _list_batch(node.tolist(), nbrs, sims)


def _tables(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    """First lists, from blocks of hyperplane buckets in ``TABLES`` tables."""
    bits = int(np.clip(np.ceil(np.log2(max(2, n / BUCKET))), 1, 30))
    schema = T.StructType([vectors.schema["node"], vectors.schema["vec"], T.StructField("table", T.IntegerType()), T.StructField("code", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = units(batch.column("vec").to_pylist())
            for t in range(TABLES):
                planes = np.random.default_rng([seed, t]).standard_normal((x.shape[1], bits))  # a row for each dimension, the same in all batches
                code = ((x @ planes) > 0) @ (1 << np.arange(bits))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("vec"), pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int64))], names=schema.names)

    coded = vectors.select("node", "vec").mapInArrow(run, schema)
    coded = stage(coded, "nnd-codes")
    sizes = coded.groupBy("table", "code").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = coded.join(sizes, ["table", "code"]).filter("parts > 0").withColumn("part", F.pmod(F.xxhash64("node", "table"), F.col("parts")))
    return by_group(dealt, ["table", "code", "part"], _local_join, LISTS)


def _merged(lists: DataFrame, threshold: float) -> DataFrame:
    """One list for each node: the nearest K, or K_WIDE where the nearest K all pass the threshold."""

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What meets in a partition is merged before the shuffle, so no hub gathers a row from each of its groups."""
        for batch in batches:
            node = batch.column("node").to_numpy()
            if not len(node):
                continue
            count = np.array([len(x) for x in batch.column("nbrs")])
            at, to, sim = np.repeat(node, count), batch.column("nbrs").flatten().to_numpy(), batch.column("sims").flatten().to_numpy()
            order = np.lexsort((-sim, at))
            at, to, sim = at[order], to[order], sim[order]
            cut = np.flatnonzero(at[1:] != at[:-1]) + 1
            first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)]))
            names, nbrs, sims = [], [], []
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                best: dict[int, float] = {}
                for y, s in zip(to[a:b].tolist(), sim[a:b].tolist(), strict=True):
                    best.setdefault(y, s)
                    if len(best) == K_WIDE:
                        break
                names.append(int(at[a]))
                ks, vs = list(best), list(best.values())
                wide = len(vs) >= K and vs[K - 1] >= threshold
                nbrs.append(ks[: K_WIDE if wide else K])
                sims.append(vs[: K_WIDE if wide else K])
            yield _list_batch(names, nbrs, sims)

    flat = lists.mapInArrow(early, LISTS).groupBy("node").agg(F.flatten(F.collect_list("nbrs")).alias("nbrs"), F.flatten(F.collect_list("sims")).alias("sims"))
    return stage(flat.mapInArrow(early, LISTS), "nnd-lists")


def _edges(lists: DataFrame) -> DataFrame:
    return lists.select("node", F.explode("nbrs").alias("nbr"))


def _round(lists: DataFrame, before: DataFrame | None, vectors: DataFrame) -> DataFrame:
    """The join of neighbours of neighbours, around every pivot that has got or become a neighbour since the lists ``before``.
    Reverse neighbours come in parts of about REVERSE, each together with the pivot's own neighbours, so a hub is spread
    over groups and none is left out."""
    own = _edges(lists)
    if before is not None:
        new = stage(own.join(_edges(before), ["node", "nbr"], "left_anti"), "nnd-new")
        pivots = new.select("node").union(new.select(F.col("nbr").alias("node"))).distinct()
        fore, back = own.join(pivots, "node"), own.join(pivots.withColumnRenamed("node", "nbr"), "nbr")
    else:
        fore = back = own
    degree = stage(back.groupBy("nbr").agg(F.ceil(F.count("*") / REVERSE).alias("parts")), "nnd-degree")
    back = back.join(degree, "nbr").select(F.col("nbr").alias("pivot"), F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node")
    fore = fore.join(degree.withColumnRenamed("nbr", "node"), "node", "left").select(F.col("node").alias("pivot"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.col("nbr").alias("node"))
    members = back.unionByName(fore).join(vectors.select("node", "vec"), "node")
    return by_group(members, ["pivot", "part"], _local_join, LISTS)


def _block_counts(members: DataFrame, threshold: float) -> DataFrame:
    """members: node, root, m, vec. n: for each node the vectors of other nodes of its component above the
    threshold. All pairs are compared, in pairs of blocks."""
    sizes = stage(members.groupBy("root").agg(F.ceil(F.count("*") / WIDE_BLOCK).alias("parts")), "nnd-sizes")
    dealt = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    spread = spread.select("node", "m", "vec", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType())])

    def count(t: pa.Table) -> pa.RecordBatch:
        node, m, own = (t.column(c).to_numpy() for c in ("node", "m", "own"))
        x = units(t.column("vec").to_pylist())
        near = (x @ x.T) >= threshold
        np.fill_diagonal(near, False)
        if t.column("i")[0].as_py() != t.column("j")[0].as_py():
            near &= own[:, None] != own[None, :]  # pairs within a block belong to that block's own group
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(near @ m.astype(np.int64))], names=["node", "n"])

    return by_group(spread, ["root", "i", "j"], count, schema).groupBy("node").agg(F.sum("n").alias("n"))


def _balls(every: DataFrame, threshold: float) -> DataFrame:
    """every: node, vec, root, open. root, vec, reach: for each component with an open node its root's vector, and the angle from
    it within which all nodes lie that link to a member."""
    centres = every.filter("node = root").select("root", F.col("vec").alias("centre"))
    roots = every.filter("open").select("root").distinct()
    schema = T.StructType([T.StructField("root", T.LongType()), T.StructField("angle", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = units([*batch.column("vec").to_pylist(), *batch.column("centre").to_pylist()])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("root"), pa.array(np.arccos(np.clip((x[:n] * x[n:]).sum(1), -1, 1)))], names=schema.names)

    angles = every.join(roots, "root").select("root", "vec").join(centres, "root").mapInArrow(run, schema)
    radius = angles.groupBy("root").agg(F.max("angle").alias("radius"))
    reach = F.col("radius") + F.lit(float(np.arccos(threshold)) + 1e-6)
    return stage(radius.join(centres, "root").select("root", F.col("centre").alias("vec"), reach.alias("reach")), "nnd-balls")


def _near_balls(balls: DataFrame, every: DataFrame) -> DataFrame | None:
    """ball, node, root: the nodes of other components within reach of a ball. ``balls`` goes out in pieces of SENT bytes, each
    past all vectors in place; none without rows."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("ball", "node", "root")])

    def against(vecs: list[bytes], own: list[int], reach: list[float]) -> DataFrame:
        roots, least = np.array(own), np.cos(np.minimum(np.array(reach), np.pi))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = units(vecs)
            for batch in batches:
                if not batch.num_rows:
                    continue
                y, node, root = units(batch.column("vec").to_pylist()), batch.column("node").to_numpy(), batch.column("root").to_numpy()
                for i in range(0, len(x), TILE):
                    for j in range(0, len(y), TILE):
                        near = (dots(x[i : i + TILE], y[j : j + TILE]) >= least[i : i + TILE, None]) & (roots[i : i + TILE, None] != root[None, j : j + TILE])
                        a, b = np.nonzero(near)
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(roots[i + a]), pa.array(node[j + b]), pa.array(root[j + b])], names=schema.names)

        return stage(every.select("node", "vec", "root").mapInArrow(run, schema), "nnd-near")

    found, rows, size = None, [], 0
    for r in balls.toLocalIterator():
        rows.append((bytes(r["vec"]), r["root"], r["reach"]))
        size += len(rows[-1][0])
        if size >= SENT:
            part = against(*map(list, zip(*rows, strict=True)))
            found, rows, size = part if found is None else found.unionByName(part), [], 0
    if rows:
        part = against(*map(list, zip(*rows, strict=True)))
        found = part if found is None else found.unionByName(part)
    return found


def _crossing(every: DataFrame, threshold: float) -> DataFrame | None:
    """u, v: roots of different components that a link of a component with an open node joins; none if no ball is near another
    node. All members of a ball and all nodes near it are compared, block against block."""
    near = _near_balls(_balls(every, threshold), every)
    if near is None or near.isEmpty():
        return None
    sides = near.groupBy("ball").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("outer"))
    members = every.join(sides.withColumnRenamed("ball", "root"), "root")
    counts = stage(members.groupBy("root", "outer").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("inner")).withColumnRenamed("root", "ball"), "nnd-sides")
    deal = lambda d, mine, other, side: d.withColumns({
        mine: F.pmod(F.xxhash64("node"), F.col({"i": "inner", "j": "outer"}[mine])).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col({"i": "inner", "j": "outer"}[other]) - 1)), "side": F.lit(side)
    }).select("ball", "i", "j", "side", "root", "vec")
    inside = deal(every.withColumn("ball", F.col("root")).join(counts, "ball"), "i", "j", 0)
    outside = deal(near.select("ball", "node").join(every, "node").join(counts, "ball"), "j", "i", 1)
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def links(t: pa.Table) -> pa.RecordBatch | None:
        side, root, x = t.column("side").to_numpy(), t.column("root").to_numpy(), units(t.column("vec").to_pylist())
        a, b = np.nonzero(dots(x[side == 0], x[side == 1]) >= threshold)
        if not len(a):
            return None
        pairs = np.unique(np.stack([root[side == 0][a], root[side == 1][b]], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=schema.names)

    return stage(by_group(inside.unionByName(outside), ["ball", "i", "j"], links, schema).distinct(), "nnd-crossing")


def _united(vectors: DataFrame, edges: DataFrame, threshold: float, lists: DataFrame | None) -> DataFrame:
    """The components of ``edges`` and of all links of nodes whose list does not reach below the threshold; without lists, of all links."""
    roots = components(edges)
    every = vectors.select("node", "vec").join(roots, "node", "left").select("node", "vec", F.coalesce("root", "node").alias("root"))
    if lists is None:
        every = every.withColumn("open", F.lit(True))
    else:
        ended = lists.filter(F.array_min("sims") < threshold).select("node", F.lit(True).alias("ended"))
        every = every.join(ended, "node", "left").withColumn("open", F.col("ended").isNull()).drop("ended")
    more = _crossing(stage(every, "nnd-rooted"), threshold)
    return roots if more is None or more.isEmpty() else stage(components(roots.toDF("u", "v").unionByName(more)), "nnd-roots")


def _audit(vectors: DataFrame, roots: DataFrame, threshold: float) -> float:
    """Share of the links of AUDIT nodes, found by comparing them with all nodes, whose ends are in one component: of all these
    links or on average of a node's, whichever is less, so that a large group does not outvote pairs."""
    sample = vectors.select("node", "vec").orderBy(F.xxhash64("node")).limit(AUDIT).collect()
    if not sample:
        return 1.0
    ids, vecs = np.array([r["node"] for r in sample]), [bytes(r["vec"]) for r in sample]
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            if len(node):
                x = units([*vecs, *batch.column("vec").to_pylist()])
                a, b = np.nonzero(x[: len(ids)] @ x[len(ids) :].T >= threshold)
                other = ids[a] != node[b]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a][other]), pa.array(node[b][other])], names=["u", "v"])

    true = vectors.select("node", "vec").mapInArrow(run, schema)
    got = true.join(roots.toDF("u", "ru"), "u", "left").join(roots.toDF("v", "rv"), "v", "left")
    own = got.groupBy("u").agg(F.count("*").alias("n"), F.count_if(F.col("ru") == F.col("rv")).alias("k"))
    row = own.agg((F.sum("k") / F.sum("n")).alias("links"), F.avg(F.col("k") / F.col("n")).alias("nodes")).first()
    return 1.0 if row["links"] is None else min(row["links"], row["nodes"])


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall: a row for each row of embeddings."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.coalesce(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists(e, lambda x: x != 0), F.lit(False))

    kind = "f" if isinstance(getattr(embeddings.schema["embedding"].dataType, "elementType", None), T.FloatType) else "d"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = pa.array([packed(x, kind) for x in batch.column("x").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vec], names=["vec_id", "vec"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, F.col("embedding") if kind == "f" else e).alias("x"))
    rows = stage(rows.mapInArrow(pack, "vec_id long, vec binary"), "nnd-rows")
    alias = F.coalesce(F.min("vec_id"), -1 - F.abs(F.xxhash64("vec") / 2).cast("long")).alias("node")
    vectors = stage(rows.filter("vec is not null").groupBy("vec").agg(alias, F.min("vec_id").alias("least_id"), F.count("*").alias("m")), "nnd-nodes")
    n = vectors.count()
    lists, roots, recall = None, None, 1.0
    for start in range(RESTARTS + 1 if n > 1 else 0):
        first = _tables(vectors, n, start)
        before, lists = lists, _merged(first if lists is None else lists.unionByName(first), threshold)  # a new start goes on from what it has
        total = None
        for _ in range(ROUNDS):
            now = lists.agg(F.coalesce(F.sum(F.aggregate("sims", F.lit(0.0), lambda a, s: a + s)), F.lit(0.0))).first()[0]
            if total is not None and now - total <= GAIN * abs(total):
                break
            total = now
            before, lists = lists, _merged(lists.unionByName(_round(lists, before, vectors)), threshold)
        edges = lists.select("node", F.explode(F.arrays_zip("nbrs", "sims")).alias("x")).filter(F.col("x.sims") >= threshold).select(F.col("node").alias("u"), F.col("x.nbrs").alias("v"))
        roots = _united(vectors, edges, threshold, lists)
        recall = _audit(vectors, roots, threshold)
        if recall >= RECALL:
            break
    else:
        if roots is not None:
            roots = _united(vectors, edges, threshold, None)
            recall = _audit(vectors, roots, threshold)
    if roots is None:
        roots = vectors.select("node", F.col("node").alias("root")).limit(0)
    linked = stage(vectors.join(roots, "node").select("node", "root", "m", "vec"), "nnd-members")
    counts = _block_counts(linked, threshold)
    named = vectors.select("node", "vec", "m", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(of_key(named, "root", component_id=F.min("least_id")), "root").join(counts, "node", "left").select("vec", "component_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = rows.join(named, "vec", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumns({"kept": F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)), "audit_recall": F.lit(float(recall))})


def query(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)
