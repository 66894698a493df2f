"""Exact top-k by inner product: ball-tree branch and bound per shard, for a stated set of queries against all rows.

1. A bounded sample gives a tree of at most ``MAX_REGIONS`` regions, parted by planes; each vector walks down
   it. A region is cut in shards of about ``shard_vectors`` by hash, so copies of one vector, however many, split too.
2. Each shard's vectors are put in ball-tree order, with each node's centre and radius, and written to the shared folder.
3. Each query first searches one shard of its own region, which gives a k-th score to start with.
4. Queries form blocks of about ``QUERY_BLOCK``. A block meets the shards of those regions whose ball one of its queries can use, in
   ``GROUPS`` streams with the best shard first. In a shard, nodes are visited in order of the upper bound q.c + |q| r;
   each query's current k-th score prunes nodes and shards and is carried from shard to shard of a stream.
5. The streams' results of a query are ranked together. What a query gets is exact.

The driver holds the sample, the planes and one ball per region, all bounded whatever the input; shards reach
the blocks by a shuffle (each shard once per block), not by file reads of its own, so any Hadoop file system will do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch

K, SHARD_VECTORS, MAX_REGIONS, SAMPLE, LEAF, DECIMALS = 10, 8192, 1024, 8192, 128, 9
QUERY_BLOCK, GROUPS, EVERY = 65_536, 32, 100


def halves(v: np.ndarray) -> tuple[np.ndarray, float] | None:
    """A plane that parts the vectors about evenly: the direction between two far points, and the median."""
    far = v[((v - v.mean(0)) ** 2).sum(1).argmax()]
    other = v[((v - far) ** 2).sum(1).argmax()]
    w = far - other
    if not w.any():
        return None
    at = v @ w
    cut = float(np.median(at))
    if not (at < cut).any():  # many ties at the lower end
        higher = at[at > cut]
        if not len(higher):
            return None
        cut = float(higher.min())
    return w, cut


class Router:
    """Splitting planes in a heap: node i has the children 2 i + 1 (below the plane) and 2 i + 2."""

    def __init__(self, sample: np.ndarray, shards: int):
        depth = max(0, math.ceil(math.log2(max(1, shards))))
        self.planes: dict[int, tuple[np.ndarray, float]] = {}

        def split(i: int, v: np.ndarray, left: int) -> None:
            if left and len(v) > 1 and (plane := halves(v)):
                self.planes[i] = plane
                below = v @ plane[0] < plane[1]
                split(2 * i + 1, v[below], left - 1)
                split(2 * i + 2, v[~below], left - 1)

        split(0, sample, depth)

    def route(self, v: np.ndarray, depth: int = 64) -> np.ndarray:
        at = np.zeros(len(v), np.int64)
        todo = {0: np.arange(len(v))}
        while todo:
            i, rows = todo.popitem()
            at[rows] = i
            if i in self.planes and len(rows) and (i + 1).bit_length() <= depth:
                w, cut = self.planes[i]
                below = v[rows] @ w < cut
                todo[2 * i + 1], todo[2 * i + 2] = rows[below], rows[~below]
        return at


def build_tree(v: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the vectors, and per node: (begin, end, parent, is leaf), centre and radius. Parents come first."""
    order, spans, centres, radii = np.arange(len(v)), [], [], []
    todo = [(0, len(v), -1)]
    while todo:
        a, b, parent = todo.pop()
        own = v[order[a:b]]
        centre = own.mean(0)
        plane = halves(own) if b - a > leaf else None
        spans.append((a, b, parent, plane is None))
        centres.append(centre)
        radii.append(math.sqrt(((own - centre) ** 2).sum(1).max()))
        if plane:
            below = own @ plane[0] < plane[1]
            order[a:b] = np.concatenate([order[a:b][below], order[a:b][~below]])
            me, mid = len(spans) - 1, a + int(below.sum())
            todo += [(mid, b, me), (a, mid, me)]
    return order, np.array(spans, np.int64), np.array(centres), np.array(radii)


class Best:
    """The best k of each query so far, by score and then by smaller id, none below ``least``."""

    def __init__(self, k: int, least: np.ndarray, kind: np.dtype):
        self.score, self.id, self.least = np.full((len(least), k), -np.inf), np.zeros((len(least), k), kind), least

    @property
    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.least)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        use = (score >= self.kth[rows][:, None]).any(1)
        if not use.any():
            return
        rows, score = rows[use], score[use]
        if score.shape[1] > 4 * k:
            # Only scores that reach the row's k-th best can enter; the rest of the row is left out, ties kept.
            at = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
            enough = score >= np.maximum(at, self.kth[rows])[:, None]
            most = max(1, int(enough.sum(1).max()))
            pick = np.argsort(~enough, axis=1, kind="stable")[:, :most]
            score = np.where(np.take_along_axis(enough, pick, 1), np.take_along_axis(score, pick, 1), -np.inf)
            ids = ids[pick]
        s = np.concatenate([self.score[rows], score], 1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], 1)
        if i.dtype.itemsize > self.id.dtype.itemsize:
            self.id = self.id.astype(i.dtype)
        best = np.lexsort((i, -s), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def upper_bounds(q: np.ndarray, norm: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bound of q.v for the v of each ball, with room for rounding."""
    reach = norm[:, None] * radii
    slack = 1e-9 * (1 + norm[:, None] * np.sqrt((centres**2).sum(1)) + reach)
    return q @ centres.T + reach + slack


def search_tree(q: np.ndarray, norm: np.ndarray, own_ids: np.ndarray, best: Best, ids: np.ndarray, v: np.ndarray, spans: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> None:
    """Branch and bound over one shard for all queries at once, best leaves first."""
    bound = upper_bounds(q, norm, centres, radii)
    for i, (_, _, parent, _) in enumerate(spans):
        if parent >= 0:
            np.minimum(bound[:, i], bound[:, parent], out=bound[:, i])
    leaves = np.flatnonzero(spans[:, 3])
    bound = bound[:, leaves]
    turn = np.argsort(-bound, axis=1, kind="stable")
    active = np.arange(len(q))
    for r in range(len(leaves)):
        leaf = turn[active, r]
        still = bound[active, leaf] >= best.kth[active]
        active, leaf = active[still], leaf[still]  # the rest of a query's leaves have lower bounds yet
        if not len(active):
            break
        by = np.argsort(leaf, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(leaf[by])) + 1, [len(by)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = active[by[a:b]]
            lo, hi = spans[leaves[leaf[by[a]]], :2]
            score = np.round(q[rows] @ v[lo:hi].T, DECIMALS)
            score[own_ids[rows][:, None] == ids[lo:hi]] = -np.inf
            best.offer(rows, score, ids[lo:hi])


def _vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten() if pa.types.is_list(column.type) else column
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _keys(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as integers where they are, else as strings; both sort as Spark sorts them."""
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.array(column.cast(pa.string()).to_pylist(), "U")


def _lists(values: pa.Array, n: int = 1) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.linspace(0, len(values), n + 1).astype(np.int32)), values)


@dataclass
class Tree:
    """A shard as it is stored."""

    ids: np.ndarray
    v: np.ndarray
    spans: np.ndarray
    centres: np.ndarray
    radii: np.ndarray

    @classmethod
    def of(cls, row: dict, ids: pa.Array, dim: int, kind: str) -> Tree:
        return cls(_keys(ids), np.frombuffer(row["vectors"], kind).reshape(-1, dim).astype(np.float64), np.frombuffer(row["spans"], np.int64).reshape(-1, 4), np.frombuffer(row["centres"]).reshape(-1, dim), np.frombuffer(row["radii"]))

    def search(self, q: np.ndarray, norm: np.ndarray, own: np.ndarray, best: Best) -> None:
        search_tree(q, norm, own, best, self.ids, self.v, self.spans, self.centres, self.radii)


def _build(dim: int, kind: str):
    def run(table: pa.Table) -> pa.Table:
        column, v = table["id"].combine_chunks(), _vectors(table["v"], dim)
        first = np.lexsort((*v.T[::-1], _keys(column)))  # the same order whatever the shuffle brought first
        order, spans, centres, radii = build_tree(v[first])
        order = first[order]
        row = [v[order].astype(kind).tobytes(), spans.tobytes(), centres.tobytes(), radii.tobytes()]
        return pa.table([table["region"][:1], table["piece"][:1], _lists(column.take(pa.array(order))), *[pa.array([x], pa.binary()) for x in row]], names=["region", "piece", "ids", "vectors", "spans", "centres", "radii"])

    return run


def _ball(dim: int):
    def run(table: pa.Table) -> pa.Table:
        """A ball around the balls of a region's shards."""
        c = np.array([np.frombuffer(x) for x in table["c"].to_pylist()]).reshape(-1, dim)
        r = np.array([np.frombuffer(x)[0] for x in table["r"].to_pylist()])
        centre = c[np.lexsort(c.T)].mean(0)
        radius = float((np.sqrt(((c - centre) ** 2).sum(1)) + r).max())
        return pa.table({"region": table["region"][:1], "c": pa.array([centre.tobytes()], pa.binary()), "r": pa.array([radius])})

    return run


def _home(dim: int, kind: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of one region each meet one of its shards: their k-th scores there."""
        for batch in batches:
            for i, row in enumerate(batch.select(["vectors", "spans", "centres", "radii"]).to_pylist()):
                t = Tree.of(row, batch["ids"][i].values, dim, kind)
                q, own = _vectors(batch["qv"][i].values, dim), batch["qids"][i].values
                best = Best(k, np.full(len(q), -np.inf), t.ids.dtype)
                t.search(q, np.sqrt((q**2).sum(1)), _keys(own), best)
                part = pa.array(np.full(len(q), batch["part"][i].as_py()))
                yield pa.RecordBatch.from_arrays([part, own, _lists(batch["qv"][i].values, len(q)), pa.array(best.kth)], ["part", "id", "v", "kth"])

    return run


def _regions(dim: int, regions: np.ndarray, centres: np.ndarray, radii: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The regions that a block can use, each with the highest bound of any of its queries."""
        for batch in batches:
            for i, block in enumerate(batch["block"].to_pylist()):
                q, kth = _vectors(batch["qv"][i].values, dim), batch["kth"][i].values.to_numpy(zero_copy_only=False)
                top = np.full(len(regions), -np.inf)
                for a in range(0, len(q), 4096):
                    part = q[a : a + 4096]
                    bound = upper_bounds(part, np.sqrt((part**2).sum(1)), centres, radii)
                    np.maximum(top, np.where(bound >= kth[a : a + 4096, None], bound, -np.inf).max(0), out=top)
                use = np.flatnonzero(np.isfinite(top))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(use), block)), pa.array(regions[use]), pa.array(top[use])], ["block", "region", "bound"])

    return run


def _search(dim: int, kind: str, k: int):
    names = ["block", "position", "vec_id", "neighbor_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams of one row with queries and then the shards they meet, best first."""
        state: tuple | None = None

        def close() -> Iterator[pa.RecordBatch]:
            if state:
                block, ids, _, _, _, best = state
                at, place = np.nonzero(np.isfinite(best.score))
                found = pa.array(best.id[at, place])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at), ids.take(pa.array(at)), found.cast(ids.type), pa.array(best.score[at, place])], names)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if not row["is_shard"][0].as_py():
                    yield from close()
                    q, ids = _vectors(row["qv"][0].values, dim), row["ids"][0].values
                    own = _keys(ids)
                    state = row["block"][0].as_py(), ids, own, q, np.sqrt((q**2).sum(1)), Best(k, row["kth"][0].values.to_numpy(zero_copy_only=False), own.dtype)
                    continue
                _, _, own, q, norm, best = state
                tree = Tree.of(row.select(["vectors", "spans", "centres", "radii"]).to_pylist()[0], row["ids"][0].values, dim, kind)
                use = np.flatnonzero(upper_bounds(q, norm, tree.centres[:1], tree.radii[:1])[:, 0] >= best.kth)
                for a in range(0, len(use), 4096):
                    part = use[a : a + 4096]
                    mine = Best(k, best.least[part], best.id.dtype)
                    mine.score, mine.id = best.score[part], best.id[part]
                    tree.search(q[part], norm[part], own[part], mine)
                    if mine.id.dtype.itemsize > best.id.dtype.itemsize:
                        best.id = best.id.astype(mine.id.dtype)
                    best.score[part], best.id[part] = mine.score, mine.id
        yield from close()

    return run


def top_k(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, asks: Column | None = None, shard_vectors: int = SHARD_VECTORS, query_block: int = QUERY_BLOCK, max_regions: int = MAX_REGIONS
) -> DataFrame:
    """Rows (vec_id, rank, neighbor_id, score): for each query the k rows of other ids with the highest inner products.

    ``asks`` says which rows are queries: all unless given. Scores are rounded to ``DECIMALS`` places and ties go to the
    smaller id. Ids keep their type (integers or anything that casts to a string). Rows with a null id, a
    null or empty vector, or one with a null, NaN or infinite element are neither queries nor
    neighbours, and so are those whose length isn't the most common (the smallest of equally common
    ones). Repeated rows count once; of an id with several vectors each is a query and a
    neighbour of other ids. An empty table, or one without queries, gives no rows. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    integer = vectors.schema[id_column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    id_type = vectors.schema[id_column].dataType.simpleString() if integer else "string"
    inner, kind = ("float", "<f4") if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else ("double", "<f8")
    schema = f"vec_id {id_type}, rank int, neighbor_id {id_type}, score double"
    v, asked = F.col(vector_column).cast(f"array<{inner}>"), F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    fine = "id is not null and size(v) > 0 and forall(v, x -> x is not null and abs(x) < double('infinity'))"
    clean = scratch.write(vectors.select(F.col(id_column).cast(id_type).alias("id"), v.alias("v"), asked.alias("asked")).where(fine).groupBy("id", "v").agg(F.max("asked").alias("asked")))
    lengths = clean.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, n = lengths
    same = clean.where(F.size("v") == dim)
    asking = same.where("asked").count()
    sample = same.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).toArrow()
    router = Router(_vectors(sample["v"], dim), min(max_regions, -(-n // shard_vectors)))
    # A block has the queries of a subtree.
    block_depth = max(0, math.ceil(math.log2(max(1, -(-asking // query_block)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _vectors(batch["v"], dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(router.route(own)), pa.array(router.route(own, block_depth))], ["id", "v", "asked", "region", "part"])

    placed = scratch.write(same.mapInArrow(place, f"id {id_type}, v array<{inner}>, asked boolean, region long, part long"))
    spread = F.pmod(F.xxhash64("id", "v"), F.col("pieces"))
    cut = lambda df, by, size: df.join(df.groupBy(by).agg(F.ceil(F.count("*") / F.lit(size)).cast("long").alias("pieces")), by).withColumn("piece", spread)
    stored = f"region long, piece long, ids array<{id_type}>, vectors binary, spans binary, centres binary, radii binary"
    trees = scratch.write(cut(placed, "region", 2 * shard_vectors).select("region", "piece", "id", "v").groupBy("region", "piece").applyInArrow(_build(dim, kind), stored))
    balls = trees.select("region", F.substring("centres", 1, 8 * dim).alias("c"), F.substring("radii", 1, 8).alias("r"))
    head = balls.groupBy("region").applyInArrow(_ball(dim), "region long, c binary, r double").orderBy("region").toArrow()
    centres = np.array([np.frombuffer(x) for x in head["c"].to_pylist()]).reshape(-1, dim)

    # Queries meet the first shard of their region, in pieces of bounded size.
    local = cut(placed.where("asked"), "region", query_block // 16).groupBy("region", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("own"))
    local = local.select("region", "part", F.col("own.id").alias("qids"), F.flatten("own.v").alias("qv"))
    met = local.join(trees.where("piece = 0").drop("piece"), "region").select("part", "ids", "vectors", "spans", "centres", "radii", "qids", "qv")
    seeded = scratch.write(met.mapInArrow(_home(dim, kind, k), f"part long, id {id_type}, v array<{inner}>, kth double"))

    gathered = cut(seeded, "part", query_block).groupBy("part", "piece").agg(F.sort_array(F.collect_list(F.struct("id", "v", "kth"))).alias("own"))
    blocks = scratch.write(gathered.select((F.col("part") * (1 << 24) + F.col("piece")).alias("block"), F.col("own.id").alias("ids"), F.flatten("own.v").alias("qv"), F.col("own.kth").alias("kth")))
    reach = scratch.write(blocks.mapInArrow(_regions(dim, head["region"].to_numpy(), centres, head["r"].to_numpy()), "block long, region long, bound double"))
    group = F.pmod(F.xxhash64("region", "piece"), F.lit(GROUPS)).cast("int").alias("group")
    shard_rows = reach.join(trees, "region").select("block", group, F.lit(True).alias("is_shard"), "bound", "region", "piece", "ids", F.lit(None).cast(f"array<{inner}>").alias("qv"), F.lit(None).cast("array<double>").alias("kth"), "vectors", "spans", "centres", "radii")
    streams = reach.join(trees.select("region", "piece"), "region").select("block", group).distinct()
    none = [F.lit(None).cast(x).alias(name) for name, x in (("bound", "double"), ("region", "long"), ("piece", "long"))]
    blobs = [F.lit(None).cast("binary").alias(x) for x in ("vectors", "spans", "centres", "radii")]
    query_rows = blocks.join(streams, "block").select("block", "group", F.lit(False).alias("is_shard"), *none, "ids", "qv", "kth", *blobs)
    every = query_rows.unionByName(shard_rows).repartition("block", "group").sortWithinPartitions("block", "group", "is_shard", F.desc("bound"), "region", "piece")
    found = every.mapInArrow(_search(dim, kind, k), f"block long, position long, vec_id {id_type}, neighbor_id {id_type}, score double")
    rank = F.row_number().over(W.partitionBy("block", "position").orderBy(F.desc("score"), "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", "score")


def top_k_sql(k: int = K, every: int = EVERY) -> str:
    """DuckDB SQL over the whole table embeddings: rows whose id is divisible by ``every`` against all rows."""
    return f"""
WITH pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), {DECIMALS}) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
ranked AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS INTEGER) AS rank, neighbor_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= {k}"""
