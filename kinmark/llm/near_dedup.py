"""MinHash near-deduplication with bottom-k sketches from one hash function.

1. Each document's set of hashed word shingles gives a fingerprint of 128 bits and its k
   smallest hashes (the sketch). Documents of equal fingerprints become one *node* with an id of its own.
2. Inverted lists hold, per retained hash, the nodes that retain it. Values
   kept by a single node are dropped; of the rest each node keeps a prefix, rarest
   first, long enough that two nodes whose sketches overlap enough must meet in
   a list (prefix filtering, so no list is capped or cut). A node of at most k shingles is *whole* in its sketch.
   Two whole nodes have lists of their own, where the smaller one needs a shorter prefix: short texts
   that share a line don't meet unless it is most of the smaller one.
3. The pairs of a list are tried leader by leader: a pair is tried only while its
   two nodes are in different groups. Once few pairs are left, or leaders no longer make them fewer, the rest is tried
   pair by pair, in slices if it is much.
4. Two whole nodes pass if the Jaccard similarity of their sketches, which is exact, reaches the threshold. Any other pair
   passes if the similarity estimated on the k smallest values of the
   united sketches is near the threshold and the exact Jaccard similarity of the
   full shingle sets reaches it. Groups are the connected components.

A shingle may be in every document: lists are counted and led by partial aggregates that are joined back, and a
join splits a hot list over tasks (adaptive skew join); no window has a shingle as its partition.
Working tables are deleted as soon as nothing reads them; only the table of the result stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import Scratch, free_name, row_key, second_key

K, WIDTH, THRESHOLD, DEVIATIONS = 64, 3, 0.5, 3.0
#: Leaders are elected until the pairs left are at most so many times the postings; a slice of pairs has about as many at most.
PAIRS_PER_POSTING = 4
#: Leaders are given up in a turn that finds more than this share of the pairs of the turn before.
LEFT_BY_LEADERS = 0.75
#: Lists of two whole nodes, of two others, and of one of each.
WHOLE, PARTS, MIXED = 0, 1, 2
#: A posting meets those of its list on either side, or only those on the other one; two on one such side make no pair.
EITHER, FIRST, SECOND = 0, 1, 2
#: Against rounding, where a product is compared with a count.
TINY = 1e-9


def sketch_sets(text: pa.Array, k: int, width: int) -> tuple[list[int | None], list[int | None], list[int], list[np.ndarray]]:
    """The two halves of a fingerprint of each text's shingle set (None: no words), its size and its k smallest hashes."""
    h, off = tv.shingles(text, width)
    h = (h >> np.uint64(1)).astype(np.int64)
    one, two, size, kept = [], [], [], []
    for a, b in zip(off[:-1], off[1:], strict=True):
        if a == b:
            one.append(None)
            two.append(None)
            size.append(0)
            kept.append(h[a:b])
            continue
        own = np.unique(h[a:b])
        mixed = tv.mix64(own.astype(np.uint64))
        for half, values in ((one, mixed), (two, tv.mix64(mixed ^ np.uint64(0x5851F42D4C957F2D)))):
            total = np.add.reduce(values, keepdims=True) + np.uint64(len(own))
            half.append(int(tv.mix64(total).astype(np.int64)[0]))
        size.append(len(own))
        kept.append(own[:k])
    return one, two, size, kept


def _sketches(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                one, two, size, kept = sketch_sets(part["text"], k, width)
                flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
                off = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
                sk = pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([part["rk"], part["rk2"], part["id"], pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(size, pa.int32()), sk], ["rk", "rk2", "id", "f1", "f2", "size", "sk"])

    return run


def exact_jaccard(a: pa.Array, b: pa.Array, width: int) -> np.ndarray:
    """Jaccard similarity of the two texts' full shingle sets, row by row."""
    ha, oa = tv.shingles(a, width)
    hb, ob = tv.shingles(b, width)
    out = np.zeros(len(a))
    for i in range(len(a)):
        x, y = np.unique(ha[oa[i] : oa[i + 1]]), np.unique(hb[ob[i] : ob[i + 1]])
        if len(x) and len(y):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out[i] = both / (len(x) + len(y) - both)
    return out


def _verify(width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in tv.chunks(batch, "ta", tv.CHUNK_BYTES // 2):
                for part in tv.chunks(half, "tb", tv.CHUNK_BYTES // 2):
                    j = exact_jaccard(part.column(2), part.column(3), width)
                    keep = pa.array(j >= threshold)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(j)], ["a", "b", "jaccard"]).filter(keep)

    return run


def estimate_floor(k: int, threshold: float, deviations: float) -> float:
    return max(threshold / 4, threshold - deviations * math.sqrt(threshold * (1 - threshold) / k))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of (a, b): rows (node, comp) with comp the smallest node.

    Large-star and small-star rounds on a written edge table until it stays the same.
    """
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = mark(now)
    while was[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A hub may have any number of neighbours: its least one is a partial aggregate, joined back.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = scratch.write(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = scratch.write(small)
        scratch.drop(now, star)
        now, is_ = new, mark(new)
        if is_ == was:
            break
        was = is_
    out = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out._kinmark_path = now._kinmark_path
    return out


#: Columns that make a list, and twice the pairs that its postings make (half of those of two on EITHER side count too often, in any part of a list alike).
LIST = ["kind", "v"]
MEETINGS = "n0 * n0 + 2 * n0 * (n1 + n2) + 2 * n1 * n2"


def _postings(nodes: DataFrame, k: int, threshold: float, floor: float) -> DataFrame:
    """Inverted lists: rows (kind, v, side, node), the prefix of each node, rarest first.

    A prefix of all but ``need - 1`` shared values holds the rarest value that a node has in common with another, if
    they have ``need`` in common. Of two whole nodes in a pair the larger has ``threshold`` of its shingles
    in common, the smaller 2 t / (1 + t): only pairs with a posting of the latter kind are tried. Any other pair has ``floor``
    of the k smallest values of both in common; one of a whole node and another is of sizes within ``threshold`` of each other.
    """
    seen = nodes.select("node", "size", F.explode("sk").alias("v"))
    shared = nodes.select(F.explode("sk").alias("v")).groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    ranked = seen.join(shared, "v").withColumn("rank", F.row_number().over(W.partitionBy("node").orderBy("df", "v"))).withColumn("cnt", F.count("*").over(W.partitionBy("node")))
    # How many shared values there are from this one on.
    rest = F.col("cnt") - F.col("rank") + 1
    complete = F.col("size") <= k
    part = rest >= math.ceil(floor * k - TINY)
    smaller = rest >= F.ceil(F.lit(2 * threshold / (1 + threshold)) * F.col("size") - TINY)
    larger = rest >= F.ceil(F.lit(threshold) * F.col("size") - TINY)
    place = lambda kind, side: F.struct(F.lit(kind).cast("byte").alias("kind"), F.lit(side).cast("byte").alias("side"))
    places = F.array(
        F.when(complete & smaller, place(WHOLE, EITHER)).when(complete & larger, place(WHOLE, SECOND)),
        F.when(~complete & part, place(PARTS, EITHER)),
        F.when(complete & part & (F.col("size") >= threshold * (k + 1) - TINY), place(MIXED, FIRST)).when(~complete & part & (F.col("size") <= k / threshold + TINY), place(MIXED, SECOND)),
    )
    return ranked.select("v", "node", F.explode(F.array_compact(places)).alias("at")).select("at.kind", "v", "at.side", "node")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K, width: int = WIDTH, threshold: float = THRESHOLD, deviations: float = DEVIATIONS
) -> tuple[DataFrame, Scratch]:
    """Rows (rk, rk2, id, group, n) for every row that has a near copy; ``rk`` and ``rk2`` are ``row_key`` and ``second_key``.

    Ids keep their type.
    Texts that are null or without words belong to no group. A repeated row is
    a copy of itself. Rows with a null or a repeated id are told apart by text.
    Texts shorter than ``width`` words have one shingle of all their words.
    An empty table gives no rows. Any other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    id_type = docs.schema[id_column].dataType.simpleString()
    source = docs.select(row_key(id_column, text_column).alias("rk"), second_key(id_column, text_column).alias("rk2"), F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = scratch.write(source.mapInArrow(_sketches(k, width), f"rk long, rk2 long, id {id_type}, f1 long, f2 long, size int, sk array<long>"))
    one = rows.where("f1 is not null").groupBy("f1", "f2").agg(F.min(F.struct("rk", "rk2")).alias("r"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sk").alias("sk"))
    nodes = scratch.write(one.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "r.rk", "r.rk2", "copies", "size", "sk"))

    floor = estimate_floor(k, threshold, deviations)
    postings = scratch.write(_postings(nodes, k, threshold, floor))
    whole = postings.count()

    comps: DataFrame | None = None
    texts: DataFrame | None = None
    sketches: DataFrame | None = None
    posted: DataFrame | None = postings
    every: list[DataFrame] = []
    tested: DataFrame | None = None

    steps: list[DataFrame] = []

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (sketches.select(F.col("node").alias(x), F.col("sk").alias(f"s{x}"), F.col("size").alias(f"n{x}")) for x in "ab")
        both = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - TINY)
        both = both.withColumn("exact", F.greatest("na", "nb") <= k).withColumn("all", F.array_union("sa", "sb")).withColumn("u", F.slice(F.array_sort("all"), 1, k)).withColumn("i", F.array_intersect("sa", "sb"))
        near = both.where(F.when(F.col("exact"), F.size("i") / F.size("all") >= threshold).otherwise(F.size(F.array_intersect("u", "i")) >= F.lit(floor) * F.size("u"))).select("a", "b", "exact")
        near = scratch.write(near)
        steps.append(near)
        sure = near.where("exact").select("a", "b")
        if texts is None:
            return sure
        ta, tb = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        held = near.where("not exact").join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(width, threshold), "a long, b long, jaccard double")
        return sure.unionByName(held.select("a", "b"))

    turn, slices, at, before = 0, 0, 0, None
    while whole and at <= slices:
        turn += 1
        if comps is None:
            labelled = postings.withColumn("comp", F.col("node"))
        else:
            labelled = postings.join(comps, "node", "left").select(*LIST, "side", "node", F.coalesce("comp", "node").alias("comp"))
        sides = [F.count(F.when(F.col("side") == x, 1)).alias(f"n{x}") for x in (EITHER, FIRST, SECOND)]
        per = labelled.groupBy(*LIST, "comp").agg(*sides).groupBy(*LIST).agg(*[F.sum(f"n{x}").alias(f"n{x}") for x in (EITHER, FIRST, SECOND)], F.sum(F.expr(MEETINGS)).alias("inside"))
        per = per.select(*LIST, (F.expr(MEETINGS) - F.col("inside")).alias("open")).where("open > 0")
        if not slices:
            pairs_left = int(per.agg(F.sum("open")).first()[0] or 0) // 2
            if not pairs_left:
                break
            if turn > 1 and (pairs_left <= PAIRS_PER_POSTING * whole or pairs_left > LEFT_BY_LEADERS * before):
                slices = math.ceil(pairs_left / (PAIRS_PER_POSTING * whole))
            before = pairs_left
        labelled = labelled.join(per.select(*LIST), LIST, "left_semi")
        if slices:
            at += 1
            x, y = (labelled.select(*LIST, F.col("side").alias(f"s{x}"), F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
            if slices > 1:
                x = x.where(F.pmod(F.xxhash64("a", F.lit("slice")), F.lit(slices)) == at - 1)
            pairs = x.join(y, LIST).where("a < b and ca <> cb").where((F.col("sa") != F.col("sb")) | (F.col("sa") == EITHER)).select("a", "b").distinct()
        else:
            labelled = scratch.write(labelled)
            if sketches is None:
                # Only nodes that meet another in a list can be in a pair, now or in a later turn; two whole ones need no texts. A node has
                # one (rk, rk2), so repeated rows go where the join has put them, without another shuffle of texts.
                sketches = scratch.write(nodes.join(labelled.select("node").distinct(), "node", "left_semi").select("node", "size", "sk"))
                read = labelled.where(F.col("kind") != WHOLE).select("node").distinct()
                if not read.isEmpty():
                    involved = nodes.join(read, "node", "left_semi").select("rk", "rk2", "node")
                    texts = scratch.write(source.select("rk", "rk2", "text").join(involved, ["rk", "rk2"]).dropDuplicates(["rk", "rk2"]).select("node", "text"))
            lead = labelled.groupBy(*LIST).agg(F.min(F.struct("side", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "comp")).alias("lead"))
            led = scratch.write(labelled.join(lead, LIST).select(*LIST, "side", "node", "comp", F.col("lead.node").alias("leader"), F.col("lead.comp").alias("lc"), F.col("lead.side").alias("ls")))
            scratch.drop(labelled)
            pairs = led.where("comp <> lc").where((F.col("side") != F.col("ls")) | (F.col("side") == EITHER)).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs)
        found = scratch.write(verified(pairs))
        scratch.drop(*steps)
        steps.clear()
        if at:
            scratch.drop(pairs)  # no later slice has its pairs
        else:
            every.append(pairs)
            tested = pairs if tested is None else tested.unionByName(pairs)
        # Components of the edges so far: those of the earlier ones are edges from each node to its component.
        known = found if comps is None else found.select("a", "b").unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        new = components(known, scratch)
        scratch.drop(found, *([comps] if comps is not None else []))
        comps = new
        if at:
            if at == slices:
                break
            continue
        scratch.drop(posted)
        posted = led
        postings = led.where("node <> leader").select(*LIST, "side", "node")

    grouped = nodes.select("node", "copies")
    if comps is None:
        grouped = grouped.withColumn("comp", F.col("node"))
    else:
        grouped = grouped.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # A group of several nodes, or one node of several rows.
    sizes = grouped.groupBy("comp").agg(F.sum("copies").alias("n")).where("n > 1")
    members = grouped.join(sizes, "comp").join(nodes.select("node", "f1", "f2"), "node").select("f1", "f2", F.col("comp").alias("group"), "n")
    out = scratch.write(rows.where("f1 is not null").select("rk", "rk2", "id", "f1", "f2").join(members, ["f1", "f2"]).select("rk", "rk2", "id", "group", "n"))
    scratch.drop(rows, nodes, *every, *[x for x in (posted, comps, texts, sketches) if x is not None])
    return out, scratch


def _first_rows(found: DataFrame) -> DataFrame:
    """Rows (group, low, first) with the smallest id and the sort key of the row that stays: a partial aggregate per group."""
    key = F.struct(F.col("id").isNull().alias("none"), "id", "rk", "rk2")
    return found.groupBy("group").agg(F.min("id").alias("low"), F.min(key).alias("first"))


def duplicate_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per document with a near copy: doc_id, group_id, group_size and whether it is the one kept.

    ``group_id`` is the smallest id of the group, and the row with it is kept;
    where it occurs in several rows, one of the smallest row key. A group of rows
    without any id has a null ``group_id``.
    """
    found, _ = near_duplicates(docs, **options)
    first = _first_rows(found)
    named = found.join(first, "group")
    # Of repeated rows with the key of the first, one is kept: only they are numbered.
    best = (F.col("rk") == F.col("first.rk")) & (F.col("rk2") == F.col("first.rk2"))
    cols = [F.col("id").alias("doc_id"), F.col("low").alias("group_id"), F.col("n").alias("group_size")]
    others = named.where(~best).select(*cols, F.lit(False).alias("kept"))
    kept = named.where(best).groupBy("group", "id", "low", "n").agg(F.count("*").alias("c"))
    kept = kept.select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("i")).select("doc_id", "group_id", "group_size", (F.col("i") == 1).alias("kept"))
    return others.unionByName(kept)


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents without all but one of each group; columns and other rows stay as they are.

    The one that stays has the smallest id (null last), then the smallest row key. Of
    repeated rows exactly one stays.
    """
    found, scratch = near_duplicates(docs, id_column, text_column, **options)
    named = found.join(_first_rows(found).select("group", "first"), "group").withColumn("stay", (F.col("rk") == F.col("first.rk")) & (F.col("rk2") == F.col("first.rk2")))
    key, key2 = free_name(docs.columns, "__rk"), free_name(docs.columns, "__rk2")
    fate = scratch.write(named.groupBy(F.col("rk").alias(key), F.col("rk2").alias(key2)).agg(F.max("stay").alias("stay"), F.count("*").alias("rows")).where("not stay or rows > 1"))
    scratch.drop(found)
    keyed = docs.withColumns({key: row_key(id_column, text_column), key2: second_key(id_column, text_column)})
    out = keyed.join(fate.select(key, key2), [key, key2], "left_anti")
    once = fate.where("stay").select(key, key2)
    if not once.isEmpty():
        out = out.unionByName(keyed.join(once, [key, key2], "left_semi").dropDuplicates([key, key2]))
    return out.select(*docs.columns)
