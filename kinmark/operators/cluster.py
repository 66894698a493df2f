"""Clusters of records by key, pairs inside clusters, and what verification counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions import slugs
from . import lists
from .features import feature_struct
from .rules import Rule, verify_pairs

#: Key functions by name; users add their own.
KEYS: dict[str, Callable[[Column], Column]] = {
    "title": lambda t: t,
    "lowercase": F.lower,
    "slug": s.slug,
    "scorable": slugs.scorable_slug,
    "nysiis": slugs.nysiis,
}


def keyed(records: DataFrame, key: str | Callable[[Column], Column] = "slug", title: str = "title") -> DataFrame:
    """The records with their key in column ``k``."""
    return records.withColumn("k", (KEYS[key] if isinstance(key, str) else key)(F.col(title)))


def usable(k: str = "k", denied: list[str] | tuple[str, ...] = ()) -> Column:
    good = F.col(k).isNotNull() & (F.col(k) != "")
    return good & ~F.col(k).isin(list(denied)) if denied else good


def cluster_members(records: DataFrame, key: str | Callable[[Column], Column] = "slug", min_size: int = 1, max_size: int | None = None, denied: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The records in clusters of an allowed size, with k and the cluster's size n.

    Sizes come from a partial aggregate; only keys of an allowed size meet their records again.
    """
    own = keyed(records, key).where(usable(denied=denied))
    sizes = own.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    if max_size is not None:
        sizes = sizes.where(F.col("n") <= max_size)
    return own.join(sizes, "k")


def _tie(records: DataFrame) -> list[Column]:
    """What orders records whose order column is null (first of all) or equal: a hash of the whole record, of equal ones too."""
    return [F.xxhash64(*records.columns).alias("tie")]


def cluster_documents(records: DataFrame, key: str | Callable[[Column], Column] = "slug", min_size: int = 1, max_size: int | None = None, order: str = "ident", denied: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row (k, v) per cluster, v its records in order (null first, ties by a hash of the record), of any size unless ``max_size`` is given: larger ones are left out before they are gathered."""
    members = cluster_members(records, key, min_size, max_size, denied)
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), *_tie(records), F.struct(*records.columns).alias("r"))))
    return members.groupBy("k").agg(packed.alias("v")).select("k", F.transform("v", lambda x: x["r"]).alias("v"))


def cluster_sizes(records: DataFrame, key: str | Callable[[Column], Column] = "slug") -> DataFrame:
    """Number of clusters of each size."""
    own = keyed(records, key).where(usable())
    return own.groupBy("k").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def cluster_counters(records: DataFrame, key: str | Callable[[Column], Column] = "slug", denied: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row: key_fail (no title), key_empty, key_denylist, key_ok, num_clusters."""
    own = keyed(records, key).groupBy("k").agg(F.count("*").alias("n"))
    fail, empty = F.col("k").isNull(), F.col("k") == ""
    off = F.col("k").isin(list(denied)) if denied else F.lit(False)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return own.agg(n(fail).alias("key_fail"), n(empty).alias("key_empty"), n(~empty & off).alias("key_denylist"), n(~empty & ~off).alias("key_ok"), F.count_if(~empty & ~off).cast("long").alias("num_clusters"))


def pairs_within(records: DataFrame, key: str | Callable[[Column], Column] = "slug", max_size: int = 10, order: str = "ident", **options) -> DataFrame:
    """Rows (k, a, b) of feature structs for each two records of a cluster, the first in order as ``a``.

    Clusters above ``max_size`` give none, so a key has at most max_size^2 / 2 pairs whatever the corpus.
    Features are made once per record and both sides of the join read the one shuffle by k.
    """
    members = cluster_members(records, key, 2, max_size).withColumn("pos", F.row_number().over(W.partitionBy("k").orderBy(order, *_tie(records))))
    own = members.select("k", "pos", feature_struct(**options).alias("f"))
    a, b = own.select("k", F.col("pos").alias("pa"), F.col("f").alias("a")), own.select("k", F.col("pos").alias("pb"), F.col("f").alias("b"))
    return a.join(b, "k").where("pa < pb").select("k", "a", "b")


def pairs_of_documents(clusters: DataFrame, max_size: int = 10, **options) -> DataFrame:
    """The same for (k, v) documents as they are read: map-only, in the order of v."""
    sized = clusters.where(F.size("v").between(2, max_size)).select("k", "v", F.posexplode("v").alias("pos", "r"))
    one = sized.select("k", "r", F.slice("v", F.col("pos") + 2, F.size("v")).alias("rest")).where(F.size("rest") > 0)
    first = one.select("k", feature_struct("r", **options).alias("a"), "rest")
    return first.select("k", "a", F.explode("rest").alias("r2")).select("k", "a", feature_struct("r2", **options).alias("b"))


def verify_clusters(clusters: DataFrame, max_size: int = 10, rules: list[Rule] | None = None, **options) -> DataFrame:
    """Rows (k, ident_a, ident_b, status, reason) of (k, v) documents."""
    pairs = pairs_of_documents(clusters, max_size, **options).select("k", F.col("a.ident").alias("ident_a"), F.col("b.ident").alias("ident_b"), "a", "b")
    return verify_pairs(pairs, rules)


def reason_counts(verified: DataFrame) -> DataFrame:
    """Pairs by status and reason, and a row of nulls with the total."""
    return verified.rollup("status", "reason").agg(F.count("*").alias("pairs"), F.grouping_id().alias("g")).where("g in (0, 3)").drop("g")


def _counters(sizes: DataFrame, met: DataFrame, verified: DataFrame, max_size: int, containers: tuple[str, ...] = lists.CONTAINERS, publishers: tuple[str, ...] = lists.PUBLISHERS) -> DataFrame:
    """Rows (counter, n) from the sizes n of all clusters, the records met in pairs (size, r), and the verified pairs."""
    counted = sizes.select(F.explode(F.array_compact(F.array(F.when(F.col("n") < 2, "singular_cluster"), F.when(F.col("n") > max_size, "max_cluster_size_exceeded")))).alias("counter")).groupBy("counter").agg(F.count("*").alias("n"))
    container = F.lower(F.trim(F.coalesce("r.extra.container_name", F.lit("")))).isin(list(containers))
    publisher = F.lower(F.trim(F.coalesce("r.publisher", F.lit("")))).isin(list(publishers))
    # A record is met once in each pair of its cluster.
    blocked = met.select(F.when(container, "container_name_blacklist").when(publisher, "publisher_blacklist").alias("counter"), (F.col("size") - 1).alias("m")).where("counter is not null").groupBy("counter").agg(F.sum("m").alias("n"))
    reasons = verified.groupBy(F.col("reason").alias("counter")).agg(F.count("*").alias("n"))
    every = counted.unionByName(blocked).unionByName(reasons)
    return every.unionByName(every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("counter"), "n"))


def group_counters(clusters: DataFrame, verified: DataFrame, max_size: int = 10, **blocked: tuple[str, ...]) -> DataFrame:
    """Rows (counter, n): pairs by reason, clusters that were too small or too large, blocked records met in pairs, and the total of all."""
    met = clusters.where(F.size("v").between(2, max_size)).select(F.size("v").alias("size"), F.explode("v").alias("r"))
    return _counters(clusters.select(F.size("v").alias("n")), met, verified, max_size, **blocked)


def record_counters(records: DataFrame, key: str | Callable[[Column], Column] = "slug", max_size: int = 10, rules: list[Rule] | None = None, containers: tuple[str, ...] = lists.CONTAINERS, publishers: tuple[str, ...] = lists.PUBLISHERS, **options) -> DataFrame:
    """The same from records: clusters of every size are counted from the size aggregate, and none is gathered in one row."""
    sizes = keyed(records, key).where(usable()).groupBy("k").agg(F.count("*").alias("n"))
    met = cluster_members(records, key, 2, max_size).select(F.col("n").alias("size"), F.struct("publisher", "extra").alias("r"))
    return _counters(sizes, met, verify_pairs(pairs_within(records, key, max_size, **options).select("a", "b"), rules), max_size, containers, publishers)


def without_blocked(records: DataFrame, containers: tuple[str, ...] = lists.CONTAINERS, publishers: tuple[str, ...] = lists.PUBLISHERS) -> DataFrame:
    """Records whose container or publisher isn't on the block lists (counting only is the default elsewhere)."""
    return records.where(~F.lower(F.trim(F.coalesce("extra.container_name", F.lit("")))).isin(list(containers)) & ~F.lower(F.trim(F.coalesce("publisher", F.lit("")))).isin(list(publishers)))
