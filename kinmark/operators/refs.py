"""Groups of one release and the references to it: each reference is compared with the release only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import keyed, usable
from .features import feature_struct
from .rules import Rule, verify_pairs


def split_groups(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, pivot, refs) of the groups that have a release, and the other groups as they are.

    The pivot is the first member without a status; members with any status but ``ref`` are ignored.
    """
    pivot = F.get(F.filter("v", lambda r: r["extra"]["skate"]["status"].isNull()), F.lit(0))
    refs = F.filter("v", lambda r: r["extra"]["skate"]["status"] == "ref")
    parts = groups.withColumn("pivot", pivot)
    return parts.where("pivot is not null").select("k", "pivot", refs.alias("refs")), parts.where("pivot is null").select(*groups.columns)


def verify_refs(groups: DataFrame, rules: list[Rule] | None = None, **options) -> DataFrame:
    """Rows (k, ident_a, ident_b, status, reason), one per reference; map-only."""
    found, _ = split_groups(groups)
    one = found.select("k", feature_struct("pivot", **options).alias("a"), "refs").select("k", "a", F.explode("refs").alias("r")).select("k", "a", feature_struct("r", **options).alias("b"))
    return verify_pairs(one.select("k", F.col("a.ident").alias("ident_a"), F.col("b.ident").alias("ident_b"), "a", "b"), rules)


def verify_keyed_refs(records: DataFrame, key: str | Callable[[Column], Column] = "slug", order: str = "ident", rules: list[Rule] | None = None, **options) -> DataFrame:
    """The same from records, whatever the size of a group: an equi-join of pivots and references by key.

    The pivot is the first record without a status in ``order``. A partial aggregate finds it, so no group is gathered in one row.
    """
    own, status = keyed(records, key).where(usable()), F.col("extra.skate.status")
    pivots = own.where(status.isNull()).groupBy("k").agg(F.min_by(F.struct(*records.columns), order).alias("pivot")).select("k", feature_struct("pivot", **options).alias("a"))
    cited = own.where(status == "ref").select("k", feature_struct(**options).alias("b"))
    return verify_pairs(pivots.join(cited, "k").select("k", F.col("a.ident").alias("ident_a"), F.col("b.ident").alias("ident_b"), "a", "b"), rules)
