"""Command line: ``spark-submit -m`` or ``python -m kinmark.cli VERB ...`` with the verbs cluster, verify, verify_ref, verify_single, release_match and unstructured."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.citations import citation
from .operators import cluster, lists
from .operators.closest import closest_match, releases_of_citations
from .operators.features import with_features
from .operators.match import match_releases, resolve_strings, sample_pair
from .operators.refs import verify_refs
from .operators.rules import verify_pairs
from .sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinmark", description=__doc__)
    p.add_argument("--titles", help="file of titles that say nothing, one per line")
    p.add_argument("--out", help="folder for the result; without it lines are shown")
    verbs = p.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("cluster", help="group records by a key of their title")
    v.add_argument("-f", "--file", required=True)
    v.add_argument("-t", "--type", default="slug", choices=sorted(cluster.KEYS))
    v.add_argument("--min-cluster-size", type=int, default=2)
    v.add_argument("--max-cluster-size", type=int, help="larger clusters are left out; all are kept unless this is given")
    v = verbs.add_parser("verify", help="verify all pairs of each cluster document")
    v.add_argument("-f", "--file", required=True)
    v.add_argument("--max-cluster-size", type=int, default=10)
    v.add_argument("--counts", action="store_true", help="counts by reason instead of pairs")
    v = verbs.add_parser("verify_ref", help="verify the references of each group")
    v.add_argument("-f", "--file", required=True)
    v = verbs.add_parser("verify_single", help="verify two records, or two at random")
    v.add_argument("--catalog", required=True)
    v.add_argument("-a")
    v.add_argument("-b")
    v.add_argument("--seed", type=int, default=0)
    v = verbs.add_parser("release_match", help="candidates for idents, ISSNs, Q numbers or titles")
    v.add_argument("--catalog", required=True)
    v.add_argument("--value", required=True, nargs="+")
    v.add_argument("--size", type=int, default=5)
    v.add_argument("--json", action="store_true")
    v = verbs.add_parser("unstructured", help="closest matches of parsed citations (XML files)")
    v.add_argument("--catalog", required=True)
    v.add_argument("-f", "--file", required=True)
    return p


def plan(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The lines that a command gives."""
    titles = {"titles": lists.load_titles(spark, a.titles)} if a.titles else {}
    if a.verb == "cluster":
        docs = cluster.cluster_documents(io.read_releases(spark, a.file), a.type, a.min_cluster_size, a.max_cluster_size)
        return docs.select(io.to_json_column().alias("value"))
    if a.verb == "verify":
        clusters = io.read_clusters(spark, a.file)
        pairs = cluster.verify_clusters(clusters, a.max_cluster_size, **titles)
        return cluster.group_counters(clusters, pairs, a.max_cluster_size).select(F.concat_ws("\t", "counter", "n").alias("value")) if a.counts else io.pair_lines(pairs)
    if a.verb == "verify_ref":
        return io.pair_lines(verify_refs(io.read_clusters(spark, a.file), **titles))
    catalog = io.read_releases(spark, a.catalog)
    if a.verb == "verify_single":
        if (a.a is None) != (a.b is None):
            raise SystemExit("both -a and -b are needed, or neither")
        two = sample_pair(catalog, seed=a.seed) if a.a is None else catalog.where(F.col("ident").isin(a.a, a.b))
        f = with_features(two, **titles)
        x, y = f.select(F.col("ident").alias("ia"), F.col("f").alias("a")), f.select(F.col("ident").alias("ib"), F.col("f").alias("b"))
        pair = x.crossJoin(y).where("ia < ib" if a.a is None else (F.col("ia") == a.a) & (F.col("ib") == a.b))
        return io.verdict_json(verify_pairs(pair).select(F.col("ia").alias("a"), F.col("ib").alias("b"), "status", "reason"))
    if a.verb == "release_match":
        named = resolve_strings(spark.createDataFrame([(v,) for v in a.value], "text string"), catalog)
        known = catalog.join(named.where("ident is not null").select("ident"), "ident", "left_semi")
        by_title = named.where("class = 'title'").select(F.col("text").alias("ident"), F.col("text").alias("title"))
        queries = known.unionByName(by_title, allowMissingColumns=True)
        found = match_releases(queries, catalog, a.size)
        return io.match_json(queries, found, catalog).select("value") if a.json else io.match_tsv(found.join(catalog, "ident").orderBy("query", "rank"))
    refs = spark.read.text(a.file, wholetext=True).select(F.xxhash64("value").cast("string").alias("ident"), citation("value").alias("ref"))
    return io.citation_tsv(closest_match(releases_of_citations(refs), catalog, **titles))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("kinmark").getOrCreate()
    lines = plan(spark, a)
    if a.out:
        io.write_lines(lines, a.out)
    else:
        for row in lines.toLocalIterator():
            print(row.value)
    return 0


if __name__ == "__main__":
    sys.exit(main())
