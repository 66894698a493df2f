"""From query records, flat metadata or parsed citations to verified matches, closest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as s
from .features import with_features
from .match import match_releases
from .rules import Rule, verify_pairs

STATUS_ORDER = {"todo": 0, "exact": 10, "strong": 20, "weak": 30, "ambiguous": 40, "different": 60}


def status_rank(status: Column) -> Column:
    out = F.lit(99)
    for name, n in STATUS_ORDER.items():
        out = F.when(status == name, n).otherwise(out)
    return out


def close_matches(queries: DataFrame, catalog: DataFrame, match_limit: int = 5, rules: list[Rule] | None = None, **options) -> DataFrame:
    """Rows (query, ident, status, reason, place): verified candidates that aren't different, by status and then by candidate rank."""
    found = match_releases(queries, catalog, match_limit)
    a = with_features(queries, **options).select(F.col("ident").alias("query"), F.col("f").alias("a"))
    b = with_features(catalog, **options).select("ident", F.col("f").alias("b"))
    judged = verify_pairs(found.select("query", "ident", "rank").join(a, "query").join(b, "ident"), rules).where("status not in ('todo', 'different')")
    place = F.row_number().over(W.partitionBy("query").orderBy(status_rank(F.col("status")), "rank"))
    return judged.withColumn("place", place).select("query", "ident", "status", "reason", "place")


def closest_match(queries: DataFrame, catalog: DataFrame, match_limit: int = 5, **options) -> DataFrame:
    """The first of ``close_matches`` for each query that has any."""
    return close_matches(queries, catalog, match_limit, **options).where("place = 1").drop("place")


def _ids(**known: Column) -> Column:
    from ..schema import EXT_IDS, ID_TYPES

    return F.struct(*[known.get(t, F.lit(None)).cast("string").alias(t) for t in ID_TYPES]).cast(EXT_IDS)


def _record(ident: Column, title, contribs, year, ids, extra_name, **fields) -> list[Column]:
    from ..schema import AUTHOR, EXTRA

    get = lambda n: fields.get(n, F.lit(None)).cast("string").alias(n)
    extra = F.when(extra_name.isNotNull(), F.struct(extra_name.cast("string"), F.lit(None).cast("array<string>"), F.lit(None).cast("struct<type:string>"), F.lit(None).cast("struct<metadataVersion:int,relations:array<struct<relatedIdentifier:string,relatedIdentifierType:string,relationType:string>>>"), F.lit(None).cast("struct<status:string>")).cast(EXTRA))
    return [
        ident.cast("string").alias("ident"), get("work_id"), get("container_id"), title.cast("string").alias("title"), get("release_type"), get("release_stage"), year.cast("int").alias("release_year"), get("publisher"),
        get("volume"), get("issue"), get("pages"), contribs.cast(f"array<{AUTHOR}>").alias("contribs"), ids.alias("ext_ids"), extra.alias("extra"),
    ]


def releases_of_biblio(biblio: DataFrame, ident: str = "ident", with_contribs: bool = True) -> DataFrame:
    """Flat metadata as records. ``with_contribs=False`` matches by title alone."""
    named = F.transform("authors", lambda a: F.struct(a["name"].alias("raw_name"), a["given_name"].alias("given_name"), a["surname"].alias("surname")))
    plain = lambda names: F.transform(names, lambda n: F.struct(n.alias("raw_name"), F.lit(None).cast("string").alias("given_name"), F.lit(None).cast("string").alias("surname")))
    contribs = F.when(F.size("authors") > 0, named).when(F.size("author_names") > 0, plain(F.col("author_names"))).when(F.col("first_author") != "", plain(F.array("first_author")))
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    return biblio.select(
        *_record(
            F.col(ident), F.col("title"), contribs if with_contribs else F.lit(None), s.year_or_date("year", "date"), _ids(doi=s.clean_doi("doi"), pmid=F.col("pmid"), pmcid=F.col("pmcid"), arxiv=F.col("arxiv_id")), first("journal", "conference"),
            volume=F.col("volume"), issue=F.col("issue"), pages=first("pages", "first_page"), publisher=F.col("publisher"), release_stage=F.col("release_stage"), release_type=F.col("release_type"),
        )
    )


def releases_of_citations(refs: DataFrame, ident: str = "ident") -> DataFrame:
    """Parsed citations (``functions.citations.citation`` in column ref) as records; those that didn't parse are left out."""
    contribs = F.transform("ref.authors", lambda a: F.struct(a["name"].alias("raw_name"), a["given_name"].alias("given_name"), a["surname"].alias("surname")))
    return refs.where("ref is not null").select(
        *_record(
            F.col(ident), F.col("ref.title"), F.coalesce(contribs, F.array()), s.year_of("ref.date"), _ids(doi=s.clean_doi("ref.doi"), pmid=F.col("ref.pmid"), pmcid=F.col("ref.pmcid"), arxiv=F.col("ref.arxiv_id")), F.nullif(F.col("ref.journal"), F.lit("")),
            volume=F.col("ref.volume"), issue=F.col("ref.issue"), pages=F.col("ref.pages"),
        )
    )
