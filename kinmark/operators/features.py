"""What the rules need to know of a record, computed once per record before any pair is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from . import lists


def feature_struct(r: str = "", titles: tuple[str, ...] | list[str] = lists.TITLES, fragments: tuple[str, ...] | list[str] = lists.FRAGMENTS) -> Column:
    """Struct of features of the record whose fields are columns (or fields of struct ``r``)."""
    f = lambda name: F.col(f"{r}.{name}" if r else name)
    title, doi = F.coalesce(f("title"), F.lit("")), f("ext_ids.doi")
    lower = F.lower(title)
    names = F.coalesce(F.transform(f("contribs"), lambda c: c["raw_name"]), F.array().cast("array<string>"))
    slugs = F.array_distinct(F.transform(F.filter(names, lambda n: n.isNotNull() & (n != "")), s.slug))
    first5 = F.slice(F.sort_array(slugs), 1, 5)
    related = F.transform(F.filter(f("extra.datacite.relations"), lambda x: F.lower(x["relatedIdentifierType"]) == "doi"), lambda x: x["relatedIdentifier"])
    prefix = F.when(F.instr(doi, F.lit("/")) > 0, F.substring_index(doi, "/", 1))
    fragment = F.lit(False)
    for phrase in fragments:
        fragment = fragment | F.contains(lower, F.lit(phrase.lower()))
    return F.struct(
        f("ident").alias("ident"), f("work_id").alias("work_id"), f("title").alias("title"), title.alias("t"), lower.alias("tl"), s.slug(title).alias("slug"), doi.alias("doi"), s.clean_doi(doi).alias("cdoi"), prefix.alias("pre"),
        f("ext_ids.arxiv").alias("arxiv"), f("ext_ids.pmid").alias("pmid"), f("ext_ids.jstor").alias("jstor"), f("release_type").alias("kind"), f("container_id").alias("cid"), f("release_year").alias("year"),
        s.parse_pages(f("pages"))["count"].alias("pages"), f("extra.container_name").alias("cname"), f("extra.subtitle").isNotNull().alias("has_sub"),
        F.coalesce(F.transform(f("extra.subtitle"), s.slug), F.array().cast("array<string>")).alias("subs"), f("extra.crossref.type").alias("crossref"), f("extra.datacite.metadataVersion").alias("version"),
        f("extra.datacite").isNotNull().alias("datacite"), F.coalesce(related, F.array().cast("array<string>")).alias("related"), F.sort_array(F.array_distinct(names)).alias("authors"), slugs.alias("sauthors"),
        F.transform(first5, lambda n: F.array_distinct(s.token_ngrams(n))).alias("grams"), F.array_distinct(F.regexp_extract_all(F.array_join(slugs, " "), F.lit(r"\w{3,}"), F.lit(0))).alias("atoks"),
        lower.isin(list(titles)).alias("denied") if len(titles) else F.lit(False).alias("denied"), fragment.alias("fragment"),
    )


def with_features(records: DataFrame, **options) -> DataFrame:
    """Rows (ident, f) with the features of each record."""
    return records.select("ident", feature_struct(**options).alias("f"))
