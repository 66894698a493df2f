"""Queries over record pairs that reach every rule.

Each document meets one of the variants below, by its id: two records made of its first line ({t}) and its id ({i})
that differ as one rule wants. Spark and SQL read the same list; the verdicts are worked out on either side for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, lists, refs
from ..schema import AUTHOR, EXT_IDS, EXTRA, ID_TYPES, RELEASE_STRUCT
from . import queries as q

FIELDS = "title names doi arxiv pmid jstor work cid kind year pages cname sub crossref version rel publisher".split()
LONG, SHORT = "{t} a study of something long", "A study of some things"
_OTHER = {"names": "Bob Ray"}
_NOBODY = {"names": ""}


def _article(reason: str, a: dict, b: dict) -> tuple[str, dict, dict]:
    base = {"title": LONG, "names": "Ann Lee"}
    return reason, base | a, base | b


#: (the rule aimed at, the first record, the second). A title with much in it may bring another rule first.
VARIANTS = [
    _article("doi", {"doi": "10.1/A{i}"}, {"doi": "doi:10.1/a{i}", "title": "another title {i}"}),
    _article("work_id", {"work": "w{i}"}, {"work": "w{i}", "title": "other {i} things"}),
    _article("short_title", {"title": "ab"}, {"title": "ab"}),
    _article("blacklisted", {"title": "Editorial"}, {"title": "Editorial"}),
    _article("blacklisted_fragment", {"title": "{t}, Minutes of the Meeting of 19{i}"}, {}),
    _article("container", {"title": "Subject Index {i}", "cid": "a{i}"}, {"title": "subject index 2", "cid": "b"}),
    _article("datacite_version", {"version": 1}, {"version": 2}),
    _article("custom_prefix_10_14288", {"doi": "10.14288/{i}"}, {"doi": "10.14288/{i}2"}),
    _article("custom_bsi_undated", {"doi": "10.3403/{i}"}, {"doi": "10.3403/{i}u"}),
    _article("custom_bsi_subdoc", {"doi": "10.3403/{i}", "sub": "s"}, {"doi": "10.3403/9{i}"}),
    _article("custom_iop_ma_pattern", {"doi": "10.1149/ma{i}"}, {"doi": "10.1149/{i}"}),
    _article("vhs", {"title": "Zweckverband Volkshochschule A{i}"}, {"title": "Zweckverband Volkshochschule B"}),
    _article("appendix", {"title": "Appendix A{i}"}, {"title": "Appendix B"}),
    _article("figshare_version", {"doi": "10.6084/m.{i}.v1"}, {"doi": "10.6084/m.{i}.v2"}),
    _article("versioned_doi", {"doi": "10.5/a{i}/v1"}, {"doi": "10.6/b/v2"}),
    _article("versioned_doi", {"doi": "10.5/a{i}.b"}, {"doi": "10.5/a{i}.b.s1"}),
    _article("datacite_related_id", {"doi": "10.5/a{i}", "rel": "10.5/zz"}, {"doi": "10.6/b{i}", "rel": "10.5/a{i}"}),
    _article("arxiv_version", {"arxiv": "{i}.5v1"}, {"arxiv": "{i}.5v2", "title": "Other thing altogether {i}"}),
    _article("release_type", {"kind": "book"}, {"kind": "chapter"}),
    _article("release_type", {"kind": "article"}, {"kind": "dataset"}),
    _article("dataset_doi", {"kind": "dataset", "doi": "10.5/a{i}"}, {"kind": "dataset", "doi": "10.5/b"}),
    _article("book_chapter", {"kind": "chapter", "cname": "a"}, {"kind": "chapter", "cname": "b{i}"}),
    _article("component", {"crossref": "component"}, {"title": LONG + " more"}),
    _article("component", {"kind": "component", "doi": "10.5/a{i}"}, {"kind": "component", "doi": "10.5/b"}),
    _article("year", {"year": 1950} | _NOBODY, {"title": LONG + "!", "year": 2000} | _NOBODY),
    _article("custom_ieee_arxiv", {"doi": "10.1109/x{i}"}, {"arxiv": "1"}),
    _article("custom_prefix_10_7916", {"doi": "10.7916/x{i}"}, {"doi": "10.7916/y"}),
    _article("subtitle", {"sub": "One"}, {"sub": "one|two {i}"}),
    _article("year", {"year": 2000}, {"year": 2005}),
    _article("title_author_match", {"year": 2000}, {"year": 2004}),
    _article("title_filename", {"title": "figure{i}.png"}, {"title": "table{i}.png"}),
    _article("year", {"year": 2000}, {"year": 2003} | _OTHER),
    _article("short_title", {"title": "A short"}, {"title": "Another one {i}"}),
    _article("num_diff", {"title": "Report number 12{i} of it"}, {"title": "Report number 13{i} of it"}),
    _article("preprint_published", {"arxiv": "{i}", "names": "Ann Lee|X Y"}, {}),
    _article("year", {"title": SHORT, "year": 1990}, {"title": "A study of something s", "year": 2000}),
    _article("slug_title_author_match", {"title": SHORT + " {i}"}, {"title": "A study of something s{i}"}),
    _article("pmid_doi_pair", {"pmid": "{i}"} | _NOBODY, {"doi": "10.5/x"} | _OTHER),
    _article("jstor_id", {"jstor": "1{i}"} | _NOBODY, {"jstor": "2"} | _OTHER),
    _article("shared_doi_prefix", {"doi": "10.5/xa{i}", "cid": "c"} | _NOBODY, {"doi": "10.5/yb", "cid": "c"} | _OTHER),
    _article("tokenized_authors", {"names": "Ann Marie Lee"}, {"names": "Lee Ann Marie"}),
    _article("jaccard_authors", {"names": "Kuidong Xu|Joong Choi|Ann Lee"}, {"names": "X Kuidong|Y Joong Choi"}),
    _article("contrib_intersection_empty", {}, _OTHER),
    _article("custom_prefix_10_5860_choice_review", {"doi": "10.5860/x{i}"} | _NOBODY, {"doi": "10.5/y"} | _OTHER),
    _article("page_count", {"pages": "1-20"} | _NOBODY, {"pages": "1-5"} | _OTHER),
    _article("title_artifact", {"cid": "c{i}"}, {"title": LONG + " (translated)", "cid": "c{i}"}),
    _article("unknown", {"cname": lists.CONTAINERS[0].upper()} | _NOBODY, {"publisher": " " + lists.PUBLISHERS[0]} | _OTHER),
]
_ROWS = [(n, side, *(None if r.get(f) is None else str(r[f]) for f in FIELDS)) for n, (_, a, b) in enumerate(VARIANTS) for side, r in (("a", a), ("b", b))]


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, side, r) with a record per side of each document's variant."""
    variants = F.broadcast(spark.createDataFrame(_ROWS, "n int, side string, " + ", ".join(f"{f} string" for f in FIELDS)))  # as many rows as the list above
    docs = q.table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("first"), F.pmod("doc_id", F.lit(len(VARIANTS))).cast("int").alias("n"))
    made = docs.join(variants, "n").select("doc_id", "side", *[F.replace(F.replace(F.col(f), F.lit("{i}"), F.col("doc_id").cast("string")), F.lit("{t}"), F.col("first")).alias(f) for f in FIELDS])
    none = F.lit(None).cast("string")
    many = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "[|]"))
    known = {t: F.col(t) for t in ("doi", "arxiv", "pmid", "jstor")}
    ids = F.struct(*[known.get(t, none).alias(t) for t in ID_TYPES]).cast(EXT_IDS)
    relations = F.when(F.col("rel").isNotNull(), F.array(F.struct(F.col("rel").alias("relatedIdentifier"), F.lit("DOI").alias("relatedIdentifierType"), none.alias("relationType"))))
    datacite = F.when(F.coalesce("version", "rel").isNotNull(), F.struct(F.col("version").cast("int").alias("metadataVersion"), relations.alias("relations")))
    status = F.when(F.col("side") == "b", F.struct(F.lit("ref").alias("status")))
    extra = F.struct(F.col("cname").alias("container_name"), many("sub").alias("subtitle"), F.when(F.col("crossref").isNotNull(), F.struct(F.col("crossref").alias("type"))).alias("crossref"), datacite.alias("datacite"), status.alias("skate")).cast(EXTRA)
    contribs = F.transform(many("names"), lambda n: F.struct(n, none, none)).cast(f"array<{AUTHOR}>")
    record: list[Column] = [
        F.concat("side", F.col("doc_id").cast("string")).alias("ident"), F.col("work").alias("work_id"), F.col("cid").alias("container_id"), "title", F.col("kind").alias("release_type"), none.alias("release_stage"), F.col("year").cast("int").alias("release_year"), "publisher",
        none.alias("volume"), none.alias("issue"), "pages", contribs.alias("contribs"), ids.alias("ext_ids"), extra.alias("extra"),
    ]
    return made.select("doc_id", "side", F.struct(*record).cast(RELEASE_STRUCT).alias("r"))


def pair_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, v) documents of the two records of each variant, the first one first."""
    both = sides(spark, sf_dir).groupBy("doc_id").agg(F.max_by("r", F.col("side") == "a").alias("a"), F.max_by("r", F.col("side") == "b").alias("b"))
    return both.select(F.col("doc_id").cast("string").alias("k"), F.array("a", "b").alias("v"))


# ---- The same in SQL


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _judged() -> str:
    slug = lambda x: q.SLUG_SQL.format(x=x)
    grams = q._GRAMS_SQL.format(t=q.TOKENS_SQL.format(x="n").replace("lambda x: x", "lambda y: y"))
    sim = q._JACCARD_SQL.format(a="x", b="y")
    both = lambda p: f"a.pre = '{p}' AND b.pre = '{p}'"
    gap = lambda g: f"a.year <> 0 AND b.year <> 0 AND abs(a.year - b.year) > {g}"
    kinds = lambda t: f"('{t}' IN (a.kind, b.kind) AND (a.kind IN ('article', 'article-journal') OR b.kind IN ('article', 'article-journal')))"
    preprints = "('article', 'article-journal', 'paper-conference', 'report')"
    same, differ = "a.slug = b.slug", "a.slug <> b.slug"
    authors = "a.tl = b.tl AND len(a.authors) > 0 AND a.authors = b.authors"
    shared = "len(list_intersect(a.sauthors, b.sauthors)) > 0"
    slug_match = f"a.slug <> '' AND replace(a.slug, ' ', '') = replace(b.slug, ' ', '') AND {shared}"
    strangers = "len(a.authors) > 0 AND len(list_intersect(a.sauthors, b.sauthors)) = 0"
    one = "regexp_full_match({r}.title, '\\s*\\S+\\s*')"
    denied = ", ".join(_literal(t) for t in lists.TITLES)
    cases = [
        ("exact doi", "a.cdoi = b.cdoi"),
        ("exact work_id", "a.work <> '' AND a.work = b.work"),
        ("ambiguous short_title", "length(a.title) < 5"),
        ("ambiguous blacklisted", f"a.tl IN ({denied})"),
        ("ambiguous blacklisted_fragment", " OR ".join(f"contains(a.tl, {_literal(x.lower())})" for x in lists.FRAGMENTS)),
        ("different container", "contains(a.tl, 'subject index') AND contains(b.tl, 'subject index') AND a.cid <> b.cid"),
        ("exact datacite_version", "a.title <> '' AND a.title = b.title AND a.version <> b.version"),
        ("different custom_prefix_10_14288", "starts_with(a.doi, '10.14288/') AND starts_with(b.doi, '10.14288/') AND a.doi <> b.doi"),
        ("strong custom_bsi_undated", f"{both('10.3403')} AND (a.doi || 'u' = b.doi OR b.doi || 'u' = a.doi)"),
        ("strong custom_bsi_subdoc", f"{both('10.3403')} AND a.title = b.title AND (a.sub IS NULL) <> (b.sub IS NULL)"),
        ("different custom_iop_ma_pattern", f"{both('10.1149')} AND starts_with(a.doi, '10.1149/ma') <> starts_with(b.doi, '10.1149/ma')"),
        ("different vhs", "contains(a.title, 'Zweckverband Volkshochschule ') AND a.title <> b.title"),
        ("ambiguous appendix", "regexp_matches(a.tl, '^appendix ?[^ ]*$')"),
        ("strong figshare_version", "starts_with(a.doi, '10.6084/') AND starts_with(b.doi, '10.6084/') AND regexp_replace(a.doi, '[.]v[0-9]+$', '') = regexp_replace(b.doi, '[.]v[0-9]+$', '')"),
        ("strong versioned_doi", "regexp_matches(a.doi, '^10[.].*/v[0-9]+$') AND regexp_matches(b.doi, '^10[.].*/v[0-9]+$')"),
        ("strong versioned_doi", "(contains(a.doi, '.') AND regexp_replace(a.doi, '[.][^.]*$', '') = b.doi) OR (contains(b.doi, '.') AND regexp_replace(b.doi, '[.][^.]*$', '') = a.doi)"),
        ("strong datacite_related_id", "(a.version IS NOT NULL OR a.rel IS NOT NULL) AND (b.version IS NOT NULL OR b.rel IS NOT NULL) AND b.doi IS NOT NULL AND (coalesce(a.rel = b.doi, FALSE) OR coalesce(b.rel = a.doi, FALSE))"),
        ("strong arxiv_version", "regexp_matches(a.arxiv, 'v[0-9]+$') AND regexp_matches(b.arxiv, 'v[0-9]+$') AND regexp_replace(a.arxiv, 'v[0-9]+$', '') = regexp_replace(b.arxiv, 'v[0-9]+$', '')"),
        ("different release_type", f"a.kind <> b.kind AND ((a.kind NOT IN {preprints} AND b.kind NOT IN {preprints}) OR {kinds('dataset')} OR {kinds('book')})"),
        ("different dataset_doi", "a.kind = 'dataset' AND b.kind = 'dataset' AND a.doi <> b.doi"),
        ("different book_chapter", "a.kind = 'chapter' AND b.kind = 'chapter' AND a.cname <> b.cname"),
        ("different component", "a.crossref = 'component' AND a.title <> b.title"),
        ("different component", "a.kind = 'component' AND b.kind = 'component' AND a.doi <> b.doi"),
        ("different year", f"{same} AND {gap(40)}"),
        ("strong custom_ieee_arxiv", f"{same} AND ((a.pre = '10.1109' AND b.arxiv <> '') OR (b.pre = '10.1109' AND a.arxiv <> ''))"),
        ("ambiguous custom_prefix_10_7916", f"{same} AND {both('10.7916')}"),
        ("different subtitle", f"{same} AND len(a.subs) > 0 AND len(b.subs) > 0 AND len(list_distinct(list_concat(a.subs, b.subs))) > 1"),
        ("different year", f"{authors} AND {gap(4)}"),
        ("exact title_author_match", authors),
        ("different title_filename", f"(({one.format(r='a')} AND regexp_matches(a.title, '^.*[.][a-z]{{2,3}}')) OR ({one.format(r='b')} AND regexp_matches(b.title, '^.*[.][a-z]{{2,3}}$'))) AND a.title <> b.title"),
        ("different year", f"a.title <> '' AND a.title = b.title AND {gap(2)}"),
        ("ambiguous short_title", f"length(a.slug) < 10 AND {differ}"),
        ("different num_diff", f"regexp_matches(a.slug, '[0-9]') AND {differ} AND regexp_replace(a.slug, '[0-9]+', '#', 'g') = regexp_replace(b.slug, '[0-9]+', '#', 'g')"),
        ("strong preprint_published", f"{same} AND a.slug <> '' AND len(list_intersect(a.authors, b.authors)) > 0 AND (a.arxiv IS NULL) <> (b.arxiv IS NULL)"),
        ("different year", f"{slug_match} AND {gap(4)}"),
        ("strong slug_title_author_match", slug_match),
        ("strong pmid_doi_pair", "a.year IS NOT DISTINCT FROM b.year AND a.tl = b.tl AND ((a.pmid IS NOT NULL AND b.doi IS NOT NULL) OR (b.pmid IS NOT NULL AND a.doi IS NOT NULL))"),
        ("different jstor_id", "a.jstor <> b.jstor"),
        ("different shared_doi_prefix", "a.cid = b.cid AND a.doi <> b.doi AND a.pre = b.pre AND a.pre <> '10.1126'"),
        ("strong tokenized_authors", f"{strangers} AND len(a.grams) > 0 AND len(b.grams) > 0 AND list_sum(list_transform(a.grams, lambda x: list_max(list_transform(b.grams, lambda y: {sim})))) / len(a.grams) > CASE WHEN least(len(a.grams), len(b.grams)) < 3 THEN 0.9 ELSE 0.5 END"),
        ("strong jaccard_authors", f"{strangers} AND {q._JACCARD_SQL.format(a='a.words', b='b.words')} > 0.35"),
        ("different contrib_intersection_empty", strangers),
        ("ambiguous custom_prefix_10_5860_choice_review", "a.doi IS NOT NULL AND b.doi IS NOT NULL AND (coalesce(a.pre = '10.5860', FALSE) OR coalesce(b.pre = '10.5860', FALSE))"),
        ("different page_count", "abs(a.pages_n - b.pages_n) > 5"),
        ("strong title_artifact", "a.authors = b.authors AND a.cid = b.cid AND a.year IS NOT DISTINCT FROM b.year AND a.title <> b.title AND (contains(a.title, b.title) OR contains(b.title, a.title))"),
    ]
    values = ", ".join("(" + ", ".join(_literal(x) for x in row) + ")" for row in _ROWS)
    made = ", ".join(f"replace(replace({f}, '{{i}}', CAST(doc_id AS VARCHAR)), '{{t}}', first) AS {f}" for f in FIELDS if f not in ("year", "version"))
    when = " ".join(f"WHEN {c} THEN '{v}'" for v, c in cases)
    return f"""
WITH variants(n, side, {', '.join(FIELDS)}) AS (VALUES {values}),
made AS (SELECT doc_id, side, CAST(year AS INTEGER) AS year, CAST(version AS INTEGER) AS version, {made} FROM (SELECT doc_id, split_part(text, chr(10), 1) AS first FROM documents) JOIN variants ON n = doc_id % {len(VARIANTS)}),
named AS (SELECT *, lower(title) AS tl, {slug('title')} AS slug, CASE WHEN contains(doi, '/') THEN split_part(doi, '/', 1) END AS pre, CASE WHEN contains(doi, '10.') THEN lower(substr(doi, instr(lower(doi), '10.'))) END AS cdoi,
  CASE WHEN names = '' THEN [] ELSE string_split(names, '|') END AS each, CASE WHEN sub IS NULL THEN [] ELSE list_transform(string_split(sub, '|'), lambda s: {slug('s')}) END AS subs,
  CASE WHEN pages IS NOT NULL THEN CAST(split_part(pages, '-', 2) AS BIGINT) - CAST(split_part(pages, '-', 1) AS BIGINT) + 1 END AS pages_n FROM made),
known AS (SELECT *, list_sort(list_distinct(each)) AS authors, list_distinct(list_transform(each, lambda n: {slug('n')})) AS sauthors FROM named),
sided AS (SELECT *, list_transform(list_sort(sauthors)[1:5], lambda n: list_distinct({grams})) AS grams, list_distinct(regexp_extract_all(array_to_string(sauthors, ' '), '[0-9A-Za-z_]{{3,}}')) AS words FROM known),
judged AS (SELECT k, ident_a, ident_b, split_part(v, ' ', 1) AS status, split_part(v, ' ', 2) AS reason FROM (
  SELECT CAST(a.doc_id AS VARCHAR) AS k, 'a' || a.doc_id AS ident_a, 'b' || b.doc_id AS ident_b, CASE {when} ELSE 'ambiguous unknown' END AS v FROM sided a JOIN sided b ON a.doc_id = b.doc_id WHERE a.side = 'a' AND b.side = 'b'))"""


JUDGED = _judged()


@q.query(JUDGED + " SELECT * FROM judged")
def verify_every_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of pre-clustered documents, whose variants reach every rule that can hold."""
    return cluster.verify_clusters(pair_documents(spark, sf_dir))


@q.query(JUDGED + " SELECT * FROM judged")
def refs_every_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs as groups of a release and one reference."""
    return refs.verify_refs(pair_documents(spark, sf_dir))


@q.query(JUDGED + f""", counted AS (SELECT reason AS counter, count(*) AS n FROM judged GROUP BY reason
UNION ALL SELECT * FROM (SELECT CASE WHEN lower(trim(cname)) = {_literal(lists.CONTAINERS[0])} THEN 'container_name_blacklist' WHEN lower(trim(publisher)) = {_literal(lists.PUBLISHERS[0])} THEN 'publisher_blacklist' END AS counter, count(*) AS n FROM made GROUP BY 1) WHERE counter IS NOT NULL)
SELECT counter, n FROM counted UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM counted""")
def counters_every_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over the same documents, records of blocked containers and publishers among them."""
    clusters = pair_documents(spark, sf_dir)
    return cluster.group_counters(clusters, cluster.verify_clusters(clusters))
