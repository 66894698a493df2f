"""The ordered rules that classify a pair of records; the first that holds decides.

A rule is data: status, reason and a condition over the feature structs ``a`` and ``b``. The
chain is one CASE that yields a rule's number, so a pair costs only the conditions up to the
first that holds; status and reason are looked up by number. A condition that is
null does not hold. The order matters, and so does the order of the pair: several
rules look at ``a`` alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    status: str
    reason: str
    condition: str


def _prefixes(prefix: str) -> str:
    return f"a.pre = '{prefix}' AND b.pre = '{prefix}'"


def _type_pair(one: str) -> str:
    return f"('{one}' IN (a.kind, b.kind) AND (a.kind IN ('article', 'article-journal') OR b.kind IN ('article', 'article-journal')))"


SAME_SLUG = "a.slug = b.slug"
_GRAM = "transform(a.grams, x -> array_max(transform(b.grams, y -> if(size(array_union(x, y)) = 0, 0D, size(array_intersect(x, y)) / size(array_union(x, y))))))"
_MEAN = f"aggregate({_GRAM}, 0D, (s, x) -> s + x) / size(a.grams)"
_FEWER = "least(size(a.grams), size(b.grams))"
_STRANGERS = "size(a.authors) > 0 AND size(array_intersect(a.sauthors, b.sauthors)) = 0"
_PREPRINTS = "'article', 'article-journal', 'paper-conference', 'report'"
_ONE_WORD = r"rlike '(?U)^\\s*\\S+\\s*$'"


def _years(gap: int) -> str:
    return f"a.year <> 0 AND b.year <> 0 AND abs(a.year - b.year) > {gap}"


def default_rules(min_title_length: int = 5) -> list[Rule]:
    slugs_differ, slug_match = "a.slug <> b.slug", "a.slug <> '' AND replace(a.slug, ' ', '') = replace(b.slug, ' ', '') AND size(array_intersect(a.sauthors, b.sauthors)) > 0"
    author_match = "a.tl = b.tl AND size(a.authors) > 0 AND a.authors = b.authors"
    return [
        Rule("exact", "doi", "a.cdoi = b.cdoi"),
        Rule("exact", "work_id", "a.work_id <> '' AND a.work_id = b.work_id"),
        Rule("ambiguous", "short_title", f"length(a.t) < {min_title_length}"),
        Rule("ambiguous", "blacklisted", "a.denied"),
        Rule("ambiguous", "blacklisted_fragment", "a.fragment"),
        Rule("different", "container", "contains(a.tl, 'subject index') AND contains(b.tl, 'subject index') AND a.cid <> b.cid"),
        Rule("exact", "datacite_version", "a.t <> '' AND a.t = b.t AND a.version <> b.version"),
        Rule("different", "custom_prefix_10_14288", "startswith(a.doi, '10.14288/') AND startswith(b.doi, '10.14288/') AND a.doi <> b.doi"),
        Rule("strong", "custom_bsi_undated", f"{_prefixes('10.3403')} AND (a.doi || 'u' = b.doi OR b.doi || 'u' = a.doi)"),
        Rule("strong", "custom_bsi_subdoc", f"{_prefixes('10.3403')} AND a.t = b.t AND a.has_sub <> b.has_sub"),
        Rule("different", "custom_iop_ma_pattern", f"{_prefixes('10.1149')} AND startswith(a.doi, '10.1149/ma') <> startswith(b.doi, '10.1149/ma')"),
        Rule("different", "vhs", "contains(a.t, 'Zweckverband Volkshochschule ') AND a.t <> b.t"),
        Rule("ambiguous", "appendix", "a.tl rlike '^appendix ?[^ ]*$'"),
        Rule("strong", "figshare_version", "startswith(a.doi, '10.6084/') AND startswith(b.doi, '10.6084/') AND regexp_replace(a.doi, '[.]v[0-9]+$', '') = regexp_replace(b.doi, '[.]v[0-9]+$', '')"),
        Rule("strong", "versioned_doi", "a.doi rlike '^10[.].*/v[0-9]+$' AND b.doi rlike '^10[.].*/v[0-9]+$'"),
        Rule("strong", "versioned_doi", "(contains(a.doi, '.') AND regexp_replace(a.doi, '[.][^.]*$', '') = b.doi) OR (contains(b.doi, '.') AND regexp_replace(b.doi, '[.][^.]*$', '') = a.doi)"),
        Rule("strong", "datacite_related_id", "a.datacite AND b.datacite AND b.doi IS NOT NULL AND (array_contains(a.related, b.doi) OR array_contains(b.related, a.doi))"),
        Rule("strong", "arxiv_version", "a.arxiv rlike '^.*v[0-9]+$' AND b.arxiv rlike '^.*v[0-9]+$' AND regexp_replace(a.arxiv, 'v[0-9]+$', '') = regexp_replace(b.arxiv, 'v[0-9]+$', '')"),
        Rule("different", "release_type", f"a.kind <> b.kind AND ((a.kind NOT IN ({_PREPRINTS}) AND b.kind NOT IN ({_PREPRINTS})) OR {_type_pair('dataset')} OR {_type_pair('book')})"),
        Rule("different", "dataset_doi", "a.kind = 'dataset' AND b.kind = 'dataset' AND a.doi <> b.doi"),
        Rule("different", "book_chapter", "a.kind = 'chapter' AND b.kind = 'chapter' AND a.cname <> b.cname"),
        Rule("different", "component", "a.crossref = 'component' AND a.title <> b.title"),
        Rule("different", "component", "a.kind = 'component' AND b.kind = 'component' AND a.doi <> b.doi"),
        Rule("different", "year", f"{SAME_SLUG} AND {_years(40)}"),
        Rule("strong", "custom_ieee_arxiv", f"{SAME_SLUG} AND ((a.pre = '10.1109' AND b.arxiv <> '') OR (b.pre = '10.1109' AND a.arxiv <> ''))"),
        Rule("ambiguous", "custom_prefix_10_7916", f"{SAME_SLUG} AND {_prefixes('10.7916')}"),
        Rule("different", "subtitle", f"{SAME_SLUG} AND size(a.subs) > 0 AND size(b.subs) > 0 AND size(array_union(a.subs, b.subs)) > 1"),
        Rule("different", "year", f"{author_match} AND {_years(4)}"),
        Rule("exact", "title_author_match", author_match),
        Rule("different", "title_filename", f"((a.t {_ONE_WORD} AND a.t rlike '^.*[.][a-z]{{2,3}}') OR (b.t {_ONE_WORD} AND b.t rlike '^.*[.][a-z]{{2,3}}$')) AND NOT a.title <=> b.title"),
        Rule("different", "year", f"a.title <> '' AND a.title = b.title AND {_years(2)}"),
        # Formulas have capitals and slugs have none, so this rule never holds; it keeps its place for rule lists that build on this one.
        Rule("different", "chem_formula", "a.slug rlike '[A-Z][0-9]'"),
        Rule("ambiguous", "short_title", f"length(a.slug) < 10 AND {slugs_differ}"),
        Rule("different", "num_diff", rf"a.slug rlike '[0-9]' AND {slugs_differ} AND regexp_replace(a.slug, '[0-9]+', '#') = regexp_replace(b.slug, '[0-9]+', '#')"),
        Rule("strong", "preprint_published", f"{SAME_SLUG} AND a.slug <> '' AND size(array_intersect(a.authors, b.authors)) > 0 AND (a.arxiv IS NULL) <> (b.arxiv IS NULL)"),
        Rule("different", "year", f"{slug_match} AND {_years(4)}"),
        Rule("strong", "slug_title_author_match", slug_match),
        Rule("strong", "pmid_doi_pair", "a.year <=> b.year AND a.tl = b.tl AND ((a.pmid IS NOT NULL AND b.doi IS NOT NULL) OR (b.pmid IS NOT NULL AND a.doi IS NOT NULL))"),
        Rule("different", "jstor_id", "a.jstor <> b.jstor"),
        Rule("different", "shared_doi_prefix", "a.cid = b.cid AND a.doi <> b.doi AND a.pre = b.pre AND a.pre <> '10.1126'"),
        Rule("strong", "tokenized_authors", f"{_STRANGERS} AND size(a.grams) > 0 AND size(b.grams) > 0 AND {_MEAN} > if({_FEWER} < 3, 0.9D, 0.5D)"),
        Rule("strong", "jaccard_authors", f"{_STRANGERS} AND size(array_intersect(a.atoks, b.atoks)) / nullif(size(array_union(a.atoks, b.atoks)), 0) > 0.35D"),
        Rule("different", "contrib_intersection_empty", _STRANGERS),
        Rule("ambiguous", "custom_prefix_10_5860_choice_review", "a.doi IS NOT NULL AND b.doi IS NOT NULL AND (coalesce(a.pre = '10.5860', false) OR coalesce(b.pre = '10.5860', false))"),
        Rule("different", "page_count", "abs(a.pages - b.pages) > 5"),
        Rule("strong", "title_artifact", "a.authors = b.authors AND a.cid = b.cid AND a.year <=> b.year AND a.t <> b.t AND (contains(a.t, b.t) OR contains(b.t, a.t))"),
    ]


UNKNOWN = ("ambiguous", "unknown")


def rule_number(rules: list[Rule]) -> Column:
    """Number, from 1, of the first rule that holds; one more than there are rules if none does."""
    cases = " ".join(f"WHEN coalesce({r.condition}, false) THEN {i}" for i, r in enumerate(rules, 1))
    return F.expr(f"CASE {cases} ELSE {len(rules) + 1} END" if rules else "1")


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Status and reason of the number in column ``rule``."""
    table = [(r.status, r.reason) for r in rules] + [UNKNOWN]
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in table]), F.col("rule"))
    return pick(0).alias("status"), pick(1).alias("reason")


def verify_pairs(pairs: DataFrame, rules: list[Rule] | None = None, min_title_length: int = 5) -> DataFrame:
    """Pairs with feature structs ``a`` and ``b``: their other columns, and status and reason."""
    rules = default_rules(min_title_length) if rules is None else rules
    other = [c for c in pairs.columns if c not in ("a", "b")]
    numbered = pairs.select(*other, rule_number(rules).alias("rule"))
    return numbered.select(*other, *verdict(rules))
