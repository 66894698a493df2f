"""Candidates for many query records at once: identifier lookup, then text levels as joins.

The text index is two tables: ``words`` (ident, field, len, terms), a row for each field with its terms in order, and
``vocabulary`` (field, term, df). Query terms meet index terms through deletion keys: two terms within k edits share a
key made by deleting at most k characters, so the fuzzy join is an equi-join over distinct terms,
checked afterwards by the edit distance (a swap of neighbours counts as one edit). Terms
of 1-2 characters match exactly, of 3-5 with one edit, and longer ones with two. Index terms above ``LONG``
characters have too many deletions: two edits, even swaps, leave one of their five segments untouched and at most two
places off, so they are met by segments instead, which are as many for a term of any length.

Levels are tried in order, and a query stops at the first that gives it anything: lookup; title and
authors; title or authors; all title terms exactly; all title terms fuzzily.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.edits import deletion_keys, within_edits
from ..schema import ID_TYPES
from ..sources.working import written

ALL = 10_000
K1, B = 1.2, 0.75
LONG, SEGMENTS = 24, 5


# ---- Identifiers


def identifiers(records: DataFrame, name: str) -> DataFrame:
    """Rows (name, rank, type, value) of each record's non-empty identifiers."""
    each = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(t).alias("type"), F.col(f"ext_ids.{t}").alias("value")) for i, t in enumerate(ID_TYPES)])
    return records.select(F.col("ident").alias(name), F.explode(F.filter(each, lambda x: x["value"] != "")).alias("x")).select(name, "x.*")


def match_by_identifier(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows (query, ident): the record with the first identifier that leads anywhere, of several the smallest ident."""
    hits = identifiers(queries, "query").join(identifiers(catalog, "ident").drop("rank"), ["type", "value"])
    best = F.row_number().over(W.partitionBy("query").orderBy("rank", "ident"))
    return hits.withColumn("n", best).where("n = 1").select("query", "ident")


# ---- The text index


def names_text(contribs: str = "contribs") -> Column:
    return F.array_join(F.transform(contribs, lambda c: c["raw_name"]), " ")


def text_index(catalog: DataFrame, fields: tuple[str, ...] = ("title", "names")) -> tuple[DataFrame, DataFrame]:
    """Words and vocabulary of titles and author names, written once: texts are split a single time, and only distinct terms are shuffled."""
    texts = {"title": F.col("title"), "names": names_text()}
    each = F.array(*[F.struct(F.lit(n).alias("field"), texts[n].alias("text")) for n in fields])
    split = catalog.select("ident", F.explode(each).alias("x")).select("ident", "x.field", s.terms("x.text").alias("terms"))
    words = written(split.select("ident", "field", F.size("terms").alias("len"), "terms"), "words").where("len > 0")
    once = words.groupBy("field", "ident").count().where("count > 1").isEmpty()
    if once:
        terms = words.select("field", F.explode(F.array_distinct("terms")).alias("term"))
    else:  # records of one ident count once for a term
        terms = words.select("field", "ident", F.explode("terms").alias("term")).distinct().select("field", "term")
    return words, written(terms.groupBy("field", "term").agg(F.count("*").alias("df")), "vocabulary")


def edits_allowed(term: Column) -> Column:
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)


def _segment(length: Column, j: Column) -> tuple[Column, Column]:
    """First place (from 1) and size of a term's j-th segment."""
    a, b = F.floor(j * length / SEGMENTS), F.floor((j + 1) * length / SEGMENTS)
    return (a + 1).cast("int"), (b - a).cast("int")


def segment_keys(term: Column) -> Column:
    """Length, number and text of each segment of an index term."""

    def one(j: Column) -> Column:
        at, size = _segment(F.length(term), j)
        return F.concat_ws(":", F.lit("#"), F.length(term), j, F.substring(term, at, size))

    return F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), one)


def segment_probes(term: Column) -> Column:
    """What the segments of long index terms within two edits of a query term can be: for each length and segment, pieces at most two places off."""

    def of_length(n: Column) -> Column:
        def one(j: Column) -> Column:
            at, size = _segment(n, j)
            pieces = F.transform(F.filter(F.sequence(F.lit(-2), F.lit(2)), lambda off: at + off >= 1), lambda off: F.substring(term, at + off, size))
            return F.transform(pieces, lambda x: F.concat_ws(":", F.lit("#"), n, j, x))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), one))

    near = F.sequence(F.greatest(F.length(term) - 2, F.lit(LONG + 1)), F.length(term) + 2)
    return F.when(F.length(term) >= LONG - 1, F.array_distinct(F.flatten(F.transform(near, of_length)))).otherwise(F.array().cast("array<string>"))


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (field, qterm, term) of query terms and the index terms within their edits.

    ``terms``: (field, qterm), ``vocabulary``: (field, term); both distinct. Index terms are keyed for
    two deletions only if they are long enough for a query term with two edits to reach them.
    """
    hashed = lambda pieces: F.transform(pieces, lambda x: F.xxhash64(x))
    none = F.array().cast("array<bigint>")
    size = F.length("qterm")
    # Keys and checks cost far more than their bytes, so terms are spread over all cores; not over more tasks, as keys are made many at once.
    tasks = 2 * max(vocabulary.sparkSession.sparkContext.defaultParallelism, 8)
    q = terms.select("field", "qterm", edits_allowed(F.col("qterm")).alias("k")).repartition(tasks, "field", "qterm")
    keys = F.concat(deletion_keys("qterm", F.when(size <= LONG + 2, F.col("k")).otherwise(-1)), F.when(size >= LONG - 1, hashed(segment_probes(F.col("qterm")))).otherwise(none))
    long = F.length("term") > LONG
    depth = F.when(long, -1).when(F.length("term") >= 4, 2).when(F.length("term") >= 2, 1).otherwise(0)
    v = vocabulary.select("field", "term").repartition(tasks, "field", "term")
    v = v.select("field", "term", F.explode(F.concat(deletion_keys("term", depth), F.when(long, hashed(segment_keys(F.col("term")))).otherwise(none))).alias("key"))
    met = q.withColumn("key", F.explode(keys)).join(v, ["field", "key"]).select("field", "qterm", "term", "k").distinct()
    return met.where(within_edits("qterm", "term", "k")).select("field", "qterm", "term")


def same_terms(terms: DataFrame) -> DataFrame:
    """Rows (field, qterm, term) of exact matching."""
    return terms.select("field", "qterm", F.col("qterm").alias("term"))


def field_matches(queries: DataFrame, words: DataFrame, vocabulary: DataFrame, near: DataFrame) -> DataFrame:
    """Rows (query, field, ident, score): catalog fields that have every term of the query's field.

    ``queries``: (query, field, qterm), distinct; ``near``: (field, qterm, term), the terms that stand for each query
    term. The score adds, over the query's terms, the best BM25 weight of a matching term.
    """
    wanted = queries.groupBy("query", "field").agg(F.count("*").alias("wanted"))
    near = written(near.join(vocabulary, ["field", "term"]), "near")
    # A query that lacks a term everywhere is out; of the others only the documents of the rarest term are candidates,
    # so a frequent term's documents are never joined with all queries that have it.
    reach = near.groupBy("field", "qterm").agg(F.sum("df").alias("reach"))
    each = W.partitionBy("query", "field")
    live = queries.join(reach, ["field", "qterm"]).withColumn("have", F.count("*").over(each)).join(wanted, ["query", "field"]).where("have = wanted")
    ranked = live.withColumn("turn", F.row_number().over(each.orderBy("reach", "qterm"))).select("query", "field", "qterm", "wanted", "turn")
    asked = written(ranked.join(near, ["field", "qterm"]), "asked")
    once = words.select("field", "ident", F.explode(F.array_distinct("terms")).alias("term"))
    candidates = written(once.join(asked.where("turn = 1").select("query", "field", "term"), ["field", "term"]).select("query", "field", "ident").distinct(), "candidates")
    terms = candidates.join(words, ["field", "ident"]).select("query", "field", "ident", "len", F.explode("terms").alias("term"))
    found = terms.join(asked.select("query", "field", "term", "qterm", "df", "wanted"), ["query", "field", "term"])
    # Of records with one ident the shortest has the largest weight, and their terms are counted together.
    counted = found.repartition("query", "ident").groupBy("query", "field", "ident", "qterm", "term").agg(F.count("*").alias("tf"), F.min("len").alias("len"), F.first("df").alias("df"), F.first("wanted").alias("wanted"))
    total = words.groupBy("field").agg(F.count("*").alias("docs"), (F.sum("len") / F.count("*")).alias("mean"))
    scored = counted.join(F.broadcast(total), "field")  # a row for each field
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    per_term = scored.groupBy("query", "field", "ident", "qterm").agg(F.max(F.round(weight, 9)).alias("w"), F.first("wanted").alias("wanted"))
    hits = per_term.groupBy("query", "field", "ident").agg(F.count("*").alias("have"), F.sum("w").alias("score"), F.first("wanted").alias("wanted"))
    return hits.where("have = wanted").select("query", "field", "ident", "score")


def query_terms(queries: DataFrame) -> DataFrame:
    """Rows (query, field, qterm) for titles and, where there are contributors, names."""
    fields = F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("text")), F.struct(F.lit("names").alias("field"), names_text().alias("text")))
    return queries.select(F.col("ident").alias("query"), F.explode(fields).alias("x")).select("query", "x.field", F.explode(F.array_distinct(s.terms("x.text"))).alias("qterm"))


def match_releases(queries: DataFrame, catalog: DataFrame, size: int | None = 5) -> DataFrame:
    """Rows (query, ident, level, score, rank) with at most ``size`` candidates a query (0 or None: 10,000).

    level: 0 lookup, 1 title and authors, 2 title or authors, 3 exact title terms, 4 fuzzy title terms. Queries
    without a title or contributors skip levels 1 and 2. Of equal scores the smaller ident comes first.
    The index is written once and read by every level, and so are the index terms near each query term; a level works
    only on the queries that earlier ones left.
    """
    words, vocabulary = text_index(catalog)
    looked = written(match_by_identifier(queries, catalog).select("query", "ident", F.lit(0).alias("level"), F.lit(0.0).alias("score")), "looked")
    open_ = queries.join(looked.select(F.col("query").alias("ident")), "ident", "left_anti")
    terms = written(query_terms(open_), "terms")
    both = open_.where("title is not null and contribs is not null").select(F.col("ident").alias("query"))
    asked = terms.join(both, "query", "left_semi")
    sought = lambda rows: rows.select("field", "qterm").distinct()
    near = written(fuzzy_terms(sought(asked), vocabulary), "near")
    fuzzy = written(field_matches(asked, words, vocabulary, near), "fields")
    either = fuzzy.groupBy("query", "ident").agg(F.count("*").alias("fields"), F.sum("score").alias("score"))
    # Level 2 is the union of both fields, so what level 1 found belongs to it too; level 1 is tried first.
    one_two = either.select("query", "ident", F.when(F.col("fields") == 2, 1).otherwise(2).alias("level"), "score")
    left = terms.where("field = 'title'").join(fuzzy.select("query"), "query", "left_anti")
    exact = written(field_matches(left, words, vocabulary, same_terms(sought(left))), "exact")
    rest = written(left.join(exact.select("query"), "query", "left_anti"), "rest")
    new = written(sought(rest).join(sought(asked), ["field", "qterm"], "left_anti"), "new")
    if not new.isEmpty():  # terms of queries that skipped levels 1 and 2
        near = near.unionByName(fuzzy_terms(new, vocabulary))
    last = field_matches(rest, words, vocabulary, near.join(sought(rest), ["field", "qterm"], "left_semi"))
    levels = [looked, one_two, exact.select("query", "ident", F.lit(3).alias("level"), "score"), last.select("query", "ident", F.lit(4).alias("level"), "score")]
    every = reduce(DataFrame.unionByName, levels)
    first = F.min("level").over(W.partitionBy("query"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.round("score", 6).desc(), "ident"))
    kept = every.withColumn("first", first).where("level = first").withColumn("rank", rank)
    return kept.where(F.col("rank") <= (size or ALL)).select("query", "ident", "level", F.round("score", 6).alias("score"), "rank")


def retrieve(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalog's records with the idents of ``ids``; idents it doesn't have are skipped."""
    return ids.join(catalog, "ident")


def resolve_strings(strings: DataFrame, releases: DataFrame, containers: DataFrame | None = None, text: str = "text") -> DataFrame:
    """What each string stands for: (text, class, ident).

    class: release (a 26-character ident, in a path or alone), container (an ISSN), wikidata (a Q number of a release)
    or title (anything else, with no ident). An ident or number that the catalog doesn't have gives a null ident.
    """
    ident = F.regexp_extract(text, "([a-z0-9]{26})$", 1)
    own = strings.select(F.col(text).alias("text"), F.when(s.is_ident(text), "release").when(s.is_issn(text), "container").when(F.col(text).rlike("^Q[0-9]+$"), "wikidata").otherwise("title").alias("class"), ident.alias("key"))
    known = releases.select(F.lit("release").alias("class"), F.col("ident").alias("key"), "ident").unionByName(releases.where("ext_ids.wikidata_qid is not null").groupBy(F.col("ext_ids.wikidata_qid").alias("key")).agg(F.min("ident").alias("ident")).select(F.lit("wikidata").alias("class"), "key", "ident"))
    if containers is not None:
        issn = containers.select(F.explode(F.array_compact(F.concat(F.array("issnl"), F.coalesce("issns", F.array().cast("array<string>"))))).alias("key"), "ident").groupBy("key").agg(F.min("ident").alias("ident"))
        known = known.unionByName(issn.select(F.lit("container").alias("class"), F.replace(F.lower("key"), F.lit("-"), F.lit("")).alias("key"), "ident"))
    keyed = own.withColumn("key", F.when(F.col("class") == "container", F.replace(F.lower(F.substring("text", 1, 9)), F.lit("-"), F.lit(""))).when(F.col("class") == "wikidata", F.col("text")).otherwise(F.col("key")))
    keyed = keyed.withColumn("key", F.when(F.col("class") == "container", F.substring("key", 1, 8)).otherwise(F.col("key")))
    return keyed.join(known, ["class", "key"], "left").select("text", "class", "ident")


def sample_pair(records: DataFrame, n: int = 2, seed: int = 0) -> DataFrame:
    """n records at random, the same for the same seed and table: a top-k by hash, without a full sort."""
    return records.orderBy(F.xxhash64(F.col("ident"), F.lit(seed)), "ident").limit(n)
