"""Scalar functions as Spark columns: strings, identifiers, pages, years.

Each is an expression that Catalyst compiles; none calls Python per row. Arguments
are columns or column names; a null argument gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def col(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: What counts as white space, for functions that take the characters and not a pattern.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def strip(x: Col) -> Column:
    """Without white space of any kind at the ends (``trim`` alone removes blanks)."""
    return F.btrim(col(x), F.lit(SPACES))


def bind(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def clean_doi(x: Col) -> Column:
    """Lower-case DOI from its first ``10.`` on, without a doubled slash after a 4-digit prefix; null where there is none."""
    doi = F.regexp_extract(F.lower(strip(x)), r"(?s)10\..*", 0)
    return F.nullif(F.regexp_replace(doi, r"(?s)^(.{7}/)/", "$1"), F.lit(""))


def doi_prefix(x: Col) -> Column:
    """What stands before the first slash; null without a slash."""
    return F.when(F.instr(col(x), F.lit("/")) > 0, F.substring_index(col(x), "/", 1))


def has_doi_prefix(x: Col, prefix: str) -> Column:
    return F.coalesce(F.substring_index(col(x), "/", 1) == prefix, F.lit(False))


def slug(x: Col) -> Column:
    """Lower-case ASCII letters and digits with single blanks between words; other letters are dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"[^0-9a-z \t\n\r\x0B\f]", ""), r"[ \t\n\r\x0B\f]+", " "))


def tokens(x: Col) -> Column:
    """Lower-case words between white space, punctuation included."""
    return F.filter(F.split(F.lower(col(x)), r"(?U)\s+"), lambda t: t != "")


def terms(x: Col) -> Column:
    """Lower-case runs of letters and digits: what the text index holds."""
    return F.filter(F.split(F.lower(col(x)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def chunks(x: Col, n: int = 2) -> Column:
    """A string's consecutive pieces of n characters; the last may be shorter."""
    return F.regexp_extract_all(col(x), F.lit(f"(?s).{{1,{n}}}"), F.lit(0))


def chunks_of_array(x: Col, n: int = 2) -> Column:
    """An array's consecutive pieces of n elements; the last may be shorter."""
    a = col(x)
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(1), F.size(a), F.lit(n)), lambda i: F.slice(a, i, F.lit(n)))).otherwise(F.array())


def token_ngrams(x: Col, n: int = 2) -> Column:
    """The n-character pieces of every token, in order."""
    return F.flatten(F.transform(tokens(x), lambda t: chunks(t, n)))


def jaccard(a: Col, b: Col) -> Column:
    """Shared elements of two arrays as sets over all; 0 if both are empty."""
    both, either = F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def author_similarity(a: Col, b: Col) -> Column:
    return jaccard(token_ngrams(a), token_ngrams(b))


def num_project(x: Col) -> Column:
    """Each run of digits becomes <NUM>."""
    return F.regexp_replace(col(x), r"\d+", "<NUM>")


def has_chemical_formula(x: Col) -> Column:
    return F.coalesce(col(x).rlike("[A-Z][0-9]"), F.lit(False))


def parse_pages(x: Col) -> Column:
    """struct(start, end, count): a page, or a range whose end may be abbreviated to 1 or 2 digits; null if it is neither."""
    page = bind(F.regexp_extract(col(x), r"^[pPeE]?([0-9]+)$", 1).try_cast("long"), lambda n: F.when(n.isNotNull(), F.struct(n.alias("start"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("long").alias("count"))))

    def completed(m: Column) -> Column:
        # The end is completed when it is above the start's last digits as a string.
        a, b = m["a"], m["b"]
        short = F.length(b)
        full = F.when((short <= 2) & (F.right(a, short) < b), F.concat(F.substring(a, F.lit(1), F.greatest(F.length(a) - short, F.lit(0))), b)).otherwise(b)
        return F.struct(a.try_cast("long").alias("start"), full.try_cast("long").alias("end"))

    def counted(r: Column) -> Column:
        return F.when(r["start"] <= r["end"], F.struct(r["start"].alias("start"), r["end"].alias("end"), (r["end"] - r["start"] + 1).alias("count")))

    parts = F.split(F.regexp_extract(col(x), "^[pPeE]?([0-9]+-[0-9]+)", 1), "-")
    pair = bind(parts, lambda p: F.struct(F.get(p, F.lit(0)).alias("a"), F.get(p, F.lit(1)).alias("b")))
    return F.coalesce(page, bind(bind(pair, completed), counted))


def year_of(x: Col) -> Column:
    """The first four characters as an integer, if they are digits."""
    return F.when(col(x).cast("string").rlike("^[0-9]{4}"), F.substring(col(x).cast("string"), 1, 4).cast("int"))


def year_or_date(year: Col, date: Col) -> Column:
    """The year; only if there is none, the date's."""
    y = col(year).cast("string")
    return F.when(F.coalesce(y, F.lit("")) != "", year_of(y)).otherwise(year_of(date))


def strip_arxiv(x: Col) -> Column:
    return F.regexp_replace(col(x), "^arXiv:", "")


def fix_url(x: Col) -> Column:
    """A citation's URL without parser leftovers: a .Lastaccessed ending, a leading <, anything from > on."""
    v = F.when(F.endswith(col(x), F.lit(".Lastaccessed")), F.replace(col(x), F.lit(".Lastaccessed"), F.lit(""))).otherwise(col(x))
    return F.substring_index(F.regexp_replace(v, "^<", ""), ">", 1)


def cut(x: Col, field: int = 0, sep: str = "\t", ignore_missing: bool = True) -> Column:
    """Field number ``field`` of a delimited line; a missing one is '' or, if strict, an error."""
    parts = F.split(strip(x), "\\Q" + sep + "\\E")
    if ignore_missing:
        return F.coalesce(F.get(parts, F.lit(field)), F.lit(""))
    return F.element_at(parts, field + 1)


def is_ident(x: Col) -> Column:
    return col(x).rlike("[a-z0-9]{26}$")


def is_issn(x: Col) -> Column:
    return F.lower(col(x)).rlike("^[0-9]{4}-?[0-9]{3}[0-9x]")


def hit_total(response: Col) -> Column:
    """Hits of a search response in JSON, whose total is a number or an object with a value."""
    return F.coalesce(F.get_json_object(col(response), "$.hits.total.value"), F.get_json_object(col(response), "$.hits.total")).try_cast("long")
