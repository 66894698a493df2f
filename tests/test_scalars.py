import pytest
from kinmark.functions import scalars as s
from kinmark.functions.slugs import nysiis, nysiis_text, scorable_slug, scorable_text
from pyspark.sql import functions as F


def values(spark, inputs, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_doi(spark):
    got = values(spark, ["10.1234/ABC", " doi:10.1234/x ", "\thttps://doi.org/10.5/a\n", "10.1234//x", "no", "", None, "10.12345//x"], s.clean_doi)
    assert got == ["10.1234/abc", "10.1234/x", "10.5/a", "10.1234/x", None, None, None, "10.12345//x"]


def test_doi_prefix(spark):
    assert values(spark, ["10.1/x/y", "10.1", "", None], s.doi_prefix) == ["10.1", None, None, None]
    assert values(spark, ["10.1/x", "10.12/x", "10.1", None], lambda x: s.has_doi_prefix(x, "10.1")) == [True, False, True, False]


def test_slug_and_tokens(spark):
    assert values(spark, [" A  B\nc! ", "Über-Graph 2.0", "", None], s.slug) == ["a b c", "bergraph 20", "", None]
    assert values(spark, ["A b C\tb", " ", None], s.tokens) == [["a", "b", "c", "b"], [], None]
    assert values(spark, ["A-b, Ünal 12"], s.terms) == [["a", "b", "ünal", "12"]]


def test_chunks(spark):
    assert values(spark, ["abcde", "a\nb", ""], lambda x: s.chunks(x, 2)) == [["ab", "cd", "e"], ["a\n", "b"], []]
    assert values(spark, [[1, 2, 3], [], None], lambda x: s.chunks_of_array(x, 2), "array<int>") == [[[1, 2], [3]], [], []]
    assert values(spark, ["Abc de"], s.token_ngrams) == [["ab", "c", "de"]]


def test_similarity(spark):
    pairs = spark.createDataFrame([("a b", "a b"), ("abcd ef", "abcd xy"), ("", ""), ("a", "")], "x string, y string")
    assert [r.v for r in pairs.select(s.author_similarity("x", "y").alias("v")).collect()] == [1.0, 0.5, 0.0, 0.0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("7", (7, None, None)), ("p7", (7, None, None)), ("E12", (12, None, None)), ("150-180", (150, 180, 31)), ("261-5", (261, 265, 5)), ("577-89", (577, 589, 13)), ("12-1", None), ("9-10", (9, 10, 2)), ("3-3", (3, 3, 1)),
        ("99-08", None), ("1-2 and more", (1, 2, 2)), ("iv-xi", None), ("", None), ("-5", None), ("p", None), ("5-40", (5, 40, 36)),
    ],
)
def test_pages(spark, text, want):
    got = values(spark, [text], s.parse_pages)[0]
    assert (tuple(got) if got else None) == want


def test_years_and_the_rest(spark):
    assert values(spark, ["1999", "1999-01", "99", "", None, "19x9"], s.year_of) == [1999, 1999, None, None, None, None]
    rows = spark.createDataFrame([("", "2001-02"), ("1990", "2001"), (None, "x"), ("abcd", "2001")], "y string, d string")
    assert [r.v for r in rows.select(s.year_or_date("y", "d").alias("v")).collect()] == [2001, 1990, None, None]
    assert values(spark, ["v1 of 22", "x"], s.num_project) == ["v<NUM> of <NUM>", "x"]
    assert values(spark, ["H2O", "h2o", None], s.has_chemical_formula) == [True, False, False]
    assert values(spark, ["arXiv:1", "arxiv:1"], s.strip_arxiv) == ["1", "arxiv:1"]
    assert values(spark, ["<http://a>b", "http://a.Lastaccessed", "http://a"], s.fix_url) == ["http://a"] * 3
    assert values(spark, ["a\tb", "a", "a.b"], lambda x: s.cut(x, 1)) == ["b", "", ""]
    assert values(spark, ["a.b"], lambda x: s.cut(x, 1, ".")) == ["b"]
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        values(spark, ["a"], lambda x: s.cut(x, 3, ignore_missing=False))
    assert values(spark, ["a" * 26, "/release/" + "b" * 26, "a" * 25, "A" * 26], s.is_ident) == [True, True, False, False]
    assert values(spark, ["1234-567X", "1234567x", "123-4567"], s.is_issn) == [True, True, False]
    assert values(spark, ['{"hits":{"total":5}}', '{"hits": {"total": {"relation": "eq", "value": 7}}}', "{}"], s.hit_total) == [5, 7, None]


def test_scorable_slug(spark):
    cases = {"": "", "Hello, World!": "helloworld", "Łódź Æsir Øre": "lodzaesirore", "µm β-x": "umbx", "naïve — “quotes”": "naivequotes", "ﬁne ²": "fine2", "&apos;x&apos;": "x", "Title: On it": "onit", "期刊 的": "期刊的"}
    assert values(spark, list(cases), scorable_slug) == list(cases.values())
    assert scorable_text("Title: On it", keep_lead=True) == "title"


def test_nysiis(spark):
    assert [nysiis_text(x) for x in ("Macdonald", "Knight", "Phillips", "Catherine", "katherine", "", "12")] == ["MCDANALD", "NAGT", "FALAP", "CATARAN", "CATARAN", "", ""]
    assert values(spark, ["John Smith", None], nysiis) == ["JANSNAT", None]
