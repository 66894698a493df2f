import json
from itertools import combinations

import pytest
from kinmark.operators import closest, cluster, match
from kinmark.operators.refs import split_groups, verify_keyed_refs, verify_refs
from kinmark.operators.rules import verify_pairs
from kinmark.schema import BIBLIO_DDL, CONTAINER_DDL, RELEASE_DDL
from pyspark.sql import functions as F


def records(spark, rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "v string").select(F.from_json("v", RELEASE_DDL).alias("r")).select("r.*")


def rec(ident, title, names=(), **ids):
    return {"ident": ident, "title": title, "contribs": [{"raw_name": n} for n in names], "ext_ids": ids}


def test_cluster_documents_and_pairs(spark):
    rows = [rec(f"{i:02}", t) for i, t in enumerate(["Big Data!", "big data", "BIG  data", "other", "", "!!", "big data"])] + [{"ident": "99", "title": None}]
    r = records(spark, rows)
    docs = {x.k: [y.ident for y in x.v] for x in cluster.cluster_documents(r).collect()}
    assert docs == {"big data": ["00", "01", "02", "06"], "other": ["03"]}
    assert cluster.cluster_documents(r, min_size=2, max_size=3).count() == 0
    made = {(x.a.ident, x.b.ident) for x in cluster.pairs_within(r).collect()}
    assert made == set(combinations(["00", "01", "02", "06"], 2))
    assert {(x.a.ident, x.b.ident) for x in cluster.pairs_of_documents(cluster.cluster_documents(r)).collect()} == made
    assert cluster.pairs_within(r, max_size=3).count() == 0
    assert cluster.cluster_counters(r, denied=["other"]).first().asDict() == {"key_fail": 1, "key_empty": 2, "key_denylist": 1, "key_ok": 4, "num_clusters": 1}
    assert {x.size: x.clusters for x in cluster.cluster_sizes(r).collect()} == {1: 1, 4: 1}


@pytest.mark.parametrize("key", sorted(cluster.KEYS))
def test_every_key(spark, key):
    r = records(spark, [rec("a", "Smith & Co"), rec("b", "Smith & Co")])
    assert cluster.cluster_documents(r, key).first().v[1].ident == "b"


def test_group_counters(spark):
    rows = [rec("1", "one title here"), rec("2", "one title here") | {"publisher": " Test Accounts"}, rec("3", "one title here") | {"extra": {"container_name": "Crossref Listing of Deleted DOIs"}}, rec("4", "alone here")]
    docs = cluster.cluster_documents(records(spark, rows))
    blocked = {"containers": ("crossref listing of deleted dois",), "publishers": ("test accounts",)}
    got = {r.counter: r.n for r in cluster.group_counters(docs, cluster.verify_clusters(docs), **blocked).collect()}
    assert got == {"singular_cluster": 1, "publisher_blacklist": 2, "container_name_blacklist": 2, "unknown": 3, "total": 8}
    assert cluster.without_blocked(records(spark, rows), **blocked).count() == 2
    counts = cluster.reason_counts(verify_pairs(cluster.pairs_within(records(spark, rows)).select("a", "b")))
    assert {tuple(r) for r in counts.collect()} == {("ambiguous", "unknown", 3), (None, None, 3)}


def test_refs(spark):
    ref = {"extra": {"skate": {"status": "ref"}}}
    rows = [rec("r1", "a title that is long") | ref, rec("p", "a title that is long"), rec("r2", "a title that is long") | ref, rec("x", "a title that is long") | {"extra": {"skate": {"status": "other"}}}]
    groups = cluster.cluster_documents(records(spark, rows + [rec("q1", "nothing but references") | ref])).withColumn("v", F.expr("array_sort(v, (x, y) -> if(x.ident < y.ident, 1, -1))"))
    found, rejected = split_groups(groups)
    assert found.count() == 1 and [r.k for r in rejected.collect()] == ["nothing but references"]
    assert {(r.ident_a, r.ident_b) for r in verify_refs(groups).collect()} == {("p", "r1"), ("p", "r2")}


def test_refs_by_key(spark):
    ref = {"extra": {"skate": {"status": "ref"}}}
    rows = [rec("r1", "a title that is long") | ref, rec("p", "a title that is long"), rec("r2", "a title that is long") | ref, rec("x", "a title that is long") | {"extra": {"skate": {"status": "other"}}}, rec("q1", "nothing but references") | ref, rec("z", "") | ref, rec("y", "")]
    r = records(spark, rows)
    assert sorted(verify_keyed_refs(r).collect()) == sorted(verify_refs(cluster.cluster_documents(r)).collect()) != []


def test_counters_by_key(spark):
    rows = [rec(f"{i:02}", "a group of eleven") for i in range(11)] + [rec("a", "one title here"), rec("b", "one title here") | {"publisher": "test accounts"}, rec("c", "alone here")]
    r = records(spark, rows)
    docs = cluster.cluster_documents(r)
    got = {x.counter: x.n for x in cluster.record_counters(r, publishers=("test accounts",)).collect()}
    assert got == {"max_cluster_size_exceeded": 1, "singular_cluster": 1, "publisher_blacklist": 1, "unknown": 1, "total": 4}
    assert got == {x.counter: x.n for x in cluster.group_counters(docs, cluster.verify_clusters(docs), publishers=("test accounts",)).collect()}


def test_groups_above_ten_thousand(spark, tmp_path):
    from kinmark.plans import queries

    n = 10_001
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same title\nA B C "), "id").alias("text"), F.lit("s").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.counter: r.n for r in queries.group_counters(spark, str(tmp_path)).collect()} == {"max_cluster_size_exceeded": 1, "total": 1}
    got = queries.refs_verify(spark, str(tmp_path)).agg(F.count("*"), F.countDistinct("ident_b"), F.min("ident_a"), F.max("ident_a")).first()
    assert tuple(got) == (n - 1, n - 1, 0, 0)


def test_identifier_priority(spark):
    catalog = records(spark, [rec("a", "x", pmid="1"), rec("b", "x", doi="10.1/x"), rec("c", "x", doi="10.1/x")])
    queries = records(spark, [rec("q1", "x", pmid="1", doi="10.1/x"), rec("q2", "x", pmid="1", doi="10.9/none"), rec("q3", "x", doi=""), rec("q4", "x")])
    assert {tuple(r) for r in match.match_by_identifier(queries, catalog).collect()} == {("q1", "b"), ("q2", "a")}


def osa(a, b):
    """Edit distance where a swap of neighbours is one edit and may be edited further."""
    import functools

    @functools.cache
    def d(x, y):
        if not x or not y:
            return len(x) + len(y)
        out = min(d(x[1:], y) + 1, d(x, y[1:]) + 1, d(x[1:], y[1:]) + (x[0] != y[0]))
        if len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0]:
            out = min(out, d(x[2:], y[2:]) + 1)
        return out

    return d(a, b)


def test_fuzzy_terms_against_all_pairs(spark):
    import random

    r = random.Random(0)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(1, 8))) for _ in range(150)})
    field = lambda name: spark.createDataFrame([("title", w) for w in words], f"field string, {name} string")
    got = {(x.qterm, x.term) for x in match.fuzzy_terms(field("qterm"), field("term")).collect()}
    want = {(q, t) for q in words for t in words if osa(q, t) <= (0 if len(q) <= 2 else 1 if len(q) <= 5 else 2)}
    assert want <= got
    # Beyond that only pairs whose two edits are a swap and an insertion within it.
    assert all(osa(q, t) <= 3 and len(q) > 5 for q, t in got - want)


def test_levels(spark):
    catalog = records(spark, [rec("c1", "Deep learning methods", ["Ann Lee"]), rec("c2", "Deep learning methods", ["Bob Ray"]), rec("c3", "Quantum gravity", ["Zed Moe"]), rec("c4", "x", pmid="9")])
    q = [
        rec("q0", "no such title", pmid="9"), rec("q1", "Deep lerning methods", ["Ann Lee"]), rec("q2", "Quantum gravity", ["Nobody Else"]), {"ident": "q3", "title": "quantum GRAVITY"}, {"ident": "q4", "title": "quantum grvaity"}, {"ident": "q5", "title": None}, rec("q6", "nothing alike", ["Nobody Else"]),
    ]
    got = {}
    for r in match.match_releases(records(spark, q), catalog).collect():
        got.setdefault(r.query, []).append((r.level, r.ident))
    assert got == {"q0": [(0, "c4")], "q1": [(1, "c1")], "q2": [(2, "c3")], "q3": [(3, "c3")], "q4": [(4, "c3")]}
    two = match.match_releases(records(spark, [{"ident": "q", "title": "deep learning"}]), catalog, size=1).collect()
    assert [(r.ident, r.rank) for r in two] == [("c1", 1)]


def test_close_and_closest(spark):
    catalog = records(spark, [rec("c1", "Deep learning methods", ["Ann Lee"]), rec("c2", "Deep learning methods", ["Bob Ray"]), rec("c3", "Deep learning methods today", ["Ann Lee"])])
    q = records(spark, [{"ident": "q", "title": "Deep learning methods"} | rec("q", "Deep learning methods", ["Ann Lee"])])
    assert [(r.ident, r.status) for r in closest.close_matches(q, catalog).orderBy("place").collect()] == [("c1", "exact"), ("c3", "ambiguous")]
    assert closest.closest_match(q, catalog).first().ident == "c1"


def test_biblio(spark):
    rows = [
        {"title": "T", "journal": "J", "conference": "C", "author_names": ["A B"], "year": "1999x", "date": "2001", "first_page": "7", "doi": "doi:10.1/X", "arxiv_id": "1"}, {"title": "T", "conference": "C", "first_author": "F", "date": "2001-02", "pages": "1-2", "first_page": "7"},
        {"authors": [{"name": "N", "surname": "S"}], "author_names": ["x"]},
    ]
    biblio = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, v string").select("i", F.from_json("v", BIBLIO_DDL).alias("b")).select("i", "b.*")
    got = {int(r.ident): r for r in closest.releases_of_biblio(biblio, "i").collect()}
    assert got[0].release_year == 1999 and got[0].extra.container_name == "J" and got[0].pages == "7" and got[0].ext_ids.doi == "10.1/x" and got[0].contribs[0].raw_name == "A B"
    assert got[1].release_year == 2001 and got[1].extra.container_name == "C" and got[1].pages == "1-2" and got[1].contribs[0].raw_name == "F"
    assert got[2].contribs[0].surname == "S" and got[2].extra is None
    assert closest.releases_of_biblio(biblio, "i", with_contribs=False).first().contribs is None


def test_resolve_strings(spark):
    a, b = "a" * 26, "b" * 26
    releases = records(spark, [rec(a, "x", wikidata_qid="Q5")])
    containers = spark.createDataFrame([("c1", "J", "1234-567X", None), ("c2", "K", None, ["1111-2222"])], CONTAINER_DDL)
    strings = spark.createDataFrame([(x,) for x in (a, "https://x.org/release/" + a, b, "1234567x", "1111-2222", "Q5", "Some title")], "text string")
    got = {r.text: (r["class"], r.ident) for r in match.resolve_strings(strings, releases, containers).collect()}
    assert got == {a: ("release", a), "https://x.org/release/" + a: ("release", a), b: ("release", None), "1234567x": ("container", "c1"), "1111-2222": ("container", "c2"), "Q5": ("wikidata", a), "Some title": ("title", None)}
    assert match.retrieve(spark.createDataFrame([(a,), (b,)], "ident string"), releases).count() == 1
    assert match.sample_pair(releases).count() == 1


def test_long_terms_meet_by_segments(spark):
    """Terms around and far above the bound, with one or two edits anywhere, swaps at the segments' ends among them."""
    import random

    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    pairs = []
    for n in [*range(21, 31)] * 12 + [60, 200, 2000]:
        a = b = word(n)
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(b) - 1)
            b = r.choice([b[:i] + b[i + 1 :], b[:i] + "x" + b[i:], b[:i] + "y" + b[i + 1 :], b[:i] + b[i + 1] + b[i] + b[i + 2 :]])
        pairs.append((a, b))
    pairs.append(("z" * 30, "z" * 33))
    q = spark.createDataFrame([("title", b) for _, b in pairs], "field string, qterm string").distinct()
    v = spark.createDataFrame([("title", a) for a, _ in pairs], "field string, term string").distinct()
    got = {(x.term, x.qterm) for x in match.fuzzy_terms(q, v).collect()}
    assert got >= set(pairs[:-1]) and ("z" * 30, "z" * 33) not in got


def test_clusters_without_idents_and_of_any_size(spark):
    rows = [(None if i % 3 == 0 else f"{i % 50:03}", "one title", f"w{i}") for i in range(12_001)]
    records = spark.createDataFrame(rows, "ident string, title string, work_id string")
    one = cluster.cluster_documents(records).select(F.size("v").alias("n"), F.transform("v", lambda r: r["ident"]).alias("ids")).first()
    assert one.n == 12_001 and one.ids == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    first, again = (cluster.cluster_documents(records.repartition(n)).select("v").first().v for n in (1, 7))
    assert first == again


def test_edits_and_keys_by_brute_force():
    import random

    import pyarrow as pa
    from kinmark.functions.edits import deletion_keys, edits

    def changed(x):
        out = {x}
        for i in range(len(x) + 1):
            out |= {x[:i] + c + x[i + j :] for c in ("", "a", "b", "c") for j in (0, 1)} | {x[:i] + x[i : i + 2][::-1] + x[i + 2 :]}
        return out

    r = random.Random(2)
    for n in [*range(9)] * 2:
        a = "".join(r.choice("abc") for _ in range(n))
        one = changed(a)
        two = set().union(*map(changed, one))
        others = sorted(two) + ["".join(r.choice("abc") for _ in range(max(0, n + r.randint(-2, 2)))) for _ in range(300)]
        assert [min(x, 3) for x in edits([a] * len(others), others)] == [0 if b == a else 1 if b in one else 2 if b in two else 3 for b in others]

    deleted = lambda x, k: {x} if k == 0 else {x}.union(*(deleted(x[:i] + x[i + 1 :], k - 1) for i in range(len(x))))
    words = ["", "a", "aa", "aba", "é\U0001f600x"] + ["".join(r.choice("abcd") for _ in range(r.randint(2, 26))) for _ in range(80)]
    depths = [i % 4 - 1 for i in range(len(words))]
    made = deletion_keys.func(pa.array(words), pa.array(depths, pa.int32())).to_pylist()
    known = {}
    for word, depth, keys in zip(words, depths, made):
        rest = deleted(word, depth) if depth >= 0 else set()
        assert len(set(keys)) == len(keys) == len(rest)
        for x in rest:
            known.setdefault(x, []).append(set(keys))
    assert all(set.intersection(*v) for v in known.values())
