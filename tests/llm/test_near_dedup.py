import random
import re
from itertools import combinations

from kinmark.llm import near_dedup as nd

from .cases import awkward, awkward_rows, empty, prose


def shingles(text, width=nd.WIDTH):
    w = re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_groups(rows):
    """Groups of two or more by exact Jaccard over all pairs, single linkage."""
    sets = {k: s for k, t in rows.items() if (s := shingles(t))}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    edges = set()
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both / (len(sets[a]) + len(sets[b]) - both) >= nd.THRESHOLD:
            edges.add((a, b))
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in sets}, edges


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want, edges = brute_groups(texts)
    got = {r.doc_id: r.group_id for r in nd.duplicate_groups(docs).collect()}
    same = [(a, b) for a, b in edges if got.get(a) is not None and got.get(a) == got.get(b)]
    assert len(same) >= 0.95 * len(edges)
    for a, g in got.items():  # no pair is joined that brute force keeps apart
        assert want[a] == want[g]


def test_groups_of_edited_copies(spark):
    base = [prose(200, i) for i in range(5)]
    rows = []
    for i, t in enumerate(base):
        w = t.split()
        for j in range(6):
            v = list(w)
            v[j * 7] = f"edit{j}"
            rows.append((i * 10 + j, " ".join(v)))
    got = nd.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_id for r in got} == {i: i // 10 * 10 for i, _ in rows}
    assert sum(r.kept for r in got) == 5 and {r.group_size for r in got} == {6}


def test_many_identical_and_chained(spark):
    rows = [(i, prose(60, 1)) for i in range(300)] + [(1000 + i, prose(60, 100 + i)) for i in range(50)]
    kept = nd.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(1000, 1050)]


def test_awkward(spark):
    docs = awkward(spark)
    kept = nd.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in kept.collect()]
    assert len(rows) == len([r for r in awkward_rows()]) - 4  # of id 6 (three rows), 7 and null with one text, one stays
    assert sum(r[0] == 6 for r in rows) == 1 and not any(r[0] == 7 and r[1] == prose(80, 1) for r in rows)
    assert {r[0] for r in rows} >= {0, 1, 2, 3, 4, 5, 8, 9}


def test_empty(spark):
    assert nd.duplicate_groups(empty(spark)).count() == 0
    assert nd.drop_near_duplicates(empty(spark)).count() == 0


def test_one_shingle_in_every_document_and_string_ids(spark):
    """A shingle that all share makes one list of all documents: only the copies are grouped, and ids stay strings."""
    rows = [(f"d{i:03}", "all of these share this line " + prose(40, i)) for i in range(150)] + [("d900", "all of these share this line " + prose(40, 7))]
    got = nd.duplicate_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.group_id, r.group_size, r.kept) for r in got) == [("d007", "d007", 2, True), ("d900", "d007", 2, False)]


def test_only_the_result_stays_in_the_shared_folder(spark):
    rows = spark.createDataFrame([(i, prose(60, i % 3)) for i in range(9)], "doc_id long, text string")
    found, scratch = nd.near_duplicates(rows)
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch.at)
    left = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    assert [f.getPath().getName() for f in left] == [found._kinmark_path.rsplit("/", 1)[1]]


def test_short_texts_with_one_line_in_common_dont_go_leader_by_leader(spark):
    """A line of 40 % of each short text makes no pair, so there are no turns, whatever the number of texts."""
    line = " ".join(f"notice{i}" for i in range(18))  # 16 of about 40 shingles
    rows = [(i, line + " " + " ".join(f"own{i}w{j}" for j in range(24))) for i in range(60)]
    rows += [(900, rows[7][1] + " more")]
    found, scratch = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.id for r in found.collect()) == [7, 900]
    assert scratch._n < 30


def edited_texts():
    """Texts of 8 to 200 words, of which many are about as alike as the threshold, and lines that many share."""
    r = random.Random(5)
    lines = [" ".join(f"line{k}w{i}" for i in range(12)) for k in range(3)]
    out = []
    for i in range(60):
        own = [f"t{i}w{j}" for j in range(r.choice((8, 15, 30, 50, 64, 68, 90, 130, 200)))]
        for _ in range(4):
            w = own[: r.randint(len(own) // 2, len(own))]
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = f"e{r.random()}"
            out.append(" ".join(w) + r.choice(["", " ", *lines]))
    return dict(enumerate(out))


def test_whole_sketches_against_brute_force_in_slices(spark, monkeypatch):
    """Pairs of whole sketches are exact, and pairs tried in slices are all tried."""
    texts = edited_texts()
    short = {k for k, t in texts.items() if len(shingles(t)) <= nd.K}
    for rows, share in ((texts, 0.98), ({k: texts[k] for k in short}, 1)):
        want, edges = brute_groups(rows)
        docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
        for most in (nd.PAIRS_PER_POSTING, 0.02):
            monkeypatch.setattr(nd, "PAIRS_PER_POSTING", most)
            monkeypatch.setattr(nd, "LEFT_BY_LEADERS", 0.75 if most > 1 else 0)
            got = {r.doc_id: r.group_id for r in nd.duplicate_groups(docs).collect()}
            assert sum(got.get(a) is not None and got.get(a) == got.get(b) for a, b in edges) >= share * len(edges)
            assert all(want[a] == want[g] for a, g in got.items())
