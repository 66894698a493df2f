import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from kinmark.llm import secret_scan as ss
from kinmark.llm import textvec as tv

from .cases import awkward, empty, prose


def english(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "their", "other", "nation", "there", "letter", "season", "reading", "thin", "into"]) for _ in range(n))


def table(spark):
    r = random.Random(3)
    rows, planted = [], {}
    for i in range(400):
        words = english(300, i).split()
        if i % 4 == 0:
            key = "".join(r.choice("0123456789abcdef") for _ in range(40))
            words.insert(50, key)
            planted[i] = key
        if i % 4 == 1:
            words.insert(20, r.choice(["0123456789" * 4, "a1" * 12, "deadbeef" * 5, "1111111111222222222233"]))
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string"), dict(rows), planted


def test_finds_random_keys_and_leaves_patterns(spark):
    docs, texts, planted = table(spark)
    got = ss.secret_spans(docs).collect()
    found = {r.doc_id: texts[r.doc_id][r.start : r.start + r.length] for r in got}
    hit = [i for i, k in planted.items() if found.get(i) == k]
    assert len(hit) >= 0.9 * len(planted)
    assert len(set(found) - set(planted)) <= 0.15 * len(found)


def test_masking_changes_the_spans_alone(spark):
    docs, texts, _ = table(spark)
    spans = {}
    for r in ss.secret_spans(docs).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    want = {}
    for i, t in texts.items():
        for a, b in sorted(spans.get(i, []), reverse=True):
            t = t[:a] + ss.MASK + t[b:]
        want[i] = t
    out = ss.mask_secrets(docs).collect()
    assert {r.doc_id: r.text for r in out} == want


def test_battery_against_plain_python():
    runs = ["7f3a9c0d1e5b8246", "0000000000000000", "0123456789abcdef", "abababababababab", "c1d2a3f4b5e60718293a4b5c"]
    r = ss.find_runs(*tv.buffers(pa.array([" ".join(runs)])))
    assert len(r.start) == 4  # the second, of zeros only, is decimal: 16 digits hold too few bits
    for i, s in enumerate([x for x in runs if x != "0000000000000000"]):
        x = ["0123456789abcdef".index(c) for c in s]
        n, k = len(x), 16
        stat = sum(x.count(v) ** 2 for v in range(k)) * k / n - n
        df = (k - 1) * n / (n - 1)
        z = ((stat * n / (n - 1) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
        assert np.isclose(r.chi[i], max(2 * ss.normal_cdf(np.array(-abs(z))), 1e-15), rtol=1e-6)
        m = sum(x) / n
        d = [v - m for v in x]
        corr = sum(d[j] * d[(j + 1) % n] for j in range(n)) / sum(v * v for v in d)
        assert np.isclose(r.serial[i], max(2 * ss.normal_cdf(np.array(-abs((corr + 1 / (n - 1)) * n**0.5))), 1e-15), rtol=1e-6)


def test_random_strings_have_uniform_scores():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 16, 4000 * 64)
    score = ss.battery(x, np.arange(0, 4000 * 64 + 1, 64), np.full(4000, 16))[3]
    for q in (0.1, 0.5, 0.9):
        assert abs((score < q).mean() - q) < 0.1  # the runs test has few values


def test_false_discovery_control():
    reference, candidates = np.zeros(len(ss.CLASSES) * ss.BUCKETS), np.zeros(len(ss.CLASSES) * ss.BUCKETS)
    reference[: ss.BUCKETS] = 1000  # scores of ordinary text are uniform in the shortest class
    candidates[: ss.BUCKETS] = 1  # and so are the candidates
    assert (ss.decide(reference, candidates).q[: ss.BUCKETS] > 0.5).all()
    candidates[ss.BUCKETS - 1] = 5000  # many with the highest score
    q = ss.decide(reference, candidates).q
    assert q[ss.BUCKETS - 1] < 0.01 and q[0] == 1.0


def recall(reference, n, share, keys=1000):
    """Share of random base62 keys of length n that are reported among so many ordinary candidates."""
    x = np.random.default_rng(n).integers(0, 62, (keys, n))
    r = ss.find_runs(*tv.buffers(pa.array(["".join(ss.ALPHABETS[8][1][i] for i in row) for row in x])))
    cell = r.cell[~r.ordinary]
    candidates = np.bincount(cell, minlength=len(reference)).astype(float)
    own = slice((np.searchsorted(ss.CLASSES, n, "right") - 1) * ss.BUCKETS, np.searchsorted(ss.CLASSES, n, "right") * ss.BUCKETS)
    candidates[own] += reference[own] / reference[own].sum() * len(cell) * share / (1 - share)
    return (ss.decide(reference, candidates).q[cell] <= ss.FDR).sum() / keys


def test_recall_by_length_and_ordinary_share(sf_dir):
    texts = pq.read_table(f"{sf_dir}/documents.parquet")["text"].combine_chunks().cast(pa.string())
    reference = np.bincount(ss.reference_cells(*tv.buffers(texts)), minlength=len(ss.CLASSES) * ss.BUCKETS).astype(float)
    got = {share: [recall(reference, n, share) for n in (16, 40)] for share in (0.5, 0.9, 0.99)}
    assert all(short <= long for short, long in got.values())
    assert got[0.5][1] >= 0.9 and got[0.9][0] <= 0.05, got  # long keys are found, the shortest aren't: see the README


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    out = ss.mask_secrets(docs, count_column="n_chars")
    assert out.columns == docs.columns and out.count() == docs.count()
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(r.text) for r in docs.collect())
    assert ss.secret_spans(docs).count() == 0
    assert ss.secret_spans(empty(spark)).count() == 0 and ss.mask_secrets(empty(spark)).count() == 0
    long = spark.createDataFrame([(1, prose(50_000, 1) + " 9f8e7d6c5b4a39281706f5e4d3c2b1a0ffee1234 " + prose(10, 2)), (None, "9f8e7d6c5b4a39281706f5e4d3c2b1a0ffee1234 é " * 2)], "doc_id long, text string")
    spans = ss.secret_spans(long, fdr=1.0).collect()
    assert len(spans) == 3 and {r.doc_id for r in spans} == {1, None}


# ---- The whole operator once more, in plain Python


def plain_battery(x, k):
    """p-values of chi-squared, runs and serial correlation, and Fisher's combination, by their textbook formulas."""
    n = len(x)
    cdf = lambda z: 0.5 * math.erfc(-max(-9.0, min(9.0, z)) / math.sqrt(2))
    both = lambda z: max(2 * cdf(-abs(z)), 1e-15)
    stat = sum((x.count(c) - n / k) ** 2 / (n / k) for c in range(k))
    df = (k - 1) * n / max(n - 1, 1)
    scaled = max(stat * n / max(n - 1, 1), 0) / df
    chi = both((scaled ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = [2 * c >= k for c in x]
    n1, r = sum(high), sum(1 for _ in itertools.groupby(high))
    mean = 1 + 2 * n1 * (n - n1) / n
    var = (mean - 1) * (mean - 2) / max(n - 1, 1)
    runs = both(math.copysign(max(abs(r - mean) - 0.5, 0), r - mean) / math.sqrt(var)) if var > 0 else max(2.0 ** (1 - min(n, 45)), 1e-15)
    m = sum(x) / n
    ss = sum((c - m) ** 2 for c in x)
    serial = both((sum((x[i] - m) * (x[(i + 1) % n] - m) for i in range(n)) / ss + 1 / max(n - 1, 1)) * math.sqrt(n)) if ss > 1e-9 else 1e-15
    h = -(math.log(chi) + math.log(runs) + math.log(serial))
    return chi, runs, serial, math.exp(-h) * (1 + h + h * h / 2)


def test_battery_against_plain_python():
    r = random.Random(3)
    strings = [[r.randrange(k) for _ in range(n)] for k in (10, 16, 26, 62) for n in (16, 23, 40, 128)] + [[0] * 20, list(range(26)), [1, 0] * 12]
    sizes = [k for k in (10, 16, 26, 62) for _ in range(4)] + [26, 26, 16]
    first = np.concatenate([[0], np.cumsum([len(x) for x in strings])])
    got = np.array(ss.battery(np.concatenate(strings).astype(np.int64), first, np.array(sizes))).T
    for row, x, k in zip(got, strings, sizes, strict=True):
        assert np.allclose(row, plain_battery(x, k), rtol=2e-3, atol=1e-6)


def plain_scan(texts):
    """{(text, start, length)} reported, from regular expressions, lists and a Benjamini-Hochberg loop."""
    bucket = lambda s: min(int(s * ss.BUCKETS), ss.BUCKETS - 1)
    size_class = lambda n: max(i for i, c in enumerate(ss.CLASSES) if c <= n)
    pools, found = [[] for _ in ss.CLASSES], []
    for d, t in enumerate(texts):
        letters = [ord(c) - 97 for c in (t or "").lower() if "a" <= c <= "z"]
        at = i = 0
        while at + ss.CLASSES[i] <= len(letters):
            n = int(ss.CLASSES[i])
            pools[i].append(bucket(plain_battery(letters[at : at + n], 26)[3]))
            at, i = at + n, (i + 1) % len(ss.CLASSES)
        for m in re.finditer(rf"[A-Za-z0-9+/_-]{{{ss.MIN_CHARS},}}", t or ""):
            run = m[0]
            for name, chars in ss.ALPHABETS:
                body = run[1:] if name == "word" and run[0].isupper() else run
                if all(c in chars for c in body):
                    break
            if name not in ("word", "upper") and len(run) * math.log2(len(chars)) >= ss.MIN_BITS:
                found.append((d, m.start(), len(run), bucket(plain_battery([chars.index(c) for c in run], len(chars))[3])))
    p = []
    for _, _, n, b in found:
        i = size_class(n)
        pool = list(pools[i])
        for j in range(i - 1, -1, -1):
            if len(pool) >= ss.MIN_REFERENCE:
                break
            pool += pools[j]
        assert len(pool) >= ss.MIN_REFERENCE  # the fixture needs no simulated letters
        p.append((1 + sum(x >= b for x in pool)) / (1 + len(pool)))
    ordinary = min(1.0, (1 + sum(x > ss.LAMBDA for x in p)) / ((1 - ss.LAMBDA) * len(p)))
    out, least = set(), 1.0
    for x in sorted(set(p), reverse=True):
        least = min(least, ordinary * x * len(p) / sum(y <= x for y in p))
        if x <= ss.LAMBDA and least <= ss.FDR:
            out |= {f[:3] for f, y in zip(found, p, strict=True) if y == x}
    return out


def test_operator_against_plain_python(spark):
    r = random.Random(5)
    texts = [english(500, i) for i in range(150)]
    for i in range(0, 150, 3):
        texts[i] += " " + "".join(r.choice("0123456789abcdef") for _ in range(40)) + " end"
        texts[i + 1] += " path/to-some_file_name/" + "".join(r.choice("abc") for _ in range(12)) + "0123 " + "x1" * 12
    docs = spark.createDataFrame(list(enumerate(texts)) + [(500, None), (501, "")], "doc_id long, text string")
    got = {(x.doc_id, x.start, x.length) for x in ss.secret_spans(docs).collect()}
    assert got == plain_scan(texts) and len(got) >= 40
