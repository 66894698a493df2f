import numpy as np
from kinmark.llm import pii

from .cases import awkward, empty, prose


def test_gradient():
    m = pii.Tagger(3, 0)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, pii.VOCABULARY, (2, 12)).astype(np.int32), r.integers(0, pii.TAGS, (2, 12))
    _, g = m.loss(x, y)
    for k in g:
        at = (1, 2, int(x[0, 5]), 1) if k == "E" else tuple(int(r.integers(0, n)) for n in m.p[k].shape)
        old = m.p[k][at]
        m.p[k][at] = old + 0.02
        up = m.loss(x, y)[0]
        m.p[k][at] = old - 0.02
        down = m.loss(x, y)[0]
        m.p[k][at] = old
        assert abs((up - down) / 0.04 - g[k][at]) < 2e-3 + 0.02 * abs(g[k][at])


def test_viterbi_against_all_paths():
    from itertools import product

    m = pii.Tagger(2, 0)
    r = np.random.default_rng(1)
    m.p |= {"A": r.normal(size=(pii.TAGS, pii.TAGS)), "s": r.normal(size=pii.TAGS), "e": r.normal(size=pii.TAGS)}
    a, s, e = m.moves
    score = r.normal(size=(1, 4, pii.TAGS))
    value = lambda t: s[t[0]] + e[t[-1]] + sum(score[0, i, k] for i, k in enumerate(t)) + sum(a[x, y] for x, y in zip(t, t[1:], strict=False))
    assert tuple(m.viterbi(score)[0]) == max(product(range(pii.TAGS), repeat=4), key=value)


def test_held_out_accuracy():
    model, right, found, want = pii.default_tagger(), 0, 0, 0
    test = pii.synthetic_examples(800, 12345)
    for (_, s), h in zip(test, pii.find_spans(model, [t for t, _ in test]), strict=True):
        right, found, want = right + len(set(s) & set(h)), found + len(h), want + len(s)
    assert right / found > 0.98 and right / want > 0.98


def brute_spans(model, text):
    """Every window of the text, one by one, and one Viterbi pass over every character."""
    p = pii.char_ids(pii.code_points(text))
    if not len(p):
        return []
    n = max(1, -(-(len(p) - pii.WINDOW + pii.STRIDE) // pii.STRIDE))
    total, weight = np.zeros((len(p), pii.TAGS)), np.zeros((len(p), 1))
    for w in range(n):
        at = w * pii.STRIDE
        x = np.zeros((1, pii.WINDOW), np.int32)
        own = p[at : at + pii.WINDOW]
        x[0, : len(own)] = own
        tri = (np.minimum(np.arange(pii.WINDOW), pii.WINDOW - 1 - np.arange(pii.WINDOW))[:, None] + 1.0)[: len(own)]
        total[at : at + len(own)] += model.scores(x)[0][: len(own)] * tri
        weight[at : at + len(own)] += tri
    tags = model.viterbi((total / weight)[None].astype(np.float32))[0]
    spans, t = [], 0
    while t < len(tags):
        b = t + 1
        if tags[t]:
            kind = (tags[t] + 1) // 2
            while b < len(tags) and tags[b] == 2 * kind:
                b += 1
            spans.append((t, b, pii.TYPES[kind - 1]))
        t = b
    return spans


def test_whole_texts_against_brute_force():
    model = pii.default_tagger()
    parts = [t for t, _ in pii.synthetic_examples(40, 4)]
    texts = ["", "no digits", "jane at home", prose(200, 1) + " call +1 (517) 555-0938 " + prose(200, 2), " ".join(parts), parts[0] + prose(30, 3) + parts[1], "4111111111111111", "é" * 47 + " 10.20.30.40"]
    got = pii.find_spans(model, texts)
    for t, own in zip(texts, got, strict=True):
        assert own == brute_spans(model, t)
    a, b, kind = got[3][0]
    assert texts[3][a:b] == "+1 (517) 555-0938" and kind == "PHONE"


def test_pieces_of_long_texts_against_brute_force(monkeypatch):
    """Texts that are held piece by piece, and a network whose best paths are often in doubt."""
    parts = [t for t, _ in pii.synthetic_examples(120, 9)]
    texts = [" ".join(parts), parts[0], "", "7" * 900, "x@" * 700 + prose(100, 5)]
    model = pii.default_tagger()
    want = [brute_spans(model, t) for t in texts]
    monkeypatch.setattr(pii, "HELD", 600)
    monkeypatch.setattr(pii, "RUN_WINDOWS", 2)
    assert pii.find_spans(model, texts) == want
    loose = pii.Tagger(4, 3)
    assert pii.find_spans(loose, texts[:3]) == [brute_spans(loose, t) for t in texts[:3]]


def test_digits_of_other_scripts():
    assert pii.char_ids(pii.code_points("\uff11\u0661\u0967@\uff20")).tolist() == [49, 49, 49, 64, 64]
    text = "call +1 (517) 555-0938 now"
    wide = text.translate({ord(c): 0xFF10 + int(c) for c in "0123456789"})
    got = pii.find_spans(pii.default_tagger(), [text, wide])
    assert got[0] == got[1] == [(5, 22, "PHONE")]


def test_awkward_masks_and_empty(spark):
    docs = awkward(spark)
    assert pii.personal_spans(docs).count() == 0 and pii.personal_spans(empty(spark)).count() == 0
    text = "write to jo.smith@mail3.example.com or 10.1.2.3 é now"
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    got = pii.personal_spans(rows).collect()
    assert len(got) == 6 and {(text[r.start : r.end], r.type) for r in got} == {("jo.smith@mail3.example.com", "EMAIL"), ("10.1.2.3", "IP")}
    from pyspark.sql import functions as F

    out = [r.t for r in rows.select(pii.masked(F.col("text")).alias("t")).collect()]
    assert out == ["write to [EMAIL] or [IP] é now"] * 3 + [None]
