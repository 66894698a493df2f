import numpy as np
import pyarrow as pa
from kinmark.llm import quality as q

from .cases import awkward, empty


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()
    known.sort(key=lambda r: hash(r.doc_id * 7919 % 1009))
    cut = len(known) * 2 // 3
    rows = [(i, v, r.quality) for r, (i, v) in zip(known[:cut], q.sparse(pa.array([r.text for r in known[:cut]])), strict=True)]
    score = q.train(rows).score(pa.array([r.text for r in known[cut:]]))
    right = np.array([r.quality for r in known[cut:]])
    assert ((score >= q.THRESHOLD) == (right == 1)).mean() > 0.93
    assert (score[right == 1] >= q.THRESHOLD).mean() > 0.97


def test_score_is_the_sparse_dot_product():
    texts = pa.array(["one two three two", "", "good words here ###"])
    m = q.Model(np.random.default_rng(0).normal(size=1 << q.BITS).astype(np.float32), 0.3)
    for i, (idx, val) in enumerate(q.sparse(texts)):
        want = 1 / (1 + np.exp(-(m.weights[idx] @ val + 0.3))) if len(idx) else 0.0
        assert np.isclose(m.score(texts)[i], want, atol=1e-4)


def test_ftrl_against_plain_python():
    rows = [(np.array([1, 5], np.int32), np.array([0.5, 1.0], np.float32), 1), (np.array([5, 9], np.int32), np.array([1.0, 2.0], np.float32), 0)]
    m = q.train(rows, bits=4, epochs=2, seed=1)
    z, n, order = {}, {}, np.random.default_rng(1)

    def w(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= q.L1 else -(zi - np.sign(zi) * q.L1) / ((q.BETA + n.get(i, 0.0) ** 0.5) / q.ALPHA + q.L2)

    for _ in range(2):
        for r in order.permutation(2):
            idx, val, y = rows[r]
            x = dict(zip(idx.tolist(), val.tolist(), strict=True)) | {16: 1.0}
            p = 1 / (1 + np.exp(-sum(w(i) * v for i, v in x.items())))
            old = {i: w(i) for i in x}
            for i, v in x.items():
                g = (p - y) * v
                s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / q.ALPHA
                z[i] = z.get(i, 0.0) + g - s * old[i]
                n[i] = n.get(i, 0.0) + g * g
    assert np.allclose([m.weights[i] for i in (1, 5, 9)], [w(i) for i in (1, 5, 9)], atol=1e-6) and np.isclose(m.bias, w(16))


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(6, 1, 0, "x"), (8, 0, 0, "x"), (8, 1, 0, "y"), (None, 1, 0, "z"), (5, None, 0, "z")], "doc_id long, quality int, toxic int, text string")
    scored = q.quality_scores(docs, labels)
    assert scored.count() == docs.count() and scored.columns == ["doc_id", "score", "kept"]
    assert not any(r.kept for r in scored.collect() if r.doc_id in (0, 1, 2))
    kept = q.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == scored.where("kept").count()
    none = labels.limit(0)
    assert {r.score for r in q.quality_scores(docs, none).collect()} == {0.0, 0.5}
    assert q.quality_scores(empty(spark), labels).count() == 0 and q.drop_low_quality(empty(spark), none).count() == 0


def test_sample_is_bounded_by_rows_and_ids_may_be_strings(spark):
    docs = spark.createDataFrame([("a", "good words here")] * 50 + [("b", "### bad %%")] * 50 + [("c", f"text {i}") for i in range(30)], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1)], "doc_id string, quality int")
    assert len(q.labelled_rows(docs, labels, "doc_id", "text", 1000)) == 32
    assert len(q.labelled_rows(docs, labels, "doc_id", "text", 5)) == 5
    assert q.quality_scores(docs, labels).count() == 130
