import numpy as np
import pytest
from kinmark.llm import ball_tree as bt
from pyspark.sql import functions as F


def brute(ids, v, k, asks):
    score = np.round(v @ v.T, bt.DECIMALS)
    out = {}
    for i, one in enumerate(ids):
        if asks(one):
            out[one] = [(n, -s) for s, n in sorted(((-score[i, j], ids[j]) for j in range(len(ids)) if ids[j] != one))[:k]]
    return out


def check(spark, ids, v, k, shard, every=1, **options):
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in zip(ids, v, strict=True)], ("string" if isinstance(ids[0], str) else "long").join(["vec_id ", ", embedding array<float>"]))
    got = {}
    for r in sorted(bt.top_k(df, k=k, shard_vectors=shard, asks=F.col("vec_id") % every == 0 if every > 1 else None, **options).collect(), key=lambda r: (r.vec_id, r.rank)):
        got.setdefault(r.vec_id, []).append((r.neighbor_id, r.score))
    want = brute(ids, np.asarray(v, np.float32).astype(np.float64), k, lambda i: every == 1 or i % every == 0)
    assert set(got) == {i for i, x in want.items() if x}
    for i, x in got.items():
        assert [n for n, _ in x] == [n for n, _ in want[i]]
        assert np.allclose([s for _, s in x], [s for _, s in want[i]], atol=1e-8)


@pytest.mark.parametrize("shard,every,block", [(64, 1, 100), (10_000, 1, 65_536), (32, 10, 64)])
def test_against_brute_force(spark, shard, every, block):
    r = np.random.default_rng(0)
    centres = r.normal(size=(5, 12)) * 3
    v = centres[r.integers(5, size=700)] + r.normal(size=(700, 12))
    check(spark, list(range(700)), v, 7, shard, every, query_block=block, max_regions=4)


def test_string_ids(spark):
    r = np.random.default_rng(1)
    check(spark, [f"v{'x' * int(n)}{i}" for i, n in enumerate(r.integers(0, 9, 150))], r.normal(size=(150, 6)), 4, 32)


def test_what_the_driver_holds_is_bounded():
    """The planes, and so the regions and their balls, stay at the bound for ten times the vectors."""
    v = np.random.default_rng(2).normal(size=(8000, 8))
    for n in (800, 8000):
        router = bt.Router(v[: bt.SAMPLE][:n], min(4, -(-n // 8)))
        assert len(set(router.route(v[:n]))) <= 4


def test_ties_and_copies(spark):
    v = np.tile(np.eye(4), (60, 1))
    check(spark, list(range(240)), v, 5, 32)


def test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    check(spark, [r.vec_id for r in rows], [r.embedding for r in rows], 10, 100)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, [0.5, 0.5], "a"), (None, [9.0, 9.0], "a"), (3, None, "a"), (4, [], "a"), (5, [1.0], "a"), (6, [float("nan"), 1.0], "a"), (7, [1.0, None], "a"), (8, [float("inf"), 1.0], "a"), (9, [0.0, 0.0], "a")]
    rows = [(*r, "v", 0, 1, 1, 1) for r in rows]
    got = bt.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, v string, asked int, region long, piece long, block long")).collect()
    assert {(r.vec_id, r.neighbor_id) for r in got} == {(a, b) for a in (1, 2, 9) for b in (1, 2, 9) if a != b}
    assert len(got) == 6
    assert bt.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert bt.top_k(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0
    rows = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert bt.top_k(rows, asks=F.lit(False)).count() == 0 and bt.top_k(rows, asks=F.lit(None).cast("boolean")).count() == 0
