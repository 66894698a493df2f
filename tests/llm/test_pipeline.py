import re

import pytest
from kinmark.llm import mixing, near_dedup, packing, quality, secret_scan

from .cases import awkward, empty, prose

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    after = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = after[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == first.columns
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in after.items() if n != "packing"}
    assert ids["near_dedup"] and set(ids["mixing"]) < set(ids["secrets"]) == set(ids["near_dedup"]) < set(ids["quality"]) < {r.doc_id for r in first.collect()}
    good = quality.quality_scores(first, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept")
    assert sorted(r.doc_id for r in good.collect()) == sorted(ids["quality"])
    groups = near_dedup.duplicate_groups(after["quality"]).collect()
    assert set(ids["quality"]) - set(ids["near_dedup"]) == {r.doc_id for r in groups if not r.kept}
    before, now = ({r.doc_id: r for r in after[n].collect()} for n in ("near_dedup", "secrets"))
    for i, r in now.items():
        assert r.n_chars == len(r.text)
        parts = r.text.split(secret_scan.MASK)
        assert re.fullmatch(r"[A-Za-z0-9+/_-]{16,}".join(re.escape(p) for p in parts), before[i].text, re.S)
    assert sorted(ids["mixing"]) == sorted(r.doc_id for r in mixing.mix_sources(after["secrets"], even=True).collect())
    packed = [d for r in after["packing"].collect() for d in r.doc_ids]
    assert set(packed) == set(ids["mixing"])
    assert after["packing"].count() == packing.pack_documents(after["mixing"]).count()


def test_run(spark, sf_dir):
    a = sorted(map(tuple, pipeline.run(spark, sf_dir).select("shard", "sequence", "n_tokens").collect()))
    assert a and a == sorted(map(tuple, pipeline.run(spark, sf_dir).select("shard", "sequence", "n_tokens").collect()))
    assert pipeline.ORACLE_SQL is None


def test_awkward_and_empty_tables(spark, tmp_path):
    """Every stage over tables with nulls, blanks, long texts, repeated rows and clashing names, and over empty ones."""
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (8, 1, 0), (None, 1, 0), (3, None, None), (2, 0, 0)], "doc_id long, quality int, toxic int")
    more = spark.createDataFrame([(100 + i, prose(60, 50 + i)) for i in range(5)], "doc_id long, text string")
    for name, docs in (("awkward", awkward(spark).unionByName(more, allowMissingColumns=True)), ("empty", empty(spark))):
        at = f"{tmp_path}/{name}"
        docs.write.parquet(f"{at}/documents.parquet")
        (labels if name == "awkward" else labels.limit(0)).write.parquet(f"{at}/labels.parquet")
        kept = docs
        for stage, f in pipeline.STAGES:
            kept = f(spark, kept, at)
            if stage != "packing":
                assert kept.columns == docs.columns
            kept.write.parquet(f"{at}/{stage}")
            kept = spark.read.parquet(f"{at}/{stage}")
        got = sorted(map(str, pipeline.run(spark, at).collect()))
        assert got == sorted(map(str, kept.collect())) and bool(got) == (name == "awkward")
