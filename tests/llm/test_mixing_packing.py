import heapq
from collections import Counter, defaultdict

import duckdb
import numpy as np
from kinmark.llm import mixing, packing, token_shards

from pyspark.sql import functions as F

from .cases import awkward, awkward_rows, empty, prose


def test_quotas_are_sainte_lague(spark):
    rows = [(i, prose(100 + i % 50, i), f"s{min(i % 7, 3)}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"s0": 5.0, "s1": 3.0, "s2": 1.0}
    got = mixing.mixed_rows(docs, weights=weights, block_tokens=512, shard_tokens=1 << 17, fraction=0.3)[0].collect()
    have = mixing.mixed_rows(docs, fraction=1.0, block_tokens=512, shard_tokens=1 << 17)[0].collect()
    avail = {(r.shard, r.source): r.quota for r in have}
    quota = {(r.shard, r.source): r.quota for r in got}
    for shard in {k[0] for k in avail}:
        n = {s: avail[shard, s] for s in ("s0", "s1", "s2", "s3")}
        seats = int(0.3 * sum(n.values()))
        won = Counter()
        for _ in range(seats):  # the textbook method, a seat at a time
            best = max((s for s in weights if won[s] < n[s]), key=lambda s: (weights[s] / (2 * won[s] + 1), -ord(s[1])), default=None)
            if best is None:
                break
            won[best] += 1
        assert {s: quota.get((shard, s), 0) for s in n} == {s: won[s] for s in n}
    blocks = defaultdict(set)
    for r in got:
        blocks[r.shard, r.source].add(r.block)
    assert all(len(b) <= quota[k] for k, b in blocks.items())


def test_equals_sql(spark, sf_dir):
    got = sorted(map(tuple, mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert got == sorted(con.sql(mixing.mixing_sql(tempered=False)).fetchall())
    got = sorted(map(tuple, mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), tempered=True, shard_tokens=1 << 15, block_tokens=256).collect()))
    want = sorted(con.sql(mixing.mixing_sql(256, 1 << 15)).fetchall())
    assert got == want and len({r[3:5] for r in want}) > 1


def test_kept_rows_are_those_mixed(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = mixing.keep_mixed(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in mixing.mix_sources(docs).collect())


def test_mixing_awkward_and_empty(spark):
    docs = awkward(spark)
    every = mixing.keep_mixed(docs, fraction=1.0)
    assert every.columns == docs.columns and every.count() == docs.count()
    half = mixing.keep_mixed(docs, fraction=0.5, block_tokens=16)
    assert sum(r.doc_id == 6 for r in half.collect()) in (0, 3)  # repeated rows go together
    assert mixing.mix_sources(empty(spark)).count() == 0 and mixing.keep_mixed(empty(spark)).count() == 0


def test_ties_and_seats_even_out_over_shards(spark):
    rows = [(i, "x" * 256, f"s{i % 12:02}") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"block_tokens": 8192, "shard_tokens": 2560}  # each source has one block in a shard
    named = mixing.mixed_rows(docs, **options)[0].select("shard", "source").distinct().collect()
    assert len({r.source for r in named}) < 12  # the SQL's order: late names never win
    even = mixing.mixed_rows(docs, even=True, **options)[0].select("shard", "source").distinct().collect()
    have = mixing.mixed_rows(docs, even=True, fraction=1.0, **options)[0].select("shard", "source").distinct().collect()
    assert len({r.source for r in even}) == 12 and len(even) == -(-len(have) // 2)
    won = Counter(r.source for r in even)
    assert max(won.values()) <= 2 * min(won.values())


def test_one_block_is_kept(spark):
    docs = spark.createDataFrame([(1, "one short text", "a")], "doc_id long, text string, source string")
    assert mixing.keep_mixed(docs, even=True).count() == 1 and mixing.keep_mixed(docs).count() == 1


def brute_pack(lengths, capacity, linear, quadratic):
    n = max(1, -(-sum(lengths) // capacity))
    bins = [[0.0, i, capacity] for i in range(n)]
    out = []
    for m in lengths:
        open_ = [b for b in bins if b[2] >= m]
        if not open_:
            bins.append([0.0, len(bins), capacity])
            open_ = [bins[-1]]
        b = heapq.nsmallest(1, open_)[0]
        b[0] += linear * m + quadratic * m * m
        b[2] -= m
        out.append(b[1])
    return out


def test_pack_against_brute_force():
    r = np.random.default_rng(1)
    for _ in range(20):
        m = np.sort(r.integers(1, 400, 200))[::-1]
        got, n = packing.pack(m, 512, 1.0, 1 / 100)
        assert got.tolist() == brute_pack(m.tolist(), 512, 1.0, 1 / 100) and n > max(got)


def test_every_token_is_packed_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: -(-len(r.text) // 4) for r in docs.select("doc_id", "text").collect()}
    seqs = packing.pack_documents(docs, tokens=mixing.token_estimate(F.col("text")), shard_tokens=1 << 15).collect()
    got = Counter()
    for s in seqs:
        assert s.n_tokens == sum(s.lengths) <= packing.CAPACITY
        assert np.isclose(s.cost, sum(m + m * m / 12288 for m in s.lengths))
        for d, m in zip(s.doc_ids, s.lengths, strict=True):
            got[d] += m
    assert got == want
    assert len({(d, p) for s in seqs for d, p in zip(s.doc_ids, s.pieces, strict=True)}) == sum(len(s.doc_ids) for s in seqs)
    assert len({s.shard for s in seqs}) > 1


def test_shards_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seqs = packing.pack_documents(docs, tokens=mixing.token_estimate(F.col("text")), shard_tokens=1 << 15).collect()
    for shard in {s.shard for s in seqs}:
        own = [s for s in seqs if s.shard == shard]
        lengths = sorted((m for s in own for m in s.lengths), reverse=True)
        to = brute_pack(lengths, packing.CAPACITY, packing.LINEAR, packing.QUADRATIC)
        loads = defaultdict(list)
        for m, b in zip(lengths, to, strict=True):
            loads[b].append(m)
        assert sorted(sorted(s.lengths, reverse=True) for s in own) == sorted(loads.values())


def test_packing_awkward_and_empty(spark):
    got = packing.pack_documents(awkward(spark), tokens=mixing.token_estimate(F.col("text")), capacity=64).collect()
    total = sum(-(-len(r[1]) // 4) for r in awkward_rows() if r[1])
    assert sum(s.n_tokens for s in got) == total
    assert sum(m for s in got for d, m in zip(s.doc_ids, s.lengths, strict=True) if d == 6) == 3 * -(-len(prose(80, 1)) // 4)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_lengths_are_those_of_the_ids(spark):
    texts = {"a": "one two three", "b": prose(60, 1), "c": "", "d": None, "e": "\n" * 9000}
    seqs = packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id string, text string"), capacity=32).collect()
    got = Counter()
    for s in seqs:
        assert s.n_tokens <= 32
        for d, m in zip(s.doc_ids, s.lengths, strict=True):
            got[d] += m
    assert got == {d: len(token_shards.encode(token_shards.TOKENIZER, t)) + 1 for d, t in texts.items() if t}
