"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Rows go to shards by a seeded hash of their id; there are as many shards as the
   corpus has ``shard_tokens``, so a shard stays the same size whatever the input,
   and so does a hot source's share of it.
2. In a shard the rows of a source, in seeded hash order, are laid end to end and cut
   into blocks of ``block_tokens``; a row belongs to the block in which it ends.
3. The k-th block of a source has the quotient weight / (2 k - 1). The highest quotients
   of a shard win until ``fraction`` of its blocks are allocated: that gives
   integer quotas per source, never above what the source has in the shard; a shard has one seat at least.
   Equal quotients go by source name; with ``even`` by a seeded hash of shard and source, and the part of a
   seat that rounding leaves is carried to the next shard, rounded up from the first on. ``tempered`` weighs each
   source by the square root of its tokens in the whole corpus, between its own share and equal parts.
4. A source's quota is filled with its blocks in seeded hash order.

All of it is window functions over (shard, source) and over shards: no driver-side loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch, free_name, row_key

BLOCK_TOKENS, SHARD_TOKENS, FRACTION, SEED, CHARS_PER_TOKEN = 4096, 4_194_304, 0.5, 17, 4


def token_estimate(text: Column) -> Column:
    """A token for every four characters or part of them; null has none."""
    return F.coalesce(F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)), F.lit(0)).cast("long")


def target_weight(source: Column, weights: dict[str, float] | None) -> Column:
    """Without weights all sources have the same; a source that isn't named has none."""
    if weights is None:
        return F.lit(1.0)
    out = F.lit(0.0)
    for name, w in weights.items():
        out = F.when(source == name, float(w)).otherwise(out)
    return out


def mixed_rows(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: dict[str, float] | None = None,
    fraction: float = FRACTION, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED, even: bool = False, tempered: bool = False,
) -> tuple[DataFrame, Scratch]:
    """Rows (rk, id, source, shard, block, quota, tokens) of the chosen rows."""
    scratch = Scratch(docs.sparkSession, "mix")
    name = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_column), F.lit("")))))
    rows = scratch.write(
        docs.select(
            row_key(id_column, text_column).alias("rk"), F.col(id_column).alias("id"), F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"),
            token_estimate(F.col(text_column)).alias("tokens"), F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("h"),
        )
    )
    shards = max(1, -(-(rows.agg(F.sum("tokens")).first()[0] or 0) // shard_tokens))
    placed = rows.withColumn("shard", F.pmod(F.conv(F.substring("h", 1, 15), 16, 10).cast("long"), F.lit(shards)))
    # Repeated rows are peers in the range frame, so they end together and share a block.
    ends = F.sum("tokens").over(W.partitionBy("shard", "source").orderBy("h", "rk").rangeBetween(W.unboundedPreceding, W.currentRow))
    laid = scratch.write(placed.withColumn("block", F.floor(F.greatest(ends - 1, F.lit(0)) / block_tokens)).drop("h"))
    have = laid.groupBy("shard", "source").agg((F.max("block") + 1).alias("n"))
    blocks = have.select("shard", "source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    if tempered:
        # Tables of sources may be long (a source per site), so this one is shuffled too.
        weighed = rows.groupBy("source").agg(F.sqrt(F.sum("tokens").cast("double")).alias("weight"))
        weighed = blocks.join(weighed.hint("merge"), "source").select("shard", "source", "k", "weight")
    else:
        weighed = blocks.withColumn("weight", target_weight(F.col("source"), weights))
    quotient = weighed.withColumn("quotient", F.col("weight") / (2 * F.col("k") - 1)).withColumn("all", F.count("*").over(W.partitionBy("shard")))
    tie = [F.md5(F.concat_ws(":", F.lit(f"{seed}:tie"), "shard", "source"))] if even else []
    rank = F.row_number().over(W.partitionBy("shard").orderBy(F.col("quotient").desc(), *tie, "source", "k"))
    ranked = quotient.withColumn("rank", rank)
    if even:
        # One row per shard: the seats up to and with it, less those before it.
        upto = F.sum("size").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow))
        seats = lambda n: F.ceil(F.round(F.lit(float(fraction)) * n, 6))
        per_shard = have.groupBy("shard").agg(F.sum("n").alias("size")).withColumn("upto", upto).select("shard", (seats(F.col("upto")) - seats(F.col("upto") - F.col("size"))).alias("seats"))
        ranked = ranked.join(per_shard.hint("merge"), "shard")
    else:
        ranked = ranked.withColumn("seats", F.greatest(F.lit(1), F.floor(F.lit(float(fraction)) * F.col("all"))))
    quotas = ranked.where((F.col("rank") <= F.col("seats")) & (F.col("quotient") > 0)).groupBy("shard", "source").agg(F.count("*").alias("quota"))
    order = F.row_number().over(W.partitionBy("shard", "source").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "shard", "source", F.col("k") - 1)), "k"))
    chosen = blocks.withColumn("turn", order).join(quotas.hint("merge"), ["shard", "source"]).where("turn <= quota").select("shard", "source", (F.col("k") - 1).alias("block"), "quota")
    # Quotas and chosen blocks grow with the corpus, so neither is ever broadcast.
    return laid.join(chosen.hint("merge"), ["shard", "source", "block"]).select("rk", "id", "source", "shard", "block", "quota", "tokens"), scratch


def mix_sources(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """One row per chosen document: doc_id, source, shard, block, its source's quota there, and tokens.

    Null and empty sources are one source named ''. A null text has no tokens and goes
    with the block at its place; a null id is placed by its text. Repeated rows
    are chosen or left together. An empty table gives no rows.
    """
    return mixed_rows(docs, id_column, **options)[0].select(F.col("id").alias("doc_id"), "source", "shard", "block", "quota", "tokens")


def keep_mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The chosen rows with all their own columns, whatever their names.

    Nulls, repeated rows and empty tables as in ``mix_sources``; a table of one block stays whole.
    Their keys grow with the corpus, so both sides are shuffled at every size and never broadcast.
    """
    chosen, scratch = mixed_rows(docs, id_column, text_column, source_column, **options)
    rk = free_name(docs.columns, "__rk")
    keys = scratch.write(chosen.select(F.col("rk").alias(rk)).distinct())
    return docs.withColumn(rk, row_key(id_column, text_column)).join(keys.hint("merge"), rk, "left_semi").select(*docs.columns)


def mixing_sql(block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, fraction: float = FRACTION, seed: int = SEED, tempered: bool = True) -> str:
    """DuckDB SQL for ``mix_sources`` with tempered or equal weights over the table documents."""
    weight = "sqrt(CAST(tokens AS DOUBLE))" if tempered else "1.0::DOUBLE"
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(coalesce(ceil(length(text) / {CHARS_PER_TOKEN}.0), 0) AS BIGINT) AS tokens, md5('{seed}:' || doc_id) AS h
  FROM documents),
placed AS (
  SELECT *, CAST('0x' || substr(h, 1, 15) AS BIGINT) % (SELECT greatest(1, CAST(ceil(sum(tokens) / {shard_tokens}.0) AS BIGINT)) FROM base) AS shard FROM base),
laid AS (
  SELECT *, CAST(floor(greatest(CAST(sum(tokens) OVER (PARTITION BY shard, source ORDER BY h, doc_id) AS BIGINT) - 1, 0) / {block_tokens}.0) AS BIGINT) AS block FROM placed),
have AS (SELECT shard, source, max(block) + 1 AS n FROM laid GROUP BY ALL),
blocks AS (SELECT shard, source, unnest(range(1, n + 1)) AS k FROM have),
weights AS (SELECT source, {weight} AS weight FROM (SELECT source, sum(tokens) AS tokens FROM base GROUP BY source)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY shard ORDER BY weight / (2 * k - 1) DESC, source, k) AS rank, count(*) OVER (PARTITION BY shard) AS total FROM blocks JOIN weights USING (source)),
quotas AS (SELECT shard, source, count(*) AS quota FROM ranked WHERE rank <= greatest(1, floor({fraction}::DOUBLE * total)) AND weight > 0 GROUP BY ALL),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY shard, source ORDER BY md5('{seed}:' || shard || ':' || source || ':' || (k - 1)), k) AS turn FROM blocks),
chosen AS (SELECT shard, source, k - 1 AS block, quota FROM turns JOIN quotas USING (shard, source) WHERE turn <= quota)
SELECT doc_id, source, shard, block, quota, tokens FROM laid JOIN chosen USING (shard, source, block)"""
