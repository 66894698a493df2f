"""Cost-balanced packing of documents into training sequences.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n``: the layers' linear
work and attention inside the document. Documents longer than a sequence are cut
into pieces of its capacity; no token is dropped. Pieces go to shards by a hash, as many as
the corpus has ``shard_tokens``; in each shard the pieces, in descending cost, go
one by one to the sequence of lowest cost that still has room for them. A
shard starts with as many sequences as its tokens fill and opens another only if
a piece fits none.

Lengths are those of the tokenizer's ids, the id that closes a document included, so a sequence never overflows; piece p of a
document is its ids from p * capacity on. Only ids and lengths are shuffled; a shard is packed by one task whose size does
not depend on the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, row_key
from .token_shards import token_count

CAPACITY, SHARD_TOKENS, LINEAR, QUADRATIC = 4096, 4_194_304, 1.0, 1 / 12288


def pack(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, int]:
    """The sequence of each piece (given in descending length) and the number of sequences."""
    n = max(1, -(-int(lengths.sum()) // capacity))
    room, cost = np.full(n, capacity, np.int64), np.zeros(n)
    out = np.empty(len(lengths), np.int64)
    for i, m in enumerate(lengths.tolist()):
        fits = np.where(room >= m, cost, np.inf)
        s = int(fits.argmin())
        if fits[s] == np.inf:
            s = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        room[s] -= m
        cost[s] += linear * m + quadratic * m * m
        out[i] = s
    return out, len(room)


def pack_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokens: Column | None = None, capacity: int = CAPACITY,
    shard_tokens: int = SHARD_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row per sequence: shard, sequence, doc_ids, pieces, lengths (in packing order), n_tokens and cost.

    ``tokens`` is the column of token counts; unless given, the tokenizer of ``token_shards`` counts them.
    Texts that are null, empty or without tokens take no room and are left out. Repeated rows are
    packed each; ids keep their type and a null one stays null in ``doc_ids``. An empty table gives no rows. Ties go by
    id (null last), row and piece, and to the sequence opened first.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    count = F.coalesce((token_count(F.col(text_column).cast("string")) if tokens is None else tokens).cast("long"), F.lit(0))
    # Ids and lengths alone are written, so that no text is tokenized twice.
    sized = Scratch(docs.sparkSession, "pack").write(docs.select(row_key(id_column, text_column).alias("rk"), F.col(id_column).alias("id"), count.alias("n"))).where("n > 0")
    shards = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // shard_tokens))
    pieces = sized.select("rk", "id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}"))).alias("piece"))
    spread = pieces.select("rk", "id", "piece", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("m"), F.pmod(F.xxhash64("rk", "piece"), F.lit(shards)).alias("shard"))

    def run(table: pa.Table) -> pa.Table:
        rk, ids, piece, m = (table[c].combine_chunks() for c in ("rk", "id", "piece", "m"))
        lengths = m.to_numpy()
        order = np.lexsort((piece.to_numpy(), rk.to_numpy(), pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy(), -lengths))
        to, n = pack(lengths[order], capacity, linear, quadratic)
        order = order[np.argsort(to, kind="stable")]
        off = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=n))]).astype(np.int32)
        used = np.flatnonzero(np.diff(off))
        lists = lambda a: pa.ListArray.from_arrays(pa.array(off), a.take(pa.array(order))).take(pa.array(used))
        own = lengths[order].astype(np.float64)
        return pa.table({
            "shard": pa.array(np.full(len(used), table["shard"][0].as_py())), "sequence": pa.array(np.arange(len(used))), "doc_ids": lists(ids), "pieces": lists(piece), "lengths": lists(m),
            "n_tokens": pa.array(np.add.reduceat(own, off[used]).astype(np.int64)), "cost": pa.array(np.add.reduceat(linear * own + quadratic * own * own, off[used])),
        })

    return spread.groupBy("shard").applyInArrow(run, f"shard long, sequence long, doc_ids array<{kind}>, pieces array<long>, lengths array<long>, n_tokens long, cost double")
