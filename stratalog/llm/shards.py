"""Shards by vector bin packing of bounded lots of groups; bytes, tokens and rows are balanced together.

Groups of equal texts fall whole, by hash, into ``LOTS`` lots. A group with a larger share of all bytes or of all rows than
1 / ``LOTS`` is an item of its own and is counted in pieces of about that share; there are fewer than ``2 * LOTS`` such
groups and ``4 * LOTS`` pieces whatever the input is, so what is packed has a bounded size. Only a group that exceeds
a shard's capacity (all bytes / shards, or all rows / shards), and so fits in none, is packed piece by piece, so its copies come
to different shards. Items are taken largest first; each goes to the shard where the dot product of its vector with the
shard's residual capacity is highest. Bytes weigh most in it, as the law says; tokens and rows decide where bytes hardly differ. Nothing depends on where a row lies in the input, but for rows without an id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

SHARDS, LOTS = 16, 4096
#: Weights of bytes, tokens and rows in the dot product.
WEIGHTS = (1.0, 0.01, 0.01)
LAW = "bytes"


def pack(loads: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each row of ``loads`` (non-negative): highest dot product with residual capacity, largest first.

    Both sides count in parts of the totals. Ties go to the lowest shard.
    """
    share = loads / np.maximum(loads.sum(0), 1)
    left = np.full((shards, loads.shape[1]), 1 / shards)
    out = np.empty(len(loads), np.int64)
    for i in np.lexsort((np.arange(len(loads)), -share.sum(1), -share[:, 0])):
        out[i] = s = np.argmax(left @ (share[i] * WEIGHTS))
        left[s] -= share[i]
    return out


def words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    inner = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, "[ \t-\r]+"))).otherwise(0)


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, lots: int = LOTS) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens``.

    ``size`` is the text's UTF-8 bytes plus one; a null text has no bytes and no words and is grouped with other nulls, an
    empty one with other empty ones; texts of any length are taken whole.
    ``law`` is ``bytes``: sizes are near equal, and tokens and rows follow. Equal texts share a shard unless they are more
    than its capacity in bytes or rows; such a group is dealt by a hash of the id, so rows that repeat an id and text
    stay together, and rows without an id are dealt one by one. ``slot`` counts from 0 in each shard without gaps: by lot and
    piece, then by id (nulls first), text checksum and size; which of rows equal in all of these comes first does not
    matter. ``grown_shard`` is null. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    text, one = F.col(text_col), F.col(id_col)
    spread = F.when(one.isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(one))
    rows = docs.select(one.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.coalesce(words(text), F.lit(0)).cast("bigint").alias("tokens"), F.xxhash64(text).alias("grp"), spread.alias("spread"))
    rows = materialize(rows)
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    groups = rows.groupBy("grp").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    share = F.greatest(F.col("b") / F.lit(max(total.b or 0, 1)), F.col("n") / F.lit(max(total.n, 1)))
    large = groups.filter(share * lots > 1).select("grp", F.ceil(share * lots).cast("int").alias("pieces"), (share * shards > 1).alias("cut"))
    placed = rows.join(F.broadcast(large), "grp", "left")  # fewer than ``2 * lots`` rows, as each has more than 1 / lots of all bytes or rows
    piece = F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(F.pmod("spread", "pieces").cast("int"))
    lot = F.when(F.col("pieces").isNull(), F.pmod("grp", F.lit(lots))).otherwise(F.col("grp"))
    placed = placed.select("doc_id", "size", "text_crc32", "tokens", piece.alias("piece"), lot.alias("lot"), F.coalesce("cut", F.lit(False)).alias("cut"))
    sums = placed.groupBy("lot", "piece").agg(F.sum("size"), F.sum("tokens"), F.count("*"), F.first("cut").alias("cut")).orderBy("lot", "piece").collect()  # at most 5 * lots rows
    items: dict[tuple, int] = {}
    item = [items.setdefault((r.lot, r.piece if r.cut else min(r.piece, 0)), len(items)) for r in sums]
    loads = np.zeros((len(items), 3))
    np.add.at(loads, item, np.array([r[2:5] for r in sums], float).reshape(-1, 3))
    chosen = pack(loads, shards)[item]
    first, at = [], [0] * shards
    for s, r in zip(chosen, sums, strict=True):
        first.append(at[s])
        at[s] += r[4]
    plan = docs.sparkSession.createDataFrame([(r[0], r[1], int(s), f) for r, s, f in zip(sums, chosen, first, strict=True)], "lot bigint, piece int, shard int, first bigint")
    order = F.row_number().over(W.partitionBy("lot", "piece").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size"))
    out = placed.drop("cut").withColumn("nth", order).join(F.broadcast(plan), ["lot", "piece"])
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
