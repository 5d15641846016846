"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns. Prefixes are told apart by the sums of their turns' hashes (each hashed with its position, 160 bits), so that
they follow from prefix sums, which no task has to form for a whole conversation. Each node has an arc that enters it and one
that leaves it; every arc knows the one after it on the tour around the trie. The tour is ranked by contraction: in each round arcs
are ordered by a new hash, those that come after both of their neighbours go into the arc before them, and when few are left one
task ranks these; then the rounds are undone in turn. A subtree's leaves and savings are the difference of the sums at its node's two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, release, small_side
from .shards import words

#: Children of a node, or conversations of a block, that one task orders; arcs that one task ranks.
HOT, BLOCK_BITS, MOST_ARCS = 10_000, 16, 20_000
END = -1
SUMS = ["s0", "s1", "s2", "s3"]


def element(pos: Column, digest: Column) -> list[Column]:
    """Four numbers of 40 bits for a turn at a position."""
    hexed = F.sha2(F.concat(F.encode(pos.cast("string"), "utf-8"), F.lit(b":"), digest), 256)
    return [F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 10).cast("bigint") for k in range(4)]


def key_of(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def rebuilt_turns(conversations: DataFrame, shared_every: int, most_shared: int) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, k, pk, words, ends`` of each rebuilt turn, and ``conv_id, ends`` of each conversation (``ends``: it has no turn).

    Turns are dealt out by ranges of (conversation, turn), so one with any number of turns lies in many parts; what goes from part to part
    is a row for each part.
    """
    c = F.col("conv_id")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 40))
    rows = conversations.filter("conv_id is not null").select(c.cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), words(text).cast("bigint").alias("words"))
    rows = materialize(rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "digest").withColumn("part", F.spark_partition_id()))
    here = W.partitionBy("part", "conv_id")
    along = W.partitionBy("conv_id").orderBy("part")
    h = F.pmod(F.crc32(c.cast("string")), F.lit(most_shared + 1)).cast("int")
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy("conv_id")).alias("total"), h.alias("h"), (c - c % shared_every).alias("base"))
    parts = materialize(parts)
    numbered = rows.join(parts.select("conv_id", "part", "before", "total", "h"), ["part", "conv_id"])
    numbered = materialize(numbered.withColumn("pos", F.col("before") + F.row_number().over(here.orderBy(F.col("turn").asc_nulls_first(), "digest"))))
    # the first turns of conversations that others begin with
    e = element(F.col("pos"), F.col("digest"))
    up_to = W.partitionBy("conv_id").orderBy("pos")
    heads = numbered.filter((c % shared_every == 0) & (F.col("pos") <= most_shared)).select("conv_id", "pos", "words", *[x.alias(s) for x, s in zip(e, SUMS, strict=True)])
    heads = heads.select("conv_id", F.struct("pos", "words", *[F.sum(s).over(up_to).alias(s) for s in SUMS]).alias("t"))
    heads = heads.groupBy(c.alias("base")).agg(F.array_sort(F.collect_list("t")).alias("heads"))
    parts = parts.join(heads, "base", "left").withColumn("heads", F.slice(F.coalesce("heads", F.array().cast("array<struct<pos:bigint,words:bigint,s0:bigint,s1:bigint,s2:bigint,s3:bigint>>")), F.lit(1), F.col("h")))
    parts = materialize(parts.withColumn("t", F.size("heads").cast("bigint")))
    start = [F.coalesce(F.when(F.col("t") > 0, F.element_at("heads", F.greatest(F.col("t"), F.lit(1)).cast("int")))[s], F.lit(0)).alias(f"{s}_head") for s in SUMS]
    own = numbered.filter("pos > h").join(parts.select("conv_id", "part", "t", *start), ["part", "conv_id"])
    own = own.withColumn("depth", F.col("t") + F.col("pos") - F.col("h"))
    own = materialize(own.select("part", "conv_id", "depth", "words", (F.col("pos") == F.col("total")).alias("ends"), *[x.alias(s) for x, s in zip(element(F.col("depth"), F.col("digest")), SUMS, strict=True)], *[f"{s}_head" for s in SUMS]))
    carried = own.groupBy("conv_id", "part").agg(*[F.sum(s).alias(s) for s in SUMS])
    carried = carried.select("conv_id", "part", *[F.sum(s).over(earlier).alias(f"{s}_before") for s in SUMS]).filter("s0_before is not null")
    carried = materialize(carried)  # one for each part at most, as a part's first conversation alone has turns in an earlier one
    run = here.orderBy("depth")
    own = own.join(small_side(carried, carried.count()), ["part", "conv_id"], "left")
    now = [F.sum(s).over(run) + F.coalesce(f"{s}_before", F.lit(0)) + F.col(f"{s}_head") for s in SUMS]
    own = own.select("conv_id", "depth", "words", "ends", *[x.alias(f"{s}_now") for x, s in zip(now, SUMS, strict=True)], *SUMS)
    of = lambda depth, sums: key_of(depth, sums)
    d = F.col("depth")
    own = own.select("conv_id", "depth", of(d, [F.col(f"{s}_now") for s in SUMS]).alias("k"), of(d - 1, [F.col(f"{s}_now") - F.col(s) for s in SUMS]).alias("pk"), "words", "ends")
    convs = materialize(parts.filter("before = 0").select("conv_id", "heads", "t", (F.col("total") <= F.col("h")).alias("short")))
    taken = convs.filter("t > 0").select("conv_id", "t", "short", F.posexplode("heads").alias("at", "x"), "heads")
    last = F.when(F.col("at") > 0, F.element_at("heads", F.greatest("at", F.lit(1))))
    first = taken.select("conv_id", F.col("x.pos").alias("depth"), of(F.col("x.pos"), [F.col(f"x.{s}") for s in SUMS]).alias("k"), of(F.col("x.pos") - 1, [F.coalesce(last[s], F.lit(0)) for s in SUMS]).alias("pk"), F.col("x.words").alias("words"), (F.col("short") & (F.col("x.pos") == F.col("t"))).alias("ends"))
    return materialize(own.unionByName(first)), convs.select("conv_id", (F.col("short") & (F.col("t") == 0)).alias("ends"))


def digests(ends: DataFrame) -> DataFrame:
    """``k, ends_sha256`` for rows (k, conv_id): the digest of each k's ids in order, comma-joined.

    Ids are joined in blocks of neighbouring numbers first; what follows takes block after block, so no list of a whole node is held anywhere.
    """
    block = F.shiftright("conv_id", BLOCK_BITS)
    blocks = ends.groupBy("k", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        row = lambda: pa.RecordBatch.from_pydict({"k": [now], "ends_sha256": [sha.hexdigest()]}, schema=pa.schema([("k", pa.binary()), ("ends_sha256", pa.string())]))
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    if sha:
                        yield row()
                    now, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
        if sha:
            yield row()

    return blocks.repartition("k").sortWithinPartitions("k", "block").select("k", "ids").mapInArrow(run, "k binary, ends_sha256 string")


def ranked_few(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums from each arc to the tour's end, by doubling steps."""
    order = np.argsort(pdf["a"].to_numpy())
    a, nxt, w = (pdf[c].to_numpy()[order] for c in (["a"], ["nxt"], ["leaves", "saved"]))
    to = np.searchsorted(a[:, 0], nxt[:, 0])
    to = np.where(nxt[:, 0] == END, len(a), to)
    to, w = np.r_[to, len(a)], np.vstack([w, np.zeros((1, 2), w.dtype)])
    while (to < len(a)).any():
        w, to = w + w[to] * (to < len(a))[:, None], to[to]
    return pd.DataFrame({"a": a[:, 0], "leaves": w[:-1, 0], "saved": w[:-1, 1]})


def list_ranks(arcs: DataFrame, most: int = MOST_ARCS) -> DataFrame:
    """``a, leaves, saved``: sums of the weights from each arc of one list (a, nxt, leaves, saved) to its end; ``nxt`` is END at the end."""
    live, steps = materialize(arcs), []
    while live.count() > most:
        mark = lambda c: F.xxhash64(F.col(c), F.lit(len(steps)))  # noqa: B023, E731
        rises = (F.col("nxt") != END) & (mark("nxt") > mark("a"))
        low = live.filter(rises).select(F.col("nxt").alias("at"), F.struct("*").alias("p"))
        high = live.filter(~rises).select(F.col("a").alias("at"), F.struct("*").alias("e"))
        met = F.col("p").isNotNull() & F.col("e").isNotNull()
        one = F.struct(F.col("p.a").alias("a"), F.col("e.nxt").alias("nxt"), (F.col("p.leaves") + F.col("e.leaves")).alias("leaves"), (F.col("p.saved") + F.col("e.saved")).alias("saved"))
        step = materialize(low.join(high, "at", "full").select(F.when(met, one).otherwise(F.coalesce("p", "e")).alias("live"), F.when(met, F.col("e")).alias("gone")))
        steps.append(step)
        live = step.select("live.*")
    found = [materialize(live.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(ranked_few, "a bigint, leaves bigint, saved bigint"))]
    for step in reversed(steps):
        known = reduce(DataFrame.unionAll, found).select(F.col("a").alias("nxt"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
        back = step.filter("gone is not null").select("gone.*").join(known, "nxt", "left")
        found.append(materialize(back.select("a", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))))
        release(step)
    return reduce(DataFrame.unionAll, found)


def linked(nodes: DataFrame, hot_children: int) -> DataFrame:
    """``nodes`` with ``parent_id, parent_conv, n_children, first_child, sibling``.

    Children of nodes that have more than ``hot_children`` are ordered in that many shares; the last of a share is followed by the first of the next.
    """
    kids = nodes.filter("pk is not null").groupBy(F.col("pk").alias("k")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(kids, "k", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    up = nodes.select(F.col("k").alias("pk"), F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv"), F.ceil(F.col("n_children") / hot_children).alias("shares"))
    hot = materialize(up.filter("shares > 1"))  # at most one for ``hot_children`` nodes
    few = small_side(hot, hot.count())
    inner = nodes.filter("pk is not null")
    placed = inner.join(few, "pk").unionByName(inner.join(few.select("pk"), "pk", "left_anti").join(up.filter("shares = 1"), "pk"))
    placed = materialize(placed.withColumn("share", F.pmod(F.xxhash64("conv_id"), "shares")).drop("shares"))
    ordered = placed.withColumn("sibling", F.lead("id").over(W.partitionBy("parent_id", "share").orderBy("conv_id")))
    child = F.struct("conv_id", "id")
    shares = placed.groupBy("parent_id", "share").agg(F.min(child).alias("low"), F.max(child).alias("high"))
    shares = materialize(shares.withColumn("after", F.lead("low.id").over(W.partitionBy("parent_id").orderBy("share"))))
    over = materialize(shares.filter("after is not null").select(F.col("high.id").alias("id"), "after"))
    ordered = ordered.join(small_side(over, over.count()), "id", "left").withColumn("sibling", F.coalesce("sibling", "after")).drop("after", "share")
    first = shares.groupBy(F.col("parent_id").alias("id")).agg(F.min_by("low.id", "share").alias("first_child"))
    root = nodes.filter("pk is null").withColumns({c: F.lit(None).cast("bigint") for c in ("parent_id", "parent_conv", "sibling")})
    return ordered.unionByName(root).join(first, "id", "left")


def prefix_trie(conversations: DataFrame, shared_every: int = 20, most_shared: int = 3, hot_children: int = HOT, most_arcs: int = MOST_ARCS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversation c is rebuilt as the first h turns of conversation c - c % ``shared_every`` (all if it has fewer, none if there is none) and its own
    turns after its first h; h is the CRC-32 of c's digits modulo ``most_shared`` + 1. Turns are ordered by ``turn``, nulls first; of equal ones by a hash of
    role and text, so repeated rows count as turns of their own. Null role or text counts as empty; texts of any length are taken whole. Rows without
    ``conv_id`` belong to no conversation. Other columns, whatever their names, are ignored. An empty table has no node, not even the root.
    """
    turns, convs = rebuilt_turns(conversations.select("conv_id", "turn", "role", "text"), shared_every, most_shared)
    nodes = turns.groupBy("k").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"), F.first("pk").alias("pk"), F.first("words").alias("words"))
    zero = key_of(F.lit(0), [F.lit(0)] * 4)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(zero.alias("k"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("pk"), F.lit(0).cast("bigint").alias("words"))
    nodes = materialize(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id()))
    nodes = materialize(linked(nodes, hot_children))
    into, out = F.col("id") * 2, F.col("id") * 2 + 1
    goes = F.array(
        F.struct(into.alias("a"), F.coalesce(F.col("first_child") * 2, out).alias("nxt"), (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")),
        F.struct(out.alias("a"), F.coalesce(F.col("sibling") * 2, F.col("parent_id") * 2 + 1, F.lit(END)).alias("nxt"), F.lit(0).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved")),
    )
    ranks = list_ranks(nodes.select(F.explode(goes).alias("x")).select("x.*"), most_arcs)
    sign = F.when(F.col("a") % 2 == 0, 1).otherwise(-1)
    below = ranks.groupBy(F.shiftright("a", 1).alias("id")).agg(F.sum(F.col("leaves") * sign).alias("n_leaves"), F.sum(F.col("saved") * sign).alias("saved_tokens"))
    ended = turns.filter("ends").select("k", "conv_id").unionByName(convs.filter("ends").select(zero.alias("k"), "conv_id"))
    out = nodes.join(below, "id").join(digests(ended), "k", "left")
    return out.select("conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


SQL = r"""
WITH RECURSIVE
bits(i, n, v) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i) UNION ALL SELECT i, n + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE n < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE n = 8),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))), lambda r, b: xor(r >> 8, tab[xor(r, b) % 256 + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t), tab),
nb AS (SELECT conv_id AS base, count(*) AS nb FROM t GROUP BY ALL),
b AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, least(h, coalesce(nb, 0)) + pos - h, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h LEFT JOIN nb ON nb.base = c.base),
p AS (SELECT conv_id, pos AS depth, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS k, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS w FROM b
  UNION ALL SELECT conv_id, 0, md5(''), 0 FROM c),
node AS (SELECT k, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(w) AS w FROM p GROUP BY k),
up AS (SELECT node.*, p.k AS pk FROM node LEFT JOIN p ON p.conv_id = node.conv_id AND p.depth = node.depth - 1),
kids AS (SELECT pk AS k, count(*) AS n_children FROM up WHERE pk IS NOT NULL GROUP BY pk),
sub AS (SELECT a.k, count(*) FILTER (kids.k IS NULL) AS n_leaves, CAST(sum((u.n_convs - 1) * u.w) AS BIGINT) AS saved_tokens FROM up u LEFT JOIN kids ON kids.k = u.k JOIN p a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY a.k),
ends AS (SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, arg_max(k, depth) AS k FROM p GROUP BY conv_id) GROUP BY k)
SELECT up.conv_id, CAST(up.depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, up.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM up LEFT JOIN node parent ON parent.k = up.pk LEFT JOIN kids ON kids.k = up.k JOIN sub ON sub.k = up.k LEFT JOIN ends ON ends.k = up.k
"""
