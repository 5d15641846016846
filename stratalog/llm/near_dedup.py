"""MinHash near-duplicate classes, candidates verified by odd sketches and then by full shingle sets.

Texts with the same shingle set are one *node*; only nodes are compared, so exact copies of any number cost
nothing further. A node's 128 MinHash values make 50 bands of five; nodes that share a band's key are
candidates. The same values, folded into a 512-bit parity bitmap (odd sketch), give each candidate pair's
similarity from the population count of the XOR; pairs that could reach the threshold are confirmed on full
sets. Confirmed links make classes by connected components.

Buckets of up to ``SMALL`` nodes give all their pairs. Larger ones give one pair per node, with the bucket's
most crowded node as pivot. The nodes of large buckets that do not end in one class are taken up again by an exact
prefix filter over their shingles, which finds every pair across classes that can reach the threshold. So no candidate is
dropped, and a dense group costs one pair per node instead of all of its pairs.

At the threshold itself a link is missed with a chance of about 1e-6 (0.80) or 1e-9 (0.85), and less above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .batches import tidy
from .common import materialize, release, small_side
from .components import components
from .shingles import STEP, blocks, mix, shingle_set

#: Most nodes of a bucket that gives all its pairs.
SMALL = 16
#: Shingles of more nodes than this are joined apart, and classes with more nodes of a shingle are dealt over ``SALTS`` keys.
HOT, SALTS = 500, 16
#: Number of MinHash values, rows a band, permutations that deal the values to bands.
FIRST = (128, 5, 2)
SKETCH_BITS = 512
SIGNED = "struct<n_shingles: bigint, node: binary, bands: array<bigint>, sketch: array<bigint>>"


@lru_cache
def layout(plan: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed multipliers and addends of the hash functions, and each band's value numbers."""
    k, rows, deals = plan
    draw = np.random.default_rng(20240229 + k)
    mul = draw.integers(0, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 2**64 - 1, k, np.uint64)
    bands = np.concatenate([draw.permutation(k)[: k // rows * rows].reshape(-1, rows) for _ in range(deals)])
    return mul, add, bands


def minhashes(sets: list[np.ndarray], plan: tuple[int, int, int]) -> np.ndarray:
    """(hash functions, sets) array of minima; the sets must not be empty."""
    mul, add, _ = layout(plan)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(mul), len(sets)), np.uint64)
    held = np.empty_like(flat)
    for i, (m, a) in enumerate(zip(mul, add, strict=True)):
        np.multiply(flat, m, out=held)
        held += a
        out[i] = np.minimum.reduceat(held, starts)
    return out


def band_keys(minima: np.ndarray, plan: tuple[int, int, int]) -> np.ndarray:
    """(sets, bands) array of 64-bit keys; a band's number is part of its keys."""
    bands = layout(plan)[2]
    key = np.repeat(np.arange(len(bands), dtype=np.uint64)[:, None], minima.shape[1], 1)
    for column in bands.T:
        key = mix(key + STEP) + minima[column]
    return mix(key).T.view(np.int64)


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """(sets, 8) array: each sample toggles one of 512 bits."""
    k, n = minima.shape
    bit = mix(minima + np.arange(1, k + 1, dtype=np.uint64)[:, None] * STEP) % np.uint64(SKETCH_BITS)
    at = bit.astype(np.int64) + np.arange(n) * SKETCH_BITS
    odd = np.bincount(at.ravel(), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def most_bits(percent: int) -> int:
    """The largest XOR population count at which a pair may still have this similarity (5 + 3 standard deviations)."""
    k, t = FIRST[0], percent / 100
    differ = k * (1 - t) + 5 * math.sqrt(k * t * (1 - t))
    return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differ)) + 3 * math.sqrt(differ / 2))


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def signed(texts: Iterator[pa.Array], n: int, plan: tuple[int, int, int]) -> Iterator[pa.Array]:
    for batch in tidy(texts):
        counts, keys, bands, sketches = [], [], [], []
        for some in blocks((shingle_set(t.as_py(), n) for t in batch), 16_384):
            full = [s for s in some if len(s)]
            if full:
                minima = minhashes(full, plan)
                by_band = iter(band_keys(minima, plan))
                by_bit = iter(odd_sketches(minima))
            for s in some:
                counts.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                bands.append(next(by_band) if len(s) else None)
                sketches.append(next(by_bit) if len(s) else None)
        long_list = pa.list_(pa.int64())
        yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, long_list), pa.array(sketches, long_list)], ["n_shingles", "node", "bands", "sketch"])


def signature(text: Column, n: int, plan: tuple[int, int, int]) -> Column:
    @F.arrow_udf(SIGNED)
    def sign(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return signed(texts, n, plan)

    return sign.asNondeterministic()(text)  # else Spark runs it below the joins that choose its rows


def hashed_set(text: Column, n: int) -> Column:
    @F.arrow_udf("struct<node: binary, items: array<bigint>>")
    def full(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidy(texts):
            sets = [shingle_set(t.as_py(), n) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "items"])

    return full.asNondeterministic()(text)


def pairs_of(group: Column) -> Column:
    """Every pair (a < b) of a short sorted array."""
    return F.flatten(F.transform(group, lambda a, i: F.transform(F.slice(group, i + 2, F.size(group)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def crowded(rows: DataFrame) -> DataFrame:
    """Buckets (key) with at least two nodes: number of nodes, smallest and largest node."""
    return rows.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("low"), F.max("node").alias("high")).filter("m > 1")


def within_small(buckets: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of buckets with at most SMALL nodes; a bucket of two is its smallest and largest node."""
    groups = members.filter(F.col("m") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("g"))
    return buckets.filter("m = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).unionAll(groups.select(F.explode(pairs_of(F.col("g"))).alias("p")).select("p.a", "p.b"))


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """The links among candidate pairs: odd sketches first, then full sets."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("doc").alias(f"doc_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    bits = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = pairs.distinct().join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).filter(bits <= most_bits(percent))
    near = materialize(near.select("a", "b", "doc_a", "doc_b", "n_a", "n_b"))
    wanted = materialize(near.select(F.col("a").alias("node"), F.col("doc_a").alias("doc")).unionAll(near.select(F.col("b").alias("node"), F.col("doc_b").alias("doc"))).distinct())
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(small_side(wanted.select(F.col("doc").alias("w")).distinct(), wanted.count()), F.col("doc_id").eqNullSafe(F.col("w")), "left_semi")
    sets = materialize(source.select(hashed_set(F.col("text"), n).alias("s")).select("s.node", "s.items").dropDuplicates(["node"]))
    sa, sb = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    both = near.join(sb, "b").join(sa, "a").withColumn("common", F.size(F.array_intersect("items_a", "items_b")))
    links = materialize(both.filter(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent).select("a", "b", "common"))
    for done in (near, wanted, sets):
        release(done)
    return links


def with_counts(rows: DataFrame) -> DataFrame:
    """Add ``df``, the number of rows with the same ``h``; frequent values do not meet in one task."""
    often = materialize(rows.groupBy("h").agg(F.count("*").alias("df")))
    hot = materialize(often.filter(F.col("df") > HOT))  # at most one for HOT rows
    known = small_side(hot, hot.count())
    return rows.join(known, "h").unionByName(rows.join(known, "h", "left_anti").join(often.filter(F.col("df") <= HOT), "h"))


def again(stuck: DataFrame, nodes: DataFrame, roots: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Candidate pairs across classes among ``stuck`` nodes, by an exact prefix filter.

    A node's shingles are ordered by how many stuck nodes have them, rarest first. Two sets that reach the threshold share
    one of the first ``size - ceil(percent * size) + 1`` of both; where the first one shared stands tells how many can follow, and
    pairs for which that is too few are left out. Classes that share a shingle are paired first, by the best that any of their nodes could
    reach, and only pairs of classes that could reach the threshold are expanded to nodes: a dense class and a stranger cost one
    pair per node of the class. Nodes of a class that has a shingle often, and classes of a shingle that many have, are dealt over several keys.
    """
    wanted = stuck.join(nodes.select("node", "doc"), "node")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(small_side(wanted.select(F.col("doc").alias("w")).distinct(), wanted.count()), F.col("doc_id").eqNullSafe(F.col("w")), "left_semi")
    sets = source.select(hashed_set(F.col("text"), n).alias("s")).select("s.node", "s.items").dropDuplicates(["node"]).join(stuck, "node")
    rows = materialize(sets.select("node", F.size("items").alias("n"), F.explode("items").alias("h")))
    place = F.row_number().over(W.partitionBy("node").orderBy("df", "h"))
    first = with_counts(rows).withColumn("at", place).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).filter("df > 1")
    first = materialize(first.join(roots.withColumnRenamed("root", "found"), "node", "left").select("h", "node", "n", "at", F.coalesce("found", "node").alias("root")))
    classes = materialize(first.groupBy("h", "root").agg(F.min("n").alias("n"), F.max(F.col("n") - F.col("at")).alias("rest"), (F.count("*") > HOT).alias("hot")))
    several = materialize(classes.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h", F.when(F.col("k") > HOT, SALTS).otherwise(1).alias("keys")))
    classes = materialize(classes.join(small_side(several, several.count()), "h"))
    # a shingle of many classes is dealt over several keys: one side by the class, the other to all of them
    keyed = {"a": F.array(F.pmod(F.xxhash64("root"), F.col("keys")).cast("int")), "b": F.sequence(F.lit(0), F.col("keys") - 1)}
    side = lambda x: classes.select("h", F.explode(keyed[x]).alias("key"), *[F.col(c).alias(f"{c}_{x}") for c in ("root", "n", "rest", "hot")])
    may = (1 + F.least("rest_a", "rest_b")) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    couples = materialize(side("a").join(side("b"), ["h", "key"]).filter((F.col("root_a") < F.col("root_b")) & may).select("h", "root_a", "root_b", "hot_a", "hot_b"))
    large = materialize(classes.filter("hot").select("h", "root", "hot"))  # at most one for HOT rows
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = first.join(small_side(large, large.count()), ["h", "root"], "left").withColumn("salt", salt)
    salts = lambda x: F.explode(F.when(F.col(f"hot_{x}"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias(f"salt_{x}")
    member = lambda x: dealt.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("root", "salt", "node", "n", "at")])
    half = couples.select("*", salts("a")).join(member("a"), ["h", "root_a", "salt_a"])
    both = half.select("h", "root_b", salts("b"), "node_a", "n_a", "at_a").join(member("b"), ["h", "root_b", "salt_b"])
    most = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    enough = most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    pairs = materialize(both.filter(enough).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct())
    for done in (rows, first, couples):
        release(done)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents whose ``n``-word shingle sets have 100 * intersection >= percent * union.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``. ``component_id`` is the smallest
    id reachable by links, the row's own included; ``kept`` says that the row has that id.
    Texts of any length are read whole. A null or wordless text has ``n_shingles`` 0, is linked with nothing and is kept. Repeated rows are in
    one class; those with the class's id are all kept. A null id counts as larger than any other: such a row takes its class's
    id, and where the class has none, ``component_id`` is null and the row is kept. Other columns, whatever their names, are ignored.
    An empty table gives an empty result.
    """
    signs = materialize(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), signature(F.col(text_col), n, FIRST).alias("s")).select("doc_id", "s.*"))
    nodes = materialize(signs.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    rows = nodes.select("node", F.explode("bands").alias("key"))
    buckets = materialize(crowded(rows))
    more = buckets.filter("m > 2").select("key", "m")
    members = materialize(rows.join(small_side(more, more.count()), "key"))
    large = members.filter(F.col("m") > SMALL)
    weight = large.groupBy("node").agg(F.sum("m").alias("weight"))
    pivots = large.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("p")).select("key", "p.node").withColumnRenamed("node", "pivot")
    pivots = materialize(pivots)  # one for SMALL members at most
    star = large.join(small_side(pivots, pivots.count()), "key").filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    links = confirmed(within_small(buckets, members).unionAll(star), nodes, docs, id_col, text_col, n, percent)
    roots = components(links)
    of = large.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = materialize(of.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("key"))
    stuck = materialize(large.join(small_side(mixed, mixed.count()), "key", "left_semi").select("node").distinct())
    if not stuck.isEmpty():
        found = confirmed(again(stuck, nodes, roots, docs, id_col, text_col, n, percent), nodes, docs, id_col, text_col, n, percent)
        roots = components(links.unionAll(found))
    for done in (buckets, members):
        release(done)
    classes = nodes.select("node", "doc").join(roots, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("doc").alias("class_id"))
    named = classes.join(least, "root").select("node", "class_id")
    out = signs.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
least_id AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN least_id l ON l.id = d.doc_id
"""
