"""Benchmark items inside documents: MinHash containment search by item size, verified by exact shingles.

Items are partitioned by the size of their shingle set (by powers of two). Each partition has hash functions and an
index of its own: for each of its functions, the item's shingle with the smallest value. A document holds a
share c of an item's shingles, so it holds a given sample with probability c, however long the document is; one held sample
makes a candidate. With s functions a document at the threshold 0.8 is missed with probability 0.2 ** s, which is 4e-9 at
most. A document's shingles are looked up in these indexes; candidates are confirmed on the item's whole set.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import tidy
from .common import materialize, small_side
from .shingles import ngrams, shingle_set, word_hashes

WORDS, PERCENT = 5, 80
#: Most hash functions that a partition (sets of 1, 2, 3-4, 5-8, ... shingles) has.
SAMPLES = 36
#: Most words of items that are broadcast to the tasks; beyond that documents' shingles are joined by shuffle, with the same result.
MOST_BROADCAST = 2_000_000


def partition_of(size: int) -> int:
    """The partition of sets with this size: 0 for 1, 1 for 2, 2 for 3-4, 3 for 5-8 and so on."""
    return max(size - 1, 0).bit_length()


@lru_cache
def functions_of(partition: int) -> tuple[np.ndarray, np.ndarray]:
    """A partition's own multipliers and addends: 12 hash functions and four more for each doubling, up to SAMPLES."""
    draw, k = np.random.default_rng(20240517 + partition), min(SAMPLES, 12 + 4 * partition)
    return draw.integers(0, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**64 - 1, k, np.uint64)


def samples(s: np.ndarray) -> np.ndarray:
    """A set's distinct MinHash samples by its partition's functions."""
    return np.unique(np.array([s[np.argmin(s * m + a)] for m, a in zip(*functions_of(partition_of(len(s))), strict=True)], np.uint64))


class Index:
    """Per partition, items by their samples; whole sets for confirmation. Short items are met by shingles of their own length."""

    def __init__(self, items: list[tuple[int, str | None]], words: int, percent: int):
        self.words, self.percent = words, percent
        sets: dict[int, set[int]] = defaultdict(set)
        for i, text in items:
            sets[i].update(shingle_set(text, words).tolist())
        self.lengths = {min(n, words) for _, text in items if (n := len(word_hashes(text)))}
        self.size = {i: len(s) for i, s in sets.items() if s}
        self.partitions: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        self.full: dict[int, set[int]] = defaultdict(set)
        for i, n in self.size.items():
            own = self.partitions[partition_of(n)]
            for h in samples(np.array(sorted(sets[i]), np.uint64)).tolist():
                own[h].add(i)
            for h in sets[i]:
                self.full[h].add(i)
        self.known = np.array(sorted({h for own in self.partitions.values() for h in own}), np.uint64)
        self.every = np.array(sorted(self.full), np.uint64)

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item, shared shingles) of items that the text contains."""
        w = word_hashes(text)
        got = [ngrams(w, n) for n in self.lengths if len(w) >= n]
        if not got:
            return []
        own = np.concatenate(got)
        met = set(held(own, self.known).tolist())  # one look-up for all partitions; few shingles of a text are in any
        candidates = {i for by_sample in self.partitions.values() for h in met for i in by_sample.get(h, ())}
        if not candidates:
            return []
        shared = Counter(i for h in np.unique(held(own, self.every)).tolist() for i in self.full[h] if i in candidates)
        return sorted((i, n) for i, n in shared.items() if n * 100 >= self.size[i] * self.percent)


def held(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The values that are in a sorted array."""
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return values[among[at] == values]


def shingle_column(text: Column, words: int, lengths: tuple[int, ...] = ()) -> Column:
    """Distinct shingles of a text; with ``lengths``, windows of those numbers of words instead."""

    @F.arrow_udf("array<bigint>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidy(batches):
            out = []
            for t in batch:
                if lengths:
                    w = word_hashes(t.as_py())
                    s = np.unique(np.concatenate([ngrams(w, n) for n in lengths if len(w) >= n] or [w]))
                else:
                    s = shingle_set(t.as_py(), words)
                out.append(s.view(np.int64))
            yield pa.array(out, pa.list_(pa.int64()))

    return made.asNondeterministic()(text)


def sample_column(items: Column) -> Column:
    @F.arrow_udf("array<bigint>")
    def chosen(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidy(batches):
            yield pa.array([samples(np.sort(np.array(s.as_py(), np.int64).view(np.uint64))).view(np.int64) for s in batch], pa.list_(pa.int64()))

    return chosen.asNondeterministic()(items)


def by_broadcast(docs: DataFrame, items: DataFrame, words: int, percent: int) -> DataFrame:
    """One pass over the documents, with the bounded index in each task."""
    shared = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])

    @F.arrow_udf("array<struct<item_id: bigint, shared: bigint, size: bigint>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(shared.value, words, percent)
        for batch in tidy(batches):
            yield pa.array([[{"item_id": i, "shared": n, "size": index.size[i]} for i, n in index.find(t.as_py())] for t in batch], pa.list_(pa.struct([("item_id", pa.int64()), ("shared", pa.int64()), ("size", pa.int64())])))

    return docs.select("doc_id", F.explode(found.asNondeterministic()(F.col("text"))).alias("f")).select("doc_id", "f.item_id", "f.shared", F.col("f.size").alias("n_item"))


def by_shuffle(docs: DataFrame, items: DataFrame, words: int, percent: int) -> DataFrame:
    """The same for items of any number: samples, then whole sets, are joined with the documents' shingles.

    A document's place in the input stands for it, so repeated or null ids do no harm.
    """
    made = materialize(items.select("item_id", shingle_column(F.col("text"), words).alias("s"), F.size(F.filter(F.split("text", "[ \t-\r]+"), lambda x: x != "")).alias("w")).filter(F.size("s") > 0))
    lengths = tuple(r.w for r in made.select(F.least("w", F.lit(words)).alias("w")).distinct().collect())
    sets = materialize(made.select("item_id", F.explode("s").alias("h")).groupBy("item_id").agg(F.collect_set("h").alias("s")))
    if not lengths:
        return by_broadcast(docs, items.limit(0), words, percent)
    placed = materialize(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place")))
    rows = placed.select("doc_id", "place", F.explode(shingle_column(F.col("text"), words, lengths)).alias("h"))
    index = sets.select("item_id", F.explode(sample_column(F.col("s"))).alias("h"))
    index = materialize(index)
    pairs = materialize(rows.join(small_side(index, index.count()), "h").select("doc_id", "place", "item_id").distinct())
    few = pairs.select("place").distinct()
    again = placed.join(small_side(few, few.count()), "place", "left_semi").select("place", F.explode(shingle_column(F.col("text"), words, lengths)).alias("h"))
    wanted = pairs.join(sets.select("item_id", F.size("s").alias("n_item"), F.explode("s").alias("h")), "item_id")
    met = wanted.join(again, ["place", "h"]).groupBy("place", "item_id").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("shared"), F.first("n_item").cast("bigint").alias("n_item"))
    return met.filter(F.col("shared") * 100 >= F.col("n_item") * percent).select("doc_id", "item_id", "shared", "n_item")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Pairs ``doc_id, item_id, shared, n_item, containment`` where a document has at least ``percent`` of an item's shingles.

    A document's shingles are counted wherever they stand in the whole text, however long it is. An item with fewer than
    ``words`` words is one shingle of its own length; an item without words, or with a null id or text, is
    in no document, and a null or wordless document holds nothing. Repeated document rows give repeated pairs; a null doc_id is
    passed on. Items that repeat an id stand for one item, with the shingles of all of them. Other columns, whatever their
    names, are ignored. Empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).dropna()
    volume = asked.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    pairs = (by_broadcast if volume <= MOST_BROADCAST else by_shuffle)(rows, asked, words, percent)
    return pairs.withColumn("containment", F.col("shared") / F.col("n_item"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bs AS (SELECT DISTINCT item_id, least(len(w), 5) AS n, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bs) WHERE len(w) >= n)),
met AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, shared, n_item, shared / n_item AS containment FROM met JOIN n USING (item_id) WHERE shared * 100 >= n_item * 80
"""
