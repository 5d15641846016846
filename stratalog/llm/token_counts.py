"""Exact histogram of encoded lengths; suffix sums answer totals, quantiles and truncated totals for any limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import encode_documents
from .common import materialize

#: Lengths in a block of the two-level sums.
BLOCK = 1024


def length_histogram(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``length, n_docs``: how many documents have each encoded length. A null or empty text has length 0."""
    return encode_documents(docs.select(F.lit(0).alias("one"), F.col(text_col).alias("t")), path, "one", "t").groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """Answers for each distinct length taken as context limit, from (length, n_docs).

    ``docs_over, tokens_over``: documents longer than the limit and all of their tokens (suffix sums).
    ``docs_total, tokens_total``. ``tokens_kept``: tokens that stay if every document is cut at the limit;
    ``tokens_cut``: the rest. ``rank_from, rank_to``: the places, from 1, that documents of this length take
    by length, so a quantile q is the length whose places include ceil(q * docs_total).

    Sums run within blocks of lengths and over the blocks' totals, so no task gets more rows than a block's or
    than there are blocks (longest length / BLOCK). A repeated length is added up, a null length ignored; an empty histogram gives an
    empty result.
    """
    rows = materialize(histogram.filter("length is not null").groupBy("length").agg(F.sum("n_docs").alias("n_docs")))  # read twice below
    rows = rows.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later, all_blocks = W.partitionBy(F.lit(0)).orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    blocks = blocks.select("block", sums("bd", later).alias("d_later"), sums("bt", later).alias("t_later"), sums("bd", all_blocks).alias("docs_total"), sums("bt", all_blocks).alias("tokens_total"))
    after = W.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"d_after": sums("n_docs", after), "t_after": sums("tokens", after)}).join(blocks, "block")
    rows = rows.withColumns({"docs_over": F.col("d_later") + F.col("d_after"), "tokens_over": F.col("t_later") + F.col("t_after")})
    kept = F.col("tokens_total") - F.col("tokens_over") + F.col("docs_over") * F.col("length")
    last = F.col("docs_total") - F.col("docs_over")
    return rows.select(F.col("length").alias("context_limit"), "n_docs", "docs_over", "tokens_over", "docs_total", "tokens_total", kept.alias("tokens_kept"), (F.col("tokens_total") - kept).alias("tokens_cut"), (last - F.col("n_docs") + 1).alias("rank_from"), last.alias("rank_to"))


def at_limits(answers: DataFrame, asked: list[int]) -> DataFrame:
    """``context_limit, docs_over, tokens_kept, tokens_cut`` for limits that need not be lengths of documents."""
    out = None
    for limit in asked:
        over = F.col("context_limit") > limit
        docs, tokens = F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("n_docs") * F.col("context_limit"))), F.lit(0))
        cut = tokens - docs * limit
        one = answers.agg(F.lit(limit).cast("bigint").alias("context_limit"), docs.alias("docs_over"), (F.coalesce(F.max("tokens_total"), F.lit(0)) - cut).alias("tokens_kept"), cut.alias("tokens_cut"))
        out = one if out is None else out.unionAll(one)
    return out


def quantiles(answers: DataFrame, asked: list[float]) -> DataFrame:
    """``quantile, length``: the smallest length that at least this share of documents doesn't exceed."""
    q = F.explode(F.array(*[F.lit(float(x)) for x in asked])).alias("quantile")
    place = F.greatest(F.ceil(F.col("quantile") * F.col("docs_total")), F.lit(1))
    return answers.select("*", q).filter(place.between(F.col("rank_from"), F.col("rank_to"))).select("quantile", F.col("context_limit").alias("length"))
