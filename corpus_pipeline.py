"""The corpus pipeline: language, exact copies, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the rows that stay, with all of
their columns; the last returns the encoded documents. ``run`` writes each stage's rows as Parquet in the shared
folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import bpe, decontaminate, exact_dedup, language, near_dedup
from stratalog.llm.common import latest, materialize, scratch, small_side, table
from stratalog.llm.queries import TOKENIZER
from stratalog.session import ship

#: A document whose best language has a smaller share of its letters is rejected, as is one without letters. A text of two languages
#: in equal parts has about a half, so it stays; measured on sf0.01, the lowest score of a document is 0.54, of random consonants 0.38.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; rejects texts that are null, empty or without a letter, and unclear ones.

    Whole texts of any length are judged, repeated rows alike, ties by the first language's name. Nulls in other columns do no harm;
    columns may have any names and all stay. Where no row has a language to learn from, all documents stay. Empty tables stay empty.
    """
    ship(spark)
    model = language.fit(docs)
    if model.labels == [language.UNKNOWN]:
        return docs
    judged = docs.select(F.struct("*").alias("row"), language.predict(F.col("text"), model, spark).alias("p"))
    return judged.filter((F.col("p.lang_pred") != language.UNKNOWN) & (F.col("p.score") >= LEAST_SCORE)).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest id of each group of equal texts; null texts count as empty, a null id is the smallest.

    Whole texts of any length are compared. Of repeated rows one stays, whichever comes first. Columns may have any names and all stay. Empty tables stay empty.
    """
    return exact_dedup.drop_exact_duplicates(docs, keep="largest")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among ``gone`` (gone), null counting as an id; columns may have any names."""
    gone = materialize(gone)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"))
    return rows.join(small_side(gone, gone.count()), F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class (five words, similarity 0.8).

    Null and wordless texts are in no class and stay. Rows that share an id, null too, stay or go together: they go if none of
    them is to stay. Whole texts of any length are compared. Columns may have any names and all stay. Empty tables stay empty.
    """
    ship(spark)
    judged = materialize(near_dedup.near_duplicates(docs))
    gone = judged.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept")
    return without(docs, gone.select(F.col("doc_id").alias("gone")))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold less than 0.8 of every benchmark item's shingles.

    Null and wordless texts hold nothing and stay. Rows that share an id, null too, go if one of them goes. Whole texts of any length
    are searched. Columns may have any names and all stay. Empty tables stay empty; without benchmark items all documents stay.
    """
    ship(spark)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.select(F.col("doc_id").alias("gone")).distinct())


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` and ``decoded_sha256``, the digest of the decoded ids' bytes, which are the text's.

    One row per input row: a null text counts as empty and has no tokens; null ids, repeated rows and texts of any length pass; other
    columns, whatever their names, are left out. An empty table gives an empty result.
    """
    ship(spark)
    return bpe.round_trip(docs, TOKENIZER).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", identify_language), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark_passages), ("bpe", encode_tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch() as kept:
            docs = materialize(stage(spark, docs, sf_dir))
            kept += latest()  # a stage's own tables go when its rows are written
    return STAGES[-1][1](spark, docs, sf_dir)
