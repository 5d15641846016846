"""Phrase search: consecutive words of a phrase within one text, accents and case aside.

Accents are those of the Latin letters listed here; other scripts and letters with several marks are compared as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side, stored

#: Letters with a mark and without, of Latin script (fixed values).
ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def folded(text: Column) -> Column:
    """Words (letters and digits) in lower case without accents, one blank before and after each."""
    words = F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def description_search(rows: DataFrame, requests: DataFrame, columns: tuple[str, ...] = ("name", "description")) -> DataFrame:
    """``request_id`` and the rows of which one column holds the request's ``phrase``: consecutive words, accents and case aside.

    Requests meet rows by the phrase's first word, so each text gives one row per distinct word; the rest of the phrase is checked in the join. A phrase without words matches nothing.
    """
    asked = requests.select("request_id", folded(F.col("phrase")).alias("_f")).filter(F.length("_f") > 2).withColumn("_w", F.split("_f", " ")[1])
    texts = F.array(*[folded(F.coalesce(c, F.lit(""))) for c in columns])
    named = rows.withColumn("_t", texts)
    words = F.array_distinct(F.filter(F.split(F.array_join("_t", " "), " +"), lambda w: w != ""))
    hits = named.withColumn("_key", F.explode(words)).join(small_side(asked), (F.col("_key") == F.col("_w")) & F.exists("_t", lambda t: F.contains(t, F.col("_f"))))
    return hits.drop("_t", "_key", "_w", "_f")


def token_rows(rows: DataFrame, keys: tuple[str, ...] = ("entity_path", "version"), columns: tuple[str, ...] = ("name", "description")) -> DataFrame:
    """``keys, column, pos, token``: each word of the folded texts with its place, to be stored once and asked often."""
    words = lambda c: F.filter(F.split(folded(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")
    texts = F.array(*[F.struct(F.lit(c).alias("column"), words(c).alias("words")) for c in columns])
    return rows.select(*keys, F.explode(texts).alias("_t")).select(*keys, "_t.column", F.posexplode("_t.words").alias("pos", "token"))


def phrase_hits(tokens: DataFrame, requests: DataFrame, keys: tuple[str, ...] = ("entity_path", "version")) -> DataFrame:
    """``request_id`` and the keys of rows that hold the request's ``phrase``, from stored ``token_rows``.

    A phrase's rarest word gives the places where it could begin; every other word is joined at its own distance from there, and where all are found the phrase stands.
    So a frequent word costs no more rows than the rarest one has. A phrase without words matches nothing.
    """
    words = F.filter(F.split(folded(F.col("phrase")), " "), lambda w: w != "")
    asked = stored(requests.select("request_id", words.alias("words")).filter(F.size("words") > 0))
    each = asked.select("request_id", F.posexplode("words").alias("at", "token"))
    hits = tokens.join(small_side(each.select("token").distinct()), "token")
    often = stored(hits.groupBy("token").agg(F.count("*").alias("n")))
    each = stored(each.join(small_side(often), "token", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    rarest = each.groupBy("request_id").agg(F.min(F.struct("n", "at", "token")).alias("r"), F.count("*").alias("words")).select("request_id", "words", F.col("r.at").alias("from"), "r.token")
    place = ["request_id", *keys, "column", "start"]
    starts = hits.join(small_side(stored(rarest)), "token").withColumn("start", F.col("pos") - F.col("from")).filter("start >= 0").select(*place, "words", "from")
    others = starts.join(small_side(each), "request_id").filter(F.col("at") != F.col("from")).select(*place, "words", "token", (F.col("start") + F.col("at")).alias("pos"))
    met = others.join(hits, ["token", *keys, "column", "pos"]).groupBy(*place).agg(F.count("*").alias("met"), F.first("words").alias("words")).filter("met = words - 1")
    return starts.filter("words = 1").select("request_id", *keys).unionByName(met.select("request_id", *keys)).distinct()


def phrase_search(docs: DataFrame, phrases: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(phrase, doc_id) of documents with the phrase, for a list of phrases in one pass. A phrase without words matches nothing."""
    norm = docs.select(F.col(id_col).alias("doc_id"), folded(F.col(text_col)).alias("t"))
    hits = F.filter(F.array(*[F.struct(F.lit(p).alias("phrase"), folded(F.lit(p)).alias("f")) for p in phrases]), lambda x: (F.length(x["f"]) > 2) & F.contains("t", x["f"]))
    return norm.select("doc_id", F.explode(hits).alias("h")).select("h.phrase", "doc_id")
