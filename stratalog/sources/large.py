"""One large snapshot document read by many tasks.

The text is read in fragments that end at a closing brace, which Spark deals over tasks by the file's blocks. Whether a fragment begins inside a string, how deep it is
and to which entry it belongs are running sums over the document's fragments: within a block by one task, from block to block over one row for each. Fragments of one entry
are put together and parsed by themselves; what stands around the entries makes the document's frame. A document is taken whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import small_side, stored

#: A document with a longer entry (characters) is rejected.
MOST_ENTRY = 64 << 20
PLACE = ["file", "block", "seq"]


def running(rows: DataFrame, value: Column, to: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all fragments of the document up to and with each one."""
    rows = rows.withColumn("_v", value)
    local = F.sum("_v").over(W.partitionBy("file", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    blocks = rows.groupBy("file", "block").agg(F.sum("_v").alias("_t"))
    earlier = F.sum("_t").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = stored(blocks.select("file", "block", F.coalesce(earlier, F.lit(0)).alias("_before")))  # a row for each block
    return stored(rows.withColumn(to, local).join(small_side(blocks), ["file", "block"]).withColumn(to, F.col(to) + F.col("_before")).drop("_v", "_before"))


def fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, seq, value`` and ``closed``: a brace follows the fragment."""
    m = lambda c: F.col(f"_metadata.{c}")
    rows = spark.read.option("lineSep", "}").text(path).select(m("file_path").alias("file"), m("file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), m("file_size").alias("size"), "value")
    rows = stored(rows)
    # with a brace after each fragment there would be one more character than the file has, if the last one has none
    ends = rows.groupBy("file").agg(F.max(F.struct("block", "seq")).alias("last"), (F.sum(F.octet_length("value") + 1) > F.max("size")).alias("open"))
    here = F.struct("block", "seq") == F.col("last")
    return rows.join(small_side(stored(ends)), "file").select(*PLACE, "value", (~(here & F.col("open"))).alias("closed"))


def entries(spark: SparkSession, path: str | list[str], level: int) -> DataFrame:
    """``file, n, text`` of the groups of fragments that end where an object at depth ``level`` ends, in order, and of the rest after the last; ``last`` marks that, ``whole`` tells that
    all braces and quotes of the document are closed."""
    rows = fragments(spark, path)
    plain = F.regexp_replace("value", r"\\.", "")
    parts = F.split(plain, '"')
    some = lambda odd, signs: F.length(F.regexp_replace(F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), ""), f"[^{signs}]", "")).cast("bigint")
    nested = lambda odd: F.struct(some(odd, "{").alias("opens"), (some(odd, r"\[") - some(odd, r"\]")).alias("lists"))
    marks = rows.select(*PLACE, "closed", (F.size(parts) - 1).cast("bigint").alias("quotes"), nested(0).alias("out"), nested(1).alias("in"))
    marks = running(marks, F.col("quotes"), "after")
    inside, ends_inside = (F.col("after") - F.col("quotes")) % 2 == 1, F.col("after") % 2 == 1
    marks = marks.select(*PLACE, ends_inside.alias("in_text"), F.when(inside, F.col("in")).otherwise(F.col("out")).alias("x"), F.when(ends_inside | ~F.col("closed"), 0).otherwise(1).cast("bigint").alias("closes"))
    marks = running(marks.select("*", "x.*").drop("x"), F.col("opens") - F.col("closes"), "depth")
    marks = running(marks, F.col("lists"), "in_lists")
    ends = (F.col("closes") == 1) & (F.col("depth") == level) & (F.col("in_lists") == 0)
    marks = running(marks.withColumn("ends", ends), F.col("ends").cast("bigint"), "n").withColumn("n", F.col("n") - F.col("ends").cast("bigint"))
    final = marks.groupBy("file").agg(F.max(F.struct("block", "seq", "depth", "in_text")).alias("z"), F.max("n").alias("last_n"), F.min("depth").alias("least"), F.max_by("ends", F.struct("block", "seq")).alias("ended"))
    final = final.select("file", "last_n", ((F.col("z.depth") == 0) & ~F.col("z.in_text") & (F.col("least") >= 0) & ~F.col("ended")).alias("whole"))
    texts = rows.join(marks.select(*PLACE, "n"), PLACE).select("file", "n", F.struct("block", "seq", F.concat("value", F.when(F.col("closed"), "}").otherwise("")).alias("t")).alias("x"), F.length("value").alias("size"))
    sizes = texts.groupBy("file").agg(F.max("size").alias("most"))
    long = stored(texts.groupBy("file", "n").agg(F.sum("size").alias("s")).groupBy("file").agg(F.max("s").alias("s")).join(sizes, "file").select("file", (F.col("s") > MOST_ENTRY).alias("long")))
    texts = texts.join(small_side(long.filter("not long")), "file", "left_semi").groupBy("file", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "").alias("text"))
    final = final.join(long, "file").select("file", "last_n", (F.col("whole") & ~F.col("long")).alias("whole"))
    return texts.join(small_side(stored(final)), "file", "right").select("file", "n", "text", (F.col("n") == F.col("last_n")).alias("last"), "whole")


def read_large(spark: SparkSession, path: str | list[str], bare: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same as ``snapshots.read_envelopes`` (``bare``: ``read_bare``) for documents of any size: (file, raw_path, entry) rows, and rejected files.

    An envelope may have no object of its own beside ``packages``; one that has is rejected.
    """
    level = 1 if bare else 2
    rows = stored(entries(spark, path, level))
    begin = r"(?s)^(\s*\{)(.*)$" if bare else r'(?s)^(\s*\{.*?"packages"\s*:\s*\{)(.*)$'
    first, last = F.col("n") == 0, F.col("last")
    head, rest = F.regexp_extract("text", begin, 1), F.when(F.col("n") == 0, F.regexp_extract("text", begin, 2)).otherwise(F.regexp_replace("text", r"^\s*,", ""))
    comma = first | last | F.col("text").rlike(r"^\s*,")
    body = F.concat(F.lit("{"), rest, F.lit("}"))
    map_of = lambda c: F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")
    told = rows.select("file", "n", "last", "whole", "text", F.when(first, head).alias("head"), F.when(~last & comma, map_of(body)).alias("entries"))
    # the frame: what stands before the first entry and after the last, which may hold entries that are no objects
    tail = F.when(last & first, F.col("text")).when(last, F.regexp_replace("text", r"^\s*,", ""))
    frames = told.groupBy("file").agg(F.max("whole").alias("whole"), F.max(F.when(first & ~last, F.col("head"))).alias("head"), F.max(tail).alias("tail"), F.bool_and(last | F.col("entries").isNotNull()).alias("parsed"))
    frame = map_of(F.concat(F.coalesce("head", F.lit("")), "tail"))
    packages = frame if bare else F.try_variant_get(F.col("frame")["packages"], "$", "map<string,variant>")
    frames = frames.withColumn("frame", frame).withColumn("packages", packages)
    version = F.lit(True) if bare else F.try_variant_get(F.col("frame")["version"], "$", "string") == "2"
    good = F.coalesce(F.col("whole") & F.col("parsed") & F.col("frame").isNotNull() & F.col("packages").isNotNull() & version, F.lit(False))
    frames = stored(frames.select("file", good.alias("good"), "packages"))
    kept = small_side(frames.filter("good").select("file"))
    found = told.filter("entries is not null").join(kept, "file", "left_semi").select("file", F.explode("entries").alias("raw_path", "entry"))
    return found.unionByName(frames.filter("good").select("file", F.explode("packages").alias("raw_path", "entry"))), frames.filter("not good").select("file")
