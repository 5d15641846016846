"""Versioned datasets: published whole or by key buckets, with manifest, deltas and verification.

Under a dataset's folder each version has a folder ``v=N`` with the files that it wrote and, written last, its manifest: all files of all of its tables, those of
earlier versions included. A table in buckets is published by its touched buckets alone; files of the others are carried forward
in the manifest. Deltas (rows that came, changed or went between two versions) stand in the manifest too, so a reader of an
older version finds the shortest chain of them to the newest.
"""

from __future__ import annotations

import functools
import json
from collections import deque
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION, LEAST_READABLE = 4, 4
BUCKETS = 16
#: Rows of a file, so that its content is far below what one row of a digest's input can hold.
FILE_ROWS = 2_000_000
#: Versions back to which a manifest keeps deltas.
KEPT_DELTAS = 64
MANIFEST = "`table` string, buckets int, bucket int, file string, size bigint, sha256 string, low string, high string, `from` bigint, `to` bigint, `schema` string, schema_version int, min_schema_version int, latest string"


class Outdated(ValueError):
    """Another writer published a version meanwhile; what this one wrote is not seen by any reader."""


class NoChain(ValueError):
    """No chain of deltas leads from a version to the newest."""


class Damaged(ValueError):
    """Files of a version are changed, missing or not listed."""


@dataclass
class Bucketed:
    """Rows of the touched buckets of a table: they take the place of all rows that these had. ``keys`` name a row in deltas."""

    rows: DataFrame
    touched: list[int]
    keys: list[str]
    #: Column that rows of a file are sorted by.
    order: str
    #: Number of buckets; it stays what it was when the table was first published.
    buckets: int = BUCKETS
    #: Whether deltas are published, which pays for tables that readers keep.
    deltas: bool = True


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def place(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, pattern: str, up: int) -> list[int]:
    glob, fs = place(spark, pattern)
    found = []
    for f in fs.globStatus(glob) or ():
        p = f.getPath()
        for _ in range(up):
            p = p.getParent()
        found.append(int(p.getName()[2:]))
    return sorted(found)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions under ``path``, in order; a version counts once its manifest is complete."""
    return numbers(spark, f"{path}/v=*/manifest/_SUCCESS", 2)


def claimed(spark: SparkSession, path: str) -> int:
    """A version's number that no other writer has: its folder's first file is made by one writer only."""
    n = max(numbers(spark, f"{path}/v=*", 0), default=-1) + 1
    while True:
        file, fs = place(spark, f"{path}/v={n}/_claim")
        try:
            fs.create(file, False).close()
            return n
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception.getClass()):
                raise
            n += 1


def manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/v={version}/manifest")


@functools.lru_cache(64)
def _listed(app: str, spark: SparkSession, path: str, version: int) -> tuple:
    return tuple(manifest(spark, path, version).collect())


def listing(spark: SparkSession, path: str, version: int) -> tuple:
    """A published manifest's rows, one for each file; it never changes, so it is read once per application."""
    return _listed(spark.sparkContext.applicationId, spark, path, version)


def bucket_count(spark: SparkSession, path: str, name: str, otherwise: int = BUCKETS) -> int:
    """In how many buckets a table is published; ``otherwise`` for one that is not yet."""
    old = versions(spark, path)
    return next((r["buckets"] for r in listing(spark, path, old[-1]) if r["table"] == name and r["buckets"]), otherwise) if old else otherwise


def written(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """``bucket, file, size, sha256`` of the Parquet files under a folder; files are named from the dataset's folder on."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{path}/{folder}")
    bucket = F.nullif(F.regexp_extract("path", r"/bucket=([0-9]+)/", 1), F.lit("")).cast("int")
    return files.select(bucket.alias("bucket"), from_dataset(F.col("path")).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def from_dataset(file: Column) -> Column:
    return F.regexp_extract(file, r"^.*/(v=[0-9]+/.+)$", 1)


def files_of(listed, name: str) -> dict[str, int | None]:
    """A table's files in a manifest's rows, with their buckets."""
    return {r["file"]: r["bucket"] for r in listed if r["table"] == name and r["from"] is None and r["file"]}


def schema_of(listed, name: str) -> StructType:
    found = next((r["schema"] for r in listed if r["table"] == name and r["schema"]), None)
    if found is None:
        raise ValueError(f"no table {name} is published")
    return StructType.fromJson(json.loads(found))


def read_files(spark: SparkSession, path: str, schema: StructType, files) -> DataFrame:
    files = sorted(files)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in files]) if files else spark.createDataFrame([], schema)


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ: ``op`` (insert, change, delete), keys, and the new values (null where the row is gone)."""
    values = [c for c in new.columns if c not in keys]
    row = lambda df, name: df.select(*keys, F.struct(*values).alias(name))
    both = row(old, "was").join(row(new, "now"), keys, "full")
    op = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(~F.col("was").eqNullSafe(F.col("now")), "change")
    return both.select(op.alias("op"), *keys, "now.*").filter("op is not null")


def publish(tables: dict[str, DataFrame], path: str, latest: str, least_readable: int = LEAST_READABLE, bucketed: dict[str, Bucketed] | None = None, delta_steps: tuple[int, ...] = (1,), orders: dict[str, str] | None = None) -> DataFrame:
    """Write a new version of a dataset: its files first, and at last the manifest by which readers find it.

    ``tables`` are written whole. Of ``bucketed`` ones the touched buckets are written, and the others' files carried forward; for each of ``delta_steps`` the rows that
    differ from the version so many publications back are written as a delta, for which files that both versions share are not read. Nothing that is
    published is overwritten, so readers see the old version or the new one, whole; a run that ends early leaves a version without manifest, which nobody
    reads. Of two writers at a time one fails with ``Outdated``. ``orders`` names a column of a whole table; its least and greatest text in each file stand
    in the manifest, as does that of a bucketed table's order.
    """
    if not LEAST_READABLE <= least_readable <= SCHEMA_VERSION:
        raise ValueError(f"readers of schema {least_readable} can't be served by schema {SCHEMA_VERSION}")
    bucketed = bucketed or {}
    spark = next(iter(tables.values())).sparkSession if tables else next(iter(bucketed.values())).rows.sparkSession
    old = versions(spark, path)
    before = listing(spark, path, old[-1]) if old else ()
    n = claimed(spark, path)
    rows = []
    for name, df in tables.items():
        df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/v={n}/{name}")
        rows += made(spark, path, n, name, df.schema, (orders or {}).get(name))
    for name, b in bucketed.items():
        kept = [r for r in before if r["table"] == name and r["from"] is None and r["file"] and r["bucket"] not in set(b.touched)]
        place_of = b.rows.select("*", bucket_of(F.col(b.keys[0]), b.buckets).alias("bucket"))
        # large buckets are dealt by ranges of the order, so files of a bucket are of disjoint ranges
        dealt = place_of.repartitionByRange("bucket", b.order).sortWithinPartitions("bucket", b.order)
        dealt.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(f"{path}/v={n}/{name}")
        own = [{**r, "buckets": b.buckets} for r in made(spark, path, n, name, b.rows.schema, b.order)]
        rows += own + [r.asDict() for r in kept]
        now = files_of([*own, *kept], name)
        for step in delta_steps if b.deltas else ():
            if len(old) >= step:
                was = listing(spark, path, old[-step])
                there = files_of(was, name)
                if not there and not any(r["table"] == name for r in was):
                    continue
                read = lambda files: read_files(spark, path, b.rows.schema, files)  # noqa: B023, E731
                delta = changes(read(there.keys() - now.keys()), read(now.keys() - there.keys()), b.keys)
                folder = f"{name}-delta-{old[-step]}"
                delta.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/v={n}/{folder}")
                rows += [{**r, "table": name, "from": old[-step], "to": n} for r in made(spark, path, n, folder, delta.schema)]
        known = set(old[-KEPT_DELTAS:])
        rows += [r.asDict() for r in before if r["table"] == name and r["from"] is not None and r["from"] in known]
    stamped = [tuple({**r, "schema_version": SCHEMA_VERSION, "min_schema_version": least_readable, "latest": latest}.get(c.split()[0].strip("`")) for c in MANIFEST.split(", ")) for r in rows]
    if versions(spark, path) != old:
        raise Outdated(f"{path} has a newer version than the one that v={n} is made from")
    spark.createDataFrame(stamped, MANIFEST).coalesce(1).write.json(f"{path}/v={n}/manifest")
    return manifest(spark, path, n)


def made(spark: SparkSession, path: str, n: int, folder: str, schema: StructType, order: str | None = None) -> list[dict]:
    """Manifest rows of what was just written; one without a file where nothing was."""
    plain = {"table": folder, "from": None, "to": None, "schema": schema.json()}
    files = written(spark, path, f"v={n}/{folder}").collect()
    ends = {}
    if files and order and schema[order].dataType.typeName() == "string":
        at = from_dataset(F.col("_metadata.file_path")).alias("file")
        each = spark.read.schema(schema).parquet(*[f"{path}/{r['file']}" for r in files]).select(at, order).groupBy("file").agg(F.min(order).alias("low"), F.max(order).alias("high"))
        ends = {r["file"]: {"low": r["low"], "high": r["high"]} for r in each.collect()}  # a row for each file
    return [{**plain, **r.asDict(), **ends.get(r["file"], {})} for r in files] or [{**plain, "bucket": None, "file": None, "size": None, "sha256": None}]


def files_with(spark: SparkSession, path: str, name: str, prefixes: DataFrame) -> list[str]:
    """Files of the newest version in which a text may start with one of ``prefixes`` (one column, any number of rows), by the least and greatest text in each.

    Prefixes are compared with the files' ranges, not with rows.
    """
    listed = [r for r in listing(spark, path, newest_version(spark, path)) if r["table"] == name and r["from"] is None and r["file"]]
    ranges = F.from_json(F.lit(json.dumps([{"i": i, "low": r["low"], "high": r["high"]} for i, r in enumerate(listed)])), "array<struct<i: int, low: string, high: string>>")
    q = F.col("q")
    may = F.filter(ranges, lambda f: f["low"].isNull() | ((f["high"] >= q) & ((f["low"] <= q) | F.startswith(f["low"], q))))
    hit = prefixes.toDF("q").filter("q is not null").distinct().select(F.explode(F.transform(may, lambda f: f["i"])).alias("i")).distinct().collect()  # at most as many as files
    return [listed[r["i"]]["file"] for r in hit]


def newest_version(spark: SparkSession, path: str) -> int:
    """The newest published version; raises if there is none, or if it needs a newer reader."""
    found = versions(spark, path)
    if not found:
        raise ValueError(f"nothing is published under {path}")
    needs = max((r["min_schema_version"] for r in listing(spark, path, found[-1])), default=SCHEMA_VERSION + 1)
    if needs > SCHEMA_VERSION:
        raise ValueError(f"dataset needs schema {needs}, this reader has {SCHEMA_VERSION}")
    return found[-1]


def read_table(spark: SparkSession, path: str, name: str, version: int | None = None, buckets: list[int] | None = None, prefixes: DataFrame | None = None) -> DataFrame:
    """A table of a version (None: the newest), or of some of its buckets, or of the newest version what may start with one of ``prefixes``; other files are not read."""
    listed = listing(spark, path, newest_version(spark, path) if version is None else version)
    files = files_of(listed, name)
    if prefixes is not None:
        return read_files(spark, path, schema_of(listed, name), files_with(spark, path, name, prefixes))
    return read_files(spark, path, schema_of(listed, name), [f for f, b in files.items() if buckets is None or b in set(buckets)])


def table_names(spark: SparkSession, path: str) -> set[str]:
    return {r["table"] for r in listing(spark, path, newest_version(spark, path)) if r["from"] is None}


def latest_of(spark: SparkSession, path: str) -> str:
    """What the newest version's publisher named it by."""
    return listing(spark, path, newest_version(spark, path))[0]["latest"]


def chain(edges: set[tuple[int, int]], begin: int, end: int) -> list[tuple[int, int]]:
    """The shortest way from ``begin`` to ``end``; of equally short ones that with the longest first steps."""
    came, todo = {begin: None}, deque([begin])
    while todo and end not in came:
        at = todo.popleft()
        for to in sorted((b for a, b in edges if a == at and b not in came), reverse=True):
            came[to] = at
            todo.append(to)
    if end not in came:
        raise NoChain(f"no chain of deltas from version {begin} to {end}: take the whole dataset")
    way = []
    while end != begin:
        way.append((came[end], end))
        end = came[end]
    return way[::-1]


def deltas(spark: SparkSession, path: str, name: str, at: int) -> DataFrame:
    """The deltas of the shortest chain from version ``at`` to the newest: ``op``, keys, values and, if there are any, ``_step``.

    They are verified by size and digest; a missing link is refused.
    """
    to = newest_version(spark, path)
    listed = listing(spark, path, to)
    way = chain({(r["from"], r["to"]) for r in listed if r["table"] == name and r["from"] is not None}, at, to)
    rows = [r for r in listed if r["table"] == name and (r["from"], r["to"]) in set(way)]
    check(spark, path, [r for r in rows if r["file"]])
    if not way:
        return read_files(spark, path, schema_of(listed, name), []).select(F.lit("").alias("op"), "*")
    schema = schema_of(rows, name)
    out = None
    for step, edge in enumerate(way):
        files = [r["file"] for r in rows if (r["from"], r["to"]) == edge and r["file"]]
        part = read_files(spark, path, schema, files).withColumn("_step", F.lit(step))
        out = part if out is None else out.unionByName(part)
    return out


def composed(steps: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key of several deltas (``_step``): the last; a key that came and went again is a delete, which does nothing to those without it."""
    if "_step" not in steps.columns:
        return steps
    rest = [c for c in steps.columns if c not in (*keys, "_step")]
    return steps.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_step").alias("r")).select("r.op", *keys, *[f"r.{c}" for c in rest if c != "op"])


def apply_changes(have: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``have`` with the rows of a delta (one for each key) put in, changed or taken out."""
    stay = have.join(delta.select(*keys), keys, "left_anti")
    return stay.unionByName(delta.filter("op <> 'delete'").select(*have.columns))


def catch_up(spark: SparkSession, path: str, name: str, have: DataFrame, at: int, keys: list[str]) -> DataFrame:
    """The newest rows of a table, from those of version ``at`` and the chain of deltas."""
    return apply_changes(have, composed(deltas(spark, path, name, at), keys), keys)


def problems(spark: SparkSession, path: str, listed: list) -> DataFrame:
    """``file, problem`` of listed files (manifest rows): missing, or changed in size or content; digests are made by Spark's tasks, file by file."""
    want = spark.createDataFrame([(r["file"], r["size"], r["sha256"]) for r in listed], "file string, size bigint, sha256 string")
    there = {}
    for folder in {r["file"].split("/")[0] for r in listed}:
        top, fs = place(spark, f"{path}/{folder}")
        if fs.exists(top):
            each = fs.listFiles(top, True)
            while each.hasNext():
                f = each.next()
                name = f.getPath().toString()
                there[folder + name.rsplit(f"/{folder}", 1)[1]] = f.getLen()
    present = [f"{path}/{r['file']}" for r in listed if r["file"] in there]
    if present:
        now = spark.read.format("binaryFile").load(present).select(from_dataset(F.col("path")).alias("file"), F.col("length"), F.sha2("content", 256).alias("digest"))
    else:
        now = spark.createDataFrame([], "file string, length bigint, digest string")
    problem = F.when(F.col("length").isNull(), "missing").when((F.col("length") != F.col("size")) | (F.col("digest") != F.col("sha256")), "changed")
    return want.join(now, "file", "left").select("file", problem.alias("problem")).filter("problem is not null")


def check(spark: SparkSession, path: str, listed: list) -> None:
    if listed and (bad := problems(spark, path, listed).limit(5).collect()):
        raise Damaged("; ".join(f"{r.file} is {r.problem}" for r in bad))


def verify(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``file, problem`` of a published version: listed files that are missing or changed, and Parquet files of its folder that are not listed (extra)."""
    n = newest_version(spark, path) if version is None else version
    listed = [r for r in listing(spark, path, n) if r["file"]]
    own = {r["file"] for r in listed}
    top, fs = place(spark, f"{path}/v={n}")
    each, extra = fs.listFiles(top, True), []
    while each.hasNext():
        name = f"v={n}" + each.next().getPath().toString().rsplit(f"/v={n}", 1)[1]
        if name.endswith(".parquet") and name not in own:
            extra.append((name, "extra"))
    return problems(spark, path, listed).unionByName(spark.createDataFrame(extra, "file string, problem string"))


def drop_versions(spark: SparkSession, path: str, keep: int) -> None:
    """Delete all but the newest ``keep`` versions, but for files that these still list."""
    found = versions(spark, path)
    gone = found[:-keep]
    if not gone:
        return
    wanted = {r["file"] for n in found[-keep:] for r in listing(spark, path, n) if r["file"]}
    for n in gone:
        top, fs = place(spark, f"{path}/v={n}")
        fs.delete(place(spark, f"{path}/v={n}/manifest")[0], True)  # from here on nobody reads it
        each, left = fs.listFiles(top, True), 0
        while each.hasNext():
            f = each.next().getPath()
            if f"v={n}" + f.toString().rsplit(f"/v={n}", 1)[1] in wanted:
                left += 1
            else:
                fs.delete(f, False)
        if not left:
            fs.delete(top, True)
