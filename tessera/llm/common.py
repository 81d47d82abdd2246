"""Helpers that the operators of this folder share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RID = "__tessera_row"
WORD = r"[^\x20\x09-\x0D]+"
BATCH = "4m"
MOST_FILES = 2_000_000  # rows of the broadcast table of files, two longs each: some 100 MB as a hash table, for 250 TB in files of 128 MB
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_own: dict[str, tempfile.TemporaryDirectory] = {}  # folders of local sessions without a setting, by application


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) as Spark itself resolves a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir, with its scheme, so that Spark and Arrow mean the same
    place. Where it is unset a local session gets a temporary folder of its own; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.TemporaryDirectory(prefix="tessera-", ignore_cleanup_errors=True)
        at = "file://" + _own[context.applicationId].name
    fs, path = _hadoop(spark, at)
    return fs.makeQualified(path).toString()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """While jobs run in it, batches that go to Python have at most BATCH of data (a longer row goes alone)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, BATCH)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def stored(df: DataFrame, name: str, codec: str = "snappy", path: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = path or new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame) -> DataFrame:
    """Adds RID, unless df has it. Two scans of the same files may number rows differently, since the splits follow the cores
    that are alive: what joins a result with its rows takes both from kept_numbers()."""
    return df if RID in df.columns else df.withColumn(RID, F.monotonically_increasing_id())


def kept_numbers(df: DataFrame, name: str = "numbered") -> DataFrame:
    """df with RID, the same in all later scans. A scan of Parquet files gets it from file and place in the file, which don't depend on
    splits: a broadcast table has the number of each path's hash. Beyond MOST_FILES files, if two paths have one hash, or if df is no
    scan, its rows are written once with their numbers."""
    if RID in df.columns:
        return df
    try:
        path, place = (df.metadataColumn("_metadata").getField(f) for f in ("file_path", "row_index"))
        files = df.select(F.xxhash64(path).alias("__tessera_hash"), path.alias("__tessera_file")).distinct()
        known, hashes = files.agg(F.count(F.lit(1)), F.countDistinct("__tessera_hash")).first()
    except (AnalysisException, IllegalArgumentException):  # not a scan of Parquet files
        known = hashes = 0
    if not 0 < known <= MOST_FILES or hashes < known:
        return stored(numbered(df), name, "zstd")
    files = stored(files.select("__tessera_hash", F.row_number().over(Window.orderBy("__tessera_file")).cast("long").alias("__tessera_number")), "files")
    placed = df.select("*", F.xxhash64(path).alias("__tessera_hash"), place.alias("__tessera_place")).join(F.broadcast(files), "__tessera_hash")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.shiftleft("__tessera_number", 40) + F.col("__tessera_place")).alias(RID))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes empty. ASCII texts take the fast built-in lower()."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def running_totals(df: DataFrame, order: list, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """Adds `<v>_before` (sum of v before the row within its key) for each of values, and `index` (rows before it).

    Rows are range-partitioned by key and order with the row number as last tie-break, so one key or one tie may span
    many partitions. Each partition's totals per key, one row each, are summed up in partition order; a row adds its
    running sum within its own partition. keys must not be null.
    """
    keys = keys or []
    n = partitions(df.sparkSession)
    ranged = numbered(df).repartitionByRange(n, *keys, *order, RID).withColumn("__part", F.spark_partition_id())
    placed = stored(ranged.sortWithinPartitions(*keys, *order, RID).withColumn("__at", F.monotonically_increasing_id()), "prefix")
    totals = placed.groupBy(*keys, "__part").agg(*[F.sum(v).alias(f"__{v}_sum") for v in values], F.count(F.lit(1)).alias("__rows_sum"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(f"__{c}_sum").over(before), F.lit(0))
    bases = totals.select(*keys, "__part", *[earlier(v).alias(f"__{v}_base") for v in values], earlier("rows").alias("__first"))
    within = Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(bases, [*keys, "__part"]).withColumn("index", F.col("__first") + F.count(F.lit(1)).over(within) - 1)
    for v in values:
        out = out.withColumn(f"{v}_before", F.col(f"__{v}_base") + F.sum(v).over(within) - F.col(v))
    return out.drop("__part", "__at", "__first", RID, *[f"__{v}_base" for v in values])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): a row (node, root) for each node that isn't its component's smallest.

    Alternating stars: every node links its larger neighbours to the smallest it knows, then its smaller ones, until the
    edges no longer change. Each round is written to the shared folder, and the round before it deleted.
    """
    spark = edges.sparkSession
    big, small = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    path = new_path(spark, "edges")
    now = stored(edges.filter("a <> b").select(big, small).distinct(), "edges", path=path)
    sign = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    was = None
    for _ in range(rounds):
        mark = sign(now)
        if mark == was or mark[0] == 0:
            break
        was = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both.a == least.u).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        rest = large.join(least, large.a == least.u).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, path = path, new_path(spark, "edges")
        now = stored(rest.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).select(big, small).distinct(), "edges", path=path)
        drop_path(spark, old)
    else:
        raise RuntimeError(f"components not settled in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
