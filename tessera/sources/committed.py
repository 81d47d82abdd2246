"""A table of Parquet files with atomic commits: staged files count once a manifest names them, and a batch counts once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEQUENCE = "__commit"


class Conflict(RuntimeError):
    """Other writers have committed again and again in between."""


class CommittedTable:
    """Rows under `path`/data, versions under `path`/manifests.

    A commit writes its rows into a folder of its own and then renames a manifest to the next version's name, which fails if
    another writer was first; then the commit is made anew on what that one left. So readers see whole commits or nothing,
    a crash leaves files that no manifest names, and two writers lose nothing. A manifest also has the last batch of each stream,
    so a batch that a stream replays adds nothing. The rename is atomic where the file system's is (HDFS; Spark's own
    streaming log rests on the same).

    insert(): rows whose keys the table doesn't hold. upsert(): of rows with equal keys the one with the largest ordinal
    stays, in whatever order they come, so a late older row changes nothing; of equal ordinals the later commit's. Upserts are
    resolved when the table is read; compact() writes what is read as one commit.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], ordinal: str | None = None):
        self.spark, self.path, self.keys, self.ordinal = spark, path.rstrip("/"), keys, ordinal
        self.schema = spark.createDataFrame([], schema).schema
        missing = {*keys, *([ordinal] if ordinal else [])} - set(self.schema.names)
        if missing:
            raise ValueError(f"no such columns: {sorted(missing)}")
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(f"{self.path}/manifests"))

    def _versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/manifests")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, the latest if none is given: version, parts (folder, commit) and batches (stream: last batch)."""
        versions = self._versions()
        if version is None and not versions:
            return {"version": 0, "parts": [], "batches": {}}
        at = self._at(f"{self.path}/manifests/{versions[-1] if version is None else version:012d}.json")
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        staged = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._fs.makeQualified(staged), self._fs.makeQualified(self._at(f"{self.path}/manifests/{manifest['version']:012d}.json")), options)
        except Py4JJavaError as e:
            self._fs.delete(staged, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def _rows(self, manifest: dict) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema).withColumn(SEQUENCE, F.lit(0).cast("long"))
        if not manifest["parts"]:
            return empty
        of = F.create_map(*[F.lit(x) for p in manifest["parts"] for x in (p["folder"], p["commit"])])
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]+)/[^/]*$", 1)
        files = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{p['folder']}" for p in manifest["parts"]])
        return files.select(*self.schema.names, F.element_at(of, folder).cast("long").alias(SEQUENCE))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version: one row for each key, if it has an ordinal."""
        rows = self._rows(self.manifest(version))
        if not self.ordinal:
            return rows.drop(SEQUENCE)
        w = Window.partitionBy(*self.keys).orderBy(F.desc_nulls_last(self.ordinal), F.desc(SEQUENCE), *[F.desc(c) for c in self.schema.names if c not in (*self.keys, self.ordinal)])
        return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", SEQUENCE)

    def commit(self, make: Callable[[dict], DataFrame | None], batch: tuple[str, int] | None = None, replace: bool = False, tries: int = 20) -> bool:
        """Commits what `make` gives for the manifest it builds on; False if the batch is in already, or there is nothing to add."""
        for _ in range(tries):
            now = self.manifest()
            if batch and now["batches"].get(batch[0], -1) >= batch[1]:
                return False
            rows = make(now)
            folder = uuid.uuid4().hex
            version = now["version"] + 1
            if rows is not None:
                rows.select(*self.schema.names).write.parquet(f"{self.path}/data/{folder}")
            part = [{"folder": folder, "commit": version}] if rows is not None else []
            if self._publish({"version": version, "parts": ([] if replace else now["parts"]) + part, "batches": now["batches"] | ({batch[0]: batch[1]} if batch else {})}):
                return True
            if rows is not None:
                self._fs.delete(self._at(f"{self.path}/data/{folder}"), True)
        raise Conflict(f"no commit to {self.path} in {tries} tries")

    def insert(self, df: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Adds rows whose keys the table doesn't hold yet; of rows with equal keys one."""
        new = df.dropDuplicates(self.keys)
        return self.commit(lambda now: new.join(self._rows(now).select(*self.keys), self.keys, "left_anti") if now["parts"] else new, batch)

    def upsert(self, df: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Adds rows that replace those of their keys with a smaller ordinal. Reads nothing of the table."""
        if not self.ordinal:
            raise ValueError("upserts need an ordinal")
        return self.commit(lambda now: df, batch)

    def compact(self) -> bool:
        """Writes what is read now as the only part. Older versions stay readable until their folders are cleared."""
        return self.commit(lambda now: self.read(now["version"]) if now["parts"] else None, replace=True)

    def clear_unnamed(self) -> int:
        """Deletes the data folders that no manifest names, which crashed or beaten commits left; no commit may be under way. Returns how many."""
        named = {p["folder"] for v in self._versions() for p in self.manifest(v)["parts"]}
        data = self._at(f"{self.path}/data")
        left = [s.getPath() for s in self._fs.listStatus(data) if s.getPath().getName() not in named] if self._fs.exists(data) else []
        for at in left:
            self._fs.delete(at, True)
        return len(left)
