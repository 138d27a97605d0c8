"""Immutable shards of a growing table, compacted by size tiers, under a versioned manifest."""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target


@dataclass(frozen=True)
class Shard:
    """One immutable file, relative to the store: its rows, bytes, and how often its rows were merged."""

    file: str
    rows: int
    bytes: int
    generation: int


class ShardStore:
    """A folder of shards that only manifests make visible.

    `root` is a folder that driver and executors share. Each manifest lists all
    shards of one version and is a file of its own; the largest number is the
    current one. A writer first writes its shards, then a manifest under a
    temporary name, and renames it to the next number, which fails if another
    writer was first: then it takes up the newer manifest and tries again.
    Readers never see a part of a version, and a failed writer leaves only
    files that no manifest names, for `vacuum`. The rename must be atomic, as
    on HDFS and local disks; plain object stores' renames are not.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(root).toUri(), self._conf)
        self._rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._jvm = jvm
        for name in ("data", "manifests"):
            self._fs.mkdirs(self._path(f"{root}/{name}"))

    def version(self) -> int:
        """The current version; 0 before the first commit."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, the current one by default."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:010d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def _commit(self, version: int, shards: list[Shard]) -> bool:
        """Make `shards` the version after `version`; False if that exists already."""
        new = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(new, False)
        out.write(bytearray(json.dumps({"version": version + 1, "shards": [asdict(s) for s in shards]}, indent=1).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        options[0] = self._rename.NONE
        try:
            self._context.rename(new, self._path(f"{self.root}/manifests/v{version + 1:010d}.json"), options)
            return True
        except Exception as e:  # py4j wraps the Java exception
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(new, False)
            return False

    def _written(self, folder: str, generation: int) -> list[Shard]:
        """The non-empty files of a folder with their rows, from the files' footers."""
        size = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if s.getPath().getName().endswith(".parquet")}
        if not size:
            return []
        name = F.element_at(F.split("_metadata.file_path", "/"), -1)
        rows = self.spark.read.parquet(f"{self.root}/{folder}").groupBy(name.alias("name")).agg(F.count("*").alias("n")).collect()
        return sorted((Shard(f"{folder}/{r['name']}", r["n"], size[r["name"]], generation) for r in rows if r["n"]), key=lambda s: s.file)

    def append(self, rows: DataFrame) -> int:
        """Write an arrival as small shards, one a task, and commit; returns the version. No shuffle."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        new = self._written(folder, 0)
        while True:
            version = self.version()
            if not self._present(new):
                raise FileNotFoundError(f"shards of {folder} were deleted before they were committed")
            if self._commit(version, self.shards(version) + new):
                return version + 1

    def compact(self, target: int = 128 << 20, fanout: int = 4, smallest: int = 1 << 20) -> int:
        """Merge each tier of `fanout` or more shards into files of about `target` bytes, and commit; returns the version.

        A shard's tier is the power of `fanout` its size is of `smallest`;
        shards of half the target or more are finished. A tier's shards are
        dealt, in the order of their names, to files of up to the target, and a
        job of one task writes each file. If nothing is to be merged there is no new version.
        """
        while True:
            version = self.version()
            before = self.shards(version)
            tiers: dict[int, list[Shard]] = {}
            for s in before:
                if s.bytes < target / 2:
                    tiers.setdefault(max(0, math.floor(math.log(max(s.bytes, 1) / smallest, fanout))), []).append(s)
            plan: list[list[Shard]] = []
            for tier in (t for _, t in sorted(tiers.items()) if len(t) >= fanout):
                group: list[Shard] = []
                for s in sorted(tier, key=lambda s: s.file):
                    if group and sum(x.bytes for x in group) + s.bytes > target:
                        plan.append(group)
                        group = []
                    group.append(s)
                plan.append(group)
            plan = [g for g in plan if len(g) > 1]
            if not plan:
                return version
            merged = {s.file for g in plan for s in g}
            schema = self.spark.read.parquet(*[f"{self.root}/{f}" for f in sorted(merged)]).schema

            generation = 1 + max(s.generation for g in plan for s in g)

            def merge(group: list[Shard]) -> list[Shard]:
                folder = f"data/{uuid.uuid4().hex}"
                self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.file}" for s in group]).coalesce(1).write.parquet(f"{self.root}/{folder}")
                return self._written(folder, generation)

            # A file is a job of one task that reads its shards: no shuffle, so disk holds the shards twice at most.
            with ThreadPoolExecutor(max(1, self.spark.sparkContext.defaultParallelism)) as pool:
                made = [s for shards in pool.map(inheritable_thread_target(self.spark)(merge), plan) for s in shards]
            if self._commit(version, [s for s in before if s.file not in merged] + made):
                return version + 1

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version with `shard`, their file's number in the manifest; None for an empty store."""
        shards = self.shards(version)
        if not shards:
            return None
        rows = self.spark.read.parquet(*[f"{self.root}/{s.file}" for s in shards])
        key = F.array_join(F.slice(F.split("_metadata.file_path", "/"), -2, 2), "/")
        number = self.spark.createDataFrame([("/".join(s.file.split("/")[-2:]), k, s.generation) for k, s in enumerate(shards)], "_file string, shard int, generation int")
        return rows.withColumn("_file", key).join(F.broadcast(number), "_file").drop("_file")

    def vacuum(self, keep: int = 1, min_age_s: float = 86400.0) -> None:
        """Delete old manifests but the last `keep`, and the files that only those named.

        Files that no manifest names may be those of a writer that hasn't
        committed yet: they go only when they are older than `min_age_s`, which
        must be longer than any write takes. Readers of a version that is no
        longer kept lose its files.
        """
        version = self.version()
        numbers = sorted(int(s.getPath().getName()[1:-5]) for s in self._fs.listStatus(self._path(f"{self.root}/manifests")) if s.getPath().getName().startswith("v"))
        kept = {s.file for v in numbers if v > version - keep for s in self.shards(v)}
        expired = {s.file for v in numbers if v <= version - keep for s in self.shards(v)}
        for file in sorted(expired - kept):
            self._fs.delete(self._path(f"{self.root}/{file}"), False)
        for v in numbers:
            if v <= version - keep:
                self._fs.delete(self._path(f"{self.root}/manifests/v{v:010d}.json"), False)
        oldest = (time.time() - min_age_s) * 1000
        for folder in self._fs.listStatus(self._path(f"{self.root}/data")):
            files = list(self._fs.listStatus(folder.getPath()))
            names = {f"data/{folder.getPath().getName()}/{f.getPath().getName()}" for f in files}
            if not names & kept and folder.getModificationTime() < oldest and all(f.getModificationTime() < oldest for f in files):
                self._fs.delete(folder.getPath(), True)

    def _present(self, shards: list[Shard]) -> bool:
        return all(self._fs.exists(self._path(f"{self.root}/{s.file}")) for s in shards)


def shard_table(spark: SparkSession, root: str, arrivals: list[DataFrame], target: int = 128 << 20, fanout: int = 4) -> ShardStore:
    """Append every arrival, compact until nothing is left to merge, and vacuum; returns the store.

    Rows are stored as they are: nulls, empty and long texts, repeated rows and
    extra columns stay. An empty arrival adds a version and no shard.
    """
    store = ShardStore(spark, root)
    for rows in arrivals:
        store.append(rows)
    version = -1
    while version != (version := store.compact(target, fanout)):
        store.vacuum()
    return store
