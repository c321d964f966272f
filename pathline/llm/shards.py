"""Sharding by size-tiered compaction, with DataFrame operations only.

Arrivals are appended as runs: folders of small immutable shards (files). Runs of similar
size make a tier; when a tier holds enough of them they are merged into one run, whose
files have the target size. So the number of runs grows with the logarithm of the table
up to the largest run that is merged, and then by one for each of those.

Every change ends with one new manifest, a single file that is complete before it gets its
version's name by a rename that fails where the name is taken. Readers see the old table
or the new one; a writer that comes second reads the newer manifest and tries again.
"""

from __future__ import annotations

import time
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathline.llm.batches import shared_dir

MANIFEST = "run string, files long, bytes long, rows long, tier int"


class Superseded(RuntimeError):
    """Another writer has replaced the runs that a change was made from."""


@dataclass(frozen=True)
class Tiers:
    target_bytes: int = 128 << 20  # size of a finished file
    fan_in: int = 4  # each tier's runs are this many times larger than those of the one below
    least_runs: int = 4  # so many runs of a tier are merged; fewer wait
    largest_run: int = 1 << 40  # runs of this size and more stay as they are


class ShardStore:
    """A table of rows as files under one folder, with versioned manifests."""

    def __init__(self, spark: SparkSession, root: str, tiers: Tiers = Tiers()):
        self.spark, self.root, self.tiers = spark, root.rstrip("/"), tiers
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        at, conf = hadoop.Path(self.root), spark._jsc.hadoopConfiguration()
        self._fs = at.getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)

    def _names(self, folder: str) -> list:
        at = self._path(folder)
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    # --- manifests -------------------------------------------------------------------------

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._names(f"{self.root}/manifests"))
        return sorted(int(n[1:10]) for n in names if n[0] == "v")

    def _named(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:09d}.parquet"

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """run, files, bytes, rows, tier of every run of a version (the newest, if none is named); None before the first."""
        held = self.versions()
        if not held:
            return None
        return self.spark.read.schema(MANIFEST).parquet(self._named(held[-1] if version is None else version))

    def _publish(self, manifest: DataFrame, version: int) -> bool:
        """The manifest as one file under the version's name; False if there is such a version already."""
        hidden = f"{self.root}/manifests/_{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(hidden)
        file = next(s.getPath() for s in self._names(hidden) if s.getPath().getName().startswith("part-"))
        try:
            self._context.rename(file, self._path(self._named(version)), self._no_options)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self._fs.delete(self._path(hidden), True)

    def _commit(self, change: Callable[[DataFrame | None], DataFrame]) -> int:
        """Makes change(newest manifest) the next version, again from the start where another writer was faster."""
        while True:
            held = self.versions()
            base = held[-1] if held else 0
            if self._publish(change(self.manifest(base) if held else None), base + 1):
                return base + 1

    def _described(self, runs: list[str], schema) -> DataFrame:
        """Manifest rows of runs, from facts of their files; no column is read."""
        files = self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{r}" for r in runs])
        path = F.col("_metadata.file_path")
        each = files.groupBy(F.regexp_extract(path, r"/data/(.*)/[^/]*$", 1).alias("run"), path.alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.count(F.lit(1)).alias("rows"))
        tier = F.floor(F.log(float(self.tiers.fan_in), F.greatest(F.col("bytes") / 1024, F.lit(1)))).cast("int")
        facts = each.groupBy("run").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum("rows").alias("rows"))
        return facts.withColumn("tier", tier)

    # --- changes ---------------------------------------------------------------------------

    def append(self, rows: DataFrame, by: Column | None = None) -> int:
        """Write arrivals, each a run of its own if `by` numbers them; other rows are untouched. Returns the version.

        All columns are stored, whatever their names; an empty table is a version without rows.
        """
        folder, name = uuid.uuid4().hex, "arrival"
        taken = {c.lower() for c in rows.columns}
        while name in taken:
            name += "_"
        at = f"{self.root}/data/{folder}"
        zstd = rows.write.option("compression", "zstd") if by is None else rows.withColumn(name, by).write.option("compression", "zstd").partitionBy(name)
        zstd.parquet(at)
        runs = [folder]
        if by is not None:
            runs = [f"{folder}/{s.getPath().getName()}" for s in self._names(at) if s.isDirectory() and s.getPath().getName().startswith(f"{name}=")]
            if not runs:  # no rows: one file that has the columns
                runs = [f"{folder}/{name}=0"]
                rows.limit(0).coalesce(1).write.parquet(f"{self.root}/data/{runs[0]}")
        new = self._described(runs, rows.schema)
        empty = new.limit(1).count() == 0
        if empty:
            new = self.spark.range(1).select(F.lit(runs[0]).alias("run"), *[F.lit(0).cast("long").alias(c) for c in ("files", "bytes", "rows")], F.lit(0).alias("tier"))
        return self._commit(lambda old: new if old is None else old.unionByName(new))

    def full_tiers(self) -> dict[int, list]:
        """Runs that are to be merged, by tier; the manifest has a few rows for each tier."""
        tiers = defaultdict(list)
        for r in self.manifest().filter(F.col("bytes") < self.tiers.largest_run).collect():
            tiers[r.tier].append(r)
        return {k: runs for k, runs in sorted(tiers.items()) if len(runs) >= self.tiers.least_runs}

    def _merge(self, runs: list[str]) -> str:
        """Runs read as tasks of the target size, each of which writes one file: no shuffle, and sizes are even."""
        folder = uuid.uuid4().hex
        wanted = {"spark.sql.files.maxPartitionBytes": str(self.tiers.target_bytes), "spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "4096"}
        was = {k: self.spark.conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                self.spark.conf.set(k, v)
            self.spark.read.parquet(*[f"{self.root}/data/{r}" for r in runs]).write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        finally:
            for k, v in was.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return folder

    def compact(self) -> int:
        """Merge every full tier, and again what has become one; a commit for each round. Returns the version."""
        while self.versions() and (full := self.full_tiers()):
            gone = [r.run for runs in full.values() for r in runs]
            merged = [self._merge([r.run for r in runs]) for runs in full.values()]
            new = self._described(merged, self.spark.read.parquet(f"{self.root}/data/{merged[0]}").schema)

            def change(old: DataFrame, gone=gone, new=new) -> DataFrame:
                if old.filter(F.col("run").isin(gone)).count() < len(gone):
                    raise Superseded("another writer has merged these runs")
                return old.filter(~F.col("run").isin(gone)).unionByName(new)

            try:
                self._commit(change)
            except Superseded:  # what was written is in no manifest; vacuum removes it
                continue
        return (self.versions() or [0])[-1]

    def vacuum(self, keep: int = 1, grace_seconds: float = 3600.0) -> int:
        """Remove all but the newest `keep` versions, then runs that none of these names and that are older than the
        grace, which a writer at work must stay within. Returns the number of runs."""
        kept = self.versions()[-keep:]
        for v in self.versions():
            if v not in kept:
                self._fs.delete(self._path(self._named(v)), False)
        used = {r.run for v in kept for r in self.manifest(v).select("run").collect()}
        before, n = (time.time() - grace_seconds) * 1000, 0
        for top in self._names(f"{self.root}/data"):
            name = top.getPath().getName()
            parts = [s for s in self._names(f"{self.root}/data/{name}") if s.isDirectory() and "=" in s.getPath().getName()]
            runs = {f"{name}/{s.getPath().getName()}": s for s in parts} or {name: top}
            dead = [s for r, s in runs.items() if r not in used and s.getModificationTime() <= before]
            if len(dead) == len(runs) and top.getModificationTime() <= before:
                self._fs.delete(top.getPath(), True)
            else:
                for s in dead:
                    self._fs.delete(s.getPath(), True)
            n += len(dead)
        return n

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, from the folders of its runs."""
        return self.spark.read.parquet(*[f"{self.root}/data/{r.run}" for r in self.manifest(version).select("run").collect()])


def compacted(docs: DataFrame, arrivals: int = 16, tiers: Tiers = Tiers()) -> tuple[ShardStore, int]:
    """A store into which docs has come in so many arrivals (drawn from doc_id; a null one comes with the first),
    compacted and without its old versions; and the number of arrivals that had rows."""
    store = ShardStore(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}", tiers)
    store.append(docs, by=F.coalesce(F.pmod("doc_id", F.lit(arrivals)), F.lit(0)))
    came = store.manifest().filter("rows > 0").count()
    store.compact()
    store.vacuum(grace_seconds=0)  # the store has no other writer
    return store, came


def op7_sharding(spark, sf_dir: str, arrivals: int = 16) -> DataFrame:
    """Every row read back from the compacted store: doc_id, n_bytes and text_sha256 (of the text; null: 0 and null),
    and facts of the newest manifest: arrivals (runs that came), manifest_rows, manifest_bytes_ok (its sizes are
    those of the files), merged (no tier is full) and versions (that can be read).

    No rows where documents has none. All columns of documents are stored.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store, came = compacted(docs, arrivals)
    facts = store.manifest().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    rows = store.read()
    on_disk = rows.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).distinct().agg(F.sum("s")).first()[0] or 0
    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("text_sha256"),
        F.lit(came).cast("long").alias("arrivals"),
        F.lit(facts.rows).cast("long").alias("manifest_rows"),
        F.lit(facts.bytes == on_disk).alias("manifest_bytes_ok"),
        F.lit(not store.full_tiers()).alias("merged"),
        F.lit(len(store.versions())).cast("long").alias("versions"),
    )


OP7_SQL = """
SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256,
       (SELECT count(DISTINCT coalesce(doc_id % 16, 0)) FROM documents) AS arrivals, (SELECT count(*) FROM documents) AS manifest_rows,
       true AS manifest_bytes_ok, true AS merged, CAST(1 AS BIGINT) AS versions
FROM documents
"""
