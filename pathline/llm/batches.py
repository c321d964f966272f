"""Shared plumbing: Arrow batches of texts, the shared folder, checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many ids (8 bytes each) go to every executor; beyond, a shuffle join is used.
BROADCAST_IDS = 1_000_000


#: Text of an Arrow batch, as far as rows allow; the JVM and a worker each hold one at a time.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of the session by bytes, as texts can be long: a batch has 2 MB or one row."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(key, None) or "").rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns can have any name."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def map_texts(docs: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """A row for each row of docs: make() runs once in each task and returns
    f(list of texts, null as "") -> dict of columns; doc_id is put before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                columns = f(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns.values())], ["doc_id", *columns])

    return texts_of(docs).mapInArrow(run, f"doc_id long, {schema}")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; only on one machine is there one beside the warehouse without it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return at or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


def settle(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: it is computed once, and its lineage ends there."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def with_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows of docs whose key is in ids (with left_anti: is not); ids go to all executors only if their checked number is small."""
    ids = ids.select(key).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, how)
