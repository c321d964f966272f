"""Which hashes of a corpus come up more than once, with a few bytes for each of them.

A task packs the hashes of a chunk of documents into one row for each bucket of the hash
space; what a bucket's task finds goes back to the chunk in one row. A hash takes 4 bytes
on the way and no row of its own. Chunks are numbered by task and batch, so that a task
that runs again gives the same rows; what is dealt must therefore be read from a table
(files, or one that `settle` has written), not come out of a shuffle, whose rows may
arrive in another order. Callers see to that with `stable_texts`.

A chunk also has a row of its own (facts about its documents), which goes to a group of its
own: no bucket holds the facts of several chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pathline.llm.batches import settle, texts_of
from pathline.llm.words import pieces

#: Text that a task holds as arrays of hashes at once.
CHUNK_BYTES = 8 << 20

ROWS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("head", pa.binary()), ("body", pa.binary())])
SCHEMA = "bucket long, chunk long, head binary, body binary"
BACK = pa.schema([("chunk", pa.int64()), ("head", pa.binary()), ("body", pa.binary())])
BACK_SCHEMA = "chunk long, head binary, body binary"


def stable_texts(docs: DataFrame, stable: bool) -> DataFrame:
    """doc_id and text as a table that gives the same rows in the same order each time: docs as they are if the
    caller says that they are read from files, else written first."""
    texts = texts_of(docs)
    return texts if stable else settle(texts, "texts")


def buckets_for(texts: DataFrame) -> int:
    """Four buckets for each task of the scan, whose size the session bounds, or for each shuffle partition where
    those are more: a bucket has some 60 MB of text at the default 128 MB a task, however large the table is."""
    return 4 * max(texts.rdd.getNumPartitions(), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def own_bucket(chunk: int) -> int:
    """Where a chunk's own row goes: below the buckets, and to no other chunk's."""
    return -1 - chunk


def chunk_numbers() -> Iterator[int]:
    from pyspark import TaskContext

    k = TaskContext.get().partitionId() << 32
    while True:
        yield k
        k += 1


def chunks(batches) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A task's batches joined and cut into chunks of about CHUNK_BYTES of text, numbered."""
    numbers, held, size = chunk_numbers(), [], 0

    def joined() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) for c in table.columns], table.column_names)

    for batch in batches:
        for i, j in pieces(batch.column("text"), CHUNK_BYTES):
            part = batch.slice(i, j - i)
            n = (pc.sum(pc.binary_length(part.column("text"))).as_py() or 0) + 64 * len(part)  # facts of a row included
            if held and size + n > CHUNK_BYTES:
                yield next(numbers), joined()
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield next(numbers), joined()


def deal(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): entries of bucket b are order[bounds[b]:bounds[b + 1]], in the order they had."""
    bucket = ((h >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.uint16 if n_buckets < 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n_buckets))])
    return order, bounds


def short(h: np.ndarray) -> np.ndarray:
    """The half of a hash that travels; the other half chose the bucket."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def repeated(h: np.ndarray) -> np.ndarray:
    """Whether each entry's value comes up again."""
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(h), dtype=bool)
    at = np.searchsorted(twice, h)
    at[at == len(twice)] = 0
    return twice[at] == h


def by_bucket(rows: DataFrame, answer) -> DataFrame:
    """Chunks' own rows pass on; those of bucket b get answer(chunks, heads, bodies),
    which returns (chunk, head, body) for each chunk that something goes back to."""

    def run(key, table):
        if key[0].as_py() < 0:
            return table.select(["chunk", "head", "body"]).cast(BACK)
        back = answer(table.column("chunk").to_pylist(), table.column("head").to_pylist(), table.column("body").to_pylist())
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*back, strict=True) if back else ([], [], []), BACK, strict=True)], schema=BACK)

    return rows.groupBy("bucket").applyInArrow(run, BACK_SCHEMA)


def pack_steps(steps: np.ndarray) -> bytes:
    """Non-negative steps in a byte each; 255 says that the step goes on in the next byte."""
    more, rest = np.divmod(steps, 255)
    out = np.full(len(steps) + int(more.sum()), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def unpack_places(packed: bytes) -> np.ndarray:
    """Where the steps lead, from 0 on."""
    b = np.frombuffer(packed, dtype=np.uint8)
    return np.cumsum(b, dtype=np.int64)[b != 255]


def pack_places(places: np.ndarray) -> bytes:
    return pack_steps(np.diff(places, prepend=0))
