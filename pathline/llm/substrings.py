"""Substring dedup with fixed-block anchors.

A repeat of 13 words holds a whole block of 7 words wherever blocks are counted off from
the start of the earlier text. So the non-overlapping blocks of every text are the index,
and every rolling window of 7 words is a probe. Hits are extended: around each hit the
13-word windows are compared (96 bits of two independent hashes, within a bucket), the smallest doc_id that each starts in
is found, and windows of later documents that touch are one maximal repeat.

Both steps go through `exchange`: some bytes for a probe, no row for each, and no pair of
documents anywhere, so a passage that very many documents share costs one entry in each.
Whole copies are told by their digest and take no part in the second step.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathline.llm import exchange
from pathline.llm.batches import BROADCAST_IDS, settle
from pathline.llm.words import hashes, pieces, windows, words_of

#: Words of a window, and of a block: the longest that a window always holds whole.
WINDOW, BLOCK = 13, 7
#: Packed places that go to all executors at once; beyond, texts and places are shuffled.
BROADCAST_BYTES = 32 << 20
EMPTY = hashlib.sha256(b"").digest()


def _joined(text: str | None) -> bytes:
    """The words with one space between them; bytes.split() cuts at the same characters."""
    return b" ".join((text or "").encode().split())


def _rows(parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*parts, strict=True), exchange.ROWS, strict=True)], schema=exchange.ROWS)


def _places(table: pa.Table, n_info: int):
    """A chunk's own row, and the places that came back, in order."""
    heads, bodies = table.column("head").to_pylist(), table.column("body").to_pylist()
    own = next(k for k, b in enumerate(bodies) if b != b"hit")
    info = np.frombuffer(heads[own], dtype=np.int64).reshape(n_info, -1)
    got = [exchange.unpack_places(h) for k, h in enumerate(heads) if k != own]
    return info, bodies[own], np.sort(np.concatenate(got)) if got else np.zeros(0, dtype=np.int64)


def _by_text(places: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """For each text its own places, counted from its first word, packed; None where there are none."""
    cut = np.searchsorted(places, first)
    return [exchange.pack_places(places[a:b] - f) if b > a else None for a, b, f in zip(cut[:-1].tolist(), cut[1:].tolist(), first[:-1].tolist(), strict=True)]


def anchors(texts: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, digest (of the words) and hits: places of blocks that come up elsewhere too, packed, or null.

    texts: as `exchange.stable_texts` gives them.
    """
    n_buckets = exchange.buckets_for(texts)

    def deal(batches):
        for chunk, batch in exchange.chunks(batches):
            ids, column = batch.column("doc_id"), batch.column("text")
            valid = np.asarray(ids.is_valid())
            counts, grams, places, base = [], [], [], 0
            for i, j in pieces(column):
                w = words_of(column.slice(i, j - i))
                n = np.diff(w.first)
                g = windows(hashes(w), block)
                text = w.text_of
                ok = (text[: len(g)] == text[block - 1 :]) & (valid[i:j] & (n >= window))[text[: len(g)]] if len(g) else np.zeros(0, dtype=bool)
                at = np.flatnonzero(ok)
                grams.append(g[at])
                places.append(at + base)
                counts.append(n)
                base += len(w.start)
            counts, h, at = np.concatenate(counts), np.concatenate(grams), np.concatenate(places)
            first = np.concatenate([[0], np.cumsum(counts)])
            indexed = (at - first[np.searchsorted(first, at, "right") - 1]) % block == 0
            order, bounds = exchange.deal(h, n_buckets)
            h, at, indexed = exchange.short(h)[order], at[order], indexed[order]
            info = np.stack([np.asarray(ids.fill_null(0)), counts, valid.astype(np.int64)])
            digests = b"".join(hashlib.sha256(_joined(t)).digest() for t in column.to_pylist())
            out = [(exchange.own_bucket(chunk), chunk, info.tobytes(), digests)]
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                s = slice(bounds[b], bounds[b + 1])
                out.append((b, chunk, exchange.pack_places(at[s]), h[s].tobytes() + np.packbits(indexed[s]).tobytes()))
            yield _rows(out)

    def answer(chunks, heads, bodies):
        sizes = [8 * len(b) // 33 for b in bodies]  # four bytes and a bit for each
        h = np.concatenate([np.frombuffer(b, dtype=np.uint32, count=n) for b, n in zip(bodies, sizes, strict=True)])
        indexed = np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8, offset=4 * n), count=n) for b, n in zip(bodies, sizes, strict=True)]).astype(bool)
        hit = exchange.repeated(h)
        blocks = np.unique(h[hit & indexed])
        at = np.searchsorted(blocks, h)
        at[at == len(blocks)] = 0
        hit &= blocks[at] == h if len(blocks) else False
        out, k = [], 0
        for chunk, head, n in zip(chunks, heads, sizes, strict=True):
            if (mine := hit[k : k + n]).any():
                out.append((chunk, exchange.pack_places(exchange.unpack_places(head)[mine]), b"hit"))
            k += n
        return out

    def gather(key, table):
        info, digests, places = _places(table, 3)
        first = np.concatenate([[0], np.cumsum(info[1])])
        return pa.table(
            {
                "doc_id": pa.array(info[0], mask=info[2] == 0),
                "n_words": info[1],
                "digest": pa.array([digests[k : k + 32] for k in range(0, len(digests), 32)], type=pa.binary()),
                "hits": pa.array(_by_text(places, first), type=pa.binary()),
            }
        )

    back = exchange.by_bucket(texts.mapInArrow(deal, exchange.SCHEMA), answer)
    return back.groupBy("chunk").applyInArrow(gather, "doc_id long, n_words long, digest binary, hits binary")


def _with_texts(texts: DataFrame, keyed: DataFrame, packed: str) -> DataFrame:
    """Texts of the documents in keyed, beside its columns; keyed is sent to all executors if its checked size is small.

    Else both are shuffled and written: chunks are numbered by task and batch, so a task
    that runs again must find the same rows in the same order.
    """
    size = keyed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(packed)), F.lit(0)).alias("b")).first()
    few = size.n <= BROADCAST_IDS and size.b + 80 * size.n <= BROADCAST_BYTES
    both = texts.join(F.broadcast(keyed) if few else keyed, "doc_id")
    return both if few else settle(both, "texts")


def _later_windows(texts: DataFrame, keyed: DataFrame, window: int, block: int) -> DataFrame:
    """doc_id, digest, starts: windows around hits that also start in a document with a smaller doc_id, packed."""
    n_buckets = exchange.buckets_for(texts)

    def deal(batches):
        for chunk, batch in exchange.chunks(batches):
            said, digests, hits = (batch.column(c).to_pylist() for c in ("text", "digest", "hits"))
            mine = [k for k, t in enumerate(said) if hashlib.sha256(_joined(t)).digest() == digests[k]]
            if not mine:
                continue
            batch = batch.take(pa.array(mine))
            ids, column = np.asarray(batch.column("doc_id")), batch.column("text")
            hits = batch.column("hits").to_pylist()
            counts, one, two, places, base = [], [], [], [], 0
            for i, j in pieces(column):
                w = words_of(column.slice(i, j - i))
                h = hashes(w)
                near = np.zeros(len(w.start) + 1, dtype=np.int32)
                for k in range(i, j):
                    f, past = w.first[k - i], w.first[k - i + 1]
                    at = exchange.unpack_places(hits[k]) + f
                    np.add.at(near, np.maximum(at - (window - block), f), 1)
                    np.add.at(near, np.maximum(np.minimum(at, past - window) + 1, np.maximum(at - (window - block), f)), -1)
                at = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                one.append(windows(h, window)[at])
                two.append(windows(hashes(w, 1), window, 1)[at])
                places.append(at + base)
                counts.append(np.diff(w.first))
                base += len(w.start)
            counts, one, two, at = np.concatenate(counts), np.concatenate(one), np.concatenate(two), np.concatenate(places)
            first = np.concatenate([[0], np.cumsum(counts)])
            doc = ids[np.searchsorted(first, at, "right") - 1]
            order, bounds = exchange.deal(one, n_buckets)
            one, two, doc, at = one[order], two[order], doc[order], at[order]
            info = np.stack([ids, counts])
            out = [(exchange.own_bucket(chunk), chunk, info.tobytes(), b"".join(batch.column("digest").to_pylist()))]
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                s = slice(bounds[b], bounds[b + 1])
                out.append((b, chunk, exchange.pack_places(at[s]), exchange.short(one[s]).tobytes() + two[s].tobytes() + doc[s].tobytes()))
            yield _rows(out)

    def answer(chunks, heads, bodies):
        sizes = [len(b) // 20 for b in bodies]
        part = lambda kind, skip: np.concatenate([np.frombuffer(b, dtype=kind, count=n, offset=skip * n) for b, n in zip(bodies, sizes, strict=True)])
        one, two, doc = part(np.uint32, 0), part(np.uint64, 4), part(np.int64, 12)
        order = np.lexsort((doc, one, two))
        one, two, sorted_doc = one[order], two[order], doc[order]
        new = np.concatenate([[True], (two[1:] != two[:-1]) | (one[1:] != one[:-1])])
        least = sorted_doc[np.flatnonzero(new)][np.cumsum(new) - 1]  # the first of each run
        later = np.empty(len(doc), dtype=bool)
        later[order] = sorted_doc > least
        out, k = [], 0
        for chunk, head, n in zip(chunks, heads, sizes, strict=True):
            if (mine := later[k : k + n]).any():
                out.append((chunk, exchange.pack_places(exchange.unpack_places(head)[mine]), b"hit"))
            k += n
        return out

    def gather(key, table):
        info, digests, places = _places(table, 2)
        starts = _by_text(places, np.concatenate([[0], np.cumsum(info[1])]))
        mine = [k for k, s in enumerate(starts) if s is not None]
        return pa.table(
            {
                "doc_id": info[0][mine],
                "digest": pa.array([digests[32 * k : 32 * k + 32] for k in mine], type=pa.binary()),
                "starts": pa.array([starts[k] for k in mine], type=pa.binary()),
            }
        )

    rows = _with_texts(texts, keyed, "hits").select("doc_id", "text", "digest", "hits").mapInArrow(deal, exchange.SCHEMA)
    return exchange.by_bucket(rows, answer).groupBy("chunk").applyInArrow(gather, "doc_id long, digest binary, starts binary")


def _cut(texts: DataFrame, removed: DataFrame, window: int) -> DataFrame:
    """doc_id, digest, n_removed, kept (the words that stay, joined) and spans (repeats: first word, past the last)."""
    span = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows = []
            for i, text, digest, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "digest", "starts")), strict=True):
                joined = _joined(text)
                if hashlib.sha256(joined).digest() != digest:
                    continue  # another text with the same id
                words, at = joined.split(b" "), exchange.unpack_places(starts)
                cut = np.flatnonzero(np.diff(at) > window)
                spans = list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + window).tolist(), strict=True))
                kept, past = [], 0
                for a, b in spans:
                    kept += words[past:a]
                    past = b
                rows.append((i, digest, sum(b - a for a, b in spans), b" ".join(kept + words[past:]).decode(), [{"first": a, "past": b} for a, b in spans]))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), span)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "digest", "n_removed", "kept", "spans"])

    rows = _with_texts(texts, removed, "starts").select("doc_id", "text", "digest", "starts")
    return rows.mapInArrow(run, "doc_id long, digest binary, n_removed long, kept string, spans array<struct<first:long,past:long>>")


def repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, stable: bool = False) -> tuple[DataFrame, DataFrame]:
    """(every row of docs: doc_id, n_words, digest, copy; those partly removed: doc_id, digest, n_removed, kept, spans).

    copy says that a document with a smaller doc_id has just the same words (at least a
    window of them): all of it is removed. stable: docs is read from files as it is; else its
    texts are written to the shared folder first.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever blocks begin")
    texts = exchange.stable_texts(docs, stable)
    marked = settle(anchors(texts, window, block), "anchors")
    hit = marked.filter("hits is not null")
    # texts with copies alone, as a table of its own: a digest that very many rows have can then be split in the joins
    own = settle(hit.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "copies")
    own = F.broadcast(own) if own.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else own
    named = marked.join(own, "digest", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    keyed = hit.join(own, "digest", "left").filter("least IS NULL OR doc_id = least").groupBy("doc_id", "digest").agg(F.first("hits").alias("hits"))
    starts = _later_windows(texts, settle(keyed, "hits"), window, block)
    starts = settle(starts.groupBy("doc_id", "digest").agg(F.first("starts").alias("starts")), "starts")
    return named.select("doc_id", "n_words", "digest", "copy"), _cut(texts, starts, window)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row; a null text has no words, a null doc_id is left alone."""
    every, cut = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), stable=True)
    cut = cut.select("doc_id", "digest", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["doc_id", "digest"])
    both = every.join(cut, ["doc_id", "digest"], "left")
    return both.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


OP1_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT rid, doc_id, i, array_to_string(w[i : i + 12], ' ') AS s
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
r AS (SELECT rid, list(DISTINCT k) AS gone FROM (SELECT rid, unnest(range(i, i + 13)) AS k FROM g JOIN m USING (s) WHERE doc_id > least) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN r USING (rid)
"""
