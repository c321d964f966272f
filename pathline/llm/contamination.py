"""Benchmark decontamination: an FM-index for each training shard, searched for test phrases.

A shard is some megabytes of documents in one task. Words that some phrase of the pass has are
numbered; stretches of such words, long enough for a phrase, make up the indexed sequence, and
anything else is a separator. The shard is indexed once; the phrases of every block of the
benchmark are put into its numbers (one with a word, or two words side by side, that the shard
lacks cannot occur) and searched backwards through wavelet ranks. Places come from sampled suffix positions, and the
places of a document are merged into removal spans. Shards are independent: no shuffle.

Phrases travel in blocks of checked size. A pass over the documents searches for so many
blocks that their tables fit in a worker; a benchmark beyond one pass takes further ones, each
of which writes what it hits before its blocks are given up, and the spans of all are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathline.llm.batches import settle, small_batches, texts_of
from pathline.llm.fmindex import FMIndex
from pathline.llm.words import LETTERS, Words, hashes, pieces, words_of

WIDTH = 10
#: Benchmark text of a block. A word takes 12 bytes, a window 5 and 12 for each of its items, so a block has some 8 MB.
BLOCK_BYTES = 2 << 20
#: Blocks that go to all executors for one pass.
PASS_BLOCKS = 12
#: Texts with hits whose spans go to all executors, where a benchmark takes several passes.
BROADCAST_TEXTS = 100_000


@dataclass
class Phrases:
    """A block: distinct windows of its items as places in the block's sequence of word numbers (from 1)."""

    words: np.ndarray  # hashes of its distinct words, sorted
    numbers: np.ndarray  # of its words, in order
    start: np.ndarray  # of each window, in numbers
    sizes: np.ndarray
    items: np.ndarray  # ids of window p: items[first[p] : first[p + 1]]
    first: np.ndarray


def phrases_of(items: list[tuple[int, str]], width: int = WIDTH) -> Phrases:
    w = words_of(pa.array([t for _, t in items], type=pa.large_string()), LETTERS, lower=True)
    words, numbers = np.unique(hashes(w), return_inverse=True)
    n = np.diff(w.first)
    windows = np.where(n > 0, np.maximum(1, n - width + 1), 0)
    item = np.repeat(np.arange(len(items)), windows)
    start = w.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
    size = np.minimum(width, n[item])
    rows = np.zeros((len(item), width), dtype=np.int32)
    for k in range(width):
        has = k < size
        rows[has, k] = numbers[start[has] + k] + 1
    _, at, phrase = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    ids = np.array([i for i, _ in items], dtype=np.int64)
    pairs = np.unique(np.stack([phrase.ravel(), ids[item]], axis=1), axis=0) if len(item) else np.zeros((0, 2), dtype=np.int64)
    first = np.searchsorted(pairs[:, 0], np.arange(len(at) + 1)).astype(np.int32)
    return Phrases(words, (numbers + 1).astype(np.int32), start[at].astype(np.int32), size[at].astype(np.int8), pairs[:, 1], first)


class Pass:
    """Blocks that are searched for together: their words are numbered in common."""

    def __init__(self, blocks: list[Phrases]):
        self.words = np.unique(np.concatenate([b.words for b in blocks])) if blocks else np.zeros(0, dtype=np.uint64)
        self.blocks = blocks
        for b in blocks:
            common = np.append(0, np.searchsorted(self.words, b.words) + 1).astype(np.int32)
            b.numbers, b.words = common[b.numbers], b.words[:0]
        self.shortest = min((int(b.sizes.min()) for b in blocks if len(b.sizes)), default=0)


def stretches(words: Words, known_words: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, number of the word of each): runs of known words of one text, each followed by a separator."""
    h = hashes(words)
    at = np.searchsorted(known_words, h)
    at[at == len(known_words)] = 0
    known = np.flatnonzero(known_words[at] == h) if len(known_words) else np.zeros(0, dtype=np.int64)
    if not len(known):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = np.searchsorted(words.first, known, "right")
    begins = np.concatenate([[True], (np.diff(known) > 1) | (np.diff(text) > 0)])
    run = np.cumsum(begins) - 1
    size = np.bincount(run)
    long = size[run] >= shortest
    known, run = known[long], run[long]
    if not len(known):
        return known, known
    gap = np.concatenate([np.diff(run) > 0, [False]])
    to = np.arange(len(known)) + np.concatenate([[0], np.cumsum(gap)[:-1]])
    symbols, number = np.zeros(int(to[-1]) + 1, dtype=np.int64), np.full(int(to[-1]) + 1, -1, dtype=np.int64)
    symbols[to], number[to] = at[known] + 1, known
    return symbols, number


#: Places of a table that says which words stand side by side in a shard.
_PAIRS = 1 << 22


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(42)


def find(words: Words, sent: Pass) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block with occurrences (block, first word, number of words, phrase) of every one of them."""
    if not sent.shortest:
        return
    symbols, number = stretches(words, sent.words, sent.shortest)
    if not len(symbols):
        return
    here, symbols = np.unique(np.append(0, symbols), return_inverse=True)  # the shard's own numbers; 0 stays 0
    index = FMIndex(symbols[1:])
    seen = np.zeros(_PAIRS, dtype=bool)
    seen[_pair(symbols[1:-1], symbols[2:])] = True
    own = np.zeros(len(sent.words) + 1, dtype=np.int32)
    own[here] = np.arange(len(here))
    for block in sent.blocks:
        flat = own[block.numbers]
        lacking = np.concatenate([[0], np.cumsum(flat == 0)])
        apart = np.concatenate([[0], np.cumsum(~seen[_pair(flat[:-1], flat[1:])])])
        able = (lacking[block.start + block.sizes] == lacking[block.start]) & (apart[block.start + block.sizes - 1] == apart[block.start])
        able = np.flatnonzero(able)
        lo, hi = index.search(flat, block.start[able], block.sizes[able])
        n = np.maximum(hi - lo, 0)
        if n.any():
            some = np.repeat(np.arange(len(n)), n)
            rows = np.arange(len(some)) - np.repeat(np.cumsum(n) - n, n) + lo[some]
            phrase = able[some]
            yield block, number[index.locate(rows)], block.sizes[phrase].astype(np.int64), phrase


def search_texts(texts: pa.Array, sent: Pass) -> Iterator[tuple[int, list[list[int]], list[list[int]], list[int]]]:
    """For each text (number of words, merged spans of words, the same in bytes of UTF-8, item ids)."""
    for i, j in pieces(texts):
        w = words_of(texts.slice(i, j - i), LETTERS, lower=True)
        counts = np.diff(w.first).tolist()
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        text_of = lambda k, w=w: np.searchsorted(w.first, k, "right") - 1
        depth = np.zeros(len(w.start) + 1, dtype=np.int64)
        for block, start, size, phrase in find(w, sent):
            np.add.at(depth, start, 1)
            np.add.at(depth, start + size, -1)
            for t, p in set(zip(text_of(start).tolist(), phrase.tolist(), strict=True)):
                items.setdefault(t, set()).update(block.items[block.first[p] : block.first[p + 1]].tolist())
        if items:
            inside = np.concatenate([[0], np.cumsum(depth)[:-1] > 0, [0]]).astype(np.int8)
            edge = np.zeros(len(w.start) + 1, dtype=bool)
            edge[w.first] = True
            a = np.flatnonzero((inside[1:] == 1) & ((inside[:-1] == 0) | edge[: len(inside) - 1]))
            b = np.flatnonzero((inside[:-1] == 1) & ((inside[1:] == 0) | edge[: len(inside) - 1]))
            for t, x, y in zip(text_of(a).tolist(), a.tolist(), b.tolist(), strict=True):
                spans.setdefault(t, []).append((x, y))
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts.slice(i, j - i)), 0))
        offset = np.cumsum(sizes) - sizes
        for t, n in enumerate(counts):
            own = spans.get(t, [])
            f = int(w.first[t])
            o = int(offset[t])
            yield n, [[x - f, y - f] for x, y in own], [[int(w.start[x]) - o, int(w.end[y - 1]) - o] for x, y in own], sorted(items.get(t, ()))


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, width: int = WIDTH) -> Iterator[Phrases]:
    """The items in blocks of about block_bytes of text, whose sizes are counted first. Items with a null
    id or text are left out; repeated ones count once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct()
    total = items.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield phrases_of([(r.item_id, r.text) for r in part.collect()], width)


def passes(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, width: int = WIDTH) -> Iterator[Pass]:
    """Blocks of the benchmark, so many at a time as one pass over documents searches for; a pass is made when it is asked for."""
    held = []
    for phrases in blocks_of(benchmark, block_bytes, width):
        held.append(phrases)
        if len(held) == PASS_BLOCKS:
            yield Pass(held)
            held = []
    if held:
        yield Pass(held)


_SPAN = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "past", "start", "end")]))
_HITS = "spans array<struct<first:long,past:long,start:long,end:long>>, items array<long>"


def _found(texts: pa.Array, sent) -> tuple[list[int], list[list], list[list]]:
    """For each text its number of words, merged spans (first word, past the last, first byte, past the last) and items."""
    n, of_words, of_bytes, items = zip(*search_texts(texts, sent.value), strict=True) if len(texts) else ([],) * 4
    return list(n), [[(*x, *y) for x, y in zip(a, b, strict=True)] for a, b in zip(of_words, of_bytes, strict=True)], list(items)


def _as_rows(spans: list[list]) -> pa.Array:
    return pa.array([[dict(zip(("first", "past", "start", "end"), x, strict=True)) for x in s] for s in spans], type=_SPAN)


def _hits(docs: DataFrame, every: Iterator[Pass]) -> DataFrame:
    """digest (of the text), spans, items of all passes, for texts that are hit: equal texts have equal hits.

    A pass writes its hits alone, and its blocks leave the executors before the next one's come.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").withColumn("digest", F.sha2("text", 256))
    hits = None
    for sent in every:
        at_all = docs.sparkSession.sparkContext.broadcast(sent)

        def search(batches, sent=at_all):
            for batch in batches:
                _, spans, items = _found(batch.column("text"), sent)
                some = [k for k, s in enumerate(spans) if s]
                digests = batch.column("digest").take(pa.array(some, type=pa.int64()))
                yield pa.RecordBatch.from_arrays([digests, _as_rows([spans[k] for k in some]), pa.array([items[k] for k in some], type=pa.list_(pa.int64()))], ["digest", "spans", "items"])

        part = settle(texts.mapInArrow(search, f"digest string, {_HITS}"), "pass")
        at_all.destroy()
        hits = part if hits is None else hits.union(part)
    return settle(hits.groupBy("digest").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")), "hits")


def _with_hits(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """docs (text and others) with spans and items, null where nothing is hit."""
    few = hits.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    return docs.withColumn("digest", F.sha2("text", 256)).join(F.broadcast(hits) if few else hits, "digest", "left").drop("digest")


def _first_passes(benchmark: DataFrame, block_bytes: int, width: int) -> tuple[Pass | None, Iterator[Pass]]:
    """(the only pass, all) or (None, all) where there are several, of which no two are held at a time."""
    every = passes(benchmark, block_bytes, width)
    first = next(every)
    second = next(every, None)

    def all_passes():
        yield first
        if second is not None:
            yield second
        yield from every

    return (first if second is None else None), all_passes()


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, spans (struct first, past: hit words, merged) and items (ids whose windows occur), for each row.

    A null text has no words. Repeated rows are searched one by one.
    """
    texts = texts_of(docs)
    only, every = _first_passes(benchmark, block_bytes, width)
    span = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))

    def answer(batch, counts, spans, items):
        words = pa.array([[{"first": s[0], "past": s[1]} for s in one] for one in spans], type=span)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, type=pa.int64()), words, pa.array(items, type=pa.list_(pa.int64()))], ["doc_id", "n_words", "spans", "items"])

    schema = "doc_id long, n_words long, spans array<struct<first:long,past:long>>, items array<long>"
    if only is not None:
        sent = docs.sparkSession.sparkContext.broadcast(only)

        def run(batches):
            for batch in batches:
                yield answer(batch, *_found(batch.column("text"), sent))

        return texts.mapInArrow(run, schema)

    def merge(batches):
        for batch in batches:
            spans = [joined([tuple(x.values()) for x in s or ()]) for s in batch.column("spans").to_pylist()]
            counts = [n for i, j in pieces(batch.column("text")) for n in np.diff(words_of(batch.column("text").slice(i, j - i), LETTERS, lower=True).first).tolist()]
            yield answer(batch, counts, spans, [sorted(i or ()) for i in batch.column("items").to_pylist()])

    return _with_hits(texts, _hits(texts, every)).mapInArrow(merge, schema)


def joined(spans: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """(first word, past the last, start, end) in order, those that overlap or meet in words joined."""
    out: list[list[int]] = []
    for first, past, start, end in sorted(spans):
        if not out or out[-1][1] < first:
            out.append([first, past, start, end])
        elif past > out[-1][1]:
            out[-1][1], out[-1][3] = past, end
    return out


def _cut(texts: list, spans: list[list]) -> list:
    """Texts without the bytes of their spans."""
    out = []
    for t, s in zip(texts, spans, strict=True):
        if s:
            raw, parts, at = t.encode(), [], 0
            for _, _, a, b in s:
                parts.append(raw[at:a])
                at = b
            t = b"".join([*parts, raw[at:]]).decode()
        out.append(t)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with every hit span cut out of text (from its first word to the end of its last); n_chars follows.

    All rows and columns stay; a text in which nothing is hit, and a null one, is as before.
    All blocks of the benchmark are searched for in the uncut text, and their spans are cut at once.
    """
    small_batches(docs.sparkSession)
    only, every = _first_passes(benchmark, block_bytes, width)
    if only is not None:
        sent = docs.sparkSession.sparkContext.broadcast(only)

        def run(batches):
            for batch in batches:
                column = batch.column("text")
                _, spans, _ = _found(column, sent)
                at = batch.schema.get_field_index("text")
                yield batch.set_column(at, "text", pa.array(_cut(column.to_pylist(), spans), type=column.type))

        out = docs.mapInArrow(run, docs.schema)
    else:
        # names of docs may clash with those here: its other columns travel in a struct
        rest = [c for c in docs.columns if c != "text"]
        row = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), "text")
        both = _with_hits(row, _hits(docs, every)).select("row", "text", "spans")

        def cut(batches):
            for batch in batches:
                spans = [joined([tuple(x.values()) for x in s or ()]) for s in batch.column("spans").to_pylist()]
                column = batch.column("text")
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(_cut(column.to_pylist(), spans), type=column.type)], ["row", "text"])

        whole = both.mapInArrow(cut, both.select("row", "text").schema)
        out = whole.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """`contamination` of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a null text has no words."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["past"] - s["first"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _sql_words(column: str) -> str:
    low = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_sql_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_sql_words("text")} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
o AS (
  SELECT rid, i, n, item_id
  FROM (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
        FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n))
  JOIN p USING (n, s)),
h AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM o) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT rid, item_id FROM o) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
