"""SimHash near-dedup with a byte-position inverted index and count filtering.

1. A document's fingerprint is 64 bits: the majority of the hashes of its shingles. Equal
   fingerprints become one row before anything is indexed.
2. A fingerprint has 8 positional bytes. Two that differ in at most 4 bits differ in at most 4
   bytes, so they share at least 4 of 8. The index's postings are keyed by positional bytes: by
   the first two that a pair shares, as a list for a single one holds a 256th of a corpus; a
   list that is still long is cut by the next byte that a pair shares, up to the fourth. As the
   rest must be found among the later bytes, only the first 6 (7, 8) positions can be second
   (third, fourth): 15 lists for a fingerprint, and 35 and 70 where lists are long.
3. Within a list a pair's shared positional bytes are tallied; those with the guaranteed four
   that have not met in an earlier list are verified by their bits. Only links that connect
   something new leave a list, never all pairs of it.
4. A list of four bytes that is still long holds one dense cloud of fingerprints. Its members
   are linked over midpoints: two that differ in at most 4 bits both reach some value within 2
   bits of each, so every member is dealt to the values within 2 bits, and those that meet are
   one. That is linear in the members, and exact; no list is sampled or cut off.
5. Components of the links give every document the smallest doc_id that it can reach.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathline.llm.batches import BROADCAST_IDS, settle, small_batches, with_ids
from pathline.llm.components import components

WIDTH, BITS, SEED = 4, 4, 42
BYTES = 8
#: Positional bytes that a pair within BITS shares at least, and by how many a list is keyed at first.
SHARED, FIRST = BYTES - BITS, 2
#: Fingerprints of a list that one task compares.
LIST = 1 << 14
#: Shingles that are hashed at once.
_SHINGLES = 1 << 16
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def fingerprint(raw: bytes, width: int = WIDTH) -> int:
    """Majority of the bits of XXH64 (seed 42) over all shingles of a text's words, letters A-Z in lower case; 0 without words."""
    joined = _SPACES.sub(b" ", raw).strip(b" ").lower()
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    start, end = np.append(0, spaces + 1), np.append(spaces, len(joined))
    n = max(1, len(start) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    last = min(width, len(start)) - 1
    for i in range(0, n, _SHINGLES):
        spans = zip(start[i : min(i + _SHINGLES, n)].tolist(), end[i + last : min(i + _SHINGLES, n) + last].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) for each row of docs; a null text has no words."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(r or b"", width) for r in batch.column("raw").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    return texts.mapInArrow(run, "doc_id long, fp long")


def _byte(p: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(0xFF))


def _lists(fps: DataFrame, k: int) -> DataFrame:
    """fp, at (the positions of a list's k bytes) and key (the bytes): lists of every fingerprint for the first k bytes that
    a pair shares. `fps` may have lists already, which are cut by one byte more."""
    end = BYTES - SHARED + k  # positions below it can be the k-th
    if "at" not in fps.columns:
        of = lambda c: F.struct(F.array(*map(F.lit, c)).alias("at"), sum((_byte(p) * F.lit(256**i) for i, p in enumerate(c)), F.lit(0).cast("long")).alias("key"))
        return fps.select("fp", F.explode(F.array(*[of(c) for c in combinations(range(end), k)])).alias("l")).select("fp", "l.at", "l.key")
    last = F.element_at("at", -1)
    longer = F.array(*[F.struct(F.concat("at", F.array(F.lit(p))).alias("at"), (F.col("key") + _byte(p) * F.lit(256 ** (k - 1))).alias("key")) for p in range(k - 1, end)])
    rows = fps.select("fp", F.explode(F.filter(longer, lambda x: F.element_at(x["at"], -1) > last)).alias("l"))
    return rows.select("fp", "l.at", "l.key")


_EQUAL = np.uint64(0x0101010101010101)


def tally(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For each pair a byte whose bit p says that the positional bytes p are equal."""
    x = one ^ two
    for s in (4, 2, 1):
        x |= x >> np.uint64(s)
    same = ~x & _EQUAL
    return ((same * np.uint64(0x0102040810204080)) >> np.uint64(56)).astype(np.uint8)


def _first_shared(masks: np.ndarray, k: int) -> np.ndarray:
    """The k lowest bits of each byte."""
    out, left = np.zeros_like(masks), masks.copy()
    for _ in range(k):
        low = left & (~left + np.uint8(1))
        out |= low
        left ^= low
    return out


def connect(fps: np.ndarray, group: np.ndarray, at: np.ndarray, k: int, bits: int = BITS) -> np.ndarray:
    """Pairs of places (n x 2) that connect what is similar within each group (sorted); at: bits of the group's positions.

    A pair is looked at in the list of the first k positions that it shares alone, if it shares enough of them, and
    if it is not connected yet.
    """
    n = len(fps)
    _, first, size = np.unique(group, return_index=True, return_counts=True)
    left = np.repeat(first + size, size) - np.arange(n)  # places to the end of the group
    parent, links, live = np.arange(n), [], np.arange(n)
    for d in range(1, int(size.max(initial=1))):
        live = live[left[live] > d]
        i = live[parent[live] != parent[live + d]]
        masks = tally(fps[i], fps[i + d])
        ok = np.bitwise_count(masks) >= SHARED
        i, masks = i[ok], masks[ok]
        i = i[(_first_shared(masks, k) == at[i]) & (np.bitwise_count(fps[i] ^ fps[i + d]) <= bits)]
        for a, b in zip(i.tolist(), (i + d).tolist(), strict=True):
            x, y = a, b
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((a, b))
        if len(i):
            while (parent != parent[parent]).any():
                parent = parent[parent]
    return np.array(links, dtype=np.int64).reshape(-1, 2)


def _compared(lists: DataFrame, k: int, bits: int) -> DataFrame:
    """Links (a, b) of fingerprints within lists of k bytes; a task reads sorted lists, whole ones at a time."""

    def run(batches):
        held = None

        def links(part):
            fp, at, key = part
            group = np.concatenate([[0], np.cumsum((np.diff(at) != 0) | (np.diff(key) != 0))])
            pairs = connect(fp.view(np.uint64), group, at.astype(np.uint8), k, bits)
            return pa.RecordBatch.from_arrays([pa.array(fp[pairs[:, 0]]), pa.array(fp[pairs[:, 1]])], ["a", "b"])

        for batch in batches:
            part = [batch.column(c).to_numpy() for c in ("fp", "at", "key")]
            part = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            if not len(part[0]):
                continue
            # the last list may go on in the next batch
            new = np.flatnonzero((np.diff(part[1]) != 0) | (np.diff(part[2]) != 0))
            cut = int(new[-1]) + 1 if len(new) else 0
            held = [x[cut:] for x in part]
            if cut:
                yield links([x[:cut] for x in part])
        if held is not None:
            yield links(held)

    mask = F.expr("aggregate(at, 0, (bits, p) -> bits | shiftleft(1, p))")
    rows = lists.select("fp", mask.alias("at"), "key")
    return rows.repartition("at", "key").sortWithinPartitions("at", "key", "fp").mapInArrow(run, "a long, b long")


def _midpoints(dense: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that connect all of `dense` (fp) that are within `bits` of each other: each is dealt to the values within
    half as many bits, where it meets the smallest."""
    half = -(-bits // 2)
    flips = [sum(1 << p for p in c) for j in range(half + 1) for c in combinations(range(64), j)]
    flips = [f - (1 << 64) if f >> 63 else f for f in flips]
    near = dense.select("fp", F.explode(F.lit(flips)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    least = near.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("m")).filter("a < m")
    met = near.join(settle(least.select("value", "a"), "midpoints"), "value").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return met if 2 * half == bits else met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)


def similar(fps: DataFrame, bits: int = BITS, most: int = LIST) -> DataFrame:
    """Links (a, b) that connect all fingerprints (fp, distinct) that links of at most `bits` (4) differing bits connect.

    most: fingerprints of a list that are compared at once; longer lists are cut by a further byte.
    """
    if bits != BITS:
        raise ValueError("the index is laid out for 4 bits")
    found, lists = [], None
    rows = fps.select("fp")
    for k in range(FIRST, SHARED + 1):
        lists = settle(_lists(rows, k), "lists")
        long = settle(lists.groupBy("at", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("at", "key"), "long")
        n = long.limit(BROADCAST_IDS + 1).count()
        side = F.broadcast(long) if n <= BROADCAST_IDS else long
        found.append(settle(_compared(lists.join(side, ["at", "key"], "left_anti") if n else lists, k, bits), "links"))
        if not n:
            break
        rows = lists.join(side, ["at", "key"], "left_semi").select("fp", "at", "key")
    else:
        found.append(settle(_midpoints(rows.select("fp").distinct(), bits), "links"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def near_groups(docs: DataFrame, width: int = WIDTH, bits: int = BITS, most: int = LIST) -> DataFrame:
    """doc_id, fp, component_id for each row of docs: the smallest doc_id that links reach, itself included.

    Documents whose fingerprints differ in at most `bits` bits are linked, those without words (or with null text) too,
    whose fingerprint is zero. A row with a null doc_id has its fingerprint, links with nothing and has a null component.
    Rows that repeat a doc_id count as documents with one number: what is linked to one of them is linked to all.
    """
    rows = settle(fingerprints(docs, width), "fingerprints")
    known = rows.filter("doc_id IS NOT NULL")
    classes = settle(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = similar(classes, bits, most)
    unlike = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi")
    unlike = settle(unlike.select("doc_id", F.col("lo").alias("b")), "unlike")
    if not unlike.isEmpty():
        few = unlike.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        again = with_ids(known, unlike).join(F.broadcast(unlike) if few else unlike, "doc_id").filter("fp <> b")
        links = links.union(again.select(F.col("fp").alias("a"), "b").distinct())
    label = components(links, "near")
    named = settle(classes.join(label, classes.fp == label.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "named")
    group = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = settle(named.join(group, "component").select("fp", "component_id"), "groups")
    few = of.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    out = rows.join(F.broadcast(of) if few else of, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op12_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """`near_groups` of documents: doc_id, fingerprint (16 hexadecimal digits), component_id; texts without words are linked by fingerprint zero."""
    out = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
