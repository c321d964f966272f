"""N-gram Jaccard join: documents whose sets of word shingles are similar, and their groups.

1. `signatures` counts for each document how many of its shingles come up in another
   document (see `exchange`). Fewer than the threshold asks for: it has no partner.
2. Equal sets become one class. Of two similar sets the larger has one of its rarest shingles
   (a prefix as long as `percent` leaves) among those of a shorter prefix of the smaller,
   whose partner must have more in common with it; and their sizes lie in one range or in
   two beside each other. Classes that this connects form loose groups. So sets that share
   a template, but not enough of it, and have shingles of their own, meet nowhere.
3. Groups are cut into blocks of bounded size; in a block a T-occurrence search with
   DivideSkip finds partners: the short postings of rare shingles are heap-merged, the long
   ones only probed, the shorter first, for what can still reach the needed overlap. A
   document that is connected to all it could find is not searched for again. Shingles that
   all sets of a block have count for every pair alike and are not searched.
4. A group of several blocks shares some members among all of them; what is then still
   apart from the group's main part is searched for in every block where a rare shingle and
   the sizes, as in 2, say that a partner can be.

No pair is listed for a group of copies; the work follows the number of documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathline.llm import exchange
from pathline.llm.batches import BROADCAST_IDS, settle, with_ids
from pathline.llm.components import components
from pathline.llm.words import hashes, mix, pieces, windows, words_of

WIDTH, PERCENT = 5, 80
#: A block has at most about so many sets and shingles; the work in it is sets x shingles at worst.
BLOCK_SETS, BLOCK_SHINGLES = 256, 500_000
#: Members that all blocks of a group have.
SHARED = 4


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles (letters A-Z in lower case)."""
    for i, j in pieces(texts):
        w = words_of(texts.slice(i, j - i), lower=True)
        h = hashes(w)
        grams = windows(h, width)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            else:  # fewer words: all of them as one; the seed keeps lengths apart
                yield windows(h[a:b], b - a, seed=b - a) if b > a else np.zeros(0, dtype=np.uint64)


def _keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others, whatever its order."""
    return int(np.sum(s, dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(1)), initial=np.uint64(0)))


def signatures(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n (size of the set), key1 and key2 (equal for equal sets), shared (shingles that more than
    one document has; a hash of 32 bits within a bucket can count a few too many, never too few).

    A row for each row of texts, which `exchange.stable_texts` gives. A null text has n = 0; a null doc_id is
    passed on and shares with nothing.
    """
    n_buckets = exchange.buckets_for(texts)

    def deal(batches):
        for chunk, batch in exchange.chunks(batches):
            ids = batch.column("doc_id")
            valid = np.asarray(ids.is_valid())
            sets = list(shingle_sets(batch.column("text"), width))
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            keys = np.array([_keys(s) for s in sets], dtype=np.uint64).reshape(-1, 2)
            head = np.stack([np.asarray(ids.fill_null(0)), sizes, keys[:, 0].view(np.int64), keys[:, 1].view(np.int64), valid.astype(np.int64)])
            sent = [s if v else s[:0] for s, v in zip(sets, valid.tolist(), strict=True)]
            h = np.concatenate(sent)
            doc = np.repeat(np.arange(len(sent)), [len(s) for s in sent])
            del sets, sent
            order, bounds = exchange.deal(h, n_buckets)
            h, doc = exchange.short(h)[order], doc[order]
            full = np.flatnonzero(np.diff(bounds)).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([exchange.own_bucket(chunk), *full], type=pa.int64()),
                    pa.array([chunk] * (len(full) + 1), type=pa.int64()),
                    pa.array([head.tobytes(), *(exchange.pack_places(doc[bounds[b] : bounds[b + 1]]) for b in full)], type=pa.binary()),
                    pa.array([b"", *(h[bounds[b] : bounds[b + 1]].tobytes() for b in full)], type=pa.binary()),
                ],
                schema=exchange.ROWS,
            )

    def answer(chunks, heads, bodies):
        h = np.concatenate([np.frombuffer(b, dtype=np.uint32) for b in bodies])
        more, at, out = exchange.repeated(h), 0, []
        for chunk, head, body in zip(chunks, heads, bodies, strict=True):
            n = len(body) // 4
            if (mine := more[at : at + n]).any():
                doc, count = np.unique(exchange.unpack_places(head)[mine], return_counts=True)
                out.append((chunk, doc.astype(np.uint32).tobytes(), count.astype(np.uint32).tobytes()))
            at += n
        return out

    def gather(key, table):
        heads, bodies = table.column("head").to_pylist(), table.column("body").to_pylist()
        info = np.frombuffer(next(h for h, b in zip(heads, bodies, strict=True) if not b), dtype=np.int64).reshape(5, -1)
        shared = np.zeros(info.shape[1], dtype=np.int64)
        for h, b in zip(heads, bodies, strict=True):
            if b:
                np.add.at(shared, np.frombuffer(h, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32))
        ids = pa.array(info[0], mask=info[4] == 0)
        return pa.table({"doc_id": ids, "n": info[1], "key1": info[2], "key2": info[3], "shared": shared})

    back = exchange.by_bucket(texts.mapInArrow(deal, exchange.SCHEMA), answer)
    return back.groupBy("chunk").applyInArrow(gather, "doc_id long, n long, key1 long, key2 long, shared long")


def _common(n, m, percent: int):
    """Shingles that similar sets of n and m have in common at least."""
    return -(-percent * (n + m) // (100 + percent))


def _counted(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Heap merge of sorted postings: the numbers that come up, and in how many of the lists each does."""
    counts = [(d, sum(1 for _ in run)) for d, run in groupby(heapq.merge(*lists))]
    return np.array(counts, dtype=np.int64).reshape(-1, 2).T


def _divide(length: np.ndarray, need: int) -> int:
    """How many of the longest postings are left for probes (fewer than `need`, so that whatever has the needed
    overlap still comes up among the others). Long lists cost a merge their length, a probe only its logarithm."""
    return min(need - 1, int(need / (0.01 * math.log2(max(2, int(length.max()))) + 1)))


#: Long postings that are probed before candidates are thinned out again.
_STRIDE = 16


def t_occurrence(sets: list[np.ndarray], asked: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs (numbers of sets) that connect what is similar, for every set of `asked` against all.

    Each asked set's partners end up connected with it; a pair within what is already
    connected is not looked at.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    distinct, first = np.unique(values, return_index=True)
    last = np.append(first[1:], len(values))
    everywhere = int(np.count_nonzero(last - first == m))  # these separate nothing
    del values, order
    group, links = np.arange(m), []
    for q in asked:
        n = int(sizes[q])
        if not n:
            continue
        fit = (100 * sizes >= percent * n) & (percent * sizes <= 100 * n) & (group != group[q])
        if not fit.any():
            continue
        lists = np.searchsorted(distinct, sets[q])
        length = last[lists] - first[lists]
        some = (length > 1) & (length < m)
        lists, length = lists[some], length[some]
        need = int(_common(n, sizes[fit].min(), percent)) - everywhere
        if len(lists) < need:
            continue
        lists = lists[np.argsort(length, kind="stable")]
        n_long = _divide(length, need) if need > 0 else len(lists)
        rare, long = lists[: len(lists) - n_long].tolist(), lists[len(lists) - n_long :].tolist()
        if need > 0:
            found, count = _counted([owner[first[k] : last[k]].tolist() for k in rare])
        else:
            found, count = np.flatnonzero(fit), np.zeros(np.count_nonzero(fit), dtype=np.int64)
        # the overlap that a pair of these sizes must have, beside what all have
        least = _common(n, sizes[found], percent) - everywhere
        left = n_long
        able = fit[found] & (count + left >= least)
        found, count, least = found[able], count[able], least[able]
        for i in range(0, n_long, _STRIDE):
            if not len(found):
                break
            for k in long[i : i + _STRIDE]:
                posting = owner[first[k] : last[k]]
                at = np.searchsorted(posting, found)
                at[at == len(posting)] = 0
                count += posting[at] == found
            left = max(0, n_long - i - _STRIDE)
            able = count + left >= least
            found, count, least = found[able], count[able], least[able]
        for d in found[count >= least].tolist():
            if group[d] != group[q]:
                links.append((q, d))
                group[group == group[d]] = group[q]
    return links


def _search(percent: int):
    def run(key, table):
        ids, asked = table.column("node").to_numpy(), table.column("asked").to_numpy(zero_copy_only=False)
        tokens = table.column("tokens").combine_chunks()
        offsets, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy().view(np.uint64)
        _, one = np.unique(ids, return_index=True)  # repeated rows
        sets = [flat[offsets[k] : offsets[k + 1]] for k in one.tolist()]
        who = set(ids[asked].tolist())
        ids = ids[one]
        links = t_occurrence(sets, [k for k, i in enumerate(ids.tolist()) if i in who], percent)
        a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": ids[a], "b": ids[b]})

    return run


def _class_sets(texts: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """class_id, n, tokens: the sets of classes, read again from the text of their smallest document (`least`)."""
    few = classes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    keyed = classes.select(F.col("least").alias("doc_id"), "key1", "key2", "class_id")
    both = texts.join(F.broadcast(keyed) if few else keyed, "doc_id")

    def run(batches):
        for batch in batches:
            ids, k1, k2 = (batch.column(c).to_pylist() for c in ("class_id", "key1", "key2"))
            rows = []
            for i, a, b, s in zip(ids, k1, k2, shingle_sets(batch.column("text"), width), strict=True):
                if (a % (1 << 64), b % (1 << 64)) == _keys(s):  # else another text with the same id
                    rows.append((i, len(s), s.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["class_id", "n", "tokens"])

    return both.mapInArrow(run, "class_id long, n long, tokens array<long>")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """class_id, band, token, indexed: of each set the rarest shingles, so many that a similar set has one of them
    in its own. If that set is no smaller, it has one of the `indexed`: fewer, as more must be common then.

    band is a range of sizes; those of similar sets are the same or side by side.
    """
    rows = sets.select("class_id", "n", F.explode("tokens").alias("token"))
    held = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    need, more = F.ceil(F.col("n") * percent / 100), F.ceil(F.col("n") * 2 * percent / (100 + percent))
    band = F.floor(F.log("n") / (math.log(100 / percent) + 1e-9)).alias("band")
    ranked = rows.join(held, "token").groupBy("class_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    # shingles of one set alone come before all others; so `t` is the end of a set in order of rarity
    some = ranked.filter(F.size("t") >= need).withColumns({"first": F.size("t") - need + 1, "short": F.size("t") - more + 1})
    each = some.select("class_id", band, "short", F.posexplode(F.slice("t", F.lit(1), F.col("first").cast("int"))).alias("at", "x"))
    return each.select("class_id", "band", F.col("x.token").alias("token"), (F.col("at") < F.col("short")).alias("indexed"))


def _loose(prefix: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that connect whatever a prefix of the larger and the indexed one of the smaller share."""
    least = prefix.filter("indexed").groupBy("token", "band").agg(F.min("class_id").alias("b"))
    near = least.select("token", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), "b")
    return prefix.join(near, ["token", "band"]).filter("class_id <> b").select(F.col("class_id").alias("a"), "b").distinct()


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes (a, b) that connect all that similar sets connect."""
    prefix = settle(_prefixes(sets, percent), "prefixes")
    group = components(_loose(prefix), "loose")
    sized = group.join(sets.select(F.col("class_id").alias("node"), "n").distinct(), "node")
    total = sized.groupBy("component").agg(
        F.count(F.lit(1)).alias("sets"),
        F.sum("n").alias("shingles"),
        F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(SHARED)])).alias("shared"),
    )
    parts = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    total = settle(total.select("component", "shared", parts.alias("parts")), "groups")
    own = group.join(total, "component").select("component", "node", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    own = settle(own, "blocks")
    large = total.filter("parts > 1")
    everywhere = large.select("component", F.explode("shared").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = _searched(own.select("component", "node", "part").union(everywhere).withColumns({"run": F.lit(0), "asked": F.lit(True)}), sets, percent)
    if large.isEmpty():
        return found
    found = settle(found, "links")
    label = components(found, "near").select("node", F.col("component").alias("label"))
    mine = own.filter("parts > 1").join(label, "node", "left").select("component", "node", "part", F.coalesce("label", "node").alias("label"))
    mine = settle(mine, "labelled")
    counts = mine.groupBy("component", "label").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("component").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    apart = mine.join(main, "component").filter("label <> main").select("component", "node", "label")
    tokens = prefix.withColumnRenamed("class_id", "node")
    # a row for each token: the blocks that it leads to, with the least and largest label there (lo, hi; of indexed
    # sets first, last) by band; so no pair of sets is a row
    label, held = F.col("label"), F.when(F.col("indexed"), F.col("label"))
    ends = [F.min(label).alias("lo"), F.max(label).alias("hi"), F.min(held).alias("first"), F.max(held).alias("last")]
    blocks = tokens.join(mine, "node").groupBy("token", "component", "part", "band").agg(*ends)
    there = blocks.groupBy("token", "component").agg(F.collect_list(F.struct("part", F.col("band").alias("at"), "lo", "hi", "first", "last")).alias("parts"), F.count("first").alias("c"))

    def other(p):
        smaller = p["at"].isin(F.col("band"), F.col("band") - 1) & ((p["first"] != label) | (p["last"] != label))
        larger = F.col("indexed") & p["at"].isin(F.col("band"), F.col("band") + 1) & ((p["lo"] != label) | (p["hi"] != label))
        return F.coalesce(smaller, F.lit(False)) | larger

    lead = F.transform(F.filter("parts", other), lambda p: p["part"]).alias("parts")
    asked = tokens.join(apart, "node").join(there.filter("c > 0"), ["token", "component"]).select("component", "node", lead).filter("size(parts) > 0")
    asked = asked.groupBy("component", "node").agg(F.array_distinct(F.flatten(F.collect_set("parts"))).alias("parts")).select("component", "node", F.explode("parts").alias("part"))
    # so many may be asked of one block that they are dealt into runs, each beside the block's own members
    asked = settle(asked, "asked")
    runs = asked.groupBy("component", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("runs"))
    dealt = asked.join(runs, ["component", "part"]).select("component", "node", "part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("runs")).cast("int").alias("run"))
    there = mine.select("component", "node", "part").join(runs, ["component", "part"]).select("component", "node", "part", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"))
    return found.union(_searched(there.withColumn("asked", F.lit(False)).unionByName(dealt.withColumn("asked", F.lit(True))), sets, percent))


def _searched(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    rows = blocks.join(sets.select(F.col("class_id").alias("node"), "tokens"), "node")
    return rows.groupBy("component", "part", "run").applyInArrow(_search(percent), "a long, b long")


def similar_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, stable: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    Two documents are linked when 100 * common shingles >= percent * shingles of both;
    component_id is the smallest doc_id that links reach. A document without words (or
    with null text) is alone, and so is one with a null doc_id, whose component is null.
    Rows that repeat a doc_id count as documents with one number: each gets its own
    n_shingles, and what is linked to one of them is linked to all. stable: docs is read from
    files as it is; else its texts are written to the shared folder first.
    """
    texts = exchange.stable_texts(docs, stable)
    signed = settle(signatures(texts, width), "signatures")
    keys = ["key1", "key2", "n"]
    able = signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull() & (100 * F.col("shared") >= percent * F.col("n")))
    # classes are told apart by a number of their own: two can have the same smallest document
    classes = able.groupBy(*keys).agg(F.min("doc_id").alias("least"))
    classes = settle(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    sets = settle(_class_sets(texts, classes, width), "sets")
    links = _links(sets, percent)
    each = F.struct(*keys)
    unlike = signed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(each).alias("lo"), F.max(each).alias("hi")).filter("lo <> hi")
    unlike = settle(unlike.select("doc_id"), "unlike")
    some = not unlike.isEmpty()
    if some:
        held = with_ids(able, unlike).join(classes, keys).select("doc_id", "class_id").distinct()
        first = held.groupBy("doc_id").agg(F.min("class_id").alias("b"))
        links = links.union(held.join(first, "doc_id").filter("class_id <> b").select(F.col("class_id").alias("a"), "b"))
    label = components(links, "similar")
    named = classes.join(label, classes.class_id == label.node, "left").withColumn("component", F.coalesce("component", "class_id"))
    named = settle(named.select(*keys, "least", "component"), "named")
    group = named.groupBy("component").agg(F.min("least").alias("group"))
    out = signed.join(named.join(group, "component").select(*keys, "group"), keys, "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.least("group", "doc_id").alias("component_id"))
    if not some:
        return out
    # a row that is like no other goes with the other rows of its doc_id
    least = settle(with_ids(out, unlike).groupBy("doc_id").agg(F.min("component_id").alias("m")), "unlike-groups")
    few = least.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    out = out.join(F.broadcast(least) if few else least, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.least("m", "component_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, stable: bool = False) -> DataFrame:
    """docs without those that a document with a smaller doc_id is connected to; one row of each doc_id stays.

    Rows with a null doc_id all stay. stable: see `similar_groups`.
    """
    groups = similar_groups(docs, width, percent, stable)
    count = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.min("component_id").alias("m"))
    count = settle(count.filter("c > 1 OR m < doc_id"), "left-out")
    again = count.filter("m = doc_id").select("doc_id")
    # names of docs may clash with those above: its columns travel in a struct
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    kept = with_ids(rows, count, how="left_anti").select("row.*")
    if again.isEmpty():
        return kept
    twice = with_ids(rows, again).groupBy("doc_id").agg(F.min("row").alias("row")).select("row.*")
    return kept.unionByName(twice)


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """`similar_groups` of documents: doc_id, n_shingles, component_id; null and empty texts are alone."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), stable=True)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT DISTINCT rid, doc_id, hash(array_to_string(w[i : i + 4], ' '), least(len(w), 5)) AS s
  FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT rid, doc_id, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT a.rid AS ra, b.rid AS rb, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
e AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM c JOIN n x ON x.rid = ra JOIN n y ON y.rid = rb
  WHERE 100 * c >= 80 * (x.n + y.n - c) AND x.doc_id <> y.doc_id),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM w WHERE doc_id IN (SELECT a FROM b) UNION SELECT r.node, b.b FROM r JOIN b ON b.a = r.seen),
m AS (SELECT node, min(seen) AS m FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.m, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (rid) LEFT JOIN m ON m.node = w.doc_id
"""
