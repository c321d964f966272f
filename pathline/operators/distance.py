"""Distances between two sets of vectors, a block of each at a time.

Both sides are cut into blocks of a known number of rows; a task multiplies one block by
another, tile by tile. What follows (all pairs, nearest k, sums for losses) is done on the
tile's matrix, so that no more than is asked for leaves the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathline.sources.shared import settle

ROWS = 2048  # of a side of a block at least
TILE = 512  # of a side of a tile, whose matrices stay near a core
BLOCK_BYTES = 32 << 20  # of the vectors of a side of a block
PAIRS, PAIR_ROWS = 1 << 23, 8192  # of a tile whose pairs are written, and of its right side
TOGETHER = 4  # tiles at most whose pairs leave in one order
SAMPLE = 1024  # rows of a side whose distances show where to cut ranges of them
BATCH = 1 << 16  # pairs of a batch that leaves a task
METRICS = ("sqeuclidean", "euclidean", "cosine", "cosine2", "jaccard")


def matrix(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """D1 squared Euclidean, D2 Euclidean (at least 1e-6), D3 1 - cos, D4 2 - 2 cos."""
    if metric in ("cosine", "cosine2"):
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (a, b))
        d = a @ b.T
        np.subtract(1, d, out=d)
        return d if metric == "cosine" else np.multiply(2, d, out=d)
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None]
    inner = a @ b.T
    d -= np.multiply(2, inner, out=inner)
    return d if metric == "sqeuclidean" else np.sqrt(np.maximum(d, 1e-12, out=d), out=d)


def vectors_of(table: pa.Table) -> np.ndarray:
    column = table.column("embedding").combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64, copy=False) if n else np.zeros((0, 1))


def _block_rows(n_left: int, n_right: int, size: int, tasks: int, rows: int) -> int:
    """As many rows as leave four blocks for each task, within a tile and BLOCK_BYTES."""
    return max(rows, min(math.isqrt(n_left * n_right // (4 * tasks)), BLOCK_BYTES // (8 * max(1, size))))


def tiles(n: int) -> list[slice]:
    """The tiles of a side of a block."""
    return [slice(i, i + TILE) for i in range(0, n, TILE)]


def in_hand(df: DataFrame) -> int:
    """Tasks that blocks are made for: two for each core, so that a vector is copied no more often with more partitions."""
    return min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism)


def _block(columns: list[str], n: int) -> Column:
    """The number of a row's block, of n, by what the row has beside its vector."""
    return F.pmod(F.xxhash64(*[c for c in columns if c != "embedding"]), F.lit(n)).cast("int")


def _dealt(left: DataFrame, right: DataFrame, rows: int, wide: bool = True) -> tuple[DataFrame, DataFrame, int, int]:
    """Both sides, each row once for every block of the other side, and the numbers of blocks; keys _a, _b number blocks, of
    `rows` rows unless `wide`. Floats stay floats until a task has them."""
    left, right = (x.filter("embedding IS NOT NULL") for x in (left, right))
    left, right = (x if x.schema["embedding"].dataType.simpleString() == "array<float>" else x.withColumn("embedding", F.col("embedding").cast("array<double>")) for x in (left, right))
    (n_left, size), (n_right, _) = (x.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first() for x in (left, right))
    side = _block_rows(n_left, n_right, size or 1, in_hand(left), rows) if wide else rows
    n_left, n_right = (max(1, -(-n // side)) for n in (n_left, n_right))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("_a", _block(left.columns, n_left)).withColumn("_b", every(n_right))
    b = right.withColumn("_b", _block(right.columns, n_right)).withColumn("_a", every(n_left))
    return a, b, n_left, n_right


def by_blocks(left: DataFrame, right: DataFrame, fn: Callable, schema: str, rows: int = ROWS, fold: Callable | None = None, whole: bool = False) -> DataFrame:
    """fn(left table, its matrix, right table, its matrix) -> Arrow table, for every pair of tiles of `rows` rows a side,
    or of blocks with `whole` (see `tiles`).

    A row is copied once for each block of the other side. A block holds several tiles where
    the tables are large; `fold` makes the rows of a left tile, gathered over right tiles, fewer.
    Rows with a null vector are left out; both sides need a column `embedding`.
    """
    a, b, _, _ = _dealt(left, right, rows)

    def run(x, y):
        u, v, out = vectors_of(x), vectors_of(y), []
        if whole:
            return fn(x, u, y, v)
        for i in range(0, max(1, len(x)), rows):
            row = None
            for j in range(0, max(1, len(y)), rows):
                tile = fn(x.slice(i, rows), u[i : i + rows], y.slice(j, rows), v[j : j + rows])
                row = tile if row is None else pa.concat_tables([row, tile]) if fold is None else fold(pa.concat_tables([row, tile]))
            out.append(row)
        return pa.concat_tables(out)

    return a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInArrow(run, schema)


def _even(n: int, most: int) -> int:
    """The step that cuts n rows into as few parts of at most `most` as there can be, all alike."""
    return -(-n // max(1, -(-n // most)))


def _order(d: np.ndarray) -> np.ndarray:
    """Places of d by value to 6 digits, equal ones as they stand."""
    bits = len(d).bit_length()
    if len(d) and np.abs(d).max() * 1e6 < 1 << (62 - bits):  # value and place are sorted as one number, which is faster
        key = np.rint(d * 1e6).astype(np.int64) << bits
        key |= np.arange(len(d))
        key.sort()
        key &= (1 << bits) - 1
        return key
    return np.argsort(np.round(d, 6), kind="stable")


def _edges(d: np.ndarray, n: int) -> np.ndarray:
    """What cuts distances like d into n ranges of about as many each."""
    d = d[np.isfinite(d)]
    return np.quantile(d, np.arange(1, n) / n, method="nearest") if len(d) else np.zeros(0)


def _range_of(d: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many edges are below each distance, in a byte; none for what is no number."""
    n = np.zeros(d.size, dtype=np.uint8)
    for edge in edges:
        n += d.ravel() > edge
    return n


def _ids(q: pa.Array, g: pa.Array, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([q, g, pa.array(d)], ["q_id", "g_id", "dist"])


def _by_distance(q: pa.Array, g: pa.Array, d: np.ndarray, at: np.ndarray | None = None, out: Callable = _ids) -> Iterator[pa.RecordBatch]:
    """The pairs of a tile from near to far, as files hold like distances side by side in fewer bytes; or those at places `at` of q x g."""
    m, d = len(g), d.ravel()
    order = _order(d)
    for i in range(0, len(order), BATCH):
        o = order[i : i + BATCH]
        r, c = np.divmod(o if at is None else at[o], m)
        yield out(q.take(pa.array(r)), g.take(pa.array(c)), d[o])


def _together(q: pa.Array, g: pa.Array, make: Callable, places: list[tuple[int, int]], edges: np.ndarray, most: int, out: Callable = _ids) -> Iterator[pa.RecordBatch]:
    """The pairs of some tiles from near to far. make(i, j) -> distances of the tile from row i of q and row j of g.

    Tiles are made once to note the range of each pair, of those that `edges` cut, then once for each range. Pairs of a range
    leave when they are all there or `most` of them are.
    """
    of = [_range_of(make(*p), edges) for p in places]
    for k in range(len(edges) + 1):
        held, n = [], 0
        for t, (i, j) in enumerate(places):
            at = np.flatnonzero(of[t] == k)
            if len(at):
                d = make(i, j)
                r, c = np.divmod(at, d.shape[1])
                held.append(((r + i) * len(g) + c + j, d.ravel()[at]))
                n += len(at)
                del at, d, r, c
            if held and (n >= most or t == len(places) - 1):
                at, d = (np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
                yield from _by_distance(q, g, d, at, out)
                del at, d


def every_pair(left: DataFrame, right: DataFrame, fn: Callable, rows: int = ROWS, beside: DataFrame | None = None, out: Callable | None = None, schema: str = "q_id long, g_id long, dist double") -> DataFrame:
    """q_id, g_id, dist of every pair of left rows (q_id, embedding) and right rows (g_id, embedding); fn(left ids, their matrix, right
    ids, their matrix) -> matrix of distances, for a tile. `beside`, a table of q_id, g_id, jd, is dealt to the blocks of its ids, then of
    `rows` rows a side, and the block's share given to fn as a fifth argument.

    With `out`, sides may have further columns, and out(left rows, right rows, distances), all of some pairs, makes a batch of `schema`.

    A task has the vectors of two blocks, the distances of one tile, about as many pairs and a byte for each pair of TOGETHER tiles; pairs
    leave it in small batches.
    """
    a, b, n_left, n_right = _dealt(left, right, rows, wide=beside is None)
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    sides = range(2 if beside is None else 3)
    own, other = ([c for c in z.columns if c != "embedding"] for z in (left, right))
    if beside is not None:
        at = beside.select("q_id", "g_id", "jd", _block(["q_id"], n_left).alias("_a"), _block(["g_id"], n_right).alias("_b"), F.lit(2).alias("_side"))
        both = both.unionByName(at, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        x, y, *some = (table.filter(pc.equal(table.column("_side"), n)) for n in sides)
        del table
        if not len(x) or not len(y):
            return
        u, v = vectors_of(x), vectors_of(y)
        if out is None:
            q, g, made = x.column("q_id").combine_chunks(), y.column("g_id").combine_chunks(), _ids
        else:
            q, g, made = (*(z.select(c).combine_chunks().to_batches()[0] for z, c in ((x, own), (y, other))), out)
        del x, y
        wide = _even(len(g), PAIR_ROWS)
        high = _even(len(q), max(1, PAIRS // wide))

        def make(i, j):
            return fn(q.slice(i, high), u[i : i + high], g.slice(j, wide), v[j : j + wide], *some)

        every = [(i, j) for i in range(0, len(q), high) for j in range(0, len(g), wide)]
        few = _even(len(every), TOGETHER)
        if few > 1:  # distances of rows from all over the block
            i, j = (np.linspace(0, len(x) - 1, min(len(x), SAMPLE)).astype(np.int64) for x in (q, g))
            like = fn(q.take(pa.array(i)), u[i], g.take(pa.array(j)), v[j], *some).ravel()
        for k in range(0, len(every), few):
            places = every[k : k + few]
            if len(places) > 1:
                yield from _together(q, g, make, places, _edges(like, len(places)), PAIRS, made)
            else:
                i, j = places[0]
                yield from _by_distance(q.slice(i, high), g.slice(j, wide), make(i, j), None, made)

    return both.groupBy("_a", "_b").applyInArrow(run, schema)


def pairs(queries: DataFrame, gallery: DataFrame, metric: str = "cosine") -> DataFrame:
    """q_id, g_id, dist of all pairs. Only for results that need every pair."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}; there are {', '.join(METRICS)}")
    if metric == "jaccard":  # of k-reciprocal sets over both sides; pairs that share no neighbour have distance 1
        from pathline.operators.rerank import jaccard

        near = jaccard(queries.unionByName(gallery), left=queries, right=gallery)
        return blended(queries, gallery, near, 0.0)
    q, g = (df.select(F.col("vec_id").cast("long").alias(c), "embedding") for df, c in ((queries, "q_id"), (gallery, "g_id")))
    return every_pair(q, g, lambda x, a, y, b: matrix(a, b, metric))


def blended(queries: DataFrame, gallery: DataFrame, near: DataFrame, weight: float, metric: str = "cosine") -> DataFrame:
    """q_id, g_id, dist = (1 - weight) * near + weight * distance of all pairs. near: i, k, dist of some pairs, whose ids both
    have vectors; it is 1 elsewhere. Those rows alone go to the blocks of their pairs, so that no pair is shuffled."""

    def placed(ids, known):
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        return at, known[at] == ids

    def fn(x, a, y, b, some):
        (rows, r), (columns, c) = (np.unique(ids.to_numpy(), return_inverse=True) for ids in (x, y))
        d = np.ones((len(rows), len(columns)))
        (i, of_x), (k, of_y) = placed(some.column("q_id").to_numpy(), rows), placed(some.column("g_id").to_numpy(), columns)
        both = of_x & of_y
        d[i[both], k[both]] = some.column("jd").to_numpy()[both]
        d = d[r][:, c]
        return (1 - weight) * d + weight * matrix(a, b, metric) if weight else d

    known = lambda x, c: x.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias(c), "embedding")
    q, g = known(queries, "q_id"), known(gallery, "g_id")
    near = near.select(F.col("i").cast("long").alias("q_id"), F.col("k").cast("long").alias("g_id"), F.col("dist").alias("jd"))
    return every_pair(q, g, fn, beside=near)


def _top(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least of each row, of equals the smaller ids; what lies beyond the k-th is not sorted."""
    near = np.round(d, 9)  # distances that differ by rounding alone count as equal, so that ids decide
    if d.shape[1] > k:
        r, c = np.nonzero(near <= np.partition(near, k - 1, axis=1)[:, k - 1 : k])
    else:
        r, c = (x.ravel() for x in np.indices(d.shape))
    order = np.lexsort((ids[c], near[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(len(d)))
    keep = np.arange(len(r)) - first[r] < k
    return r[keep], c[keep]


def _nearest_of(x: pa.Table, a: np.ndarray, y: pa.Table, b: np.ndarray, k: int, metric: str) -> pa.Table:
    """The k nearest of each row of a block, tile by tile: of a later tile only what is no farther than the k-th so far is looked at."""
    ids, out = y.column("g_id").to_numpy(), []
    for at in tiles(len(x)) if len(y) else []:
        n = len(a[at])
        r, g, d, bound = np.zeros(0, dtype=np.int64), ids[:0], np.zeros(0), None
        for to in tiles(len(y)):
            m, own = matrix(a[at], b[to], metric), ids[to]
            i, c = _top(m, own, k) if bound is None else np.nonzero(m <= bound[:, None])
            if len(i):
                r, g, d = np.append(r, i), np.append(g, own[c]), np.append(d, m[i, c])
                near = np.round(d, 9)
                order = np.lexsort((g, near, r))
                order = order[np.arange(len(r)) - np.searchsorted(r[order], np.arange(n))[r[order]] < k]
                r, g, d, near = r[order], g[order], d[order], near[order]
            if (np.bincount(r, minlength=n) == k).all():
                bound = near[k - 1 :: k] + 1e-9  # rounding hides less
        out.append((x.column("q_id").to_numpy()[at][r], g, d))
    q, g, d = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    return pa.table({"q_id": q, "g_id": g, "dist": d})


#: Cells at most, whose pivots go to all tasks and whose sizes come to the driver; rows of a cell for which another is worth it.
CELLS, CELL_ROWS = 1024, 4096
#: Share of pairs that must be skipped for cells to be used.
WORTH = 0.2


class Cells:
    """Vectors in cells around pivots, and which cells a query's cell must see for its k nearest.

    Any two vectors of cells are apart by the distance of the pivots less both radii at least, and plus
    both radii at most. The k-th nearest of a query is no farther than the bound within which cells
    hold k vectors; cells that begin beyond it are skipped. Cosine distances go by vectors
    of unit length, for which they are half the squared distance.
    """

    def __init__(self, queries: DataFrame, base: DataFrame, k: int, metric: str, cells: int | None, n_base: int):
        self.unit = metric in ("cosine", "cosine2")
        many = cells or min(CELLS, n_base // CELL_ROWS)
        rows = base.orderBy(F.xxhash64("g_id"), "g_id").limit(many).select("embedding").toArrow() if many > 1 else None
        self.pivots = self._points(vectors_of(rows)) if rows is not None and len(rows) else None
        self.skipped = 0.0
        if self.pivots is None:
            return
        self.queries, self.base = self._placed(queries), self._placed(base)
        p = len(self.pivots)
        self.n, self.far = np.zeros((2, p), dtype=np.int64), np.zeros((2, p))
        for side, df in enumerate((self.queries, self.base)):
            for r in df.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_off").alias("far")).collect():  # a row for each cell
                self.n[side, r["_cell"]], self.far[side, r["_cell"]] = r.n, r.far
        apart = np.sqrt(np.maximum(matrix(self.pivots, self.pivots, "sqeuclidean"), 0.0))
        both = self.far[0][:, None] + self.far[1][None]
        most = np.where(self.n[1] > 0, apart + both, np.inf)
        order = np.argsort(most, axis=1)
        enough = (np.cumsum(self.n[1][order], axis=1) >= k).argmax(axis=1)
        within = np.where(self.n[1].sum() >= k, np.take_along_axis(most, order, 1)[np.arange(p), enough], np.inf)
        slack = 1e-6 * (1 + np.abs(within))  # more than rounding of distances can hide
        self.seen = (apart - both <= (within + slack)[:, None]) & (self.n[0] > 0)[:, None] & (self.n[1] > 0)[None]
        every = self.n[0][:, None] * self.n[1][None]
        self.skipped = 1 - float((every * self.seen).sum()) / max(1, int(every.sum()))

    def _points(self, v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if self.unit else v

    def _placed(self, df: DataFrame) -> DataFrame:
        """df with the number of the nearest pivot and the distance from it; written, as it is read for sizes and for pairs."""
        pivots, points = self.pivots, self._points

        def run(batches):
            for batch in batches:
                v = points(vectors_of(pa.Table.from_batches([batch])))
                d = matrix(v, pivots, "sqeuclidean") if len(v) else np.zeros((0, len(pivots)))
                cell = d.argmin(axis=1)
                off = np.linalg.norm(v - pivots[cell], axis=1) if len(v) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(off)], [*batch.schema.names, "_cell", "_off"])

        return settle(df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", _cell int, _off double"), "cells")

    def pairs_of(self, rows: int) -> tuple[DataFrame, DataFrame]:
        """Both sides, each row once for every block of the other side that it meets; keys _a, _b number blocks."""
        spark = self.queries.sparkSession
        parts = np.maximum(1, -(-self.n // rows))  # a cell of many rows is several blocks
        first = np.concatenate([np.zeros((2, 1), dtype=np.int64), np.cumsum(parts, axis=1)], axis=1)
        out = []
        for side, df in enumerate((self.queries, self.base)):
            meets = self.seen if side == 0 else self.seen.T
            blocks = [(c, int(parts[side, c]), int(first[side, c]), [b for o in np.flatnonzero(meets[c]).tolist() for b in range(int(first[1 - side, o]), int(first[1 - side, o + 1]))]) for c in range(len(self.pivots)) if meets[c].any()]
            table = spark.createDataFrame(blocks, "_cell int, _parts int, _first int, _others array<int>")  # a row for each cell
            key = "q_id" if side == 0 else "g_id"
            own = (F.col("_first") + F.pmod(F.xxhash64(key), F.col("_parts"))).cast("int")
            mine, other = ("_a", "_b") if side == 0 else ("_b", "_a")
            both = df.join(F.broadcast(table), "_cell")
            out.append(both.select(key, "embedding", own.alias(mine), F.explode("_others").alias(other)))
        return out[0], out[1]


def nearest(queries: DataFrame, base: DataFrame, k: int, metric: str = "sqeuclidean", rows: int = ROWS, cells: int | None = None) -> DataFrame:
    """q_id, g_id, dist, rank of the exact k nearest, from 1; equal distances by g_id. Fewer rows than k give fewer.

    Where the triangle inequality lets a fair share of the pairs of cells be skipped (see `Cells`), only the others are
    compared; else every block meets every block. The result is the same.
    """
    q, g = (x.filter("embedding IS NOT NULL").select(F.col("vec_id").alias(c), F.col("embedding").cast("array<double>").alias("embedding")) for x, c in ((queries, "q_id"), (base, "g_id")))
    n_base = g.count() if cells is None else 0
    made = Cells(q, g, k, metric, cells, n_base) if cells or n_base >= 2 * CELL_ROWS else None
    schema = "q_id long, g_id long, dist double"
    if made is not None and made.skipped >= WORTH:
        a, b = made.pairs_of(rows)

        def run(x, y):
            return _nearest_of(x, vectors_of(x), y, vectors_of(y), k, metric)

        found = a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInArrow(run, schema)
    else:
        found = by_blocks(q, g, lambda x, a, y, b: _nearest_of(x, a, y, b, k, metric), schema, rows, whole=True)
    w = Window.partitionBy("q_id").orderBy(F.round("dist", 9), "g_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
