"""Work that grew faster than its rows: what is shuffled, and how often a table is made."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathline.operators import detections as P
from pathline.operators import distance as D
from pathline.operators import rerank as J
from pathline.plans import catalog
from pathline.streaming import online as W


def shuffled(spark, run):
    """Bytes that run() writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def so_far():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = so_far()
    run()
    return so_far() - before


def test_minima_are_summed_before_a_shuffle(spark):
    """a million pairs that share ten columns each are not shuffled, let alone a row for every column."""
    n = 1000
    rows = spark.range(n * 10).selectExpr("id DIV 10 AS i", "id % 10 AS j", "0.1D AS v")
    assert shuffled(spark, lambda: J.jaccard_of(rows).write.format("noop").mode("overwrite").save()) < 2_000_000
    got = J.jaccard_of(rows).selectExpr("count(*)", "count(DISTINCT i, k)", "max(dist)").first()
    assert (got[0], got[1]) == (n * n, n * n) and got[2] == pytest.approx(0)


def test_minima_of_many_blocks(spark, monkeypatch):
    """Blocks by likeness and of few rows give what plain sums give; entries of value 0 share a column too."""
    r = np.random.default_rng(3)
    own = {i: dict.fromkeys(r.choice(25, 3, replace=False).tolist(), 0.0) | {100 + i % 4: round(float(r.random()), 3)} for i in range(120)}
    v = spark.createDataFrame([(i, j, x) for i, e in own.items() for j, x in e.items()], "i long, j long, v double")
    features = spark.createDataFrame([(i, [float(i % 4), float(r.random()) / 9]) for i in own], "vec_id long, embedding array<double>")
    want = {(i, k): 1 - t / (2 - t) for i in own for k in own if own[i].keys() & own[k].keys() for t in [sum(min(x, own[k][j]) for j, x in own[i].items() if j in own[k])]}
    monkeypatch.setattr(J, "LEAST", 7)
    monkeypatch.setattr(J, "STEP", 50)
    monkeypatch.setattr(J, "PIVOTS", 9)
    for few in (1024, 1):
        monkeypatch.setattr(J, "FEW_BLOCKS", few)
        got = {(x.i, x.k): x.dist for x in J.jaccard_of(v, features=features).collect()}
        assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)
    assert J.jaccard_of(v.filter("i < 0"), features=features).isEmpty()


def test_minima_of_rows_that_share_nothing(monkeypatch):
    """Of the left rows taken together none shared a column with the right block, and sums came out as whole numbers."""
    x = np.array([1, 2, 3]), np.array([0, 1, 2]), np.array([50, 7, 60]), np.array([1.0, 0.5, 1.0])
    y = np.array([8, 9]), np.array([0, 1]), np.array([7, 5]), np.array([0.25, 1.0])
    monkeypatch.setattr(J, "STEP", 1)  # each left row by itself
    batches = list(J._minima(x, y))
    assert all(b.schema.types == [pa.int64(), pa.int64(), pa.float64()] for b in batches)
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == [(2, 8, 0.25)]


@pytest.fixture
def seen(spark, monkeypatch):
    """Counts the rows that suppression is given, in all runs."""
    rows = spark.sparkContext.accumulator(0)
    confident = P.confident

    def counted(df):
        def run(batches):
            for batch in batches:
                rows.add(len(batch))
                yield batch

        out = confident(df)
        return out.mapInArrow(run, out.schema)

    monkeypatch.setattr(P, "confident", counted)
    return rows


def test_tracking_cleans_once(spark, sf_dir, seen):
    """segments and boxes come from rows that are cleaned once."""
    catalog.QUERIES["track_batch"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    once = catalog.load(spark, sf_dir, "raw_detections").filter("score > 0.3 AND cls = 0").count()
    assert seen.value == once > 0


@pytest.mark.parametrize("batch, few", [(10_000, 64), (3, 64), (7, 4), (1, 0)])
def test_suppression_of_many_frames_at_once(spark, monkeypatch, batch, few):
    """Frames over several batches, of no key, of many boxes and with equal scores: the same as box by box."""
    r = np.random.default_rng(batch)
    rows = []
    for k in range(160):
        x, y = r.integers(0, 30, 2).tolist()
        camera, frame = (None if k % 11 == 10 else k % 3), (None if k % 13 == 12 else 0 if k % 2 else int(r.integers(9)))
        rows.append((None if k == 50 else k, camera, frame, float(x), float(y), x + 9.0, y + 12.0, round(float(r.random()), 1), k % 2))
    schema = "det_id long, camera_id int, frame int, x1 double, y1 double, x2 double, y2 double, score double, cls int"

    def over(p, q):
        w, h = max(0, min(p[5], q[5]) - max(p[3], q[3])), max(0, min(p[6], q[6]) - max(p[4], q[4]))
        return p[8] == q[8] and w * h / (2 * 9 * 12 - w * h + 1e-12) > 0.3

    want = []
    for p in sorted(rows, key=lambda p: (-p[7], p[0] is None, p[0] or 0)):
        if not any(q[1:3] == p[1:3] and over(p, q) for q in want):
            want.append(p)
    monkeypatch.setattr(P, "FEW", few)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [tuple(x) for x in P.suppress(spark.createDataFrame(rows, schema)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) < 150
    assert P.suppress(spark.createDataFrame([], schema)).isEmpty()


def test_the_stream_is_of_rows_cleaned_once(spark, sf_dir, seen):
    """the range of frames, the row that ends the stream and its files come from one cleaned table."""
    catalog.QUERIES["track_stream"](spark, sf_dir)
    assert seen.value == catalog.load(spark, sf_dir, "raw_detections").filter("score > 0.3 AND cls = 0").count() > 0


def floats(spark, n, seed, first=0, size=64):
    v = np.random.default_rng(seed).normal(size=(n, size)) / 8
    return spark.createDataFrame([(first + i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")


def stored(df, at):
    """Bytes of the files of df."""
    df.write.parquet(str(at))
    return sum(f.stat().st_size for f in at.glob("*.parquet"))


@pytest.mark.parametrize("metric, most", [("cosine", 6.5), ("cosine2", 7.5), ("euclidean", 6.5), ("sqeuclidean", 7.5)])
def test_files_of_all_pairs(spark, tmp_path, metric, most):
    """Like distances side by side; in the order of ids a pair took over 8.3 bytes."""
    q, g = floats(spark, 1200, 1), floats(spark, 1800, 2, 5000)
    pairs = D.pairs(q, g, metric).withColumn("dist", F.round("dist", 6))
    assert stored(pairs, tmp_path / "pairs") < most * 1200 * 1800
    got = spark.read.parquet(str(tmp_path / "pairs")).toArrow().to_pandas().sort_values(["q_id", "g_id"])
    a, b = (np.array([r.embedding for r in x.orderBy("vec_id").collect()]) for x in (q, g))
    assert got.q_id.tolist() == np.repeat(np.arange(1200), 1800).tolist() and got.g_id.tolist() == np.tile(np.arange(5000, 6800), 1200).tolist()
    assert np.allclose(got.dist, D.matrix(a, b, metric).ravel(), atol=1e-6)


def test_vectors_of_all_pairs(spark):
    """floats go to blocks as floats, and blocks are as large as leaves four for each task."""
    q, g = floats(spark, 500, 1), floats(spark, 900, 2)
    assert shuffled(spark, lambda: D.pairs(q, g).write.format("noop").mode("overwrite").save()) < 330 * 1400
    q, g = (x.withColumnRenamed("vec_id", c) for x, c in ((q, "q_id"), (g, "g_id")))
    in_tiles = D.every_pair(q, g, lambda x, a, y, b: D.matrix(a, b, "cosine"), rows=16)  # 15 x 32 blocks of 16 rows were 29,000 copies
    assert shuffled(spark, lambda: in_tiles.write.format("noop").mode("overwrite").save()) < 400 * 8000


@pytest.mark.parametrize("pairs, wide", [(1, 1), (50, 7), (1 << 23, 8192)])
def test_all_pairs_in_small_tiles(spark, monkeypatch, pairs, wide):
    """Rows of one id, of none and without a vector; a side of floats and one of doubles; a distance beyond whole numbers; a side without rows."""
    monkeypatch.setattr(D, "PAIRS", pairs)
    monkeypatch.setattr(D, "PAIR_ROWS", wide)
    ids = [None, 3, 3, 4, 5, 6, 7, 8, 9]
    q = spark.createDataFrame([(i, [float(n), 1.0]) for n, i in enumerate(ids)] + [(10, None)], "vec_id long, embedding array<float>")
    g = spark.createDataFrame([(n, [1e200 if n == 11 else n / 7, 2.0]) for n in range(20)], "vec_id long, embedding array<double>")
    want = sorted((str(i), k, float(f"{(n - (1e200 if k == 11 else k / 7)) ** 2 + 1:.6g}")) for n, i in enumerate(ids) for k in range(20) if k != 11)
    got = D.pairs(q, g, "sqeuclidean").collect()
    assert len(got) == 180
    assert sorted((str(r.q_id), r.g_id, float(f"{r.dist:.6g}")) for r in got if r.g_id != 11) == want
    assert D.pairs(q, g.filter("vec_id < 0")).isEmpty() and D.pairs(q.filter("vec_id < 0"), g).isEmpty()


@pytest.mark.parametrize("top", [2.0, 1e4, 1e16, np.inf, np.nan])
def test_order_of_distances(top):
    r = np.random.default_rng(1)
    d = np.append(np.round(r.normal(size=2000), 2), top)
    assert D._order(d).tolist() == np.argsort(np.round(d, 6), kind="stable").tolist()
    assert D._order(d[:0]).tolist() == []


@pytest.mark.parametrize("together", [1, 4])
def test_pairs_of_tiles_leave_in_one_order(spark, monkeypatch, together):
    """the pairs of four tiles of one block (300 x 400) from near to far; each tile was put in order on its own."""
    monkeypatch.setattr(D, "PAIRS", 30_000)
    monkeypatch.setattr(D, "PAIR_ROWS", 200)
    monkeypatch.setattr(D, "TOGETHER", together)
    q, g = floats(spark, 300, 1), floats(spark, 400, 2, 5000)
    got = D.pairs(q, g, "euclidean").toArrow().to_pandas()
    breaks = int((np.diff(np.rint(got.dist.to_numpy() * 1e6)) < 0).sum())
    assert breaks == 0 if together == 4 else breaks == 3
    got = got.sort_values(["q_id", "g_id"])
    a, b = (np.array([r.embedding for r in x.orderBy("vec_id").collect()]) for x in (q, g))
    assert got.q_id.tolist() == np.repeat(np.arange(300), 400).tolist() and got.g_id.tolist() == np.tile(np.arange(5000, 5400), 300).tolist()
    assert np.allclose(got.dist, D.matrix(a, b, "euclidean").ravel(), atol=1e-9)


@pytest.mark.parametrize("what", ["like", "equal", "no number", "far"])
def test_pairs_held(monkeypatch, what):
    """every pair once, no more held than `most` and a tile, also where ranges of a sample do not fit or have no edge."""
    r = np.random.default_rng(1)
    d = r.normal(size=(60, 50)) if what != "equal" else np.ones((60, 50))
    if what == "no number":
        d[r.random(d.shape) < 0.5] = np.nan
        d[0, :3] = np.inf, -np.inf, 0.0
    places = [(i, j) for i in range(0, 60, 30) for j in range(0, 50, 25)]
    edges = D._edges(d if what != "no number" else d * np.nan, 4) + (100 if what == "far" else 0)
    made, order = [], D._order
    monkeypatch.setattr(D, "_order", lambda x: made.append(len(x)) or order(x))
    out = pa.Table.from_batches(list(D._together(pa.array(range(60)), pa.array(range(50)), lambda i, j: d[i : i + 30, j : j + 25], places, edges, 1000)))
    q, g, dist = (c.to_numpy() for c in out.columns)
    assert sorted(zip(q.tolist(), g.tolist(), strict=True)) == [(i, j) for i in range(60) for j in range(50)]
    assert np.array_equal(dist, d[q, g], equal_nan=True) and max(made) < 1000 + 750


def few_at_a_time(monkeypatch):
    """Small blocks, and each left row by itself in the tasks too."""
    of_blocks = J._of_blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, J.STEP = J.STEP, 1
        try:
            yield from of_blocks(batches)
        finally:
            J.STEP = step

    monkeypatch.setattr(J, "LEAST", 7)
    monkeypatch.setattr(J, "in_hand", lambda df: 40)
    monkeypatch.setattr(J, "_of_blocks", run)


@pytest.mark.parametrize("name", ["dist_jaccard", "rerank"])
def test_rows_that_share_nothing_with_a_block(name, same, monkeypatch):
    """these ended with an error; what is far keeps its distance of 1."""
    few_at_a_time(monkeypatch)
    same(catalog.QUERIES[name], catalog.ORACLES[name])


class _Map(dict):
    """A map state in memory, as the store gives its values back."""

    def exists(self):
        return bool(self)

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = tuple(map(list, value))


class _Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def test_series_is_folded_in_parts():
    """each micro-batch changed every bucket of a name, and all its rows were held as tuples and given out at once."""
    r, n, rows, seen, old = np.random.default_rng(7), 5, {}, {}, set()
    series = W._Series(n, None)
    series.SPAN, series.CHUNK, series.about, series.buckets = 16, 100, _Value(), _Map()
    order = r.permutation(3000)
    for revision, part in enumerate((order[:300], order[300:303], order[303:2000], order[2000:]), 1):
        new = pd.DataFrame({"iteration": part // 2 * (1 + part % 7 // 6 * 40), "seq": part, "value": np.where(part % 11 == 0, np.nan, part * 37 % 101)})
        frames = list(series.handleInputRows(("=a",), iter([new]), None))
        assert max(map(len, frames)) < 100 + 60
        rows |= {(i, s): v for i, s, v in new.itertuples(index=False)}
        line = sorted(rows)
        last = pd.Series([rows[x] for x in line]).rolling(n, min_periods=1)
        changed = [k for k in range(len(line)) if any(x not in old for x in line[max(0, k - n + 1) : k + 1])]
        got = pd.concat(frames)
        assert list(zip(got["iteration"], got["seq"], strict=True)) == [line[k] for k in changed] and set(got["revision"]) == {revision}
        assert np.allclose(got["median"], last.median().iloc[changed], equal_nan=True) and np.allclose(got["mean"], last.mean().iloc[changed], equal_nan=True)
        old = set(line)


def test_revisions_are_sorted_once(spark):
    """they were sorted before and after their shuffle."""
    out = spark.createDataFrame([("a", 1, 1, 0.0, 0.0, 0.0, k) for k in (1, 2)], "name string, iteration long, seq long, value double, median double, mean double, revision long")
    plan = W.revised(out)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
