"""Small hand-made cases, and behaviour that the queries do not show."""

import math
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathline.functions import boxes as B
from pathline.functions.vectors import unit
from pathline.operators import detections as P
from pathline.operators import distance as D
from pathline.operators import embeddings as E
from pathline.operators import hooks as U
from pathline.operators import losses as M
from pathline.operators import pose as K
from pathline.operators import rerank as J
from pathline.operators import retrieval as R
from pathline.operators import telemetry as H
from pathline.plans import catalog
from pathline.sources import tables as S
from pathline.streaming import online as W

VEC = "vec_id long, person_id int, cam_id int, embedding array<double>"


def vectors(spark, rows):
    return spark.createDataFrame(rows, VEC)


def test_boxes(spark):
    rows = [(0.0, 0.0, 4.0, 4.0, 2.0, 0.0, 6.0, 4.0), (0.0, 0.0, 4.0, 4.0, 9.0, 9.0, 9.0, 9.0), (1.0, 1.0, 3.0, 1.0, 1.0, 1.0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double, h double")
    out = df.select(B.iou(list("abcd"), list("efgh")).alias("iou"), B.to_centre(*"abcd").alias("z")).select("iou", "z.r", B.to_corners("z").alias("c")).collect()
    assert out[0].iou == pytest.approx(8 / 24) and out[1].iou == 0 and out[2].iou == 0
    assert out[2].r == 0 and out[2].c.x1 == out[2].c.x2 == 2.0
    assert tuple(out[0].c) == pytest.approx((0, 0, 4, 4))


def test_clean_edges(spark):
    rows = [(1, 0, 1, 0.0, 0.0, 10.0, 10.0, 0.3, 0), (2, 0, 1, 0.0, 0.0, 10.0, 10.0, 0.31, 0), (3, 1, 1, 0.0, 0.0, 9.9, 10.0, 0.9, 0), (4, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.9, 1), (5, 1, 1, 0.0, None, 10.0, 10.0, 0.9, 0)]
    df = spark.createDataFrame(rows, "det_id long, camera_id int, frame int, x1 double, y1 double, x2 double, y2 double, score double, cls int")
    rois = spark.createDataFrame([(0, 5.0, 50.0, 7.0, 70.0)], "camera_id int, rx1 double, rx2 double, ry1 double, ry2 double")
    out = P.clean(df, rois, P.Cleaning(min_w=10, min_h=10)).collect()
    assert [(r.det_id, r.x1, r.y1) for r in out] == [(2, 5.0, 7.0)]


def test_pose_lengths(spark):
    df = spark.createDataFrame([(1, [1.0], [2.0], [0.5]), (2, [1.0], [2.0], [])], "det_id long, xs array<double>, ys array<double>, scores array<double>")
    assert {r.det_id: r.ok for r in K.with_scores(df).collect()} == {1: True, 2: False}


def test_unit_of_zero(spark):
    r = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(unit("v").alias("a"), unit("v", True).alias("b")).first()
    assert r.a == r.b == [0.0, 0.0]


def test_precise_stats_needs_batches(spark):
    df = vectors(spark, [(k, 0, 0, [float(k)]) for k in range(8)]).withColumn("batch", F.floor(F.col("vec_id") / 4))
    with pytest.raises(ValueError):
        E.precise_stats(df, "batch", 3)
    whole = E.precise_stats(df, "batch", 2).first()
    assert whole["mean"] == 3.5 and whole["var"] == pytest.approx(np.var([0, 1, 2, 3], ddof=1))
    halves = E.precise_stats(df, "batch", 2, num_splits=2).first()
    assert halves["mean"] == 3.5 and halves["var"] == pytest.approx(0.5)


def test_sets_are_joined_by_weight(spark):
    df = vectors(spark, [(k, k % 3 + 5, 0, [1.0]) for k in range(400)])
    out = E.joint_sets({"a": df, "b": df}, {"b": 0.25})
    n = {r.set_name: r["count"] for r in out.groupBy("set_name").count().collect()}
    assert n["a"] == 400 and 50 < n["b"] < 150
    assert {(r.set_name, r.person_id): r.joint_id for r in out.collect()} == {(s, p): 3 * i + p - 5 for i, s in enumerate("ab") for p in (5, 6, 7)}


def test_knn_ties_and_few_rows(spark):
    df = vectors(spark, [(k, 0, 0, [1.0, 0.0]) for k in (3, 1, 2)])
    out = sorted((r.q_id, r["rank"], r.g_id) for r in D.nearest(df, df, 5).collect())
    assert out == [(q, n, n) for q in (1, 2, 3) for n in (1, 2, 3)]


def test_blocks_change_nothing(spark):
    rng = np.random.default_rng(1)
    df = vectors(spark, [(k, k % 5, k % 2, rng.normal(size=4).tolist()) for k in range(60)])

    def fn(x, a, y, b):
        d = D.matrix(a, b, "sqeuclidean").ravel()
        import pyarrow as pa

        return pa.table({"q": np.repeat(x.column("q").to_numpy(), len(y)), "g": np.tile(y.column("g").to_numpy(), len(x)), "d": d})

    q, g = df.select(F.col("vec_id").alias("q"), "embedding"), df.select(F.col("vec_id").alias("g"), "embedding")
    few = {(r.q, r.g): r.d for r in D.by_blocks(q, g, fn, "q long, g long, d double", rows=7).collect()}
    all_ = {(r.q, r.g): r.d for r in D.by_blocks(q, g, fn, "q long, g long, d double").collect()}
    assert few.keys() == all_.keys() and len(few) == 3600
    assert all(few[k] == pytest.approx(all_[k]) for k in few)
    with pytest.raises(ValueError):
        D.pairs(df, df, "manhattan")


def test_jaccard_properties(spark):
    rng = np.random.default_rng(2)
    df = vectors(spark, [(k, k % 3, 0, (np.eye(3)[k % 3] * 5 + rng.normal(size=3)).tolist()) for k in range(24)])
    out = {(r.i, r.k): r.dist for r in J.jaccard(df, k1=5, k2=2).collect()}
    assert all(0 <= d <= 1 for d in out.values())
    assert all(out[k, i] == pytest.approx(d) for (i, k), d in out.items())
    assert all(out[i, i] == pytest.approx(0) for i in range(24))
    knn = D.nearest(df, df, 5).select(F.col("q_id").alias("i"), F.col("g_id").alias("j"), "rank")
    sums = J.weights(J.expanded(knn, 5), df).groupBy("i").agg(F.sum("v").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)


def test_half_set_size():
    assert [J.half(k) for k in (20, 6, 5, 3)] == [11, 4, 3, 3]


def test_queries_without_true_match_are_left_out(spark):
    q = vectors(spark, [(1, 7, 0, [1.0]), (2, 8, 0, [1.0])])
    g = vectors(spark, [(10, 7, 1, [1.0]), (11, 8, 0, [1.0])])  # the second has the same camera
    dist = spark.createDataFrame([(a, b, 0.1 * b) for a in (1, 2) for b in (10, 11)], "q_id long, g_id long, dist double")
    out = R.average_precision(R.labelled(dist, q, g)).collect()
    assert [(r.q_id, r.ap, r.first_match) for r in out] == [(1, 1.0, 1)]


def test_mining_without_partners(spark):
    df = vectors(spark, [(1, 0, 0, [1.0, 0.0]), (2, 0, 0, [0.0, 1.0])])
    assert {r.an for r in M.hard_mining(df).collect()} == {1e9}
    assert {r.loss for r in M.circle(df).collect()} == {0.0}


def test_soft_margin_falls_back(spark):
    df = vectors(spark, [(1, 0, 0, [0.0]), (2, 0, 0, [2000.0]), (3, 1, 0, [0.0])])
    loss = M.triplet(df, margin=0.0).first().loss
    assert math.isfinite(loss) and loss == pytest.approx(np.mean([2000.3, 0.3, 0.3]), abs=1e-3)


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("a", None)], "name string, value double")
    out = {r.bin: (r["count"], r.num) for r in H.histogram(df, 4).collect()}
    assert out == {0: (0, 2), 1: (0, 2), 2: (0, 2), 3: (2, 2)}


def test_throttle_is_greedy(spark):
    rows = [(k, "a", datetime(2024, 1, 1) + timedelta(seconds=s)) for k, s in enumerate((0, 4, 5, 9, 10, 16))]
    df = spark.createDataFrame(rows, "seq long, caller string, ts timestamp_ntz")
    assert sorted(r.seq for r in H.every_n_seconds(df, 5).collect()) == [0, 2, 4, 5]


def test_best_epochs(spark):
    rows = [(0, 0.5), (1, 0.5), (2, 0.4), (3, None), (4, 0.6)]
    out = {r.epoch: (r.best, r.periodic, r.final) for r in H.best_epochs(spark.createDataFrame(rows, "epoch int, metric double"), 2, 5).collect()}
    assert out == {1: (True, True, False), 3: (False, True, False), 4: (True, False, True)}


def test_every_first_of_n_is_kept(spark):
    df = spark.createDataFrame([(k, "c") for k in range(5)], "seq long, caller string")
    assert [r.seq for r in H.every_n(df, 2).orderBy("seq").collect()] == [0, 2, 4]
    assert H.every_n(df, 1).count() == 5


def test_hook_counts_rows(spark):
    df = spark.createDataFrame([(1, [float(x) for x in range(12)], 2, 2)], "id long, pixels array<double>, h int, w int")
    with pytest.raises(Exception, match="0 vectors for 1 images"):
        U.embed_crops(df, lambda: lambda images: images.mean(axis=(2, 3))[:-1]).collect()


def test_detector_and_pose_hooks(spark):
    df = spark.createDataFrame([(0, 1, [1.0] * 12, 2, 2), (0, 2, [0.0] * 12, 2, 2)], "camera_id int, frame int, pixels array<double>, h int, w int")
    assert [(r.frame, r.x2) for r in U.detect_frames(df, lambda: lambda i: [[0, 0, i.shape[1], i.shape[0], 0.9, 0]] if i.sum() > 0 else []).collect()] == [(1, 2.0)]
    poses = spark.createDataFrame([(5, [1.0] * 12, 2, 2)], "det_id long, pixels array<double>, h int, w int")
    r = U.estimate_poses(poses, lambda: lambda image: [[1, 2, 0.5]]).first()
    assert (r.xs, r.ys, r.scores) == ([1.0], [2.0], [0.5])


def test_roc_and_lines_are_kept(spark, sf_dir, tmp_path):
    roc = catalog.QUERIES["roc"](spark, sf_dir)
    S.save_roc(roc, roc.select("threshold"), f"{tmp_path}/roc")
    assert S.load_roc(spark, f"{tmp_path}/roc")[0].count() == roc.count()
    lines = catalog.QUERIES["metrics_json"](spark, sf_dir)
    S.append_lines(lines, f"{tmp_path}/lines")
    import json

    rows = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/lines").collect()]
    assert len(rows) == lines.count() and all(list(r) == sorted(r) and "iteration" in r for r in rows)


def test_tracks_by_camera(spark, sf_dir, tmp_path):
    tracks = catalog.QUERIES["track_batch"](spark, sf_dir)
    S.write_tracks(tracks, f"{tmp_path}/tracks")
    assert spark.read.parquet(f"{tmp_path}/tracks").filter("camera_id = 1").count() == tracks.filter("camera_id = 1").count()
    dets = catalog.load(spark, sf_dir, "raw_detections")
    dets.write.parquet(f"{tmp_path}/dets")
    assert S.read_detections(spark, f"{tmp_path}/dets").count() == dets.count()
    assert S.read_detections(spark, f"{tmp_path}/dets", stream=True).isStreaming


BANK = "bank int, vec_id long, label int, embedding array<double>"


def test_bank_stream_keeps_the_newest(spark):
    df = spark.createDataFrame([(k % 2, k, 0, [float(k + 1), 0.0]) for k in range(20)], BANK)
    entered = catalog.finished(W.bank_stream(catalog.streamed(df, 2, "vec_id", "bank"), size=3), "bank")
    rows = W.banked(entered, 3).collect()
    assert {r.vec_id for r in rows if r.bank == 1} == {15, 17, 19} and {r.vec_id for r in rows if r.bank == 0} == {14, 16, 18}
    assert all(list(r.embedding) == [1.0, 0.0] for r in rows)


def run_parts(spark, stream, parts, schema, checkpoint=None):
    """All rows that a stream gives for parts, each a micro-batch, as a table; and the checkpoint."""
    at, checkpoint = catalog.new_folder(spark, "parts"), checkpoint or catalog.new_folder(spark, "state")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.02)
    out = stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at))
    out.writeStream.format("parquet").option("path", f"{checkpoint}-out").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{checkpoint}-out"), checkpoint


def test_bank_stream_leaves_nulls_out_and_writes_its_own_slots(spark):
    odd = [(0, 100, 1, None), (0, 101, 1, [None, 1.0]), (0, None, 1, [1.0, 1.0]), (None, 102, 1, [1.0, 1.0]), (0, 103, None, [1.0, 1.0])]
    parts = [[(0, k, k, [3.0, 4.0 + k]) for k in range(10)], odd, [(0, 7, 99, [0.0, 0.0]), *odd], [(0, k, k, [1.0, 1.0]) for k in range(20, 50)]]
    entered, checkpoint = run_parts(spark, lambda s: W.bank_stream(s, 6), parts, BANK)
    # all of a part that fits, and of a part of 30 the last 6
    assert sorted((r.place, r.vec_id) for r in entered.collect()) == [*((k, k) for k in range(4, 10)), (10, 7), *((k + 11 + 24, k + 44) for k in range(6))]
    slots = spark.read.format("statestore").option("stateVarName", "slots").load(checkpoint).select("user_map_key.slot", "user_map_value.*").collect()
    assert sorted((r.slot, r.place, r.vec_id) for r in slots) == sorted((p % 6, p, v) for p, v in ((35 + k, 44 + k) for k in range(6)))
    assert {(r.place, r.vec_id) for r in W.banked(entered, 6).collect()} == {(r.place, r.vec_id) for r in slots}


def test_rolling_stream_places_late_rows(spark):
    rng = random.Random(3)
    rows = [(n, i, 10 * i + k, float(rng.randrange(50)) if rng.random() > 0.1 else None) for n in ("a", "b", None) for i in range(900) for k in range(rng.randrange(3))]
    rows += [("a", None, s, 1.0) for s in (2, 1)] + [("b", 4, None, 2.0)]
    schema = "name string, iteration long, seq long, value double"
    want = H.rolling(spark.createDataFrame(rows, schema), 5)
    want = sorted((str(r.name), str(r.iteration), str(r.seq), str(r.value), str(r["median"]), f"{r['mean'] or 0:.9f}") for r in want.collect())
    for seed in (1, 2):
        mixed = list(rows)
        random.Random(seed).shuffle(mixed)
        cuts = [0, 40, 45, 1200, len(mixed)]
        out, _ = run_parts(spark, lambda s: W.rolling_stream(s, 5), [mixed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], schema)
        got = W.revised(out).collect()
        assert sorted((str(r.name), str(r.iteration), str(r.seq), str(r.value), str(r["median"]), f"{r['mean'] or 0:.9f}") for r in got) == want


def test_rolling_stream_keeps_a_long_series(spark):
    """1.1 million rows of a name, the oldest last: rows beyond the newest million were dropped."""
    at, n = catalog.new_folder(spark, "long"), 1_100_000
    rows = spark.range(n).select(F.lit("a").alias("name"), F.col("id").alias("iteration"), F.lit(0).cast("long").alias("seq"), (F.col("id") % 7).cast("double").alias("value"))
    for part in (rows.filter("iteration >= 500"), rows.filter("iteration < 500")):
        part.coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.02)
    out = catalog.finished(W.rolling_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at), 2), "long")
    done = W.revised(out)
    assert out.filter("iteration = -1").count() == 0 and done.count() == n
    assert {r.iteration: r.mean for r in done.filter("iteration IN (0, 499, 500)").collect()} == {0: 0.0, 499: 1.5, 500: 2.5}


def test_rolling_stream_is_bounded(spark):
    schema = "name string, iteration long, seq long, value double"
    parts = [[("a", i, 0, float(i)) for i in range(a, a + 1000)] for a in range(0, 5000, 1000)]
    out, checkpoint = run_parts(spark, lambda s: W.rolling_stream(s, 5, keep=600), [*parts, [("a", 10, 1, 9.0), ("a", 4990, 1, 9.0)]], schema)
    held = spark.read.format("statestore").option("stateVarName", "buckets").load(checkpoint).select(F.size("user_map_value.seq").alias("n")).collect()
    assert 600 <= sum(r.n for r in held) < 600 + W._Series.SPAN + 2
    assert [r.seq for r in out.filter("iteration = -1").collect()] == [1]
    # of the last part the late row and the rows whose windows hold it are given out
    assert sorted((r.iteration, r.seq) for r in out.filter("revision = 6 AND iteration >= 0").collect()) == [(4990, 0 + 1), *((i, 0) for i in range(4991, 4995))]


def test_lines_are_written_once(spark, tmp_path):
    lines = spark.createDataFrame([("{}",)] * 3, "line string")
    at = catalog.new_folder(spark, "lines")
    lines.coalesce(1).write.parquet(at)
    for _ in range(2):
        W.write_lines(spark.readStream.schema("line string").parquet(at), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    assert spark.read.text(f"{tmp_path}/out").count() == 3


def test_tiles_change_no_neighbour(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(90, 4)), 1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    whole = {(r.q_id, r["rank"], r.g_id) for r in D.nearest(df, df, 5).collect()}
    d = np.round(((x[:, None] - x[None]) ** 2).sum(2), 9)
    plain = {(i, k + 1, int(j)) for i in range(90) for k, j in enumerate(sorted(range(90), key=lambda j: (d[i, j], j))[:5])}
    assert whole == plain
    assert {(r.q_id, r["rank"], r.g_id) for r in D.nearest(df, df, 5, rows=7).collect()} == plain
    assert D._block_rows(90, 90, 4, 4, 7) == 22 and D._block_rows(10**9, 10**9, 64, 4, 2048) == 65536 and D._block_rows(9, 9, 64, 4, 2048) == 2048


def test_hub_columns_in_runs(spark, monkeypatch):
    """A column that many rows share is cut into runs; sums of minima stay the same."""
    rnd = random.Random(9)
    rows = [(i, j, rnd.random()) for i in range(40) for j in sorted({0, 1, rnd.randrange(2, 60), rnd.randrange(2, 60)})]
    v = spark.createDataFrame(rows, "i long, j long, v double")
    own = {}
    for i, j, x in rows:
        own.setdefault(i, {})[j] = x
    want = {(i, k): max(0.0, 1 - t / (2 - t)) for i in own for k in own if (t := sum(min(x, own[k].get(j, 0.0)) for j, x in own[i].items()))}
    for most in (4096, 7):
        monkeypatch.setattr(J, "HUB_ROWS", most)
        got = {(r.i, r.k): r.dist for r in J.jaccard_of(v).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
        few = {(r.i, r.k) for r in J.jaccard_of(v, v.filter("i < 3").selectExpr("i AS vec_id"), v.filter("i > 30").selectExpr("i AS vec_id")).collect()}
        assert few == {x for x in want if x[0] < 3 and x[1] > 30}


SERIES = "name string, iteration long, seq long, value double"


def in_many_ranges(spark, parts=7):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)


@pytest.fixture
def ranges(spark):
    """Sorts are dealt to many ranges, so that one series is in several tasks."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    in_many_ranges(spark)
    yield 7
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def plain_rolling(rows, n):
    out = {}
    for name in {r[0] for r in rows}:
        line = sorted((r for r in rows if r[0] == name), key=lambda r: (r[1] if r[1] is not None else -1, r[2]))
        for k, r in enumerate(line):
            last = [x[3] for x in line[max(0, k - n + 1) : k + 1] if x[3] is not None]
            ever = [x[3] for x in line[: k + 1] if x[3] is not None]
            out[r] = tuple(f(v) if v else None for f, v in ((np.median, last), (np.mean, last), (np.mean, ever)))
    return out


@pytest.mark.parametrize("n", [1, 2, 20, 200])
def test_one_series_in_many_ranges(spark, ranges, n):
    rng = random.Random(n)
    rows = [("a", i // 3, i, float(rng.randrange(90)) if rng.random() > 0.1 else None) for i in range(300)]
    rows += [(None, 1, 1, 5.0), (None, None, 2, 6.0), ("b", 0, 0, None), *[("c", i, 0, float(i)) for i in range(5)]]
    df = spark.createDataFrame(rows, SERIES)
    assert H.in_ranges(df, "name", "iteration", "seq").filter("name = 'a'").select("_part").distinct().count() > 3
    got = {(r.name, r.iteration, r.seq, r.value): (r["median"], r["mean"], r.global_mean) for r in H.rolling(df, n).collect()}
    want = plain_rolling(rows, n)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-9)) for a, b in zip(got[k], v, strict=True)), k


def test_rolling_has_no_window_over_a_whole_name(spark):
    df = spark.createDataFrame([("a", 1, 1, 1.0)], SERIES)
    plan = H.rolling(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("_part" in x or "_n_of" in x or "collect_list" in x for x in windows)


def plain_throttle(rows, seconds):
    last, kept = {}, []
    for seq, caller, ts in sorted(rows, key=lambda r: (str(r[1]), r[2] is not None, r[2] or 0, r[0])):
        if ts is None or caller not in last or ts - last[caller] >= timedelta(seconds=seconds):
            kept.append(seq)
            if ts is not None:
                last[caller] = ts
    return sorted(kept)


@pytest.mark.parametrize("seconds", [0.5, 3, 40, 10_000])
def test_one_caller_in_many_ranges(spark, ranges, seconds):
    rng = random.Random(int(seconds))
    start = datetime(2024, 1, 1)
    rows = [(i, "hot", start + timedelta(seconds=rng.choice([0.1, 1, 2, 3, 17]) * rng.randrange(100))) for i in range(500)]
    rows += [(600 + i, rng.choice(["x", "y", None]), start + timedelta(seconds=rng.randrange(99))) for i in range(60)] + [(900, "hot", None), (901, "x", None)]
    df = spark.createDataFrame(rows, "seq long, caller string, ts timestamp_ntz")
    assert H.in_ranges(df, "caller", "ts", "seq").filter("caller = 'hot'").select("_part").distinct().count() > 3
    out = H.every_n_seconds(df, seconds)
    assert out.columns == df.columns and sorted(r.seq for r in out.collect()) == plain_throttle(rows, seconds)


def test_passage_composes_as_a_loop():
    rng = np.random.default_rng(1)
    for _ in range(60):
        t = np.sort(rng.integers(0, 300, rng.integers(1, 80)))
        least = int(rng.integers(1, 120))
        bounds, exits = H._passage(t, least)
        for entry in [None, *range(int(t[0]) - 130, int(t[0]) + 1)]:
            last = entry
            for x in t.tolist():
                if last is None or x - last >= least:
                    last = x
            at = 0 if entry is None else int(np.searchsorted(bounds, entry + least))
            assert (int(exits[at]) if at < len(bounds) else entry) == last


def plain_nearest(x, y, k, metric):
    d = np.round(D.matrix(x, y, metric), 9)
    return {(i, r + 1, int(j)) for i in range(len(x)) for r, j in enumerate(sorted(range(len(y)), key=lambda j: (d[i, j], j))[:k])}


@pytest.mark.parametrize("metric", ["sqeuclidean", "euclidean", "cosine", "cosine2"])
def test_cells_skip_pairs_and_change_nothing(spark, metric):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 6)) * 8
    x = np.round(centres[rng.integers(0, 12, 260)] + rng.normal(size=(260, 6)) * 0.2, 2)
    y = np.round(centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 6)) * 0.2, 2)
    y[40] = y[7]  # a tie
    q, g = (spark.createDataFrame([*((i, [float(v) for v in r]) for i, r in enumerate(z)), (999, None)], "vec_id long, embedding array<double>") for z in (x, y))
    made = D.Cells(*(df.filter("embedding IS NOT NULL").withColumnRenamed("vec_id", c) for df, c in ((q, "q_id"), (g, "g_id"))), 5, metric, 30, 0)
    assert made.skipped > 0.5
    got = {(r.q_id, r["rank"], r.g_id) for r in D.nearest(q, g, 5, metric, rows=16, cells=30).collect()}
    assert got == plain_nearest(x, y, 5, metric)
    assert {(r.q_id, r["rank"], r.g_id) for r in D.nearest(q, g, 5, metric).collect()} == got


def test_cells_on_clustered_vectors_and_where_nothing_can_be_skipped(spark, sf_dir):
    from pathline.sources.views import load

    f = load(spark, sf_dir, "clustered").select("vec_id", "embedding")
    plain = {(r.q_id, r["rank"], r.g_id) for r in D.nearest(f, f, 20).collect()}
    assert {(r.q_id, r["rank"], r.g_id) for r in D.nearest(f, f, 20, cells=40).collect()} == plain
    few = f.limit(4)
    assert D.nearest(few, few, 9, cells=3).count() == 16 and D.nearest(f.limit(0), f, 3, cells=4).count() == 0 and D.nearest(f, f.limit(0), 3, cells=4).count() == 0


def test_metric_lines_and_table_with_odd_names(spark):
    import json

    names = ['a"b', "back\\slash", "tab\there", "line\nbreak", "plain", "é中"]
    rows = [(n, 1, k, float(k)) for k, n in enumerate(names)] + [("plain", 1, 99, 7.0), ("plain", 2, 0, 1.0), (None, 1, 5, 5.0), ("none", 2, 1, None)]
    df = spark.createDataFrame(rows, SERIES)
    lines = {json.loads(r.line)["iteration"]: json.loads(r.line) for r in S.metric_lines(df).collect()}
    assert lines == {1: {"iteration": 1, **{n: float(k) for k, n in enumerate(names)}, "plain": 7.0}, 2: {"iteration": 2, "plain": 1.0}}
    table = {r.iteration: r.asDict() for r in S.metric_table(df).collect()}
    assert table[1] == {**lines[1], "none": None} and table[2]["plain"] == 1.0 and table[2]["é中"] is None


def test_detections_of_a_batch_are_one_frame():
    """There was a pandas frame for each image, whose making took most of the time."""
    import pandas as pd

    class Rows:
        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            return run

    boxes = [[1.0, 2.0, 3.0, 4.0, 0.5, 1.0] * n for n in (2, 1)]
    frames = pd.DataFrame({"camera_id": [0, 2], "frame": [7, 9], "pixels": boxes, "h": [2, 1], "w": [2, 2]})
    model = lambda: lambda image: image.reshape(-1, 6)
    out = list(U.detect_frames(Rows(), model)(iter([frames, frames.iloc[:0]])))
    assert len(out) == 2 and len(out[1]) == 0
    assert [tuple(r) for r in out[0][["camera_id", "frame", "y2", "cls"]].to_numpy()] == [(0, 7, 4.0, 1), (0, 7, 4.0, 1), (2, 9, 4.0, 1)]
