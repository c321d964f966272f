"""The tracker against a plain loop with full 7 x 7 matrices, and its table forms against each other."""

import itertools
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathline.operators import assignment as A
from pathline.operators import detections as P
from pathline.operators import tracking as T
from pathline.plans import catalog
from pathline.streaming.online import track_stream

DET = "det_id long, camera_id int, frame int, x1 double, y1 double, x2 double, y2 double"


class Plain:
    """One track as a textbook filter of seven states."""

    def __init__(self, box, number):
        self.F = np.eye(7)
        self.F[[0, 1, 2], [4, 5, 6]] = 1
        self.H = np.eye(4, 7)
        self.P = np.diag([10.0] * 4 + [1e4] * 3)
        self.Q = np.diag([1, 1, 1, 1, 0.01, 0.01, 0.0001])
        self.R = np.diag([1.0, 1, 10, 10])
        self.x = np.concatenate([self.z(box), np.zeros(3)])
        self.number, self.missed, self.row = number, 0, 0

    @staticmethod
    def z(b):
        w, h = b[2] - b[0], b[3] - b[1]
        return np.array([b[0] + w / 2, b[1] + h / 2, w * h, w / h if h else 0.0])

    def predict(self):
        if self.x[2] + self.x[6] <= 0:
            self.x[6] = 0
        self.x = self.F @ self.x
        self.P = self.F @ self.P @ self.F.T + self.Q
        if self.missed:
            self.row = 0
        self.missed += 1

    def update(self, box):
        s = self.H @ self.P @ self.H.T + self.R
        k = self.P @ self.H.T @ np.linalg.inv(s)
        self.x = self.x + k @ (self.z(box) - self.H @ self.x)
        self.P = (np.eye(7) - k @ self.H) @ self.P
        self.missed, self.row = 0, self.row + 1

    def box(self):
        x, y, s, r = self.x[:4]
        w = max(s * r, 0) ** 0.5
        h = s / w if w else 0.0
        return [x - w / 2, y - h / 2, x + w / 2, y + h / 2]


def plain_track(frames, last, p=T.Tracking()):
    live, born, out = [], 0, []
    for f in range(1, last + 1):
        dets = frames.get(f, [])
        for t in live:
            t.predict()
        boxes = np.array([t.box() for t in live]).reshape(-1, 4)
        found = A.associate(np.array(dets).reshape(-1, 4), boxes, p.iou)
        for d, t in found:
            live[t].update(dets[d])
        for d in range(len(dets)):
            if d not in {a for a, _ in found}:
                born += 1
                live.append(Plain(dets[d], born))
        out += [(f, t.number, *t.box()) for t in live if t.missed < 1 and (t.row >= p.min_hits or f <= p.min_hits)]
        live = [t for t in live if t.missed <= p.max_age]
    return sorted(out)


def table(spark, frames, camera=0):
    rows = [(1000 * f + k, camera, f, *map(float, b)) for f, boxes in frames.items() for k, b in enumerate(boxes)]
    return spark.createDataFrame(rows, DET)


def walk(seed, last=60, gap=None):
    rnd, frames = random.Random(seed), {}
    for f in range(1, last + 1):
        if gap and gap[0] <= f < gap[1]:
            continue
        boxes = [(50 * k + 3 * f * (-1) ** k + rnd.uniform(-2, 2), 10.0 + rnd.uniform(-1, 1)) for k in range(5) if rnd.random() < 0.8]
        if boxes:
            frames[f] = [(x, y, x + 30 + k, y + 60) for k, (x, y) in enumerate(boxes)]
    return frames


def got(df):
    return sorted((r.frame, r.track_id, r.x1, r.y1, r.x2, r.y2) for r in df.collect())


def check(a, b):
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert np.allclose([x[2:] for x in a], [x[2:] for x in b], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("gap", [None, (20, 50), (20, 52), (20, 53)])
def test_as_the_plain_loop(spark, seed, gap):
    frames = walk(seed, 90, gap)
    want = plain_track(frames, 90)
    check(got(T.track(table(spark, frames))), want)
    check(got(T.track(table(spark, frames), cut=False)), want)


def test_assignment_is_best():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        n, m = rnd.integers(1, 6, 2).tolist()
        g = rnd.random((n, m))
        small, large = min(n, m), max(n, m)
        h = g if n <= m else g.T
        best = max(sum(h[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(large), small))
        pairs = A.assignment(g)
        assert len(pairs) == small and len({a for a, _ in pairs}) == len({b for _, b in pairs}) == small
        assert abs(sum(g[a, b] for a, b in pairs) - best) < 1e-9


def proven(rows):
    """The pairs of the largest total, whose potentials prove it."""
    column, u, v = A.best_pairs(rows)
    gain = [dict(r) for r in rows]
    used = [c for c in column if c >= 0]
    assert len(used) == len(set(used))
    total = sum(gain[r][c] for r, c in enumerate(column) if c >= 0)
    assert min([0.0, *u, *v.values()]) >= 0
    assert all(u[r] + v.get(c, 0.0) >= g - 1e-9 for r, row in enumerate(rows) for c, g in row)
    assert abs(sum(u) + sum(v.values()) - total) < 1e-6 * max(1, total)
    return total


def test_potentials_prove_the_best_total():
    rnd = random.Random(6)
    for _ in range(300):
        n, m = rnd.randrange(1, 6), rnd.randrange(1, 6)
        rows = [[(c, rnd.choice([0.25, 0.5, rnd.random()])) for c in range(m) if rnd.random() < 0.6] for _ in range(n)]
        gain = [dict(r) for r in rows]
        best = max(sum(gain[r].get(c, 0.0) for r, c in enumerate(p) if c >= 0) for p in itertools.product(range(-1, m), repeat=n) if len([c for c in p if c >= 0]) == len({c for c in p if c >= 0}))
        assert abs(proven(rows) - best) < 1e-9
    for n in (40, 300):  # chains, where paths are long
        rows = [[(k, 1 + rnd.random()), (k + 1, 1 + rnd.random())] for k in range(n)]
        rnd.shuffle(rows)
        proven(rows)


def test_sweep_finds_all_overlaps():
    rng = np.random.default_rng(8)
    for n, m in ((1, 1), (30, 50), (200, 7)):
        a, b = (np.concatenate([x := rng.uniform(0, 200, (k, 2)), x + rng.uniform(0, 40, (k, 2)) ** rng.choice([1, 1.2])], axis=1) for k in (n, m))
        i, j, o = A.overlapping(a, b, together=9)
        full = A.iou_matrix(a, b)
        want = np.nonzero(full > 0)
        assert (i == want[0]).all() and (j == want[1]).all() and (o == full[want]).all()


def test_a_frame_of_5000_boxes_needs_no_matrix(monkeypatch):
    rng = np.random.default_rng(9)
    at = rng.uniform(0, 20_000, (5000, 2))
    tracks = np.concatenate([at, at + rng.uniform(20, 60, (5000, 2))], axis=1)
    dets = (tracks + rng.normal(size=(5000, 4)) * 3)[rng.permutation(5000)]
    sizes = []
    real = A._overlap
    monkeypatch.setattr(A, "_overlap", lambda a, b: sizes.append(np.broadcast(a[..., 0], b[..., 0]).size) or real(a, b))
    began = time.time()
    found = A.associate(dets, tracks, 0.3)
    assert len(found) > 4000 and max(sizes) <= A._TOGETHER and sum(sizes) < 5000 * 5000 / 20 and time.time() - began < 20
    i, j, o = A.overlapping(dets, tracks)
    rows = [[] for _ in range(5000)]
    for r, c, g in zip(i.tolist(), j.tolist(), o.tolist(), strict=True):
        rows[r].append((c, g))
    gain = [dict(r) for r in rows]
    assert abs(proven(rows) - sum(gain[r][c] for r, c in A.solved(i, j, o, 5000, 5000))) < 1e-6


def test_threshold_of_both_paths():
    a = np.array([[0.0, 0, 10, 10]])
    b = np.array([[0.0, 0, 10, 5]])  # half of it
    thr = float(A.iou_matrix(a, b)[0, 0])
    assert A.associate(a, b, thr) == [(0, 0)]  # not above it, but the best pairs may equal it
    assert A.associate(a, b, thr + 1e-9) == []


def test_warm_up_and_late_birth(spark):
    one = {f: [(0, 0, 10, 20)] for f in range(1, 11)}
    assert {r[0] for r in got(T.track(table(spark, one)))} == set(range(1, 11))
    late = {f: [(0, 0, 10, 20)] for f in range(10, 20)}
    assert min(r[0] for r in got(T.track(table(spark, late)))) == 13


def test_bad_rows_and_nothing(spark):
    rows = [(1, 0, 1, 0.0, 0.0, 1.0, 1.0), (2, 0, 1, float("nan"), 0.0, 1.0, 1.0), (3, 0, 1, None, 0.0, 1.0, 1.0), (4, None, 1, 0.0, 0.0, 1.0, 1.0)]
    assert len(got(T.track(spark.createDataFrame(rows, DET)))) == 1
    assert got(T.track(spark.createDataFrame([], DET))) == []


def test_greedy_suppression(spark):
    rnd = random.Random(4)
    rows = [(k, 0, k % 3, x := rnd.uniform(0, 60), y := rnd.uniform(0, 60), x + 20, y + 20, round(rnd.random(), 2), k % 2) for k in range(90)]
    df = spark.createDataFrame(rows, DET + ", score double, cls int")
    want = set()
    for f in range(3):
        left, kept = sorted((r for r in rows if r[2] == f), key=lambda r: (-r[7], r[0])), []
        for r in left:
            if all(k[8] != r[8] or A.iou_matrix(np.array([k[3:7]]), np.array([r[3:7]]))[0, 0] <= 0.3 for k in kept):
                kept.append(r)
        want |= {r[0] for r in kept}
    assert {r.det_id for r in P.suppress(df).collect()} == want


def test_stream_gives_the_same(spark, sf_dir):
    batch = catalog.QUERIES["track_batch"](spark, sf_dir)
    stream = catalog.QUERIES["track_stream"](spark, sf_dir)
    assert batch.exceptAll(stream).isEmpty() and stream.exceptAll(batch).isEmpty()


def test_stream_drops_late_frames(spark):
    rows = [(1, 0, 1, 0.0, 0.0, 9.0, 9.0), (2, 0, 2, 0.0, 0.0, 9.0, 9.0), (3, 0, 3, 0.0, 0.0, 9.0, 9.0)]
    late = [(9, 0, 1, 5.0, 5.0, 8.0, 8.0), (10, 0, 5, 0.0, 0.0, 9.0, 9.0)]
    out = online(spark, [rows, late], DET)
    assert [r.track_id for r in out if r.frame == -1] == [1]
    assert {r.frame for r in out if r.frame > 0} == {1, 2, 3}


TIMED = DET + ", ts timestamp"


def moved(n=40, cameras=(0, 1), stop=None, start=1):
    """Two boxes of each camera over n frames, one a second; camera `stop[0]` falls silent after frame `stop[1]`."""
    at = lambda f: datetime(2024, 1, 1) + timedelta(seconds=f)
    rows = []
    for f in range(start, n + 1):
        for c in cameras:
            if stop is None or c != stop[0] or f <= stop[1]:
                rows += [(1000 * c + 10 * f + k, c, f, 30.0 * k + f, 5.0, 30.0 * k + f + 20, 40.0, at(f)) for k in (0, 1)]
    return rows


def clock(frame, seconds):
    return (None, None, frame, None, None, None, None, datetime(2024, 1, 1) + timedelta(seconds=seconds))


def parts_of(spark, parts, schema, at=None):
    """Each part as a file, in order of time."""
    at = at or catalog.new_folder(spark, "parts")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.02)
    return at


def online(spark, parts, schema, delay=None, at=None, checkpoint=None):
    """All rows that the stream gives for parts, each a micro-batch; a checkpoint goes on where it stopped."""
    at = parts_of(spark, parts, schema, at)
    stream = track_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at), delay=delay)
    checkpoint = checkpoint or catalog.new_folder(spark, "state")
    out = f"{checkpoint}-out"
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect()


def key(rows):
    return sorted(tuple(r) for r in rows)


def test_idle_camera_is_closed_by_the_watermark(spark):
    rows = moved(stop=(1, 12))
    want = key(T.track(spark.createDataFrame(rows, TIMED)).collect())
    cut = [[r for r in rows if a <= r[2] < b] for a, b in ((1, 12), (12, 25), (25, 41))]
    # camera 0 goes on and moves the time, so the last frame of camera 1 comes; its own last one waits
    out = key(online(spark, cut, TIMED, delay="5 seconds"))
    assert out == [r for r in want if not (r[0] == 0 and r[1] == 40)]
    assert any(r[0] == 1 and r[1] == 12 for r in out)
    # time alone closes the rest: no flush
    assert key(online(spark, [*cut, [clock(0, 100)]], TIMED, delay="5 seconds")) == want
    # without a delay the silent camera waits
    assert not any(r[0] == 1 and r[1] == 12 for r in key(online(spark, cut, TIMED)))


def test_rows_behind_the_watermark_are_counted(spark):
    rows = moved(20)
    late = [(1, 0, 3, 0.0, 0.0, 9.0, 9.0, datetime(2024, 1, 1)), (2, 0, 4, 0.0, 0.0, 9.0, 9.0, None), (3, 1, 20, 0.0, 0.0, 9.0, 9.0, datetime(2024, 1, 1))]
    out = online(spark, [rows, [clock(0, 500)], late], TIMED, delay="1 second")
    assert {(r.camera_id, r.track_id) for r in out if r.frame == -1} == {(0, 2), (1, 1)}
    assert key(r for r in out if r.frame > 0) == key(T.track(spark.createDataFrame(rows, TIMED)).collect())


def test_stream_goes_on_from_its_checkpoint(spark):
    rows = moved(30, stop=(1, 20))
    at, checkpoint = catalog.new_folder(spark, "parts"), catalog.new_folder(spark, "state")
    for a, b in ((1, 9), (9, 10), (10, 31)):  # each a query of its own
        online(spark, [[r for r in rows if a <= r[2] < b]], TIMED, "3 seconds", at, checkpoint)
    out = online(spark, [[clock(0, 900)]], TIMED, "3 seconds", at, checkpoint)
    assert key(out) == key(T.track(spark.createDataFrame(rows, TIMED)).collect())
    state = spark.read.format("statestore").option("stateVarName", "tracks").load(checkpoint)
    assert {"pos", "vel", "cov", "hits"} <= set(state.select("list_element.*").columns) and state.count() > 0


def test_stream_with_null_ids_and_unsound_rows_as_in_batch(spark):
    nan = float("nan")
    rows = [(None, 0, f, 20.0 * k, 0.0, 20.0 * k + 15, 30.0) for f in range(1, 7) for k in range(6)]
    odd = [(5, None, 2, 0.0, 0.0, 9.0, 9.0), (6, 0, None, 0.0, 0.0, 9.0, 9.0), (7, 0, 0, 0.0, 0.0, 9.0, 9.0), (8, 0, 3, nan, 0.0, 9.0, 9.0), (9, 0, 3, None, 0.0, 9.0, 9.0)]
    every = rows + odd
    want = key(T.track(spark.createDataFrame(every, DET)).collect())
    assert len(want) == 36
    out = online(spark, [every[::2], every[1::2], [(1, 0, 99, 0.0, 0.0, 1.0, 1.0)]], DET)
    # frames that a later one has closed are late in the second part; the newest is still open
    assert [r.track_id for r in out if r.frame == -1] == [15]
    whole = online(spark, [[r for r in every if r[2] != 6], [r for r in every if r[2] == 6], [(1, 0, 99, 0.0, 0.0, 1.0, 1.0)]], DET)
    assert key(r for r in whole if r.frame > 0) == want


def test_saved_tracks_go_on_alike():
    rng = np.random.default_rng(4)
    a, b = T.Tracks(T.Tracking()), None
    for f in range(1, 25):
        boxes = np.stack([[x, 0, x + 20, 40 + k] for k, x in enumerate(rng.normal(size=5) * 2 + np.arange(5) * 30 + f)])
        b_before = T.Tracks(T.Tracking())
        b_before.restore(a.frame, a.born, a.save())
        ids, shown = a.step(f, boxes)
        b_ids, b_shown = b_before.step(f, boxes)
        assert (ids == b_ids).all() and (shown == b_shown).all() and a.save() == b_before.save()


def test_summary_and_assignment_tables(spark):
    d = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 9.0, 9.0), (2, 0, 1, 50.0, 0.0, 59.0, 9.0)], DET)
    t = spark.createDataFrame([(0, 1, 7, 1.0, 0.0, 10.0, 9.0), (0, 1, 8, 90.0, 0.0, 99.0, 9.0), (1, 1, 9, 0.0, 0.0, 1.0, 1.0)], "camera_id int, frame int, track_id long, x1 double, y1 double, x2 double, y2 double")
    out = {(r.det_id, r.track_id) for r in T.assign_table(d, t).collect()}
    assert out == {(1, 7), (2, None), (None, 8), (None, 9)}
    e = t.select("camera_id", "track_id", "frame", F.array(F.lit(1.0)).alias("embedding"))
    s = t.withColumns({"ts": F.lit("2024-01-01").cast("timestamp"), "score": F.lit(1.0)})
    assert all(len(r.embeddings) == 1 for r in T.summaries(s, e).collect())


def test_one_camera_in_many_ranges(spark):
    rng = random.Random(2)
    frames, f = [], 0
    for _ in range(400):
        f += rng.choice([0, 1, 1, 1, 2, 31, 32, 33, 60])
        frames.append(f)
    rows = [(k, c, f) for c in (0, 1, None) for k, f in enumerate(frames if c == 0 else frames[:20])] + [(7, 0, None)]
    df = spark.createDataFrame(rows, "det_id long, camera_id int, frame int")
    want = []
    for c in (0, 1, None):
        seen = sorted({f for _, d, f in rows if d == c and f is not None})
        at = {f: sum(b - a >= 32 for a, b in zip(seen, seen[1:], strict=False) if b <= f) for f in seen}
        want += [(k, str(c), str(f), at.get(f, 0)) for k, d, f in rows if d == c]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 9)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got = [(r.det_id, str(r.camera_id), str(r.frame), r.segment) for r in T.segments(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert sorted(got) == sorted(want)
