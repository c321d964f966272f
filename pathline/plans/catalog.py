"""Registered queries on the driver's tables, and the same in SQL where SQL can express it.

Array results are given in long form and floats are rounded, so that both can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathline.functions import boxes as B
from pathline.functions.vectors import doubles, unit
from pathline.operators import detections as P
from pathline.operators import distance as D
from pathline.operators import embeddings as E
from pathline.operators import hooks as U
from pathline.operators import losses as M
from pathline.operators import pose as K
from pathline.operators import rerank as J
from pathline.operators import retrieval as R
from pathline.operators import telemetry as H
from pathline.operators import tracking as T
from pathline.sources import tables as S
from pathline.sources.shared import new_folder, settle
from pathline.sources.views import ctes, load
from pathline.streaming import online as W

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL for it."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """nudge: means of values of two decimals can lie half-way between two results, where engines differ."""
    return df.withColumns({n: F.round(F.col(n) + nudge, digits) + F.lit(0.0) for n in names})


def _split(spark, sf_dir: str, view: str = "features") -> tuple[DataFrame, DataFrame]:
    f = load(spark, sf_dir, view)
    return f.filter("split = 'query'"), f.filter("split = 'gallery'")


def _long(df: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    return df.select(key, F.posexplode(column).alias("pos", "value"))


# --- detections, boxes, tracks, poses --------------------------------------------------------


@query(
    ctes("raw_detections", "rois")
    + """ SELECT det_id, camera_id, frame, round(x1 + coalesce(rx1, 0), 6) AS x1, round(y1 + coalesce(ry1, 0), 6) AS y1,
       round(x2 + coalesce(rx1, 0), 6) AS x2, round(y2 + coalesce(ry1, 0), 6) AS y2, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, frame ORDER BY score DESC, det_id) AS r FROM raw_detections WHERE score > 0.3 AND cls = 0)
LEFT JOIN rois USING (camera_id) WHERE r <= 8 AND x2 - x1 >= 48 AND y2 - y1 >= 110"""
)
def clean_detections(spark, sf_dir):
    p = P.Cleaning(max_det=8, min_w=48, min_h=110)
    return rounded(P.clean(load(spark, sf_dir, "raw_detections"), load(spark, sf_dir, "rois"), p, nms=False), "x1", "y1", "x2", "y2", "score")


_OVER = "(greatest(0.0, least(b.x2, o.x2) - greatest(b.x1, o.x1)) * greatest(0.0, least(b.y2, o.y2) - greatest(b.y1, o.y1)))"
#: Greedy suppression box by box, best first: `kept` are the boxes of the frame that stay so far.
_NMS = f"""
WITH RECURSIVE {ctes("raw_detections", "rois").removeprefix("WITH ")},
o AS (SELECT *, row_number() OVER (PARTITION BY camera_id, frame ORDER BY score DESC, det_id) AS r FROM raw_detections WHERE score > 0.3 AND cls = 0),
g AS (
  SELECT camera_id, frame, r, det_id, true AS stays, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM o WHERE r = 1
  UNION ALL
  SELECT camera_id, frame, r, det_id, stays, CASE WHEN stays THEN list_append(kept, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) ELSE kept END
  FROM (SELECT o.*, g.kept, len(list_filter(g.kept, lambda b: {_OVER} / ((b.x2 - b.x1) * (b.y2 - b.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - {_OVER} + 1e-12) > 0.3)) = 0 AS stays
        FROM g JOIN o ON o.camera_id = g.camera_id AND o.frame = g.frame AND o.r = g.r + 1)),
n AS (SELECT o.* FROM o JOIN g USING (det_id) WHERE stays)"""


@query(_NMS + " SELECT det_id, camera_id, frame FROM n")
def nms(spark, sf_dir):
    return P.suppress(P.confident(load(spark, sf_dir, "raw_detections"))).select("det_id", "camera_id", "frame")


@query(
    _NMS
    + """ SELECT det_id, camera_id, frame, round(x1 + coalesce(rx1, 0), 6) AS x1, round(y1 + coalesce(ry1, 0), 6) AS y1,
       round(x2 + coalesce(rx1, 0), 6) AS x2, round(y2 + coalesce(ry1, 0), 6) AS y2, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, frame ORDER BY score DESC, det_id) AS place FROM n) LEFT JOIN rois USING (camera_id) WHERE place <= 32"""
)
def clean_chain(spark, sf_dir):
    """The whole chain, suppression included."""
    return rounded(P.clean(load(spark, sf_dir, "raw_detections"), load(spark, sf_dir, "rois")), "x1", "y1", "x2", "y2", "score")


_IOU = "(greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
_AREA = "((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1))"


@query(
    ctes("raw_detections")
    + f""" SELECT a.camera_id, a.frame, a.det_id AS a_id, b.det_id AS b_id, round({_IOU} / ({_AREA} - {_IOU} + 1e-12), 6) AS iou
FROM raw_detections a JOIN raw_detections b ON a.camera_id = b.camera_id AND a.frame = b.frame AND a.det_id < b.det_id
WHERE {_IOU} / ({_AREA} - {_IOU} + 1e-12) > 0.3"""
)
def frame_iou_pairs(spark, sf_dir):
    return rounded(P.overlapping(load(spark, sf_dir, "raw_detections")), "iou")


@query(
    ctes("raw_detections")
    + """, z AS (SELECT det_id, x1 + (x2 - x1) / 2 AS x, y1 + (y2 - y1) / 2 AS y, (x2 - x1) * (y2 - y1) AS s,
       CASE WHEN y2 - y1 <> 0 THEN (x2 - x1) / (y2 - y1) ELSE 0 END AS r FROM raw_detections),
w AS (SELECT *, sqrt(greatest(s * r, 0)) AS w FROM z), h AS (SELECT *, CASE WHEN w <> 0 THEN s / w ELSE 0 END AS h FROM w)
SELECT det_id, round(x, 6) AS x, round(y, 6) AS y, round(s, 6) AS s, round(r, 6) AS r, round(x - w / 2, 6) AS x1,
       round(y - h / 2, 6) AS y1, round(x + w / 2, 6) AS x2, round(y + h / 2, 6) AS y2 FROM h"""
)
def box_roundtrip(spark, sf_dir):
    z = load(spark, sf_dir, "raw_detections").select("det_id", B.to_centre("x1", "y1", "x2", "y2").alias("z"))
    return rounded(z.select("det_id", "z.*", B.to_corners("z").alias("b")).select("det_id", "x", "y", "s", "r", "b.*"), "x", "y", "s", "r", "x1", "y1", "x2", "y2")


def _cleaned(spark, sf_dir):
    """Written once: tracking reads its rows more than once."""
    return settle(P.suppress(P.confident(load(spark, sf_dir, "raw_detections"))), "cleaned")


@query()
def track_batch(spark, sf_dir):
    return rounded(T.track(_cleaned(spark, sf_dir)), "x1", "y1", "x2", "y2", digits=4)


@query(
    ctes("raw_detections")
    + """, c AS (SELECT DISTINCT camera_id, frame FROM raw_detections),
g AS (SELECT *, coalesce(frame - lag(frame) OVER (PARTITION BY camera_id ORDER BY frame) >= 32, false) AS n FROM c)
SELECT camera_id, frame, CAST(sum(CASE WHEN n THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id ORDER BY frame) AS BIGINT) AS segment FROM g"""
)
def track_segments(spark, sf_dir):
    return T.segments(load(spark, sf_dir, "raw_detections").select("camera_id", "frame").distinct())


# tracks of a frame are connected if they overlap with one detection; in each component every choice of detections is
# tried, track by track, and the one with the largest total counts
@query(
    "WITH RECURSIVE "
    + ctes("raw_detections", "given_tracks")[5:]
    + """, d AS (SELECT camera_id, frame, det_id, x1, y1, x2, y2 FROM raw_detections WHERE score > 0.3 AND cls = 0),
t AS (SELECT camera_id, frame, track_id, x1, y1, x2, y2 FROM given_tracks),
w AS (SELECT camera_id, frame, det_id, track_id, greatest(0, least(d.x2, t.x2) - greatest(d.x1, t.x1)) * greatest(0, least(d.y2, t.y2) - greatest(d.y1, t.y1)) AS i,
       (d.x2 - d.x1) * (d.y2 - d.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS areas FROM d JOIN t USING (camera_id, frame)),
p AS MATERIALIZED (SELECT camera_id, frame, det_id, track_id, i / (areas - i + 1e-12) AS o FROM w WHERE i > 0),
f AS (SELECT camera_id, frame, max(n) = 1 AS plain FROM (
        SELECT camera_id, frame, count(*) AS n FROM p WHERE o > 0.3 GROUP BY camera_id, frame, det_id
        UNION ALL SELECT camera_id, frame, count(*) AS n FROM p WHERE o > 0.3 GROUP BY camera_id, frame, track_id) GROUP BY camera_id, frame),
q AS MATERIALIZED (SELECT p.* FROM p LEFT JOIN f USING (camera_id, frame) WHERE NOT coalesce(plain, false)),
e AS MATERIALIZED (SELECT DISTINCT a.camera_id, a.frame, a.track_id AS a, b.track_id AS b FROM q a JOIN q b USING (camera_id, frame, det_id)),
r AS (SELECT camera_id, frame, a AS node, a AS seen FROM e UNION SELECT r.camera_id, r.frame, r.node, e.b FROM r JOIN e ON e.camera_id = r.camera_id AND e.frame = r.frame AND e.a = r.seen),
c AS MATERIALIZED (SELECT camera_id, frame, node AS track_id, min(seen) AS comp FROM r GROUP BY ALL),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY camera_id, frame, comp ORDER BY track_id) AS k FROM c),
x AS MATERIALIZED (
  SELECT camera_id, frame, comp, k, track_id, det_id, o FROM n JOIN q USING (camera_id, frame, track_id)
  UNION ALL SELECT camera_id, frame, comp, k, track_id, NULL, 0 FROM n),
s AS (
  SELECT camera_id, frame, comp, 0 AS k, [0::BIGINT] AS used, 0::DOUBLE AS total, []::STRUCT(track_id BIGINT, det_id BIGINT, o DOUBLE)[] AS chosen FROM n WHERE k = 1
  UNION ALL
  SELECT s.camera_id, s.frame, s.comp, s.k + 1, list_append(s.used, coalesce(x.det_id, -1)), s.total + x.o, list_append(s.chosen, {'track_id': x.track_id::BIGINT, 'det_id': x.det_id, 'o': x.o::DOUBLE})
  FROM s JOIN x ON x.camera_id = s.camera_id AND x.frame = s.frame AND x.comp = s.comp AND x.k = s.k + 1 WHERE x.det_id IS NULL OR NOT list_contains(s.used, x.det_id)),
z AS (SELECT camera_id, frame, comp, max(k) AS k FROM n GROUP BY ALL),
b AS (SELECT s.camera_id, s.frame, unnest(arg_max(chosen, total)) AS m FROM s JOIN z USING (camera_id, frame, comp, k) GROUP BY s.camera_id, s.frame, comp),
m AS (
  SELECT camera_id, frame, m.det_id AS det_id, m.track_id AS track_id FROM b WHERE m.det_id IS NOT NULL AND m.o >= 0.3
  UNION ALL SELECT camera_id, frame, det_id, track_id FROM p JOIN f USING (camera_id, frame) WHERE plain AND o > 0.3)
SELECT camera_id, frame, det_id, track_id FROM m
UNION ALL SELECT camera_id, frame, det_id, NULL FROM d WHERE (camera_id, frame, det_id) NOT IN (SELECT (camera_id, frame, det_id) FROM m)
UNION ALL SELECT camera_id, frame, NULL, track_id FROM t WHERE (camera_id, frame, track_id) NOT IN (SELECT (camera_id, frame, track_id) FROM m)"""
)
def assign_detections(spark, sf_dir):
    dets, tracks = P.confident(load(spark, sf_dir, "raw_detections")), load(spark, sf_dir, "given_tracks")
    return T.assign_table(dets, tracks)


@query(
    ctes("given_tracks")
    + """, t AS (SELECT camera_id, track_id, min(ts) AS start_time, max(ts) AS end_time, min(frame) AS start_frame, max(frame) AS end_frame,
       list({'frame': frame, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score} ORDER BY frame, x1, y1, x2, y2, score) AS b
FROM given_tracks GROUP BY ALL)
SELECT camera_id, track_id, start_time, end_time, start_frame, end_frame, CAST(i - 1 AS INT) AS pos, b[i].frame AS frame, round(b[i].x1, 6) AS x1, round(b[i].score, 6) AS score
FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM t)"""
)
def track_summary(spark, sf_dir):
    s = T.summaries(load(spark, sf_dir, "given_tracks"))
    rows = s.select("camera_id", "track_id", "start_time", "end_time", "start_frame", "end_frame", F.posexplode("bboxes").alias("pos", "b"))
    return rounded(rows.select(*[c for c in rows.columns if c != "b"], "b.frame", "b.x1", "b.score"), "x1", "score")


@query(
    ctes("keypoints")
    + """ SELECT det_id, kp, round(kx * (x2 - x1) / 640 + x1, 6) AS px, round(ky * (y2 - y1) / 640 + y1, 6) AS py, round(kscore, 6) AS kscore
FROM keypoints WHERE trunc(greatest(x2, 0)) > trunc(greatest(x1, 0)) AND trunc(greatest(y2, 0)) > trunc(greatest(y1, 0))"""
)
def pose_to_frame(spark, sf_dir):
    return rounded(K.points_in_frame(K.crops(load(spark, sf_dir, "keypoints"))).select("det_id", "kp", "px", "py", "kscore"), "px", "py", "kscore")


@query(
    ctes("keypoints")
    + """, a AS (SELECT det_id, row_number() OVER (PARTITION BY det_id ORDER BY kp) - 1 AS i, kx, ky, kscore FROM keypoints)
SELECT det_id, CAST(i AS INT) AS pos, kx AS x, ky AS y, round(kscore, 6) AS score FROM a"""
)
def pose_scores(spark, sf_dir):
    k = load(spark, sf_dir, "keypoints")
    part = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("kp", c))), lambda t: t[c])
    poses = k.groupBy("det_id").agg(part("kx").alias("xs"), part("ky").alias("ys"), part("kscore").alias("scores"))
    rows = K.with_scores(poses).filter("ok").select("det_id", F.posexplode("points").alias("pos", "p"))
    return rounded(rows.select("det_id", "pos", "p.*"), "score")


@query(ctes("raw_detections") + " SELECT det_id, camera_id, frame, round(x1, 6) AS x1, round(score, 6) AS score, cls FROM raw_detections")
def detections_read(spark, sf_dir):
    """Detections written as files and read with their schema."""
    at = new_folder(spark, "detections")
    load(spark, sf_dir, "raw_detections").write.parquet(at)
    return rounded(S.read_detections(spark, at).select("det_id", "camera_id", "frame", "x1", "score", "cls"), "x1", "score")


@query(ctes("given_tracks") + " SELECT camera_id, track_id, frame, round(x1, 6) AS x1, round(score, 6) AS score FROM given_tracks")
def tracks_written(spark, sf_dir):
    """Tracks written by camera and read back."""
    at = new_folder(spark, "tracks")
    S.write_tracks(load(spark, sf_dir, "given_tracks"), at)
    return rounded(spark.read.parquet(at).select("camera_id", "track_id", "frame", "x1", "score"), "x1", "score")


def _values_as_boxes():
    """A stand-in for a detector: the frame's numbers are the boxes."""
    return lambda image: image.reshape(-1, 6)


@query(ctes("raw_detections") + " SELECT camera_id, frame, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(score, 6) AS score, cls FROM raw_detections")
def detect_hook(spark, sf_dir):
    """U2 with a stand-in model; a frame's pixels are its detections, two pixels of three channels for each."""
    one = F.array("x1", "y1", "x2", "y2", "score", F.col("cls").cast("double"))
    frames = load(spark, sf_dir, "raw_detections").groupBy("camera_id", "frame").agg(F.array_sort(F.collect_list(F.struct("det_id", one.alias("v")))).alias("d"))
    frames = frames.select("camera_id", "frame", F.flatten(F.transform("d", lambda x: x["v"])).alias("pixels"), F.size("d").alias("h"), F.lit(2).alias("w"))
    return rounded(U.detect_frames(frames, _values_as_boxes), "x1", "y1", "x2", "y2", "score")


def _values_as_points():
    """A stand-in for a pose model: a pixel's three numbers are a point."""
    return lambda image: image.reshape(-1, 3)


@query(
    ctes("keypoints")
    + """, a AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY kp) - 1 AS pos FROM keypoints)
SELECT det_id, CAST(pos AS INT) AS pos, kx AS x, ky AS y, round(kscore, 6) AS score FROM a"""
)
def pose_hook(spark, sf_dir):
    """U3 with a stand-in model; the pixels of a crop are its points."""
    points = load(spark, sf_dir, "keypoints").groupBy("det_id").agg(F.array_sort(F.collect_list(F.struct("kp", F.array("kx", "ky", "kscore").alias("v")))).alias("k"))
    crops = points.select("det_id", F.flatten(F.transform("k", lambda x: x["v"])).alias("pixels"), F.size("k").alias("h"), F.lit(1).alias("w"))
    rows = U.estimate_poses(crops, _values_as_points).select("det_id", F.posexplode(F.arrays_zip("xs", "ys", "scores")).alias("pos", "p"))
    return rounded(rows.select("det_id", "pos", F.col("p.xs").alias("x"), F.col("p.ys").alias("y"), F.col("p.scores").alias("score")), "score")


# --- embeddings ------------------------------------------------------------------------------

_NORM = "sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))"
_IP = "list_inner_product"


@query(
    ctes("clustered")
    + f""", n AS (SELECT vec_id, embedding AS e, {_NORM} AS n FROM clustered), u AS (SELECT vec_id, n, unnest(range(0, len(e))) AS pos, unnest(e) AS x FROM n)
SELECT vec_id, CAST(pos AS INT) AS pos, round(x / greatest(n, 1e-12), 6) + 0.0 AS e1, round(x / (n + 1e-12), 6) + 0.0 AS e2 FROM u"""
)
def l2_normalize(spark, sf_dir):
    f = load(spark, sf_dir, "clustered")
    e = doubles("embedding")
    both = f.select("vec_id", F.arrays_zip(unit(e).alias("e1"), unit(e, add=True).alias("e2")).alias("z"))
    return rounded(both.select("vec_id", F.posexplode("z").alias("pos", "z")).select("vec_id", "pos", "z.e1", "z.e2"), "e1", "e2")


@query(
    ctes("features")
    + """, u AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM features)
SELECT vec_id, CAST(i AS INT) AS pos, round((x - i / 100) / sqrt(1 + i / 50 + 1e-5) * (1 + i / 64) + 0.5, 6) + 0.0 AS value FROM u"""
)
def frozen_standardize(spark, sf_dir):
    f, d = load(spark, sf_dir, "features"), range(64)
    out = E.standardised(f, [i / 100 for i in d], [1 + i / 50 for i in d], [1 + i / 64 for i in d], [0.5] * 64)
    return rounded(_long(out, "vec_id"), "value")


@query(
    ctes("features")
    + """, u AS (SELECT vec_id // 50 AS b, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM features),
s AS (SELECT b, pos, avg(x) AS m, var_samp(x) AS v FROM u GROUP BY ALL)
SELECT CAST(pos AS INT) AS pos, round(avg(m), 6) + 0.0 AS mean, round(avg(v), 6) + 0.0 AS var FROM s GROUP BY pos"""
)
def precise_stats(spark, sf_dir):
    f = load(spark, sf_dir, "features").withColumn("batch_id", F.floor(F.col("vec_id") / 50))
    return rounded(E.precise_stats(f, "batch_id", f.select("batch_id").distinct().count()), "mean", "var")


@query(
    ctes("features")
    + """, u AS (SELECT person_id, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM features)
SELECT person_id, CAST(pos AS INT) AS pos, round(avg(x), 6) + 0.0 AS mean, round(max(x), 6) + 0.0 AS max,
       round(power(avg(power(greatest(x, 1e-6), 3)), 1.0 / 3.0), 6) + 0.0 AS gem, round(avg(x) + max(x), 6) + 0.0 AS mean_max,
       round(least(greatest(avg(x), 0.0), 1.0), 6) + 0.0 AS clipped FROM u GROUP BY person_id, pos"""
)
def group_pool(spark, sf_dir):
    return rounded(E.pooled(load(spark, sf_dir, "features"), "person_id"), "mean", "max", "gem", "mean_max", "clipped")


@query(
    ctes("features")
    + """, c AS (SELECT vec_id, embedding[57:64] || embedding[49:56] || embedding[41:48] || embedding[33:40] || embedding[25:32] || embedding[17:24] || embedding[9:16] || embedding[1:8] AS e FROM features)
SELECT vec_id, CAST(unnest(range(0, 64)) AS INT) AS pos, round(CAST(unnest(e) AS DOUBLE), 6) + 0.0 AS value FROM c"""
)
def part_concat(spark, sf_dir):
    f = load(spark, sf_dir, "features").select("vec_id", *[F.slice("embedding", 57 - 8 * k, 8).alias(p) for k, p in enumerate(E.PARTS)])
    return rounded(_long(E.joined_parts(f), "vec_id"), "value")


@query(
    ctes("features")
    + """, u AS (SELECT person_id, vec_id, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM features)
SELECT person_id, CAST(pos AS INT) AS pos, round(list_reduce(list(x ORDER BY vec_id), lambda k, q: k * 0.9 + q * 0.1), 6) + 0.0 AS value FROM u GROUP BY person_id, pos"""
)
def ema_prototype(spark, sf_dir):
    return rounded(E.moving_average(load(spark, sf_dir, "features"), "person_id", "vec_id", 0.9), "value")


@query(
    ctes("clustered")
    + f""", m AS (SELECT vec_id, person_id, embedding AS e, greatest({_NORM}, 1e-12) AS n FROM clustered ORDER BY vec_id DESC LIMIT 8192)
SELECT vec_id, person_id, CAST(unnest(range(0, 64)) AS INT) AS pos, round(unnest(e) / n, 6) + 0.0 AS value FROM m"""
)
def memory_bank(spark, sf_dir):
    bank = E.memory_bank(load(spark, sf_dir, "clustered"), "vec_id")
    return rounded(bank.select("vec_id", "person_id", F.posexplode("embedding").alias("pos", "value")), "value")


_CENTRES = """, u AS (SELECT person_id, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM features),
c AS (SELECT person_id AS class_id, list(m ORDER BY pos) AS w FROM (SELECT person_id, pos, avg(x) AS m FROM u GROUP BY ALL) GROUP BY person_id)"""


@query(
    ctes("features")
    + _CENTRES
    + f""" SELECT vec_id, class_id, round(16 * {_IP}(CAST(embedding AS DOUBLE[]), w) / {_NORM} / sqrt({_IP}(w, w)), 6) + 0.0 AS score FROM features CROSS JOIN c"""
)
def class_scores(spark, sf_dir):
    f = load(spark, sf_dir, "features")
    return rounded(E.class_scores(f, E.class_centres(f), scale=16.0), "score")


@query(
    ctes("features")
    + _CENTRES
    + f""", s AS (SELECT vec_id, class_id, {_IP}(CAST(embedding AS DOUBLE[]), w) AS score FROM features CROSS JOIN c)
SELECT vec_id, class_id, round(score, 6) + 0.0 AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class_id) = 1"""
)
def predicted_class(spark, sf_dir):
    f = load(spark, sf_dir, "features")
    return rounded(E.predicted(E.class_scores(f, E.class_centres(f), cosine=False)), "score")


# --- distances, neighbours, re-ranking -----------------------------------------------------------

_SIDES = f""", q AS (SELECT vec_id AS q_id, person_id AS q_pid, cam_id AS q_cam, CAST(embedding AS DOUBLE[]) AS qe, {_NORM} AS qn FROM {{v}} WHERE split = 'query'),
g AS (SELECT vec_id AS g_id, person_id AS g_pid, cam_id AS g_cam, CAST(embedding AS DOUBLE[]) AS ge, {_NORM} AS gn FROM {{v}} WHERE split = 'gallery')"""
_SQ = f"({_IP}(qe, qe) + {_IP}(ge, ge) - 2 * {_IP}(qe, ge))"
_COS = f"(1 - {_IP}(qe, ge) / qn / gn)"


def _pairs_sql(form: str) -> str:
    return ctes("features") + _SIDES.format(v="features") + f" SELECT q_id, g_id, round({form}, 6) + 0.0 AS dist FROM q CROSS JOIN g"


@query(_pairs_sql(_SQ))
def dist_sqeuclid(spark, sf_dir):
    return rounded(D.pairs(*_split(spark, sf_dir), "sqeuclidean"), "dist")


@query(_pairs_sql(f"sqrt(greatest({_SQ}, 1e-12))"))
def dist_euclid(spark, sf_dir):
    return rounded(D.pairs(*_split(spark, sf_dir), "euclidean"), "dist")


@query(_pairs_sql(_COS))
def dist_cosine(spark, sf_dir):
    return rounded(D.pairs(*_split(spark, sf_dir), "cosine"), "dist")


@query(_pairs_sql(f"2 * {_COS}"))
def dist_cosine2(spark, sf_dir):
    return rounded(D.pairs(*_split(spark, sf_dir), "cosine2"), "dist")


@query(
    ctes("features")
    + _SIDES.format(v="features")
    + f""", d AS (SELECT q_id, g_id, {_SQ} AS dist FROM q CROSS JOIN g), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(dist, 9), g_id) AS rank FROM d)
SELECT q_id, g_id, round(dist, 6) + 0.0 AS dist, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"""
)
def knn(spark, sf_dir):
    return rounded(D.nearest(*_split(spark, sf_dir), 10), "dist")


_KNN = f""", f AS (SELECT vec_id AS id, split, CAST(embedding AS DOUBLE[]) AS e FROM clustered),
d AS MATERIALIZED (SELECT a.id AS i, b.id AS j, {_IP}(a.e, a.e) + {_IP}(b.e, b.e) - 2 * {_IP}(a.e, b.e) AS dist FROM f a CROSS JOIN f b),
k AS MATERIALIZED (SELECT * FROM (SELECT i, j, dist, row_number() OVER (PARTITION BY i ORDER BY round(dist, 9), j) AS rank FROM d) WHERE rank <= 20),
r AS MATERIALIZED (SELECT k.i, k.j FROM k JOIN k o ON o.i = k.j AND o.j = k.i),
h AS MATERIALIZED (SELECT k.i, k.j FROM k JOIN k o ON o.i = k.j AND o.j = k.i WHERE k.rank <= 11 AND o.rank <= 11),
n AS (SELECT i, count(*) AS n FROM h GROUP BY i),
t AS (SELECT r.i, r.j AS c, count(*) AS bo FROM r JOIN h ON h.i = r.j JOIN r s ON s.i = r.i AND s.j = h.j GROUP BY ALL),
x AS (SELECT i, j FROM r UNION SELECT t.i, h.j FROM t JOIN n ON n.i = t.c JOIN h ON h.i = t.c WHERE 3 * bo > 2 * n.n),
e AS (SELECT x.i, x.j, exp(-d.dist) AS e FROM x JOIN d ON d.i = x.i AND d.j = x.j),
v AS (SELECT i, j, e / sum(e) OVER (PARTITION BY i) AS v FROM e),
w AS (SELECT k.i, v.j, sum(v) / 6 AS v FROM k JOIN v ON v.i = k.j WHERE rank <= 6 GROUP BY ALL),
jd AS (SELECT i, k, greatest(0.0, 1 - t / (2 - t)) AS dist FROM (SELECT a.i, b.i AS k, sum(least(a.v, b.v)) AS t FROM w a JOIN w b USING (j) GROUP BY ALL))"""


@query(ctes("clustered") + _KNN[: _KNN.index(",\nh AS")] + " SELECT i, j FROM r")
def k_reciprocal(spark, sf_dir):
    f = load(spark, sf_dir, "clustered")
    near = D.nearest(f, f, 20).select(F.col("q_id").alias("i"), F.col("g_id").alias("j"), "rank")
    return J.reciprocal(near, 20)


@query(
    ctes("clustered")
    + _KNN
    + """ SELECT q.id AS q_id, g.id AS g_id, round(coalesce(jd.dist, 1), 6) + 0.0 AS dist
FROM f q CROSS JOIN f g LEFT JOIN jd ON jd.i = q.id AND jd.k = g.id WHERE q.split = 'query' AND g.split = 'gallery'"""
)
def dist_jaccard(spark, sf_dir):
    return rounded(D.pairs(*_split(spark, sf_dir, "clustered"), "jaccard"), "dist")


@query(ctes("clustered") + _KNN + " SELECT i, k, round(dist, 6) + 0.0 AS dist FROM jd")
def jaccard(spark, sf_dir):
    return rounded(J.jaccard(load(spark, sf_dir, "clustered")), "dist")


@query(
    ctes("clustered")
    + _KNN
    + f""", c AS (SELECT a.id AS q_id, b.id AS g_id, 1 - {_IP}(a.e, b.e) / sqrt({_IP}(a.e, a.e)) / sqrt({_IP}(b.e, b.e)) AS dist
      FROM f a CROSS JOIN f b WHERE a.split = 'query' AND b.split = 'gallery')
SELECT q_id, g_id, round(0.7 * coalesce(jd.dist, 1) + 0.3 * c.dist, 6) + 0.0 AS dist FROM c LEFT JOIN jd ON jd.i = q_id AND jd.k = g_id"""
)
def rerank(spark, sf_dir):
    return rounded(J.rerank(*_split(spark, sf_dir, "clustered")), "dist")


@query(
    ctes("clustered")
    + _SIDES.format(v="clustered")
    + f""", d AS (SELECT q_id, qe, qn, ge, gn, {_COS} AS dist, g_id FROM q CROSS JOIN g),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY round(dist, 9), g_id) <= 5),
a AS (SELECT q_id, 1.0 AS w, qe AS e, qn AS n FROM q UNION ALL SELECT q_id, power(1 - dist, 3), ge, gn FROM k),
u AS (SELECT q_id, w / n AS w, unnest(range(0, 64)) AS pos, unnest(e) AS x FROM a),
s AS (SELECT q_id, pos, sum(w * x) AS x FROM u GROUP BY ALL)
SELECT q_id AS vec_id, CAST(pos AS INT) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY q_id)), 6) + 0.0 AS value FROM s"""
)
def aqe(spark, sf_dir):
    return rounded(J.query_expansion(*_split(spark, sf_dir, "clustered")), "value")


# --- retrieval -----------------------------------------------------------------------------------

_ROWS = (
    ctes("clustered")
    + _SIDES.format(v="clustered")
    + f""", m AS (SELECT q_id, g_id, g_cam, {_COS} AS dist, CAST(q_pid = g_pid AS INT) AS match FROM q CROSS JOIN g WHERE NOT (q_pid = g_pid AND q_cam = g_cam)),
k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(dist, 9), g_id) AS rank FROM m),
p AS (SELECT q_id, avg(h / rank) AS ap, min(rank) AS first_match FROM (SELECT q_id, rank, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS h FROM k WHERE match = 1) GROUP BY q_id)"""
)


@query(_ROWS + " SELECT q_id, g_id, g_cam, match, CAST(rank AS INT) AS rank, round(1 - dist, 6) + 0.0 AS similarity FROM k WHERE rank <= 5")
def rank_list(spark, sf_dir):
    rows = R.firsts_of(*_split(spark, sf_dir, "clustered")).withColumn("similarity", 1 - F.col("dist"))
    return rounded(rows.select("q_id", "g_id", "g_cam", "match", F.col("place").alias("rank"), "similarity"), "similarity")


@query(
    _ROWS
    + """ SELECT q_id, g_id, round(dist, 6) + 0.0 AS dist, CAST(place AS INT) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(dist, 9) DESC, g_id) AS place FROM m WHERE match = 1) WHERE place <= 5"""
)
def true_matches(spark, sf_dir):
    rows = R.firsts_of(*_split(spark, sf_dir, "clustered"), matches=True, farthest_first=True)
    return rounded(rows.select("q_id", "g_id", "dist", "place"), "dist")


@query(_ROWS + " SELECT q_id, round(ap, 6) + 0.0 AS ap, CAST(first_match AS INT) AS first_match FROM p ORDER BY round(ap, 9), q_id LIMIT 100")
def worst_queries(spark, sf_dir):
    return rounded(R.worst_queries(R.average_precision_of(*_split(spark, sf_dir, "clustered"))), "ap")


@query(
    _ROWS
    + """ SELECT count(*) AS queries, round(avg(ap), 6) AS map, round(avg(CAST(first_match <= 1 AS INT)), 6) AS cmc1,
       round(avg(CAST(first_match <= 5 AS INT)), 6) AS cmc5, round(avg(CAST(first_match <= 10 AS INT)), 6) AS cmc10 FROM p"""
)
def cmc_map(spark, sf_dir):
    return rounded(R.hit_rates(R.average_precision_of(*_split(spark, sf_dir, "clustered"))), "map", "cmc1", "cmc5", "cmc10")


@query(
    _ROWS
    + """, c AS (SELECT round(dist, 6) AS threshold, sum(1 - match) AS p, sum(match) AS n FROM m GROUP BY 1)
SELECT threshold + 0.0 AS threshold, round(sum(n) OVER o / sum(n) OVER (), 6) AS fpr, round(sum(p) OVER o / sum(p) OVER (), 6) AS tpr FROM c WINDOW o AS (ORDER BY threshold DESC)"""
)
def roc(spark, sf_dir):
    return rounded(R.roc_of(*_split(spark, sf_dir, "clustered"), digits=6), "threshold", "fpr", "tpr")


@query(
    _ROWS
    + """, c AS (SELECT round(dist, 6) AS threshold, sum(1 - match) AS p, sum(match) AS n FROM m GROUP BY 1)
SELECT threshold + 0.0 AS threshold, round(sum(n) OVER o / sum(n) OVER (), 6) AS fpr, round(sum(p) OVER o / sum(p) OVER (), 6) AS tpr FROM c WINDOW o AS (ORDER BY threshold DESC)"""
)
def roc_saved(spark, sf_dir):
    """S3: the curve as it is read back, beside its pairs."""
    at, sides = new_folder(spark, "roc"), _split(spark, sf_dir, "clustered")
    S.save_roc(R.roc_of(*sides, digits=6), R.labelled_pairs(*sides), at)
    return rounded(S.load_roc(spark, at)[0], "threshold", "fpr", "tpr")


@query(
    _ROWS
    + """, s AS (SELECT match, min(dist) AS lo, max(dist) AS hi, avg(dist) AS mean, stddev_pop(dist) AS std, count(*) AS n FROM m GROUP BY match),
c AS (SELECT m.match, CAST(least(79, floor((dist - lo) / ((hi - lo) / 80))) AS INT) AS bin, count(*) AS c FROM m JOIN s USING (match) GROUP BY ALL),
b AS (SELECT *, (hi - lo) / 80 AS w FROM s, (SELECT CAST(range AS INT) AS bin FROM range(80)))
SELECT match, bin, round(lo + bin * w, 6) + 0.0 AS edge, round(coalesce(c, 0) / (n * w), 6) + 0.0 AS density, round(mean, 6) AS mean, round(std, 6) AS std,
       round(exp(-power((lo + bin * w - mean) / std, 2) / 2) / (std * sqrt(2 * pi())), 6) + 0.0 AS curve FROM b LEFT JOIN c USING (match, bin)"""
)
def pair_distribution(spark, sf_dir):
    return rounded(R.distribution_of(*_split(spark, sf_dir, "clustered")), "edge", "density", "mean", "std", "curve")


@query(ctes("features") + " SELECT vec_id, person_id FROM features QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY md5(CAST(vec_id AS VARCHAR) || 's'), vec_id) <= 4")
def pk_sample(spark, sf_dir):
    return E.balanced_sample(load(spark, sf_dir, "features"), 4, "s").select("vec_id", "person_id")


@query(
    ctes("features")
    + """, s AS (SELECT CASE split WHEN 'query' THEN 'a' ELSE 'b' END AS set_name, vec_id, person_id FROM features)
SELECT set_name, person_id, vec_id, CAST(dense_rank() OVER (ORDER BY set_name, person_id) - 1 AS INT) AS joint_id FROM s"""
)
def joint_sets(spark, sf_dir):
    q, g = _split(spark, sf_dir)
    return E.joint_sets({"a": q, "b": g})


# --- losses ----------------------------------------------------------------------------------------

_ALL = f""", a AS (SELECT vec_id AS id, person_id AS pid, CAST(embedding AS DOUBLE[]) AS e, {_NORM} AS n FROM clustered),
d AS (SELECT x.id AS q_id, y.id AS g_id, x.pid = y.pid AS pos, sqrt(greatest({_IP}(x.e, x.e) + {_IP}(y.e, y.e) - 2 * {_IP}(x.e, y.e), 1e-12)) AS d,
      {_IP}(x.e, y.e) / x.n / y.n AS s FROM a x CROSS JOIN a y),
hm AS (SELECT q_id, max(CASE WHEN pos THEN d ELSE 0 END) AS ap, min(CASE WHEN pos THEN 1e9 ELSE d END) AS an FROM d GROUP BY q_id),
mx AS (SELECT q_id, max(CASE WHEN pos THEN d ELSE 0 END) AS m FROM d GROUP BY q_id),
wm AS (SELECT q_id, sum(d * exp(d - m)) FILTER (WHERE pos) / (sum(exp(d - m)) FILTER (WHERE pos) + 1e-6) AS ap,
       sum(d * exp(-d)) FILTER (WHERE NOT pos) / (sum(exp(-d)) FILTER (WHERE NOT pos) + 1e-6) AS an FROM d JOIN mx USING (q_id) GROUP BY q_id)"""


def _pair_sql(positive: str, negative: str, own: str = "q_id <> g_id", rows: str = "d") -> str:
    return f""", l AS (SELECT q_id, CASE WHEN pos THEN {positive} ELSE {negative} END AS l, pos FROM {rows} WHERE NOT pos OR {own}),
lm AS (SELECT q_id, pos, max(l) AS m FROM l GROUP BY ALL), ls AS (SELECT q_id, pos, any_value(m) + ln(sum(exp(l - m))) AS x FROM l JOIN lm USING (q_id, pos) GROUP BY ALL),
lx AS (SELECT q_id, sum(x) AS x, count(*) AS c FROM ls GROUP BY q_id)
SELECT q_id, round(CASE WHEN c = 2 THEN greatest(x, 0) + ln(1 + exp(-abs(x))) ELSE 0 END, 4) + 0.0 AS loss FROM lx"""


def _clustered(spark, sf_dir):
    return load(spark, sf_dir, "clustered")


@query(ctes("clustered") + _ALL + " SELECT q_id, round(ap, 6) + 0.0 AS ap, round(an, 6) + 0.0 AS an FROM hm")
def hard_mining(spark, sf_dir):
    return rounded(M.hard_mining(_clustered(spark, sf_dir)), "ap", "an")


@query(ctes("clustered") + _ALL + " SELECT q_id, round(ap, 4) + 0.0 AS ap, round(an, 4) + 0.0 AS an FROM wm")
def weighted_mining(spark, sf_dir):
    return rounded(M.weighted_mining(_clustered(spark, sf_dir)), "ap", "an", digits=4)


@query(ctes("clustered") + _ALL + " SELECT round(avg(greatest(0, ap - an + 0.3)), 4) AS loss FROM hm")
def triplet(spark, sf_dir):
    return rounded(M.triplet(_clustered(spark, sf_dir)), "loss", digits=4)


@query(ctes("clustered") + _ALL + " SELECT round(avg(ln(1 + exp(ap - an))), 4) AS loss FROM wm")
def triplet_soft(spark, sf_dir):
    return rounded(M.triplet(_clustered(spark, sf_dir), margin=0.0, hard=False), "loss", digits=4)


@query(ctes("clustered") + _ALL + _pair_sql("-128 * greatest(1.25 - s, 0) * (s - 0.75)", "128 * greatest(s + 0.25, 0) * (s - 0.25)"))
def circle(spark, sf_dir):
    return rounded(M.circle(_clustered(spark, sf_dir)), "loss", digits=4)


@query(ctes("clustered") + _ALL + _pair_sql("-32 * s", "32 * (s + 0.25)"))
def cosface(spark, sf_dir):
    return rounded(M.cosface(_clustered(spark, sf_dir)), "loss", digits=4)


@query(ctes("clustered") + _ALL + ", db AS (SELECT * FROM d WHERE g_id IN (SELECT id FROM a ORDER BY id DESC LIMIT 8192))" + _pair_sql("-32 * s", "32 * (s + 0.25)", rows="db"))
def cosface_bank(spark, sf_dir):
    f = _clustered(spark, sf_dir)
    return rounded(M.cosface(f, E.memory_bank(f, "vec_id")), "loss", digits=4)


_LOGITS = """, l AS (SELECT vec_id, person_id AS target, [8 * CAST(x AS DOUBLE) FOR x IN embedding[1:10]] AS l, [8 * CAST(x AS DOUBLE) FOR x IN embedding[11:20]] AS t1,
       [8 * CAST(x AS DOUBLE) FOR x IN embedding[21:30]] AS t2 FROM features),
s AS (SELECT vec_id, target, l, [x - ln(list_sum([exp(y) FOR y IN l])) FOR x IN l] AS lp FROM l)"""


def _logits(spark, sf_dir, first=1, scale=8.0):
    return M.logits_of(load(spark, sf_dir, "features"), first, 10, scale)


@query(ctes("features") + _LOGITS + " SELECT round(avg(CAST(len(list_filter(l, lambda x: x > l[target + 1])) < 1 AS INT)), 6) AS accuracy FROM l")
def topk_accuracy(spark, sf_dir):
    return rounded(M.topk_accuracy(_logits(spark, sf_dir)), "accuracy")


@query(
    ctes("features")
    + _LOGITS
    + """, c AS (SELECT -(0.1 / 9 * (list_sum(lp) - lp[target + 1]) + 0.9 * lp[target + 1]) AS x, 0.2 * exp(lp[target + 1]) AS a, lp, target FROM s)
SELECT 'fixed' AS smoothing, round(sum(x) / greatest(count(*) FILTER (WHERE x <> 0), 1), 4) AS loss FROM c
UNION ALL SELECT 'adaptive', round(avg(-(a / 9 * (list_sum(lp) - lp[target + 1]) + (1 - a) * lp[target + 1])), 4) FROM c"""
)
def cross_entropy(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    both = M.cross_entropy(rows).select(F.lit("fixed").alias("smoothing"), "loss").union(M.cross_entropy(rows, eps=-1.0).select(F.lit("adaptive"), "loss"))
    return rounded(both, "loss", digits=4)


@query(ctes("features") + _LOGITS + " SELECT vec_id, round(-0.5 * power(1 - exp(lp[target + 1]), 2) * lp[target + 1], 4) + 0.0 AS loss FROM s")
def focal(spark, sf_dir):
    return rounded(M.focal(_logits(spark, sf_dir)), "loss", digits=4)


@query(
    ctes("features")
    + """, m AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE person_id END AS target, unnest(range(0, 10)) AS i, CAST(unnest(embedding[1:10]) AS DOUBLE) AS x FROM features)
SELECT vec_id, CAST(i AS INT) AS pos, round(64 * CASE WHEN i = target THEN x - 0.35 ELSE x END, 4) + 0.0 AS cosface, round(64 * CASE WHEN i = target THEN cos(acos(x) + 0.35) ELSE x END, 4) + 0.0 AS arcface,
       round(64 * CASE WHEN i = target THEN greatest(1.35 - x, 0) * (x - 0.65) ELSE greatest(x + 0.35, 0) * (x - 0.35) END, 4) + 0.0 AS circle, round(64 * x, 4) + 0.0 AS linear FROM m"""
)
def margin_logits(spark, sf_dir):
    rows = _logits(spark, sf_dir, scale=1.0).withColumn("target", F.expr("CASE WHEN vec_id % 7 = 0 THEN -1 ELSE target END"))
    kinds = ("cosface", "arcface", "circle", "linear")
    out = rows.select("vec_id")
    for k in kinds:
        part = M.margin_logits(rows, k).select("vec_id", F.posexplode("logits").alias("pos", k))
        out = out.join(part, "vec_id" if out.columns == ["vec_id"] else ["vec_id", "pos"])
    return rounded(out, *kinds, digits=4)


def _kl_sql(t: str) -> str:
    soft = lambda c: f"[x / 16 - ln(list_sum([exp(y / 16) FOR y IN {c}])) FOR x IN {c}]"
    return f"SELECT '{t}' AS t, {soft('l')} AS a, {soft(t)} AS b FROM l"


@query(
    ctes("features")
    + _LOGITS
    + f""", p AS ({_kl_sql("t1")} UNION ALL {_kl_sql("t2")}),
k AS (SELECT t, (list_sum([exp(b[i]) * (b[i] - a[i]) FOR i IN range(1, 11)]) + list_sum([exp(a[i]) * (a[i] - b[i]) FOR i IN range(1, 11)])) / 2 AS d FROM p)
SELECT round(avg(x), 4) AS loss FROM (SELECT t, sum(d) * 256 / count(*) AS x FROM k GROUP BY t)"""
)
def jsdiv(spark, sf_dir):
    t1, t2 = (_logits(spark, sf_dir, first).withColumn("teacher", F.lit(str(first))) for first in (11, 21))
    return rounded(M.jsdiv(_logits(spark, sf_dir), t1.union(t2)), "loss", digits=4)


@query(
    ctes("clustered", "features")
    + _ALL
    + _LOGITS.replace(", l AS", ", lg AS").replace("FROM l)", "FROM lg)").replace("s AS (SELECT vec_id, target, l,", "sl AS (SELECT vec_id, target, l,")
    + """ SELECT round(0.2 * (SELECT avg(greatest(0, ap - an + 0.3)) FROM hm)
       + 0.125 * (SELECT avg(-(0.1 / 9 * (list_sum(lp) - lp[target + 1]) + 0.9 * lp[target + 1])) FROM sl), 4) AS loss"""
)
def loss_total(spark, sf_dir):
    parts = {"triplet": M.triplet(_clustered(spark, sf_dir)), "class": M.cross_entropy(_logits(spark, sf_dir))}
    return rounded(M.weighted_total(parts, {"triplet": 0.2, "class": 0.125}), "loss", digits=4)


# --- telemetry ---------------------------------------------------------------------------------------


def _metrics(spark, sf_dir):
    return load(spark, sf_dir, "metrics")


@query(ctes("metrics") + " SELECT seq, 'train/' || name AS name, iteration, value FROM metrics")
def metric_scope(spark, sf_dir):
    return H.scoped(_metrics(spark, sf_dir), "train//").select("seq", "name", "iteration", "value")


@query(ctes("metrics") + " SELECT name, value, iteration FROM metrics QUALIFY row_number() OVER (PARTITION BY name ORDER BY iteration DESC, seq DESC) = 1")
def metric_latest(spark, sf_dir):
    return H.latest(_metrics(spark, sf_dir))


_W = "OVER (PARTITION BY name ORDER BY iteration, seq ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query(ctes("metrics") + f" SELECT name, seq, round(median(value) {_W.format(19)} + 1e-9, 6) AS median, round(avg(value) {_W.format(19)} + 1e-9, 6) AS mean, round(avg(value) {_W.format('UNBOUNDED')} + 1e-9, 6) AS global_mean FROM metrics")
def metric_smooth(spark, sf_dir):
    return rounded(H.rolling(_metrics(spark, sf_dir), 20).select("name", "seq", "median", "mean", "global_mean"), "median", "mean", "global_mean", nudge=1e-9)


@query(ctes("metrics") + " SELECT name, seq FROM metrics QUALIFY row_number() OVER (PARTITION BY name ORDER BY iteration DESC, seq DESC) <= 50")
def metric_bounded(spark, sf_dir):
    return H.bounded(_metrics(spark, sf_dir), 50).select("name", "seq")


@query(
    ctes("metrics")
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY iteration DESC, seq DESC) AS r FROM metrics)
SELECT name, max(iteration) FILTER (WHERE r = 1) AS iteration, round(CASE WHEN bool_or(smoothing_hint AND r = 1) THEN median(value) ELSE max(value) FILTER (WHERE r = 1) END + 1e-9, 6) AS value
FROM r WHERE r <= 20 GROUP BY name"""
)
def metric_latest_smoothed(spark, sf_dir):
    return rounded(H.latest_smoothed(_metrics(spark, sf_dir)), "value", nudge=1e-9)


@query(ctes("metrics") + ", o AS (SELECT CASE WHEN seq % 97 = 0 THEN 'time' ELSE name END AS name, smoothing_hint FROM metrics) SELECT name, count(DISTINCT smoothing_hint) AS hints FROM o GROUP BY name HAVING count(DISTINCT smoothing_hint) > 1")
def hint_violations(spark, sf_dir):
    # some rows under another name: the table itself has no violation
    return H.hint_violations(_metrics(spark, sf_dir).withColumn("name", F.expr("CASE WHEN seq % 97 = 0 THEN 'time' ELSE name END")))


@query(
    ctes("metrics")
    + """, s AS (SELECT name, min(value) AS lo, max(value) AS hi, count(value) AS num, sum(value) AS sum, sum(value * value) AS sum_squares FROM metrics GROUP BY name),
c AS (SELECT name, CAST(least(999, floor((value - lo) / ((hi - lo) / 1000))) AS INT) AS bin, count(*) AS c FROM metrics JOIN s USING (name) GROUP BY ALL)
SELECT name, bin, round(lo + (bin + 1) * ((hi - lo) / 1000), 6) AS "limit", coalesce(c, 0) AS "count", round(lo, 6) AS min, round(hi, 6) AS max, num, round(sum, 4) AS sum, round(sum_squares, 2) AS sum_squares
FROM (SELECT *, CAST(unnest(range(0, 1000)) AS INT) AS bin FROM s) LEFT JOIN c USING (name, bin)"""
)
def metric_histogram(spark, sf_dir):
    out = rounded(rounded(H.histogram(_metrics(spark, sf_dir)), "limit", "min", "max"), "sum", digits=4)
    return rounded(out, "sum_squares", digits=2)


@query(ctes("metrics") + " SELECT name, seq, iteration FROM metrics WHERE iteration > 50 AND ((iteration + 1) % 20 = 0 OR (iteration + 1) % 150 = 0 OR iteration = (SELECT max(iteration) FROM metrics))")
def metric_due(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    last = m.agg(F.max("iteration")).first()[0]
    return H.due(H.newer(m, 50), last + 1, 20, 150).select("name", "seq", "iteration")


def _as_of(name: str, agg: str, n: int | None) -> str:
    rows = f"SELECT value FROM metrics m WHERE m.name = '{name}' AND m.iteration <= i.iteration ORDER BY m.iteration DESC, seq DESC" + (f" LIMIT {n}" if n else "")
    return f"(SELECT {agg}(value) FROM ({rows}))"


@query(
    ctes("metrics")
    + f""", x AS (SELECT max(iteration) + 1 AS n FROM metrics), i AS (SELECT DISTINCT iteration FROM metrics WHERE (iteration + 1) % 20 = 0 OR iteration = (SELECT n FROM x) - 1)
SELECT iteration, round({_as_of("data_time", "avg", 20)} + 1e-9, 4) AS data_time, round({_as_of("loss_cls", "median", 200)} + 1e-9, 4) AS loss_cls,
       round({_as_of("loss_triplet", "median", 200)} + 1e-9, 4) AS loss_triplet, round({_as_of("lr", "max", 1)} + 1e-9, 4) AS lr, round({_as_of("time", "avg", None)} + 1e-9, 4) AS "time",
       round({_as_of("time", "median", 1000)} * ((SELECT n FROM x) - iteration - 1) + 1e-9, 4) + 0.0 AS eta_seconds FROM i"""
)
def progress(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    out = H.progress(m, m.agg(F.max("iteration")).first()[0] + 1)
    return rounded(out, "data_time", "loss_cls", "loss_triplet", "lr", "time", "eta_seconds", digits=4, nudge=1e-9)


@query(
    ctes("metrics")
    + """, r AS (SELECT value, row_number() OVER (ORDER BY iteration, seq) AS r FROM metrics WHERE name = 'time')
SELECT count(*) AS n, round(sum(value) FILTER (WHERE r >= 3) + 1e-9, 4) AS total, round(sum(value) FILTER (WHERE r >= 3) / (count(*) - 3) + 1e-9, 4) AS mean, round(avg(value) FILTER (WHERE r >= 3) + 1e-9, 4) AS plain_mean FROM r"""
)
def step_time(spark, sf_dir):
    return rounded(H.step_time(_metrics(spark, sf_dir).filter("name = 'time'")), "total", "mean", "plain_mean", digits=4, nudge=1e-9)


@query(ctes("metrics") + " SELECT iteration, name, round(avg(value) + 1e-9, 6) AS value FROM metrics GROUP BY ALL")
def worker_reduce(spark, sf_dir):
    return rounded(H.over_workers(_metrics(spark, sf_dir)), "value", nudge=1e-9)


@query(
    ctes("epochs")
    + """, k AS (SELECT * FROM epochs WHERE (epoch + 1) % 3 = 0 OR epoch >= 29)
SELECT epoch, round(metric, 6) AS metric, metric > coalesce(max(metric) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS best, epoch < 29 AS periodic, epoch >= 29 AS final FROM k"""
)
def best_epochs(spark, sf_dir):
    return rounded(H.best_epochs(load(spark, sf_dir, "epochs"), 3, 30), "metric")


@query(ctes("logs") + " SELECT seq, caller, message FROM logs QUALIFY row_number() OVER (PARTITION BY caller, message ORDER BY seq) <= 2")
def log_first_n(spark, sf_dir):
    return H.first_n(load(spark, sf_dir, "logs"), 2, ("caller", "message")).select("seq", "caller", "message")


@query(ctes("logs") + " SELECT seq, caller FROM logs QUALIFY row_number() OVER (PARTITION BY caller ORDER BY seq) % 7 = 1")
def log_every_n(spark, sf_dir):
    return H.every_n(load(spark, sf_dir, "logs"), 7).select("seq", "caller")


@query(
    "WITH RECURSIVE "
    + ctes("logs")[5:]
    + """, k AS (SELECT caller, min(ts) AS ts FROM logs GROUP BY caller
       UNION ALL SELECT k.caller, (SELECT min(l.ts) FROM logs l WHERE l.caller = k.caller AND l.ts >= k.ts + INTERVAL 20000 SECOND) FROM k WHERE k.ts IS NOT NULL)
SELECT min(seq) AS seq, caller, ts FROM logs JOIN k USING (caller, ts) GROUP BY caller, ts"""
)
def log_throttle(spark, sf_dir):
    return H.every_n_seconds(load(spark, sf_dir, "logs").select("seq", "caller", "ts"), 20000)


@query(
    ctes("metrics")
    + """, l AS (SELECT iteration, name, value FROM metrics QUALIFY row_number() OVER (PARTITION BY iteration, name ORDER BY seq DESC) = 1),
c AS (SELECT iteration, name, '"' || name || '": ' || CAST(value AS VARCHAR) AS cell FROM l UNION ALL SELECT DISTINCT iteration, 'iteration', '"iteration": ' || iteration FROM l)
SELECT iteration, '{' || string_agg(cell, ', ' ORDER BY name) || '}' AS line FROM c GROUP BY iteration"""
)
def metrics_json(spark, sf_dir):
    return S.metric_lines(_metrics(spark, sf_dir))


@query(
    ctes("metrics")
    + """, l AS (SELECT iteration, name, value FROM metrics QUALIFY row_number() OVER (PARTITION BY iteration, name ORDER BY seq DESC) = 1)
SELECT iteration, max(CASE WHEN name = 'loss_cls' THEN value END) AS loss_cls, max(CASE WHEN name = 'loss_triplet' THEN value END) AS loss_triplet,
       max(CASE WHEN name = 'time' THEN value END) AS time, max(CASE WHEN name = 'data_time' THEN value END) AS data_time, max(CASE WHEN name = 'lr' THEN value END) AS lr
FROM l GROUP BY iteration"""
)
def metrics_wide(spark, sf_dir):
    return S.metric_table(_metrics(spark, sf_dir))


# --- hooks ---------------------------------------------------------------------------------------------


class _ChannelMeans:
    """A model that stands in for a user's: the mean of each channel."""

    def __call__(self, images):
        return images.mean(axis=(2, 3))


@query(
    ctes("features")
    + """, p AS (SELECT vec_id AS id, [100 * CAST(x AS DOUBLE) FOR x IN embedding[1:12]] AS p FROM features),
c AS (SELECT id, unnest([0, 1, 2]) AS pos, p FROM p)
SELECT id, CAST(pos AS INT) AS pos, round(((p[3 - pos] + p[6 - pos] + p[9 - pos] + p[12 - pos]) / 4 - 127.5) / 127.5, 6) + 0.0 AS value FROM c"""
)
def embed_hook(spark, sf_dir):
    crops = load(spark, sf_dir, "features").select(F.col("vec_id").alias("id"), F.transform(F.slice(doubles("embedding"), 1, 12), lambda x: x * 100).alias("pixels"), F.lit(2).alias("h"), F.lit(2).alias("w"))
    return rounded(_long(U.embed_crops(crops, _ChannelMeans), "id"), "value")


# --- streams ---------------------------------------------------------------------------------------------


FILE_ROWS = 1_000_000  # of a file that a stream reads at a time, about


def streamed(rows: DataFrame, parts: int, order: str, name: str) -> DataFrame:
    """rows as files in order of a column, `parts` of them or as many as bound their rows, and opened as a stream that
    reads one at a time. Rows are read for their range, then written once, dealt by part; each part becomes a file in turn."""
    spark, at = rows.sparkSession, new_folder(rows.sparkSession, name)
    lo, hi, n = rows.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    parts = max(parts, -(-n // FILE_ROWS))
    step = ((hi or 0) - (lo or 0)) // parts + 1
    part = F.floor((F.col(order) - F.lit(lo)) / step).cast("int")
    rows.withColumn("_part", part).write.partitionBy("_part").parquet(f"{at}-parts")
    dealt = spark.read.schema(rows.withColumn("_part", part).schema).parquet(f"{at}-parts")
    for k in range(parts):
        dealt.filter(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)


def finished(out: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, as a table."""
    spark, at = out.sparkSession, new_folder(out.sparkSession, name)
    (out.writeStream.outputMode(mode).format("parquet").option("path", at).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(out.schema).parquet(at)


@query()
def track_stream(spark, sf_dir):
    """The same rows as track_batch, from a stream of files; a row without a camera moves the time on at its end."""
    dets = _cleaned(spark, sf_dir).select("camera_id", "frame", "det_id", "ts", "x1", "y1", "x2", "y2")
    last = dets.agg(F.max("frame").alias("frame"), (F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    end = last.select(F.lit(None).cast("int").alias("camera_id"), "frame", F.lit(None).cast("long").alias("det_id"), "ts", *[F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    out = finished(W.track_stream(streamed(dets.union(end), 4, "frame", "frames"), delay="1 minute"), "tracks")
    return rounded(out, "x1", "y1", "x2", "y2", digits=4)


@query(ctes("metrics") + f" SELECT name, seq, round(median(value) {_W.format(19)} + 1e-9, 6) AS median, round(avg(value) {_W.format(19)} + 1e-9, 6) AS mean FROM metrics")
def metric_stream(spark, sf_dir):
    rows = _metrics(spark, sf_dir).withColumn("arrival", F.pmod(F.xxhash64("seq"), F.lit(1000)))  # in no order
    out = W.revised(finished(W.rolling_stream(streamed(rows, 3, "arrival", "metrics")), "rolling"))
    return rounded(out.select("name", "seq", "median", "mean"), "median", "mean", nudge=1e-9)


@query(
    ctes("metrics")
    + """, l AS (SELECT iteration, name, value FROM metrics QUALIFY row_number() OVER (PARTITION BY iteration, name ORDER BY seq DESC) = 1),
c AS (SELECT iteration, name, '"' || name || '": ' || CAST(value AS VARCHAR) AS cell FROM l UNION ALL SELECT DISTINCT iteration, 'iteration', '"iteration": ' || iteration FROM l)
SELECT iteration, '{' || string_agg(cell, ', ' ORDER BY name) || '}' AS line FROM c GROUP BY iteration"""
)
def line_stream(spark, sf_dir):
    """Metric lines of a stream appended to text files, and read back."""
    at = new_folder(spark, "lines")
    W.write_lines(streamed(S.metric_lines(_metrics(spark, sf_dir)), 3, "iteration", "metric-lines").select("line"), at, f"{at}-state").awaitTermination()
    return spark.read.text(at).select(F.get_json_object("value", "$.iteration").cast("long").alias("iteration"), F.col("value").alias("line"))


@query(
    ctes("features")
    + f""", n AS (SELECT cam_id AS bank, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM features QUALIFY row_number() OVER (PARTITION BY cam_id ORDER BY vec_id DESC) <= 8192),
u AS (SELECT bank, vec_id, unnest(range(0, len(e))) AS pos, unnest(e) / greatest(sqrt({_IP}(e, e)), 1e-12) AS x FROM n)
SELECT bank, vec_id, CAST(pos AS INT) AS pos, round(x, 6) + 0.0 AS value FROM u"""
)
def bank_stream(spark, sf_dir):
    """What each bank holds after all micro-batches."""
    rows = load(spark, sf_dir, "features").select(F.col("cam_id").alias("bank"), "vec_id", F.col("person_id").alias("label"), "embedding")
    held = W.banked(finished(W.bank_stream(streamed(rows, 3, "vec_id", "vectors")), "banks"))
    return rounded(held.select("bank", "vec_id", F.posexplode("embedding").alias("pos", "value")), "value")
