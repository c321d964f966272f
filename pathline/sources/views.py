"""Tables of detections, features, metrics and logs drawn from `events` and `embeddings`.

Each view is one SQL text that Spark and DuckDB read alike; names in braces are tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "raw_detections": """
WITH b AS (
  SELECT event_id, ts, event_type, value, CAST(event_id % 10 AS INT) AS slot,
         CAST(floor(event_id / 10) AS BIGINT) % 4 AS cam, CAST(floor(event_id / 40) AS BIGINT) + 1 AS fr
  FROM {events} WHERE event_type <> 'error' AND (CAST(floor(event_id / 40) AS BIGINT) + 1) % 100 NOT BETWEEN 50 AND 90),
g AS (
  SELECT *, 40.0 + 4 * slot AS w, 100.0 + 5 * slot AS h,
         120.0 + 170 * slot + 3 * (fr % 120) * (CASE WHEN slot % 2 = 0 THEN 1 ELSE -1 END) + (value - floor(value)) * 6 - 3 AS cx,
         200.0 + 60 * cam + 40 * (slot % 3) AS cy FROM b),
a AS (
  SELECT event_id * 2 AS det_id, CAST(cam AS INT) AS camera_id, CAST(fr AS INT) AS frame, ts,
         CAST(cx - w / 2 AS DOUBLE) AS x1, CAST(cy - h / 2 AS DOUBLE) AS y1, CAST(cx + w / 2 AS DOUBLE) AS x2, CAST(cy + h / 2 AS DOUBLE) AS y2,
         0.2 + 0.8 * ((event_id * 37) % 101) / 100.0 AS score, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS cls, event_type FROM g)
SELECT det_id, camera_id, frame, ts, x1, y1, x2, y2, CAST(score AS DOUBLE) AS score, cls FROM a
UNION ALL
SELECT det_id + 1, camera_id, frame, ts, x1 + 4, y1 + 2, x2 + 4, y2 + 2, CAST(score * 0.9 AS DOUBLE), cls FROM a WHERE event_type = 'click'""",
    "rois": """
SELECT CAST(c AS INT) AS camera_id, CAST(a AS DOUBLE) AS rx1, CAST(b AS DOUBLE) AS rx2, CAST(d AS DOUBLE) AS ry1, CAST(e AS DOUBLE) AS ry2
FROM (VALUES (0, 0, 1920, 0, 1080), (1, 100, 1820, 50, 1030), (2, 7.5, 1900, 3.25, 1000)) v(c, a, b, d, e)""",
    "keypoints": """
SELECT det_id, camera_id, frame, x1, y1, x2, y2, k AS kp, CAST((det_id * (k + 3)) % 640 AS DOUBLE) AS kx,
       CAST((det_id * (k + 7)) % 640 AS DOUBLE) AS ky, CAST((det_id + k) % 10 AS DOUBLE) / 10 AS kscore
FROM ({raw_detections}) CROSS JOIN (VALUES (0), (1), (2)) v(k)""",
    "given_tracks": """
SELECT camera_id, CAST(floor(det_id / 2) AS BIGINT) % 10 + 1 AS track_id, frame, ts, x1, y1, x2, y2, score
FROM ({raw_detections}) WHERE det_id % 2 = 0""",
    "features": """
SELECT vec_id, label AS person_id, CAST(vec_id % 4 AS INT) AS cam_id,
       CASE WHEN vec_id % 5 = 0 THEN 'query' ELSE 'gallery' END AS split, embedding FROM {embeddings}""",
    "metrics": """
SELECT event_id AS seq,
       CASE event_type WHEN 'click' THEN 'loss_cls' WHEN 'view' THEN 'loss_triplet' WHEN 'purchase' THEN 'time'
            WHEN 'signup' THEN 'data_time' ELSE 'lr' END AS name,
       CAST(floor(event_id / 5) AS BIGINT) AS iteration, value, event_type <> 'error' AS smoothing_hint, CAST(event_id % 5 AS INT) AS worker
FROM {events}""",
    "epochs": "SELECT CAST(day(ts) - 1 AS INT) AS epoch, avg(value) AS metric FROM {events} GROUP BY 1",
    "logs": """
SELECT event_id AS seq, concat(event_type, '-', CAST(user_id % 10 AS STRING)) AS caller, props AS message, ts FROM {events}""",
}
# One view has a lambda, which the two engines write differently.
CLUSTERED_SPARK = """
SELECT vec_id, label AS person_id, CAST(vec_id % 4 AS INT) AS cam_id, CASE WHEN vec_id % 5 = 0 THEN 'query' ELSE 'gallery' END AS split,
       transform(embedding, (x, i) -> CAST(x AS DOUBLE) + CASE WHEN i = label THEN 1.0D ELSE 0.0D END) AS embedding FROM {embeddings}"""
CLUSTERED_DUCK = """
SELECT vec_id, label AS person_id, CAST(vec_id % 4 AS INT) AS cam_id, CASE WHEN vec_id % 5 = 0 THEN 'query' ELSE 'gallery' END AS split,
       list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + CASE WHEN i - 1 = label THEN 1.0 ELSE 0.0 END) AS embedding FROM {embeddings}"""


def sql(name: str, duck: bool = False) -> str:
    """The text of a view with the views it needs put in."""
    text = VIEWS[name] if name != "clustered" else (CLUSTERED_DUCK if duck else CLUSTERED_SPARK)
    if "{raw_detections}" in text:
        text = text.replace("{raw_detections}", VIEWS["raw_detections"])
    return text.replace("{events}", "events").replace("{embeddings}", "embeddings") if duck else text


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, tables = sql(name), {}
    for t in ("events", "embeddings"):
        if "{" + t + "}" in text:
            tables[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(text, **tables)


def ctes(*names: str) -> str:
    """The views as a WITH clause for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({sql(n, duck=True)})" for n in names)
