"""Operators on tables of embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathline.functions.order import numbered
from pathline.functions.vectors import doubles, unit
from pathline.operators.distance import by_blocks


def normalised(df: DataFrame, column: str = "embedding", add: bool = False) -> DataFrame:
    """Unit length; a zero vector stays zero."""
    return df.withColumn(column, unit(doubles(column), add))


def standardised(df: DataFrame, mean: list[float], var: list[float], weight: list[float] | None = None, bias: list[float] | None = None, eps: float = 1e-5, column: str = "embedding") -> DataFrame:
    """(x - mean) / sqrt(var + eps) * weight + bias in each dimension, by frozen numbers (one row of them)."""
    d = len(mean)
    scale = [(weight[i] if weight else 1.0) / (var[i] + eps) ** 0.5 for i in range(d)]
    m, s, b = (F.array(*map(F.lit, map(float, x))) for x in (mean, scale, bias or [0.0] * d))
    out = F.zip_with(F.zip_with(doubles(column), m, lambda x, y: x - y), F.zip_with(s, b, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda x, t: x * t["p"] + t["q"])
    return df.withColumn(column, out)


def _long(df: DataFrame, *keys: str, column: str = "embedding") -> DataFrame:
    return df.select(*keys, F.posexplode(doubles(column)).alias("pos", "value"))


def precise_stats(df: DataFrame, batch: str, num_iters: int, num_splits: int = 1, order: str = "vec_id") -> DataFrame:
    """Pos, mean and var: the plain average over batches of each batch's mean and unbiased variance.

    The first num_iters batches count; fewer are an error. With num_splits each batch falls
    into that many parts by its order, which are averaged like batches.
    """
    few = df.select(batch).distinct().orderBy(batch).limit(num_iters)
    if few.count() < num_iters:
        raise ValueError(f"fewer than {num_iters} batches")
    part = F.lit(0)
    if num_splits > 1:
        w = Window.partitionBy(batch).orderBy(order)
        part = F.ntile(num_splits).over(w)
    rows = _long(df.join(F.broadcast(few), batch, "left_semi").withColumn("_part", part), batch, "_part")
    each = rows.groupBy(batch, "_part", "pos").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    return each.groupBy("pos").agg(F.avg("m").alias("mean"), F.avg("v").alias("var"))


def pooled(df: DataFrame, key: str, p: float = 3.0, eps: float = 1e-6) -> DataFrame:
    """E5: key, pos and the mean, max, generalised mean, mean + max, and mean within [0, 1] of a group's vectors."""
    mean, top = F.avg("value"), F.max("value")
    gem = F.pow(F.avg(F.pow(F.greatest(F.col("value"), F.lit(eps)), F.lit(p))), F.lit(1.0 / p))
    clipped = F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0))
    return _long(df, key).groupBy(key, "pos").agg(mean.alias("mean"), top.alias("max"), gem.alias("gem"), (mean + top).alias("mean_max"), clipped.alias("clipped"))


def assembled(df: DataFrame, key: str, value: str) -> DataFrame:
    """A value of each dimension put together again as a vector."""
    parts = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.transform(parts, lambda x: x["v"]).alias("embedding"))


# The order in which part features are joined.
PARTS = ("b1", "b2", "b3", "b21", "b22", "b31", "b32", "b33")


def joined_parts(df: DataFrame, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """The part columns as one vector, in order."""
    return df.withColumn("embedding", F.concat(*[doubles(p) for p in parts]))


def moving_average(df: DataFrame, key: str, order: str, m: float = 0.999) -> DataFrame:
    """Key and its vector after k = k * m + q * (1 - m) over its rows in order; it starts with the first.

    The fold is linear, so each row's share is known from how many rows follow it, and sums
    per dimension give the result: no key's rows are gathered, however many there are.
    """
    w = Window.partitionBy(key).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    rank = F.row_number().over(w)
    share = F.when(rank == 1, F.pow(F.lit(m), n - 1)).otherwise((1 - m) * F.pow(F.lit(m), n - rank))
    rows = df.select(key, share.alias("s"), "embedding").select(key, "s", F.posexplode(doubles("embedding")).alias("pos", "v"))
    return rows.groupBy(key, "pos").agg(F.sum(F.col("s") * F.col("v")).alias("value"))


def memory_bank(df: DataFrame, order: str, size: int = 8192, by: str | None = None) -> DataFrame:
    """The newest `size` vectors (of each `by`), unit length, with their labels."""
    if by is None:
        rows = df.orderBy(F.desc(order)).limit(size)
    else:
        w = Window.partitionBy(by).orderBy(F.desc(order))
        rows = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= size).drop("_rank")
    return normalised(rows)


def class_scores(df: DataFrame, centres: DataFrame, scale: float = 1.0, cosine: bool = True) -> DataFrame:
    """vec_id, class_id, score for every class, a block of vectors against a block of centres at a time."""

    def fn(x, a, y, b):
        if cosine:
            a, b = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (a, b))
        n, m = len(x), len(y)
        score = (a @ b.T).ravel() * scale if n and m else np.zeros(0)
        return pa.table({"vec_id": np.repeat(x.column("vec_id").to_numpy(), m), "class_id": np.tile(y.column("class_id").to_numpy(), n), "score": score})

    left, right = df.select("vec_id", "embedding"), centres.select(F.col("class_id").cast("int").alias("class_id"), F.col("w").alias("embedding"))
    return by_blocks(left, right, fn, "vec_id long, class_id int, score double")


def predicted(scores: DataFrame) -> DataFrame:
    """The class with the best score, the smallest of equals."""
    return scores.groupBy("vec_id").agg(F.max_by(F.struct("class_id", "score"), F.struct(F.col("score"), -F.col("class_id"))).alias("b")).select("vec_id", "b.class_id", "b.score")


def class_centres(df: DataFrame) -> DataFrame:
    """class_id and the mean vector of its rows."""
    mean = _long(df, "person_id").groupBy("person_id", "pos").agg(F.avg("value").alias("v"))
    return assembled(mean, "person_id", "v").select(F.col("person_id").alias("class_id"), F.col("embedding").alias("w"))


def balanced_sample(df: DataFrame, n: int = 4, seed: str = "") -> DataFrame:
    """C4: at most n rows of each person, in the order of a hash of id and seed."""
    w = Window.partitionBy("person_id").orderBy(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit(seed))), "vec_id")
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def joint_sets(sets: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Rows of all sets with set_name; persons are numbered anew by set and id. A weight below 1 keeps about that
    share of a set's rows, the same ones each time; other sets are whole."""
    rows: DataFrame | None = None
    for name, df in sets.items():
        part = df.select(F.lit(name).alias("set_name"), "vec_id", "person_id")
        share = (weights or {}).get(name, 1.0)
        if share < 1:
            part = part.filter(F.pmod(F.xxhash64("set_name", "vec_id"), F.lit(1_000_000)) < int(share * 1_000_000))
        rows = part if rows is None else rows.union(part)
    persons = rows.select("set_name", "person_id").distinct()
    return rows.join(numbered(persons, "joint_id", "set_name", "person_id"), ["set_name", "person_id"])
