"""Scores of metric learning over tables (M1 to M12): values, no gradients.

Sums over pairs are taken inside a block of the distance matrix, in tiles of rows sorted by
person, most of which are of one person or of different ones; what leaves a task is one row
for each anchor, and rows of several blocks are merged by their maxima.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathline.functions.vectors import doubles, log_softmax, softmax, total
from pathline.operators.distance import by_blocks, matrix, tiles


def _sides(df: DataFrame, bank: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    q = df.select(F.col("vec_id").alias("q_id"), F.col("person_id").alias("q_pid"), "embedding")
    g = (df if bank is None else bank).select(F.col("vec_id").alias("g_id"), F.col("person_id").alias("g_pid"), "embedding")
    return q, g


def _persons(table: pa.Table, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of a block's rows by person, and the persons (null: NaN, which is none's equal) and ids so ordered."""
    pid, ids = table.column(f"{side}_pid").to_numpy(), table.column(f"{side}_id").to_numpy()
    order = np.argsort(pid, kind="stable")
    return order, pid[order], ids[order]


def _same(p: np.ndarray, q: np.ndarray) -> np.ndarray | bool:
    """Which pairs of two sorted runs of persons are equal; True or False if all or none are."""
    if p[0] == p[-1] == q[0] == q[-1]:
        return True
    return False if p[-1] < q[0] or q[-1] < p[0] else p[:, None] == q[None]


def _anchors(x: pa.Table, a: np.ndarray, y: pa.Table, b: np.ndarray, columns: dict[str, float], fn) -> pa.Table:
    """q_id and columns that start from given values; fn(their arrays, vectors of the tiles, which are equal, ids of both) changes
    them tile by tile."""
    (by, p, q_id), (to, g_pid, g_id) = _persons(x, "q"), _persons(y, "g")
    a, b = a[by] if len(a) else a, b[to] if len(b) else b
    out = {c: np.full(len(q_id) if len(g_id) else 0, start) for c, start in columns.items()}
    for i in tiles(len(q_id)) if len(g_id) else []:
        mine = {c: v[i] for c, v in out.items()}  # views
        for j in tiles(len(g_id)):
            fn(mine, a[i], b[j], _same(p[i], g_pid[j]), q_id[i], g_id[j])
    return pa.table({"q_id": pa.array(q_id[: len(q_id) if len(g_id) else 0], pa.int64())} | out)


def hard_mining(df: DataFrame, metric: str = "euclidean") -> DataFrame:
    """M1: q_id, ap (largest distance of its person, itself among them), an (smallest of another, 1e9 if none)."""
    squared = metric == "euclidean"  # the root is taken of what is left

    def tile(at, a, b, same, q_id, g_id):
        d = matrix(a, b, "sqeuclidean" if squared else metric)
        if same is not False:
            np.maximum(at["ap"], (d if same is True else np.where(same, d, -np.inf)).max(1), out=at["ap"])
        if same is not True:
            np.minimum(at["an"], (d if same is False else np.where(same, np.inf, d)).min(1), out=at["an"])

    def fn(x, a, y, b):
        t = _anchors(x, a, y, b, {"ap": -np.inf, "an": np.inf}, tile)
        ap, an = t.column("ap").to_numpy(), t.column("an").to_numpy()
        root = (lambda d: np.sqrt(np.maximum(d, 1e-12))) if squared else (lambda d: d)
        return pa.table({"q_id": t.column("q_id"), "ap": np.where(ap > -np.inf, np.maximum(root(ap), 0.0), 0.0), "an": np.minimum(root(an), 1e9)})

    return by_blocks(*_sides(df), fn, "q_id long, ap double, an double", whole=True).groupBy("q_id").agg(F.max("ap").alias("ap"), F.min("an").alias("an"))


def weighted_mining(df: DataFrame, metric: str = "euclidean") -> DataFrame:
    """M2: q_id, ap, an as means of distances, weighted by a softmax over the mask (of minus the distance for other
    persons); the largest value that is subtracted counts masked zeros, and 1e-6 is added to the divisor."""

    def tile(at, a, b, same, q_id, g_id):
        d = matrix(a, b, metric)
        if same is not False:
            top = np.maximum(at["m"], (d if same is True else np.where(same, d, 0.0)).max(1))
            shrink = np.exp(at["m"] - top)
            e = np.exp(d - top[:, None]) if same is True else np.where(same, np.exp(np.minimum(d - top[:, None], 0.0)), 0.0)
            at["p0"][:] = at["p0"] * shrink + e.sum(1)
            at["p1"][:] = at["p1"] * shrink + np.einsum("ij,ij->i", e, d)
            at["m"][:] = top
        if same is not True:
            f = np.exp(-d) if same is False else np.where(same, 0.0, np.exp(-d))
            at["n0"] += f.sum(1)
            at["n1"] += np.einsum("ij,ij->i", f, d)

    columns = dict.fromkeys(("m", "p0", "p1", "n0", "n1"), 0.0)
    rows = by_blocks(*_sides(df), lambda x, a, y, b: _anchors(x, a, y, b, columns, tile), "q_id long, m double, p0 double, p1 double, n0 double, n1 double", whole=True)
    top = F.exp(F.col("m") - F.max("m").over(Window.partitionBy("q_id")))
    rows = rows.withColumns({"p0": F.col("p0") * top, "p1": F.col("p1") * top})
    ratio = lambda a, b: F.sum(a) / (F.sum(b) + 1e-6)
    return rows.groupBy("q_id").agg(ratio("p1", "p0").alias("ap"), ratio("n1", "n0").alias("an"))


def triplet(df: DataFrame, margin: float = 0.3, norm_feat: bool = False, hard: bool = True) -> DataFrame:
    """M3: one row, loss. With a margin the mean of max(0, ap - an + margin), without one that of log(1 + exp(ap - an)),
    or the former with 0.3 where the latter is infinite."""
    mined = (hard_mining if hard else weighted_mining)(df, "cosine2" if norm_feat else "euclidean")
    gap = F.col("ap") - F.col("an")
    ranking = lambda m: F.avg(F.greatest(F.lit(0.0), gap + m))
    if margin > 0:
        return mined.agg(ranking(margin).alias("loss"))
    soft = F.avg(F.log1p(F.exp(gap)))
    return mined.agg(F.when(soft == F.lit(float("inf")), ranking(0.3)).otherwise(soft).alias("loss"))


def _pair_loss(df: DataFrame, bank: DataFrame | None, positive, negative) -> DataFrame:
    """q_id, loss = softplus(log-sum-exp of positives + that of negatives); 0 without one of both. Itself is no pair."""

    def tile(at, a, b, same, q_id, g_id):
        s = 1 - matrix(a, b, "cosine")
        kinds = []
        if same is not False:
            kinds.append(("p", positive(s), (q_id[:, None] != g_id[None]) & same))
        if same is not True:
            kinds.append(("n", negative(s), None if same is False else ~same))
        for kind, logit, mask in kinds:
            if mask is not None:
                logit = np.where(mask, logit, -1e300)
            top = np.maximum(at[f"m{kind}"], logit.max(1))
            e = np.exp(logit - top[:, None])
            if mask is not None:
                e *= mask  # a row without any has 1 everywhere
            at[f"s{kind}"][:] = at[f"s{kind}"] * np.exp(at[f"m{kind}"] - top) + e.sum(1)
            at[f"m{kind}"][:] = top

    columns = {"mp": -1e300, "sp": 0.0, "mn": -1e300, "sn": 0.0}
    rows = by_blocks(*_sides(df, bank), lambda x, a, y, b: _anchors(x, a, y, b, columns, tile), "q_id long, mp double, sp double, mn double, sn double", whole=True)
    w = Window.partitionBy("q_id")
    rows = rows.withColumns({"tp": F.max("mp").over(w), "tn": F.max("mn").over(w)})
    each = rows.groupBy("q_id", "tp", "tn").agg(F.sum(F.col("sp") * F.exp(F.col("mp") - F.col("tp"))).alias("sp"), F.sum(F.col("sn") * F.exp(F.col("mn") - F.col("tn"))).alias("sn"))
    x = F.col("tp") + F.log("sp") + F.col("tn") + F.log("sn")
    loss = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return each.select("q_id", F.when((F.col("sp") > 0) & (F.col("sn") > 0), loss).otherwise(0.0).alias("loss"))


def circle(df: DataFrame, margin: float = 0.25, gamma: float = 128.0) -> DataFrame:
    """M4: loss of each anchor."""
    return _pair_loss(
        df,
        None,
        lambda s: -gamma * np.maximum(-s + 1 + margin, 0) * (s - (1 - margin)),
        lambda s: gamma * np.maximum(s + margin, 0) * (s - margin),
    )


def cosface(df: DataFrame, bank: DataFrame | None = None, margin: float = 0.25, gamma: float = 32.0) -> DataFrame:
    """M5: loss of each anchor; with a bank (M6) against its rows, where a row of the same id is no pair."""
    return _pair_loss(df, bank, lambda s: -gamma * s, lambda s: gamma * (s + margin))


# --- tables of logits ----------------------------------------------------------------------


def _target(v: str | Column) -> Column:
    return F.get(v, F.col("target"))


def topk_accuracy(df: DataFrame, k: int = 1) -> DataFrame:
    """M7: one row, accuracy: fewer than k logits are above the target's."""
    t = _target("logits")
    return df.select((F.size(F.filter("logits", lambda x: x > t)) < k).cast("double").alias("hit")).agg(F.avg("hit").alias("accuracy"))


def cross_entropy(df: DataFrame, eps: float = 0.1, alpha: float = 0.2) -> DataFrame:
    """M8: one row, loss: the sum over rows by the number of those that are not 0 (at least 1). A negative eps smooths
    by alpha times the target's probability."""
    rows = df.select("target", log_softmax("logits").alias("lp"))
    lt = _target("lp")
    s = F.lit(float(eps)) if eps >= 0 else alpha * F.exp(lt)
    loss = -(s / (F.size("lp") - 1) * (total("lp") - lt) + (1 - s) * lt)
    return rows.select(loss.alias("l")).agg((F.sum("l") / F.greatest(F.sum((F.col("l") != 0).cast("int")), F.lit(1))).alias("loss"))


def focal(df: DataFrame, alpha: float = 0.5, gamma: float = 2.0, reduction: str = "none") -> DataFrame:
    """M9: -alpha (1 - p)^gamma log p of each row, or its mean or sum."""
    rows = df.select("vec_id", "target", softmax("logits").alias("p"))
    p = _target("p")
    rows = rows.select("vec_id", (-alpha * F.pow(1 - p, F.lit(gamma)) * F.log(p)).alias("loss"))
    if reduction == "none":
        return rows
    if reduction not in ("mean", "sum"):
        raise ValueError(f"no reduction {reduction!r}")
    return rows.agg((F.avg if reduction == "mean" else F.sum)("loss").alias("loss"))


def margin_logits(df: DataFrame, kind: str = "cosface", scale: float = 64.0, margin: float = 0.35) -> DataFrame:
    """Logits after a margin on the target, times scale. kind: linear, cosface, arcface or circle. Target -1 is none:
    circle then takes every logit as a negative, the others change none."""
    t = F.col("target")
    at = lambda i: (t != -1) & (i == t)
    forms = {
        "linear": lambda x, i: x,
        "cosface": lambda x, i: F.when(at(i), x - margin).otherwise(x),
        "arcface": lambda x, i: F.when(at(i), F.cos(F.acos(x) + margin)).otherwise(x),
        "circle": lambda x, i: F.when(at(i), F.greatest(1 + margin - x, F.lit(0.0)) * (x - (1 - margin))).otherwise(F.greatest(x + margin, F.lit(0.0)) * (x - margin)),
    }
    if kind not in forms:
        raise ValueError(f"no margin {kind!r}")
    return df.withColumn("logits", F.transform("logits", lambda x, i: forms[kind](x, i) * scale))


def jsdiv(student: DataFrame, teachers: DataFrame, t: float = 16.0) -> DataFrame:
    """One row, loss: half the sum of both divergences at temperature t, times t squared by the number of rows;
    the mean over teachers. Tables of vec_id, logits; teachers also have `teacher`."""
    kl = lambda p, lp, lq: total(F.zip_with(p, F.zip_with(lp, lq, lambda a, b: a - b), lambda w, d: w * d))
    s = student.select("vec_id", softmax("logits", t).alias("ps"), log_softmax("logits", t).alias("ls"))
    r = teachers.select("vec_id", "teacher", softmax("logits", t).alias("pt"), log_softmax("logits", t).alias("lt"))
    both = s.join(r, "vec_id").select("teacher", ((kl("pt", "lt", "ls") + kl("ps", "ls", "lt")) / 2).alias("d"))
    return both.groupBy("teacher").agg((F.sum("d") * t * t / F.count(F.lit(1))).alias("l")).agg(F.avg("l").alias("loss"))


def weighted_total(losses: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """One row, loss: the named one-row losses times their weights (1 where none is given)."""
    rows: DataFrame | None = None
    for name, df in losses.items():
        part = df.select((F.col("loss") * weights.get(name, 1.0)).alias("l"))
        rows = part if rows is None else rows.union(part)
    return rows.agg(F.sum("l").alias("loss"))


def logits_of(features: DataFrame, first: int = 1, n: int = 10, scale: float = 8.0) -> DataFrame:
    """Logits from n elements of the embedding, and the person as target."""
    return features.select("vec_id", F.transform(F.slice(doubles("embedding"), first, n), lambda x: x * scale).alias("logits"), F.col("person_id").alias("target"))
