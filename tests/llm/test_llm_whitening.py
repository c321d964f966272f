"""Whitening against NumPy on the whole table at once."""

import math

import numpy as np
import pytest

from pathline.llm import whitening

ROWS = "vec_id long, embedding array<float>"


def plain(vectors, k=32):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    v = (off / n).T @ (off / n) / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:k]
    return n, (off**2).sum(axis=1), (off / n) @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(v)


def held(df, vectors, k):
    """Holds the result against NumPy; vectors by vec_id."""
    ids = sorted(vectors)
    n, deviation, white, explained = plain([vectors[i] for i in ids], k)
    rows = df.collect()
    at = {i: p for p, i in enumerate(ids)}
    got = np.full((n, k), np.nan)
    for r in rows:
        assert (r.n, r.deviation) == (n, deviation[at[r.vec_id]]) and math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
        got[at[r.vec_id], r.component - 1] = r.whitened
    assert len(rows) == n * k and rows[0].identity_error < 1e-9 and len({r.identity_error for r in rows}) == 1
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got - white * sign).max() < 1e-8


def test_query_as_numpy(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    df = whitening.op13_embedding_whitening(spark, sf_dir)
    held(df, vectors, 32)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}


@pytest.mark.parametrize("matrix", [1, 3])
def test_small_blocks_and_several_matrices(spark, matrix):
    r = np.random.default_rng(2)
    vectors = {i: r.normal(size=5).astype(np.float32).tolist() for i in range(83)}
    df = spark.createDataFrame([(i, v, "clash") for i, v in vectors.items()], ROWS + ", index string").repartition(7)
    held(whitening.whiten(df, 4, block=5 * 10, matrix=matrix), vectors, 4)


def test_unsound_rows_are_dropped(spark):
    r = np.random.default_rng(3)
    vectors = {i: r.normal(size=3).tolist() for i in range(20)}
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 2.0]), (104, [1.0, float("inf"), 2.0]), (105, [1.0, 2.0]), (106, [-float("inf")] * 3)]
    df = spark.createDataFrame([*vectors.items(), *odd], ROWS)
    held(whitening.whiten(df), vectors, 3)


def test_repeated_rows_and_ids_stay_rows(spark):
    rows = [(None, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [0.5, 0.25]), (2, [-1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == 10 and {r.n for r in got} == {5} and sum(r.vec_id is None for r in got) == 2 and sum(r.vec_id == 1 for r in got) == 6


def test_without_rows_or_variance(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = whitening.whiten(spark.createDataFrame(rows, ROWS))
        assert df.count() == 0 and len(df.columns) == 7


def test_fewer_directions_than_components(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(rows, ROWS)).collect()
    assert {r.component for r in got} == {1} and all(math.isclose(r.explained, 1.0) and r.identity_error < 1e-9 for r in got)
