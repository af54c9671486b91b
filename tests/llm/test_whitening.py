"""Whitening against a decomposition of the whole table at once."""

import math

import numpy as np
import pytest

from tableloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, components=4):
    """(x by id, n, mean, eigenvalues, eigenvectors, trace) of (id, vector) rows."""
    x = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}), dtype=float)
    mean = fit.mean(axis=0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    order = np.argsort(values)[::-1][:components]
    return x, len(fit), mean, values[order], vectors[:, order], values.sum()


def compare(got, rows):
    x, n, mean, values, vectors, trace = plain(rows)
    sums = np.array(sorted({tuple(v) for v in x.values()}), dtype=object).sum(axis=0)
    signs = {}
    assert len(got) == len(rows) * min(4, len(mean))
    for r in got:
        own, c = x[r["vec_id"]], r["component"] - 1
        assert r["n"] == n
        assert r["deviation"] == sum((n * int(a) - s) ** 2 for a, s in zip(own, sums))
        expected = (own - mean) @ vectors[:, c] / math.sqrt(values[c])
        if abs(expected) > 1e-3:
            sign = signs.setdefault(c, np.sign(expected * r["whitened"]))
            assert r["whitened"] == pytest.approx(sign * expected, rel=1e-7, abs=1e-9)
        assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_query_equals_plain_version(spark, tables):
    rows = spark.read.parquet(f"{tables}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = queries.op12_embedding_whitening(spark, tables)
    assert got.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
    ]
    compare(got.collect(), rows)


def test_partitions_blocks_and_rounds_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(whitening, "JOINED", 3)
    rng = np.random.default_rng(2)
    mixed = rng.normal(size=(6, 6))
    rows = [(i, (rng.normal(size=6) @ mixed + 5).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # a third of the rows is one vector
    df = spark.createDataFrame(rows, SCHEMA).repartition(11)
    compare(whitening.whitened(df).withColumnRenamed("id", "vec_id").collect(), rows)


@pytest.mark.parametrize("kind", ["random", "equal", "zero", "close", "wide"])
def test_rank_one_update(kind):
    rng = np.random.default_rng(4)
    d = {
        "random": np.sort(rng.random(12)),
        "equal": np.repeat([1.0, 2.0, 3.0], 4),
        "zero": np.zeros(12),
        "close": 1 + np.arange(12) * 1e-14,
        "wide": 10.0 ** np.arange(-6, 6),
    }[kind]
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    v = rng.normal(size=12)
    v = q @ np.where(np.arange(12) % 3 == 0, 0, q.T @ v)  # some components do not move
    whole = q @ np.diag(d) @ q.T + np.outer(v, v)
    values, vectors = whitening.updated(d, q, v)
    assert np.allclose(values, np.linalg.eigvalsh(whole), rtol=1e-10, atol=1e-10 * values.max())
    assert np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-12)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, whole, atol=1e-11 * values.max())


def test_updates_alone_come_close_to_the_whole():
    rng = np.random.default_rng(7)
    x = rng.integers(-100, 100, size=(700, 8)).astype(float)
    one = whitening.Spectrum.empty(8)
    for start in range(0, 300, 5):  # fewer rows than dimensions: each is an update
        one = one.with_rows(x[start : start + 5])
    other = whitening.Spectrum.empty(8).with_rows(x[300:])
    both = one.with_spectrum(other)
    centred = x - x.mean(axis=0)
    assert both.n == 700 and np.allclose(both.mean, x.mean(axis=0))
    assert np.allclose(both.d, np.linalg.eigvalsh(centred.T @ centred), rtol=1e-10)


def test_odd_vectors_and_clashing_names(spark):
    good = [(i, [float(i % 7), float(i * i % 5), 0.1 * i]) for i in range(20)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 1.0]),
           (103, [float("inf"), 1.0, 1.0]), (104, []), (105, [1.0]), (106, [3e38, 1.0, 1.0])]
    df = spark.createDataFrame(good + bad, SCHEMA)
    df = df.selectExpr("*", "1 AS id", "2 AS x", "3 AS size", "4 AS n", "5 AS component")
    got = whitening.whitened(df).withColumnRenamed("id", "vec_id").collect()
    compare(got, good)


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(i, [1.5, 2.5]) for i in range(3)] + [(None, [1.5, 2.5])], SCHEMA)
    got = whitening.whitened(same).collect()
    assert len(got) == 8
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {
        (1, 0, 0.0, 0.0, 0.0)
    }
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [])], SCHEMA)).count() == 0


def test_deviation_beyond_64_bits_is_null():
    x = np.array([[2**40, 0], [1, 1]])
    assert whitening.deviations(x, 3, [2**40, 0]) == [None, None]
    assert whitening.deviations(np.array([[2**31, 0]]), 1, [0, 0]) == [2**62]
