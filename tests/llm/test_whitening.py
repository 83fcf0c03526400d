"""Whitening against numpy on whole tables, with repeats, odd entries, few vectors and huge values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axolin.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, components=4):
    """(id, component) -> values, for rows of usable vectors."""
    good = [(i, v) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    d = max((len(v) for _, v in good), default=0)
    x = [[int(math.floor(256 * e)) for e in v] + [0] * (d - len(v)) for _, v in good]
    u = sorted(set(map(tuple, x)))
    n, s = len(u), [sum(c) for c in zip(*u, strict=True)]
    y = np.array([[float(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in u])
    cov = y.T @ y / n
    values, basis = np.linalg.eigh(cov)
    out = []
    for (i, _), v in zip(good, x, strict=True):
        dev = sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
        c = np.array([float(n * a - b) / n for a, b in zip(v, s, strict=True)])
        out += [(i, k + 1, n, dev, c @ basis[:, -1 - k], values[-1 - k], values[-1 - k] / np.trace(cov) if np.trace(cov) else None) for k in range(min(components, d))]
    return out


def compare(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clash:
        df = df.select("*", *[F.lit(1).alias(c) for c in ("x", "name", "w", "component", "n", "a.b")])
    got = sorted(whitening.whiten(df).collect(), key=lambda r: (str(r["vec_id"]), r["deviation"] or 0, r["component"]))
    want = sorted(brute(rows), key=lambda r: (str(r[0]), r[3] if r[3] < 2**63 else 0, r[1]))
    assert len(got) == len(want)
    signs = {}
    for g, (i, k, n, dev, projected, value, share) in zip(got, want, strict=True):
        assert (g["vec_id"], g["component"], g["n"]) == (i, k, n)
        assert g["deviation"] == (dev if dev < 2**63 else None)
        if g["whitened"] is None:
            assert value <= 1e-9 * max(1.0, max(r[5] for r in want))
            continue
        w = projected / math.sqrt(value)
        if abs(w) > 1e-6:
            sign = signs.setdefault(k, math.copysign(1, w * g["whitened"]))
            assert g["whitened"] == pytest.approx(sign * w, rel=1e-6, abs=1e-9)
        assert g["explained"] == pytest.approx(share, rel=1e-9)
        assert g["identity_error"] < 1e-9
    return got


def vectors(n, d, seed=1):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) * np.geomspace(8, 1, d)).tolist()


def test_odd_rows(spark):
    v = vectors(60, 6)
    rows = list(enumerate(v)) + [(None, v[0]), (3, v[1]), (3, v[1]), (70, None), (71, [1.0, None] + [0.0] * 4), (72, [math.nan] * 6), (73, [math.inf] * 6), (74, []), (75, [0.5]), (76, [-0.0] * 6)]
    got = compare(spark, rows)
    assert {r["vec_id"] for r in got} == {None, *range(60), 74, 75, 76}


def test_a_third_of_all_rows_alike(spark):
    v = vectors(100, 5)
    assert compare(spark, list(enumerate(v + [v[0]] * 50)))[0]["n"] == 100


def test_fewer_dimensions_or_vectors_than_components(spark):
    compare(spark, list(enumerate(vectors(40, 2))))
    got = compare(spark, list(enumerate(vectors(3, 6))))
    assert [r["whitened"] is None for r in got[:4]] == [False, False, True, True]
    one = compare(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in one)


def test_values_beyond_a_long(spark):
    rows = list(enumerate((np.array(vectors(20, 3)) * 1e12).tolist()))
    assert all(r["deviation"] is None for r in compare(spark, rows, clash=False))
    whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], SCHEMA)).collect()


def test_nothing_to_fit(spark):
    for rows in ([], [(1, None)], [(1, []), (2, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = {(i, k): (n, dev, abs(p) / math.sqrt(v), share) for i, k, n, dev, p, v, share in brute(rows)}
    got = whitening.query(spark, sf).collect()
    assert len(got) == len(want) == 4 * len(rows)
    for r in got:
        n, dev, w, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, dev)
        assert abs(r["whitened"]) == pytest.approx(w, abs=1e-7)
        assert r["explained"] == pytest.approx(share)
        assert r["identity_error"] < 1e-4
