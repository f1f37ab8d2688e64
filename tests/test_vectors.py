"""Vector operators against numpy: normalisation, PCA basis and positions,
categories, exact k-NN; the float32 codec round trip; small-n edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmap.functions import vectors as V
from corpusmap.operators import projection as P
from corpusmap.operators import similarity as SIM
from corpusmap.plans import maps as MAPS
from corpusmap.sources import store as STORE


def _points(spark, mats: dict):
    rows = [(ds, i, [float(x) for x in v]) for ds, m in mats.items() for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "dataset string, id long, vector array<float>")


def _labels(spark, mat):
    mat = mat / np.linalg.norm(mat, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(mat)], "idx int, vector array<float>")


def test_normalize_and_validity(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1.0, float("nan")],), ([1.0],), (None,)],
                               "v array<float>")
    r = df.select(V.l2_normalize("v").alias("u"), V.is_valid("v", 2).alias("ok")).collect()
    assert r[0].u == [0.6, 0.8] and r[1].u == [0.0, 0.0]
    assert [x.ok for x in r] == [True, True, False, False, False]


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(60, 8)).astype(np.float32) * np.arange(1, 9, dtype=np.float32)
    b = rng.normal(size=(40, 8)).astype(np.float32)
    df = _points(spark, {"a": a, "b": b})
    proj = {r.dataset: r for r in P.fit_projection(df).collect()}
    for name, m in (("a", a), ("b", b)):
        x = m.astype(np.float64)
        c = x - x.mean(0)
        w, v = np.linalg.eigh(c.T @ c)
        got = np.array(proj[name].basis)
        for k in range(3):
            ref = v[:, -1 - k]
            assert abs(abs(got[k] @ ref) - 1) < 1e-8
            assert got[k][np.argmax(np.abs(got[k]))] > 0
        assert np.allclose(proj[name].eigenvalues, w[::-1][:3])
        assert np.allclose(got @ got.T, np.eye(3), atol=1e-10)           # orthonormal basis
        assert sum(proj[name].eigenvalues) <= np.trace(c.T @ c) + 1e-9
        assert np.allclose(proj[name].mean, x.mean(0))
    pts = P.project(df, P.fit_projection(df), places=None).filter("dataset = 'a'").toPandas()
    assert abs(pts[["x", "y", "z"]].mean()).max() < 1e-9  # centred positions


@pytest.mark.parametrize("n,nonzero", [(1, 0), (2, 1), (3, 2), (5, 3)])
def test_pca_small_n(spark, n, nonzero):
    rng = np.random.default_rng(n)
    df = _points(spark, {"d": rng.normal(size=(n, 6)).astype(np.float32)})
    r = P.fit_projection(df).first()
    norms = [float(np.linalg.norm(b)) for b in r.basis]
    assert sum(1 for x in norms if x > 0.5) == nonzero


def test_categorize_and_nearest_match_numpy(spark):
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(300, 16)).astype(np.float32)
    labs = rng.normal(size=(8, 16))
    qs = rng.normal(size=(7, 16)).astype(np.float32)
    df = _points(spark, {"x": pts})
    lab = _labels(spark, labs)
    cat = {r.id: (r.category, r.similarity) for r in SIM.categorize(df, lab).collect()}
    u = pts / np.linalg.norm(pts, axis=1, keepdims=True)
    lu = labs / np.linalg.norm(labs, axis=1, keepdims=True)
    s = u @ lu.T
    for i in range(len(pts)):
        assert cat[i][0] == int(np.argmax(s[i])) and abs(cat[i][1] - round(float(s[i].max()), 4)) < 1e-4
    q = spark.createDataFrame([(j, [float(x) for x in v]) for j, v in enumerate(qs)], "query_id long, vector array<float>")
    nn = SIM.nearest(df.repartition(5), q, k=8).collect()
    got = {}
    for r in nn:
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    qu = qs / np.linalg.norm(qs, axis=1, keepdims=True)
    for j in range(len(qs)):
        order = np.argsort(-(u @ qu[j]), kind="stable")[:8]
        assert [i for _, i in sorted(got[j])] == list(order)


def test_nearest_includes_identical_point_and_groups(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(20, 5)).astype(np.float32)
    df = _points(spark, {"a": m, "b": m[:3]})
    q = spark.createDataFrame([(1, "a", [float(x) for x in m[4]]), (2, "b", [float(x) for x in m[4]])],
                              "query_id long, dataset string, vector array<float>")
    nn = SIM.nearest(df, q, k=8, group_col="dataset").collect()
    a = sorted((r.rank, r.id) for r in nn if r.query_id == 1)
    assert a[0][1] == 4 and len(a) == 8
    assert len([r for r in nn if r.query_id == 2]) == 3  # k = min(8, n)


def test_codec_round_trip(spark):
    df = spark.createDataFrame([(1, [0.5, -1.25, 3.0]), (2, None)], "id int, vector array<float>")
    enc = STORE.encode_vectors(df)
    dec = STORE.decode_vectors(enc, dim=3, out="back").orderBy("id").collect()
    assert dec[0].back == [0.5, -1.25, 3.0] and dec[1].back is None
    bad = STORE.decode_vectors(enc, dim=4, out="back").orderBy("id").collect()
    assert bad[0].back is None and bad[0].decode_error == "size"


def test_build_maps_and_answers(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(30, 6)).astype(np.float32)
    df = _points(spark, {"a": m})
    bad = spark.createDataFrame([("a", 99, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0])],
                                "dataset string, id long, vector array<float>")
    lab = _labels(spark, rng.normal(size=(4, 6)))
    points, proj, quarantine = MAPS.build_maps(df.unionByName(bad), lab, dim=6)
    assert quarantine.count() == 1
    p = points.orderBy("idx").collect()
    assert [r.idx for r in p] == list(range(30)) and [r.id for r in p] == list(range(30))
    q = spark.createDataFrame([(7, "a", [float(x) for x in m[11]])], "query_id long, dataset string, vector array<float>")
    ans = MAPS.answer_queries(q, points, proj, lab).orderBy("rank").collect()
    assert ans[0].nearest_id == 11 and ans[0].nearest_idx == 11
    assert (ans[0].x, ans[0].y, ans[0].z) == (p[11].x, p[11].y, p[11].z)
    assert ans[0].category == p[11].category


def test_fit_matches_svd(spark):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(50, 7)).astype(np.float32) * np.arange(1, 8, dtype=np.float32)
    df = _points(spark, {"d": m}).repartition(4)
    fit = P.fit_projection(df).first()
    x = m.astype(np.float64)
    _, sv, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(fit.mean, x.mean(axis=0)) and np.allclose(fit.eigenvalues, sv[:3] ** 2)
    assert np.allclose(np.abs(np.array(fit.basis) @ vt[:3].T), np.eye(3), atol=1e-8)


def test_gram_flush_bound(spark):
    rng = np.random.default_rng(12)
    mats = {f"d{i}": rng.normal(size=(6, 5)).astype(np.float32) for i in range(9)}
    rows = [(ds, i, [float(x) for x in v]) for i in range(6) for ds, m in mats.items() for v in [m[i]]]
    df = spark.createDataFrame(rows, "dataset string, id long, vector array<float>").coalesce(1)  # interleaved
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")   # many batches in the one task
    try:
        flushed = {r.dataset: r for r in P.fit_projection(df, max_open=2).collect()}
        partial = df.select("dataset", "vector").mapInPandas(lambda it: P._partial_gram(it, 2), schema=P._GRAM_SCHEMA)
        assert partial.filter("i = 0").groupBy("dataset").count().agg(F.max("count")).first()[0] > 1  # re-opened
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    plain = {r.dataset: r for r in P.fit_projection(df).collect()}
    for k in mats:
        assert np.allclose(flushed[k].eigenvalues, plain[k].eigenvalues)
