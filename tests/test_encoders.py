"""Encoders: native hashing encoder vs its Python twin, the encoder plug,
both pooling plans, the dense layer; store column probing."""

import numpy as np
from pyspark.sql import functions as F

from corpusmap.operators import encoders as E
from corpusmap.operators import tokenizer as TOK
from corpusmap.sources import store as STORE

from .conftest import SF_SMALL


def test_hashing_matches_python_twin(spark):
    texts = [(1, "Hello world, hello!"), (2, "Ça va? très bien"), (3, ""), (4, "12 34 !!"), (5, None)]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r.id: np.array(r.vector) for r in E.hashing_vectors(df, "id", "text", 16).collect()}
    assert set(got) == {1, 2}                       # no word -> nothing to embed
    want = E.HashingEncoder(16).encode([t for _, t in texts])
    assert np.allclose(got[1], want[0], atol=1e-7) and np.allclose(got[2], want[1], atol=1e-7)


class _Flaky:
    dim = 4

    def encode(self, texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("model failed")
        return np.array([[len(t), 1.0, 0.0, 0.0] for t in texts], dtype=np.float32)


def test_encoder_plug_failures_stay_pending(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "")], "id long, text string").coalesce(1)
    ok = {r.id: r.vector for r in E.encode_with(df.filter("id = 1"), "id", "text", _Flaky, 4).collect()}
    assert ok[1] == [2.0, 1.0, 0.0, 0.0]
    out = {r.id: r.vector for r in E.encode_with(df, "id", "text", _Flaky, 4).collect()}
    assert out == {1: [2.0, 1.0, 0.0, 0.0], 2: None}   # only the bad text stays pending; empty text skipped
    errors = {r.id: r.error for r in E.encode_with(df, "id", "text", _Flaky, 4).collect()}
    assert errors == {1: None, 2: "RuntimeError: model failed"}
    bad_dim = {r.id: r.vector for r in E.encode_with(df.filter("id = 1"), "id", "text", _Flaky, 5).collect()}
    assert bad_dim[1] is None                       # wrong dimension is not stored


def test_pooling_plans_agree(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    toks = TOK.word_tokens(d, "doc_id", "text", 700)         # ids past the table are skipped
    table = E.token_table_from_embeddings(e)
    a = {r.doc_id: np.array(r.pooled) for r in E.pool_token_vectors(toks, table, "doc_id", 64, method="broadcast").collect()}
    b = {r.doc_id: np.array(r.pooled) for r in E.pool_token_vectors(toks, table, "doc_id", 64, method="join").collect()}
    assert set(a) == set(b) and len(a) > 100
    assert max(float(np.abs(a[k] - b[k]).max()) for k in a) < 1e-9


def test_dense_layer_matches_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(5, 6))
    w = E.rule_weights(3, 6)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id int, v array<double>")
    got = {r.id: r.projected for r in E.project_dense(df, "v", w, [0.5, 0.0, -1.0]).collect()}
    want = v @ np.array(w).T + np.array([0.5, 0.0, -1.0])
    assert all(np.allclose(got[i], want[i]) for i in range(5))


def test_store_probing(spark, tmp_path):
    missing = STORE.read_store(spark, str(tmp_path / "nope"), STORE.PROJECTS_SCHEMA)
    assert missing.count() == 0 and missing.columns == [f.name for f in STORE.PROJECTS_SCHEMA.fields]
    old = spark.createDataFrame([(1, "s", "n")], "id long, slug string, name string")
    old.write.parquet(str(tmp_path / "old"))
    got = STORE.read_store(spark, str(tmp_path / "old"), STORE.PROJECTS_SCHEMA).first()
    assert got.slug == "s" and got.winner is None and got.prizes is None and got.year is None
