"""The registered queries and the pipeline."""

import hashlib
import importlib.util
import sys

import __spark_entry__ as E
import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from corpusmap.llm import decontaminate, pii, toxicity
from corpusmap.llm.common import id_text, remainder
from tests.conftest import SF_SMALL
from tests.llm.test_joins import brute_components
from tests.oracle import duck

LLM = sorted(q for q in E.queries() if q.startswith("op") or q == "pipeline")


def test_all_are_registered():
    numbers = sorted(int(q[2:].split("_")[0]) for q in LLM if q != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in LLM


@pytest.mark.parametrize("name", [q for q in LLM if q not in ("pipeline", "op6_top_k", "op9_decontaminate")])
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = E.queries()[name](spark, SF_SMALL)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_top_k_equals_sql(spark):
    got = E.queries()["op6_top_k"](spark, SF_SMALL).select("query_id", "rank", "vec_id", "score").collect()
    con = duck(SF_SMALL)
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({E.oracle_sql()['op6_top_k']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's result on the smallest tables, by name."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = {"documents": docs}
    for name, stage in P.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(f"{root}/{name}")
        docs = out[name] = spark.read.parquet(f"{root}/{name}")
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stage_columns(stages):
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "jaccard_join", "decontamination", "personal_data", "byte_bpe"]
    for n in names[:-1]:
        assert stages[n].columns == stages["documents"].columns


def test_toxicity_stage(spark, stages):
    docs, labels = stages["documents"], spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    weights, bias = toxicity.train(id_text(docs), labels, remainder("doc_id", 5) != 0)
    words = toxicity.WordScores(weights.astype("float32"))
    want = {i for i, r in rows_of(docs).items() if toxicity.score_text(r.text, words, bias)[0] < 0.5}
    assert set(rows_of(stages["toxicity"])) == want


def test_jaccard_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    want = {c for _, _, c in brute_components(rows)}
    assert set(rows_of(stages["jaccard_join"])) == want


def test_decontamination_stage(spark, stages):
    docs = stages["jaccard_join"]
    items = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    gone = set(rows_of(docs)) - set(rows_of(stages["decontamination"]))
    leaks = {i for i, r in rows_of(docs).items() if any(t in r.text for t in items)}
    assert leaks <= gone and len(gone) <= len(leaks) + 3


def test_personal_data_stage(stages):
    before, after = rows_of(stages["decontamination"]), rows_of(stages["personal_data"])
    assert set(before) == set(after)
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(stages["decontamination"]).collect()}
    for i, r in after.items():
        text, want, at = before[i].text, "", 0
        for s in sorted(spans[i], key=lambda s: (s.start, -s.end)):
            if s.start >= at:
                want += text[at:s.start] + f"[{pii.KINDS[s.kind].upper()}]"
            at = max(at, s.end)
        want += text[at:]
        assert r.text == want and r.n_chars == len(want)


def test_bpe_stage(stages):
    texts, got = rows_of(stages["personal_data"]), rows_of(stages["byte_bpe"])
    assert set(texts) == set(got)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[i].text.encode()).hexdigest() for i, r in got.items())


def test_run_applies_all_stages(spark, stages):
    got = P.run(spark, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages["byte_bpe"].collect()))


def test_stages_on_edge_cases(spark, make_docs, edge_rows, tmp_path):
    docs = make_docs(edge_rows)
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    ids = [r.doc_id for r in docs.collect()]
    assert {1, 2, 3} <= set(ids)                     # null, empty and blank texts are linked with nothing and stay
    assert ids.count(6) == 1 and 7 not in ids        # one of the three equal texts


def test_stages_on_an_empty_table(spark, no_docs):
    for _, stage in P.STAGES:
        assert stage(spark, no_docs, SF_SMALL).count() == 0


def test_entry_works_without_the_subpackage():
    """As after the folder and the pipeline module were removed."""
    class Block:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("corpusmap.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    gone = {m: sys.modules.pop(m) for m in list(sys.modules) if m == "corpus_pipeline" or m.startswith("corpusmap.llm")}
    import corpusmap
    had = corpusmap.__dict__.pop("llm", None)
    block = Block()
    sys.meta_path.insert(0, block)
    try:
        spec = importlib.util.spec_from_file_location("entry_alone", E.__file__)
        alone = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(alone)
        assert alone.queries() and not any(q.startswith("op") for q in alone.queries())
    finally:
        sys.meta_path.remove(block)
        sys.modules.update(gone)
        if had is not None:
            corpusmap.llm = had


def test_window_slots_are_per_alignment(spark, make_docs):
    items = spark.createDataFrame([(1, "on day 3 the old farmer counts 3 sheep and then rests near the river")], "item_id long, text string")
    twice = "on day 4 the old farmer counts 4 sheep and then rests near the river. " \
            "Well, on day 8 the old farmer counts 8 sheep and then rests near the river"
    assert decontaminate.contamination(make_docs([(1, twice)]), items).select(F.count(F.lit(1))).first()[0] == 1
