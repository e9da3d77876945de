import os

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from creditline.llm import queries
from creditline.llm.common import components, read_table, stored
from creditline.llm.tokens import vocabulary
from tests.conftest import MEDIUM
from tests.llm.test_decontam import brute
from tests.llm.test_linededup import left_over
from tests.llm.test_packing import check
from tests.llm.test_simhash import slow_components, slow_fingerprint


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read_table(spark, MEDIUM, "documents"), [read_table(spark, MEDIUM, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, MEDIUM), name)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_toxicity_stage(spark, stages):
    kept = texts(stages[1])
    want = {r.doc_id for r in queries.op2_toxicity(spark, MEDIUM).collect() if not r.toxic}
    assert set(kept) == want and all(texts(stages[0])[i] == t for i, t in kept.items())
    labels = {r.doc_id: r.toxic for r in read_table(spark, MEDIUM, "labels").collect()}
    assert sum(not t and i not in kept for i, t in labels.items()) <= 3


def test_line_dedup_stage(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert left_over(before, {i: after.get(i, "") for i in before}) == set()
    assert all((before[i] or "").strip() for i in set(before) - set(after))
    for r in stages[2].collect():
        assert r.n_chars == len(r.text)


def test_near_dedup_stage(stages):
    before, after = texts(stages[2]), texts(stages[3])
    fps = sorted((i, slow_fingerprint(t)) for i, t in before.items())
    roots = slow_components(fps, 4)
    assert set(after) == set(roots)


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in read_table(spark, MEDIUM, "benchmark").collect()]
    bad = {d for d, _, _ in brute(sorted(texts(stages[3]).items()), items)}
    assert set(texts(stages[4])) == set(texts(stages[3])) - bad


def test_packing_stage(spark, stages):
    full = Tokenizer.from_file(f"{vocabulary()}.json")
    check(stages[5].collect(), texts(stages[4]), full)


def test_run_equals_stages(spark, stages):
    assert corpus_pipeline.run(spark, MEDIUM).agg({"length": "sum"}).first()[0] == stages[5].agg({"length": "sum"}).first()[0]


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_components_of_a_long_chain_a_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 400)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + star + [(7, 7), (-5, 3), (3, -5)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 100 for i in range(100, 401)} | {1000 + i: 1000 for i in range(300)} | {-5: -5, 3: -5}
    assert components(edges.limit(0)).count() == 0


def test_nothing_but_llm_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "creditline")):
        for f in files:
            if f.endswith(".py") and "/llm" not in folder:
                assert "llm" not in open(os.path.join(folder, f)).read()
