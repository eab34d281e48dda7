import pytest

import corpus_pipeline
from riverlake.llm.queries import ORACLES, llm_queries
from riverlake.llm.rows import stored
from tests.compare import connect, difference
from tests.llm.helpers import docs, sentence

SF = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries()) == list(range(1, 14))
    assert set(ORACLES) <= set(llm_queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(llm_queries()[name](spark, SF), connect(SF), ORACLES[name]) == ""


def test_stages_keep_clean_documents_and_drop_the_others(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()
    clean = [sentence(i, 80) for i in range(30)]
    near = " ".join(w if i != 40 else "other" for i, w in enumerate(clean[3].split()))
    bad = [clean[0], near, "short text", "again " * 90, f"{sentence(77, 60)} {bench.text} {sentence(78, 60)}", None]
    table = docs(spark, clean + bad)
    table = stored(table, "test-docs")
    for name, stage in corpus_pipeline.STAGES:
        given = table
        table = stored(stage(spark, given, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert table.columns == given.columns
    rows = {r.doc_id: r for r in table.collect()}
    assert sorted(rows) == list(range(30))
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows.values())


def test_run_over_the_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    source = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < out.count() < source.count()
    assert out.join(source, "doc_id", "left_anti").isEmpty()
