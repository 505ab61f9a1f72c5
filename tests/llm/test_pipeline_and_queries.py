from __future__ import annotations

import pytest

import corpus_pipeline
from sonolith.llm import exact_dedup, queries, simhash
from tests.compare import check
from tests.llm.test_shingle_join import brute_survivors


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(name, spark, sf_dir, duck):
    check(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, sf_dir, duck)


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    seen = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = seen
        stage(spark, seen, sf_dir).write.parquet(f"{tmp_path}/{i}")
        seen = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(seen.count())
        if name != "packing":
            assert seen.columns == docs.columns
            assert seen.exceptAll(before).count() == 0
        if name == "exact_copies":
            marked = exact_dedup.mark_exact(before)
            assert sorted(r.doc_id for r in marked.where("kept").collect()) == sorted(r.doc_id for r in seen.select("doc_id").collect())
        if name == "near_copies":
            comp = simhash.similar_components(before)
            assert brute_survivors([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]) == sorted(r.doc_id for r in seen.select("doc_id").collect())
            assert sorted(r.component_id for r in comp.select("component_id").distinct().collect()) == sorted(r.doc_id for r in seen.select("doc_id").collect())
    assert sizes[-1] == sizes[-2] and sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[3]
    assert corpus_pipeline.run(spark, sf_dir).count() == sizes[-1]
