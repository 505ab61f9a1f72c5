from __future__ import annotations

import uuid

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sonolith.llm import bpe, exact_dedup, language_id, packing, revisits, sharding, simhash, token_files, topk, toxicity
from sonolith.llm.common import checkpoint_dir


@pytest.mark.parametrize("stage", [corpus_pipeline.reject_toxic, corpus_pipeline.reject_unknown_language])
def test_stages_pass_columns_of_any_name(stage, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.select(F.col("n_chars").alias("Score"), F.lit("x").alias("predicted"), F.lit(7).alias("lang_pred"), "*")
    out = stage(spark, more, sf_dir)
    assert out.columns == more.columns
    if stage is corpus_pipeline.reject_toxic:
        model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
        want = toxicity.scored(docs, model).where("predicted = 0")
    else:
        seen = language_id.identified(docs, language_id.learn(docs, F.lit(True)))
        want = seen.where((F.col("lang_pred") != "und") & (F.col("score") >= corpus_pipeline.LEAST_COSINE))
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in want.collect())
    assert all((r.Score, r.predicted, r.lang_pred) == (r.n_chars, "x", 7) for r in got)


#: Working names of the operators, and the input's own names in another case.
EXTRA = ["DOC_ID", "Text", "id", "fp", "size", "sha", "key", "tie", "range", "n", "h", "ids", "length", "part", "bucket", "score", "c0", "group", "open", "prefix", "line"]
JSON, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
LONG = "very long " * 30_000
ROWS = [(1, "Same words here, and some more of them", "en"), (2, "Same words here, and some more of them", "en"), (2, "Same words here, and some more of them", "en"), (3, "", None), (4, None, "en"), (5, "  \n", "de"), (6, LONG, "en"), (None, "without an id", "de"), (7, "ein ganz anderer Satz", "de"), (8, "!!! 123", None)]


def tokens(df):
    folder = f"{checkpoint_dir(df.sparkSession)}/clash-{uuid.uuid4().hex}"
    return token_files.read_token_digest(token_files.write_token_files(df, JSON, folder), folder)


def toxic(df):
    labels = df.sparkSession.createDataFrame([(1, 1, 1, 0), (7, 0, 0, 1), (None, 1, 1, 1), (3, None, None, None)], "doc_id long, toxic int, TOXIC2 int, Label int")
    return toxicity.scored(df, toxicity.learn(df, labels, F.lit(True)))


OPERATORS = {
    "sharding": sharding.shard_rows, "simhash": simhash.near_components, "similar": simhash.similar_components,
    "language": lambda df: language_id.identified(df, language_id.learn(df, F.lit(True))), "language rows": lambda df: language_id.identify(df, language_id.learn(df, F.lit(True))),
    "toxicity": toxic, "packing": packing.pack_batches, "token files": tokens, "exact": lambda df: exact_dedup.mark_exact(df, digest_all=True), "bpe": lambda df: bpe.encode_digest(df, MULTI), "bpe rows": lambda df: bpe.encode_rows(df, MULTI),
}


def table(spark, rows):
    kinds = ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(*r, *["x" if i % 3 else None for i in range(len(EXTRA))]) for r in rows], f"doc_id long, text string, lang string, {kinds}")


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_any_rows_and_names(name, spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    got, want = OPERATORS[name](table(spark, ROWS)), OPERATORS[name](plain)
    kept = [c for c in want.columns if c in got.columns]
    assert len(kept) >= len(want.columns) - 2
    exact = got.toDF(*[f"c{i}" for i in range(len(got.columns))]).select(*[F.col(f"c{got.columns.index(c)}").alias(c) for c in kept])
    if name == "sharding":  # places among equal rows may differ
        exact, want = exact.drop("slot", "shard"), want.drop("slot", "shard")
    assert sorted(map(str, exact.collect())) == sorted(map(str, want.select(*exact.columns).collect()))
    assert got.count() == len(ROWS)
    assert OPERATORS[name](table(spark, [])).collect() == []


def test_rows_that_stay_keep_their_columns(spark):
    df = table(spark, ROWS)
    for drop in (exact_dedup.drop_exact, simhash.drop_near):
        out = drop(df)
        assert out.columns == df.columns
        ids = sorted(r[0] or 0 for r in out.collect())
        assert len(ids) == len(set(ids)) and {0, 6, 7} <= set(ids)
        assert drop(df.limit(0)).collect() == []


def test_searches_and_revisits_take_any_names(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0], "x", 1, None) for i in range(5)] + [(None, [1.0, 1.0], "x", 1, 0), (9, None, None, None, 0)], "vec_id long, embedding array<double>, VEC_ID string, v int, id long")
    assert topk.top_k(vectors, F.col("vec_id") == 0).count() == 4
    records = spark.createDataFrame([(1, "response", "http://a", 1, {"etag": "x"}, "z", None), (2, "revisit", "http://a", 2, {"etag": "x"}, None, 3), (3, "revisit", None, None, None, None, None)], "record_id long, kind string, url string, ts long, headers map<string,string>, URL string, stretch int")
    assert sorted(r.status for r in revisits.resolve_revisits(records).collect()) == ["orphan", "resolved"]
