"""The registered queries over whole tables, against plain versions of what they return."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from sonolith.llm import packing, queries, sharding
from tests.llm.test_dedup_and_shards import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def documents(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], zip(t["text"], t["lang"], strict=True), strict=True))


def run(name, spark, sf_dir):
    return queries.QUERIES[name](spark, sf_dir).collect()


def test_op1(spark, sf_dir, documents):
    got = run("op1_histogram_shards", spark, sf_dir)
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, (t, _) in documents.items()}
    assert len(got) == len(documents) and {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    total, most = sum(r.size for r in got), max(r.size for r in got)
    assert sorted(shards) == list(range(8))
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r.size for r in rows) - total / 8) <= most + 2 * sharding.TOLERANCE * total / 8 + 2


def test_op2(spark, sf_dir, documents):
    got = {r.doc_id: r for r in run("op2_simhash", spark, sf_dir)}
    ids = sorted(documents)
    prints = [brute_fingerprint(documents[i][0]) for i in ids]
    least = {}
    for i, c in zip(ids, comp := brute_components(prints), strict=True):
        least.setdefault(c, i)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", least[c]) for i, f, c in zip(ids, prints, comp, strict=True)}


def test_op3(spark, sf_dir, documents):
    got = run("op3_language", spark, sf_dir)
    assert sorted(r.doc_id for r in got) == sorted(documents)
    langs = {x for _, x in documents.values() if x}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.lang_pred in langs if any(c.isalpha() for c in documents[r.doc_id][0] or "") else r.lang_pred == "und"
    held = [r for r in got if r.held_out and documents[r.doc_id][1]]
    assert sum(r.lang_pred == documents[r.doc_id][1] for r in held) >= 0.95 * len(held)


def test_op4(spark, sf_dir, documents):
    got = run("op4_toxicity", spark, sf_dir)
    assert sorted(r.doc_id for r in got) == sorted(documents)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op7(spark, sf_dir, documents):
    got = run("op7_length_buckets", spark, sf_dir)
    lengths = {i: len((t or "").split()) for i, (t, _) in documents.items()}
    assert {r.doc_id: r.length for r in got} == lengths
    values, counts = np.unique(list(lengths.values()), return_counts=True)
    assert sum(r.padding for r in got) == packing.optimal_boundaries(values, counts, packing.BUCKETS)[1]
    for (_, n), k in Counter((r.boundary, r.batch) for r in got if r.boundary).items():
        assert k >= 1 and n >= 0
    load = Counter()
    for r in got:
        load[r.bucket, r.batch] += r.boundary
        assert 0 <= r.length <= r.boundary
    assert all(v <= packing.TOKEN_BUDGET or v == max(r.boundary for r in got) for v in load.values())


def test_op8(spark, sf_dir, documents):
    got = sorted(run("op8_token_files", spark, sf_dir), key=lambda r: r.start)
    t, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    assert [r.doc_id for r in got] == sorted(documents)
    for r in got:
        ids = [*t.encode(documents[r.doc_id][0] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op10(spark, sf_dir, documents):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = run("op10_byte_bpe", spark, sf_dir)
    assert sorted(r.doc_id for r in got) == sorted(documents)
    for r in got:
        text = documents[r.doc_id][0] or ""
        ids = own.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
