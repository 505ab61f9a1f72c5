from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonolith.llm import components, exact_dedup, sharding, simhash
from sonolith.llm.common import keyed_lookup
from sonolith.llm.components import component_roots
from sonolith.llm.xxh64 import xxh64

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


ROWS = [(1, "same"), (2, "same"), (9, "same"), (3, ""), (4, None), (5, "other"), (6, LONG), (7, LONG), (8, "same "), (5, "other"), (None, "lonely"), (10, LONG + "x"), (11, "a" * 64 + "tail"), (12, "a" * 64 + "liat")]


def test_exact_marks_match_brute_force(spark):
    got = exact_dedup.mark_exact(docs(spark, ROWS), digest_all=True).collect()
    assert len(got) == len(ROWS)
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (max(known) if known else None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_rows_keep_columns(spark):
    df = docs(spark, ROWS).withColumnRenamed("source", "size")
    out = exact_dedup.drop_exact(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got[(9, "same")] == 1 and (1, "same") not in got and got[(5, "other")] == 1 and got[(4, None)] == 1 and (3, "") not in got
    assert sum(got.values()) == len({t or "" for _, t in ROWS})


def test_exact_on_empty_table(spark):
    assert exact_dedup.mark_exact(docs(spark, []), digest_all=True).collect() == []
    assert exact_dedup.drop_exact(docs(spark, [])).collect() == []


def shards_ok(got, rows, n):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32) for r in got) == sorted((i is None, i or 0, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    size = Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    total, most = sum(r.size for r in got), max(r.size for r in got)
    for k in range(n):
        assert abs(size[k] - total / n) <= most + 2 * sharding.TOLERANCE * total / n + 2


def placed(df):
    """What the query derives from the exchanged rows."""
    return sharding.shard_rows(df).withColumn("text_crc32", sharding.text_crc32(F.col("text"))).collect()


def test_shards_balance_bytes(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), "x" * int(rng.integers(0, 300))) for i in rng.permutation(2000)]
    shards_ok(placed(docs(spark, rows)), rows, 8)


def test_shards_cut_a_key_that_holds_a_third(spark):
    rows = [(i, "y" * 50) for i in range(400)] + [(77, "y" * 50)] * 300 + [(None, None)] * 40
    shards_ok(placed(docs(spark, rows)), rows, 8)


def test_shards_of_few_and_no_rows(spark):
    assert placed(docs(spark, [])) == []
    got = placed(docs(spark, [(1, "é"), (2, None)]))
    assert {(r.doc_id, r.size) for r in got} == {(1, 3), (2, 1)}


def test_shard_rows_keeps_columns_of_any_name(spark):
    df = docs(spark, [(i, "t" * i) for i in range(50)])
    out = sharding.shard_rows(df, 4)
    assert out.columns == [*df.columns, "size", "law", "shard", "slot", "grown_shard"] and out.count() == 50
    names = ["doc_id", "text", "Shard", "key", "tie"]
    more = sharding.shard_rows(df.toDF(*names), 4)
    assert more.columns[:5] == ["doc_id", "text", "Shard_in", "key", "tie"]
    assert sorted((r.doc_id, r.text, r.Shard_in, r.key, r.tie, r.slot) for r in more.collect()) == sorted((r.doc_id, r.text, "en", "s", 0, r.slot) for r in out.collect())
    twice = sharding.shard_rows(df.toDF("doc_id", "text", "DOC_ID", "range", "nth"), 4)
    assert twice.columns[:3] == ["doc_id", "text", "DOC_ID_in"] and twice.count() == 50


def test_shards_of_text_keys(spark):
    df = spark.createDataFrame([(f"k{i}", "t" * (i % 9)) for i in range(200)], "doc_id string, text string")
    got = sharding.shard_rows(df, 4).collect()
    assert len({r.doc_id for r in got}) == 200 and {r.shard for r in got} == {0, 1, 2, 3}


def test_many_ranges_still_number_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 50)
    rows = [(i % 900, "z" * (i % 17)) for i in range(1500)]
    shards_ok(placed(docs(spark, rows)), rows, 8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=120), min_size=1, max_size=20))
def test_xxh64_is_the_published_hash(spans):
    import xxhash

    buffer = np.frombuffer(b"".join(spans) + b"\0" * 8, dtype=np.uint8)
    size = np.array([len(s) for s in spans])
    assert xxh64(buffer, np.cumsum(size) - size, size).tolist() == [xxhash.xxh64_intdigest(s, seed=42) for s in spans]


def brute_fingerprint(text):
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n\x0b\x0c\r\x1c.", max_size=40), min_size=1, max_size=8))
def test_fingerprints_match_brute_force(texts):
    assert simhash.fingerprints(texts).tolist() == [brute_fingerprint(t) for t in texts]


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_hot_keys_are_looked_up_like_others(spark):
    rows = spark.createDataFrame([(k, i) for k in range(30) for i in range(300 if k == 3 else k)], "k long, i long")
    table = rows.groupBy("k").count()
    got = keyed_lookup(rows, table.where("k <> 7"), "k", "count", rows.count(), 4).collect()
    assert Counter((r.k, r["count"]) for r in got) == {(k, 300 if k == 3 else k): 300 if k == 3 else k for k in range(1, 30) if k != 7}


def test_exact_rows_beyond_the_broadcast(spark, monkeypatch):
    want = Counter((r.doc_id, r.text) for r in exact_dedup.drop_exact(docs(spark, ROWS)).collect())
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 0)
    assert Counter((r.doc_id, r.text) for r in exact_dedup.drop_exact(docs(spark, ROWS)).collect()) == want
    assert want[(None, "lonely")] == 1 and want[(5, "other")] == 1


@pytest.mark.parametrize("posting", [2048, 3])
def test_links_lose_nothing(spark, monkeypatch, posting):
    """Also where every posting is large and is refined."""
    monkeypatch.setattr(simhash, "POSTING", posting)
    rng = np.random.default_rng(posting)
    base = rng.integers(0, 2**63, 12, dtype=np.int64)
    fps = set()
    for b in base.tolist():
        x = b
        for _ in range(25):
            x ^= (1 << int(rng.integers(0, 63))) | (1 << int(rng.integers(0, 63)))
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in component_roots(simhash.link_edges(nodes)).collect()}
    want = brute_components(fps)
    for i in range(len(fps)):
        for j in range(i):
            same = roots.get(fps[i], fps[i]) == roots.get(fps[j], fps[j])
            assert same == (want[i] == want[j])


def test_components_of_documents(spark):
    body = " ".join(f"w{i}" for i in range(400))
    rows = [(5, body), (6, body), (3, body + " end"), (8, "quite another text here"), (9, ""), (2, None), (10, "  \n"), (None, body), (8, "quite another text here"), (20, LONG)]
    got = simhash.near_components(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    want = Counter()
    for (i, _), f, c in zip(rows, fps, comp, strict=True):
        ids = [r[0] for r, k in zip(rows, comp, strict=True) if k == c and r[0] is not None]
        want[(i, f"{f:016x}", min(ids))] += 1
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_components(docs(spark, [])).collect() == []


def test_near_copies_leave_one(spark):
    body = " ".join(f"w{i}" for i in range(300))
    df = docs(spark, [(5, body), (6, body), (7, "nothing like it at all"), (4, body.upper()), (4, body.upper()), (None, body), (7, "nothing like it at all")])
    out = simhash.drop_near(df.withColumnRenamed("source", "ID"), components=simhash.near_components)
    assert out.columns == [c.replace("source", "ID") for c in df.columns]
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 4, 7]
    assert simhash.drop_near(df.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 40)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in component_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + k: 1000 for k in range(40)}}
    assert component_roots(spark.createDataFrame([], "a long, b long")).collect() == []


def _brute_roots(edges):
    low = {x: x for e in edges if e[0] != e[1] for x in e}
    while any(low[x] != low[y] for x, y in edges if x != y):
        for x, y in edges:
            if x != y:
                low[x] = low[y] = min(low[x], low[y])
    return low


@pytest.mark.parametrize("most", [200_000, 100])
def test_components_in_one_task_and_in_rounds_are_the_same(spark, monkeypatch, most):
    """Random forests and chains in shuffled order, negative nodes, repeated edges and loops; over 100 edges by rounds, then."""
    rng = np.random.default_rng(7)
    names = rng.permutation(rng.integers(-(2**63), 2**63 - 1, 400, dtype=np.int64)).tolist()
    edges = [(names[i], names[i + 1]) for i in range(150)] + [(names[int(x)], names[int(y)]) for x, y in rng.integers(151, 400, (120, 2))]
    edges += edges[:5] + [(names[3], names[3])]
    want = _brute_roots(edges)
    df = spark.createDataFrame([edges[i] for i in rng.permutation(len(edges))], "a long, b long").repartition(3)
    monkeypatch.setattr(components, "NARROW_ROWS", most)
    got = component_roots(df).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want


def test_components_of_few_edges_take_few_jobs(spark):
    """Rounds over a few edges were dozens of shuffles, whose plans and tasks filled the driver's memory."""
    df = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    spark.sparkContext.setJobGroup("few-edges", "")
    try:
        assert {r.root for r in component_roots(df).collect()} == {0}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")) <= 8
