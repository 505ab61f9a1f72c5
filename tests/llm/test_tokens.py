from __future__ import annotations

import base64
import hashlib
import random
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow.fs as pafs
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from sonolith.llm import bpe, piece_ids, token_files, varbyte
from sonolith.llm import pieces as pieces_module
from sonolith.llm.common import checkpoint_dir, remove_folder
from sonolith.llm.pieces import split

MULTI, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, IDS string"
texts = st.text(alphabet=st.one_of(st.sampled_from("ab'stremvld  \n\t1²,!Éñ中 　"), st.characters(exclude_categories=("Cs",))), max_size=40)


def parts(encoded):
    ids, at = encoded
    return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_pieces_are_the_matches_of_the_pattern(batch):
    pieces, first = split(batch)
    own = ByteLevel(add_prefix_space=False)
    assert [pieces[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == [[t[a:b] for _, (a, b) in own.pre_tokenize_str(t)] for t in batch]


@settings(max_examples=100, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_ids_are_those_of_the_library(reference, batch):
    got = parts(bpe.encode_texts(MULTI, batch))
    assert [x.tolist() for x in got] == [reference.encode_ordinary(t) for t in batch]
    assert [bpe.ranks(MULTI).decode(x) for x in got] == [t.encode() for t in batch]


def test_long_pieces(reference):
    rng = random.Random(1)
    batch = ["a" * 257, "ab" * 900, "中" * 400, " " * 900 + "x", "".join(rng.choice("abcdefghij") for _ in range(5000)), "\n" * 700, "<|endoftext|>"]
    batch += ["aab" * 301, "=-" * 300 + "=" * 500, "".join(rng.choice("aeinrst") for _ in range(20_000))]
    batch += ["".join(rng.choice("ab" if i % 2 else "thein") for _ in range(rng.randrange(200, 900))) for i in range(60)]
    assert [x.tolist() for x in parts(bpe.encode_texts(MULTI, batch))] == [reference.encode_ordinary(t) for t in batch]


def test_one_merge_a_round_and_many_agree(monkeypatch):
    rng = random.Random(2)
    pieces = ["".join(rng.choice("aeiourstln") for _ in range(rng.randrange(1, 80))).encode() for _ in range(400)]
    table = bpe.ranks(MULTI)
    want = [x.tolist() for x in table.encode_pieces(pieces)]
    monkeypatch.setattr(bpe, "LONG_BYTES", 0)
    assert [x.tolist() for x in table.encode_pieces(pieces)] == want


def test_pieces_are_remembered_and_forgotten(reference, monkeypatch):
    monkeypatch.setattr(piece_ids, "REMEMBERED", 40)
    table = bpe._pieces_of.__wrapped__(MULTI)
    rng = random.Random(3)
    for _ in range(30):
        batch = [" ".join(f"w{rng.randrange(200)}" for _ in range(20)) for _ in range(3)]
        assert [x.tolist() for x in parts(table.ids(batch))] == [reference.encode_ordinary(t) for t in batch]
    assert len(table) < 400


def test_equal_hashes_do_not_mix_pieces(reference, monkeypatch):
    monkeypatch.setattr(pieces_module, "_hashed", lambda: np.zeros(0x110000, dtype=np.uint64))
    table = bpe._pieces_of.__wrapped__(MULTI)
    for batch in (["some words and some other words", "words"], ["other", "wordy", ""], ["some words"]):
        assert [x.tolist() for x in parts(table.ids(batch))] == [reference.encode_ordinary(t) for t in batch]


def test_pair_table_finds_all_and_nothing_else():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 500, (4000, 2)), axis=0).astype(np.uint32)
    t = bpe.PairTable(keys[:, 0], keys[:, 1], np.arange(len(keys), dtype=np.uint32))
    assert (t.find(keys[:, 0], keys[:, 1]) == np.arange(len(keys))).all()
    assert (t.find(keys[:, 0] + np.uint32(1000), keys[:, 1]) == 0xFFFFFFFF).all()


ROWS = [(3, "Hello there, it's 42!"), (1, None), (2, ""), (None, "no id"), (9, "long " * 40_000), (3, "Hello there, it's 42!"), (7, "<|endoftext|> plain"), (5, "ñandú 中文")]


def test_digest_of_rows(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in ROWS], DOCS)
    got = bpe.encode_digest(df, MULTI).collect()

    def row(i, t):
        ids = reference.encode_ordinary(t or "")
        return (i is None, i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())

    assert sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in got) == sorted(row(i, t) for i, t in ROWS)
    assert bpe.encode_digest(df.limit(0), MULTI).collect() == []
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.encode_rows(df, MULTI).collect()}
    assert back[5] == "ñandú 中文" and back[1] == ""


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=60))
def test_codes_round_trip(ranks):
    control, data = varbyte.encode(np.array(ranks, dtype=np.uint32))
    out = varbyte.decode(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks))
    assert out.tolist() == ranks
    assert len(data) == sum(1 + (r >= 1 << 8) + (r >= 1 << 16) + (r >= 1 << 24) for r in ranks)


def test_file_round_trip_and_ranks():
    ids = np.array([5, 5, 5, 70_000, 5, 9], np.uint32)
    vocabulary = varbyte.ranked(np.bincount(ids))
    assert vocabulary.tolist() == [5, 9, 70_000]
    blob = varbyte.pack(np.array([4, 0, 8]), np.array([False, True, False]), np.array([4, 0, 2]), varbyte.rank_table(vocabulary)[ids])
    docs, none, sizes, ranks = varbyte.unpack(blob)
    assert docs.tolist() == [4, 0, 8] and none.tolist() == [False, True, False] and sizes.tolist() == [4, 0, 2]
    assert vocabulary[ranks].tolist() == ids.tolist()
    assert varbyte.ranked(np.bincount([5, 5, 9, 3, 3, 3])).tolist() == [3, 5, 9]
    with pytest.raises(ValueError):
        varbyte.unpack(blob[:-1])
    with pytest.raises(ValueError):
        varbyte.unpack(b"x" + blob[1:])


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_token_files_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    monkeypatch.setattr(token_files, "FILE_IDS", 30 * block)
    t = Tokenizer.from_file(JSON)
    rows = ROWS + [(100 + i, f"document number {i} " * (i % 9)) for i in range(60)]
    df = spark.createDataFrame([(i, x, "c") for i, x in rows], DOCS)
    folder = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    manifest = token_files.write_token_files(df, JSON, folder)
    got = token_files.read_token_digest(manifest, folder).orderBy("start").collect()
    want = {}
    for i, x in rows:
        want.setdefault(i, []).append([*t.encode(x or "", add_special_tokens=False).ids, 2])
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(i for i, _ in rows if i is not None)
    at = 0
    for r in got:
        ids = want[r.doc_id].pop(0)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    fs, base = pafs.FileSystem.from_uri(folder)
    vocabulary = np.frombuffer(fs.open_input_stream(f"{base}/{token_files.VOCABULARY}").read(), "<u4")
    counts = Counter(i for x in rows for i in [*t.encode(x[1] or "", add_special_tokens=False).ids, 2])
    assert vocabulary.tolist() == sorted(counts, key=lambda i: (-counts[i], i))
    lists = {r.start: r.ids for r in token_files.read_token_files(manifest, folder).collect()}
    assert lists[0][-1] == 2 and sum(map(len, lists.values())) == at
    remove_folder(spark, folder)


def test_token_files_of_nothing(spark):
    folder = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    manifest = token_files.write_token_files(spark.createDataFrame([], DOCS), JSON, folder)
    assert token_files.read_token_digest(manifest, folder).collect() == []


def test_pieces_encode_like_whole_texts():
    batch = [*(x or "" for _, x in ROWS), "a <|endoftext|> b", "<|endoftext|>", "\n\n a　b \r\n x'", "x  y\t\tz", "plain ' 's ''ll"]
    t = Tokenizer.from_file(JSON)
    got = [x.tolist() for x in parts(token_files.encode_texts(JSON, batch))]
    assert got == [e.ids for e in t.encode_batch(batch, add_special_tokens=False)]
    assert got[-5] == [64, 220, 50256, 275]
    lower = P.path("word_bpe_49k.json")
    u = Tokenizer.from_file(lower)
    assert [x.tolist() for x in parts(token_files.encode_texts(lower, batch[:4]))] == [e.ids for e in u.encode_batch(batch[:4], add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_token_ids_are_those_of_the_untouched_library(batch):
    t = Tokenizer.from_file(JSON)
    assert [x.tolist() for x in parts(token_files.encode_texts(JSON, batch))] == [e.ids for e in t.encode_batch(batch, add_special_tokens=False)]
