from __future__ import annotations

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from sonolith.llm import shingle_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_survivors(rows):
    """Least id of each component of pairs with five-word Jaccard of 0.8 or more."""

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


@pytest.mark.parametrize("frequent", [4, 10**9])
def test_near_copies_match_brute_force(spark, monkeypatch, frequent):
    """Copies with a few words changed, chains of them, a line that all share, short and empty texts."""
    monkeypatch.setattr(shingle_join, "FREQUENT", frequent)
    rng = random.Random(3)
    rows, line = [], " ".join(f"all{k}" for k in range(14))
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 200))]
        for _ in range(8):
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = f"v{rng.randrange(9000)}"
            rows.append((len(rows), " ".join(words) + (" " + line if base % 2 else "")))
    rows += [(500, "One two"), (501, "one  TWO"), (502, "one three"), (503, ""), (504, None), (505, line)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())
    assert got == brute_survivors(rows)
    assert 12 < len(got) < len(rows)


def test_sketches_differ_less_than_sets():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 700, 30_000):
        for share in (0.0, 0.1, 0.3, 1.0):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) >= share], rng.integers(0, 2**64, int(n * share) // 2, dtype=np.uint64)]))
            sets = [x for x in (a, b) if len(x)]
            data, at = shingle_join.sketches(np.concatenate(sets), shingle_join.starts_of(np.array([len(x) for x in sets])))
            parts = [data[i:j][None, :] for i, j in zip(at[:-1], at[1:], strict=True)]
            if len(parts) == 2:
                width = min(p.shape[1] for p in parts)
                apart, real = int(shingle_join._apart(*(shingle_join._folded(p, width) for p in parts))[0]), len(np.setxor1d(a, b))
                assert apart <= real and (share > 0.3 or n < 700 or apart >= 0.6 * real)
    n = np.arange(1, 60_000)
    assert (shingle_join.class_bits(n * 5 // 4) - shingle_join.class_bits(n) <= 1).all()


def test_near_copies_of_no_rows(spark):
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], DOCS), "").collect() == []
