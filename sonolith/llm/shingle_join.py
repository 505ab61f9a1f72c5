"""Near duplicates by the Jaccard similarity of word shingles: an exact set join by prefixes.

Shingles have one order for all texts. Two sets of similarity 4/5 or more share at least four fifths
of each, so they share a shingle among the first n - ceil(4n/5) + 1 of each set. Texts that do are
compared by their whole sets. Shingles that are frequent in a sample come late in the order, which
keeps lists short; the sample decides on speed alone, not on what is found.

Links are verified in rounds, and only between texts that are still in different components, so a
large group of copies costs no pairs: first those that SimHash links, then two rounds in which every
list is compared with one leader, then what is left. Before, each set has a bit for each class of
shingles, whether their number is odd, in one to two classes a shingle; as bits differ in no more
places than sets do, and in nearly as many, a pair whose bits differ in over a ninth of both sizes
can't have the similarity, and its sets aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import NARROW_ROWS, arrow_map, cut, cut_narrow, if_few, keyed_lookup, named, release, runs, starts_of, text_chunks
from sonolith.llm.components import component_ids, component_roots
from sonolith.llm.shingles import shingle_hashes

#: Words of a shingle; linked texts have a Jaccard similarity of 4/5 or more.
WORDS = 5
#: Texts, about, whose shingles are counted for the order; count from which one is frequent; frequent ones at most.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 20_000, 4, 1_000_000
#: Rounds in which members of a list are compared with one leader only.
STAR_ROUNDS = 2
#: Classes, at least, for each shingle of a set; least and most classes, as powers of two.
CLASSES_EACH, CLASS_BITS = 1, (8, 17)
#: Texts that are compared are found by broadcast up to so many.
BROADCAST_ROWS = 500_000
#: Pairs that a task holds to give each once.
HELD_PAIRS = 500_000

Frequent = tuple[np.ndarray, np.ndarray]
Columns = list[np.ndarray]


def _distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of each text, ascending, and where each text starts."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], starts_of(np.bincount(doc[new], minlength=len(at) - 1))


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of each text, ascending, one text behind the other, and where each text starts."""
    return _distinct(*shingle_hashes(texts, WORDS))


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each set, the same for equal sets; 0 for the empty one."""
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(32)), dtype=np.uint64)))
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def class_bits(n: np.ndarray) -> np.ndarray:
    """How many leading bits of a shingle tell its class, for sets of n; sets that can be similar differ by one bit at most."""
    return np.ceil(np.log2(np.maximum(n * CLASSES_EACH, 1))).astype(np.int64).clip(*CLASS_BITS)


def sketches(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set a bit for each class, whether it has an odd number of shingles there, and the byte where each set's start."""
    bits = class_bits(np.diff(at))
    start = starts_of(1 << bits)
    own = np.repeat(start[:-1], np.diff(at)) + (h >> np.repeat(64 - bits, np.diff(at)).astype(np.uint64)).astype(np.int64)
    return np.packbits((np.bincount(own, minlength=int(start[-1])) & 1).astype(np.uint8)), start // 8


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of bits for half as many classes, until they have ``width`` bytes."""
    while rows.shape[1] > width:
        bits = np.unpackbits(rows, axis=1)
        rows = np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1)
    return rows


def _rows_of(blobs: np.ndarray) -> np.ndarray:
    """Sketches of one width as rows of bytes."""
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Classes in which rows differ: no more than the shingles that only one of two sets has."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def prefixes(h: np.ndarray, at: np.ndarray, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(4n/5) + 1 shingles of each set, frequent ones last."""
    n = np.diff(at)
    late = np.zeros(len(h), dtype=np.int64)
    if len(frequent[0]):
        place = np.minimum(np.searchsorted(frequent[0], h), len(frequent[0]) - 1)
        late = np.where(frequent[0][place] == h, frequent[1][place], 0)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, late, doc))
    size = np.where(n > 0, n - -(-4 * n // 5) + 1, 0)
    first = np.arange(len(h)) - np.repeat(at[:-1], n) < np.repeat(size, n)
    return h[order][first], starts_of(size)


def _frequent(docs: DataFrame) -> Frequent:
    share = int(min(1.0, SAMPLE_DOCS / max(docs.count(), 1)) * (1 << 30))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batch.column(0)):
            kinds, n = np.unique(shingle_sets(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], names=["token", "n"])

    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).select("text")
    counted = arrow_map(sample, work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counted.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow()
    token, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def _blobs(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def _sets(docs: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batch.column(0)):
            h, at = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([pa.array(signatures(h, at)), _lists(h, at)], names=["sig", "tokens"])

    return arrow_map(docs.select("text"), work, "sig long, tokens array<long>")


def _digests(docs: DataFrame, frequent: Frequent, majority: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """For each row: id, a hash of the text, fingerprint, signature, size, prefix and sketch of the shingles."""
    id_type = docs.schema["id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, texts in text_chunks(batch.column(1)):
            every, every_at = shingle_hashes(texts, WORDS)
            h, at = _distinct(every, every_at)
            mine = [batch.column(i).slice(start, len(texts)) for i in (0, 2)]
            made = [pa.array(majority(every, every_at).view(np.int64)), pa.array(signatures(h, at)), pa.array(np.diff(at)), _lists(*prefixes(h, at, frequent)), _blobs(*sketches(h, at))]
            yield pa.RecordBatch.from_arrays([*mine, *made], names=["id", "text_hash", "fp", "sig", "n", "prefix", "sketch"])

    source = docs.select("id", "text", F.xxhash64("text").alias("text_hash"))
    return arrow_map(source, work, f"id {id_type}, text_hash long, fp long, sig long, n long, prefix array<long>, sketch binary")


def _by_list(rows: DataFrame, work: Callable[[Columns, np.ndarray], Iterator[Columns]], schema: str, tasks: int | None = None) -> DataFrame:
    """``work`` on the columns of many rows and where each list (rows of one token, in order of sig) starts; holds one list besides a batch.

    With ``tasks``, lists are dealt to so many, and what ``work`` gives are pairs, of which a task
    gives each once, as far as HELD_PAIRS go.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def made(cols: Columns, at: np.ndarray) -> Iterator[Columns]:
        if len(at) > 1:
            yield from (found for found in work([c[: at[-1]] for c in cols], at) if len(found[0]))

    def batch(found: Columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tasks is None:
            yield from map(batch, lists(batches))
            return
        held, merged, size = [], 0, 0
        for found in lists(batches):
            held.append(found)
            size += len(found[0])
            if size > 2 * merged + HELD_PAIRS:
                held = [_once(held)]
                size = merged = len(held[0][0])
                if merged > HELD_PAIRS:
                    yield batch(held[0])
                    held, merged, size = [], 0, 0
        if held:
            yield batch(_once(held))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            at = runs(cols[:1])
            yield from made(cols, at[:-1])
            rest = [c[at[-2] :] for c in cols]
        if rest is not None:
            yield from made(rest, runs(rest[:1]))

    dealt = rows.repartition("token") if tasks is None else rows.repartition("token").coalesce(tasks)
    return dealt.sortWithinPartitions("token", "sig").mapInArrow(run, schema)


def _shared(cols: Columns, at: np.ndarray) -> Iterator[Columns]:
    """Lists of two different sets or more, each set once."""
    token, sig = cols
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
    kinds = np.add.reduceat(new.astype(np.int64), at[:-1])
    yield [c[new & np.repeat(kinds > 1, np.diff(at))] for c in cols]


def _plausible(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """(a, b, a_hash, b_hash): pairs whose sketches allow the similarity, with the hash of a text of each set."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, m, x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5))
        ok = np.zeros(len(n), dtype=bool)
        widths = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)])
        for p, q in np.unique(widths, axis=0).tolist():
            if max(p, q) <= 2 * min(p, q):
                mine = np.flatnonzero((widths == (p, q)).all(axis=1))
                differ = _apart(_folded(_rows_of(x[mine]), min(p, q)), _folded(_rows_of(y[mine]), min(p, q)))
                ok[mine] = 9 * np.maximum(differ, np.abs(n[mine] - m[mine])) <= n[mine] + m[mine]
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1, 6, 7)], names=["a", "b", "a_hash", "b_hash"])

    own = drawn.select("sig", "n", "sketch", "text_hash")
    both = pairs.join(own.toDF("a", "n", "x", "a_hash"), "a").join(own.toDF("b", "m", "y", "b_hash"), "b").select("a", "b", "n", "m", "x", "y", "a_hash", "b_hash")
    return arrow_map(both, work, "a long, b long, a_hash long, b_hash long")


def _to_leader(salt: int) -> Callable[[Columns, np.ndarray], Iterator[Columns]]:
    """Each member with the leader of its list, a set that is drawn by a hash, where they are apart."""

    def work(cols: Columns, at: np.ndarray) -> Iterator[Columns]:
        _, sig, comp = cols
        size = np.diff(at)
        drawn = (sig.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        lead = np.repeat(np.flatnonzero(drawn == np.repeat(np.minimum.reduceat(drawn, at[:-1]), size)), size)
        ok = comp != comp[lead]
        a, b = sig[ok], sig[lead[ok]]
        yield [np.maximum(a, b), np.minimum(a, b)]

    return work


def _all_pairs(cols: Columns, at: np.ndarray) -> Iterator[Columns]:
    """Members of a list that are apart and whose sizes and sketches allow the similarity."""
    _, sig, comp, n, sketch = cols
    several = np.minimum.reduceat(comp, at[:-1]) != np.maximum.reduceat(comp, at[:-1])
    found: list[Columns] = []
    held = known = 0
    for g in np.flatnonzero(several):
        order = at[g] + np.argsort(n[at[g] : at[g + 1]], kind="stable")
        size, parts = n[order], comp[order]
        last = np.searchsorted(4 * size, 5 * size, side="right")  # of sizes that fit
        width = np.array([len(x) for x in sketch[order]])
        first = {w: int(np.searchsorted(width, w)) for w in np.unique(width).tolist()}  # widths go up with sizes
        whole = {w: _rows_of(sketch[order[width == w]]) for w in first}
        half = {w: _folded(c, w // 2) for w, c in whole.items()}
        for i in range(len(order) - 1):
            w = int(width[i])
            for table, begin in ((whole, first.get(w)), (half, first.get(2 * w))):
                if begin is None:
                    continue
                rows = table[w if table is whole else 2 * w]
                j = np.arange(max(i + 1, begin), min(int(last[i]), begin + len(rows)))
                j = j[parts[j] != parts[i]]
                if len(j):
                    j = j[9 * _apart(rows[j - begin], whole[w][i - first[w]]) <= size[j] + size[i]]
                    a, b = sig[order[j]], np.full(len(j), sig[order[i]])
                    found.append([np.maximum(a, b), np.minimum(a, b)])
            held += sum(len(f[0]) for f in found[known:])
            known = len(found)
            if held > 500_000:
                yield _once(found)
                found, held, known = [], 0, 0
    if found:
        yield _once(found)


def _once(found: list[Columns]) -> Columns:
    """Pairs of many lists, each once."""
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return [a[new], b[new]]


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole sets have a similarity of 4/5 or more."""
    wanted = cut_narrow(pairs.select(F.explode(F.array("a_hash", "b_hash")).alias("text_hash")).distinct())
    # only texts that are compared go to Python
    compared = docs.withColumn("text_hash", F.xxhash64("text")).join(if_few(wanted, BROADCAST_ROWS)[0], "text_hash", "left_semi")
    sets = cut(_sets(compared).groupBy("sig").agg(F.first("tokens").alias("tokens")))
    both = pairs.join(sets.toDF("a", "s"), "a").join(sets.toDF("b", "t"), "b")
    return both.where(9 * F.size(F.array_intersect("s", "t")) >= 4 * (F.size("s") + F.size("t"))).select("a", "b")


def _by_fingerprint(rows: DataFrame, link_edges: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b), a > b, of sets with equal or linked fingerprints: to one set for each fingerprint, and between these."""
    sets = cut_narrow(rows.select("fp", "sig").distinct())
    ones = cut_narrow(sets.groupBy("fp").agg(F.min("sig").alias("one"), F.count(F.lit(1)).alias("sets")))
    same = keyed_lookup(sets, ones, "fp", "sets", sets.count()).select(F.col("sig").alias("a"), F.col("one").alias("b"))
    edges = link_edges(ones.select("fp")).distinct()
    linked = edges.join(ones.select(F.col("fp").alias("a"), F.col("one").alias("x")), "a").join(ones.select(F.col("fp").alias("b"), F.col("one").alias("y")), "b")
    return same.unionByName(linked.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).where("a > b").distinct()


def near_components(df: DataFrame, id_col: str, text_col: str, majority: Callable[[np.ndarray, np.ndarray], np.ndarray], link_edges: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, component_id) for each row: the least id reachable over pairs of similarity 4/5 or more.

    Sets are of 64-bit hashes of shingles; a text of fewer words is one shingle, texts without words
    are one class. Null ids take part but are never the least, unless a component has no other.
    ``majority`` makes fingerprints of shingles, ``link_edges`` finds the links among them.
    """
    docs = named(df, id_col, text_col).toDF("id", "text")
    rows = cut(_digests(docs, _frequent(docs), majority))
    drawn = cut(rows.groupBy("sig").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("text_hash").alias("text_hash")))
    pairs = cut_narrow(_plausible(_by_fingerprint(rows, link_edges), drawn))
    edges = cut_narrow(_verified(docs, pairs))
    roots = cut_narrow(component_roots(edges))
    posts = cut(_by_list(rows.select(F.explode("prefix").alias("token"), "sig"), _shared, "token long, sig long"))
    tasks = posts.count() // NARROW_ROWS + 1
    release(df.sparkSession)
    for salt in range(STAR_ROUNDS + 1):
        known = if_few(roots.toDF("sig", "comp"), BROADCAST_ROWS)[0]
        apart = posts.join(known, "sig", "left").select("token", "sig", F.coalesce("comp", "sig").alias("comp"))
        work = _to_leader(salt)
        if salt == STAR_ROUNDS:
            mixed = apart.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
            apart, work = apart.join(mixed, "token", "left_semi").join(drawn, "sig").select("token", "sig", "comp", "n", "sketch"), _all_pairs
        pairs = cut_narrow(_plausible(_by_list(apart, work, "a long, b long", tasks).distinct(), drawn))
        edges = cut_narrow(edges.unionByName(_verified(docs, pairs)))
        roots = cut_narrow(component_roots(edges))
        release(df.sparkSession)  # a round leaves dozens of plans and shuffles
    nodes = cut_narrow(rows.groupBy("sig").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")))
    classes = component_ids(nodes, roots, "sig")
    return keyed_lookup(rows.select("id", "sig"), classes, "sig", "n", rows.count()).select(F.col("id").alias(id_col), "component_id")
