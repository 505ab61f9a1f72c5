"""Token ids in binary files: texts are encoded where they lie, ids are counted, and go once to files by document id."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonolith.llm.common import arrow_map, cut, named, starts_of, text_chunks
from sonolith.llm.piece_ids import PIECE_CHARS, PieceIds
from sonolith.llm.varbyte import pack, rank_table, ranked, unpack

#: Ids a file takes, about; ids a block takes, about; tasks that count ids, at most, for each of Spark's parallel tasks.
FILE_IDS, BLOCK_IDS, COUNTERS = 8 << 20, 1 << 20, 4
END_ID = 2
VOCABULARY = "vocabulary.u32"


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _added(path: str) -> tuple[str, ...]:
    """Strings that the library takes out of a text before it cuts pieces."""
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    at = starts_of(np.array([len(x) for x in lists], dtype=np.int64))
    return np.fromiter((i for x in lists for i in x), np.uint32, int(at[-1])), at


@cache
def _pieces_of(path: str) -> PieceIds | None:
    """Ids of pieces seen, where the file's tokenizer treats the pieces of a text one by one; else none."""
    t = _tokenizer(path)
    pre = t.pre_tokenizer
    if t.normalizer is not None or type(pre).__name__ != "ByteLevel" or pre.add_prefix_space or not pre.use_regex:
        return None
    line = t.encode("\n", add_special_tokens=False).ids

    def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces without white space inside go to the library as the lines of one text; a line break is a piece of its own."""
        blank = np.array([p.isspace() for p in new])
        lines = [p for p, b in zip(new, blank.tolist(), strict=True) if not b]
        ids = np.array(t.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.append(np.flatnonzero(ids == line[0]), len(ids))
        if len(line) != 1 or len(ends) != len(lines):
            return _flat([e.ids for e in t.encode_batch_fast(new, add_special_tokens=False)])
        other, other_at = _flat([e.ids for e in t.encode_batch_fast([p for p in new if p.isspace()], add_special_tokens=False)])
        size = np.zeros(len(new), dtype=np.int64)
        size[~blank], size[blank] = np.diff(ends, prepend=-1) - 1, np.diff(other_at)
        out = np.zeros(int(size.sum()), dtype=np.uint32)
        mine = np.repeat(blank, size)
        out[~mine], out[mine] = np.delete(ids, ends[:-1]), other
        return out, starts_of(size)

    return PieceIds(encode)


def encode_texts(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts by the tokenizers library (``add_special_tokens=False``), one text behind the other, and where each starts.

    A byte-level tokenizer cuts a text into pieces first and encodes each by itself, so each
    distinct piece is given to the library once and remembered. Texts that hold the string of a
    special token, which the library takes out before that, go to it whole.
    """
    t, table = _tokenizer(path), _pieces_of(path)
    whole = [table is None or any(s in x for s in _added(path)) for x in texts]
    if all(whole):
        return _flat([e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)])
    ids, at = table.ids([x if not w else "" for x, w in zip(texts, whole, strict=True)])
    if not any(whole):
        return ids, at
    parts = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    for i in np.flatnonzero(whole).tolist():
        parts[i] = np.array(t.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
    return np.concatenate(parts), starts_of(np.array([len(p) for p in parts], dtype=np.int64))


def _with_end(ids: np.ndarray, at: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    return (ids, at) if end_id is None else (np.insert(ids, at[1:], end_id), at + np.arange(len(at)))


def token_rows(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """(id, h, n, ids): hash, number of ids and ids of each whole text, these as a zstandard frame of little-endian numbers of two bytes, of four if two don't hold all ids."""
    kind = _id_type(tokenizer, end_id)
    source = named(df, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("h"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for start, texts in text_chunks(batch.column(1), PIECE_CHARS):
            ids, at = _with_end(*encode_texts(tokenizer, texts), end_id)
            whole, ends = memoryview(ids.astype(kind).tobytes()), (kind.itemsize * at).tolist()
            blobs = pa.array([press.compress(whole[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), batch.column(2).slice(start, len(texts)), pa.array(np.diff(at)), blobs], names=["id", "h", "n", "ids"])

    return arrow_map(source, work, "id long, h long, n long, ids binary")


def _id_type(tokenizer: str, end_id: int | None) -> np.dtype:
    t = _tokenizer(tokenizer)
    most = max([t.get_vocab_size(with_added_tokens=True), *(i + 1 for i in t.get_added_tokens_decoder()), (end_id or 0) + 1])
    return np.dtype("<u2") if most <= 1 << 16 else np.dtype("<u4")


def _ids_of(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, and where each row's start, and the end."""
    open_ = zstandard.ZstdDecompressor()
    parts = [open_.decompress(x) for x in column.to_pylist()]
    return np.frombuffer(b"".join(parts), kind), starts_of(np.array([len(x) for x in parts], dtype=np.int64) // kind.itemsize)


def _by_frequency(rows: DataFrame, kind: np.dtype) -> np.ndarray:
    """All ids of the corpus that occur, most frequent first. The driver gets one number for each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for b in batches:
            own = np.bincount(_ids_of(b.column(0), kind)[0], minlength=len(n))
            own[: len(n)] += n
            n = own
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["id", "n"])

    tasks = COUNTERS * rows.sparkSession.sparkContext.defaultParallelism
    counted = rows.select("ids").coalesce(tasks).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(max(counted.column("id").to_pylist(), default=0) + 1, np.int64)
    n[counted.column("id").to_numpy()] = counted.column("n").to_numpy()
    return ranked(n)


def _blocks(batches: Iterator[pa.RecordBatch], kind: np.dtype, table: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(documents, ids, block) of about BLOCK_IDS ids or more."""
    held: list[tuple[np.ndarray, ...]] = []

    def block() -> tuple[int, int, bytes]:
        docs, none, sizes, ranks = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return len(docs), len(ranks), pack(docs, none, sizes, ranks)

    for b in batches:
        ids, at = _ids_of(b.column(1), kind)
        none = np.asarray(b.column(0).is_null())
        docs = b.column(0).fill_null(0).to_numpy()
        cuts = np.unique(np.searchsorted(at, np.arange(BLOCK_IDS, at[-1] + 1, BLOCK_IDS)).clip(0, len(docs)))
        for low, high in zip([0, *cuts], [*cuts, len(docs)], strict=True):
            if high > low:
                held.append((docs[low:high], none[low:high], np.diff(at[low : high + 1]), table[ids[at[low] : at[high]]]))
                if sum(len(h[3]) for h in held) >= BLOCK_IDS:
                    yield block()
    if held:
        yield block()


def write_token_files(df: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """Write the ids of every whole text to files in ``folder``, in ascending order of id; returns (part, file, docs, ids).

    ``folder`` is a URI that all executors and the driver reach; the ids' ranks over the whole
    corpus go to one file there. Null texts count as empty and have the end id alone. Null ids come
    first; rows of one id lie in the order of a hash of their texts, over as many files as they
    need. Each file is written under a name of its task attempt and then renamed to its part's, so
    a task that runs again puts the same file in place. An empty table writes the empty ranking only.
    """
    kind = _id_type(tokenizer, end_id)
    rows = cut(token_rows(df, tokenizer, id_col, text_col, end_id)).withColumn("line", F.monotonically_increasing_id())
    vocabulary = _by_frequency(rows, kind)
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{VOCABULARY}") as f:
        f.write(vocabulary.astype("<u4").tobytes())
    files = max(1, min((rows.agg(F.sum("n")).first()[0] or 0) // FILE_IDS + 1, 1 << 20))
    # the place among the rows lets even one id, or one text of it, go to several files
    order = [F.col("id").asc_nulls_first(), F.col("h").asc_nulls_first(), F.col("line").asc()]
    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("id", "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{base}/{VOCABULARY}") as f:
            table = rank_table(np.frombuffer(f.read(), "<u4"))
        part = TaskContext.get().partitionId()
        done, draft = f"{base}/part-{part:07d}.tok", f"{base}/.draft-{part:07d}-{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        out = None
        for docs, ids, block in _blocks(batches, kind, table):
            if out is None:
                out = fs.open_output_stream(draft)
            out.write(np.array([len(block)], dtype="<i8").tobytes())
            out.write(block)
            n_docs += docs
            n_ids += ids
        if out is not None:
            out.close()
            fs.move(draft, done)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"part-{part:07d}.tok"]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["part", "file", "docs", "ids"])

    return cut(ordered.mapInArrow(work, "part long, file string, docs long, ids long"))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids) of the files: start counts the ids of all documents before."""
    return _read(manifest, folder, False)


def read_token_digest(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files; ids as uint32, lowest byte first."""
    return _read(manifest, folder, True)


def _read(manifest: DataFrame, folder: str, digest: bool) -> DataFrame:
    # one row a file: a running sum over them in one task holds a few bytes a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long"))).select("file", "base")
    spread = based.repartitionByRange(max(1, manifest.count()), "file")

    def blocks(fs: pafs.FileSystem, name: str) -> Iterator[bytes]:
        with fs.open_input_stream(name) as f:
            while head := f.read(8):
                size = int(np.frombuffer(head, dtype="<i8")[0])
                block = f.read(size)
                if len(block) < size:
                    raise ValueError(f"token file {name} is cut short")
                yield block

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{base}/{VOCABULARY}") as f:
            vocabulary = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for block in blocks(fs, f"{base}/{name}"):
                    docs, none, sizes, ranks = unpack(block)
                    tokens = vocabulary[ranks]
                    first = starts_of(sizes)
                    columns = [pa.array(docs, mask=none), pa.array(at + first[:-1])]
                    at += int(first[-1])
                    if digest:
                        whole = memoryview(tokens.tobytes())
                        ends = (4 * first).tolist()
                        sums = [zlib.crc32(whole[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                        columns += [pa.array(sizes.astype(np.int64)), pa.array(sums, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    else:
                        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens.astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([*columns, lists], names=["doc_id", "start", "ids"])

    tail = "n_tokens long, ids_crc32 long" if digest else "ids array<int>"
    return spread.mapInArrow(work, f"doc_id long, start long, {tail}")
