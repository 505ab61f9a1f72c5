"""What the corpus operators share: checkpoints, Arrow batches, small hash helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one round of vectorised work takes at a time; texts; texts that are made strings at a time.
CHUNK_CHARS, CHUNK_TEXTS, SLICE_TEXTS = 1 << 20, 1 << 12, 256
#: Rows of an Arrow batch at most.
BATCH_ROWS = 2_000
#: A key with more than this part of all rows is looked up by broadcast, so at most so many keys are.
HOT_PARTS = 512
#: Rows of a few numbers that one partition holds, about.
NARROW_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is named, a temporary one, but only if Spark runs on this machine alone."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that the driver and all executors share")
            named = f"file://{tempfile.mkdtemp(prefix='sonolith-checkpoint-')}"
            atexit.register(shutil.rmtree, named.removeprefix("file://"), True)
        spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def small_batches(spark: SparkSession) -> None:
    """Let the session hand out Arrow batches of BATCH_ROWS rows at most: texts are long, and both sides hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder, which outlives executors, and go on from there."""
    small_batches(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keyed_lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, parts: int = HOT_PARTS) -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each ``key`` and in ``weight`` its number of rows, ``total`` in all.

    Keys with over ``total / parts`` rows, at most ``parts`` of them, are broadcast, so their rows
    stay where they lie; no other key has many rows, so no task gets many. Rows without a match go.
    """
    most = total // parts
    hot = F.broadcast(table.where(F.col(weight) > most))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(weight) <= most), key)
    return rows.join(hot, key).unionByName(cold)


def if_few(table: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """``table`` with a hint to broadcast it if it has ``most`` rows at most, by count, else without; and whether it has."""
    few = table.limit(most + 1).count() <= most
    return (F.broadcast(table) if few else table), few


def cut_narrow(df: DataFrame, most: int | None = None) -> DataFrame:
    """``cut`` for rows of a few numbers, on as many partitions as these fill; ``most``: so many rows at most, if that is known before."""
    if most is not None:
        return cut(df.coalesce(most // NARROW_ROWS + 1))
    out = cut(df)
    return out.coalesce(out._jdf.queryExecution().toRdd().count() // NARROW_ROWS + 1)  # counted where they lie, without an exchange


def utf8_size(text: Column) -> Column:
    """Bytes of the text in UTF-8, 0 for null."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def beside(columns: list[str], *new: str) -> list[str]:
    """Names for input columns that stand beside ``new`` ones: those that clash, or repeat another, get ``_in`` behind, as often as needed."""
    taken, out = {n.lower() for n in new}, []
    for c in columns:
        while c.lower() in taken:
            c = f"{c}_in"
        taken.add(c.lower())
        out.append(c)
    return out


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as Parquet in a folder that all executors share; unlike a checkpoint, columns that aren't needed aren't read again."""
    small_batches(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new name in the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Take away what ``stored`` or a writer has left; nothing that reads it may still be wanted."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage: its heap shrinks again, and Spark's cleaner drops shuffles, broadcasts and checkpoints that nothing refers to."""
    spark.sparkContext._jvm.System.gc()


def named(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, by position, so that names that differ in case alone don't clash."""
    seen = {}
    for i, c in enumerate(df.columns):
        seen.setdefault(c, i)
    missing = [w for w in wanted if w not in seen]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    exact = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return exact.select(*[F.col(f"__c{seen[w]}").alias(w) for w in wanted])


def text_chunks(column: pa.Array, chars: int = CHUNK_CHARS, texts: int = CHUNK_TEXTS) -> Iterator[tuple[int, list[str]]]:
    """Whole texts (null: empty) in runs of about ``chars`` characters and ``texts`` texts at most; a longer text is a run of its own."""
    start, size, run = 0, 0, []
    for low in range(0, len(column), SLICE_TEXTS):  # a batch of long texts isn't turned into strings at once
        for i, value in enumerate(column.slice(low, SLICE_TEXTS).to_pylist(), low):
            text = value or ""
            if run and (size + len(text) > chars or len(run) >= texts):
                yield start, run
                start, size, run = i, 0, []
            run.append(text)
            size += len(text)
    if run:
        yield start, run


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on each Arrow batch; batches are bounded in rows by ``small_batches`` and in bytes by Spark's settings."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each run starts, and at the end the total."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def runs(sorted_keys: list[np.ndarray]) -> np.ndarray:
    """Start of each run of equal keys, and at the end the length; several columns make a key."""
    n = len(sorted_keys[0])
    if n == 0:
        return np.zeros(1, dtype=np.int64)
    new = np.zeros(n - 1, dtype=bool)
    for k in sorted_keys:
        new |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [n])).astype(np.int64)
