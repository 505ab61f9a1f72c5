"""Exact deduplication by progressive refinement, in DataFrame operations only.

Length, then a hash of the first characters, then the hash of the whole text: each level only looks
at groups in which the level before left two rows or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import cut, if_few, keyed_lookup, named, utf8_size

#: Characters of the second level; groups of two or more up to which, by count, they are broadcast (under 100 bytes each).
PREFIX_CHARS, BROADCAST_GROUPS = 64, 500_000


def _content(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _hash(text: str) -> Column:
    return F.unhex(F.sha2(_content(text).cast("binary"), 256))


def _few(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast if its rows are few by count; beyond that rows are dealt by key and skewed parts are split."""
    return if_few(table, BROADCAST_GROUPS)[0]


def _levels(keyed: DataFrame) -> DataFrame:
    """(size, prefix) of groups that two rows or more are left in, by length and then by prefix hash."""
    first = cut(keyed.groupBy("size", "prefix").agg(F.count(F.lit(1)).alias("n")))  # partial sums: copies don't travel
    lengths = first.groupBy("size").agg(F.sum("n").alias("n")).where("n > 1").select("size")
    return cut(first.join(lengths, "size", "left_semi").where("n > 1").select("size", "prefix", F.lit(True).alias("open")))


def _keyed(inner: DataFrame, text: str) -> DataFrame:
    return inner.withColumns({"size": utf8_size(F.col(text)), "prefix": F.xxhash64(F.substring(_content(text), 1, PREFIX_CHARS))})


def mark_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """For each row: id, keep_id, group_size, kept (and text_sha256 if ``digest_all``).

    Texts are equal when identical; null counts as empty, and empty texts are equal to each other.
    Of equal texts the row with the largest id stays; null ids rank last. Of rows that repeat both
    id and text exactly one is kept. A group of any size passes through partial sums and one row
    per (id, text), and meets its result by broadcast if it is large, so no task holds a group. An
    empty table gives an empty result. Other columns, whatever their names, are not looked at.
    """
    keyed = _keyed(named(df, id_col, text_col).toDF("id", "text"), "text")
    # only survivors have their whole content read and hashed
    refined = keyed.join(_few(_levels(keyed)), ["size", "prefix"], "left").withColumn("sha", F.when(F.col("open"), _hash("text")))
    digest = [F.coalesce(F.col("sha"), _hash("text")).alias("digest")] if digest_all else []
    rows = cut(refined.select("id", "sha", *digest))
    alone = rows.where("sha is null").select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), *([F.lower(F.hex("digest")).alias("text_sha256")] if digest_all else []),
    )
    ids, groups, total = _groups(rows)
    shared = keyed_lookup(ids, groups, "sha", "group_size", total).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    shared = shared.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        *([F.lower(F.hex("sha")).alias("text_sha256")] if digest_all else []),
    )
    return alone.unionByName(shared)


def _groups(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(sha, id, copies), (sha, keep_id, group_size) and the number of rows, of those that have a sha."""
    ids = cut(rows.where("sha is not null").groupBy("sha", "id").agg(F.count(F.lit(1)).alias("copies")))
    groups = cut(ids.groupBy("sha").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size")))
    return ids, groups, int(groups.agg(F.sum("group_size")).first()[0] or 0)


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns in order.

    Rules as in ``mark_exact``. Where rows repeat both id and text, one of them stays; which of
    them, if they differ in other columns, is the one that is least by those columns' hash. Rows
    whose length or prefix is their own are neither hashed nor moved; others meet the groups of two
    or more by broadcast while these are few.
    """
    columns = [f"c{i}" for i in range(len(df.columns))]
    id_at, text_at = (columns[df.columns.index(c)] for c in (id_col, text_col))
    keyed = _keyed(df.toDF(*columns), text_at)
    refined = keyed.join(_few(_levels(keyed)), ["size", "prefix"], "left").withColumn("sha", F.when(F.col("open"), _hash(text_at)))
    ids, groups, total = _groups(cut(refined.where("open").select(F.col(id_at).alias("id"), "sha")))
    pairs = groups.where("group_size > 1")
    stays = keyed_lookup(ids, pairs, "sha", "group_size", total).where(F.col("id").eqNullSafe(F.col("keep_id")))
    decided = cut(stays.select("sha", "keep_id", F.lit(True).alias("group"), (F.col("copies") > 1).alias("twice")))
    table, few = if_few(decided, BROADCAST_GROUPS)
    # rows without a sha have no group; where rows are dealt by sha, these stay out of it
    found = refined.join(table, "sha", "left") if few else refined.where("open").join(table, "sha", "left")
    mine = F.col(id_at).eqNullSafe(F.col("keep_id"))
    out = found.where(F.col("group").isNull() | (mine & ~F.col("twice"))).select(*columns)
    if not few:
        out = out.unionByName(refined.where("open is null").select(*columns))
    if not decided.where("twice").isEmpty():
        again = found.where(F.col("group") & mine & F.col("twice")).groupBy("sha", id_at)
        out = out.unionByName(again.agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*"))
    return out.toDF(*df.columns)
