"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the product of its letters' vectors,
each rotated by its place; a text or a language is the sum of its trigrams' vectors. A text goes to
the language whose vector has the greatest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.llm.common import arrow_map, beside, id_bucket, named, starts_of, text_chunks
from sonolith.llm.pieces import LETTER, classes, code_points

#: Length of the vectors, letters that have their own (others share by hash), seed of the vectors.
DIMENSIONS, SYMBOLS, SEED = 1024, 64, 20240229
#: Labelled documents that profiles are learned from, about; more than these are thinned by a hash of the id.
SAMPLE_DOCS = 20_000
#: Texts whose counts of trigrams are held at a time, 4,096 trigrams each (32 MB).
CHUNK = 1024
UNDETERMINED = "und"


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, DIMENSIONS))
    return np.roll(one, 2, axis=1), np.roll(one, 1, axis=1), one


@cache
def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 is no letter, 1 to 26 are a to z, other letters are spread over the rest."""
    cp = np.arange(len(classes()), dtype=np.uint64)
    out = (27 + ((cp * np.uint64(2654435761)) >> np.uint64(12)) % np.uint64(SYMBOLS - 27)).astype(np.int64)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[classes() != LETTER] = 0
    return out


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vector of each text, as float32 rows, and its number of letters."""
    low = [f" {t.lower()} " for t in texts]
    at = starts_of(np.array([len(t) for t in low]))
    sym = _symbols()[code_points("".join(low))]
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    letters = np.bincount(doc[sym > 0], minlength=len(texts))
    keep = np.ones(len(sym), dtype=bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (doc[1:] != doc[:-1])
    sym, doc = sym[keep], doc[keep]
    gram = (sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:]
    inside = doc[:-2] == doc[2:]
    gram, doc = gram[inside], doc[:-2][inside]
    used = np.zeros(SYMBOLS**3, dtype=bool)
    used[gram] = True
    kinds = np.flatnonzero(used)
    place = np.zeros(SYMBOLS**3, dtype=np.int64)
    place[kinds] = np.arange(len(kinds))
    second, first, plain = _letters()
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    column = place[gram]
    for i in range(0, len(kinds), 4096):  # trigrams' vectors are made as they are needed
        k = kinds[i : i + 4096]
        mine = (column >= i) & (column < i + len(k))
        counts = np.bincount(doc[mine] * len(k) + column[mine] - i, minlength=len(texts) * len(k)).reshape(len(texts), len(k))
        vectors = second[k // SYMBOLS**2] * first[k // SYMBOLS % SYMBOLS] * plain[k % SYMBOLS]
        out += counts.astype(np.float32) @ vectors.astype(np.float32)
    return out, letters


@dataclass(frozen=True)
class Profiles:
    """Languages and their vectors, each of length 1."""

    langs: list[str]
    vectors: np.ndarray

    def compare(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its cosine, 0 at least; ``und`` and 0 without letters or languages."""
        own, letters = bundles(texts)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        size = np.linalg.norm(own, axis=1)
        cos = (own @ self.vectors.T) / np.where(size > 0, size, 1)[:, None]
        best = cos.argmax(axis=1)  # the first in order of name, if tied
        known = letters > 0
        score = np.where(known, np.clip(cos[np.arange(len(texts)), best], 0, 1), 0.0).astype(np.float64)
        return [self.langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], score


def learn(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Profiles:
    """Profiles from the rows that are ``usable`` (a condition on the three columns) and have a language.

    Of more than ``sample_docs`` such rows about that many are taken, chosen by a hash of the id.
    The texts' vectors are summed on the executors; the driver gets one vector a language.
    """
    labelled = named(df, id_col, lang_col, text_col).where(usable).toDF("id", "lang", "text").where("lang is not null")
    n = labelled.count()
    share = int(min(1.0, sample_docs / max(n, 1)) * (1 << 30))
    sample = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).select("lang", "text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for at, texts in text_chunks(batch.column(1), texts=CHUNK):
            own, _ = bundles(texts)
            size = np.linalg.norm(own, axis=1)
            own = own / np.where(size > 0, size, 1)[:, None]  # texts count alike, whatever their length
            mine = langs[at : at + len(texts)]
            names = sorted(set(mine))
            sums = [own[mine == x].sum(axis=0, dtype=np.float64) for x in names]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums, pa.list_(pa.float64()))], names=["lang", "sum"])

    sums = arrow_map(sample, work, "lang string, sum array<double>")
    rows = sums.select("lang", F.posexplode("sum")).groupBy("lang", "pos").agg(F.sum("col").alias("v")).collect()
    langs = sorted({r["lang"] for r in rows})
    vectors = np.zeros((len(langs), DIMENSIONS))
    for r in rows:
        vectors[langs.index(r["lang"]), r["pos"]] = r["v"]
    size = np.linalg.norm(vectors, axis=1)
    return Profiles(langs, (vectors / np.where(size > 0, size, 1)[:, None]).astype(np.float32))


def identify(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row, from its whole text alone.

    Score is the cosine, from 0 to 1. A null text, or one without a letter, is ``und`` with 0, as is
    every text if there are no profiles. Ties go to the language first by name.
    """
    source = named(df, id_col, text_col)
    id_type = source.schema[0].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, texts in text_chunks(batch.column(1), texts=CHUNK):
            langs, score = profiles.compare(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(langs), pa.array(score)], names=["id", "lang_pred", "score"])

    return arrow_map(source, work, f"id {id_type}, lang_pred string, score double").toDF(id_col, "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(id_bucket(id_col, 5) == 0, F.lit(False))


def kept(df: DataFrame, profiles: Profiles, least: float, text_col: str = "text") -> DataFrame:
    """The rows with a letter and a cosine of ``least`` or more, with their columns, whatever these are named."""
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = df.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, texts in text_chunks(batch.column(at), texts=CHUNK):
            langs, score = profiles.compare(texts)
            yield batch.slice(start, len(texts)).filter(pa.array((np.array(langs) != UNDETERMINED) & (score >= least)))

    return arrow_map(inner, work, inner.schema).toDF(*df.columns)


def identified(df: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """All rows and columns, with lang_pred and score behind them; input columns of these names, or like another, get ``_in`` behind theirs."""
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = df.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, texts in text_chunks(batch.column(at), texts=CHUNK):
            langs, score = profiles.compare(texts)
            part = batch.slice(start, len(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs), pa.array(score)], names=[*part.schema.names, "lang_pred", "score"])

    schema = T.StructType([*inner.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return arrow_map(inner, work, schema).toDF(*beside(df.columns, "lang_pred", "score"), "lang_pred", "score")
