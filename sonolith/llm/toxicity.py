"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon turns the words of a clause into symbols: insult, threat, target, negator, report, intent
or other. Five weighted transducers, for negation, reported speech, targets, threats and insults, are
composed into one machine that reads the symbols and gives a factor for each; marks that come from
words further on are set by a machine that reads the clause from its end. A clause scores the sum of
its words' weights times their factors, so a threat without anybody addressed scores nothing, and a
negated or reported one little. Insult stems and their weights are learned from labels, and so is
the curve from evidence to score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.llm.common import arrow_map, beside, cut, id_bucket, named, text_chunks

OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORT, INTENT = range(7)
# Marks of an insult or a threat.
NEGATED, REPORTED, AIMED = 8, 16, 32
#: Words that a negator, somebody addressed, and an intent reach.
NEGATION_REACH, TARGET_REACH, INTENT_REACH = 3, 5, 4
#: Labelled documents to learn from, about; more are thinned by a hash of the id.
SAMPLE_DOCS = 12_000
#: Letters of a stem; a stem's least log-likelihood ratio and least log odds.
STEM_LETTERS, LEAST_RATIO, LEAST_ODDS = range(3, 8), 24.0, 1.6
#: Weight of a threat; factors of transitions.
THREAT_WEIGHT, NEGATED_FACTOR, REPORTED_FACTOR, AIMED_FACTOR, VAGUE_FACTOR, PILED_FACTOR = 4.0, 0.2, 0.3, 1.5, 0.8, 1.2
#: Characters that accidental evidence is told by; evidence that counts as accidental in any text.
PER_CHARS, FLOOR = 1000, 0.1
THRESHOLD = 0.7

# Closed word classes in English, German, French and Spanish.
WORDS = {
    THREAT: (
        "kill kills killing murder hurt beat stab shoot strangle destroy töten tötet töte umbringen bringe schlagen erschlagen erschießen vernichten "
        "tuer tue tuerai tuerons détruire frapper frapperai étrangler matar mato mataré mataremos matarte destruir golpear pegar"
    ),
    TARGET: "you your yours they them he she him her du dich dir dein deine ihr euch sie ihn tu toi te vous ils elles lui leur tú ti usted ustedes os ellos ellas lo la",
    NEGATOR: "not never no isn't aren't don't won't wouldn't cannot can't nicht kein keine nie niemals pas jamais aucun nunca jamás tampoco",
    REPORT: "said says say told called wrote writes quoted claimed sagte sagt nannte schrieb behauptete dit disait écrivait prétend dijo dice llamó escribió",
    INTENT: "will shall gonna going must i'll we'll werde werden will wollen muss vais allons veux voy vamos quiero",
}
_CLOSED = {w: kind for kind, words in WORDS.items() for w in words.split()}
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_LETTERS = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;\n]+")

Step = Callable[[Hashable, int], tuple[Hashable, int, float]]


@dataclass(frozen=True)
class Transducer:
    """A weighted machine that reads a symbol and gives one: (state, symbol) -> (state, symbol, factor)."""

    start: Hashable
    step: Step

    def then(self, other: Transducer) -> Transducer:
        """Both in one: what this gives, the other reads; factors are multiplied."""

        def step(state: Hashable, x: int) -> tuple[Hashable, int, float]:
            s, y, f = self.step(state[0], x)
            t, z, g = other.step(state[1], y)
            return (s, t), z, f * g

        return Transducer((self.start, other.start), step)

    def compiled(self, alphabet: list[int]) -> Machine:
        """All states that the alphabet reaches, as numbers."""
        number, todo, table = {self.start: 0}, [self.start], []
        while todo:
            state = todo.pop(0)
            row = {}
            for x in alphabet:
                to, y, factor = self.step(state, x)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row[x] = (number[to], y, factor)
            table.append(row)
        return Machine(table)


@dataclass(frozen=True)
class Machine:
    table: list[dict[int, tuple[int, int, float]]]

    def run(self, symbols: list[int]) -> tuple[list[int], list[float]]:
        """What is given for each symbol, and its factor."""
        state, out, factors = 0, [], []
        for x in symbols:
            state, y, f = self.table[state][x]
            out.append(y)
            factors.append(f)
        return out, factors


def _hit(x: int) -> bool:
    return x & 7 in (INSULT, THREAT)


def _near(opener: int, mark: int, reach: int, factor: float = 1.0, kinds: tuple[int, ...] = (INSULT, THREAT)) -> Transducer:
    """Marks hits up to ``reach`` symbols behind an opener (0: all behind it); hits with the mark have ``factor``, if of ``kinds``."""

    def step(left: int, x: int) -> tuple[int, int, float]:
        y = x | mark if left and _hit(x) else x
        to = (reach or 1) if x & 7 == opener else left if not reach else max(0, left - 1)
        return to, y, factor if y & mark and y & 7 in kinds else 1.0

    return Transducer(0, step)


def _threats() -> Transducer:
    """A threat counts if it is aimed at somebody, less without an intent before it."""

    def step(left: int, x: int) -> tuple[int, int, float]:
        to = INTENT_REACH if x & 7 == INTENT else max(0, left - 1)
        if x & 7 != THREAT:
            return to, x, 1.0
        return to, x, (1.0 if left else VAGUE_FACTOR) if x & AIMED else 0.0

    return Transducer(0, step)


def _insults() -> Transducer:
    """Insults after the first of a clause weigh more."""

    def step(seen: int, x: int) -> tuple[int, int, float]:
        insult = x & 7 == INSULT
        return int(seen or insult), x, PILED_FACTOR if insult and seen else 1.0

    return Transducer(0, step)


_PLAIN = list(range(7))
_MARKED = sorted({*_PLAIN, *(k | m for k in (INSULT, THREAT) for m in (NEGATED, AIMED, NEGATED | AIMED))})


def grammar() -> tuple[Machine, Machine]:
    """What is read from a clause's end (negators and targets that follow), and then from its beginning."""
    backward = _near(NEGATOR, NEGATED, NEGATION_REACH).then(_near(TARGET, AIMED, TARGET_REACH))
    negation = _near(NEGATOR, NEGATED, NEGATION_REACH, NEGATED_FACTOR)
    report = _near(REPORT, REPORTED, 0, REPORTED_FACTOR)
    target = _near(TARGET, AIMED, TARGET_REACH, AIMED_FACTOR, (INSULT,))
    forward = negation.then(report).then(target).then(_threats()).then(_insults())
    return backward.compiled(_PLAIN), forward.compiled(_MARKED)


_BACKWARD, _FORWARD = grammar()


def clause_score(symbols: list[int], weights: list[float]) -> float:
    """Sum of weights times factors; symbols other than insults and threats have weight 0."""
    marked = _BACKWARD.run(symbols[::-1])[0][::-1]
    return sum(w * f for w, f in zip(weights, _FORWARD.run(marked)[1], strict=True) if w)


def stems(text: str) -> set[str]:
    """Beginnings of the text's words, and the words themselves with ``|`` behind."""
    words = set(_LETTERS.findall(text.lower()))
    return {w[:k] for w in words for k in STEM_LETTERS if len(w) >= k} | {f"{w}|" for w in words if len(w) >= STEM_LETTERS[0]}


class Lexicon:
    """Insult stems with weights, as an automaton over lower-case text."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.automaton = ahocorasick.Automaton()
        for stem, w in weights.items():
            word = stem.rstrip("|")
            # of a stem and a word that are spelled alike, the stem says more
            if word not in self.automaton or not stem.endswith("|"):
                self.automaton.add_word(word, (len(word), stem.endswith("|"), w))
        for word, kind in _CLOSED.items():
            if kind == THREAT and word not in self.automaton:
                self.automaton.add_word(word, (len(word), True, 0.0))
        self.automaton.make_automaton()

    def hits(self, low: str) -> dict[int, float]:
        """Where insults (weight) and threats (0) begin."""
        out: dict[int, float] = {}
        n = len(low)
        for end, (size, whole, w) in self.automaton.iter(low):
            at = end - size + 1
            if (at and low[at - 1].isalpha()) or (whole and end + 1 < n and low[end + 1].isalpha()):
                continue
            out[at] = max(out.get(at, 0.0), w)
        return out

    def evidence(self, text: str) -> float:
        """Sum of the scores of the clauses that have a hit, in one pass over the text."""
        low = text.lower()
        hits = self.hits(low)
        starts = iter(sorted(hits))
        at = next(starts, None)
        total, begin = 0.0, 0
        for m in chain(_CLAUSE.finditer(low), (None,)):
            if at is None:
                break
            end = m.start() if m else len(low)
            if at < end:
                total += self._clause(low, begin, end, hits)
                while at is not None and at < end:
                    at = next(starts, None)
            begin = m.end() if m else end
        return total

    def _clause(self, low: str, begin: int, end: int, hits: dict[int, float]) -> float:
        symbols, weights = [], []
        for m in _WORD.finditer(low, begin, end):
            # behind an elision (l', d', qu') the word begins anew
            tail = m.start() + m.group().find("'") + 1
            kind = _CLOSED.get(m.group()) or _CLOSED.get(low[tail : m.end()], OTHER)
            w = max(hits.get(m.start(), 0.0), hits.get(tail, 0.0))
            if w:
                kind = INSULT
            symbols.append(kind)
            weights.append(THREAT_WEIGHT if kind == THREAT else w)
        return clause_score(symbols, weights)


@dataclass(frozen=True)
class ToxicityModel:
    """Stem weights; evidence that clean texts have by PER_CHARS characters; bias and slope of the logistic curve.

    The curve is over log(1 + evidence / (FLOOR + what a clean text of this length would have)).
    """

    weights: dict[str, float]
    noise: float
    bias: float
    slope: float

    def scores(self, texts: list[str], lexicon: Lexicon) -> np.ndarray:
        evidence = np.array([lexicon.evidence(t) for t in texts], dtype=np.float64)
        x = excess(evidence, np.array([len(t) for t in texts]), self.noise)
        return 1 / (1 + np.exp(-(self.bias + self.slope * x)))


def excess(evidence: np.ndarray, chars: np.ndarray, noise: float) -> np.ndarray:
    return np.log1p(evidence / (FLOOR + noise * chars / PER_CHARS))


def _ratio(a: int, b: int, n_a: int, n_b: int) -> float:
    """Log-likelihood ratio of a in n_a against b in n_b."""

    def part(k: float, n: float, p: float) -> float:
        return (k * np.log(p) if k else 0.0) + ((n - k) * np.log(1 - p) if n > k else 0.0)

    p = (a + b) / (n_a + n_b)
    if not 0 < p < 1:
        return 0.0
    return 2 * float(part(a, n_a, a / n_a) + part(b, n_b, b / n_b) - part(a, n_a, p) - part(b, n_b, p))


def choose_stems(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Stems that tell, each as long as its support lasts, none beginning with another; with log odds."""
    good = {}
    for s, a in toxic.items():
        b = clean.get(s, 0)
        odds = float(np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1)))
        if odds >= LEAST_ODDS and _ratio(a, b, n_toxic, n_clean) >= LEAST_RATIO:
            good[s] = odds
    longer: dict[str, int] = {}
    for s in good:
        for k in range(STEM_LETTERS[0], len(s)):
            if (p := s[:k]) in good:
                longer[p] = max(longer.get(p, 0), toxic[s])
    closed = {s for s in good if longer.get(s, 0) < 0.9 * toxic[s]}
    kept: dict[str, float] = {}
    for s in sorted(closed, key=lambda s: (len(s), s)):
        if not any(s[:k] in kept for k in range(STEM_LETTERS[0], len(s))):
            kept[s] = good[s]
    return kept


def fit_curve(x: np.ndarray, label: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Bias and slope of the logistic curve over x, by Newton's method with a little ridge; the slope is 0 at least."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(hess, z.T @ (p - label) + ridge * w)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """A model from the labelled rows that are ``usable`` (a condition on the id).

    Of more than ``sample_docs`` labelled rows about that many are taken, chosen by a hash of the
    id; they alone are joined to the texts, so the broadcast side is bounded. Rows without a label
    are not looked at; an id labelled twice counts as toxic if one of the labels says so.
    """
    told = named(labels, id_col, label_col).where(usable).toDF("id", "label").where("id is not null and label is not null").select("id", (F.col("label") > 0).cast("int").alias("label"))
    share = int(min(1.0, sample_docs / max(told.count(), 1)) * (1 << 30))
    picked = told.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).groupBy("id").agg(F.max("label").alias("label"))
    sample = cut(named(docs, id_col, text_col).toDF("id", "text").join(F.broadcast(picked), "id").select("text", "label"))
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel({}, 0.0, -20.0, 0.0)

    def counts(wanted: frozenset[str] | None):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c: Counter[str] = Counter()
            for b in batches:
                for text in b.column(0).to_pylist():
                    found = stems(text or "")
                    c.update(found if wanted is None else found & wanted)
                if len(c) > 500_000:
                    yield pa.RecordBatch.from_pydict({"stem": list(c), "n": list(c.values())})
                    c.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["stem", "n"])

        return work

    least = max(4, n_toxic // 200)
    in_toxic = sample.where("label = 1").select("text").mapInArrow(counts(None), "stem string, n long")
    toxic = {r["stem"]: r["n"] for r in in_toxic.groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toLocalIterator()}
    in_clean = sample.where("label = 0").select("text").mapInArrow(counts(frozenset(toxic)), "stem string, n long")
    clean = {r["stem"]: r["n"] for r in in_clean.groupBy("stem").agg(F.sum("n").alias("n")).toLocalIterator()}
    weights = choose_stems(toxic, clean, n_toxic, n_clean)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lexicon, texts = Lexicon(weights), [t or "" for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([lexicon.evidence(t) for t in texts]), pa.array([len(t) for t in texts], pa.int64()), batch.column(1)], names=["evidence", "chars", "label"])

    seen = arrow_map(sample, work, "evidence double, chars long, label int").toArrow()  # three numbers for each sampled row
    evidence, chars, label = (seen.column(i).to_numpy() for i in range(3))
    noise = float(evidence[label == 0].sum() * PER_CHARS / max(chars[label == 0].sum(), 1))
    return ToxicityModel(weights, noise, *fit_curve(excess(evidence, chars, noise), label.astype(np.float64)))


def kept(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with their columns, whatever these are named."""
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.weights)
        for batch in batches:
            for start, texts in text_chunks(batch.column(at)):
                yield batch.slice(start, len(texts)).filter(pa.array(model.scores(texts, lexicon) < THRESHOLD))

    return inner.mapInArrow(run, inner.schema).toDF(*df.columns)


def scored(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """All rows and columns, with score (0 to 1) and predicted (1 from THRESHOLD on) behind them.

    Whole texts are scored, from their words alone. Null and empty texts, and all texts without
    insults or threats, have the least score that the model gives. Input columns named score or
    predicted, or like another, get ``_in`` behind their names.
    """
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.weights)
        for batch in batches:
            for start, texts in text_chunks(batch.column(at)):
                score = model.scores(texts, lexicon)
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    schema = T.StructType([*inner.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return inner.mapInArrow(run, schema).toDF(*beside(df.columns, "score", "predicted"), "score", "predicted")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(id_bucket(id_col, 3) == 1, F.lit(False))
