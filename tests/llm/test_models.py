from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.llm import language_id, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LANGS = {"xx": ["ban", "bor", "bil", "ta"], "yy": ["qué", "quo", "zur", "ñe"], "zz": ["schl", "ung", "ö", "keit"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        lang = rng.choice(list(LANGS))
        rows.append((i, prose(rng, lang, rng.randint(8, 60)), lang if i % 10 else None, "s", 0))
    rows += [(900, None, "xx", "s", 0), (901, "", "yy", "s", 0), (902, "123 -- 456", "zz", "s", 0), (903, prose(rng, "yy", 40_000), None, "s", 0), (None, prose(rng, "zz", 30), None, "s", 0), (900, None, "xx", "s", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_languages_of_held_out_documents(corpus):
    held = language_id.held_out()
    profiles = language_id.learn(corpus, ~held)
    assert profiles.langs == sorted(LANGS)
    got = language_id.identify(corpus, profiles).withColumn("held", held).join(corpus.select("doc_id", "lang", "text").distinct(), "doc_id").collect()
    tested = [r for r in got if r.held and r.lang and r.doc_id < 900]
    assert len(tested) > 30 and sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.97
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert {r.lang_pred for r in got if r.doc_id == 903} == {"yy"}


def test_language_rows_and_clashes(corpus):
    p = language_id.learn(corpus, F.lit(True), sample_docs=50)
    out = language_id.identified(corpus, p)
    assert out.columns == [*corpus.columns, "lang_pred", "score"] and out.count() == corpus.count()
    other = language_id.identified(corpus.toDF("doc_id", "text", "Score", "LANG", "TEXT"), p)
    assert other.columns == ["doc_id", "text", "Score_in", "LANG", "TEXT_in", "lang_pred", "score"]
    assert sorted(map(str, other.drop("TEXT_in", "LANG").collect())) == sorted(map(str, out.withColumnRenamed("lang", "Score_in").drop("source", "n_chars").collect()))
    twice = language_id.learn(corpus.toDF("doc_id", "text", "lang", "LANG", "DOC_ID"), F.col("doc_id") >= 0)
    assert twice.langs == sorted(LANGS)
    empty = corpus.limit(0)
    none = language_id.learn(empty, F.lit(True))
    assert none.langs == [] and language_id.identify(empty, none).collect() == []
    assert {r.lang_pred for r in language_id.identify(corpus, none).collect()} == {"und"}


def test_bundles_are_sums_of_trigram_vectors():
    second, first, plain = language_id._letters()
    sym = language_id._symbols()
    text = "Ab, cé"
    low = f" {text.lower()} "
    seq = []
    for ch in low:
        s = int(sym[ord(ch)])
        if s or not seq or seq[-1]:
            seq.append(s)
    want = sum(second[a].astype(int) * first[b] * plain[c] for a, b, c in zip(seq, seq[1:], seq[2:], strict=False))
    got, letters = language_id.bundles([text, "", text + text])
    assert (got[0] == want).all() and letters.tolist() == [4, 0, 8] and (got[1] == 0).all()


WORDS = "ab cd ef gh ij kl mn op qr st the of and".split()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(10, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["dolt", "vexo" + rng.choice(WORDS), "vexo" + rng.choice(WORDS)]))
        rows.append((i, " ".join(words).capitalize() + ".", "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "clean " * 50_000 + "dolt vexoab", "en", "s", 0), (None, "dolt dolt vexocd", "en", "s", 0), (1000, None, "en", "s", 0)]
    labels += [(5000, None, 1), (5001, 1, None), (None, 1, 1), (0, 1, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_stems_and_scores_held_out(labelled):
    docs, labels = labelled
    held = toxicity.held_out()
    model = toxicity.learn(docs, labels, ~held)
    assert set(model.weights) == {"dolt", "vexo"} or {s.rstrip("|")[:4] for s in model.weights} == {"dolt", "vexo"}
    got = toxicity.scored(docs, model).withColumn("held", held).collect()
    assert len(got) == 605
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None and r.doc_id < 600:
            assert r.predicted == int(r.doc_id % 6 == 0)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].predicted == by_id[1001].predicted == 0 and by_id[1000].score == by_id[1001].score
    assert by_id[1002].predicted == 1 and by_id[None].predicted == 1


def test_toxicity_without_labels_or_rows(labelled):
    docs, labels = labelled
    model = toxicity.learn(docs, labels.limit(0), F.lit(True))
    assert model.weights == {} and {r.predicted for r in toxicity.scored(docs, model).collect()} == {0}
    assert toxicity.scored(docs.limit(0), model).collect() == []
    assert toxicity.scored(docs.withColumnRenamed("source", "Score"), model).columns == ["doc_id", "text", "lang", "Score_in", "n_chars", "score", "predicted"]
    twice = toxicity.learn(docs.withColumnRenamed("lang", "DOC_ID"), labels.withColumnRenamed("quality", "TOXIC"), ~toxicity.held_out())
    assert twice.weights == toxicity.learn(docs, labels, ~toxicity.held_out()).weights


def test_grammar_marks_scope():
    lex = toxicity.Lexicon({"dolt": 4.0})
    plain = lex.evidence("What a dolt.")
    assert plain == 4.0
    assert lex.evidence("He is not a dolt.") < plain
    assert lex.evidence("They said dolt.") < lex.evidence("They went dolt.")
    assert lex.evidence("You dolt.") > plain
    assert lex.evidence("Not here. What a dolt.") == plain
    assert lex.evidence("adolt dolts") == 4.0
    assert lex.evidence("I will kill you.") == toxicity.THREAT_WEIGHT and lex.evidence("I will kill time.") == 0
    assert lex.evidence("") == 0 and lex.evidence("nothing here") == 0


def test_threats_are_negated_and_reported_in_either_order():
    lex = toxicity.Lexicon({"dolt": 4.0})
    plain = lex.evidence("I will kill you")
    for weaker in ("I will never kill you", "I do not kill you", "Anna said kill you", "Anna said I will kill you", "je ne te tuerai pas", "ich töte dich nicht"):
        assert 0 < lex.evidence(weaker) < plain / 2
    assert 0 < lex.evidence("kill you") < plain
    assert lex.evidence("you, I will kill") == plain and lex.evidence("te voy a matar") == plain
    assert lex.evidence("I will kill time") == 0 and lex.evidence("kill. You") == 0
    assert lex.evidence("a dolt, dolt") > 2 * lex.evidence("a dolt")


def test_long_texts_take_one_pass():
    lex = toxicity.Lexicon({"dolt": 4.0})
    for sep in (". ", " "):
        short, long = ("I will kill you and a dolt" + sep) * 2_000, ("I will kill you and a dolt" + sep) * 40_000
        took = []
        for text in (short, long):
            began = time.process_time()
            assert lex.evidence(text) > 0
            took.append(time.process_time() - began)
        assert took[1] < 100 * max(took[0], 0.01)


def test_composition_is_running_one_after_the_other():
    rng = random.Random(1)
    plain = list(range(7))
    marked = toxicity._MARKED
    a = toxicity._near(toxicity.NEGATOR, toxicity.NEGATED, 3, 0.5)
    b = toxicity._near(toxicity.REPORT, toxicity.REPORTED, 0, 0.25)
    both, first, second = a.then(b).compiled(plain), a.compiled(plain), b.compiled(marked)
    for _ in range(200):
        s = [rng.randrange(7) for _ in range(rng.randrange(12))]
        mid, f = first.run(s)
        out, g = second.run(mid)
        assert both.run(s) == (out, [x * y for x, y in zip(f, g, strict=True)])
    assert len(toxicity._FORWARD.table) > 100  # five machines in one


def test_curve_separates():
    e = np.log1p(np.array([0.0] * 50 + [8.0] * 20))
    bias, slope = toxicity.fit_curve(e, (e > 0).astype(float))
    p = 1 / (1 + np.exp(-(bias + slope * e)))
    assert p[:50].max() < 0.1 and p[50:].min() > 0.9 and toxicity.fit_curve(-e, (e > 0).astype(float))[1] == 0


def test_held_out_labels_are_met(spark):
    """On the largest table: of held-out documents nine tenths of the toxic ones are found, one in two hundred of the others."""
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.learn(docs, labels, ~toxicity.held_out())
    got = toxicity.scored(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(toxicity.held_out() & F.col("toxic").isNotNull())
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n[1, 0]) and n.get((0, 1), 0) <= 0.005 * (n.get((0, 1), 0) + n[0, 0])


def test_held_out_languages_are_met(spark):
    """On the largest table: 99 of 100 held-out documents get their label's language."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = language_id.held_out()
    got = language_id.identify(docs, language_id.learn(docs, ~held)).join(docs.select("doc_id", "lang"), "doc_id").where(held & F.col("lang").isNotNull())
    right, all_ = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert all_ > 1500 and right >= 0.99 * all_
