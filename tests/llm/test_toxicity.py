"""Toxicity: the automaton against plain edit distances, counts against brute force, held-out accuracy, misspellings and quotations."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distances():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(3, 8)))
    weights = {("=" if rng.random() < 0.7 else "^") + word(): round(rng.uniform(1, 9), 3) for _ in range(60)}
    words = [word() for _ in range(1500)] + [t[1:] for t in weights] + ["", "x", "日本語", "a" * 50]
    exact, near = toxicity.Automaton(weights).evidence(words)
    for w, e, n in zip(words, exact, near):
        want = max([v for t, v in weights.items() if (w == t[1:] if t[0] == "=" else w.startswith(t[1:]))], default=0)
        assert e == want, w
        close = [v for t, v in weights.items() if t[0] == "=" and len(t) > toxicity.FUZZY_LENGTH and v >= toxicity.FUZZY_WEIGHT and distance(w, t[1:]) == 1]
        assert n == (0 if want else max(close, default=0)), w


def corpus(n=1200):
    """Texts of invented words; toxic ones hold insults, or words of a stem with any ending."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ba", "ko", "ri", "tun", "sel", "mo", "fe"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(10, 120))]
        toxic = i % 7 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["wretched", "Vermin", "zqua" + word()]))
        docs.append((i, " ".join(words)))
        labels.append((i, None, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus()
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, labels, frames, toxicity.learn(*frames, ~toxicity.held_out("t_id"))


def test_counts_against_brute_force(spark, learned):
    docs, labels, frames, _ = learned
    rows = frames[0].join(frames[1], "doc_id").select((F.col("doc_id") % 2).alias("half"), "text")
    got = {(r["term"], r["half"]): (r["docs"], r["contexts"]) for r in toxicity._counted(rows).groupBy("term", "half").agg(F.sum("docs").alias("docs"), F.bit_or("contexts").alias("contexts")).collect()}
    want = defaultdict(lambda: [0, 0])
    for i, text in docs:
        words = text.lower().split()
        for w, after in zip(words, [*words[1:], None]):
            for t in toxicity._terms(w):
                want[t, i % 2][1] |= 1 if after is None else 1 << (zlib.crc32(after.encode()) & 63)
        for t in {t for w in words for t in toxicity._terms(w)}:
            want[t, i % 2][0] += 1
    assert got == {k: (n, bits - 2**64 if bits >= 2**63 else bits) for k, (n, bits) in want.items()}


def test_held_out_accuracy(spark, learned):
    docs, labels, frames, model = learned
    assert {"=wretched", "=vermin", "^zqua"} <= set(model.weights)
    got = {r["doc_id"]: r for r in toxicity.toxicity_report(*frames).collect()}
    assert len(got) == len(docs)
    for i, _, toxic in labels:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["predicted"] == toxic == int(got[i]["score"] >= 0.5)


def test_misspellings_and_quotations(learned):
    *_, model = learned
    automaton = toxicity.Automaton(model.weights, model.known)
    score = lambda t: float(1 / (1 + np.exp(-(toxicity.features(automaton, [t]) @ model.coefficients)[0])))
    plain = "ko ri you wretched vermin ba tun"
    assert score(plain) > 0.5 and score("ko ri you wretchd verm1n*** ba tun") > 0.5
    assert score("ko ri you ba tun") < 0.5
    quoted = 'ko ri he was called "wretched vermin" by them ba tun'
    assert score(quoted) < score(quoted.replace('"', "")) and score("») « " + quoted.replace('"', "")) > 0.5
    copies = toxicity.features(automaton, [plain, plain.upper(), None, "", "..."])
    assert (copies[0] == copies[1]).all() and (copies[2:, 1:] == 0).all()


def test_odd_tables(spark, learned):
    *_, frames, model = learned
    rows = [(None, "vermin", 1), (1, None, 1), (2, "", 1), (3, "vermin wretched zquako " * 20000, 1), (4, "ba", 1), (4, "ba", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = sorted(((r["doc_id"], r["held_out"], r["predicted"], r["score"]) for r in toxicity.toxicity_report(odd, frames[1]).collect()), key=str)
    # Without a text to learn from all scores are that of no evidence.
    assert [g[0] for g in got] == [1, 2, 3, 4, 4, None] and {g[2] for g in got} == {0} and got[-1][1] is None
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert scored[3] > 0.5 > scored[1] == scored[2] == scored[4]
    none = odd.limit(0)
    assert toxicity.toxicity_report(none, frames[1].limit(0)).collect() == []
    unlabelled = frames[1].withColumn("toxic", F.lit(None).cast("int"))
    assert toxicity.learn(frames[0], unlabelled, F.lit(True)).weights == {}


def test_copies_make_no_entries(spark):
    """Words of one copied document are no lexicon, however often it is copied."""
    rng = random.Random(5)
    text = " ".join(f"copied{rng.randrange(10**6)}x" for _ in range(40))
    docs, labels = corpus(600)
    docs += [(10_000 + i, text) for i in range(60)]
    labels += [(10_000 + i, None, 1) for i in range(60)]
    model = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    assert not [t for t in model.weights if t.startswith("=copied")]
