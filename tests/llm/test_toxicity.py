"""Toxicity: the label model on votes of known making, scores against plain Python, accuracy on held-out labels."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostgrain.llm import queries
from hostgrain.llm.toxicity import LEXICON, LabelModel, ToxicityModel, features_of, fit_linear, held_out, score_toxicity, train_toxicity

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, score double, predicted int, toxic int"


def made_votes(seed=3, n=4000):
    """Eight voters that fire by class alone, and five copies of one bad voter."""
    r = np.random.default_rng(seed)
    y = (r.random(n) < 0.3).astype(int)
    fires = np.array([[0.02, 0.6], [0.05, 0.5], [0.01, 0.3], [0.1, 0.7], [0.03, 0.4], [0.05, 0.6], [0.02, 0.5], [0.04, 0.3]])
    good = (r.random((n, len(fires))) < fires[:, y].T).astype(float)
    bad = (r.random(n) < np.where(y == 1, 0.5, 0.3)).astype(float)
    return y, fires, np.column_stack([good, *[bad] * 5])


def posterior_in_loops(model, votes, given):
    out = []
    for row, said in zip(votes, given):
        z = math.log(model.prior / (1 - model.prior))
        for fired, p0, p1, share in zip(row, *model.fires, model.share):
            z += share * (math.log(p1 / p0) if fired else math.log((1 - p1) / (1 - p0)))
        if not math.isnan(said):
            p0, p1 = model.given
            z += math.log(p1 / p0) if said == 1 else math.log((1 - p1) / (1 - p0))
        out.append(1 / (1 + math.exp(-z)))
    return out


def test_label_model_finds_accuracies_and_copies_without_labels():
    y, fires, votes = made_votes()
    model, nothing = LabelModel(), np.full(len(y), np.nan)
    q = model.fit(votes, nothing, np.where(votes[:, :8].sum(1) > 1, 0.9, 0.1))
    assert np.abs(model.fires[:, :8].T - fires).max() < 0.06 and abs(model.prior - 0.3) < 0.04
    assert (model.share[:8] > 0.7).all() and (model.share[8:] < 0.3).all()  # five copies count about as one
    assert ((q > 0.5) == y).mean() > 0.94
    assert np.allclose(posterior_in_loops(model, votes[:200], nothing[:200]), q[:200])


def test_given_labels_may_err():
    y, _, votes = made_votes(5)
    r = np.random.default_rng(1)
    given = np.where(r.random(len(y)) < 0.1, 1 - y, y).astype(float)
    given[::5] = np.nan
    model = LabelModel()
    q = model.fit(votes, given, np.where(np.isnan(given), 0.3, np.where(given == 1, 0.95, 0.05)))
    assert abs(model.given[0] - 0.1) < 0.04 and abs(model.given[1] - 0.9) < 0.04
    known = ~np.isnan(given)
    assert ((q > 0.5) == y)[known].mean() > 0.96 > (given == y)[known].mean()
    assert np.allclose(posterior_in_loops(model, votes[:200], given[:200]), q[:200])


def test_linear_model_is_logistic_regression():
    """At the optimum the gradient, in plain loops, is nothing."""
    r = np.random.default_rng(2)
    x, q = (r.random((80, 4)) < 0.4).astype(float), r.random(80)
    w, b = fit_linear(x, q, rounds=4000, rate=0.01)
    weight = q / q.sum() + (1 - q) / (1 - q).sum()
    weight /= weight.sum()
    p = [1 / (1 + math.exp(-(b + sum(w[j] * x[i, j] for j in range(4))))) for i in range(80)]
    for j in range(4):
        assert abs(sum(weight[i] * (p[i] - q[i]) * x[i, j] for i in range(80)) + 1e-4 * w[j]) < 1e-3
    assert abs(sum(weight[i] * (p[i] - q[i]) for i in range(80))) < 1e-3


def test_features():
    assert features_of(None) == features_of("") == features_of(" \n\t ") == set()
    assert features_of("You are an IDIOT!!!") == {"w:you", "w:are", "w:an", "w:idiot", "b:idio", "p:shout", "p:you are"}
    assert "w:idiot" in features_of("what an 1d10t") and "w:stupid" in features_of("$tupid 5tup1d") and "w:1057" in features_of("1057") and "w:ios7" not in features_of("1057")
    got = features_of(" ".join(f"stemword{c}" for c in "abcde") + " " + " ".join(f"x{i}y" for i in range(400)))
    assert {"b:stem", "b:stem x2", "b:stem x4", "b:stem x2>0.4%"} <= got and "b:stem x2>0.8%" not in got


def texts(n=600):
    """Toxic texts hold forms of two made-up stems and of words of the lexicon; one label in 25 is wrong."""
    r = np.random.default_rng(9)
    syllables = ["ba", "ke", "lo", "ni", "ru", "ta", "vo", "xi", "mu", "pe"]
    out = []
    for i in range(n):
        words = ["".join(r.choice(syllables, r.integers(2, 5))) for _ in range(int(r.integers(20, 120)))]
        bad = i % 4 == 0
        if bad:
            kind = ["zorgl", "quixt"][i // 4 % 2]
            for _ in range(3):
                words.insert(int(r.integers(len(words))), kind + str(r.choice(syllables)) if i % 3 else "idiot")
        out.append((i, " ".join(words), int(bad) ^ (i % 25 == 7)))
    return out


def test_training_on_noisy_labels(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 0.0, 0, x) for i, t, x in rows], COLUMNS).repartition(4)
    model = train_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic").filter("doc_id % 5 > 0"))
    got = {r.doc_id: r for r in score_toxicity(docs, model, keep=("toxic",)).collect()}
    wrong = [(i, got[i].score) for i, _, _ in rows if got[i].predicted != (i % 4 == 0)]
    assert 2 * len(wrong) <= len(rows) // 25, wrong  # the given labels are wrong twice as often at least
    for i, t, x in rows[:60]:  # the score in plain terms
        z = model.bias + sum(model.weights.get(f, 0.0) for f in sorted(features_of(t)))
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 2e-6 and got[i].toxic == x
    assert sorted(model.weights) != [] and len(model.weights) <= 2000


def test_training_without_labels(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(9)) + " " + (" ".join(LEXICON[(i // 5 * k + k * k) % 7] for k in (1, 2, 4, 5)) if i % 5 == 0 else "and nothing bad"), None, None, None) for i in range(200)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for labels in (None, docs.select("doc_id", "toxic"), docs.limit(0).select("doc_id", "toxic")):
        model = train_toxicity(docs, labels)
        assert {r.doc_id: r.predicted for r in score_toxicity(docs, model).collect()} == {i: int(i % 5 == 0) for i in range(200)}


def test_edges(spark):
    model = ToxicityModel({"w:idiot": 4.0, "w:long": -0.5}, -2.0)
    long = "long " * 100_000 + "idiot"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "idiot"), (4, "idiot"), (None, "idiot"), (5, long), (6, "日本 😀 \x00 ünï"), (7, "!!!")]
    df = spark.createDataFrame([(i, t, 9.0, 9, 9) for i, t in rows], COLUMNS)
    for n in (1, 5):
        got = score_toxicity(df.repartition(n), model).collect()
        assert sorted((r.doc_id or 0, r.score, r.predicted) for r in got) == sorted(
            (i or 0, round(1 / (1 + math.exp(2 - 4 * ("idiot" in (t or "")) + 0.5 * ("long" in (t or "")))), 6), int("idiot" in (t or ""))) for i, t in rows)
    assert score_toxicity(df.limit(0), model).columns == ["doc_id", "score", "predicted"] and score_toxicity(df.limit(0), model).count() == 0
    empty = train_toxicity(df.limit(0), df.limit(0).select("doc_id", "toxic"))
    assert empty.score("you idiot") > 0.5 > empty.score("you")
    one_class = train_toxicity(df.select("doc_id", "text"), df.select("doc_id", F.lit(0).alias("toxic")))
    assert 0 <= one_class.score("idiot") <= 1


def test_repeated_ids_and_labels(spark):
    rows = texts(200)
    docs = spark.createDataFrame([(i // 2, t, 0.0, 0, x) for i, t, x in rows] * 2, COLUMNS)
    model = train_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert isinstance(model.bias, float) and score_toxicity(docs, model).count() == 400


@pytest.fixture(scope="module")
def scored(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return queries.op11_toxicity(spark, SF).join(docs, "doc_id").join(labels, "doc_id", "left").collect()


def test_held_out_labels_are_met(scored, spark):
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    held = [r for r in scored if r.held_out and r.toxic is not None and r.text]
    bad = re.compile("trash|pathetic|idiot|disgusting|worthless|stupid|clown|scum|loser|moron")
    told = [r for r in scored if r.text and bad.search(r.text.lower())]
    assert sum(r.predicted for r in told) >= 0.97 * len(told)
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held)
    assert sum(r.predicted for r in held if r.toxic == 0) <= 0.03 * len(held)


def test_equal_texts_have_equal_scores(scored):
    by = {}
    for r in scored:
        assert by.setdefault(r.text, r.score) == r.score


def test_held_out_of_no_id(spark):
    assert spark.createDataFrame([(None,)], "doc_id long").select(held_out("doc_id").alias("h")).head().h is False
