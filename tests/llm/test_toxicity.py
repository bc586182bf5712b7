import math
import random
import zlib

import numpy as np
import pytest
from edges import clashing, empty, odd, rows

from tessella.llm.queries import op5_toxicity
from tessella.llm.toxicity import BUCKETS, Model, Scorer, bags, calibration, drop_toxic, features, fit_toxicity, gradients, score_toxicity, telling, train


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
    texts, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["zyxwvut", "zyxwvuq", "qqzzrrx"]))
        texts.append(" ".join(text))
        labels.append(int(toxic))
    return texts, labels


def test_learns_stems_and_scores_unseen_misspellings():
    texts, labels = corpus(600, 1)
    scorer = Scorer(train(texts, labels))
    held_texts, held = corpus(200, 2)
    right = sum((scorer.score(t) >= 0.7) == bool(y) for t, y in zip(held_texts, held, strict=True))
    assert right >= 185
    clean = " ".join(texts[1].split()[:30])
    assert scorer.score(f"{clean} zyxwvutt zyxxwvut") > scorer.score(clean)


def test_training_repeats_exactly():
    texts, labels = corpus(120, 3)
    a, b = train(texts, labels, steps=5), train(texts, labels, steps=5)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_one_class_or_nothing_gives_a_constant():
    assert Scorer(train([], [])).score("any") == 0.5
    assert Scorer(train(["a b"], [0])).score("x") < 0.5


#: At sf0.01 four of the 18 held-out toxic texts have none of the words that tell in the 33 toxic texts to learn from.
@pytest.mark.parametrize("size, recall, precision", [("sf0.01", 0.72, 0.95), ("sf0.1", 0.9, 0.95)])
def test_query_on_all_held_out_rows(spark, size, recall, precision):
    data = f"/root/testdata/{size}"
    out = op5_toxicity(spark, data)
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic").collect()}
    hit = miss = wrong = 0
    for doc, held, score, predicted in out.collect():
        assert held == (zlib.crc32(str(doc).encode()) % 3 == 1) and 0 <= score <= 1 and predicted == int(score >= 0.7)
        if held and doc in labels:
            hit += predicted and labels[doc]
            miss += (not predicted) and labels[doc]
            wrong += predicted and not labels[doc]
    assert hit / (hit + miss) >= recall
    assert hit / (hit + wrong) >= precision


TEXTS = ["a bad bad word", "Good words, only", "", None, "bad? word!", "something else here", "ünï code bad"]


def naive_logit(text, weights, bias, pull):
    """From the definitions, one feature at a time."""
    words = (text or "").lower().split()
    total, norm = 0.0, pull
    for word in sorted(set(words)):
        share = 1 + math.log(words.count(word))
        norm += share
        inner = word.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
        grams = [f"<{inner}>", *(f"<{inner}>"[i : i + n] for n in (3, 4, 5, 6) for i in range(len(inner) + 3 - n))] if inner else []
        if grams:
            total += share * sum(weights[zlib.crc32(g.encode()) % BUCKETS] for g in grams) / len(grams)
    return total / norm + bias


def test_score_equals_the_definition():
    weights = np.random.default_rng(1).normal(size=BUCKETS)
    scorer = Scorer(Model(weights, 0.3, 1.7, -0.2, 20.0))
    for text in TEXTS:
        logit = naive_logit(text, weights, 0.3, 20.0)
        assert math.isclose(scorer.logit(text), logit, rel_tol=1e-9) and math.isclose(scorer.score(text), 1 / (1 + math.exp(-(1.7 * logit - 0.2))), rel_tol=1e-9)


def test_gradients_equal_those_by_differences():
    rng = np.random.default_rng(3)
    y, rows = np.array([1, 0, 0, 1, 1, 0, 1]), np.array([1.0, 1, 1, 1, 0, 1, 1])
    bag = bags(TEXTS, 20.0)
    e, w, b = rng.normal(size=(BUCKETS, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)

    def loss(e, w, b):
        out = 0.0
        for k, text in enumerate(TEXTS):
            z = [naive_logit(text, (e @ w)[:, c], b[c], 20.0) for c in (0, 1)]
            out += rows[k] * (math.log(sum(map(math.exp, z))) - z[y[k]])
        return out / rows.sum() + 0.01 / 2 * (e**2).sum()

    found = gradients(bag, y, rows, e, w, b, 0.01)
    places = [(0, (int(g), c)) for g in np.unique(bag.gram)[:6] for c in (0, 1)] + [(1, (i, j)) for i in (0, 1) for j in (0, 1)] + [(2, (0,)), (2, (1,))]
    for which, at in places:
        sides = []
        for step in (1e-5, -1e-5):
            moved = [e.copy(), w.copy(), b.copy()]
            moved[which][at] += step
            sides.append(loss(*moved))
        assert math.isclose(found[which][at], (sides[0] - sides[1]) / 2e-5, rel_tol=1e-3, abs_tol=1e-5), (which, at)


def test_frequencies_and_telling_features():
    bag = bags(TEXTS, 20.0)
    group = np.array([0, 1, 0, 1, 0, 1, 1])
    found = bag.frequencies(group, 2, step=2)
    want = np.zeros((2, BUCKETS))
    for k, text in enumerate(TEXTS):
        for g in {g for t in (text or "").lower().split() for g in features(t)}:
            want[group[k], g] += 1
    assert (found == want).all()
    # 9 of 10 against 1 of 20: a difference of 0.85 with a standard error of 0.18
    assert telling(np.array([9.0, 9.0, 0.0]), np.array([1.0, 18.0, 0.0]), 10, 20, 3.0, 3).tolist() == [True, False, False]


def test_calibration_is_the_minimum_and_stays_finite():
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.2).astype(int)
    x = rng.normal(size=400) + 2.0 * y
    slope, shift = calibration(x, y)
    assert 1.0 < slope < 3.0
    p = 1 / (1 + np.exp(-(slope * x + shift)))
    assert abs(p[y == 1].mean() + p[y == 0].mean() - 1) < 0.02  # both labels weigh the same
    slope, shift = calibration(np.array([-1.0, -2.0, 5.0, 6.0]), np.array([0, 0, 1, 1]))
    assert 0 < slope < 20 and abs(shift) < 100
    assert calibration(np.array([1.0]), np.array([1])) == (1.0, 0.0)


def test_held_out_labels_are_never_used(spark):
    texts, labels = corpus(90, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    one = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    other = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    a, b = fit_toxicity(docs, one, steps=3), fit_toxicity(docs, other, steps=3)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_odd_input(spark):
    texts, labels = corpus(80, 4)
    model = train(texts, labels, steps=5)
    got = rows(score_toxicity(odd(spark), model))
    assert len(got) == 13 and all(0 <= r[2] <= 1 for r in got)
    blank = {r[2] for r in got if r[0] in (1, 2, 3)}
    assert len(blank) == 1
    assert rows(score_toxicity(clashing(spark), model)) == got
    assert score_toxicity(empty(spark), model).count() == 0
    assert drop_toxic(odd(spark), model, threshold=1.1).count() == 13
    assert drop_toxic(clashing(spark), model, threshold=1.1).count() == 13
    none = spark.createDataFrame([(None, 1, 1), (4, None, None), (6, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert fit_toxicity(clashing(spark), none, steps=2).weights is not None
    assert fit_toxicity(empty(spark), none, steps=2).bias is not None
