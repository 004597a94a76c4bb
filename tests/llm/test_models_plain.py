"""The trained models against plain Python: one coordinate, one step, one text at a time."""

import math

import numpy as np
import pytest

from ridgeline.llm import langid, toxicity

TEXTS = [("en", "the cat sat on the mat"), ("de", "die katze sass auf der matte"), ("en", "a dog and the cat"), ("fr", "le chat est là"), ("de", "der hund und die katze"), ("en", "the mat"), ("fr", "la natte du chat"), ("de", "auf der matte")]


def plain_grams(text, slots):
    points = [ord(c) for c in f" {text.lower()} "]
    mask = 2**32 - 1
    one = [p * 2654435761 & mask for p in points]
    two = [((a ^ a >> 15) * 2246822519 + b) & mask for a, b in zip(one, one[1:])]
    three = [((a ^ a >> 13) * 3266489917 + b) & mask for a, b in zip(two, one[2:])]
    return [(h ^ h >> 16) % slots for h in [*one, *two, *three]]


def plain_ftrl(rows, slots, alpha=0.5, beta=1.0, l1=0.002, l2=0.01, rounds=3):
    langs = sorted({lang for lang, _ in rows})
    z, n = {}, {}

    def weight(i, k):
        zi, ni = z.get((i, k), 0.0), n.get((i, k), 0.0)
        return 0.0 if abs(zi) <= l1 else -math.copysign(abs(zi) - l1, zi) / ((beta + math.sqrt(ni)) / alpha + l2)

    for _ in range(rounds):
        for j, (lang, x) in enumerate(rows):
            if j % 5 == 0:
                continue
            x = {**{i: v * langid.SCALE for i, v in x.items()}, slots: 1.0}
            w = {(i, k): weight(i, k) for i in x for k in range(len(langs))}
            score = [sum(x[i] * w[i, k] for i in x) for k in range(len(langs))]
            top = max(score)
            share = [math.exp(s - top) for s in score]
            for k in range(len(langs)):
                error = share[k] / sum(share) - (langs[k] == lang)
                for i, v in x.items():
                    g, old = v * error, n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i, k]
                    n[i, k] = old + g * g
    return langs, {key: weight(*key) for key in z}


def test_language_weights_and_scores(spark):
    slots = 1 << 10
    idf = 1 + np.linspace(0, 2, slots)
    rows, plain = [], []
    for lang, text in TEXTS:
        held = plain_grams(text, slots)
        assert held == langid.grams(text, slots).tolist()
        x = {i: held.count(i) / len(held) * idf[i] for i in sorted(set(held))}
        rows.append((lang, np.asarray(list(x)), np.asarray(list(x.values()))))
        plain.append((lang, x))
    model = langid.train(rows, idf)
    langs, weights = plain_ftrl(plain, slots)
    assert model.langs == langs
    table = np.zeros((slots + 1, len(langs)))
    for (i, k), w in weights.items():
        table[i, k] = w
    np.testing.assert_allclose(model.bias, table[slots], atol=1e-12)
    np.testing.assert_allclose(model.table, table[:slots] * idf[:, None] * langid.SCALE, rtol=1e-5, atol=1e-7)
    assert (table[:slots] == 0).mean() > 0.5  # most weights stay at zero
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(TEXTS)], "doc_id long, text string"), model).collect()}
    for j, (_, x) in enumerate(plain):
        score = [(sum(v * langid.SCALE * table[i, k] for i, v in x.items()) + table[slots, k]) / model.temperature for k in range(len(langs))]
        share = [math.exp(s - max(score)) for s in score]
        best = max(range(len(langs)), key=lambda k: share[k])
        assert got[j][0] == langs[best] and got[j][1] == pytest.approx(share[best] / sum(share), rel=1e-4)


def test_ordinal_fit_is_stationary():
    """At the fit no weight or threshold can move to a lower penalised loss: subgradients, worked out row by row."""
    rng = np.random.default_rng(2)
    rows = [sorted(set(rng.integers(0, 12, rng.integers(1, 6)).tolist())) for _ in range(300)]
    true = rng.normal(size=12) * 1.5
    grades = np.asarray([int(np.clip(round(sum(true[i] for i in r) + rng.normal() * 0.7 + 1), 0, 3)) for r in rows])
    l1 = 2e-3
    w, theta = toxicity.fit_ordinal(rows, grades, 12, l1=l1, steps=6000)
    assert (np.diff(theta) >= 0).all()
    slope, lift = [0.0] * 12, [0.0] * len(theta)
    for r, grade in zip(rows, grades.tolist()):
        score = sum(w[i] for i in r)
        for k, t in enumerate(theta.tolist()):
            error = 1 / (1 + math.exp(t - score)) - (grade > k)
            lift[k] -= error / len(rows)
            for i in r:
                slope[i] += error / len(rows)
    for i in range(12):
        assert slope[i] == pytest.approx(-math.copysign(l1, w[i]), abs=2e-4) if w[i] else abs(slope[i]) <= l1 + 2e-4
    assert max(map(abs, lift)) < 2e-3


def test_severity_of_a_text(spark):
    model = toxicity.Ordinal({"bad": 2.0, "wor-": 1.0, "good": -3.0}, np.asarray([0.5, 1.5, 2.5]))
    rows = spark.createDataFrame([(1, "Bad WORDS"), (2, "good"), (3, None), (4, "bad bad bad")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(rows, model).collect()}
    for key, total in ((1, 3.0), (2, -3.0), (3, 0.0), (4, 2.0)):
        above = [1 / (1 + math.exp(t - total)) for t in (0.5, 1.5, 2.5)]
        each = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
        assert got[key]["severity"] == pytest.approx(sum(above)) and got[key]["grade"] == each.index(max(each)) and got[key]["rejected"] == (above[0] >= 0.5)
