"""The classifier chain, fitted in the executors, against a dense fit on the driver."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestat.llm.toxicity import BAG_TEXTS, bags_of, features_of, fit_chain, fit_weights, score_toxicity, windows_of


def dense_logistic(x, y, l2=1.0):
    x = np.hstack([x, np.ones((len(x), 1))])
    shrink = np.append(np.full(x.shape[1] - 1, l2), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (p - y) + shrink * w)
    return w


def prob(x, w):
    return 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))


def test_weights_meet_the_first_order_condition_and_equal_the_dense_fit(spark):
    r = np.random.default_rng(2)
    x = (r.random((300, 6)) < 0.3).astype(float)
    y = (x[:, 0] + x[:, 1] - 0.4 + 0.5 * r.standard_normal(300) > 0.5).astype(int)
    fold = r.integers(0, 3, 300)
    rows = spark.createDataFrame([([int(k) for k in np.flatnonzero(v)], int(f), int(t)) for v, f, t in zip(x, fold, y)],
                                 "present array<int>, fold int, y0 int").repartition(5)
    got = fit_weights(rows, "y0", 6, [], folds=3)
    w = got[0]
    p = prob(x, w)
    assert np.abs(x.T @ (p - y) + w[:-1]).max() < 1e-3 and abs((p - y).sum()) < 1e-3
    for m in range(4):
        on = fold != m - 1
        assert np.allclose(got[m], dense_logistic(x[on], y[on]), atol=1e-3)


def test_chain_equals_a_dense_chain(spark, docs_of, prose):
    texts = {k: prose(k % 450, 30 + k % 40) + (" grim" if k % 7 == 0 else "") + (" vile" if k % 5 == 0 else "") for k in range(450)}
    texts |= {900: prose(900, 1_300) + " vile grim", 901: None, 902: ""}
    labels = [(k, int(k % 7 == 0), int(k % 5 == 0 or k % 35 == 7)) for k in texts]
    docs = docs_of(list(texts.items()) + [(3, texts[3])])
    chain = fit_chain(docs, spark.createDataFrame(labels, "doc_id long, bad int, toxic int"), {"bad": F.col("bad"), "toxic": F.col("toxic")}, features=40)
    number = {f: k for k, f in enumerate(chain.features)}
    unique = {}
    for k, t in texts.items():
        if t is not None:
            of = unique.setdefault(t, [0, 0])
            of[0], of[1] = max(of[0], int(k % 7 == 0)), max(of[1], int(k % 5 == 0 or k % 35 == 7))
    bodies = {r["text"]: r["fold"] for r in docs.where("text IS NOT NULL").select("text", F.pmod(F.xxhash64("text"), F.lit(3)).alias("fold")).collect()}
    x, y, fold = [], [], []
    for t, marks in unique.items():
        for window in windows_of(t):
            row = np.zeros(len(number))
            row[[number[f] for f in features_of(window) if f in number]] = 1
            x.append(row), y.append(marks), fold.append(bodies[t])
    x, y, fold = np.array(x), np.array(y), np.array(fold)
    assert len(x) > len(unique)  # the long text has several windows
    first = dense_logistic(x, y[:, 0])
    out = np.zeros(len(x))
    for f in range(3):
        out[fold == f] = prob(x[fold == f], dense_logistic(x[fold != f], y[fold != f, 0]))
    second = dense_logistic(np.hstack([x, out[:, None]]), y[:, 1])
    a, b = chain.links
    assert np.allclose([*a.weights, a.bias], first, atol=2e-3)
    assert np.allclose([*b.weights, *b.earlier, b.bias], second, atol=2e-3)


def test_few_texts_and_one_sided_labels(spark, docs_of):
    docs = docs_of({1: "one text", 2: None, 3: ""})
    one = fit_chain(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, bad int, toxic int"), {"bad": F.col("bad"), "toxic": F.col("toxic")})
    assert one.names == ["bad", "toxic"] and one.features == ()
    assert not any(r["toxic"] for r in score_toxicity(docs, one).collect())


def test_features_of_few_texts_are_held_at_a_time(prose):
    texts = [prose(k, 700 if k % 9 == 0 else 40) for k in range(100)] + [""]
    frames = list(bags_of(iter([pd.DataFrame({"body": range(101), "text": texts, "y0": 1})])))
    assert max(f["body"].nunique() for f in frames) <= BAG_TEXTS
    rows = pd.concat(frames)
    assert list(rows.columns) == ["body", "y0", "words"]
    assert [(b, w) for b, w in zip(rows["body"], rows["words"])] == [(b, features_of(w)) for b, t in enumerate(texts) for w in windows_of(t)]
