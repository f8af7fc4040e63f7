"""Toxicity by a classifier chain of linear models over the words of whole texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.rows import id_and_text, with_null_ids
from lodestat.session import saved

WORDS = re.compile(r"\w+|[^\w\s]+")


STEMS = (4, 5, 6, 7, 8)  # lengths of the word beginnings that count as stems, beside the whole word
LEVELS = (1, 2, 3)
LONG = 500  # a text of more words is read in overlapping windows of so many, so that long texts don't have everything
DENSE_COUNT, DENSE_SHARE = 2, 0.004
BAG_TEXTS = 16  # texts whose windows' features, a thousand or more each, are held at a time
FIT_ROWS = 2048  # windows made dense at a time in a fitting task
STRIPE = 64  # rows of a matrix of sums that travel together


def stems_of(word: str) -> list[str]:
    """The whole word, marked by a closing dollar sign, and its beginnings."""
    return [word + "$", *(word[:n] for n in STEMS if len(word) >= n)]


def levels_of(count: int, words: int) -> list[int]:
    """Which features a stem has: found once, twice, three times or more; 0 if it is also frequent for the text's length."""
    found = [n for n in LEVELS if count >= n]
    return [*found, 0] if count >= DENSE_COUNT and count >= DENSE_SHARE * words else found


def windows_of(text: str | None) -> list[Counter]:
    """Words, lower-cased, and runs of other marks, with their counts, in each window of the text.

    Windows hold LONG words and start every half of that; the last one ends with the text. A shorter text is one window.
    """
    words = WORDS.findall(text.lower()) if text else []
    starts = [*range(0, len(words) - LONG, LONG // 2), len(words) - LONG] if len(words) > LONG else [0]
    return [Counter(words[at : at + LONG]) for at in starts]


def features_of(words: Counter) -> list[str]:
    """All features of a window, as level:stem."""
    stems = Counter()
    for word, n in words.items():
        for stem in stems_of(word):
            stems[stem] += n
    total = words.total()
    return [f"{level}:{stem}" for stem, n in stems.items() for level in levels_of(n, total)]


def bags_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each window of each row's `text`, with its features as `words` in the text's place; BAG_TEXTS texts at a time."""
    for batch in batches:
        for at in range(0, len(batch), BAG_TEXTS):
            some = batch.iloc[at : at + BAG_TEXTS]
            windows = some["text"].map(windows_of)
            rows = some.drop(columns="text").loc[windows.index.repeat(windows.map(len))]
            yield rows.assign(words=[features_of(w) for each in windows for w in each])


@dataclass(frozen=True)
class Link:
    """One linear model of the chain: `weights` of the words, then of the earlier categories' probabilities."""

    category: str
    bias: float
    weights: np.ndarray
    earlier: np.ndarray


@dataclass(frozen=True)
class Chain:
    """The features chosen, and the models over them in order."""

    features: tuple[str, ...]
    links: tuple[Link, ...]

    @property
    def names(self) -> list[str]:
        return [link.category for link in self.links]

    def predictor(self) -> Callable[[str | None], list[float]]:
        """A function from a text to the probability of each category.

        A text of one window has that window's odds. In a longer text a passage may stand in any window, each as likely
        beforehand, so the odds of the text are the mean of its windows' odds: one clear window is enough, while many
        windows that each just might be of the category are not.
        """
        number = {f: k for k, f in enumerate(self.features)}
        stems = {f.split(":", 1)[1] for f in self.features}
        known: dict[str, list[str]] = {}  # the chosen stems of each word met so far

        def predict(text: str | None) -> list[float]:
            return [float(sigmoid(np.logaddexp.reduce(of) - np.log(len(of)))) for of in zip(*map(window, windows_of(text)))]

        def window(words: Counter) -> list[float]:
            found = Counter()
            for word, n in words.items():
                some = known.get(word)
                if some is None:
                    if len(known) > 200_000:
                        known.clear()
                    some = known[word] = [s for s in stems_of(word) if s in stems]
                for stem in some:
                    found[stem] += n
            total = words.total()
            named = (number.get(f"{level}:{stem}") for stem, n in found.items() for level in levels_of(n, total))
            return self.log_odds(sorted(k for k in named if k is not None))

        return predict

    def log_odds(self, present: list[int]) -> list[float]:
        """Of each category in order, from the numbers of the features present in a window."""
        found: list[float] = []
        for link in self.links:
            found.append(link.bias + float(link.weights[present].sum()) + float(np.dot(link.earlier, sigmoid(np.array(found)))))
        return found


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def one_hot(present: list[np.ndarray], width: int) -> np.ndarray:
    """A row for each window, with ones at the features present."""
    x = np.zeros((len(present), width), np.float32)
    x[np.repeat(np.arange(len(present)), [len(p) for p in present]), np.concatenate(present).astype(np.int64)] = 1
    return x


def with_earlier(x: np.ndarray, fold: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """The features, then each earlier category's probability by the model that has not seen the row's fold, then a one for the bias."""
    full = np.hstack([x.astype(float), np.zeros((len(x), len(before))), np.ones((len(x), 1))])
    at = x.shape[1]
    for k, models in enumerate(before):
        z = (full[:, : at + k] * models[fold, : at + k]).sum(axis=1) + models[fold, -1]
        full[:, at + k] = sigmoid(z)
    return full


def newton_sums(rows: DataFrame, label: str, width: int, before: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    """What a Newton step at the weights `at` of each model needs, added up over all rows in the executors.

    Model 0 takes all rows, model f those outside fold f - 1. Each gets a matrix: the curvature, a row with the gradient, and
    the loss as that row's last value. Tasks send a matrix in stripes of rows, one group adds up each stripe, and only the
    sums come to the driver: models times the square of the inputs, whatever the number of rows.
    """
    models, size = at.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((models, size + 1, size + 1))
        for batch in batches:
            for start in range(0, len(batch), FIT_ROWS):
                some = batch.iloc[start : start + FIT_ROWS]
                fold, y = some["fold"].to_numpy(np.int64), some[label].to_numpy(float)
                x = with_earlier(one_hot([np.asarray(p) for p in some["present"]], width), fold, before)
                for m in range(models):
                    on = slice(None) if m == 0 else fold != m - 1
                    xm, ym = x[on], y[on]
                    z = xm @ at[m]
                    p = sigmoid(z)
                    # single precision is enough for the curvature: it bends the step, the gradient alone decides where steps end
                    half = (xm * np.sqrt(p * (1 - p) + 1e-9)[:, None]).astype(np.float32)
                    total[m, :-1, :-1] += half.T @ half
                    total[m, -1, :-1] += xm.T @ (p - ym)
                    total[m, -1, -1] += np.logaddexp(0, z).sum() - ym @ z
        for m in range(models):
            for row in range(0, size + 1, STRIPE):
                yield pd.DataFrame({"model": [m], "row": [row], "total": [total[m, row : row + STRIPE].tobytes()]})

    def added(stripe: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in stripe["total"])
        return stripe.iloc[:1].assign(total=[total.tobytes()])

    schema = "model int, row int, total binary"
    found = rows.select("present", "fold", label).mapInPandas(sums, schema).groupBy("model", "row").applyInPandas(added, schema).collect()
    whole = np.zeros((models, size + 1, size + 1))
    for r in found:
        stripe = np.frombuffer(r["total"]).reshape(-1, size + 1)
        whole[r["model"], r["row"] : r["row"] + len(stripe)] = stripe
    return list(whole)


def fit_weights(rows: DataFrame, label: str, width: int, before: list[np.ndarray], folds: int = 0, l2: float = 1.0, steps: int = 100) -> np.ndarray:
    """Weights (features, earlier categories, bias; the bias is not shrunk) of ridge logistic regressions, by damped Newton steps to convergence.

    `rows` has `present` (numbers of the features present), `fold` and the 0/1 column `label`. One row of weights comes back
    for all rows, then one for each fold left out; all are fitted in the same passes, each a Spark job.
    """
    size = width + len(before) + 1
    shrink = np.append(np.full(size - 1, l2), 1e-6)
    at = np.zeros((folds + 1, size))
    best, loss, pace, step = at.copy(), np.full(folds + 1, np.inf), np.ones(folds + 1), np.zeros_like(at)
    moving = np.full(folds + 1, True)
    for _ in range(steps):
        for m, total in enumerate(newton_sums(rows, label, width, before, at)):
            now = total[-1, -1] + (shrink * at[m] * at[m]).sum() / 2
            if not moving[m]:
                continue
            if now <= loss[m]:
                moving[m] = loss[m] - now >= 1e-9 * max(1.0, abs(now))
                best[m], loss[m], pace[m] = at[m], now, 1.0
                step[m] = np.linalg.solve(total[:-1, :-1] + np.diag(shrink), total[-1, :-1] + shrink * at[m])
            else:
                pace[m] /= 2  # too far: back towards the last point
                moving[m] = pace[m] > 1e-6
        if not moving.any():
            break
        at = np.where(moving[:, None], best - pace[:, None] * step, best)
    return best


def sampled_labels(labels: DataFrame, id_col: str, categories: dict[str, Column], sample: int) -> DataFrame:
    """`doc_id` and a 0/1 column for each category, of at most about `sample` labelled ids, those of lowest hash; repeated ids take the larger label."""
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), *[c.cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())])
    ys = [f"y{k}" for k in range(len(categories))]
    whole = named.dropna().groupBy("doc_id").agg(*[F.max(y).alias(y) for y in ys])
    low = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    rows = whole.count()
    return whole.where(low < sample / rows) if rows > sample else whole


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text",
              sample: int = 10_000, features: int = 250, min_share: float = 0.005, folds: int = 3) -> Chain:
    """Fit the chain on a bounded sample of labelled documents.

    `categories` names each label and gives it as a 0/1 column of `labels`, in the order of the chain. A feature is a word or
    word beginning with how often it is found (see `levels_of`). For each category at most `features` are chosen by their
    chi-square statistic among those in `min_share` of the sample or more. Every window of a text counts as one, with the text's labels. A model's inputs are which are present and, of earlier categories, the probabilities that models
    trained without the document's fold give it; the models kept are then trained on the whole sample.

    Windows stay in the executors: each step of the fit adds up gradients and curvatures there, and the driver holds the
    vocabulary and matrices of its size only. Equal texts count once, with the larger of their labels. Without labelled documents every probability is 0; a category with one value only is predicted
    at its smoothed share.
    """
    names = list(categories)
    ys = [f"y{k}" for k in range(len(names))]
    ids = F.broadcast(sampled_labels(labels, id_col, categories, sample))  # two numbers and a few labels for each of at most about `sample` rows
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")

    found = texts.join(ids, "doc_id").groupBy(F.xxhash64("text").alias("body")).agg(F.first("text").alias("text"), *[F.max(y).alias(y) for y in ys])
    bag = found.mapInPandas(bags_of, f"body long, words array<string>, {', '.join(f'{y} int' for y in ys)}").persist()
    try:
        totals = bag.agg(F.count("*").alias("n"), F.count_distinct(F.pmod("body", F.lit(folds))).alias("folds"), *[F.sum(y).alias(y) for y in ys]).first()
        n = totals["n"]
        if not n:
            return Chain((), ())
        counts = bag.select(F.explode("words").alias("word"), *ys).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).where(F.col("n") >= max(2.0, min_share * n))
        chosen: set[str] = set()
        for y in ys:
            if 0 < totals[y] < n:
                expected = F.col("n") * totals[y] / n
                spread = expected * (1 - totals[y] / n) * (1 - F.col("n") / n) + 1e-9
                chi = F.pow(F.col(y) - expected, 2) / spread
                chosen |= {r["word"] for r in counts.select("word", chi.alias("chi")).where("chi > 10.83").orderBy(F.desc("chi"), "word").limit(features).collect()}
        vocabulary = sorted(chosen)
        number = {w: k for k, w in enumerate(vocabulary)}

        def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch["words"] = [sorted(number[w] for w in words if w in number) for words in batch["words"]]
                yield batch.rename(columns={"words": "present"})

        # windows of a text stay in one fold, which depends on the text alone
        rows = saved(bag.mapInPandas(numbered, f"body long, present array<int>, {', '.join(f'{y} int' for y in ys)}")
                     .withColumn("fold", F.pmod("body", F.lit(folds)).cast("int")), "toxicity_windows")
    finally:
        bag.unpersist()
    links, before, width = [], [], len(vocabulary)
    for k, name in enumerate(names):
        # with all texts in one fold, what is left to train without it is nothing: the model of all rows stands in
        parts = folds if k + 1 < len(names) and totals["folds"] > 1 else 0
        found = fit_weights(rows, ys[k], width, before, parts)
        links.append(Link(name, float(found[0, -1]), found[0, :width], found[0, width:-1]))
        before.append(found[1:] if parts else np.repeat(found[:1], folds, axis=0))
    return Chain(tuple(vocabulary), tuple(links))


def score_toxicity(docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `doc_id`, `p_<category>` for each category of the chain, and `toxic`, the last word on `category`.

    The whole text is read, in windows; the odds of a text are the mean of its windows' odds. Null and empty texts have no words and get the models' base rates; they are toxic only if the
    base rate is. Without a fitted chain nothing is toxic. Repeated rows each get their row, other columns are ignored.
    """
    names = chain.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = chain.predictor()
        for batch in batches:
            rows = [predict(t) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=[f"p_{c}" for c in names], index=batch.index, dtype=float)
            out["toxic"] = out[f"p_{category}"] >= threshold if category in names else False
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return with_null_ids(id_and_text(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, " + "".join(f"`p_{c}` double, " for c in names) + "toxic boolean"
    ))


def drop_toxic(docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the chain does not call toxic, with all their columns; rules as in `score_toxicity`."""
    if category not in chain.names:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict, at = chain.predictor(), chain.names.index(category)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            yield batch.filter(pa.array([predict(t)[at] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
