"""Boosted stumps for several classes (SAMME), each stump the best over all features and cuts by a weighted histogram.

Rows are reduced once to bin numbers. A round is one map-side-combined aggregate of the row weights by feature, bin and class; the
weights themselves are an expression of the stumps so far, so nothing is rewritten between rounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col
from lodestat.session import saved


@dataclass
class Stump:
    feature: int
    bin: int  # bins up to this one go left
    left: int
    right: int
    error: float
    weight: float


@dataclass
class BoostedStumps:
    """`fit` takes features, a label and, if wanted, cut points; `transform` adds the predicted class."""
    rounds: int = 30
    bins: int = 32
    rate: float = 1.0
    features: list[str] = field(default_factory=list)
    classes: list = field(default_factory=list)
    cuts: list[list[float]] = field(default_factory=list)
    stumps: list[Stump] = field(default_factory=list)

    def fit(self, df: DataFrame, features: Sequence[str], label: str, cuts: dict[str, Sequence[float]] | None = None) -> "BoostedStumps":
        """Rows without a label are left out; missing features (null or NaN) have a bin of their own, below all cuts."""
        self.features, self.stumps = list(features), []
        rows = df.where(as_col(label).isNotNull())
        self.classes = sorted(r[0] for r in rows.select(as_col(label)).distinct().limit(1001).collect())
        if len(self.classes) > 1000:
            raise ValueError("more than 1000 classes")
        probs = [(i + 1) / self.bins for i in range(self.bins - 1)]
        found = rows.agg(*[F.percentile_approx(as_col(c).cast("double"), probs, 10_000).alias(f"q{i}") for i, c in enumerate(self.features)]).first()
        self.cuts = [sorted(set(map(float, cuts[c] if cuts and c in cuts else (found[f"q{i}"] or [])))) for i, c in enumerate(self.features)]
        if len(self.classes) < 2:
            return self
        number = F.array_position(F.array(*[F.lit(c) for c in self.classes]), as_col(label)).cast("int") - 1
        table = saved(rows.select(number.alias("y"), F.array(*self._bins()).alias("b")), "stump_bins")
        k = len(self.classes)
        for _ in range(self.rounds):
            weighted = table.select("y", "b", self._row_weight(F.col("y")).alias("w"))
            cells = weighted.select("y", "w", F.posexplode("b").alias("f", "bin")).groupBy("f", "bin", "y").agg(F.sum("w").alias("w")).collect()  # features x bins x classes
            stump = self._best(cells, k)
            if stump is None:
                break
            self.stumps.append(stump)
            if stump.error <= 1e-12:
                break
        return self

    def _bins(self) -> list[Column]:
        out = []
        for c, cuts in zip(self.features, self.cuts):
            v = as_col(c).cast("double")
            above = [F.when(v > F.lit(x), 1).otherwise(0) for x in cuts]
            out.append(F.when(v.isNull() | F.isnan(v), F.lit(0)).otherwise(sum(above, F.lit(1))).cast("int"))
        return out

    def _row_weight(self, y: Column) -> Column:
        """The product of exp(vote weight) over the stumps that got the row wrong, in units of its largest possible value."""
        total = F.lit(0.0)
        for s in self.stumps:
            guess = F.when(F.get("b", s.feature) <= s.bin, s.left).otherwise(s.right)
            total = total + F.when(guess != y, 0.0).otherwise(-s.weight)
        return F.exp(total)

    def _best(self, cells, k: int) -> Stump | None:
        best = None
        for f, cuts in enumerate(self.cuts):
            mass = np.zeros((len(cuts) + 2, k))
            for r in cells:
                if r["f"] == f:
                    mass[r["bin"], r["y"]] += r["w"]
            left = mass.cumsum(axis=0)
            whole = left[-1]
            for b in range(len(mass) - 1):
                right = whole - left[b]
                error = 1 - (left[b].max() + right.max()) / whole.sum()
                if best is None or error < best[0] - 1e-12:
                    best = (error, f, b, int(left[b].argmax()), int(right.argmax()))
        if best is None or best[0] >= 1 - 1 / k - 1e-12:
            return None
        error = max(best[0], 1e-15)
        return Stump(*best[1:], best[0], self.rate * (math.log((1 - error) / error) + math.log(k - 1)))

    def votes(self) -> list[Column]:
        bins = self._bins()
        out = [F.lit(0.0)] * len(self.classes)
        for s in self.stumps:
            goes_left = bins[s.feature] <= s.bin
            for c in range(len(self.classes)):
                if c in (s.left, s.right):
                    out[c] = out[c] + F.when(goes_left, s.weight if c == s.left else 0.0).otherwise(s.weight if c == s.right else 0.0)
        return out

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """The class with most votes, the first of equals."""
        best = F.array_max(F.array(*self.votes()))
        at = F.array_position(F.array(*self.votes()), best)
        return df.withColumn(name, F.element_at(F.array(*[F.lit(c) for c in self.classes]), at.cast("int")))
