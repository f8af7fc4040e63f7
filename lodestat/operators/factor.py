"""Principal components, correspondence and multiple correspondence analysis.

Only matrices over columns or levels reach the driver; rows are placed on the axes by
expressions or Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col, local_rows
from lodestat.operators.gram import Gram, complete, gram
from lodestat.operators.ordering import with_position

MAX_SIDE = 3000  # dense eigenproblem on the driver


def _fix_signs(v: np.ndarray) -> np.ndarray:
    """Make the largest entry of every axis positive, so axes are reproducible."""
    flip = np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])])
    return v * np.where(flip == 0, 1, flip)


def _axes(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    vals, vecs = np.linalg.eigh(r)
    order = np.argsort(vals)[::-1]
    return np.maximum(vals[order], 0), _fix_signs(vecs[:, order])


def pca_axes(df: DataFrame, cols: Sequence[str]) -> tuple[Gram, np.ndarray, np.ndarray]:
    g = gram(df, cols)
    if np.any(np.diag(g.cross) <= 0):
        raise ValueError("constant columns have no place in a component analysis")
    vals, vecs = _axes(g.corr)
    return g, vals, vecs


def pca_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Eigenvalues, shares, and which axes pass the Kaiser rule."""
    _, vals, _ = pca_axes(df, cols)
    share = vals / vals.sum()
    return local_rows(df.sparkSession, [(i + 1, v, s, c, bool(v > 1)) for i, (v, s, c) in enumerate(zip(vals, share, np.cumsum(share)))],
                      "axis int, eigenvalue double, share double, cumulative double, kept boolean")


def pca_variables(df: DataFrame, cols: Sequence[str], axes: int | None = None) -> DataFrame:
    """Loading, contribution and squared cosine of every column on every kept axis."""
    _, vals, vecs = pca_axes(df, cols)
    axes = axes or max(1, int((vals > 1).sum()))
    load = vecs[:, :axes] * np.sqrt(vals[:axes])
    rows = [(c, a + 1, load[i, a], vecs[i, a] ** 2 * 100, load[i, a] ** 2) for i, c in enumerate(cols) for a in range(axes)]
    return local_rows(df.sparkSession, rows, "column string, axis int, loading double, contribution double, cos2 double")


def pca_scores(df: DataFrame, cols: Sequence[str], axes: int = 2) -> DataFrame:
    """Every row's coordinates as dot products, with its squared cosine on the kept axes."""
    g, vals, vecs = pca_axes(df, cols)
    sd = np.sqrt(np.diag(g.cross) / g.n)
    z = [(as_col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(cols, g.mean, sd)]
    out = complete(df, cols).withColumns({f"axis{a + 1}": sum((float(w) * c for w, c in zip(vecs[:, a], z)), F.lit(0.0)) for a in range(axes)})
    norm = sum((c * c for c in z), F.lit(0.0))
    kept = sum((F.col(f"axis{a + 1}") * F.col(f"axis{a + 1}") for a in range(axes)), F.lit(0.0))
    return out.withColumn("cos2", F.try_divide(kept, norm))


# ---------------------------------------------------------------- correspondence analysis

def correspondence(df: DataFrame, a: str, b: str, axes: int = 2) -> DataFrame:
    """Coordinates, contributions and squared cosines of the levels of two columns.

    The side with fewer levels is held as a small dense matrix; the other side's profiles
    stay distributed and are summed into it in Arrow batches.
    """
    cells = df.where(as_col(a).isNotNull() & as_col(b).isNotNull()).groupBy(as_col(a).cast("string").alias("a"), as_col(b).cast("string").alias("b")).agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    la, lb = cells.select(F.count_distinct("a"), F.count_distinct("b")).first()
    long, short = ("a", "b") if la >= lb else ("b", "a")
    if min(la, lb) > MAX_SIDE:
        raise ValueError(f"both columns have more than {MAX_SIDE} levels")
    masses = cells.groupBy(short).agg(F.sum("n").alias("m")).orderBy(short).collect()  # at most MAX_SIDE rows
    levels = [r[short] for r in masses]
    m = np.array([r["m"] for r in masses])
    total = m.sum()
    c = m / total
    k = len(levels)
    at = {v: i for i, v in enumerate(levels)}
    profiles = cells.groupBy(long).agg(F.collect_list(F.struct(F.col(short).alias("s"), "n")).alias("cells"))

    def residuals(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n = np.zeros((len(pdf), k))
        for i, row in enumerate(pdf["cells"]):
            for cell in row:
                n[i, at[cell["s"]]] = cell["n"]
        p = n / total
        r = p.sum(axis=1)
        return (p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), r

    def partial(batches):
        s = np.zeros((k, k))
        for pdf in batches:
            e, _ = residuals(pdf)
            s += e.T @ e
        yield pd.DataFrame({"i": np.repeat(np.arange(k), k), "j": np.tile(np.arange(k), k), "v": s.ravel()})

    sums = profiles.mapInPandas(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    s = np.zeros((k, k))
    s[sums["i"], sums["j"]] = sums["v"]
    vals, vecs = _axes((s + s.T) / 2)
    axes = min(axes, max(1, k - 1))
    inertia, vecs = vals[:axes], vecs[:, :axes]
    root = np.sqrt(np.maximum(inertia, 1e-300))
    coord = vecs * root / np.sqrt(c)[:, None]
    whole = np.diag(s) / c
    side = {"a": a, "b": b}
    rows = [(side[short], levels[i], x + 1, coord[i, x], vecs[i, x] ** 2 * 100, coord[i, x] ** 2 / whole[i] if whole[i] > 0 else 0.0, inertia[x], inertia[x] / vals.sum())
            for i in range(k) for x in range(axes)]
    schema = "variable string, level string, axis int, coordinate double, contribution double, cos2 double, inertia double, share double"
    name, share = side[long], inertia / vals.sum()

    def place(batches):
        for pdf in batches:
            e, r = residuals(pdf)
            f = (e @ vecs) / np.sqrt(r)[:, None]
            d2 = (e ** 2).sum(axis=1) / r
            for x in range(axes):
                yield pd.DataFrame({"variable": name, "level": pdf[long], "axis": x + 1, "coordinate": f[:, x], "contribution": r * f[:, x] ** 2 / inertia[x] * 100,
                                    "cos2": f[:, x] ** 2 / np.where(d2 > 0, d2, 1), "inertia": inertia[x], "share": share[x]})

    return local_rows(df.sparkSession, rows, schema).unionByName(profiles.mapInPandas(place, schema))


# ---------------------------------------------------------------- multiple correspondence

def _burt(df: DataFrame, cols: Sequence[str]) -> tuple[list[tuple[int, str]], np.ndarray, float]:
    """Levels and the table of joint counts of all pairs of columns, from one grouped count."""
    q = len(cols)
    ok = F.lit(True)
    for c in cols:
        ok = ok & as_col(c).isNotNull()
    text = [as_col(c).cast("string") for c in cols]
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), text[i].alias("x"), text[j].alias("y")) for i in range(q) for j in range(i, q)])
    counts = df.where(ok).select(F.explode(pairs).alias("p")).select("p.*").groupBy("i", "j", "x", "y").count()
    diag = counts.where("i = j AND x = y").select("i", "x", "count").orderBy("i", "x").limit(MAX_SIDE + 1).collect()
    if len(diag) > MAX_SIDE:
        raise ValueError(f"more than {MAX_SIDE} levels in all")
    levels = [(r["i"], r["x"]) for r in diag]
    at = {v: k for k, v in enumerate(levels)}
    b = np.zeros((len(levels), len(levels)))
    for r in counts.collect():  # at most levels x levels cells
        s, t = at[(r["i"], r["x"])], at[(r["j"], r["y"])]
        b[s, t] = b[t, s] = r["count"]
    n = sum(r["count"] for r in diag if r["i"] == 0)
    return levels, b, float(n)


def _mca(df: DataFrame, cols: Sequence[str]):
    levels, b, n = _burt(df, cols)
    q = len(cols)
    mass = np.diag(b) / (n * q)
    s = b / (n * q * q) / np.sqrt(np.outer(mass, mass)) - np.sqrt(np.outer(mass, mass))
    vals, vecs = _axes(s)
    keep = max(1, len(levels) - q)
    return levels, mass, vals[:keep], vecs[:, :keep], q


def mca_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inertia per axis, raw and with Benzécri's correction."""
    _, _, vals, _, q = _mca(df, cols)
    fixed = np.where(vals > 1 / q, (q / (q - 1)) ** 2 * (vals - 1 / q) ** 2, 0.0) if q > 1 else vals
    total = fixed.sum() or 1.0
    return local_rows(df.sparkSession, [(i + 1, v, v / vals.sum(), f, f / total) for i, (v, f) in enumerate(zip(vals, fixed))],
                      "axis int, inertia double, share double, corrected double, corrected_share double")


def mca_levels(df: DataFrame, cols: Sequence[str], axes: int = 2) -> DataFrame:
    """Coordinates and contributions of the levels."""
    levels, mass, vals, vecs, _ = _mca(df, cols)
    coord = vecs * np.sqrt(vals) / np.sqrt(mass)[:, None]
    rows = [(cols[i], x, a + 1, coord[k, a], vecs[k, a] ** 2 * 100) for k, (i, x) in enumerate(levels) for a in range(min(axes, len(vals)))]
    return local_rows(df.sparkSession, rows, "variable string, level string, axis int, coordinate double, contribution double")


def mca_links(df: DataFrame, cols: Sequence[str], axes: int = 2) -> DataFrame:
    """Correlation ratio of every column with every axis: its level masses times squared coordinates."""
    levels, mass, vals, vecs, q = _mca(df, cols)
    coord2 = (vecs * np.sqrt(vals)) ** 2 / mass[:, None]
    rows = [(c, a + 1, sum(mass[k] * q * coord2[k, a] for k, (j, _) in enumerate(levels) if j == i)) for i, c in enumerate(cols) for a in range(min(axes, len(vals)))]
    return local_rows(df.sparkSession, rows, "variable string, axis int, eta2 double")


def mca_rows(df: DataFrame, cols: Sequence[str], axes: int = 2) -> DataFrame:
    """Every row's coordinates: the mean of its levels' standard coordinates."""
    levels, mass, vals, vecs, q = _mca(df, cols)
    std = vecs / np.sqrt(mass)[:, None]

    def part(i: int, a: int) -> Column:
        pairs = [x for k, (j, v) in enumerate(levels) if j == i for x in (F.lit(v), F.lit(float(std[k, a])))]
        return F.element_at(F.create_map(*pairs), as_col(cols[i]).cast("string"))

    ok = F.lit(True)
    for c in cols:
        ok = ok & as_col(c).isNotNull()
    return df.where(ok).withColumns({f"axis{a + 1}": sum((part(i, a) for i in range(q)), F.lit(0.0)) / q for a in range(min(axes, len(vals)))})
