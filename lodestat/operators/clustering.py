"""Clustering: k-means, mixtures, density, top-down trees, and their summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col, local_rows
from lodestat.operators.gram import complete, gram
from lodestat.operators.ordering import lookup_by_value, with_position
from lodestat.session import cut_lineage


def scaled_vectors(df: DataFrame, cols: Sequence[str], name: str = "features") -> DataFrame:
    """Complete rows with centred, unit-variance features as a vector."""
    wide = VectorAssembler(inputCols=[f"__d_{c}" for c in cols], outputCol="__raw").transform(
        complete(df, cols).withColumns({f"__d_{c}": as_col(c).cast("double") for c in cols}))
    out = StandardScaler(inputCol="__raw", outputCol=name, withMean=True, withStd=True).fit(wide).transform(wide)
    return out.drop("__raw", *[f"__d_{c}" for c in cols])


def _silhouette(scored: DataFrame) -> float:
    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(scored)


def _by_silhouette(vectors: DataFrame, ks: Sequence[int], make) -> tuple[DataFrame, list[tuple[int, float]]]:
    tried, best = [], None
    for k in ks:
        scored = make(k).fit(vectors).transform(vectors)
        if scored.select("cluster").distinct().count() < 2:
            continue
        s = _silhouette(scored)
        tried.append((k, float(s)))
        if best is None or s > best[0]:
            best = (s, scored)
    if best is None:
        raise ValueError("no number of clusters gave two groups")
    return best[1], tried


def k_means(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5, 6), seed: int = 42) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Rows with a cluster, and the silhouette of each k tried."""
    return _by_silhouette(scaled_vectors(df, cols), ks, lambda k: KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster"))


def top_down(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5, 6), seed: int = 42) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Hierarchical clusters from repeated bisection."""
    return _by_silhouette(scaled_vectors(df, cols), ks, lambda k: BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster"))


def mixture(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5, 6, 7), seed: int = 42) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Gaussian mixture with the number of parts of smallest BIC."""
    vectors = scaled_vectors(df, cols)
    n, d = vectors.count(), len(cols)
    tried, best = [], None
    for k in ks:
        model = GaussianMixture(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)
        bic = (k * (1 + d + d * (d + 1) / 2) - 1) * math.log(n) - 2 * model.summary.logLikelihood
        tried.append((k, float(bic)))
        if best is None or bic < best[0]:
            best = (bic, model)
    return best[1].transform(vectors), tried


def choice_table(spark, tried: list[tuple[int, float]], name: str) -> DataFrame:
    return local_rows(spark, tried, f"k int, {name} double")


def cluster_summary(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Rows, share and column means per cluster."""
    total = df.count()
    return df.groupBy(as_col(cluster)).agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) / F.lit(float(total)) * 100).alias("percent"),
                                           *[F.avg(as_col(c)).alias(f"mean_{c}") for c in cols])


# ---------------------------------------------------------------- components

def connected_components(edges: DataFrame, nodes: DataFrame, most: int = 60) -> DataFrame:
    """(node, label): smallest node of each component, by alternating star contractions.

    Each round is two grouped minima with joins, and the number of rounds grows with the
    logarithm of the component size. Edges are (a, b) of one comparable type.
    """
    pairs = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(most):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m0")).select("a", F.least("a", "m0").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        pairs = cut_lineage(small)
        mark = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("node").join(pairs.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select(
        "node", F.coalesce("label", "node").alias("label"))


# ---------------------------------------------------------------- density clustering

def _box_gap(d: int, far: bool) -> Column:
    """Smallest (or largest) squared distance between boxes lo/hi of sides a and b."""
    total = F.lit(0.0)
    for i in range(d):
        al, ah, bl, bh = (F.col(f"{s}{e}{i}") for s in "ab" for e in ("lo", "hi"))
        gap = F.greatest(F.abs(ah - bl), F.abs(bh - al)) if far else F.greatest(bl - ah, al - bh, F.lit(0.0))
        total = total + gap * gap
    return total


def density_clusters(df: DataFrame, cols: Sequence[str], key: str, eps: float = 0.5, min_points: int = 5, standardise: bool = True,
                     rows_per_task: int = 200_000) -> DataFrame:
    """DBSCAN with exact results: (key, cluster), -1 for noise. Meant for two to four columns.

    Space is cut into cells of diagonal eps, so a cell with `min_points` rows is all core and
    forms one node, whatever its size. Only rows of sparser cells (fewer than `min_points`
    each) are compared with the rows of neighbouring cells, which are spread over salted
    tasks. Two full cells are linked by comparing nested boxes around their rows, split
    fourfold per side until every pair of boxes is clearly within or beyond eps.
    """
    d = len(cols)
    g = gram(df, cols)
    sd = np.sqrt(np.maximum(np.diag(g.cross) / g.n, 0)) if standardise else np.ones(d)
    sd = np.where(sd > 0, sd, 1.0)
    mean = g.mean if standardise else np.zeros(d)
    side = eps / math.sqrt(d)
    z = [(as_col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(cols, mean, sd)]
    points = complete(df, cols).select(as_col(key).cast("string").alias("id"), *[c.alias(f"z{i}") for i, c in enumerate(z)]).withColumns(
        {f"c{i}": F.floor(F.col(f"z{i}") / side) for i in range(d)})
    cell = [f"c{i}" for i in range(d)]
    points = cut_lineage(points)
    cells = cut_lineage(points.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).withColumn("full", F.col("n") >= min_points))
    reach = int(math.ceil(math.sqrt(d)))
    steps = [s for s in np.ndindex(*([2 * reach + 1] * d))]
    # offsets whose cells can hold points within eps
    near = [tuple(int(v) - reach for v in s) for s in steps if sum(max(abs(int(v) - reach) - 1, 0) ** 2 for v in s) * side * side <= eps * eps * (1 + 1e-12)]
    offsets = F.array(*[F.struct(*[F.lit(o[i]).cast("long").alias(f"o{i}") for i in range(d)]) for o in near])

    # 1. rows of sparse cells against rows of neighbouring cells
    node_of_cell = F.concat(F.lit("c:"), F.concat_ws(",", *cell))
    tagged = lookup_by_value(points.withColumn("cell", node_of_cell), cells.select(node_of_cell.alias("cell"), "n", F.col("n").alias("rows"), "full"), "cell").withColumnRenamed("rows", "n")
    sparse = tagged.where("NOT full")
    asked = sparse.select(F.col("id").alias("pid"), *[F.col(f"z{i}").alias(f"p{i}") for i in range(d)], *cell, F.explode(offsets).alias("o")).select(
        "pid", *[f"p{i}" for i in range(d)], *[(F.col(f"c{i}") + F.col(f"o.o{i}")).alias(f"c{i}") for i in range(d)])
    spread = F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_task)).cast("int")
    asked = asked.join(cells.select(*cell, spread.alias("k")), cell).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")
    held = tagged.drop("cell").withColumn("salt", F.pmod(F.xxhash64("id"), spread).cast("int"))
    dist2 = sum(((F.col(f"z{i}") - F.col(f"p{i}")) * (F.col(f"z{i}") - F.col(f"p{i}")) for i in range(d)), F.lit(0.0))
    node_of_cell = F.concat(F.lit("c:"), F.concat_ws(",", *cell))
    close = asked.join(held, [*cell, "salt"]).where(dist2 <= eps * eps)
    # neighbours in a full cell are counted and kept once per cell, others one by one
    touched = cut_lineage(close.groupBy("pid", F.when(F.col("full"), node_of_cell).otherwise(F.concat(F.lit("p:"), "id")).alias("other"), "full").agg(
        F.count(F.lit(1)).alias("n")))
    counts = touched.groupBy("pid").agg(F.sum("n").alias("n"))
    core_sparse = cut_lineage(counts.where(F.col("n") >= min_points).select(F.concat(F.lit("p:"), "pid").alias("node")))
    to_full = touched.where("full").select(F.concat(F.lit("p:"), "pid").alias("p"), "other")
    to_point = touched.where("NOT full").select(F.concat(F.lit("p:"), "pid").alias("p"), "other").join(core_sparse.withColumnRenamed("node", "other"), "other", "left_semi")
    links = to_full.select("p", "other").unionByName(to_point.select("p", "other"))
    core_links = links.join(core_sparse.withColumnRenamed("node", "p"), "p", "left_semi").select(F.col("p").alias("a"), F.col("other").alias("b"))

    # 2. full cells against full cells, by nested boxes
    full = cells.where("full").select(*cell)
    node = node_of_cell.alias("node")
    pair = full.select(*cell, node_of_cell.alias("ca"), F.explode(offsets).alias("o")).select(
        "ca", *[(F.col(f"c{i}") + F.col(f"o.o{i}")).alias(f"c{i}") for i in range(d)]).join(full, cell).select("ca", node_of_cell.alias("cb")).where("ca < cb")
    inner = cut_lineage(tagged.where("full").select(node_of_cell.alias("cell"), *[f"z{i}" for i in range(d)], *[
        ((F.col(f"z{i}") / side - F.col(f"c{i}"))).alias(f"u{i}") for i in range(d)]))

    def boxes(level: int) -> DataFrame:
        def name(lv: int) -> Column:
            return F.concat_ws(",", *[F.least(F.floor(F.col(f"u{i}") * 4 ** lv), F.lit(4 ** lv - 1)).cast("string") for i in range(d)])
        parent = name(level - 1) if level else F.lit("")
        return inner.groupBy("cell", parent.alias("parent"), name(level).alias("box")).agg(
            *[F.min(f"z{i}").alias(f"lo{i}") for i in range(d)], *[F.max(f"z{i}").alias(f"hi{i}") for i in range(d)])

    def sided(t: DataFrame, s: str) -> DataFrame:
        return t.withColumnsRenamed({"cell": f"c{s}", "parent": f"{s}parent", "box": f"{s}box", **{f"{e}{i}": f"{s}{e}{i}" for i in range(d) for e in ("lo", "hi")}})

    open_pairs = pair.withColumn("abox", F.lit("")).withColumn("bbox", F.lit(""))
    linked = None
    for level in range(0, 27):
        b = boxes(level)
        up = ["aparent", "bparent"]
        todo = open_pairs.select("ca", "cb", F.col("abox").alias("aparent"), F.col("bbox").alias("bparent"))
        met = cut_lineage(todo.join(sided(b, "a"), ["ca", "aparent"]).join(sided(b, "b"), ["cb", "bparent"]).select(
            "ca", "cb", "abox", "bbox", (_box_gap(d, True) <= eps * eps).alias("yes"), (_box_gap(d, False) > eps * eps).alias("no")))
        hit = met.where("yes").select("ca", "cb").distinct()
        linked = hit if linked is None else linked.unionByName(hit)
        open_pairs = cut_lineage(met.where("NOT yes AND NOT no").join(hit, ["ca", "cb"], "left_anti").select("ca", "cb", "abox", "bbox"))
        if open_pairs.isEmpty():
            break
    cell_links = linked.select(F.col("ca").alias("a"), F.col("cb").alias("b"))

    # 3. components of core nodes, then border rows take the smallest cluster they touch
    nodes = full.select(node).unionByName(core_sparse)
    labels = cut_lineage(connected_components(core_links.unionByName(cell_links), nodes))
    border = links.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("p").agg(F.min("label").alias("label"))
    own = tagged.select("id", F.when(F.col("full"), node_of_cell).otherwise(F.concat(F.lit("p:"), "id")).alias("node"))
    sizes = cells.where("full").select(node_of_cell.alias("node"), "n")
    sized = labels.join(sizes, "node", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    out = lookup_by_value(own, sized, "node").join(border.select(F.col("p").alias("node"), F.col("label").alias("edge")), "node", "left")
    named = out.select("id", F.coalesce("label", "edge").alias("label"))
    order = named.where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    ranked = with_position(order.withColumn("__neg", -F.col("rows")), ["__neg", "label"], name="cluster").select("label", F.col("rows").alias("n"), "cluster")
    return lookup_by_value(named, ranked, "label").select(F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))
