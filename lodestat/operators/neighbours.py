"""Exact nearest neighbours by a certified search along one projection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col
from lodestat.operators.gram import gram
from lodestat.operators.ordering import running_total, with_position
from lodestat.operators.pivot_join import nearest_in_blocks, pivot_join
from lodestat.session import cut_lineage

FEW = 3  # columns searched along one axis
BLOCK = 1_024  # donors, by number, that are held together when queries meet them


def nearest(queries: DataFrame, donors: DataFrame, features: Sequence[str], query_id: str, donor_id: str, k: int = 5,
            payload: Sequence[str] = (), standardise: bool = True, window: int = 64) -> DataFrame:
    """The k nearest donors of each query: (query_id, donor_id, distance, payload…, rank).

    Donors are numbered along the first principal axis. A query is compared with the
    donors whose numbers lie around its own; because the gap along the axis never
    exceeds the true distance, the answer is final once the k-th distance is within the
    gap to both ends of the span searched. Queries not final search four times wider.
    Donors are met in blocks of equal size, in which queries and donors are compared without a row for each pair.

    In more than FEW columns one axis tells too little; there `pivot_join` searches, with the same answer.
    """
    if len(features) > FEW:
        return pivot_join(queries, donors, features, query_id, donor_id, k, payload, standardise)
    g = gram(donors, features)
    sd = np.sqrt(np.maximum(np.diag(g.cov), 0))
    sd = np.where(sd > 0, sd, 1.0) if standardise else np.ones(len(features))
    unit = g.cov / np.outer(sd, sd)
    axis = np.linalg.eigh(unit)[1][:, -1]
    z = [(as_col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(features, g.mean, sd)]
    along = sum((float(w) * c for w, c in zip(axis, z)), F.lit(0.0))
    xs = [f"__x{i}" for i in range(len(z))]
    d = donors.select(as_col(donor_id).alias("__d"), along.alias("__p"), *[c.alias(x) for c, x in zip(z, xs)],
                      *[as_col(c).alias(f"__pay_{c}") for c in payload])
    q = queries.select(as_col(query_id).alias("__q"), along.alias("__p"), *[c.alias(x) for c, x in zip(z, xs)])
    # a row without all features has no distance to any other
    whole = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in xs])
    d, q = d.where(whole), q.where(whole)
    total = d.count()
    k_eff, window = min(k, total), max(window, k)
    if not total:
        none = d.withColumn("__q", F.lit(None).cast(q.schema["__q"].dataType))
        return none.select(F.col("__q").alias(query_id), F.col("__d").alias(donor_id if donor_id != query_id else "neighbour"),
                           F.lit(0.0).alias("distance"), *[F.col(f"__pay_{c}").alias(c) for c in payload], F.lit(0).alias("rank"))
    numbered = cut_lineage(with_position(d, ["__p", "__d"], name="__n").withColumn("__at", F.floor(F.col("__n") / BLOCK)))
    both = q.select(F.col("__q").cast("string").alias("id"), "__p", F.lit(0).cast("long").alias("is_donor")).unionByName(
        d.select(F.col("__d").cast("string").alias("id"), "__p", F.lit(1).cast("long").alias("is_donor")))
    at = running_total(both, {"__r": "is_donor"}, ["__p", "is_donor", "id"]).where("is_donor = 0").select(
        F.col("id").alias("__id"), "__r")
    open_q = cut_lineage(q.join(at, F.col("__q").cast("string") == F.col("__id")).drop("__id"))
    done = None
    while True:
        asked = open_q.withColumns({"__low": F.greatest(F.col("__r") - window, F.lit(0)), "__high": F.least(F.col("__r") + window - 1, F.lit(total - 1))})
        visits = asked.withColumn("__at", F.explode(F.sequence(F.floor(F.col("__low") / BLOCK), F.floor(F.col("__high") / BLOCK))))
        w = Window.partitionBy("__q").orderBy("distance", "__d")
        met = nearest_in_blocks(visits, numbered, len(xs), k_eff)
        best = cut_lineage(met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k_eff))
        ends = asked.groupBy("__q").agg(F.min("__low").alias("a"), F.max("__high").alias("b"), F.first("__p").alias("__pq"))
        edge = numbered.select(F.col("__n"), "__p")
        ends = ends.join(edge.withColumnsRenamed({"__n": "a", "__p": "pa"}), "a").join(
            edge.withColumnsRenamed({"__n": "b", "__p": "pb"}), "b")
        gap = F.least(F.when(F.col("a") == 0, F.lit(float("inf"))).otherwise(F.col("__pq") - F.col("pa")),
                      F.when(F.col("b") == total - 1, F.lit(float("inf"))).otherwise(F.col("pb") - F.col("__pq")))
        reach = best.groupBy("__q").agg(F.max("distance").alias("worst"), F.count("*").alias("found"))
        final = ends.join(reach, "__q").where((F.col("worst") <= gap) & (F.col("found") == k_eff)).select("__q")
        final = cut_lineage(final)
        got = best.join(final, "__q", "left_semi")
        done = got if done is None else done.unionByName(got)
        open_q = cut_lineage(open_q.join(final, "__q", "left_anti"))
        if open_q.isEmpty():
            break
        window *= 4
    return done.select(F.col("__q").alias(query_id), F.col("__d").alias(donor_id if donor_id != query_id else "neighbour"),
                       "distance", *[F.col(f"__pay_{c}").alias(c) for c in payload], "rank")
