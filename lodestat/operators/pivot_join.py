"""Exact k nearest neighbours in many columns: donors in cells round pivots, compared only where the triangle inequality leaves room."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col
from lodestat.operators.gram import gram
from lodestat.session import cut_lineage

SAMPLE = 20_000  # donors, by smallest hash, among which pivots are placed; every donor is indexed
MOST_PIVOTS = 1_024
RINGS = 4  # blocks a cell, by distance from its pivot
BLOCK_ROWS = 4_096  # donors of a block that meet a query in one place; larger blocks are dealt by the donor's hash
CELLS_AT_ONCE = 100_000  # numbers in one array of a task: distances or bounds of some rows, few enough for a processor's cache
SLACK = 1e-9  # rounding of distances, relative

METRICS = {
    "euclidean": lambda parts: np.sqrt(sum(p * p for p in parts)),
    "maximum": lambda parts: reduce(np.maximum, [np.abs(p) for p in parts]),
}


def nearest_in_blocks(visits: DataFrame, donors: DataFrame, width: int, k: int, metric: str = "euclidean") -> DataFrame:
    """The k nearest donors of the block that a query visits: (__q, __d, distance, payload…), for each visit.

    `visits` has `__at` (a block), `__q` and the numbers `__x0` …; with `__reach`, donors farther than it are left out, and with
    `__low` and `__high` those whose `__n` is not between them. `donors` has `__at`, `__d`, the numbers, and the payload `__pay_…`.
    Both are dealt by block and sorted, a block's donors, by id, before the visits to it. A task holds the donors of one block and
    some visits, so that compared pairs are never rows. Equal distances are taken by donor id.
    """
    names = [f"__x{i}" for i in range(width)]
    kept = ["__d", *[c for c in donors.columns if c.startswith("__pay_")]]
    reaches, spans = "__reach" in visits.columns, "__low" in visits.columns

    def compared(held: pa.RecordBatch, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        theirs = _numbers(held, names).T
        place = held.column("__n").to_numpy(zero_copy_only=False) if spans else None
        rows = max(1, CELLS_AT_ONCE // held.num_rows)
        for start in range(0, asked.num_rows, rows):
            part = asked.slice(start, rows)
            far = METRICS[metric]([t[None] - o[:, None] for t, o in zip(theirs, _numbers(part, names).T)])
            met = np.ones(far.shape, bool)
            if reaches:
                met &= far <= part.column("__reach").to_numpy(zero_copy_only=False)[:, None]
            if spans:
                low, high = (part.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("__low", "__high"))
                met &= (place[None] >= low) & (place[None] <= high)
            if held.num_rows > k:
                seen = np.where(met, far, np.inf)
                met &= ~(seen > np.partition(seen, k - 1, axis=1)[:, k - 1 : k])
            row, col = np.nonzero(met)
            order = np.lexsort((col, far[row, col], row))
            row, col = row[order], col[order]
            near = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col = row[near], col[near]
            if len(row):
                taken = [held.column(c).take(pa.array(col)) for c in kept]
                yield pa.RecordBatch.from_arrays([part.column("__q").take(pa.array(row)), taken[0], pa.array(far[row, col]), *taken[1:]],
                                                 names=["__q", "__d", "distance", *kept[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            at, is_donor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__at", "__turn"))
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if at[begin] != block:
                    block, held = at[begin], []
                first_visit = begin + int((is_donor[begin:end] == 0).sum())
                if first_visit > begin:
                    held.append(batch.slice(begin, first_visit - begin))
                if held and first_visit < end:
                    if len(held) > 1:
                        held = pa.Table.from_batches(held).combine_chunks().to_batches()
                    yield from compared(held[0], batch.slice(first_visit, end - first_visit))

    d = donors.select("__at", *kept, *names, *(["__n"] if spans else []), F.lit(0).alias("__turn"))
    v = visits.select("__at", "__q", *names, *(["__reach"] if reaches else []), *(["__low", "__high"] if spans else []), F.lit(1).alias("__turn"))
    both = d.unionByName(v, allowMissingColumns=True).repartition("__at").sortWithinPartitions("__at", "__turn", "__d")
    kinds = {c: both.schema[c].dataType.simpleString() for c in ("__q", *kept)}
    return both.mapInArrow(run, f"__q {kinds['__q']}, __d {kinds['__d']}, distance double" + "".join(f", `{c}` {kinds[c]}" for c in kept[1:]))


def place_pivots(sample: np.ndarray, count: int, metric: str, rounds: int = 4) -> np.ndarray:
    """Means of the sample's rows nearest to each pivot, from rows evenly spaced in the sample; pivots without rows go."""
    rows = np.unique(sample, axis=0)
    pivots = rows[np.linspace(0, len(rows) - 1, min(count, len(rows))).astype(int)]
    for _ in range(rounds):
        nearest = to_pivots(rows, pivots, metric).argmin(axis=1)
        sizes = np.bincount(nearest, minlength=len(pivots))
        sums = np.stack([np.bincount(nearest, weights=c, minlength=len(pivots)) for c in rows.T], axis=1)
        pivots = sums[sizes > 0] / sizes[sizes > 0, None]
    return pivots


def to_pivots(rows: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows to pivots, from differences, so that their rounding is relative to themselves."""
    out = np.empty((len(rows), len(pivots)))
    some = max(1, CELLS_AT_ONCE // max(1, len(pivots)))
    for at in range(0, len(rows), some):
        out[at : at + some] = METRICS[metric]([c[:, None] - p[None] for c, p in zip(rows[at : at + some].T, pivots.T)])
    return out


class Blocks:
    """What is known of all blocks: cell, rows, nearest and farthest donor from the pivot, and the box round its donors."""

    def __init__(self, pivots: np.ndarray, rows: list, metric: str, width: int):
        self.pivots, self.metric = pivots, metric
        self.ids = np.array([r["__b"] for r in rows], np.int64)
        self.cell, self.n = self.ids // RINGS, np.array([r["n"] for r in rows], np.int64)
        self.near, self.far = np.array([r["near"] for r in rows]), np.array([r["far"] for r in rows])
        self.low = np.array([[r[f"lo{i}"] for i in range(width)] for r in rows])
        self.high = np.array([[r[f"hi{i}"] for i in range(width)] for r in rows])
        self.between = to_pivots(pivots, pivots, metric)

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row and block, a distance below that of any of its donors, and the distance to the block's pivot.

        It is the largest of three: the gap to the ring, the gap to the box, and the way past the border between the cell
        of the row's own nearest pivot and the block's (half of the difference in any metric, more in the Euclidean).
        """
        to = to_pivots(rows, self.pivots, self.metric)
        own = to.argmin(axis=1)
        least = to[np.arange(len(rows)), own][:, None]
        if self.metric == "euclidean":
            with np.errstate(divide="ignore", invalid="ignore"):
                border = np.where(self.between[own] > 0, (to * to - least * least) / (2 * self.between[own]), 0.0)
        else:
            border = (to - least) / 2
        here = to[:, self.cell]
        bound = np.maximum(border[:, self.cell], np.maximum(self.near[None] - here, here - self.far[None]))
        gaps = [np.maximum(np.maximum(lo[None] - c[:, None], c[:, None] - hi[None]), 0.0) for c, lo, hi in zip(rows.T, self.low.T, self.high.T)]
        return np.maximum(bound, METRICS[self.metric](gaps)) - SLACK * (here + self.far[None]), here

    def visits(self, rows: np.ndarray, least: int, reach: np.ndarray | None) -> np.ndarray:
        """Which blocks each row visits: first the nearest ones that hold `least` donors; with `reach`, all others within it."""
        bound, here = self.bounds(rows)
        # those that may hold a donor at the query itself come first, by their pivots; a block holds a donor, so `least` blocks do
        key, few = np.where(bound > 0, bound + here.max(axis=1, keepdims=True), here), min(least, len(self.n))
        order = np.argpartition(key, few - 1, axis=1)[:, :few]
        order = np.take_along_axis(order, np.take_along_axis(key, order, axis=1).argsort(axis=1, kind="stable"), axis=1)
        held = np.cumsum(self.n[order], axis=1)
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, held - self.n[order] < least, axis=1)
        return first if reach is None else ~first & (bound <= reach[:, None])


def _numbers(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)


def pivot_join(queries: DataFrame, donors: DataFrame, features: Sequence[str], query_id: str, donor_id: str, k: int = 5,
               payload: Sequence[str] = (), standardise: bool = True, metric: str = "euclidean", pivots: int | None = None,
               report: bool = False) -> DataFrame:
    """The k nearest donors of each query: (query_id, donor_id, distance, payload…, rank), with `report` also `candidates`.

    Every donor belongs to the cell of its nearest pivot and there to one of RINGS blocks by its distance from it. A query
    meets the nearest blocks that hold k donors or 64, which bounds its k-th distance, and then, in a second and
    last turn, all other blocks that may hold a donor within that bound. Visits are shuffled, and the k nearest of each visit,
    but not the pairs compared (`nearest_in_blocks`). The answer is exact; pivots (about the root of
    the donors, at most MOST_PIVOTS, fitted on SAMPLE donors) only change how much is compared: `candidates` is the number
    of donors of the blocks that a query meets. Blocks' sizes, rings and boxes, at most RINGS rows a pivot, go through the driver.

    Ids are unique. Equal distances are ranked by donor id. Rows without all features, or with infinite or NaN ones, are
    neither asked nor found. No donors: no rows; fewer than k: all of them.
    """
    def _at(part: Column) -> Column:
        """One number for a part of a block."""
        return F.col("__b").cast("long") * 2**32 + part.cast("long")

    out_id, width = donor_id if donor_id != query_id else "neighbour", len(features)
    g = gram(donors, features) if standardise else None
    sd = np.sqrt(np.maximum(np.diag(g.cov), 0)) if standardise else np.ones(width)
    sd = np.where(np.isfinite(sd) & (sd > 0), sd, 1.0)
    z = [(as_col(c).cast("double") / float(s)) for c, s in zip(features, sd)]
    zs = [f"__x{i}" for i in range(width)]

    def whole(names: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf")) for c in names])

    d = donors.select(as_col(donor_id).alias("__d"), *[c.alias(n) for c, n in zip(z, zs)], *[as_col(c).alias(f"__pay_{c}") for c in payload]).where(whole(zs))
    q = queries.select(as_col(query_id).alias("__q"), *[c.alias(n) for c, n in zip(z, zs)]).where(whole(zs))
    total = d.count()

    def named(found: DataFrame) -> DataFrame:
        return found.select(F.col("__q").alias(query_id), F.col("__d").alias(out_id), "distance",
                            *[F.col(f"__pay_{c}").alias(c) for c in payload], "rank", *(["candidates"] if report else []))

    if not total:
        none = d.withColumns({"__q": F.lit(None).cast(q.schema["__q"].dataType), "distance": F.lit(0.0), "rank": F.lit(0), "candidates": F.lit(0).cast("long")})
        return named(none)
    sample = d.orderBy(F.xxhash64("__d"), "__d").limit(SAMPLE).select(*zs).toPandas().to_numpy(float)
    at = place_pivots(sample, pivots or min(MOST_PIVOTS, int(np.ceil(total ** 0.5))), metric)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = to_pivots(_numbers(batch, zs), at, metric)
            cell = to.argmin(axis=1) if len(to) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(to[np.arange(len(to)), cell])],
                                             names=[*batch.schema.names, "__c", "__far"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    celled = cut_lineage(d.mapInArrow(assign, f"{fields}, __c int, __far double"))
    cuts = celled.groupBy("__c").agg(F.percentile_approx("__far", [i / RINGS for i in range(1, RINGS)], 1000).alias("__cuts"))
    ring = F.size(F.filter("__cuts", lambda cut: cut < F.col("__far")))
    ringed = celled.join(F.broadcast(cuts), "__c").withColumn("__b", F.col("__c") * RINGS + ring).drop("__cuts", "__c")
    about = ringed.groupBy("__b").agg(F.count("*").alias("n"), F.min("__far").alias("near"), F.max("__far").alias("far"),
                                      *[f(c).alias(f"{n}{i}") for i, c in enumerate(zs) for n, f in (("lo", F.min), ("hi", F.max))])
    about = cut_lineage(about)
    blocks = Blocks(at, about.collect(), metric, width)
    parts = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    dealt = cut_lineage(ringed.join(F.broadcast(about.select("__b", parts.alias("__s"))), "__b").withColumn(
        "__at", _at(F.pmod(F.xxhash64("__d"), F.col("__s").cast("long")))).drop("__far", "__b", "__s"))
    k, least = min(k, total), max(k, 64)

    def ask(asked: DataFrame) -> DataFrame:
        """The blocks that each query visits, in the second turn by its column `__reach`."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = max(16, CELLS_AT_ONCE // len(blocks.n))
            for whole_batch in batches:
                for start in range(0, whole_batch.num_rows, rows):
                    batch = whole_batch.slice(start, rows)
                    reach = batch.column("__reach").to_numpy(zero_copy_only=False) if "__reach" in batch.schema.names else None
                    row, block = np.nonzero(blocks.visits(_numbers(batch, zs), least, reach))
                    met = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*met.columns, pa.array(blocks.ids[block].astype(np.int32)), pa.array(blocks.n[block])],
                                                     names=[*met.schema.names, "__b", "__n"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
        return asked.mapInArrow(run, f"{fields}, __b int, __n long")

    w = Window.partitionBy("__q").orderBy("distance", "__d")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def meet(visits: DataFrame) -> DataFrame:
        spread = visits.withColumn("__s", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__n") / BLOCK_ROWS).cast("int") - 1)))
        return nearest_in_blocks(spread.withColumn("__at", _at(F.col("__s"))), dealt, width, k, metric)

    first = cut_lineage(best(meet(ask(q))))
    reach = first.groupBy("__q").agg((F.max("distance") * (1 + SLACK)).alias("__reach"))
    again = cut_lineage(ask(q.join(reach, "__q")))
    found = best(first.drop("rank").unionByName(meet(again)))
    if report:
        met = ask(q).select("__q", "__n").unionByName(again.select("__q", "__n"))
        found = found.join(met.groupBy("__q").agg(F.sum("__n").alias("candidates")), "__q")
    return named(found)
