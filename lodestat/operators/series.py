"""Time series of many keys at once: grids, decomposition, autocorrelation, simple forecasts, backtests."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col, join_null_safe, local_rows, ratio, safe_corr
from lodestat.operators.linear import durbin_watson, jarque_bera, ljung_box
from lodestat.operators.ordering import fill_order, order_number, over_order, with_position

# Rows per season by frequency.
SEASON = {"h": 24, "B": 5, "D": 7, "W": 52, "M": 12, "Q": 4, "Y": 1, "min": 60}
STEP = {"min": "interval 1 minute", "h": "interval 1 hour", "D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month",
        "Q": "interval 3 months", "Y": "interval 1 year"}
_TRUNC = {"min": "minute", "h": "hour", "D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def _keys(by: Sequence[str]) -> list[Column]:
    return [as_col(b) for b in by]


def seasonal_period(freq: str) -> int:
    for key in ("min", "B", "D", "W", "M", "Q", "Y", "h"):
        if freq == key or freq.upper().startswith(key.upper()):
            return SEASON[key]
    return 1


def infer_frequency(df: DataFrame, ts: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """Commonest gap between consecutive distinct times (the smaller on ties), and its frequency letter."""
    times = df.where(as_col(ts).isNotNull()).select(*_keys(by), as_col(ts).cast("timestamp").alias("t")).distinct()
    gaps = over_order(times, ["t"], lambda w: {"gap": (F.unix_micros("t") - F.unix_micros(F.lag("t").over(w))) / F.lit(1e6)}, by, before=1, **kw)
    modal = gaps.where("gap IS NOT NULL").groupBy(*_keys(by), "gap").count().groupBy(*_keys(by)).agg(
        F.min(F.struct((-F.col("count")).alias("k"), "gap")).alias("b"))
    g = F.col("b.gap")
    day = 86400.0
    freq = (F.when(g >= 365 * day, "Y").when(g >= 28 * day, "M").when(g >= 7 * day, "W").when(g >= day, "D").when(g >= 3600, "h").when(g >= 60, "min").otherwise("D"))
    return modal.select(*_keys(by), g.alias("gap_seconds"), freq.alias("frequency"))


def regular_grid(df: DataFrame, ts: str, values: Sequence[str], freq: str, by: Sequence[str] = (), how: str = "mean",
                 chunk: int = 10_000, fill: bool = True, **kw) -> DataFrame:
    """One row per step from a series' first to last time; several rows in a step take their mean (or the last), gaps the neighbours' values.

    Steps are produced in chunks so a long series never becomes one huge array.
    """
    slot = F.date_trunc(_TRUNC[freq], as_col(ts).cast("timestamp"))
    agg = (lambda c: F.avg(as_col(c).cast("double"))) if how == "mean" else (lambda c: F.max_by(as_col(c).cast("double"), F.when(as_col(c).isNotNull(), as_col(ts))))
    binned = df.where(as_col(ts).isNotNull()).groupBy(*_keys(by), slot.alias("ts")).agg(*[agg(c).alias(c) for c in values])
    ends = binned.groupBy(*_keys(by)).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    months = {"M": 1, "Q": 3, "Y": 12}.get(freq)
    if months:
        steps = F.round(F.months_between("b", "a") / months).cast("long")
        at = F.add_months(F.col("a").cast("date"), (F.col("i") * months).cast("int")).cast("timestamp")
    else:
        micros = {"min": 60, "h": 3600, "D": 86400, "W": 604800}[freq] * 1_000_000
        steps = F.floor((F.unix_micros("b") - F.unix_micros("a")) / micros).cast("long")
        at = F.timestamp_micros(F.unix_micros("a") + F.col("i") * micros)
    spread = ends.withColumn("n", steps).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / chunk)))).withColumn(
        "i", F.explode(F.sequence(F.col("c") * chunk, F.least(F.col("n"), (F.col("c") + 1) * chunk - 1))))
    grid = spread.select(*_keys(by), at.alias("ts"))
    out = join_null_safe(grid, binned, [*by, "ts"])
    if fill:
        out = fill_order(fill_order(out, values, ["ts"], by, True, **kw), values, ["ts"], by, False, **kw)
    return out


def future_dates(df: DataFrame, ts: str, freq: str, steps: int, by: Sequence[str] = (), dates: Sequence[datetime] | None = None) -> DataFrame:
    """The next steps after each series' last time, or a given list of as many dates."""
    if dates is not None and len(dates) != steps:
        raise ValueError(f"{steps} dates expected, {len(dates)} given")
    last = df.groupBy(*_keys(by)).agg(F.max(as_col(ts).cast("timestamp")).alias("last"))
    if dates is not None:
        rows = F.posexplode(F.array(*[F.lit(d).cast("timestamp") for d in dates]))
        return last.select(*_keys(by), rows.alias("step", "ts")).withColumn("step", F.col("step") + 1)
    seq = F.expr(f"sequence(last + {STEP[freq]}, last + {steps} * {STEP[freq]}, {STEP[freq]})")
    return last.select(*_keys(by), F.posexplode(seq).alias("step", "ts")).withColumn("step", F.col("step") + 1)


def decompose(df: DataFrame, value: str, order: Sequence[str], period: int, by: Sequence[str] = (), multiplicative: bool = False, **kw) -> DataFrame:
    """Trend (centred moving average), seasonal index and remainder of every row."""
    half = period // 2
    v = as_col(value).cast("double")
    placed = with_position(df, order, by, "__i", **kw)

    def trend(w) -> dict[str, Column]:
        if period % 2:
            frame = w.rowsBetween(-half, half)
            return {"trend": F.when(F.count(v).over(frame) == period, F.avg(v).over(frame))}
        inner, outer = w.rowsBetween(-half + 1, half - 1), w.rowsBetween(-half, half)
        total = F.sum(v).over(inner) + 0.5 * (F.lag(v, half).over(w) + F.lead(v, half).over(w))
        return {"trend": F.when(F.count(v).over(outer) == period + 1, total / period)}

    smooth = over_order(placed, ["__i"], trend, by, half, half, **kw)
    rest = F.try_divide(v, F.col("trend")) if multiplicative else v - F.col("trend")
    index = smooth.withColumn("__s", F.col("__i") % period).withColumn("__r", rest)
    raw = index.groupBy(*_keys(by), "__s").agg(F.avg("__r").alias("__m"))
    centre = raw.groupBy(*_keys(by)).agg(F.avg("__m").alias("__c"))
    if by:
        seasons = join_null_safe(raw, centre, list(by))
    else:
        seasons = raw.withColumn("__c", F.lit(centre.first()[0]))
    seasons = seasons.select(*_keys(by), "__s", (F.try_divide(F.col("__m"), F.col("__c")) if multiplicative else F.col("__m") - F.col("__c")).alias("seasonal"))
    out = join_null_safe(index, seasons, [*by, "__s"])
    left = F.try_divide(v, F.col("trend") * F.col("seasonal")) if multiplicative else v - F.col("trend") - F.col("seasonal")
    return out.withColumn("remainder", left).drop("__i", "__s", "__r")


def autocorrelation(df: DataFrame, value: str, order: Sequence[str], lags: Sequence[int], by: Sequence[str] = (), **kw) -> DataFrame:
    """Correlation with each lag, and the memory flag of lag one."""
    v = as_col(value).cast("double")
    lagged = over_order(df, order, lambda w: {f"__l{k}": F.lag(v, k).over(w) for k in lags}, by, before=max(lags), **kw)
    wide = lagged.groupBy(*_keys(by)).agg(*[safe_corr(v, F.col(f"__l{k}")).alias(f"r{k}") for k in lags])
    return wide.select(*_keys(by), F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in lags])).alias("e")).select(
        *_keys(by), "e.*").withColumn("memory", (F.col("lag") == 1) & (F.abs("r") > 0.4))


def naive_forecasts(df: DataFrame, value: str, order: Sequence[str], horizon: int, period: int = 1, by: Sequence[str] = (), **kw) -> DataFrame:
    """Last value, last season and drift, for each step ahead."""
    v = as_col(value).cast("double")
    placed = with_position(df.where(v.isNotNull()), order, by, "__i", **kw)
    ends = placed.groupBy(*_keys(by)).agg(F.min_by(v, F.col("__i")).alias("first"), F.max_by(v, F.col("__i")).alias("last"), F.max("__i").alias("n"))
    steps = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    steps = steps.withColumn("__i", F.col("n") - period + 1 + F.pmod(F.col("step") - 1, F.lit(period)))
    season = placed.select(*_keys(by), "__i", v.alias("seasonal"))
    out = join_null_safe(steps, season, [*by, "__i"])
    return out.select(*_keys(by), "step", F.col("last").alias("naive"), F.coalesce("seasonal", "last").alias("seasonal_naive"),
                      (F.col("last") + F.col("step") * F.coalesce(F.try_divide(F.col("last") - F.col("first"), F.col("n").cast("double")), F.lit(0.0))).alias("drift"))


def backtest_simple(df: DataFrame, value: str, order: Sequence[str], horizon: int, origins: int = 5, period: int = 1, by: Sequence[str] = (), **kw) -> DataFrame:
    """Rolling-origin errors of the simple forecasters: (method, mae, rmse, mape, skill against the last value).

    Origins are positions; forecasts meet actual values by equi-joins on position.
    """
    v = as_col(value).cast("double")
    placed = with_position(df.where(v.isNotNull()), order, by, "i", **kw).select(*_keys(by), "i", v.alias("y"))
    size = placed.groupBy(*_keys(by)).agg((F.max("i") + 1).alias("n"), F.min_by("y", "i").alias("y0"))
    plan = size.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(origins - 1)))).withColumn("o", F.col("n") - 1 - horizon - F.col("k")).where(F.col("o") >= period)
    at = join_null_safe(plan, placed.select(*_keys(by), F.col("i").alias("o"), F.col("y").alias("yo")), [*by, "o"])
    steps = at.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("i", F.col("o") + F.col("h")).withColumn(
        "s", F.col("o") - period + 1 + F.pmod(F.col("h") - 1, F.lit(period)))
    both = join_null_safe(steps, placed, [*by, "i"])
    both = join_null_safe(both, placed.select(*_keys(by), F.col("i").alias("s"), F.col("y").alias("ys")), [*by, "s"])
    drift = F.col("yo") + F.col("h") * ratio(F.col("yo") - F.col("y0"), F.col("o"))
    methods = F.array(*[F.struct(F.lit(m).alias("method"), e.alias("forecast")) for m, e in (("naive", F.col("yo")), ("seasonal_naive", F.col("ys")), ("drift", drift))])
    long = both.select(*_keys(by), "y", F.explode(methods).alias("m")).select(*_keys(by), "y", "m.*")
    return score_forecasts(long, by)


def score_forecasts(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE per method, and the gain over the naive method."""
    e = F.col("y") - F.col("forecast")
    t = long.groupBy(*_keys(by), "method").agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                                               (F.avg(F.abs(F.try_divide(e, F.col("y")))) * 100).alias("mape"))
    base = t.where("method = 'naive'").select(*_keys(by), F.col("mae").alias("__b"))
    if by:
        t = join_null_safe(t, base, list(by))
    else:
        first = base.first()
        t = t.withColumn("__b", F.lit(first["__b"] if first else None).cast("double"))
    return t.withColumn("skill", 1 - ratio(F.col("mae"), F.col("__b"))).drop("__b")


def returns(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), name: str = "return", **kw) -> DataFrame:
    """Log returns when every value of the series is positive, else simple returns."""
    v = as_col(value).cast("double")
    low = df.groupBy(*_keys(by)).agg(F.min(v).alias("__low"))
    lagged = over_order(df, order, lambda w: {"__p": F.lag(v).over(w)}, by, before=1, **kw)
    if by:
        lagged = join_null_safe(lagged, low, list(by))
    else:
        lagged = lagged.withColumn("__low", F.lit(low.first()[0]))
    q = F.try_divide(v, F.col("__p"))
    return lagged.withColumn(name, F.when(F.col("__low") > 0, F.log(q)).otherwise(q - 1)).drop("__p", "__low")


def residual_diagnostics(df: DataFrame, values: Sequence[str], order: Sequence[str], lags: int = 10, by: Sequence[str] = (), **kw) -> DataFrame:
    """Ljung-Box, Jarque-Bera and Durbin-Watson of each residual column."""
    out = None
    for c in values:
        e = as_col(c).cast("double")
        q = ljung_box(df, e, order, lags, by, **kw).withColumnRenamed("q", "ljung_box").drop("lags")
        d = durbin_watson(df, e, order, by, **kw)
        if by:
            m = df.groupBy(*_keys(by)).agg(F.skewness(e).alias("g1"), F.kurtosis(e).alias("g2"))
            row = join_null_safe(join_null_safe(q, d, list(by)), m, list(by)).withColumn(
                "jarque_bera", F.col("n") / 6 * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4)).drop("g1", "g2")
        else:
            row = q.withColumn("durbin_watson", F.lit(d.first()[0])).withColumn("jarque_bera", F.lit(jarque_bera(df, e).first()["jarque_bera"]))
        row = row.select(F.lit(c).alias("column"), *_keys(by), "n", "ljung_box", "durbin_watson", "jarque_bera")
        out = row if out is None else out.unionByName(row)
    return out


def trend_test(df: DataFrame, value: str, ts: str) -> DataFrame:
    """Rank correlation of a column with time; a trend from 0.3 on."""
    from lodestat.operators.correlate import spearman_pairs
    d = df.where(as_col(ts).isNotNull() & as_col(value).isNotNull()).select(order_number(df, ts).alias("time"), as_col(value).cast("double").alias("value"))
    return spearman_pairs(d, ["time", "value"]).select(F.lit(value).alias("column"), "n", F.col("r").alias("rho"), "t", (F.abs("r") >= 0.3).alias("trend"))
