"""Time series and windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestat.functions.expr import rnd
from lodestat.operators import arima as AR
from lodestat.operators import forecast as FC
from lodestat.operators import multivariate_ts as MV
from lodestat.operators import series as S
from lodestat.operators import smoothing as SM
from lodestat.operators import stationarity as ST
from lodestat.queries.c_describe import rounded
from lodestat.queries.registry import query


def daily_events(t):
    return t.events.groupBy("event_type", F.to_date("ts").cast("timestamp").alias("day")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))


def monthly_orders(t):
    return t.orders.groupBy(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("month")).agg(
        (F.sum("o_totalprice") / 1e6).alias("total"), (F.avg("o_totalprice") / 1000).alias("mean"), F.count(F.lit(1)).cast("double").alias("n"))


_DAILY = "d AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, sum(value) v FROM events GROUP BY 1,2)"
_MONTHLY = "m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS mth, sum(o_totalprice)/1e6 total FROM orders GROUP BY 1)"


@query("g01_frequency", f"""
WITH {_DAILY}, g AS (SELECT event_type, epoch(day - lag(day) OVER (PARTITION BY event_type ORDER BY day))::DOUBLE gap FROM d)
SELECT event_type, gap AS gap_seconds, 'D' AS frequency FROM (SELECT event_type, gap, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, gap) k FROM g WHERE gap IS NOT NULL GROUP BY 1,2) WHERE k = 1""")
def _(t):
    return S.infer_frequency(daily_events(t), "day", ["event_type"])


@query("g02_regular_grid", """
WITH b AS (SELECT user_id % 10 u, date_trunc('hour', ts)::TIMESTAMP h, avg(value) v FROM events GROUP BY 1,2), e AS (SELECT u, min(h) a, max(h) z FROM b GROUP BY 1),
g AS (SELECT u, unnest(generate_series(a, z, INTERVAL 1 HOUR)) h FROM e), j AS (SELECT g.u, g.h, v FROM g LEFT JOIN b ON g.u=b.u AND g.h=b.h)
SELECT u, h AS ts, round(last_value(v IGNORE NULLS) OVER (PARTITION BY u ORDER BY h ROWS UNBOUNDED PRECEDING),5) AS value FROM j""")
def _(t):
    out = S.regular_grid(t.events.select((F.col("user_id") % 10).alias("u"), F.col("ts").alias("at"), "value"), "at", ["value"], "h", ["u"])
    return out.select("u", F.col("ts").cast("timestamp_ntz").alias("ts"), rnd("value", 5).alias("value"))


@query("g03_multivariate_grid", """
WITH b AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP d, avg(o_totalprice) p, avg(o_custkey) c FROM orders GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(d) FROM b), (SELECT max(d) FROM b), INTERVAL 1 DAY)) d)
SELECT g.d AS ts, round(last_value(p IGNORE NULLS) OVER (ORDER BY g.d ROWS UNBOUNDED PRECEDING),6) AS o_totalprice, round(last_value(c IGNORE NULLS) OVER (ORDER BY g.d ROWS UNBOUNDED PRECEDING),6) AS o_custkey FROM g LEFT JOIN b USING (d)""")
def _(t):
    out = S.regular_grid(t.orders, "o_orderdate", ["o_totalprice", "o_custkey"], "D")
    return rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 6)


@query("g04_seasonal_period")
def _(t):
    freq = S.infer_frequency(daily_events(t), "day", ["event_type"])
    pairs = [x for f in S.STEP for x in (F.lit(f), F.lit(S.seasonal_period(f)))]
    return freq.withColumn("period", F.create_map(*pairs)[F.col("frequency")])


@query("g05_future_dates", f"""
WITH {_DAILY}, l AS (SELECT event_type, max(day) m FROM d GROUP BY 1) SELECT event_type, s::INT AS step, m + s * INTERVAL 1 DAY AS ts FROM l, range(1,8) r(s)""")
def _(t):
    return S.future_dates(daily_events(t), "day", "D", 7, ["event_type"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _decompose_sql(mult):
    trend = """CASE WHEN count(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7 THEN avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END"""
    op, c = ("/", "raw/avg(raw) OVER (PARTITION BY event_type)") if mult else ("-", "raw-avg(raw) OVER (PARTITION BY event_type)")
    return f"""WITH {_DAILY}, t AS (SELECT *, {trend} AS trend, (row_number() OVER (PARTITION BY event_type ORDER BY day)-1) % 7 AS s FROM d),
r AS (SELECT event_type, s, avg(v{op}trend) raw FROM t GROUP BY 1,2), x AS (SELECT event_type, s, {c} AS seasonal FROM r)
SELECT event_type, day, round(trend,4) AS trend, round(seasonal,4)+0.0 AS seasonal, round(v{op}trend{op}seasonal,4)+0.0 AS remainder FROM t JOIN x USING (event_type, s)"""


@query("g06_decomposition", _decompose_sql(False))
def _(t):
    out = S.decompose(daily_events(t), "v", ["day"], 7, ["event_type"])
    return rounded(out.select("event_type", F.col("day").cast("timestamp_ntz").alias("day"), "trend", "seasonal", "remainder"))


@query("g06_decomposition_multiplicative", _decompose_sql(True))
def _(t):
    out = S.decompose(daily_events(t), "v", ["day"], 7, ["event_type"], multiplicative=True)
    return rounded(out.select("event_type", F.col("day").cast("timestamp_ntz").alias("day"), "trend", "seasonal", "remainder"))


@query("g06_decomposition_even_period", f"""
WITH {_MONTHLY}, i AS (SELECT *, count(*) OVER a c, (sum(total) OVER b + .5*(lag(total,6) OVER o + lead(total,6) OVER o))/12 z FROM m WINDOW o AS (ORDER BY mth), a AS (ORDER BY mth ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), b AS (ORDER BY mth ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT mth AS month, round(CASE WHEN c = 13 THEN z END,5) AS trend FROM i""")
def _(t):
    return rounded(S.decompose(monthly_orders(t), "total", ["month"], 12).select(F.col("month").cast("timestamp_ntz").alias("month"), "trend"), 5)


@query("g07_g08_g09_stationarity")
def _(t):
    return ST.stationarity(monthly_orders(t), ["total", "mean"], ["month"])


@query("g07_unit_root_no_lags", f"""
WITH {_MONTHLY}, l AS (SELECT total - lag(total) OVER (ORDER BY mth) d, lag(total) OVER (ORDER BY mth) y FROM m),
s AS (SELECT count(d)::DOUBLE n, regr_slope(d,y) b, regr_sxx(d,y) sxx, regr_syy(d,y)-pow(regr_sxy(d,y),2)/regr_sxx(d,y) rss FROM l) SELECT round(b/sqrt(rss/(n-2)/sxx),6) AS tau FROM s""")
def _(t):
    tau = ST.adf(monthly_orders(t), "total", ["month"], max_lag=0)[0]
    return monthly_orders(t).agg(rnd(F.lit(tau)).alias("tau"))


@query("g08_kpss_sums", f"""
WITH {_MONTHLY}, e AS (SELECT mth, total-avg(total) OVER () e FROM m), p AS (SELECT e, sum(e) OVER (ORDER BY mth) s FROM e) SELECT round(sum(s*s)/pow(count(*),2),6) AS eta FROM p""")
def _(t):
    from lodestat.operators.ordering import running_total
    m = monthly_orders(t)
    mean = m.agg(F.avg("total")).first()[0]
    run = running_total(m.select("month", (F.col("total") - F.lit(mean)).alias("e")), {"s": "e"}, ["month"])
    return run.agg(rnd(F.sum(F.col("s") * F.col("s")) / (F.count(F.lit(1)) * F.count(F.lit(1)))).alias("eta"))


@query("g10_integration_order")
def _(t):
    return ST.integration_summary(monthly_orders(t), ["total"], ["month"])


@query("g11_autocorrelation", f"""
WITH {_DAILY}, l AS (SELECT event_type, v, lag(v) OVER w l1, lag(v,7) OVER w l7 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, 1 AS lag, round(corr(v,l1),6)+0.0 AS r, abs(corr(v,l1)) > .4 AS memory FROM l GROUP BY 1 UNION ALL SELECT event_type, 7, round(corr(v,l7),6)+0.0, false FROM l GROUP BY 1""")
def _(t):
    return rounded(S.autocorrelation(daily_events(t), "v", ["day"], [1, 7], ["event_type"]), 6)


@query("g12_naive_forecasts", f"""
WITH {_DAILY}, p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 i FROM d), e AS (SELECT event_type, min_by(v,i) f, max_by(v,i) l, max(i) n FROM p GROUP BY 1)
SELECT e.event_type, s::INT AS step, round(l,4) AS naive, round(p.v,4) AS seasonal_naive, round(l+s*(l-f)/n,4) AS drift FROM e CROSS JOIN range(1,11) r(s) JOIN p ON p.event_type=e.event_type AND p.i = n-6+(s-1)%7""")
def _(t):
    return rounded(S.naive_forecasts(daily_events(t), "v", ["day"], 10, 7, ["event_type"]))


@query("g13_holt_winters")
def _(t):
    return SM.smoothing_forecast(daily_events(t), "v", ["day"], 7, 7, ["event_type"])


@query("g13_holt_winters_multiplicative")
def _(t):
    return SM.smoothing_forecast(daily_events(t), "v", ["day"], 7, 7, ["event_type"], multiplicative=True)


# a level alone: squared errors by recursion over a grid of weights, a finer grid around the best, and a parabola through three points
@query("g13_exponential_smoothing", f"""
WITH RECURSIVE {_DAILY}, c AS (SELECT event_type, day, v / 1e3 - avg(v / 1e3) OVER (PARTITION BY event_type) w FROM d),
x AS (SELECT event_type, row_number() OVER o t, sum(w) OVER o + 2*w y, count(*) OVER (PARTITION BY event_type) n FROM c WINDOW o AS (PARTITION BY event_type ORDER BY day)),
a AS (SELECT event_type, t, n, k/100.0::DOUBLE al, y l, 0.0::DOUBLE s FROM x, range(1, 100) r(k) WHERE t = 1
 UNION ALL SELECT a.event_type, x.t, a.n, al, l + al*(y - l), s + pow(y - l, 2) FROM a JOIN x ON x.event_type = a.event_type AND x.t = a.t + 1),
g AS (SELECT event_type, arg_min(al, s) c FROM a WHERE t = n GROUP BY 1),
b AS (SELECT x.event_type, x.t, n, j, c + j/1e4::DOUBLE al, y l, 0.0::DOUBLE s FROM x JOIN g USING (event_type), range(-99, 100) r(j) WHERE t = 1
 UNION ALL SELECT b.event_type, x.t, b.n, j, al, l + al*(y - l), s + pow(y - l, 2) FROM b JOIN x ON x.event_type = b.event_type AND x.t = b.t + 1),
o AS (SELECT event_type, j, al, n, s FROM b WHERE t = n), m AS (SELECT event_type, arg_min(j, s) j FROM o GROUP BY 1)
SELECT o.event_type, o.n, round(o.al + 0.5e-4*(lo.s - hi.s)/(lo.s - 2*o.s + hi.s), 4) AS alpha, round(o.s, 4) AS sse
FROM m JOIN o USING (event_type, j) JOIN o lo ON lo.event_type = m.event_type AND lo.j = m.j - 1 JOIN o hi ON hi.event_type = m.event_type AND hi.j = m.j + 1""")
def _(t):
    series = Window.partitionBy("event_type")
    centred = daily_events(t).withColumn("w", F.col("v") / 1e3 - F.avg(F.col("v") / 1e3).over(series))
    levels = centred.withColumn("y", F.sum("w").over(series.orderBy("day")) + 2 * F.col("w"))
    out = SM.smoothing_fit(levels, "y", ["day"], 1, ["event_type"], trend=False)
    return out.select("event_type", "n", rnd("alpha", 4).alias("alpha"), rnd("sse", 4).alias("sse"))


@query("g14_autoregression")
def _(t):
    return FC.autoregressive_forecast(daily_events(t), "v", ["day"], 5, most=3, by=["event_type"])


@query("g14_autoregression_order_one", f"""
WITH {_DAILY}, l AS (SELECT event_type, v, lag(v) OVER (PARTITION BY event_type ORDER BY day) p FROM d) SELECT event_type, round(regr_slope(v,p),6)+0.0 AS phi, round(regr_intercept(v,p),3) AS const FROM l GROUP BY 1""")
def _(t):
    out = FC.autoregression(daily_events(t), "v", ["day"], most=1, by=["event_type"])
    return out.select("event_type", rnd(F.col("coef")[1]).alias("phi"), rnd(F.col("coef")[0], 3).alias("const"))


# exact likelihood of an MA(1) of the centred values: errors and variances by recursion, the best of a grid, of a finer grid around it, and of a parabola through three points
_MA1 = f"""
WITH RECURSIVE {_DAILY}, x AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY day) t, v / 1e3 - avg(v / 1e3) OVER (PARTITION BY event_type) w, count(*) OVER (PARTITION BY event_type) n FROM d),
a AS (SELECT x.event_type, x.t, n, k, k / 100.0::DOUBLE AS th, w e, 1 + pow(k / 100.0::DOUBLE, 2) f, w*w/(1 + pow(k / 100.0::DOUBLE, 2)) s, ln(1 + pow(k / 100.0::DOUBLE, 2)) l FROM x, range(-99, 100) r(k) WHERE t = 1
 UNION ALL SELECT a.event_type, x.t, a.n, k, th, w - th*e/f, 1 + th*th - th*th/f, s + pow(w - th*e/f, 2)/(1 + th*th - th*th/f), l + ln(1 + th*th - th*th/f) FROM a JOIN x ON x.event_type = a.event_type AND x.t = a.t + 1),
g AS (SELECT event_type, arg_min(th, n*ln(s/n) + l) c FROM a WHERE t = n GROUP BY 1),
b AS (SELECT x.event_type, x.t, n, c, j, c + j/1e4::DOUBLE AS th, w e, 1 + pow(c + j/1e4::DOUBLE, 2) f, w*w/(1 + pow(c + j/1e4::DOUBLE, 2)) s, ln(1 + pow(c + j/1e4::DOUBLE, 2)) l FROM x JOIN g USING (event_type), range(-100, 101) r(j) WHERE t = 1
 UNION ALL SELECT b.event_type, x.t, b.n, c, j, th, w - th*e/f, 1 + th*th - th*th/f, s + pow(w - th*e/f, 2)/(1 + th*th - th*th/f), l + ln(1 + th*th - th*th/f) FROM b JOIN x ON x.event_type = b.event_type AND x.t = b.t + 1),
o AS (SELECT event_type, j, th, n, s, n*ln(s/n) + l q FROM b WHERE t = n), m AS (SELECT event_type, arg_min(j, q) j FROM o GROUP BY 1),
z AS (SELECT o.event_type, o.n, o.th, o.q, o.s, lo.q ql, hi.q qh FROM m JOIN o USING (event_type, j) JOIN o lo ON lo.event_type = m.event_type AND lo.j = m.j - 1 JOIN o hi ON hi.event_type = m.event_type AND hi.j = m.j + 1)
SELECT event_type, n, round(th + 0.5e-4*(ql - qh)/(ql - 2*q + qh), 4) + 0.0 AS theta, round(-0.5*(n*(ln(2*pi()) + 1) + q), 4) AS log_likelihood FROM z"""


@query("g14_arima", _MA1)
def _(t):
    centred = daily_events(t).withColumn("v", F.col("v") / 1e3 - F.avg(F.col("v") / 1e3).over(Window.partitionBy("event_type")))
    out = AR.arima_fit(centred, "v", ["day"], [(0, 0, 1, 0, 0, 0, 0)], ["event_type"], mean=False)
    return out.select("event_type", "n", rnd(F.col("ma")[0], 4).alias("theta"), rnd("log_likelihood", 4).alias("log_likelihood"))


@query("g14_arima_forecast")
def _(t):
    return AR.arima_forecast(daily_events(t), "v", ["day"], 5, by=["event_type"])


@query("g15_sarima_forecast")
def _(t):
    return AR.arima_forecast(monthly_orders(t), "total", ["month"], 6, AR.seasonal_orders(12))


@query("g15_seasonal_autoregression")
def _(t):
    return FC.autoregressive_forecast(monthly_orders(t), "total", ["month"], 6, most=2, d=1, seasonal=12)


@query("g16_trend_season")
def _(t):
    return FC.trend_season_fit(daily_events(t), "v", ["day"], 7, 7, knots=2, waves=2, by=["event_type"])


@query("g17_backtest", f"""
WITH {_DAILY}, p AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 i FROM d), e AS (SELECT event_type, min_by(v,i) y0, max(i)+1 n FROM p GROUP BY 1),
o AS (SELECT e.*, n-1-3-k AS o, h FROM e, range(4) a(k), range(1,4) b(h)),
f AS (SELECT a.event_type, a.v y, x.v yo, s.v ys, h, o.o, y0 FROM o JOIN p x ON x.event_type=o.event_type AND x.i=o.o JOIN p a ON a.event_type=o.event_type AND a.i=o.o+h JOIN p s ON s.event_type=o.event_type AND s.i=o.o-6+(h-1)%7 WHERE o.o >= 7),
m AS (SELECT event_type, unnest(['naive','seasonal_naive','drift']) AS "method", y, unnest([yo, ys, yo+h*(yo-y0)/o]) AS p FROM f),
r AS (SELECT event_type, "method", count(*) n, avg(abs(y-p)) mae, sqrt(avg(pow(y-p,2))) rmse, avg(abs((y-p)/y))*100 mape FROM m GROUP BY 1,2)
SELECT r.event_type, r."method", r.n, round(r.mae,4) AS mae, round(r.rmse,4) AS rmse, round(r.mape,4) AS mape, round(1-r.mae/b.mae,6)+0.0 AS skill FROM r JOIN r b ON b.event_type=r.event_type AND b."method"='naive'""")
def _(t):
    return rounded(S.backtest_simple(daily_events(t), "v", ["day"], 3, 4, 7, ["event_type"]), 4, skill=6)


@query("g18_forecaster_comparison")
def _(t):
    return FC.compare_forecasters(daily_events(t), "v", ["day"], 5, 7, ["event_type"])


@query("g18_simple_comparison", f"""
WITH {_MONTHLY}, p AS (SELECT total v, row_number() OVER (ORDER BY mth) - 1 i, count(*) OVER () n FROM m), b AS (SELECT max_by(v,i) l, min_by(v,i) f, max(i) k FROM p WHERE i < n-6),
e AS (SELECT p.v y, l, q.v s, l+(p.i-b.k)*(l-f)/b.k d FROM p, b, p q WHERE p.i >= p.n-6 AND q.i = b.k-11+(p.i-b.k-1)%12),
r AS (SELECT unnest(['naive','seasonal_naive','drift']) AS "method", unnest([avg(abs(y-l)), avg(abs(y-s)), avg(abs(y-d))]) AS mae FROM e) SELECT "method", round(mae,6) AS mae FROM r""")
def _(t):
    return rounded(FC.compare_forecasters(monthly_orders(t), "total", ["month"], 6, 12, methods=[]).select("method", "mae"), 6)


@query("g19_granger")
def _(t):
    return MV.granger(monthly_orders(t), ["total", "mean"], ["month"], 3)


@query("g20_granger_stationary")
def _(t):
    return MV.granger_stationary(monthly_orders(t), ["total", "mean"], ["month"], 2)


@query("g21_johansen")
def _(t):
    return MV.johansen(monthly_orders(t), ["total", "mean"], ["month"], 1)


@query("g22_var_forecast")
def _(t):
    return MV.var_forecast(monthly_orders(t), ["total", "mean"], ["month"], 6, 3)


@query("g23_impulse_responses")
def _(t):
    return MV.impulse_responses(monthly_orders(t), ["total", "mean"], ["month"], 6, 2)


@query("g24_pairwise_var")
def _(t):
    return MV.pairwise_var(monthly_orders(t), ["total", "mean", "n"], ["month"], 4)


@query("g25_vecm_forecast")
def _(t):
    return MV.vecm_forecast(monthly_orders(t), ["total", "mean"], ["month"], 4)


@query("g26_ardl_bounds")
def _(t):
    return MV.ardl_bounds(monthly_orders(t), "total", ["mean"], ["month"], 1)


@query("g27_bvar_forecast")
def _(t):
    return MV.bvar_forecast(monthly_orders(t), ["total", "mean"], ["month"], 4)


@query("g28_residual_diagnostics", f"""
WITH {_DAILY}, e AS (SELECT event_type, day, v, v-avg(v) OVER (PARTITION BY event_type) x FROM d), l AS (SELECT *, lag(v) OVER w vl, {", ".join(f"lag(x,{k}) OVER w l{k}" for k in (1, 2, 3))} FROM e WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT 'v' AS "column", event_type, count(*) AS n, round(count(*)::DOUBLE*(count(*)+2)*({"+".join(f"pow(sum(x*l{k})/sum(x*x),2)/(count(*)-{k})" for k in (1, 2, 3))}),5) AS ljung_box, round(sum(pow(v-vl,2))/sum(v*v),6) AS durbin_watson,
 round(count(*)/6.0::DOUBLE*(pow(skewness(v)*(count(*)-2)/sqrt(count(*)::DOUBLE*(count(*)-1)),2)+pow(kurtosis_pop(v),2)/4),5) AS jarque_bera FROM l GROUP BY event_type""")
def _(t):
    return rounded(S.residual_diagnostics(daily_events(t), ["v"], ["day"], 3, ["event_type"]), 5, durbin_watson=6)


@query("g29_workflow")
def _(t):
    return MV.workflow(monthly_orders(t), ["total", "mean"], ["month"], 2)


@query("g30_returns", f"WITH {_DAILY} SELECT event_type, day, round(ln(v/lag(v) OVER (PARTITION BY event_type ORDER BY day)),6)+0.0 AS \"return\" FROM d")
def _(t):
    out = S.returns(daily_events(t), "v", ["day"], ["event_type"])
    return rounded(out.select("event_type", F.col("day").cast("timestamp_ntz").alias("day"), "return"), 6)


@query("g31_garch")
def _(t):
    return SM.garch_fit(S.returns(daily_events(t), "v", ["day"], ["event_type"]).where("return IS NOT NULL"), "return", ["day"], ["event_type"])


@query("g32_trend_test", f"""
WITH {_MONTHLY}, k AS (SELECT row_number() OVER (ORDER BY mth)::DOUBLE a, (rank() OVER (ORDER BY total))::DOUBLE b FROM m) SELECT 'total' AS "column", count(*) AS n, round(corr(a,b),6)+0.0 AS rho, abs(corr(a,b)) >= .3 AS trend FROM k""")
def _(t):
    return rounded(S.trend_test(monthly_orders(t), "total", "month").drop("t"), 6)
