"""Queries for decomposition (D) and the closed-form and group forecasters (M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import groupwise as gw
from ..models.base import with_baseline
from ..models.smoothing import ETS, STL, Theta
from ..models.wma import WMA, Naive
from ..operators import decompose as dc
from ..operators import evaluate
from ..sources.tables import brand_panel, region_panel
from . import events_sql as es
from . import inputs as i
from . import model_sql as ms
from .event_queries import EVENT_LIFTS, LIFTS
from .join_queries import DAILY_EVENTS, PLAN, plan
from .registry import query


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


BAND = ("yhat", "lower_ci", "upper_ci")

# --- decomposition ---------------------------------------------------------------------


def waves_sql(panel: str) -> str:
    """CTEs up to ``periods``: up to three strongest periods of each series by the direct Fourier sums."""
    def pick(rank: int) -> str:
        others = "".join(f" AND abs(r.period - f{k}.p{k}) / f{k}.p{k} >= 0.2" for k in range(1, rank))
        joins = "".join(f" JOIN first{k} f{k} ON f{k}.series_id = r.series_id" for k in range(1, rank))
        return f"""first{rank} AS (SELECT r.series_id, arg_max(r.period, r.size) AS p{rank} FROM rated r{joins} WHERE r.size > 1e-6{others} GROUP BY 1)"""

    return f"""waves AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS t,
    count(*) OVER (PARTITION BY series_id) AS n, y - avg(y) OVER (PARTITION BY series_id) AS c FROM {panel}),
  sizes AS (SELECT series_id, k, max(n) AS n, sqrt(pow(sum(c * cos(2 * pi() * k * t / n)), 2) + pow(sum(c * sin(2 * pi() * k * t / n)), 2)) AS size
    FROM waves JOIN range(1, 3000) r(k) ON k <= n // 2 GROUP BY 1, 2),
  rated AS (SELECT * FROM (SELECT *, CAST(round_even(1.0::DOUBLE / (k * (1.0::DOUBLE / n)), 0) AS INTEGER) AS period FROM sizes)
    WHERE period BETWEEN 2 AND CASE WHEN n < 2 * least(365, n // 2) THEN greatest(7, n // 4) ELSE least(365, n // 2) END),
  {pick(1)}, {pick(2)}, {pick(3)}"""


@query("d1_spectral_periods", i.with_sql(i.REGION, waves_sql("region_panel")) + """SELECT s.series_id, CAST(n AS INTEGER) AS n, CAST(rank AS INTEGER) AS rank, period FROM (
    SELECT series_id, 0 AS rank, p1 AS period FROM first1 UNION ALL SELECT series_id, 1, p2 FROM first2 UNION ALL SELECT series_id, 2, p3 FROM first3) s
  JOIN (SELECT DISTINCT series_id, n FROM sizes) n ON n.series_id = s.series_id""")
def d1(spark: SparkSession, folder: str) -> DataFrame:
    out = dc.spectral_periods(region_panel(spark, folder))
    return out.select("series_id", "n", F.posexplode("periods").alias("rank", "period"))


@query("d1_dominant_period", i.with_sql(i.REGION, waves_sql("region_panel")) + "SELECT series_id, p1 AS period FROM first1")
def d1_dominant(spark: SparkSession, folder: str) -> DataFrame:
    return dc.spectral_periods(region_panel(spark, folder)).select("series_id", F.get("periods", F.lit(0)).alias("period"))


ACF_PEAKS = """base AS (SELECT series_id, y - avg(y) OVER s AS c, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS idx, count(*) OVER s AS n
  FROM region_panel WINDOW s AS (PARTITION BY series_id)),
spread AS (SELECT series_id, max(n) AS n, sum(c * c) AS v FROM base GROUP BY 1),
pairs AS (SELECT a.series_id, CAST(b.idx - a.idx AS INTEGER) AS lag, sum(a.c * b.c) AS s FROM base a JOIN base b
  ON a.series_id = b.series_id AND b.idx - a.idx BETWEEN 1 AND 365 GROUP BY 1, 2),
acf AS (SELECT p.series_id, lag, n, s / v * n / (n - lag) AS r FROM pairs p JOIN spread d ON p.series_id = d.series_id WHERE lag <= least(365, n // 3)),
peaks AS (SELECT * FROM (SELECT *, lag(r) OVER w AS before, lead(r) OVER w AS after FROM acf WINDOW w AS (PARTITION BY series_id ORDER BY lag))
  WHERE r > 2 / sqrt(n) AND r > before AND r > after AND lag >= 2)"""


def _next_peak(rank: int) -> str:
    others = "".join(f" AND abs(p.lag - f{k}.p{k}) / f{k}.p{k} >= 0.2" for k in range(1, rank))
    joins = "".join(f" JOIN peak{k} f{k} ON f{k}.series_id = p.series_id" for k in range(1, rank))
    return f"""peak{rank} AS (SELECT p.series_id, arg_min(p.lag, struct_pack(r := -round(r, 9), l := p.lag)) AS p{rank} FROM peaks p{joins} WHERE true{others} GROUP BY 1)"""


PERIODS = f"{_next_peak(1)}, {_next_peak(2)}, {_next_peak(3)}"


@query("d2_acf_peaks", i.with_sql(i.REGION, ACF_PEAKS, PERIODS) + """SELECT series_id, CAST(rank AS INTEGER) AS rank, CAST(period AS INTEGER) AS period FROM (
  SELECT series_id, 0 AS rank, p1 AS period FROM peak1 UNION ALL SELECT series_id, 1, p2 FROM peak2 UNION ALL SELECT series_id, 2, p3 FROM peak3)""")
def d2(spark: SparkSession, folder: str) -> DataFrame:
    out = dc.autocorrelation_periods(region_panel(spark, folder), 365)
    return out.select("series_id", F.posexplode("periods").alias("rank", "period"))


@query("d3_robust_decomposition")
def d3(spark: SparkSession, folder: str) -> DataFrame:
    return dc.decomposition_rows(dc.robust_decompose(region_panel(spark, folder), 7))


def classical_sql(panel: str, period: int) -> str:
    half, rows = period // 2, 2 * (period // 2) + 1
    return f"""smooth AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n,
  CASE WHEN count(*) OVER w = {rows} THEN sum(y) OVER w / {period} END AS trend FROM {panel}
  WINDOW w AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)),
phases AS (SELECT series_id, p AS phase, coalesce(m, 0) AS m FROM (SELECT DISTINCT series_id FROM {panel}) CROSS JOIN range({period}) r(p)
  LEFT JOIN (SELECT series_id AS sid, idx % {period} AS ph, avg(y - trend) AS m FROM smooth WHERE trend <> 0 GROUP BY 1, 2) ON sid = series_id AND ph = p),
seasons AS (SELECT series_id, phase, m - avg(m) OVER (PARTITION BY series_id) AS seasonal FROM phases),
parts AS (SELECT s.series_id, ds, y, idx, n, trend, seasonal, y - trend - seasonal AS residual FROM smooth s
  JOIN seasons e ON s.series_id = e.series_id AND e.phase = s.idx % {period})"""


@query("d4_classical", i.with_sql(i.REGION, classical_sql("region_panel", 7)) + """SELECT series_id, ds, y, round(trend, 6) AS trend,
  round(seasonal, 5) AS seasonal, round(residual, 5) AS residual FROM parts""")
def d4(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rounded(dc.classical(region_panel(spark, folder), 7), 6, "trend"), 5, "seasonal", "residual")




SEASONAL_PARAMS = """{params} AS (SELECT a.series_id, model, CASE WHEN model IN ('ets', 'theta', 'stl', 'wma') THEN p1 END AS seasonal_periods,
  CASE WHEN model = 'sarimax' THEN p1 END AS seasonal_period,
  CASE WHEN model = 'prophet' AND p2 = 30 AND p1 <> 30 THEN false WHEN model = 'prophet' AND p1 IN (52, 53, 12, 30) THEN true END AS yearly_seasonality,
  CASE WHEN model = 'prophet' AND (p1 = 7 OR p2 = 7) THEN true WHEN model = 'prophet' AND p1 IN (52, 53) THEN false END AS weekly_seasonality
  FROM {first} a LEFT JOIN {second} b ON a.series_id = b.series_id CROSS JOIN (SELECT unnest(['ets', 'theta', 'wma', 'sarimax', 'prophet']) AS model))"""
WITH_PARAMS = ["ets", "theta", "wma", "sarimax", "prophet"]


@query("d5_seasonal_params", i.with_sql(i.REGION, ACF_PEAKS, PERIODS, SEASONAL_PARAMS.format(params="params", first="peak1", second="peak2")) + "SELECT * FROM params")
def d5(spark: SparkSession, folder: str) -> DataFrame:
    return dc.seasonal_params(dc.autocorrelation_periods(region_panel(spark, folder), 365), WITH_PARAMS)


@query("d6_trend_line", i.with_sql(i.BRAND) + """SELECT series_id, ds, round(regr_intercept(y, i) OVER s + regr_slope(y, i) OVER s * i, 4) AS trend FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS i FROM brand_panel) WINDOW s AS (PARTITION BY series_id)""")
def d6(spark: SparkSession, folder: str) -> DataFrame:
    out = dc.trend_line(brand_panel(spark, folder).select("series_id", "ds", "y"))
    return rounded(out.drop("y"), 4, "trend")


@query("d7_outlier_flags", i.with_sql(i.BRAND, """quart AS (SELECT series_id, max(CASE WHEN pos = floor(n * 0.25) THEN y END) AS q1,
  max(CASE WHEN pos = floor(n * 0.75) THEN y END) AS q3 FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY y) - 1 AS pos,
    count(*) OVER (PARTITION BY series_id) AS n FROM brand_panel) GROUP BY 1)""") + """
  SELECT b.series_id, ds, y, y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1) AS is_outlier FROM brand_panel b JOIN quart q ON b.series_id = q.series_id""")
def d7(spark: SparkSession, folder: str) -> DataFrame:
    return dc.outlier_flags(brand_panel(spark, folder).select("series_id", "ds", "y"))


# --- closed-form models ----------------------------------------------------------------


@query("m1_wma_forecast", i.with_sql(i.REGION, *ms.wma("region_panel", 7)) + """SELECT series_id, step, ds, round(yhat, 4) AS yhat,
  round(lower_ci, 4) AS lower_ci, round(upper_ci, 4) AS upper_ci FROM wma_forecast""")
def m1(spark: SparkSession, folder: str) -> DataFrame:
    model = WMA()
    return rounded(model.forecast(model.fit(region_panel(spark, folder)), 7), 4, *BAND)


@query("m1_wma_with_factors", i.with_sql(i.REGION, i.HOLIDAYS, *ms.wma("region_panel", 30, "holiday_multiplier")) + """SELECT series_id, step, ds,
  round(yhat, 4) AS yhat, round(lower_ci, 4) AS lower_ci, round(upper_ci, 4) AS upper_ci FROM wma_forecast""")
def m1_factors(spark: SparkSession, folder: str) -> DataFrame:
    model = WMA()
    factors = {"holidays": ms.shifted_holidays(spark, folder)}
    return rounded(model.forecast(model.fit(region_panel(spark, folder)), 30, "D", factors), 4, *BAND)


@query("m2_ets")
def m2(spark: SparkSession, folder: str) -> DataFrame:
    model = ETS()
    return model.forecast(model.fit(region_panel(spark, folder)), 14)


LEVEL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS rk, count(*) OVER (PARTITION BY series_id) AS n FROM region_panel),
smoothed AS (SELECT series_id, max(ds) AS last_ds, sum(0.3 * pow(0.7, n - rk) * y) + pow(0.7, max(n)) * avg(CASE WHEN rk <= 7 THEN y END) AS level FROM ranked GROUP BY 1)"""


@query("m2_ets_level", i.with_sql(i.REGION, LEVEL) + """SELECT series_id, step, CAST(last_ds + step AS DATE) AS ds, round(level, 3) AS yhat
  FROM (SELECT *, CAST(unnest(range(1, 8)) AS INTEGER) AS step FROM smoothed)""")
def m2_level(spark: SparkSession, folder: str) -> DataFrame:
    model = ETS(trend=None, seasonal=None, alphas=(0.3,))
    out = model.forecast(model.fit(region_panel(spark, folder)), 7)
    return out.select("series_id", "step", "ds", F.round("yhat", 3).alias("yhat"))


@query("m2_ets_multiplicative")
def m2_mul(spark: SparkSession, folder: str) -> DataFrame:
    model = ETS(trend="mul", seasonal="mul")
    return model.forecast(model.fit(region_panel(spark, folder)), 14)


THETA = """tx AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM region_panel),
ts AS (SELECT *, avg(y) OVER (PARTITION BY series_id, idx % 7) / avg(y) OVER (PARTITION BY series_id) AS season FROM tx),
tf AS (SELECT series_id, max(ds) AS last_ds, max(n) AS n, regr_slope(y / season, idx) AS slope,
  sum(0.2 * pow(0.8, n - 1 - idx) * y / season) + max(CASE WHEN idx = 0 THEN pow(0.8, n) * y / season END) AS level FROM ts GROUP BY 1),
tp AS (SELECT DISTINCT series_id, idx % 7 AS phase, season FROM ts),
tg AS (SELECT *, CAST(unnest(range(1, 15)) AS INTEGER) AS step FROM tf)"""


@query("m3_theta_fixed_alpha", i.with_sql(i.REGION, THETA) + """SELECT g.series_id, step, CAST(last_ds + step AS DATE) AS ds,
  round((level + 0.5 * slope * (step - 1 + (1 - pow(0.8, n)) / 0.2)) * season, 3) AS yhat FROM tg g
  JOIN tp p ON g.series_id = p.series_id AND p.phase = (n + step - 1) % 7""")
def m3(spark: SparkSession, folder: str) -> DataFrame:
    model = Theta(alpha=0.2)
    out = model.forecast(model.fit(region_panel(spark, folder)), 14)
    return out.select("series_id", "step", "ds", F.round("yhat", 3).alias("yhat"))


@query("m3_theta")
def m3_search(spark: SparkSession, folder: str) -> DataFrame:
    model = Theta()
    return model.forecast(model.fit(region_panel(spark, folder)), 14)


STL_SQL = classical_sql("region_panel", 7) + """,
sf AS (SELECT series_id, max(ds) AS last_ds, max(n) AS n, regr_slope(trend, idx) AS slope, regr_intercept(trend, idx) AS intercept,
  stddev_pop(residual) AS sigma, greatest(0, 1 - var_pop(residual) / var_pop(residual + seasonal)) AS strength FROM parts GROUP BY 1),
sg AS (SELECT *, CAST(unnest(range(1, 15)) AS INTEGER) AS step FROM sf)"""


@query("m4_stl_classical", i.with_sql(i.REGION, STL_SQL) + """SELECT g.series_id, step, CAST(last_ds + step AS DATE) AS ds, round(greatest(v, 0), 3) AS yhat,
  round(greatest(v - 1.96 * sigma * sqrt(step), 0), 3) AS lower_ci, round(v + 1.96 * sigma * sqrt(step), 3) AS upper_ci FROM (
  SELECT g.*, intercept + slope * (n + step - 1) + seasonal AS v FROM sg g JOIN seasons e ON g.series_id = e.series_id AND e.phase = (n - 7 + (step - 1) % 7) % 7) g""")
def m4(spark: SparkSession, folder: str) -> DataFrame:
    model = STL()
    return rounded(model.forecast(model.fit(region_panel(spark, folder)), 14), 3, *BAND)


@query("m4_stl_robust")
def m4_robust(spark: SparkSession, folder: str) -> DataFrame:
    model = STL(robust=True)
    return model.forecast(model.fit(region_panel(spark, folder)), 14)


@query("m14_naive", i.with_sql(i.BRAND, *ms.naive("brand_panel", 7)) + """SELECT series_id, step, ds, round(yhat, 4) AS yhat,
  round(lower_ci, 4) AS lower_ci, round(upper_ci, 4) AS upper_ci FROM naive_forecast""")
def m14(spark: SparkSession, folder: str) -> DataFrame:
    model = Naive()
    panel = brand_panel(spark, folder).select("series_id", "ds", "y")
    return rounded(model.forecast(model.fit(panel), 7), 4, *BAND)


WEIGHTS = """metrics AS (SELECT series_id, model, avg(mae) AS mae FROM (SELECT * FROM wma_folds UNION ALL SELECT * FROM naive_folds) GROUP BY 1, 2 HAVING count(*) >= 2),
weights AS (SELECT series_id, model, 1 / (mae + 0.001) / sum(1 / (mae + 0.001)) OVER (PARTITION BY series_id) AS weight FROM metrics)"""


@query("m15_ensemble", i.with_sql(*ms.CV_PARTS, WEIGHTS, *ms.wma("region_panel", 7, name="final_wma"), *ms.naive("region_panel", 7, name="final_naive"),
  """members AS (SELECT 'wma' AS model, series_id, ds, yhat, lower_ci, upper_ci FROM final_wma_forecast
  UNION ALL SELECT 'naive', series_id, ds, yhat, lower_ci, upper_ci FROM final_naive_forecast)""") + """
  SELECT m.series_id, ds, round(sum(yhat * weight) / sum(weight), 4) AS yhat, round(min(lower_ci), 4) AS lower_ci, round(max(upper_ci), 4) AS upper_ci,
  'ensemble' AS model FROM members m JOIN weights w ON m.series_id = w.series_id AND m.model = w.model GROUP BY 1, 2""")
def m15(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.ranking import union_all

    panel = i.regions(spark, folder)
    models = [WMA(), Naive()]
    folds = union_all([evaluate.cross_validate(panel, m) for m in models])
    weights = evaluate.inverse_error_weights(evaluate.fold_summary(folds).select("series_id", "model", "mae"))
    members = union_all([m.forecast(m.fit(panel), 7).withColumn("model", F.lit(m.name)) for m in models])
    return rounded(evaluate.combine_forecasts(members, weights), 4, *BAND)


@query("m16_combine", i.with_sql(i.REGION, *ms.wma("region_panel", 7), *ms.naive("region_panel", 10), """members AS (
  SELECT 'wma' AS model, 3.0::DOUBLE AS w, series_id, ds, yhat, lower_ci, upper_ci FROM wma_forecast
  UNION ALL SELECT 'naive', 1.0, series_id, ds, yhat, lower_ci, upper_ci FROM naive_forecast)""") + """
  SELECT series_id, ds, round(sum(yhat * w) / sum(w), 4) AS yhat, round(min(lower_ci), 4) AS lower_ci, round(max(upper_ci), 4) AS upper_ci,
  'ensemble' AS model FROM members GROUP BY 1, 2""")
def m16(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.ranking import union_all

    panel = i.regions(spark, folder)
    members = union_all([
        m.forecast(m.fit(panel), h).withColumn("model", F.lit(m.name)) for m, h in ((WMA(), 7), (Naive(), 10))
    ])
    shares = F.explode(F.array(F.struct(F.lit("wma").alias("model"), F.lit(3.0).alias("weight")),
                               F.struct(F.lit("naive").alias("model"), F.lit(1.0).alias("weight"))))
    weights = panel.select("series_id").distinct().select("series_id", shares.alias("s")).select("series_id", "s.*")
    return rounded(evaluate.combine_forecasts(members, weights), 4, *BAND)


@query("m17_baseline_uplift", i.with_sql(i.REGION, i.HOLIDAYS, *ms.wma("region_panel", 30, "holiday_multiplier")) + """SELECT 'wma' AS model, series_id, step, ds,
  round(yhat, 4) AS yhat, round(lower_ci, 4) AS lower_ci, round(upper_ci, 4) AS upper_ci, round(baseline, 4) AS baseline,
  round((yhat - baseline) / abs(baseline) * 100, 9) AS uplift FROM wma_forecast""")
def m17(spark: SparkSession, folder: str) -> DataFrame:
    model = WMA()
    out = with_baseline(model, model.fit(i.regions(spark, folder)), 30, "D", {"holidays": ms.shifted_holidays(spark, folder)})
    return rounded(rounded(out, 4, *BAND, "baseline"), 9, "uplift")


@query("m19_wma_components", i.with_sql(i.REGION, *ms.wma("region_panel", 1)) + """SELECT f.series_id, round(wma, 4) AS wma, round(mean, 4) AS mean,
  CAST(d.dow AS INTEGER) AS dow, round(factor, 8) AS factor FROM wma_fit f JOIN wma_dow d ON f.series_id = d.series_id""")
def m19(spark: SparkSession, folder: str) -> DataFrame:
    model = WMA()
    out = model.components(model.fit(region_panel(spark, folder)))
    return rounded(rounded(out, 4, "wma", "mean"), 8, "factor")


@query("m19_stl_components", i.with_sql(i.REGION, STL_SQL) + """SELECT series_id, round(slope, 6) AS trend_slope, round(strength, 8) AS seasonal_strength,
  round(sigma, 4) AS residual_std FROM sf""")
def m19_stl(spark: SparkSession, folder: str) -> DataFrame:
    model = STL()
    out = model.components(model.fit(region_panel(spark, folder)))
    return rounded(rounded(rounded(out, 6, "trend_slope"), 8, "seasonal_strength"), 4, "residual_std")


# --- attribute groups -------------------------------------------------------------------

START = "DATE '2001-06-04'"
START_DAY = "2001-06-04"
TODAY = {"D": "CAST(DATE '2001-06-04' + step AS DATE)", "W": "CAST(DATE '2001-06-04' + 7 * step AS DATE)",
         "M": "CAST(DATE '2001-06-01' + to_months(step) AS DATE)"}
WEEK = "CAST(date_trunc('week', {}) AS DATE)"
WOM = "(date_diff('day', CAST(date_trunc('week', date_trunc('month', {0})) AS DATE), CAST(date_trunc('week', {0}) AS DATE)) / 7 + 1)"


def group_sql(freq: str, periods: int, lookback: str = "{n}") -> list[str]:
    """CTEs ending in ``base_<freq>`` and ``fallback_<freq>``: series_id, ds, wma, median."""
    n = {"D": 8, "W": 6, "M": 5}[freq]
    fall = {"D": 14, "W": 6, "M": 6}[freq]
    period = {"D": "ds", "W": WEEK.format("ds"), "M": "CAST(date_trunc('month', ds) AS DATE)"}[freq]
    slot = {"D": "isodow({})", "W": WOM, "M": "month({})"}[freq]
    return [
        f"hist_{freq} AS (SELECT series_id, {period} AS period, sum(y) AS y FROM brand_panel GROUP BY 1, 2)",
        f"""goal_{freq} AS (SELECT series_id, {TODAY[freq]} AS ds FROM (SELECT series_id, CAST(unnest(range({periods})) AS INTEGER) AS step
          FROM (SELECT DISTINCT series_id FROM brand_panel)))""",
        f"""match_{freq} AS (SELECT g.series_id, g.ds, h.y, row_number() OVER (PARTITION BY g.series_id, g.ds ORDER BY h.period DESC) AS age
          FROM goal_{freq} g JOIN hist_{freq} h ON g.series_id = h.series_id AND h.period < g.ds AND {slot.format('h.period')} = {slot.format('g.ds')})""",
        f"""base_{freq} AS (SELECT series_id, ds, sum(y * (n + 1 - age)) / sum(n + 1 - age) AS wma, median(y) AS median FROM (
          SELECT *, count(*) OVER (PARTITION BY series_id, ds) AS n FROM match_{freq} WHERE age <= {lookback.format(n=n)}) GROUP BY 1, 2)""",
        f"""fallback_{freq} AS (SELECT series_id, avg(y) AS fallback FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period DESC) AS age
          FROM hist_{freq}) WHERE age <= {fall} GROUP BY 1)""",
    ]


PERIODS_AHEAD = {"D": 14, "W": 8, "M": 6}


def _baseline(freq: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        sales = i.brands(spark, folder)
        keys = ["series_id"]
        wanted = gw.targets(sales, keys, START_DAY, PERIODS_AHEAD[freq], freq)
        out = {}
        for method in ("wma", "median"):
            settings = gw.resolve_settings(sales, None, keys, freq, method)
            base = gw.matched_baseline(sales, wanted, settings, keys, freq)
            out[method] = base.withColumn(method, F.round("base", 6)).drop("base")
        return out["wma"].join(out["median"], ["series_id", "ds"])

    return run


for _id, _freq, _name in (("m23", "D", "daily"), ("m24", "W", "weekly"), ("m25", "M", "monthly")):
    query(f"{_id}_baseline_{_name}", i.with_sql(i.BRAND, *group_sql(_freq, PERIODS_AHEAD[_freq])) +
          f"SELECT series_id, ds, round(wma, 6) AS wma, round(median, 6) AS median FROM base_{_freq}")(_baseline(_freq))


TREND = "trend AS (WITH means AS (" + " UNION ALL ".join(
    f"SELECT series_id, '{u}' AS unit, date_trunc('{u}', ds) AS period, avg(y) AS m FROM brand_panel GROUP BY 1, 3" for u in ("week", "month", "year")) + """),
  aged AS (SELECT *, row_number() OVER (PARTITION BY series_id, unit ORDER BY period DESC) AS age FROM means)
  SELECT series_id, 1 + coalesce(avg(change), 0) AS trend_factor FROM (SELECT series_id, unit,
    (max(CASE WHEN age = 1 THEN m END) - max(CASE WHEN age = 2 THEN m END)) / nullif(max(CASE WHEN age = 2 THEN m END), 0) AS change
    FROM aged WHERE age <= 2 GROUP BY 1, 2) GROUP BY 1)"""


@query("m26_trend_factor", i.with_sql(i.BRAND, TREND) + "SELECT series_id, round(trend_factor, 8) AS trend_factor FROM trend")
def m26(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(gw.trend_factor(brand_panel(spark, folder), ["series_id"]), 8, "trend_factor")


def lookback_config(spark: SparkSession, folder: str) -> DataFrame:
    """Settings by type and by (type, brand), derived from the part table."""
    from ..sources.tables import scan

    part = scan(spark, folder, "part")
    kinds = part.filter(F.col("p_type") != "PROMO").groupBy(F.col("p_type").alias("category")).agg(
        (F.min("p_size") + 3).alias("D"), F.lit("median").alias("method"))
    pairs = part.filter(F.col("p_size") >= 49).groupBy(F.col("p_type").alias("category"), F.col("p_brand").alias("brand")).agg(
        (F.max("p_size") - 40).alias("D"), F.lit("wma").alias("method"))
    both = kinds.withColumn("brand", F.lit(None).cast("string")).unionByName(pairs)
    return both.withColumns({"W": F.col("D"), "M": F.col("D")})


CONFIG = """kinds AS (SELECT p_type AS category, min(p_size) + 3 AS n FROM part WHERE p_type <> 'PROMO' GROUP BY 1),
pairs AS (SELECT p_type AS category, p_brand AS brand, max(p_size) - 40 AS n FROM part WHERE p_size >= 49 GROUP BY 1, 2),
settings AS (SELECT g.category, g.brand, CAST(coalesce(p.n, k.n, 8) AS INTEGER) AS lookback,
  CASE WHEN p.n IS NOT NULL THEN 'wma' WHEN k.n IS NOT NULL THEN 'median' ELSE 'wma' END AS method
  FROM (SELECT DISTINCT category, brand FROM product_sales) g LEFT JOIN pairs p ON p.category = g.category AND p.brand = g.brand
  LEFT JOIN kinds k ON k.category = g.category)"""


def product_sales(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.tables import brand_sales

    return brand_sales(spark, folder).select(
        "category", "brand", "ds", "y", "promo_flag", (F.col("discount_sum") / F.col("lines")).alias("discount"))


@query("m27_lookback", i.with_sql(i.PRODUCT, CONFIG) + "SELECT category, brand, lookback, method FROM settings")
def m27(spark: SparkSession, folder: str) -> DataFrame:
    return gw.resolve_settings(product_sales(spark, folder), lookback_config(spark, folder), ["category", "brand"], "D")


@query("m28_fallback", i.with_sql(i.BRAND, *(c for f in "DWM" for c in group_sql(f, 1))) + """SELECT d.series_id, round(d.fallback, 6) AS daily,
  round(w.fallback, 6) AS weekly, round(m.fallback, 6) AS monthly FROM "fallback_D" d JOIN "fallback_W" w ON d.series_id = w.series_id
  JOIN "fallback_M" m ON d.series_id = m.series_id""")
def m28(spark: SparkSession, folder: str) -> DataFrame:
    sales = i.brands(spark, folder)
    parts = [
        gw.fallback_base(sales, ["series_id"], f).select("series_id", F.round("fallback", 6).alias(name))
        for f, name in (("D", "daily"), ("W", "weekly"), ("M", "monthly"))
    ]
    return parts[0].join(parts[1], "series_id").join(parts[2], "series_id")


def _group_forecast(freq: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        model = gw.GroupForecaster(freq=freq)
        marked = es.intervals(spark, folder)
        out = model.forecast(
            i.brands(spark, folder), START_DAY, PERIODS_AHEAD[freq], events=marked, future_events=marked,
            plan=plan(spark, folder).select("series_id", "ds", "no", "discount", "note", "promo_flag"),
        )
        out = out.select("series_id", "ds", "yhat", "trend_factor", "promo_flag", "discount", "event_name")
        return rounded(rounded(out, 4, "yhat"), 8, "trend_factor")

    return run


for _freq, _name in (("D", "daily"), ("W", "weekly"), ("M", "monthly")):
    query(f"m29_group_forecast_{_name}", i.with_sql(i.BRAND, *group_sql(_freq, PERIODS_AHEAD[_freq]), TREND, PLAN, es.INTERVALS, DAILY_EVENTS, LIFTS, EVENT_LIFTS) + f"""
      SELECT g.series_id, g.ds, round(greatest(0, coalesce(wma, fallback) * trend_factor * CASE WHEN p.promo_flag <> 0 THEN promo_lift ELSE 1 END
        * CASE WHEN p.discount <> 0 THEN 1 + discount_beta * p.discount ELSE 1 END * coalesce(event_lift, 1)), 4) AS yhat,
        round(trend_factor, 8) AS trend_factor, coalesce(p.promo_flag, 0) AS promo_flag, coalesce(p.discount, 0) AS discount, e.event_name
      FROM "goal_{_freq}" g LEFT JOIN "base_{_freq}" b ON g.series_id = b.series_id AND g.ds = b.ds JOIN "fallback_{_freq}" f ON g.series_id = f.series_id
      JOIN trend t ON g.series_id = t.series_id JOIN lifts l ON g.series_id = l.series_id LEFT JOIN first_plan p ON g.series_id = p.series_id AND g.ds = p.ds
      LEFT JOIN one_event e ON e.series_id = g.series_id AND e.ds = g.ds LEFT JOIN event_lifts v ON v.series_id = g.series_id AND v.event_name = e.event_name""")(_group_forecast(_freq))


@query("m31_segment_methods", i.with_sql(i.PRODUCT, CONFIG, """goal AS (SELECT category, brand, lookback, method, CAST(DATE '2001-06-04' + step AS DATE) AS ds
    FROM (SELECT *, CAST(unnest(range(7)) AS INTEGER) AS step FROM settings)),
  matched AS (SELECT g.*, h.y, row_number() OVER (PARTITION BY g.category, g.brand, g.ds ORDER BY h.ds DESC) AS age FROM goal g JOIN product_sales h
    ON g.category = h.category AND g.brand = h.brand AND h.ds < g.ds AND isodow(h.ds) = isodow(g.ds))""") + """
  SELECT category, brand, ds, round(CASE WHEN max(method) = 'median' THEN median(y) ELSE sum(y * (n + 1 - age)) / sum(n + 1 - age) END, 6) AS base FROM (
    SELECT *, count(*) OVER (PARTITION BY category, brand, ds) AS n FROM matched WHERE age <= lookback) GROUP BY 1, 2, 3""")
def m31(spark: SparkSession, folder: str) -> DataFrame:
    sales, keys = product_sales(spark, folder), ["category", "brand"]
    settings = gw.resolve_settings(sales, lookback_config(spark, folder), keys, "D")
    wanted = gw.targets(sales, keys, START_DAY, 7, "D")
    return rounded(gw.matched_baseline(sales, wanted, settings, keys, "D"), 6, "base")
