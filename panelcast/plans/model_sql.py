"""SQL forms of the closed-form forecasters, used to check the Spark ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inputs as i


def wma(panel: str, horizon: int, multiplier: str | None = None, name: str = "wma", window: int = 8) -> list[str]:
    """CTEs ending in ``<name>_forecast``: series_id, step, ds, yhat, bounds, baseline.

    ``multiplier`` names a table with ds and multiplier; it is defined here for the
    built-in ones.
    """
    parts = []
    if multiplier == "holiday_multiplier":
        parts.append("""holiday_multiplier AS (
          SELECT CAST(ds + 30 AS DATE) AS ds, product(holiday_impact) AS multiplier FROM holidays GROUP BY 1)""")
    mult = "coalesce(m.multiplier, 1.0)" if multiplier else "1.0"
    join = f"LEFT JOIN {multiplier} m ON m.ds = g.ds" if multiplier else ""
    return parts + [
        f"""{name}_aged AS (SELECT *, isodow(ds) - 1 AS dow,
          row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS age,
          count(*) OVER (PARTITION BY series_id) AS n FROM {panel})""",
        f"""{name}_fit AS (SELECT series_id, max(ds) AS last_ds, max(n) AS n, avg(y) AS mean,
          sum(CASE WHEN age <= {window} THEN y * (least(n, {window}) + 1 - age) END)
            / max(least(n, {window}) * (least(n, {window}) + 1) / 2) AS wma FROM {name}_aged GROUP BY 1)""",
        f"""{name}_dow AS (SELECT a.series_id, dow, avg(y) / max(mean) AS factor FROM {name}_aged a
          JOIN {name}_fit f ON a.series_id = f.series_id WHERE f.n >= 14 AND mean <> 0 GROUP BY 1, 2)""",
        f"""{name}_grid AS (SELECT series_id, wma, step, CAST(last_ds + step AS DATE) AS ds
          FROM (SELECT *, CAST(unnest(range(1, {horizon} + 1)) AS INTEGER) AS step FROM {name}_fit))""",
        f"""{name}_forecast AS (SELECT g.series_id, step, g.ds,
          greatest(wma * coalesce(factor, 1.0) * {mult}, 0) AS yhat,
          greatest(wma * coalesce(factor, 1.0) * {mult} * 0.85, 0) AS lower_ci,
          wma * coalesce(factor, 1.0) * {mult} * 1.15 AS upper_ci,
          greatest(wma * coalesce(factor, 1.0), 0) AS baseline
          FROM {name}_grid g LEFT JOIN {name}_dow d ON d.series_id = g.series_id AND d.dow = isodow(g.ds) - 1 {join})""",
    ]


def naive(panel: str, horizon: int, name: str = "naive") -> list[str]:
    return [
        f"""{name}_forecast AS (SELECT series_id, step, CAST(last_ds + step AS DATE) AS ds, last_y AS yhat,
          last_y * 0.8 AS lower_ci, last_y * 1.2 AS upper_ci FROM (
            SELECT *, CAST(unnest(range(1, {horizon} + 1)) AS INTEGER) AS step FROM (
              SELECT series_id, max(ds) AS last_ds, arg_max(y, ds) AS last_y FROM {panel} GROUP BY 1)))"""
    ]


def shifted_holidays(spark: SparkSession, folder: str) -> DataFrame:
    """Holiday rows moved 30 days on, so that some fall after the last sales date."""
    return i.holidays(spark, folder).withColumn("ds", F.date_add("ds", 30))


def cv_rows(panel: str, horizon: int = 7, folds: int = 5) -> list[str]:
    least = max(2 * horizon, 14)
    return [
        f"""cv_sized AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS idx,
          count(*) OVER (PARTITION BY series_id) AS n FROM {panel})""",
        f"""cv_test AS (SELECT *, least({horizon}, greatest(1, (n - {least}) // {folds + 1})) AS size
          FROM cv_sized WHERE n >= {least})""",
        f"""cv_all AS (SELECT c.series_id, c.ds, c.y, f.fold, idx,
          {least} + f.fold * size AS train_end, size, n FROM cv_test c CROSS JOIN range({folds}) f(fold)
          WHERE {least} + (f.fold + 1) * size <= n)""",
        """cv_train AS (SELECT series_id || '#' || fold AS series_id, ds, y FROM cv_all WHERE idx < train_end)""",
        """cv_hold AS (SELECT series_id || '#' || fold AS key, series_id, fold, ds, y, idx - train_end + 1 AS step
          FROM cv_all WHERE idx >= train_end AND idx < train_end + size)""",
    ]


def fold_metrics(forecast: str, model: str) -> str:
    return f"""{model}_folds AS (SELECT h.series_id, h.fold, '{model}' AS model, avg(abs(yhat - y)) AS mae,
      sqrt(avg((yhat - y) * (yhat - y))) AS rmse,
      avg(least(abs(yhat - y) / greatest(abs(y), 1e-9) * 100, 1000)) AS mape,
      CASE WHEN var_pop(y) * count(*) > 1e-9 THEN 1 - sum((yhat - y) * (yhat - y)) / (var_pop(y) * count(*)) END AS r2,
      count(*) AS rows
      FROM cv_hold h JOIN {forecast} f ON f.series_id = h.key AND f.step = h.step GROUP BY 1, 2)"""


CV_PARTS = [
    i.REGION, *cv_rows("region_panel"), *wma("cv_train", 7), *naive("cv_train", 7),
    fold_metrics("wma_forecast", "wma"), fold_metrics("naive_forecast", "naive"),
]

GRADE = """CASE WHEN {a} >= 90 THEN 'Excellent' WHEN {a} >= 80 THEN 'Good' WHEN {a} >= 70 THEN 'Fair'
  WHEN {a} >= 60 THEN 'Marginal' WHEN {a} IS NOT NULL THEN 'Poor' END"""

CV_RANK_SQL = i.with_sql(*CV_PARTS, """cv_mean AS (SELECT series_id, model, avg(mae) AS mae, avg(mape) AS mape
  FROM (SELECT * FROM wma_folds UNION ALL SELECT * FROM naive_folds) GROUP BY 1, 2 HAVING count(*) >= 2
  UNION ALL SELECT DISTINCT series_id, 'absent', NULL, NULL FROM region_panel)""",
  """cv_acc AS (SELECT *, CASE WHEN mape IS NOT NULL THEN greatest(least(100 - mape, 100), 0) END AS acc FROM cv_mean)""") + f"""
  SELECT series_id, model, CAST(row_number() OVER (PARTITION BY series_id ORDER BY mae NULLS LAST, model) AS INTEGER) AS rank,
  round(mae, 4) AS mae, round(1 / (mae + 1), 9) AS score, round(acc, 6) AS accuracy, {GRADE.format(a='acc')} AS grade
  FROM cv_acc"""
