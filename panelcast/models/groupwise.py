"""Attribute-group forecaster: calendar-matched baselines x trend x empirical lifts.

The sales table has one row per group and day. All groups and target dates are handled
by equi-joins on (group, calendar slot); a slot keeps only its newest rows per target.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import horizon_date, period_start, week_of_month
from ..functions.scalars import rank_weight, ratio
from ..operators import events as ev
from ..operators.enrich import attach_events, first_match
from ..store import materialize

# Look-back and fallback lengths per frequency.
LOOKBACK = {"D": 8, "W": 6, "M": 5}
FALLBACK = {"D": 14, "W": 6, "M": 6}


def targets(sales: DataFrame, keys: Sequence[str], start: str | Column, periods: int, freq: str,
            week_day: str = "MON") -> DataFrame:
    """Every group with its planned dates."""
    first = F.lit(start).cast("date") if isinstance(start, str) else start
    step = F.explode(F.sequence(F.lit(0), F.lit(periods - 1)))
    return sales.select(*keys).distinct().select(*keys, step.alias("step")).withColumn(
        "ds", horizon_date(first, F.col("step"), freq, week_day)
    )


def explicit_targets(sales: DataFrame, keys: Sequence[str], dates: Sequence[str]) -> DataFrame:
    listed = F.explode(F.array(*[F.lit(d).cast("date") for d in dates]))
    return sales.select(*keys).distinct().select(*keys, listed.alias("ds"))


def resolve_settings(groups: DataFrame, config: DataFrame | None, keys: Sequence[str], freq: str,
                     method: str = "wma") -> DataFrame:
    """Look-back length and method per group from the longest matching key prefix.

    ``config`` has the key columns (null beyond the prefix), ``D, W, M`` and ``method``.
    Without a match the defaults apply.
    """
    out = groups.select(*keys).distinct()
    found: list[Column] = []
    methods: list[Column] = []
    if config is not None:
        for length in range(len(keys), 0, -1):
            level = config
            for i, k in enumerate(keys):
                level = level.filter(F.col(k).isNotNull() if i < length else F.col(k).isNull())
            prefix = list(keys[:length])
            level = level.groupBy(*prefix).agg(
                F.max(freq).alias(f"__n{length}"), F.max("method").alias(f"__m{length}")
            )
            out = out.join(level, prefix, "left")
            found.append(F.col(f"__n{length}"))
            methods.append(F.col(f"__m{length}"))
    return out.select(
        *keys, F.coalesce(*found, F.lit(LOOKBACK[freq])).cast("int").alias("lookback"),
        F.coalesce(*methods, F.lit(method)).alias("method"),
    )


def _history(sales: DataFrame, keys: Sequence[str], freq: str, week_day: str) -> DataFrame:
    """Daily rows, or weekly / monthly totals, with their calendar slot."""
    if freq == "D":
        return sales.select(*keys, F.col("ds").alias("period"), "y", F.weekday("ds").alias("slot"))
    period = period_start("ds", freq, week_day)
    totals = sales.groupBy(*keys, period.alias("period")).agg(F.sum("y").alias("y"))
    slot = week_of_month("period", week_day) if freq == "W" else F.month("period")
    return totals.withColumn("slot", slot)


def _target_slot(freq: str, week_day: str) -> Column:
    if freq == "D":
        return F.weekday("ds")
    return week_of_month("ds", week_day) if freq == "W" else F.month("ds")


def matched_baseline(sales: DataFrame, wanted: DataFrame, settings: DataFrame, keys: Sequence[str],
                     freq: str, week_day: str = "MON") -> DataFrame:
    """Average of the newest look-back rows before each target in the same slot.

    Daily: same weekday. Weekly: weekly totals of the same week of the month.
    Monthly: totals of the same calendar month. ``base`` is null without such rows.
    """
    keys = list(keys)
    history = _history(sales, keys, freq, week_day)
    begin = ds_period = period_start("ds", freq, week_day)
    goals = wanted.select(*keys, "ds", ds_period.alias("limit"), _target_slot(freq, week_day).alias("slot"))
    goals = goals.join(settings, keys)
    # rows older than the newest look-back ones before the first target can never count
    first_goal = goals.groupBy(*keys, "slot").agg(
        F.min("limit").alias("first_limit"), F.max("limit").alias("last_limit"), F.max("lookback").alias("most")
    )
    near = history.join(first_goal, [*keys, "slot"]).filter(F.col("period") < F.col("last_limit"))
    old = F.col("period") < F.col("first_limit")
    newest = Window.partitionBy(*keys, "slot", old).orderBy(F.desc("period"))
    kept = near.withColumn("age", F.row_number().over(newest)).filter(~old | (F.col("age") <= F.col("most")))
    pairs = goals.join(kept.select(*keys, "slot", "period", "y"), [*keys, "slot"]).filter(
        F.col("period") < F.col("limit")
    )
    per_target = Window.partitionBy(*keys, "ds")
    aged = pairs.withColumn("age", F.row_number().over(per_target.orderBy(F.desc("period")))).filter(
        F.col("age") <= F.col("lookback")
    )
    ranked = aged.withColumn("n", F.count(F.lit(1)).over(per_target)).withColumn("rank", F.col("n") - F.col("age") + 1)
    averages = ranked.groupBy(*keys, "ds").agg(
        F.max("method").alias("method"),
        F.sum(F.col("y") * rank_weight("rank", "n")).alias("wma"),
        F.median("y").alias("median"),
    )
    base = F.when(F.col("method") == "median", F.col("median")).otherwise(F.col("wma"))
    return averages.select(*keys, "ds", base.alias("base"))


def fallback_base(sales: DataFrame, keys: Sequence[str], freq: str, week_day: str = "MON") -> DataFrame:
    """Mean of the last 14 days, 6 weekly totals or 6 monthly totals of each group."""
    history = _history(sales, keys, freq, week_day)
    newest = Window.partitionBy(*keys).orderBy(F.desc("period"))
    tail = history.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= FALLBACK[freq])
    return tail.groupBy(*keys).agg(F.avg("y").alias("fallback"))


def trend_factor(sales: DataFrame, keys: Sequence[str], week_day: str = "MON") -> DataFrame:
    """1 + mean relative change of the last week, month and year against the one before.

    The three period means come from one group-by over an exploded label.
    """
    labels = F.explode(F.array(*[
        F.struct(F.lit(unit).alias("unit"), label.alias("period"))
        for unit, label in [("W", period_start("ds", "W", week_day)), ("M", F.trunc("ds", "MONTH")), ("Y", F.trunc("ds", "YEAR"))]
    ]))
    means = sales.select(*keys, "y", labels.alias("p")).groupBy(*keys, "p.unit", "p.period").agg(F.avg("y").alias("m"))
    newest = Window.partitionBy(*keys, "unit").orderBy(F.desc("period"))
    last_two = means.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= 2)
    change = last_two.groupBy(*keys, "unit").agg(
        ratio(F.max(F.when(F.col("age") == 1, F.col("m"))) - F.max(F.when(F.col("age") == 2, F.col("m"))),
              F.max(F.when(F.col("age") == 2, F.col("m")))).alias("change")
    )
    return change.groupBy(*keys).agg((1 + F.coalesce(F.avg("change"), F.lit(0.0))).alias("trend_factor"))


@dataclass(frozen=True)
class GroupForecaster:
    """Baseline x trend x lift for every attribute group."""

    keys: tuple[str, ...] = ("series_id",)
    freq: str = "D"
    method: str = "wma"
    week_day: str = "MON"
    use_trend: bool = True
    use_promotions: bool = True
    use_events: bool = True
    event_lag_days: int = 0

    def forecast(self, sales: DataFrame, start: str | Column | None = None, periods: int = 7,
                 events: DataFrame | None = None, plan: DataFrame | None = None,
                 future_events: DataFrame | None = None, config: DataFrame | None = None,
                 dates: Sequence[str] | None = None) -> DataFrame:
        keys = list(self.keys)
        sales = materialize(sales)  # one row per group and day, used by every part below
        if dates is not None:
            wanted = explicit_targets(sales, keys, dates)
        else:
            wanted = targets(sales, keys, start, periods, self.freq, self.week_day).drop("step")
        settings = resolve_settings(sales, config, keys, self.freq, self.method)
        base = matched_baseline(sales, wanted, settings, keys, self.freq, self.week_day)
        out = wanted.join(base, [*keys, "ds"], "left").join(
            fallback_base(sales, keys, self.freq, self.week_day), keys, "left"
        )
        out = out.withColumn("base", F.coalesce("base", "fallback", F.lit(0.0)))
        if self.use_trend:
            out = out.join(trend_factor(sales, keys, self.week_day), keys, "left")
        else:
            out = out.withColumn("trend_factor", F.lit(1.0))
        history = sales
        if events is not None:
            history = attach_events(sales, ev.explode_intervals(events, keys, self.event_lag_days), keys)
        else:
            history = sales.withColumn("event_name", F.lit(None).cast("string"))
        out = out.join(ev.promo_lifts(history, keys), keys, "left")
        if plan is not None:
            order = [c for c in plan.columns if c not in (*keys, "ds")]
            first = first_match(plan, [*keys, "ds"], order).select(*keys, "ds", "promo_flag", "discount")
            out = out.join(first, [*keys, "ds"], "left").fillna({"promo_flag": 0, "discount": 0.0})
        else:
            out = out.withColumns({"promo_flag": F.lit(0), "discount": F.lit(0.0)})
        if future_events is not None:
            out = attach_events(out, ev.explode_intervals(future_events, keys, self.event_lag_days), keys)
        else:
            out = out.withColumn("event_name", F.lit(None).cast("string"))
        out = out.join(ev.event_lifts(history, keys), [*keys, "event_name"], "left")
        lift = ev.combined_lift(
            F.col("promo_flag") if self.use_promotions else F.lit(0),
            F.col("discount") if self.use_promotions else F.lit(0.0),
            F.col("event_lift") if self.use_events else F.lit(1.0),
        )
        value = F.greatest(F.lit(0.0), F.col("base") * F.col("trend_factor") * lift)
        return out.select(*keys, "ds", value.alias("yhat"), "base", "trend_factor", "promo_flag", "discount", "event_name")
