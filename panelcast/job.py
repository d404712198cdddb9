"""Batch job: forecast attribute groups from files.

    spark-submit -m panelcast.job --sales sales.csv --attributes region,store,item \\
        --freq D --start 2025-01-01 --periods 14 --output out/
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models.groupwise import GroupForecaster
from .operators.normalize import parse_date
from .session import build_session


def load(spark: SparkSession, path: str, dates: Sequence[str]) -> DataFrame:
    """CSV or Parquet; the named date columns are parsed, all else keeps its type.

    CSV columns are read as text, so no second pass over the data infers types.
    """
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    return df.withColumns({d: parse_date(df, d) for d in dates if d in df.columns})


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description="Forecast attribute groups")
    out.add_argument("--sales", required=True)
    out.add_argument("--events")
    out.add_argument("--future-plan")
    out.add_argument("--future-events")
    out.add_argument("--attributes", default="")
    out.add_argument("--date-column", default="date")
    out.add_argument("--target-column", default="sales")
    out.add_argument("--promo-column", default="promo_flag")
    out.add_argument("--discount-column", default="discount")
    out.add_argument("--method", choices=["wma", "median"], default="wma")
    out.add_argument("--freq", choices=["D", "W", "M"], default="D")
    out.add_argument("--week-start", default="MON")
    out.add_argument("--lookback", help='JSON list, e.g. [{"region": "north", "D": 6, "W": 4, "M": 3, "method": "median"}]')
    out.add_argument("--start")
    out.add_argument("--periods", type=int, default=14)
    out.add_argument("--dates", help="comma-separated dates instead of start and periods")
    out.add_argument("--event-lag-days", type=int, default=0)
    out.add_argument("--no-trend", action="store_true")
    out.add_argument("--no-promotions", action="store_true")
    out.add_argument("--no-events", action="store_true")
    out.add_argument("--output", required=True)
    out.add_argument("--format", choices=["csv", "parquet"], default="csv")
    return out


def forecast(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    keys = [a.strip() for a in args.attributes.split(",") if a.strip()]
    raw = load(spark, args.sales, [args.date_column])
    if not keys:
        raw, keys = raw.withColumn("series_id", F.lit("(all)")), ["series_id"]

    def number(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.col(name).try_cast("double") if name in df.columns else F.lit(0.0))

    raw = number(number(raw, args.promo_column), args.discount_column)
    # one row per group and day: repeated rows are added up before anything else
    sales = raw.groupBy(*keys, F.col(args.date_column).alias("ds")).agg(
        F.sum(F.col(args.target_column).try_cast("double")).alias("y"),
        F.max(args.promo_column).cast("int").alias("promo_flag"), F.avg(args.discount_column).alias("discount"),
    ).filter(F.col("ds").isNotNull())
    plan = None
    if args.future_plan:
        rows = load(spark, args.future_plan, [args.date_column])
        rows = number(number(rows, args.promo_column), args.discount_column)
        plan = rows.select(*keys, F.col(args.date_column).alias("ds"), F.col(args.promo_column).cast("int").alias("promo_flag"),
                           F.col(args.discount_column).alias("discount"))
    intervals = [load(spark, p, ["start_date", "end_date"]) if p else None for p in (args.events, args.future_events)]
    config = None
    if args.lookback:
        columns = [*keys, "D", "W", "M", "method"]
        listed = [tuple(entry.get(c) for c in columns) for entry in json.loads(args.lookback)]
        schema = ", ".join([*[f"{k} string" for k in keys], "D int", "W int", "M int", "method string"])
        config = spark.createDataFrame(listed, schema)
    model = GroupForecaster(
        tuple(keys), args.freq, args.method, args.week_start, not args.no_trend, not args.no_promotions, not args.no_events,
        args.event_lag_days,
    )
    dates = args.dates.split(",") if args.dates else None
    return model.forecast(sales, args.start, args.periods, intervals[0], plan, intervals[1], config, dates)


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if not args.dates and not args.start:
        raise SystemExit("either --start or --dates is needed")
    rows = forecast(build_session("panelcast-job"), args)
    writer = rows.write.mode("overwrite")
    writer.csv(args.output, header=True) if args.format == "csv" else writer.parquet(args.output)


if __name__ == "__main__":
    main()
