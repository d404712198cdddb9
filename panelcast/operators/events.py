"""Event calendars, event impact on sales, and promotion / event lifts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.dates import nth_weekday, orthodox_easter, western_easter
from ..functions.scalars import clamp, correlation, impact_pct, ratio, strength_label
from .enrich import window_means
from .ranking import union_by_priority, union_distinct

# First days of lunar festivals, 2020 to 2035.
CHINESE_NEW_YEAR = {
    2020: "2020-01-25", 2021: "2021-02-12", 2022: "2022-02-01", 2023: "2023-01-22", 2024: "2024-02-10", 2025: "2025-01-29",
    2026: "2026-02-17", 2027: "2027-02-06", 2028: "2028-01-26", 2029: "2029-02-13", 2030: "2030-02-03", 2031: "2031-01-23",
    2032: "2032-02-11", 2033: "2033-01-31", 2034: "2034-02-19", 2035: "2035-02-08",
}
DIWALI = {
    2020: "2020-11-14", 2021: "2021-11-04", 2022: "2022-10-24", 2023: "2023-11-12", 2024: "2024-10-31", 2025: "2025-10-20",
    2026: "2026-11-08", 2027: "2027-10-29", 2028: "2028-11-16", 2029: "2029-11-05", 2030: "2030-10-26", 2031: "2031-11-14",
    2032: "2032-11-02", 2033: "2033-10-22", 2034: "2034-11-10", 2035: "2035-10-31",
}
HOLI = {
    2020: "2020-03-10", 2021: "2021-03-29", 2022: "2022-03-18", 2023: "2023-03-08", 2024: "2024-03-25", 2025: "2025-03-14",
    2026: "2026-03-03", 2027: "2027-03-22", 2028: "2028-03-11", 2029: "2029-03-29", 2030: "2030-03-19", 2031: "2031-03-08",
    2032: "2032-03-26", 2033: "2033-03-15", 2034: "2034-03-05", 2035: "2035-03-24",
}
RAMADAN = {
    2020: "2020-04-24", 2021: "2021-04-13", 2022: "2022-04-02", 2023: "2023-03-23", 2024: "2024-03-11", 2025: "2025-03-01",
    2026: "2026-02-18", 2027: "2027-02-07", 2028: "2028-01-28", 2029: "2029-01-16", 2030: "2030-01-05", 2031: "2031-02-20",
    2032: "2032-01-15", 2033: "2033-01-04", 2034: "2034-12-15", 2035: "2035-12-05",
}

# Countries by tradition (ISO codes).
WESTERN = [
    "US", "CA", "GB", "DE", "FR", "IT", "ES", "PT", "NL", "BE", "CH", "AT", "PL", "CZ", "SK", "HU", "RO", "HR", "SI", "LT", "LV", "EE",
    "IE", "NO", "SE", "DK", "FI", "IS", "AU", "NZ", "ZA", "AR", "BR", "CL", "CO", "PE", "MX",
]
MUSLIM = [
    "SA", "IQ", "IR", "EG", "DZ", "MA", "SD", "PK", "BD", "ID", "MY", "NG", "TR", "AF", "YE", "SY", "TN", "SO", "NE", "ML", "SN", "LB",
    "JO", "PS", "AE", "QA", "KW", "OM", "BH",
]

# Where each event is observed; None means everywhere.
COUNTRIES: dict[str, list[str] | None] = {
    "easter": WESTERN,
    "orthodox_easter": ["RU", "UA", "BY", "GR", "CY", "RO", "BG", "RS", "MK", "MD", "GE", "AM"],
    "ramadan": MUSLIM,
    "chinese_new_year": ["CN", "TW", "HK", "SG", "MY", "VN", "PH", "ID", "TH", "KH", "LA", "MM", "BN"],
    "diwali": ["IN", "FJ", "GY", "MU", "MY", "NP", "SG", "SR", "TT", "LK", "AE", "QA", "OM", "BH", "KW", "SA"],
    "holi": ["IN", "NP"],
    "thanksgiving": ["US"],
    "black_friday": ["US", "CA", "GB"],
    "parents_day": ["US", "CA", "AU", "NZ", "DE", "JP", "IN"],
    "fifa_world_cup": None,
    "summer_olympics": None,
    "super_bowl": ["US", "CA"],
    "ipl": ["IN"],
    "cricket_world_cup": ["IN", "GB", "AU", "NZ", "ZA", "PK", "BD", "SL", "AE", "SG", "MY", "KE"],
    "tour_de_france": [],
}

# Years, first day and length in days of the tournaments.
TOURNAMENTS = {
    "fifa_world_cup": ("FIFA World Cup", [2018, 2022, 2026, 2030, 2034], (6, 11), 32),
    "summer_olympics": ("Summer Olympics", [2020, 2024, 2028, 2032], (7, 23), 17),
    "ipl": ("IPL Season", None, (3, 23), 60),
    "cricket_world_cup": ("Cricket World Cup", [2019, 2023, 2027, 2031], (10, 5), 46),
    "tour_de_france": ("Tour de France", None, (7, 1), 23),
}

# Regions in which an event is known to be observed.
REGION_HINTS = {
    "Durga Puja": ["west_bengal", "assam", "odisha", "jharkhand", "bihar", "tripura"],
    "Ganesh Chaturthi": ["maharashtra", "goa", "gujarat", "karnataka", "andhra_pradesh"],
    "Pongal": ["tamil_nadu", "pondicherry", "kerala"],
    "Onam": ["kerala"],
    "Lohri": ["punjab", "haryana", "delhi"],
    "Makar Sankranti": ["gujarat", "maharashtra", "karnataka", "andhra_pradesh", "tamil_nadu", "odisha", "bihar", "uttar_pradesh", "west_bengal"],
}

BASELINE_DAYS, EVENT_AFTER = 21, 1  # fixed values: days before and after an event
IMPACT_LOW, IMPACT_HIGH = 0.1, 5.0  # fixed values: limits of an impact


def lunar(year: Column, dates: dict[int, str]) -> Column:
    """Date of a festival in ``year`` from a table of dates, else null."""
    pairs = [F.lit(x) for pair in dates.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), year).cast("date")


@dataclass(frozen=True)
class Feast:
    """A dated event: observed by ``group``, named and typed, ``offset`` days off its anchor."""

    group: str
    anchor: str
    offset: int
    name: str
    kind: str


FEASTS = [
    Feast("easter", "easter", 0, "Easter Sunday", "religious"),
    Feast("easter", "easter", -2, "Good Friday", "religious"),
    Feast("easter", "easter", 1, "Easter Monday", "religious"),
    Feast("orthodox_easter", "orthodox", 0, "Orthodox Easter Sunday", "religious"),
    Feast("chinese_new_year", "cny", 0, "Chinese New Year", "cultural"),
    *[Feast("chinese_new_year", "cny", i, f"CNY Day {i + 1}", "cultural") for i in range(1, 15)],
    Feast("diwali", "diwali", 0, "Diwali", "cultural"),
    Feast("diwali", "diwali", -1, "Naraka Chaturdashi (Choti Diwali)", "cultural"),
    Feast("diwali", "diwali", -2, "Dhanteras", "cultural"),
    Feast("diwali", "diwali", 1, "Govardhan Puja", "cultural"),
    Feast("diwali", "diwali", 2, "Bhai Dooj", "cultural"),
    Feast("holi", "holi", 0, "Holi", "cultural"),
    Feast("holi", "holi", -1, "Holika Dahan", "cultural"),
    Feast("ramadan", "ramadan", 0, "Ramadan Start", "religious"),
    Feast("ramadan", "ramadan", 29, "Eid al-Fitr", "religious"),
    Feast("ramadan", "ramadan", 70, "Eid al-Adha", "religious"),
    Feast("thanksgiving", "thanksgiving", 0, "Thanksgiving", "public_holiday"),
    Feast("black_friday", "thanksgiving", 1, "Black Friday", "retail"),
    Feast("black_friday", "thanksgiving", 4, "Cyber Monday", "retail"),
    Feast("parents_day", "mothers_day", 0, "Mother's Day", "cultural"),
    Feast("parents_day", "fathers_day", 0, "Father's Day", "cultural"),
]


def anchors(year: Column) -> dict[str, Column]:
    return {
        "easter": western_easter(year),
        "orthodox": orthodox_easter(year),
        "cny": lunar(year, CHINESE_NEW_YEAR),
        "diwali": lunar(year, DIWALI),
        "holi": lunar(year, HOLI),
        "ramadan": lunar(year, RAMADAN),
        "thanksgiving": nth_weekday(year, 11, "THU", 4),
        "mothers_day": nth_weekday(year, 5, "SUN", 2),
        "fathers_day": nth_weekday(year, 6, "SUN", 3),
    }


def observed_in(group: str, country: Column) -> Column:
    countries = COUNTRIES[group]
    return F.lit(True) if countries is None else country.isin(countries)


def applicability(countries: DataFrame) -> DataFrame:
    """(event group, country) pairs for a table of country codes."""
    groups = F.array(*[
        F.when(observed_in(g, F.col("country")), F.lit(g)) for g in sorted(COUNTRIES)
    ])
    return countries.select("country", F.explode(groups).alias("event")).filter("event is not null")


def years_of(*tables: DataFrame) -> DataFrame:
    """Distinct years of the ``ds`` columns."""
    parts = [t.select(F.year("ds").alias("year")).distinct() for t in tables]
    return union_distinct(parts, ["year"])


def _with_countries(years: DataFrame, countries: Sequence[str]) -> DataFrame:
    return years.withColumn("country", F.explode(F.array(*[F.lit(c) for c in countries])))


def feasts(years: DataFrame, countries: Sequence[str]) -> DataFrame:
    """Religious, cultural and retail dates of the given years and countries."""
    base = _with_countries(years, countries)
    dated = base.withColumns({f"__{k}": v for k, v in anchors(F.col("year").cast("int")).items()})
    rows = F.array(*[
        F.when(
            observed_in(f.group, F.col("country")),
            F.struct(F.date_add(f"__{f.anchor}", f.offset).alias("ds"), F.lit(f.name).alias("name"),
                     F.lit(f.kind).alias("type")),
        )
        for f in FEASTS
    ])
    out = dated.select("country", F.explode(rows).alias("e")).select("e.ds", "e.name", "e.type", "country")
    return out.filter(F.col("ds").isNotNull())


def sports(years: DataFrame, countries: Sequence[str], only_reachable: bool = False) -> DataFrame:
    """One row per day of each tournament.

    ``only_reachable`` limits the output to the Super Bowl, the one event whose name
    and country entry agree in the original tables.
    """
    year, country = F.col("year").cast("int"), F.col("country")
    spans = [F.when(
        observed_in("super_bowl", country),
        F.struct(nth_weekday(year, 2, "SUN", 1).alias("first"), F.lit(1).alias("days"), F.lit("Super Bowl").alias("name")),
    )]
    for group, (label, when, (month, day), days) in ({} if only_reachable else TOURNAMENTS).items():
        occurs = F.lit(True) if when is None else year.isin(when)
        spans.append(F.when(
            occurs & observed_in(group, country),
            F.struct(F.make_date(year, F.lit(month), F.lit(day)).alias("first"), F.lit(days).alias("days"),
                     F.lit(label).alias("name")),
        ))
    found = _with_countries(years, countries).select("country", F.explode(F.array(*spans)).alias("s")).filter("s is not null")
    day = F.explode(F.sequence("s.first", F.date_add("s.first", F.col("s.days") - 1)))
    return found.select(day.alias("ds"), F.col("s.name").alias("name"), F.lit("sports").alias("type"), "country")


def event_calendar(panel: DataFrame, countries: Sequence[str], public_holidays: DataFrame | None = None,
                   include_sports: bool = True, include_cultural: bool = True) -> DataFrame:
    """All events of the countries between the first and last date of the panel.

    ``public_holidays`` (ds, name, type, country) comes from the caller; where it names
    the same event on the same day it wins.
    """
    # one aggregate over the panel; its uses below share a single subquery
    span = panel.agg(F.struct(F.min("ds").alias("first"), F.max("ds").alias("last"))).scalar()
    first, last = span.getField("first"), span.getField("last")
    every_year = F.explode(F.sequence(F.year(first), F.year(last)))
    years = panel.sparkSession.range(1).select(every_year.alias("year"))
    parts = [public_holidays.select("ds", "name", "type", "country")] if public_holidays is not None else []
    if include_cultural:
        parts.append(feasts(years, countries))
    if include_sports:
        parts.append(sports(years, countries))
    merged = union_by_priority(parts, ["ds", "name", "country"], ["type"]).drop("source")
    return merged.filter(F.col("ds").between(first, last))


def region_hints(regions: DataFrame) -> DataFrame:
    """(event, region) pairs known for the regions of a table."""
    pairs = F.array(*[
        F.when(F.col("region").isin(places), F.lit(event)) for event, places in REGION_HINTS.items()
    ])
    return regions.select("region", F.explode(pairs).alias("event")).filter("event is not null")


# --- impact ---------------------------------------------------------------------------


def event_impacts(events: DataFrame, panel: DataFrame) -> DataFrame:
    """Mean sales in the event window over the mean before it, per series and event.

    Null with fewer than three baseline rows, no event row or a zero baseline.
    """
    named = events.select(F.col("ds").alias("event_ds"), "name").distinct()
    means = window_means(named, panel, BASELINE_DAYS, 0, EVENT_AFTER)
    enough = (F.col("baseline_rows") >= 3) & (F.col("event_rows") >= 1)
    raw = F.when(enough, ratio("during", "baseline"))
    impact = F.round(clamp(raw, IMPACT_LOW, IMPACT_HIGH), 4)
    return means.select("series_id", "event_ds", "name", "baseline", impact.alias("impact"))


def overall_panel(panel: DataFrame) -> DataFrame:
    return panel.groupBy("ds").agg(F.round(F.sum("y"), 2).alias("y")).withColumn("series_id", F.lit("(all)"))


def weighted_impacts(events: DataFrame, panel: DataFrame) -> DataFrame:
    """One impact per event: the mean over series weighted by their baseline sales.

    Where no series has a positive weight the impact on the total stands in, else 1.
    """
    named = events.select(F.col("ds").alias("event_ds"), "name").distinct()
    by_series = event_impacts(events, panel)
    weight = F.when(F.col("impact").isNotNull() & (F.col("baseline") > 0), F.col("baseline"))
    weighted = by_series.groupBy("event_ds", "name").agg(
        ratio(F.sum(F.col("impact") * weight), F.sum(weight)).alias("weighted")
    )
    overall = event_impacts(events, overall_panel(panel)).select("event_ds", "name", F.col("impact").alias("overall"))
    joined = named.join(weighted, ["event_ds", "name"], "left").join(overall, ["event_ds", "name"], "left")
    value = F.coalesce("weighted", "overall", F.lit(1.0))
    return joined.select("event_ds", "name", F.round(clamp(value, IMPACT_LOW, IMPACT_HIGH), 4).alias("impact"))


def detect_events(panel: DataFrame, countries: Sequence[str], public_holidays: DataFrame | None = None,
                  per_series: bool = False, min_abs_impact: float = 0.0) -> DataFrame:
    """Calendar of the panel's date range with the measured impact of every event."""
    calendar = event_calendar(panel, countries, public_holidays)
    kinds = calendar.groupBy(F.col("ds").alias("event_ds"), "name").agg(F.min("type").alias("type"))
    measured = (
        event_impacts(calendar, panel).drop("baseline").fillna(1.0, ["impact"]) if per_series
        else weighted_impacts(calendar, panel)
    )
    out = measured.join(kinds, ["event_ds", "name"])
    if min_abs_impact > 0:
        small = F.abs(F.col("impact") - 1) < min_abs_impact
        out = out.withColumn("impact", F.when(small, 1.0).otherwise(F.col("impact")))
    return out.withColumn("impact_pct", impact_pct("impact"))


# --- interval events and lifts --------------------------------------------------------------


def explode_intervals(events: DataFrame, keys: Sequence[str] = (), lag_days: int = 0) -> DataFrame:
    """One row per day of each event, moved by ``lag_days``; incomplete events are dropped."""
    valid = events.filter(F.col("start_date").isNotNull() & (F.col("end_date") >= F.col("start_date")))
    day = F.explode(F.sequence(F.col("start_date").cast("date"), F.col("end_date").cast("date")))
    out = valid.select("event_id", "event_name", *[k for k in keys if k in events.columns], day.alias("ds"))
    return out.withColumn("ds", F.date_add("ds", lag_days))


def promo_lifts(sales: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Promotion lift and relative slope of sales on discount per group."""
    base = F.avg(F.when(F.col("promo_flag") == 0, F.col("y")))
    promo = F.avg(F.when(F.col("promo_flag") == 1, F.col("y")))
    pair = F.col("y").isNotNull() & F.col("discount").isNotNull()
    mean = F.avg(F.when(pair, F.col("y")))
    sloped = (F.count_if(pair) >= 10) & (F.stddev_samp(F.when(pair, F.col("discount"))) > 0) & (mean > 0)
    return sales.groupBy(*keys).agg(
        F.coalesce(F.when(base > 0, ratio(promo, base)), F.lit(1.0)).alias("promo_lift"),
        F.coalesce(F.when(sloped, ratio(F.regr_slope("y", "discount"), mean)), F.lit(0.0)).alias("discount_beta"),
    )


def event_lifts(sales: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Mean sales on event days over days without event, per group and event.

    Events seen on fewer than three rows have no lift.
    """
    by_event = sales.groupBy(*keys, "event_name").agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n"))
    plain = F.max(F.when(F.col("event_name").isNull(), F.col("mean"))).over(Window.partitionBy(*keys))
    return (
        by_event.withColumn("plain", plain)
        .filter(F.col("event_name").isNotNull() & (F.col("n") >= 3) & (F.col("plain") > 0))
        .select(*keys, "event_name", (F.col("mean") / F.col("plain")).alias("event_lift"))
    )


def combined_lift(promo_flag: Column, discount: Column, event_lift: Column) -> Column:
    """Product of the lifts that apply; needs ``promo_lift`` and ``discount_beta``."""
    promo = F.when(F.coalesce(promo_flag, F.lit(0)) != 0, F.col("promo_lift")).otherwise(1.0)
    price = F.when(F.coalesce(discount, F.lit(0.0)) != 0, 1 + F.col("discount_beta") * discount).otherwise(1.0)
    return promo * price * F.coalesce(event_lift, F.lit(1.0))


# --- lagged correlation ---------------------------------------------------------------------


def lagged_factor_correlation(panel: DataFrame, factor: DataFrame, lags: int) -> DataFrame:
    """Correlation of sales with each factor column 0..lags-1 rows earlier.

    Lags are positions in the joined rows of a series. A factor with several rows on a day
    counts with its mean, so the joined table has one row per series, day and column. No row is copied
    per lag: values are put in order once, as two arrays of calendar length, and each lag folds
    their overlap into its moments.
    """
    numbers = [f.name for f in factor.schema.fields if isinstance(f.dataType, T.NumericType)]
    values = F.array(*[
        F.struct(F.lit(i).alias("no"), F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
        for i, c in enumerate(numbers)
    ])
    daily = factor.groupBy("ds").agg(*[F.avg(c).alias(c) for c in numbers])
    long = panel.select("series_id", "ds", "y").join(daily, "ds").select("series_id", "ds", "y", F.explode(values).alias("v"))
    rows = long.select("series_id", "ds", "y", "v.*")
    listed = rows.groupBy("series_id", "column").agg(
        F.min("no").alias("no"), F.avg("y").alias("my"), F.avg("x").alias("mx"), F.array_sort(F.collect_list(F.struct("ds", "y", "x"))).alias("r")
    )
    n = F.size("r")
    arrays = listed.select(
        "series_id", "no", "column", n.alias("n"),
        F.transform(F.col("r")["y"], lambda v: v - F.col("my")).alias("ys"), F.transform(F.col("r")["x"], lambda v: v - F.col("mx")).alias("xs"),
    )
    names = ("n", "x", "y", "xx", "yy", "xy")
    nothing = F.struct(*[F.lit(0.0).alias(c) for c in names])

    def add(sums: Column, pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        grown = F.struct(*[(sums[c] + v).alias(c) for c, v in zip(names, (F.lit(1.0), x, y, x * x, y * y, x * y), strict=True)])
        return F.when(x.isNull() | y.isNull(), sums).otherwise(grown)

    def at(k: Column) -> Column:
        pairs = F.zip_with(F.slice("ys", k + 1, F.greatest(F.col("n") - k, F.lit(0))), F.slice("xs", F.lit(1), F.greatest(F.col("n") - k, F.lit(0))), lambda y, x: F.struct(x.alias("x"), y.alias("y")))
        return F.aggregate(pairs, nothing, add)

    moments = arrays.select("series_id", "no", "column", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(lags - 1)), at)).alias("lag", "m"))
    n, x, y, xx, yy, xy = (F.col("m")[c] for c in names)
    sxx, syy = xx - x * x / n, yy - y * y / n
    spread = F.when((n > 0) & (sxx > 1e-12 * xx) & (syy > 1e-12 * yy), F.sqrt(sxx * syy))
    return moments.select("series_id", "no", "column", "n", "lag", F.try_divide(xy - x * y / n, spread).alias("r"))


def lag_analysis(panel: DataFrame, factor: DataFrame, max_lag: int = 30) -> DataFrame:
    """Factor column and lag most correlated with each series."""
    all_lags = lagged_factor_correlation(panel, factor, max_lag + 1)
    usable = all_lags.filter((F.col("n") >= max_lag + 5) & (F.col("lag") < F.floor(F.col("n") / 2)))
    size = F.coalesce(F.abs("r"), F.lit(0.0))
    # rounding the sort key keeps the choice independent of summation order
    best = usable.groupBy("series_id").agg(
        F.max_by(F.struct("column", "lag", size.alias("r")), F.struct(F.round(size, 9), -F.col("no"), -F.col("lag"))).alias("b")
    )
    return best.select(
        "series_id", F.col("b.column").alias("column"), F.col("b.lag").alias("lag"),
        F.round("b.r", 3).alias("correlation"), strength_label("b.r").alias("strength"),
    )


def factor_lags(panel: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    """Plain correlation and best lag of each factor column with each series.

    Lags run below 30 and a third of the rows; a best correlation up to 0.1 is no lag.
    """
    parts = []
    for kind, df in factors.items():
        rows = lagged_factor_correlation(panel, df, 30).filter(F.col("n") >= 5)
        size = F.coalesce(F.abs("r"), F.lit(0.0))
        seen = F.col("lag") < F.floor(F.col("n") / 3)
        best = F.max_by(F.struct("lag", size.alias("r")), F.when(seen, F.struct(F.round(size, 9), -F.col("lag"))))
        parts.append(
            rows.groupBy("series_id", F.concat(F.lit(f"{kind}/"), "column").alias("factor"))
            .agg(F.coalesce(F.max(F.when(F.col("lag") == 0, F.col("r"))), F.lit(0.0)).alias("correlation"), best.alias("b"))
            .select("series_id", "factor", "correlation",
                    F.when(F.col("b.r") > 0.1, F.col("b.lag")).alias("best_lag"),
                    F.when(F.col("b.r") > 0.1, F.col("b.r")).alias("best_correlation"))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rule_uplift(rules: Sequence[tuple[Column, float]]) -> Column:
    """Multiplier of the first rule that holds, else 1."""
    (condition, value), *rest = rules
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(1.0)
