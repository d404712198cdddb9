"""Event tables of the queries: Spark form and, for the comparison engine, SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as ev
from ..sources.tables import scan

SALES_YEARS = "years AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)"
ALL_YEARS = """years AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders
  UNION SELECT DISTINCT CAST(year(ts) AS INTEGER) FROM events)"""

# Gauss's rule, a different route to the same dates as the Spark expression
EASTER = """easter AS (
  SELECT y, CAST(make_date(y, 3, 22) + CAST(d + e - CASE WHEN (d = 29 AND e = 6)
      OR (d = 28 AND e = 6 AND (11 * mm + 11) % 30 < 19) THEN 7 ELSE 0 END AS INTEGER) AS DATE) AS western,
    CAST(make_date(y, 3, 22) + CAST(jd + je + 13 AS INTEGER) AS DATE) AS orthodox
  FROM (SELECT *, (2 * (y % 4) + 4 * (y % 7) + 6 * d + nn) % 7 AS e, (2 * (y % 4) + 4 * (y % 7) + 6 * jd + 6) % 7 AS je
    FROM (SELECT *, (19 * (y % 19) + mm) % 30 AS d, (19 * (y % 19) + 15) % 30 AS jd
      FROM (SELECT y, (15 - (13 + 8 * (y // 100)) // 25 + y // 100 - y // 400) % 30 AS mm,
                   (4 + y // 100 - y // 400) % 7 AS nn FROM years))))"""


def nth_sql(month: int, isodow: int, n: int) -> str:
    first = f"make_date(y, {month}, 1)"
    return f"CAST({first} + CAST(({isodow} - isodow({first}) + 7) % 7 + {7 * (n - 1)} AS INTEGER) AS DATE)"


THANKSGIVING = nth_sql(11, 4, 4)
LUNAR = "lunar AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS feast, CAST(unnest([{', '.join(repr(d) for d in dates.values())}]) AS DATE) AS d"
    for name, dates in [("cny", ev.CHINESE_NEW_YEAR), ("diwali", ev.DIWALI), ("holi", ev.HOLI), ("ramadan", ev.RAMADAN)]
) + ")"

_ANCHORS = f"""anchors AS (SELECT 'easter' AS a, western AS d FROM easter UNION ALL SELECT 'orthodox', orthodox FROM easter
  UNION ALL SELECT feast, d FROM lunar WHERE year(d) IN (SELECT y FROM years)
  UNION ALL SELECT 'thanksgiving', {THANKSGIVING} FROM years UNION ALL SELECT 'mothers_day', {nth_sql(5, 7, 2)} FROM years
  UNION ALL SELECT 'fathers_day', {nth_sql(6, 7, 3)} FROM years)"""


def _in(country: str, group: str) -> bool:
    allowed = ev.COUNTRIES[group]
    return allowed is None or country in allowed


def feasts_sql(countries: list[str]) -> list[str]:
    """CTEs ending in ``feasts``: ds, name, type, country."""
    rules = ", ".join(
        "('{}', {}, '{}', '{}', '{}')".format(f.anchor, f.offset, f.name.replace("'", "''"), f.kind, c)
        for c in countries for f in ev.FEASTS if _in(c, f.group)
    )
    return [EASTER, LUNAR, _ANCHORS, f"rules(a, off, name, type, country) AS (VALUES {rules})",
            "feasts AS (SELECT CAST(d + off AS DATE) AS ds, name, type, country FROM anchors JOIN rules ON anchors.a = rules.a)"]


def sports_sql(countries: list[str]) -> str:
    parts = []
    for c in countries:
        if _in(c, "super_bowl"):
            parts.append(f"SELECT {nth_sql(2, 7, 1)} AS ds, 'Super Bowl' AS name, 'sports' AS type, '{c}' AS country FROM years")
        for group, (label, when, (month, day), days) in ev.TOURNAMENTS.items():
            if _in(c, group):
                where = f"WHERE y IN ({', '.join(map(str, when))})" if when else ""
                parts.append(f"""SELECT CAST(make_date(y, {month}, {day}) + CAST(unnest(range({days})) AS INTEGER) AS DATE) AS ds,
                  '{label}' AS name, 'sports' AS type, '{c}' AS country FROM years {where}""")
    return "sports AS (" + " UNION ALL ".join(parts) + ")"


# the United States events between the first and last order date of the region panel
EVENTS_US = ",\n".join([SALES_YEARS, *feasts_sql(["US"]), sports_sql(["US"]), """us_events AS (SELECT DISTINCT ds, name, type FROM (
  SELECT * FROM feasts UNION ALL SELECT * FROM sports) WHERE ds BETWEEN (SELECT min(ds) FROM region_panel) AND (SELECT max(ds) FROM region_panel))"""])


def us_events(panel: DataFrame) -> DataFrame:
    return ev.event_calendar(panel, ["US"]).select("ds", "name", "type")


INTERVALS = """intervals AS (SELECT l_orderkey * 10 + l_linenumber AS event_id, 'sale ' || l_returnflag AS event_name, p_brand AS series_id,
  CAST(l_shipdate AS DATE) AS start_date, CAST(l_shipdate + to_days(l_linenumber) AS DATE) AS end_date
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount = 0.1 AND l_quantity >= 45)"""


def intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Multi-day events of a brand: the large lines sold at the highest discount."""
    lines = scan(spark, folder, "lineitem").filter((F.col("l_discount") == 0.1) & (F.col("l_quantity") >= 45))
    part = scan(spark, folder, "part").select("p_partkey", "p_brand")
    start = F.to_date("l_shipdate")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
        F.concat(F.lit("sale "), "l_returnflag").alias("event_name"), F.col("p_brand").alias("series_id"),
        start.alias("start_date"), F.date_add(start, F.col("l_linenumber")).alias("end_date"),
    )
