"""Date arithmetic: period labels, future dates, week numbering, feast dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col

FREQUENCIES = ("D", "W", "F", "M", "Q", "Y")
DAYS_PER_PERIOD = {"D": 1, "W": 7, "F": 14, "M": 30, "Q": 91, "Y": 365}  # fixed values


def week_start(ds: Column | str, day: str = "MON") -> Column:
    """First day of the week that begins on ``day``."""
    return F.date_sub(F.next_day(col(ds), day), 7)


def week_end(ds: Column | str) -> Column:
    """The Sunday that closes the week of ``ds``."""
    return F.next_day(F.date_sub(col(ds), 1), "SUN")


def quarter_end(ds: Column | str) -> Column:
    return F.date_sub(F.add_months(F.trunc(col(ds), "QUARTER"), 3), 1)


def year_end(ds: Column | str) -> Column:
    return F.date_sub(F.add_months(F.trunc(col(ds), "YEAR"), 12), 1)


def period_start(ds: Column | str, freq: str, day: str = "MON") -> Column:
    if freq == "D":
        return col(ds).cast("date")
    if freq == "W":
        return week_start(ds, day)
    if freq == "M":
        return F.trunc(col(ds), "MONTH")
    raise ValueError(f"no period start for frequency {freq!r}")


def period_label(ds: Column | str, freq: str, origin: Column | str | None = None) -> Column:
    """Label of the resampling bin: the day itself, or the last day of the period.

    Fortnights are counted from ``origin``, the first day of the series, and carry
    their first day as label.
    """
    ds = col(ds)
    if freq == "D":
        return ds
    if freq == "W":
        return week_end(ds)
    if freq == "F":
        if origin is None:
            raise ValueError("fortnights need the first day of the series as origin")
        start = col(origin)
        return F.date_add(start, (F.floor(F.datediff(ds, start) / 14) * 14).cast("int"))
    if freq == "M":
        return F.last_day(ds)
    if freq == "Q":
        return quarter_end(ds)
    if freq == "Y":
        return year_end(ds)
    raise ValueError(f"unknown frequency {freq!r}")


def future_date(last: Column | str, step: Column | str, freq: str) -> Column:
    """The ``step``-th period label strictly after ``last``."""
    last, step = col(last), col(step).cast("int")
    following = F.date_add(last, 1)
    if freq == "D":
        return F.date_add(last, step)
    if freq == "W":
        return F.date_add(F.next_day(last, "SUN"), (step - 1) * 7)
    if freq == "F":
        return F.date_add(last, step * 14)
    if freq == "M":
        return F.last_day(F.add_months(following, step - 1))
    if freq == "Q":
        return F.date_sub(F.add_months(F.trunc(following, "QUARTER"), step * 3), 1)
    if freq == "Y":
        return F.date_sub(F.add_months(F.trunc(following, "YEAR"), step * 12), 1)
    raise ValueError(f"unknown frequency {freq!r}")


def horizon_date(start: Column | str, step: Column | str, freq: str, day: str = "MON") -> Column:
    """The ``step``-th (from 0) planned date: days, week starts or month starts."""
    first, step = period_start(start, freq, day), col(step).cast("int")
    if freq == "M":
        return F.add_months(first, step)
    return F.date_add(first, step * (7 if freq == "W" else 1))


def week_of_month(ds: Column | str, day: str = "MON") -> Column:
    """1 for the week that holds the first of the month, 2 for the next, ..."""
    first = week_start(F.trunc(col(ds), "MONTH"), day)
    return (F.datediff(week_start(ds, day), first) / 7 + 1).cast("int")


def nth_weekday(year: Column, month: int, day: str, n: int) -> Column:
    """The n-th given weekday of a month, e.g. the 4th Thursday of November."""
    before = F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1)
    return F.date_add(F.next_day(before, day), 7 * (n - 1))


def last_weekday(year: Column, month: int, day: str) -> Column:
    after = F.date_add(F.last_day(F.make_date(year, F.lit(month), F.lit(1))), 1)
    return F.date_sub(F.next_day(F.date_sub(after, 1), day), 7)


def _quotient(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def western_easter(year: Column | str) -> Column:
    """Easter Sunday of the Gregorian calendar.

    The paschal full moon comes from the epact (lunar age, corrected for leap
    centuries); Easter is the Sunday that follows it.
    """
    year = col(year).cast("int")
    golden = year % 19
    century = _quotient(year, 100) + 1
    skipped_leaps = _quotient(century * 3, 4) - 12
    moon_shift = _quotient(century * 8 + 5, 25) - 5
    raw = F.pmod(golden * 11 + 20 + moon_shift - skipped_leaps + 11, F.lit(30))
    late = (raw == 24) | ((raw == 25) & (golden + 1 > 11))
    epact = raw + F.when(late, 1).otherwise(0)
    moon_day = F.lit(44) - epact
    moon_day = moon_day + F.when(moon_day < 21, 30).otherwise(0)
    full_moon = F.date_add(F.make_date(year, F.lit(3), F.lit(1)), moon_day - 1)
    return F.next_day(full_moon, "SUN")


def orthodox_easter(year: Column | str) -> Column:
    """Easter Sunday of the Julian calendar as a Gregorian date (valid 1900-2099)."""
    year = col(year).cast("int")
    moon_age = (year % 19 * 19 + 15) % 30
    full_moon_julian = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), moon_age)
    full_moon = F.date_add(full_moon_julian, 13)
    return F.next_day(full_moon, "SUN")


def frequency_by_gap(gap: Column | str, ladder: list[tuple[float, str]], default: str) -> Column:
    """Walk ``ladder`` (upper limit in days, label) in order; above all: ``default``."""
    gap = col(gap)
    (limit, label), *rest = ladder
    chain = F.when(gap <= limit, label)
    for limit, label in rest:
        chain = chain.when(gap <= limit, label)
    return F.when(gap.isNotNull(), chain.otherwise(default))


# The four gap ladders, in days.
VALIDATION_LADDER = [(3, "D"), (10, "W"), (20, "F"), (60, "M"), (180, "Q")]  # else Y
PATTERN_LADDER = [(1.5, "D"), (3.5, "2D"), (10, "W"), (20, "2W"), (45, "MS"), (100, "QS")]  # else YS
MODEL_LADDER = [(1, "D"), (7, "W"), (31, "M")]  # else D
FREQUENCY_RANK = {"D": 0, "W": 1, "F": 2, "M": 3, "Q": 4, "Y": 5}
