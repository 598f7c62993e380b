"""Date and time functions with the dialect's semantics."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of units of fixed length.
MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
#: 2000-01-03, a Monday, where buckets of fixed length begin.
ORIGIN = 946_857_600_000_000
#: Format codes of C and of Spark.
FORMATS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "g": "SSS", "p": "a", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "-d": "d", "-m": "M", "-H": "H"}


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def epoch_ms(ts: Column) -> Column:
    return F.round(micros(ts) / 1000).cast("long")


def epoch(ts: Column) -> Column:
    return micros(ts) / F.lit(1_000_000.0)


def epoch_ns(ts: Column) -> Column:
    return micros(ts) * 1000


def date_part(part: str, ts: Column) -> Column:
    part = part.lower().rstrip("s") if part.lower() not in ("s",) else "second"
    return {
        "year": lambda: F.year(ts),
        "month": lambda: F.month(ts),
        "day": lambda: F.dayofmonth(ts),
        "hour": lambda: F.hour(ts),
        "minute": lambda: F.minute(ts),
        "second": lambda: F.second(ts),
        "millisecond": lambda: F.pmod(F.floor(micros(ts) / 1000), F.lit(60_000)),
        "microsecond": lambda: F.pmod(micros(ts), F.lit(60_000_000)),
        "nanosecond": lambda: F.pmod(micros(ts), F.lit(60_000_000)) * 1000,
        "dow": lambda: F.dayofweek(ts) - 1,
        "dayofweek": lambda: F.dayofweek(ts) - 1,
        "isodow": lambda: F.weekday(ts) + 1,
        "doy": lambda: F.dayofyear(ts),
        "dayofyear": lambda: F.dayofyear(ts),
        "week": lambda: F.weekofyear(ts),
        "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), ts),
        "yearweek": lambda: F.extract(F.lit("YEAROFWEEK"), ts) * 100 + F.weekofyear(ts),
        "quarter": lambda: F.quarter(ts),
        "decade": lambda: F.floor(F.year(ts) / 10),
        "century": lambda: F.ceil(F.year(ts) / 100),
    }[part]().cast("long")


def date_trunc(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts.cast("timestamp")).cast("timestamp_ntz")


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """How many boundaries of the unit lie between; for weeks, how many whole ones."""
    unit = unit.lower().rstrip("s")
    months = lambda t: F.year(t) * 12 + F.month(t) - 1
    if unit in ("year", "decade", "century"):
        size = {"year": 1, "decade": 10, "century": 100}[unit]
        return (F.floor(F.year(end) / size) - F.floor(F.year(start) / size)).cast("long")
    if unit in ("month", "quarter"):
        size = {"month": 1, "quarter": 3}[unit]
        return (F.floor(months(end) / size) - F.floor(months(start) / size)).cast("long")
    if unit == "week":  # whole weeks between the dates
        days = F.date_diff(end, start)
        return (F.signum(days) * F.floor(F.abs(days) / 7)).cast("long")
    place = lambda t: F.floor(micros(t) / MICROS[unit])
    return (place(end) - place(start)).cast("long")


def date_sub(unit: str, start: Column, end: Column) -> Column:
    """How many whole units lie between."""
    unit = unit.lower().rstrip("s")
    if unit in MICROS:
        gap = micros(end) - micros(start)
        return (F.signum(gap) * F.floor(F.abs(gap) / MICROS[unit])).cast("long")
    size = {"month": 1, "quarter": 3, "year": 12}[unit]
    low, high = F.least(start, end), F.greatest(start, end)
    day = F.least(F.dayofmonth(low), F.dayofmonth(F.last_day(high)))  # a day past the later month's end falls on its end
    time = lambda t: F.pmod(micros(t), F.lit(MICROS["day"]))
    short = (F.dayofmonth(high) < day) | ((F.dayofmonth(high) == day) & (time(high) < time(low)))
    whole = F.year(high) * 12 + F.month(high) - F.year(low) * 12 - F.month(low) - F.when(short, 1).otherwise(0)
    return (F.when(end < start, -1).otherwise(1) * F.floor(whole / size)).cast("long")


def date_add(ts: Column, months: Column | int = 0, days: Column | int = 0, microseconds: Column | int = 0) -> Column:
    """An interval added part by part; days past a month's end fall on its end."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    moved = ts.cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), lit(months).cast("int"))
    return from_micros(micros(moved) + lit(days).cast("long") * MICROS["day"] + lit(microseconds).cast("long"))


def age(later: Column, earlier: Column) -> Column:
    """A struct of months, days and microseconds from earlier to later, all of one sign."""
    low, high = F.least(later, earlier), F.greatest(later, earlier)
    months = F.year(high) * 12 + F.month(high) - F.year(low) * 12 - F.month(low)
    inside = lambda t: (F.dayofmonth(t) - 1) * MICROS["day"] + F.pmod(micros(t), F.lit(MICROS["day"]))
    months = months - F.when(inside(high) < inside(low), 1).otherwise(0)
    time_of = lambda t: F.pmod(micros(t), F.lit(MICROS["day"]))
    # Days are counted with the length of the earlier month, as a borrow would have it.
    time = time_of(high) - time_of(low)
    days = F.dayofmonth(high) - F.dayofmonth(low) - F.when(time < 0, 1).otherwise(0)
    days = F.when(days < 0, days + F.dayofmonth(F.last_day(low))).otherwise(days)
    time = F.when(time < 0, time + MICROS["day"]).otherwise(time)
    sign = F.when(later < earlier, -1).otherwise(1)
    return F.struct((sign * months).cast("long").alias("months"), (sign * days).cast("long").alias("days"), (sign * time).cast("long").alias("micros"))


def time_bucket(ts: Column, width_micros: int | None = None, width_months: int | None = None, origin: int = ORIGIN) -> Column:
    """The start of the bucket of fixed width that holds ts; fixed widths start at ORIGIN, months at 2000-01."""
    if width_months:
        months = (F.year(ts) - 2000) * 12 + F.month(ts) - 1
        at = F.floor(months / width_months) * width_months
        return F.make_timestamp_ntz(2000 + F.floor(at / 12), F.pmod(at, F.lit(12)) + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return from_micros(F.floor((micros(ts) - origin) / width_micros) * width_micros + origin)


def java_format(pattern: str) -> str:
    """A format of C codes in Spark's letters; other letters are quoted."""
    out = []
    for m in re.finditer(r"%(-?[A-Za-z%])|([A-Za-z]+)|([^%A-Za-z]+)", pattern):
        code, letters, other = m.groups()
        out.append("%" if code == "%" else FORMATS[code] if code else f"'{letters}'" if letters else other.replace("'", "''"))
    return "".join(out)


def strftime(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, java_format(pattern))


def strptime(s: Column, pattern: str) -> Column:
    return F.to_timestamp_ntz(s, F.lit(java_format(pattern)))


def dayname(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def monthname(ts: Column) -> Column:
    return F.date_format(ts, "MMMM")


def part(name: str):
    """The function of one part of a date or time: year(ts), isodow(ts), ..."""

    def of(ts: Column) -> Column:
        return date_part(name, ts)

    of.__doc__ = f"The {name} of a date or time."
    return of


def today() -> Column:
    return F.current_date()


#: Places of the units in make_interval(years, months, weeks, days, hours, minutes, seconds), and how many of those each is.
INTERVAL_UNITS = {"millennia": (0, 1000), "centuries": (0, 100), "decades": (0, 10), "years": (0, 1), "quarters": (1, 3), "months": (1, 1), "weeks": (2, 1), "days": (3, 1), "hours": (4, 1), "minutes": (5, 1), "seconds": (6, 1), "milliseconds": (6, 0.001), "microseconds": (6, 0.000001)}


def to_unit(unit: str):
    """The builder to_<unit>(n) of intervals, which add to dates and timestamps."""
    place, size = INTERVAL_UNITS[unit]

    def build(n: Column) -> Column:
        amount = (n * F.lit(size)).cast("decimal(18,6)") if place == 6 else (n * F.lit(size)).cast("int")
        return F.make_interval(*(amount if k == place else F.lit(0) for k in range(7)))

    build.__doc__ = f"An interval of n {unit}."
    return build


#: Days of a month and of a year on average, as totals of mixed intervals count them.
MONTH_DAYS, YEAR_DAYS = 30.4375, 365.25


def total(unit: str):
    """The function total_<unit>(interval): all of an interval in one unit, as a double."""

    def of(interval: Column) -> Column:
        months = F.extract(F.lit("YEAR"), interval) * 12 + F.extract(F.lit("MONTH"), interval)
        seconds = (F.extract(F.lit("HOUR"), interval) * 3600 + F.extract(F.lit("MINUTE"), interval) * 60 + F.extract(F.lit("SECOND"), interval)).cast("double")
        days = F.extract(F.lit("DAY"), interval) + seconds / 86400
        every = months * MONTH_DAYS + days
        return {
            "years": lambda: every / YEAR_DAYS,
            "months": lambda: months + days / MONTH_DAYS,
            "days": lambda: every,
            "hours": lambda: every * 24,
            "minutes": lambda: every * 1440,
            "seconds": lambda: every * 86400,
        }[unit]().cast("double")

    of.__doc__ = f"All of an interval in {unit}."
    return of
