"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minekit.operators.profile import row_hash
from minekit.scale import col, one_row, quantiles


def date_parts(df: DataFrame, c: str) -> DataFrame:
    """Add year, month, day, month name, weekday number (Monday = 0) and weekday name."""
    return df.withColumns(
        {
            "year": F.year(c),
            "month": F.month(c),
            "day": F.dayofmonth(c),
            "month_name": F.date_format(c, "MMMM"),
            "weekday": F.weekday(c),
            "weekday_name": F.date_format(c, "EEEE"),
        }
    )


def half_year(c: str | Column) -> Column:
    """1 for January to June, 2 for July to December."""
    return (F.floor(F.month(col(c)) / 7) + 1).cast("int")


def week_no(c: str | Column, origin: str) -> Column:
    """Whole weeks since ``origin`` (a Monday)."""
    return F.floor(F.datediff(col(c), F.lit(origin).cast("date")) / 7).cast("int")


def week_start(n: str | Column, origin: str) -> Column:
    """First day of week ``n``."""
    return F.date_add(F.lit(origin).cast("date"), col(n).cast("int") * 7)


def days_since_first(df: DataFrame, c: str, out: str = "days_since_first") -> DataFrame:
    first = df.agg(F.min(F.to_date(c)).alias("d"))
    return df.withColumn(out, F.datediff(F.to_date(c), one_row(first)["d"]))


def repair_dates(df: DataFrame, c: str, max_year: int, how: str, shift: int = 0, seed: int = 0) -> DataFrame:
    """Repair dates after ``max_year``; the old value stays in ``<c>_original``.

    ``how``: shift (back by ``shift`` years), mean, median, random (a date between the first and last
    valid one, hashed from the old date) or null.
    """
    day = F.to_date(c)
    bad = F.coalesce(F.year(day) > max_year, F.lit(False))
    valid = df.where(F.year(day) <= max_year).select(F.unix_date(day).alias("d"))
    if how == "shift":
        fixed = F.add_months(day, -12 * shift)
    elif how == "mean":
        fixed = F.date_from_unix_date(F.floor(one_row(valid.agg(F.avg("d").alias("m")))["m"]).cast("int"))
    elif how == "median":
        middle = one_row(quantiles(valid, [], "d", [0.5]))["q"][0]
        fixed = F.date_from_unix_date(F.floor(middle).cast("int"))
    elif how == "random":
        span = one_row(valid.agg(F.min("d").alias("a"), F.max("d").alias("b")))
        draw = F.pmod(row_hash(F.unix_date(day), seed), span["b"] - span["a"] + 1).cast("int")
        fixed = F.date_from_unix_date(span["a"] + draw)
    elif how == "null":
        fixed = F.lit(None).cast("date")
    else:
        raise ValueError(f"unknown repair {how!r}")
    return df.withColumn(f"{c}_original", F.col(c)).withColumn(c, F.when(bad, fixed).otherwise(day))


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th given weekday (Monday = 0) of a month; n = -1 is the last one."""
    if n > 0:
        first = F.make_date(year, F.lit(month), F.lit(1))
        return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)))


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday by the anonymous computus."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = F.pmod(year, F.lit(19)), div(year, 100), F.pmod(year, F.lit(100))
    h = F.pmod(19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15, F.lit(30))
    w = F.pmod(32 + 2 * F.pmod(b, F.lit(4)) + 2 * div(c, 4) - h - F.pmod(c, F.lit(4)), F.lit(7))
    m = div(a + 11 * h + 22 * w, 451)
    s = h + w - 7 * m + 114
    return F.make_date(year, div(s, 31), F.pmod(s, F.lit(31)) + 1)


def observed(d: Column) -> Column:
    """Saturday holidays are observed on Friday, Sunday holidays on Monday."""
    return F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)


def holiday_calendar(years: DataFrame, year: str = "year") -> DataFrame:
    """US holidays of every year in ``years`` as a ``(holiday, date)`` dimension, from calendar rules."""
    y = F.col(year)
    fixed = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    thanksgiving = nth_weekday(y, 11, 3, 4)
    rules = {
        "New Year's Day": fixed(1, 1),
        "Martin Luther King's Day": nth_weekday(y, 1, 0, 3),
        "Washington's Birthday": nth_weekday(y, 2, 0, 3),
        "Saint Patrick's Day": fixed(3, 17),
        "Easter": easter(y),
        "Easter Monday": F.date_add(easter(y), 1),
        "Memorial Day": nth_weekday(y, 5, 0, -1),
        "Juneteenth National Independence Day": fixed(6, 19),
        "Independence Day": F.when(F.weekday(fixed(7, 4)) == 5, fixed(7, 3)).otherwise(fixed(7, 4)),
        "Labor Day": nth_weekday(y, 9, 0, 1),
        "Columbus Day": nth_weekday(y, 10, 0, 2),
        "Veterans' Day": fixed(11, 11),
        "Thanksgiving Day": thanksgiving,
        "Black Friday": F.date_add(thanksgiving, 1),
        "Christmas Day": F.when(F.weekday(fixed(12, 25)) == 6, fixed(12, 26)).otherwise(fixed(12, 25)),
    }
    named = F.array(*[F.struct(F.lit(k).alias("holiday"), v.alias("date")) for k, v in rules.items()])
    return years.select(year).distinct().select(F.inline(named))


def tag_dates(df: DataFrame, c: str, calendar: DataFrame, name: str = "holiday") -> DataFrame:
    """Name of the calendar entry of each row's day, null on ordinary days.

    A day with two entries keeps the first in alphabetical order. The calendar is a per-day dimension:
    Spark broadcasts it when its measured size allows.
    """
    days = calendar.groupBy(F.to_date("date").alias("__day")).agg(F.min(name).alias(name))
    return df.withColumn("__day", F.to_date(c)).join(days, "__day", "left").drop("__day")
