"""Calendar arithmetic as column expressions; dates have no time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ordinal


def month_add(day: Column, months: Column) -> Column:
    """The same day n months on (the last of the month if it has no such day)."""
    return F.add_months(day, months)


def business_day_add(day: Column, n: Column, holidays: Column) -> Column:
    """The n-th Monday to Friday after day that is no holiday; day itself for n = 0. holidays: array of dates."""
    span = F.sequence(F.date_add(day, 1), F.date_add(day, (n * 2 + 10 + F.size(holidays)).cast("int")))
    open_days = F.filter(span, lambda d: (F.weekday(d) < 5) & ~F.array_contains(holidays, d))
    return F.when(n == 0, day).otherwise(F.element_at(open_days, n.cast("int")))


def months_complete(start: Column, end: Column) -> Column:
    """Complete months: one less while the day of the month has not come."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)


def long_date(day: Column) -> Column:
    """March 1st, 2025."""
    return F.concat(F.date_format(day, "MMMM "), ordinal(F.dayofmonth(day)), F.date_format(day, ", yyyy"))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two spans of days share one, ends included."""
    return F.greatest(s1, s2) <= F.least(e1, e2)


def week_of_month(day: Column) -> Column:
    return F.floor((F.dayofmonth(day) - 1) / 7)


def months_before(day: Column, months: Column) -> Column:
    """A day from which exactly so many complete months have passed: the day before in that month, or the first."""
    at = F.year(day) * 12 + F.month(day) - 1 - months
    return F.make_date(
        F.floor(at / 12).cast("int"), (F.pmod(at, F.lit(12)) + 1).cast("int"), F.when(F.dayofmonth(day) == 1, 1).otherwise(F.dayofmonth(day) - 1)
    )


def styles(day: Column) -> dict[str, Column]:
    """A date in each of the written styles."""
    f = lambda p: F.date_format(day, p)
    return {
        "iso": f("yyyy-MM-dd"),
        "us": f("MMMM d, yyyy"),
        "uk": f("d MMMM yyyy"),
        "abbr": f("MMM d, yyyy"),
        "ord": F.concat(F.lit("the "), ordinal(F.dayofmonth(day)), F.lit(" of "), f("MMMM yyyy")),
        "wd": f("EEEE, MMMM d, yyyy"),
    }


# The days of the week from Monday in Chinese.
WEEKDAYS_ZH = ["星期一", "星期二", "星期三", "星期四", "星期五", "星期六", "星期日"]


def styles_zh(day: Column) -> dict[str, Column]:
    f = lambda p: F.date_format(day, p)
    weekday = F.element_at(F.array(*map(F.lit, WEEKDAYS_ZH)), F.weekday(day) + 1)
    return {
        "ymd": f("yyyy年M月d日"),
        "slash": f("yyyy/M/d"),
        "noyear": f("M月d日"),
        "zero": f("yyyy年MM月dd日"),
        "wd": F.concat(f("yyyy年M月d日"), F.lit("（"), weekday, F.lit("）")),
    }


def holiday_list(days: Column) -> Column:
    """The days in order, joined by commas."""
    return F.array_join(F.array_sort(F.transform(days, lambda d: F.date_format(d, "yyyy-MM-dd"))), ", ")


def holiday_list_zh(days: Column) -> Column:
    """In the order of their written forms."""
    return F.array_join(F.array_sort(F.transform(days, lambda d: F.date_format(d, "yyyy年M月d日"))), "、")
