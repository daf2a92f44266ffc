"""Calendar parts, labels and closed date ranges."""

from __future__ import annotations

import calendar as _calendar
import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reclutark import catalogs

ALL, YEAR, QUARTER, MONTH, WEEK, RANGE = (
    "Todo el tiempo", "Por año", "Por trimestre", "Por mes", "Por semana", "Por rango de fechas",
)


def year(c: Column) -> Column:
    return F.year(c).cast("int")


def month(c: Column) -> Column:
    return F.month(c).cast("int")


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def month_label(month_number: Column, short: bool = False) -> Column:
    labels = catalogs.MONTHS_SHORT if short else catalogs.MONTHS
    return F.get(F.array(*[F.lit(label) for label in labels]), month_number - 1)


def iso_week_start(year_: Column, week: Column) -> Column:
    """Monday of an ISO week."""
    return F.date_add(F.trunc(F.make_date(year_, F.lit(1), F.lit(4)), "WEEK"), (week - 1) * 7)


def iso_weeks_in_year(year_: Column) -> Column:
    """52 or 53: the ISO week of 28 December."""
    return F.weekofyear(F.make_date(year_, F.lit(12), F.lit(28)))


def quarter_start(year_: Column, quarter: Column) -> Column:
    return F.make_date(year_, quarter * 3 - 2, F.lit(1))


def quarter_end(year_: Column, quarter: Column) -> Column:
    return F.last_day(F.add_months(quarter_start(year_, quarter), 2))


def clamped_date(year_: Column, month_: Column, day: Column) -> Column:
    """Date whose day is cut to the length of the month (29 February -> 28)."""
    first = F.make_date(year_, month_, F.lit(1))
    return F.make_date(year_, month_, F.least(day, F.day(F.last_day(first))))


def week_range(year_: int, week: int) -> tuple[dt.date, dt.date]:
    """Monday and Sunday of an ISO week; a week the year does not have is an error."""
    start = dt.date.fromisocalendar(int(year_), int(week), 1)
    return start, start + dt.timedelta(days=6)


def month_range(year_: int, month_: int) -> tuple[dt.date, dt.date]:
    last = _calendar.monthrange(year_, month_)[1]
    return dt.date(year_, month_, 1), dt.date(year_, month_, last)


def quarter_range(year_: int, quarter: int) -> tuple[dt.date, dt.date]:
    if int(quarter) not in (1, 2, 3, 4):
        raise ValueError(f"quarter must be 1 to 4, got {quarter}")
    last_month = int(quarter) * 3
    return dt.date(int(year_), last_month - 2, 1), month_range(int(year_), last_month)[1]


@dataclass(frozen=True)
class Period:
    """A reporting period.  ``mode`` is one of the six menu entries.

    A mode whose arguments are missing filters nothing, unless ``strict`` is set, which makes it an error.
    """

    mode: str = ALL
    year: int | None = None
    month: int | None = None
    week: int | None = None
    quarter: int | None = None
    start: dt.date | None = None
    end: dt.date | None = None
    strict: bool = False

    def bounds(self) -> tuple[dt.date, dt.date] | None:
        """First and last day, or None for no filter."""
        if self.mode == YEAR and self.year:
            return dt.date(self.year, 1, 1), dt.date(self.year, 12, 31)
        if self.mode == QUARTER and self.year and self.quarter:
            return quarter_range(self.year, self.quarter)
        if self.mode == MONTH and self.year and self.month:
            return month_range(self.year, self.month)
        if self.mode == WEEK and self.year and self.week:
            return week_range(self.year, self.week)
        if self.mode == RANGE and self.start and self.end:
            return self.start, self.end
        if self.strict and self.mode != ALL:
            raise ValueError(f"period {self.mode!r} lacks its arguments")
        return None

    def holds(self, date: Column) -> Column:
        """Condition on a date or timestamp column; a plain range, so that it reaches the scan."""
        bounds = self.bounds()
        return F.lit(True) if bounds is None else in_range(date, *bounds)

    def filter(self, df: DataFrame, column: str) -> DataFrame:
        """Rows inside the period; every filter but "all time" drops rows without a date."""
        return df if self.bounds() is None else df.where(self.holds(F.col(column)))


def in_range(date: Column, start: dt.date, end: dt.date) -> Column:
    """Both ends included; a timestamp counts by its day."""
    return date.cast("date").between(F.lit(start), F.lit(end))


def same_window(
    years: Iterable[int], first: tuple[int, int], last: tuple[int, int]
) -> list[tuple[int, dt.date, dt.date]]:
    """The same (month, day) window in each year, with the day cut to the length of the month."""

    def day_of(year_: int, month_day: tuple[int, int]) -> dt.date:
        month_, day = month_day
        return dt.date(year_, month_, min(day, _calendar.monthrange(year_, month_)[1]))

    return [(y, day_of(y, first), day_of(y, last)) for y in years]


def windows_frame(spark: SparkSession, windows: Iterable[tuple[int, dt.date, dt.date]]) -> DataFrame:
    """Windows as rows (anio, fecha_ini, fecha_fin); inline values, so the planner knows they are few."""
    rows = ", ".join(f"({y}, DATE'{start}', DATE'{end}')" for y, start, end in windows)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS w(anio, fecha_ini, fecha_fin)")
