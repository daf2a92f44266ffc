"""Annual comparison: years, months and recruiters, free ranges, the same window in several years."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reclutark import catalogs
from reclutark.functions import calendar, predicates, text
from reclutark.functions.coerce import lenient_int
from reclutark.operators import series
from reclutark.plans.hires import count_column

MONTHS = range(1, 13)
YearWindow = tuple[int, dt.date, dt.date]


def _year() -> Column:
    return calendar.year(F.col("fecha_alta"))


def _month() -> Column:
    return calendar.month(F.col("fecha_alta"))


def _with_month_name(df: DataFrame) -> DataFrame:
    return df.withColumn("nombre_mes", calendar.month_label(F.col("mes"), short=True))


def of_area(df: DataFrame, column: str, area: str | None) -> DataFrame:
    return df.where(predicates.area_is(column, area))


def yearly(hires: DataFrame) -> DataFrame:
    """Hires per year with the change against exactly the year before."""
    rows = hires.where(F.col("fecha_alta").isNotNull())
    totals = rows.groupBy(_year().alias("anio")).agg(F.sum(count_column()).alias("contratados"))
    return series.year_over_year(totals, "contratados").orderBy("anio")


def monthly_of_year(hires: DataFrame, year: int) -> DataFrame:
    """Hires of all twelve months of one year; nothing if the year has no rows."""
    rows = hires.where(calendar.in_range(F.col("fecha_alta"), dt.date(year, 1, 1), dt.date(year, 12, 31)))
    filled = series.dense_by_category(
        rows.withColumn("anio", _year()), ["anio"], _month(), MONTHS, count_column(), "mes", "contratados"
    )
    return _with_month_name(filled).orderBy("mes")


def monthly_grid(hires: DataFrame) -> DataFrame:
    """Hires of every month of every year that has rows; nothing with fewer than two years."""
    rows = hires.where(F.col("fecha_alta").isNotNull()).withColumn("anio", _year())
    wide = series.sum_by_category(rows, ["anio"], _month(), MONTHS, count_column())
    # One row per calendar year at this point, so counting them in one window is cheap and reads nothing twice.
    years = wide.withColumn("_anios", F.count("*").over(Window.partitionBy())).where(F.col("_anios") >= 2)
    return _with_month_name(series.to_long(years, ["anio"], MONTHS, "mes", "contratados")).orderBy("anio", "mes")


def new_and_replacement(
    vacancies: DataFrame, first_year: int = 2024, types: Sequence[str] = catalogs.REQUEST_TYPES[:2]
) -> DataFrame:
    """Hired vacancies per request type and year, 0 where a type has none, with the yearly change."""
    rows = vacancies.where(predicates.is_hired() & (F.col("fecha_solicitud") >= F.lit(dt.date(first_year, 1, 1))))
    filled = series.dense_by_category(
        rows.withColumn("anio", calendar.year(F.col("fecha_solicitud"))),
        ["anio"], F.col("tipo_solicitud"), types, lenient_int(F.col("vacantes_contratados")),
        "tipo_solicitud", "contratados",
    )
    return series.year_over_year(filled, "contratados", by=["tipo_solicitud"]).orderBy("tipo_solicitud", "anio")


def _with_recruiter(hires: DataFrame, listed: Sequence[str]) -> DataFrame:
    found = text.first_listed_word(F.col("responsable_alta"), listed)
    return hires.withColumn("ejecutivo", found).where(F.col("ejecutivo").isNotNull())


def recruiters_by_year(hires: DataFrame, listed: Sequence[str] = catalogs.RECRUITERS) -> DataFrame:
    """Hires of each listed recruiter in every year that has rows of any of them."""
    rows = _with_recruiter(hires.where(F.col("fecha_alta").isNotNull()), listed).withColumn("anio", _year())
    return series.dense_by_category(
        rows, ["anio"], F.col("ejecutivo"), listed, count_column(), "ejecutivo", "contratados"
    ).orderBy("anio", "ejecutivo")


def _hired_in(date: str, windows: DataFrame, rows: DataFrame, bounds: tuple[dt.date, dt.date]) -> DataFrame:
    return series.join_windows(rows.where(calendar.in_range(F.col(date), *bounds)), windows, date)


def _bounds(windows: Sequence[YearWindow]) -> tuple[dt.date, dt.date]:
    return min(start for _, start, _ in windows), max(end for _, _, end in windows)


def window_totals(hires: DataFrame, vacancies: DataFrame, windows: Sequence[YearWindow]) -> DataFrame:
    """Hires, new and replacement vacancies per window; 0 where a window has none."""
    frame = calendar.windows_frame(hires.sparkSession, windows)
    bounds = _bounds(windows)
    hired = _hired_in("fecha_alta", frame, hires, bounds).select(
        "anio", count_column().alias("contratados"), F.lit(0).cast("bigint").alias("nuevas"),
        F.lit(0).cast("bigint").alias("reemplazos"),
    )
    count = lenient_int(F.col("vacantes_contratados"))

    def of_type(name: str) -> Column:
        return F.when(F.col("tipo_solicitud") == name, count).otherwise(F.lit(0)).cast("bigint")

    filled = _hired_in("fecha_solicitud", frame, vacancies.where(predicates.is_hired()), bounds).select(
        "anio", F.lit(0).cast("bigint").alias("contratados"),
        of_type("NUEVO").alias("nuevas"), of_type("REEMPLAZO").alias("reemplazos"),
    )
    zeros = frame.select("anio", *[F.lit(0).cast("bigint").alias(c) for c in ("contratados", "nuevas", "reemplazos")])
    rows = hired.unionByName(filled).unionByName(zeros)
    return rows.groupBy("anio").agg(
        *[F.sum(c).alias(c) for c in ("contratados", "nuevas", "reemplazos")]
    ).orderBy("anio")


def window_monthly(hires: DataFrame, windows: Sequence[YearWindow]) -> DataFrame:
    """Hires per month and window, 0 where none; the months shown are those of the first window."""
    spark = hires.sparkSession
    frame = calendar.windows_frame(spark, windows)
    months = list(range(windows[0][1].month, windows[0][2].month + 1))
    rows = (
        _hired_in("fecha_alta", frame, hires, _bounds(windows))
        .select("anio", _month().alias("mes"), count_column().alias("contratados"))
        .where(F.col("mes").isin(months))
    )
    spine = frame.select("anio", F.explode(_literals(months)).alias("mes"))
    return _with_month_name(series.zero_filled_sum(rows, spine, ["anio", "mes"], "contratados")).orderBy("anio", "mes")


def window_recruiters(
    hires: DataFrame, windows: Sequence[YearWindow], listed: Sequence[str] = catalogs.RECRUITERS
) -> DataFrame:
    """Hires per listed recruiter and window, 0 where none."""
    frame = calendar.windows_frame(hires.sparkSession, windows)
    rows = _hired_in("fecha_alta", frame, _with_recruiter(hires, listed), _bounds(windows)).select(
        "anio", "ejecutivo", count_column().alias("contratados")
    )
    spine = frame.select("anio", F.explode(_literals(listed)).alias("ejecutivo"))
    return series.zero_filled_sum(rows, spine, ["anio", "ejecutivo"], "contratados").orderBy("anio", "ejecutivo")


def _literals(values: Sequence[int | str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<int>")


def range_totals(hires: DataFrame, vacancies: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Hires, new and replacement vacancies between two days."""
    return window_totals(hires, vacancies, [(start.year, start, end)]).drop("anio")


def range_monthly(hires: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Hires per month number of a range, 0 where none; nothing if the range has no rows."""
    months = list(range(start.month, end.month + 1))
    rows = (
        hires.where(calendar.in_range(F.col("fecha_alta"), start, end))
        .select(F.lit(1).alias("_todo"), _month().alias("mes"), count_column().alias("contratados"))
    )
    if not months:
        return _with_month_name(rows.select("mes", "contratados").where(F.lit(False)))
    filled = series.dense_by_category(
        rows, ["_todo"], F.col("mes"), months, F.col("contratados"), "mes", "contratados"
    )
    return _with_month_name(filled.drop("_todo")).orderBy("mes")


def range_recruiters(
    hires: DataFrame, start: dt.date, end: dt.date, listed: Sequence[str] = catalogs.RECRUITERS
) -> DataFrame:
    """Hires per listed recruiter in a range, 0 where none; nothing if none of them has rows."""
    rows = _with_recruiter(hires.where(calendar.in_range(F.col("fecha_alta"), start, end)), listed)
    return series.dense_by_category(
        rows.withColumn("_todo", F.lit(1)), ["_todo"], F.col("ejecutivo"), listed, count_column(),
        "ejecutivo", "contratados",
    ).drop("_todo").orderBy("ejecutivo")


def years_of(df: DataFrame, date: str, first_year: int | None = None) -> DataFrame:
    """Calendar years of a column, ascending."""
    years = df.where(F.col(date).isNotNull()).select(calendar.year(F.col(date)).alias("anio")).distinct()
    return (years if first_year is None else years.where(F.col("anio") >= first_year)).orderBy("anio")


def years_available(
    dates: Sequence[tuple[DataFrame, Sequence[str]]], as_of: dt.date | None = None
) -> DataFrame:
    """Years of all given date columns together, latest first; the current year if there are none.

    Each table is read once for all its date columns.  The collected set has at most one entry per calendar
    year.
    """
    parts = [
        df.select(F.explode(F.array(*[calendar.year(F.col(c)) for c in columns])).alias("anio")).distinct()
        for df, columns in dates
    ]
    years = parts[0]
    for part in parts[1:]:
        years = years.unionByName(part)
    current = calendar.year(F.current_date() if as_of is None else F.lit(as_of))
    found = years.where(F.col("anio").isNotNull()).agg(F.collect_set("anio").alias("anios"))
    shown = F.when(F.size("anios") > 0, F.col("anios")).otherwise(F.array(current))
    return found.select(F.explode(shown).alias("anio")).orderBy(F.desc("anio"))
