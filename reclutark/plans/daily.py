"""Daily totals that add up: kept beside the tables, moved on by each import, and summed by windows and ranges.

A row is a part of a sum (dia, tabla, tipo, area, medio, responsable, cantidad); rows with the same keys add up, and a part may be negative.  So a change of
the tables is the parts of its new rows less those of the rows that it replaces: nothing stored is rewritten, and only rows of the change are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reclutark.functions import calendar, predicates
from reclutark.functions.coerce import lenient_int
from reclutark.operators import series
from reclutark.plans import annual, hires as _hires

KEYS = ("dia", "tabla", "tipo", "area", "medio", "responsable")
HIRES, VACANCIES = "altas", "vacantes"


def _added(rows: DataFrame, amount: Column, **keys: Column) -> DataFrame:
    named = {k: keys.get(k, F.lit(None).cast("string")) for k in KEYS}
    return rows.select(*[c.alias(k) for k, c in named.items()], amount.alias("cantidad")).where(F.col("dia").isNotNull()).groupBy(*KEYS).agg(F.sum("cantidad").alias("cantidad"))


def of_hires(hires: DataFrame) -> DataFrame:
    """Daily parts of hires, by area, channel and recruiter as stored."""
    return _added(
        hires, _hires.count_column(), dia=F.col("fecha_alta").cast("date"), tabla=F.lit(HIRES), area=F.col("area_alta"),
        medio=F.col("medio_reclutamiento_alta"), responsable=F.col("responsable_alta"),
    )


def of_vacancies(vacancies: DataFrame) -> DataFrame:
    """Daily parts of hired vacancies, by request type, area and recruiter as stored; the day is that of the request."""
    rows = vacancies.where(predicates.is_hired())
    return _added(
        rows, lenient_int(F.col("vacantes_contratados")), dia=F.col("fecha_solicitud").cast("date"), tabla=F.lit(VACANCIES), tipo=F.col("tipo_solicitud"),
        area=F.col("funcion_area_vacante"), medio=F.col("medio_reclutamiento_vacante"), responsable=F.col("responsable_vacante"),
    )


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """Parts that lead from the old rows' sums to the new ones'; days that don't change have none."""
    both = new.unionByName(old.withColumn("cantidad", -F.col("cantidad")))
    return both.groupBy(*KEYS).agg(F.sum("cantidad").alias("cantidad")).where(F.col("cantidad") != 0)


def merged(parts: DataFrame) -> DataFrame:
    """One row per key, as a stored table of parts is written anew now and then."""
    return parts.groupBy(*KEYS).agg(F.sum("cantidad").alias("cantidad")).where(F.col("cantidad") != 0)


def window_totals(parts: DataFrame, windows: Sequence[annual.YearWindow]) -> DataFrame:
    """:func:`annual.window_totals` from daily parts: hires, new and replacement vacancies per window, 0 where none."""
    frame = calendar.windows_frame(parts.sparkSession, windows)
    first, last = min(w[1] for w in windows), max(w[2] for w in windows)
    zero = F.lit(0).cast("bigint")

    def of(condition: Column, name: str) -> Column:
        return F.when(condition, F.col("cantidad")).otherwise(zero).alias(name)

    of_type = F.col("tabla") == VACANCIES
    rows = series.join_windows(parts.where(calendar.in_range(F.col("dia"), first, last)), frame, "dia").select(
        "anio", of(F.col("tabla") == HIRES, "contratados"), of(of_type & (F.col("tipo") == "NUEVO"), "nuevas"), of(of_type & (F.col("tipo") == "REEMPLAZO"), "reemplazos")
    )
    names = ("contratados", "nuevas", "reemplazos")
    rows = rows.unionByName(frame.select("anio", *[zero.alias(c) for c in names]))
    return rows.groupBy("anio").agg(*[F.sum(c).alias(c) for c in names]).orderBy("anio")


def window_monthly(parts: DataFrame, windows: Sequence[annual.YearWindow]) -> DataFrame:
    """:func:`annual.window_monthly` from daily parts."""
    return annual.window_monthly(_as_hires(parts), windows)


def window_recruiters(parts: DataFrame, windows: Sequence[annual.YearWindow]) -> DataFrame:
    """:func:`annual.window_recruiters` from daily parts."""
    return annual.window_recruiters(_as_hires(parts), windows)


def yearly(parts: DataFrame) -> DataFrame:
    """:func:`annual.yearly` from daily parts."""
    return annual.yearly(_as_hires(parts))


def _as_hires(parts: DataFrame) -> DataFrame:
    """Parts of hires under the columns of the hires; counts are added up by the same plans."""
    return parts.where(F.col("tabla") == HIRES).select(
        F.col("dia").alias("fecha_alta"), F.col("cantidad").alias(_hires.COUNT), F.col("area").alias("area_alta"), F.col("medio").alias("medio_reclutamiento_alta"),
        F.col("responsable").alias("responsable_alta"),
    )
