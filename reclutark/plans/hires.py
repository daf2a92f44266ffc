"""Hires (altas): totals, breakdowns, pivot and detail."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reclutark import catalogs
from reclutark.functions import calendar, predicates, text
from reclutark.functions.calendar import Period
from reclutark.functions.coerce import strict_int
from reclutark.operators import pivot, series, tableview

COUNT = "contratados_alta"


def count_column() -> Column:
    """Hires of a row; stored as text."""
    return strict_int(F.col(COUNT))


def by_recruiter(df: DataFrame, column: str, choice: str = "Todos") -> DataFrame:
    """Rows of one recruiter, matched on any word of the name; "Todos" keeps all."""
    return df if choice == "Todos" else df.where(text.any_word_is(F.col(column), choice))


def selected(hires: DataFrame, period: Period = Period(), recruiter: str = "Todos") -> DataFrame:
    """Hires of a period and a recruiter."""
    return by_recruiter(period.filter(hires, "fecha_alta"), "responsable_alta", recruiter)


def positive(hires: DataFrame) -> DataFrame:
    """Rows with at least one hire, the count typed."""
    return hires.withColumn(COUNT, count_column()).where(F.col(COUNT) > 0)


def total(hires: DataFrame) -> DataFrame:
    return hires.agg(F.coalesce(F.sum(count_column()), F.lit(0)).alias("contratados"))


def _totals_by(hires: DataFrame, key: Column, name: str) -> DataFrame:
    """Sum per key; a missing key is no group."""
    return (
        positive(hires).withColumn(name, key).where(F.col(name).isNotNull())
        .groupBy(name).agg(F.sum(COUNT).alias("contratados"))
    )


def by_channel(hires: DataFrame) -> DataFrame:
    """Hires and share per recruiting channel, smallest first."""
    totals = _totals_by(hires, F.col("medio_reclutamiento_alta"), "medio_reclutamiento_alta")
    return series.with_share(totals, "contratados").orderBy("contratados", "medio_reclutamiento_alta")


def by_company(
    hires: DataFrame,
    companies: Sequence[str] | None = None,
    names: Mapping[str, str] = catalogs.COMPANY_SHORT_NAMES,
) -> DataFrame:
    """Hires per company under its short name, with the share within the chosen companies, smallest first."""
    totals = _totals_by(hires, text.short_company(F.col("empresa_alta"), names), "empresa_alta")
    chosen = totals.where(predicates.chosen(F.col("empresa_alta"), companies))
    return series.with_share(chosen, "contratados").orderBy("contratados", "empresa_alta")


def by_recruiter_and_area(
    hires: DataFrame,
    areas: Sequence[str] = ("OPERATIVA", "ADMINISTRATIVA"),
    aliases: Mapping[str, str] = catalogs.CHART_ALIASES,
) -> DataFrame:
    """Hires per recruiter nickname, one column per area, ordered by the total over all areas."""
    name = "ejecutivo"
    rows = (
        positive(hires)
        .withColumn(name, text.first_word_alias(F.col("responsable_alta"), aliases))
        .where(F.col(name).isNotNull() & F.col("area_alta").isNotNull())
    )
    sums = [
        F.coalesce(F.sum(F.when(F.col("area_alta") == area, F.col(COUNT))), F.lit(0)).alias(area.lower())
        for area in areas
    ]
    wide = rows.groupBy(name).agg(*sums, F.sum(COUNT).alias("_total"))
    return wide.orderBy("_total", name).drop("_total")


def by_month(hires: DataFrame) -> DataFrame:
    """Hires per calendar month, all years together; only months that occur, in calendar order."""
    totals = _totals_by(hires, calendar.month(F.col("fecha_alta")), "mes")
    return totals.select("mes", calendar.month_label(F.col("mes")).alias("nombre_mes"), "contratados").orderBy("mes")


def _paid() -> Column:
    return F.col("medio_reclutamiento_alta") == catalogs.PAID_MEDIA


def _operative() -> Column:
    return F.col("area_alta") == "OPERATIVA"


def _sum_if(condition: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(COUNT))), F.lit(0)).alias(name)


def paid_media_totals(hires: DataFrame) -> DataFrame:
    """Four totals in one pass: all, paid media, operative, operative by paid media."""
    return positive(hires).agg(
        _sum_if(F.lit(True), "contratados_totales"),
        _sum_if(_paid(), "contratados_redes_pagadas"),
        _sum_if(_operative(), "contratados_operativas"),
        _sum_if(_operative() & _paid(), "contratados_operativas_redes_pagadas"),
    )


def paid_media_monthly(hires: DataFrame) -> DataFrame:
    """Operative and paid-media hires per calendar month, lined up on the month; NULL where one has no rows."""
    month = calendar.month(F.col("fecha_alta"))
    return (
        positive(hires)
        .where((_operative() | _paid()) & F.col("fecha_alta").isNotNull())
        .groupBy(month.alias("mes"))
        .agg(
            F.sum(F.when(_operative(), F.col(COUNT))).alias("operativas"),
            F.sum(F.when(_paid(), F.col(COUNT))).alias("redes_pagadas"),
        )
        .select("mes", calendar.month_label(F.col("mes")).alias("nombre_mes"), "operativas", "redes_pagadas")
        .orderBy("mes")
    )


def pivot_cells(hires: DataFrame) -> DataFrame:
    """Pivot of dates by recruiter and area: hires and record count, with all totals, in long form."""
    rows = positive(hires).withColumn("_uno", F.when(F.col("id").isNotNull(), 1))
    return pivot.totals_cube(
        rows,
        ["fecha_alta"],
        ["responsable_alta", "area_alta"],
        {"contrataciones": F.col(COUNT), "registros": F.col("_uno")},
    )


def pivot_wide(hires: DataFrame, columns: Sequence[tuple[str | None, str | None]]) -> DataFrame:
    """The pivot as a table with a column per given (recruiter, area), a total column and a total row."""
    return pivot.wide_totals(
        pivot_cells(hires), "fecha_alta", columns, ["responsable_alta", "area_alta"], "contrataciones"
    )


def detail(hires: DataFrame) -> DataFrame:
    """Hires as the dashboard lists them: confidential positions masked, day only, ids and mark left out."""
    shown = hires.withColumns(
        {
            "puesto_alta": text.mask_confidential(F.col("puesto_alta"), F.col("confidencial")),
            "fecha_alta": F.col("fecha_alta").cast("date"),
        }
    )
    return tableview.rename(shown, DETAIL_COLUMNS)


# Column titles of the listings.
DETAIL_COLUMNS = {
    "fecha_alta": "Fecha de contratación",
    "empresa_alta": "Empresa",
    "puesto_alta": "Puesto",
    "plaza_alta": "Plaza",
    "area_alta": "Área",
    "contratados_alta": "Contratados",
    "medio_reclutamiento_alta": "Medio de reclutamiento",
    "responsable_alta": "Ejecutivo de reclutamiento",
}
