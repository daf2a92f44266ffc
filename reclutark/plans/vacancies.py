"""Vacancies: open ones by company, area and stage, ageing, closed means, pivot."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from reclutark import catalogs
from reclutark.functions import measures, predicates, text
from reclutark.functions.calendar import Period
from reclutark.functions.coerce import int_or_zero, lenient_int
from reclutark.operators import pivot
from reclutark.plans.hires import by_recruiter

OPENINGS = "vacantes_solicitadas"


def with_days(vacancies: DataFrame, as_of: dt.date | None = None, tz_exact: bool = False, name: str = "dias") -> DataFrame:
    """Vacancies with their days of coverage by the dashboard rule."""
    days = measures.coverage_days(
        F.col("fecha_autorizacion"), F.col("fecha_solicitud"), F.col("fecha_cobertura"),
        F.col("vacantes_contratados"), F.col(OPENINGS), as_of, tz_exact,
    )
    return vacancies.withColumn(name, days)


def open_now(vacancies: DataFrame) -> DataFrame:
    return vacancies.where(predicates.is_open())


def open_total(vacancies: DataFrame) -> DataFrame:
    """Openings of authorised open vacancies, a missing status or stage counting as open."""
    condition = predicates.is_open() & F.col("fecha_autorizacion").isNotNull()
    return vacancies.where(condition).agg(
        F.coalesce(F.sum(int_or_zero(F.col(OPENINGS))), F.lit(0)).alias("vacantes"), F.count("*").alias("registros")
    )


def open_total_for_capacity(vacancies: DataFrame) -> DataFrame:
    """Openings by the capacity model's reading of open."""
    return vacancies.where(predicates.is_open_for_capacity()).agg(
        F.coalesce(F.sum(int_or_zero(F.col(OPENINGS))), F.lit(0)).alias("vacantes"), F.count("*").alias("registros")
    )


def _area_is(area: str) -> Column:
    return F.col("funcion_area_vacante") == area


def open_age(vacancies: DataFrame, as_of: dt.date | None = None, tz_exact: bool = False) -> DataFrame:
    """Mean age in whole days of ageing vacancies: all, administrative, operative; 0 without rows.  One pass."""
    rows = with_days(vacancies.where(predicates.is_ageing()), as_of, tz_exact)

    def mean(days: Column, name: str) -> Column:
        return F.coalesce(F.bround(F.avg(days), 0), F.lit(0.0)).cast("bigint").alias(name)

    days = F.col("dias")
    return rows.agg(
        mean(days, "promedio"),
        mean(F.when(_area_is("ADMINISTRATIVA"), days), "promedio_administrativas"),
        mean(F.when(_area_is("OPERATIVA"), days), "promedio_operativas"),
    )


def closed_in(vacancies: DataFrame, period: Period = Period(), recruiter: str = "Todos") -> DataFrame:
    """Vacancies whose fill date is in the period, of one recruiter or all."""
    return by_recruiter(period.filter(vacancies, "fecha_cobertura"), "responsable_vacante", recruiter)


def closed_days(
    vacancies: DataFrame, goals: Mapping[str, float] = catalogs.GOAL_DAYS
) -> DataFrame:
    """Mean days from authorisation to fill of closed vacancies: all and per area, with the goal over the mean."""
    rows = vacancies.where(predicates.is_closed()).withColumn(
        "dias", measures.closed_days(F.col("fecha_autorizacion"), F.col("fecha_cobertura"))
    )
    means = [F.avg("dias").alias("promedio")]
    ratios = []
    for area in catalogs.AREAS:
        name = f"promedio_{area.lower()}s"
        means.append(F.avg(F.when(_area_is(area), F.col("dias"))).alias(name))
        ratios.append(measures.goal_pct(F.col(name), float(goals[area])).alias(f"meta_pct_{area.lower()}s"))
    return rows.agg(*means).select("*", *ratios)


def _with_authorised_openings(vacancies: DataFrame) -> DataFrame:
    return open_now(vacancies).where(predicates.has_authorised_openings())


def by_company(
    vacancies: DataFrame, names: Mapping[str, str] = catalogs.COMPANY_SHORT_NAMES
) -> DataFrame:
    """Authorised openings per company under its short name, most first."""
    short = text.short_company(F.col("empresa_vacante"), names)
    return _openings_by(vacancies, short, "empresa")


def by_area(vacancies: DataFrame) -> DataFrame:
    """Authorised openings per area, most first."""
    return _openings_by(vacancies, F.col("funcion_area_vacante"), "funcion_area")


def _openings_by(vacancies: DataFrame, key: Column, name: str) -> DataFrame:
    rows = _with_authorised_openings(vacancies).withColumn(name, key).where(F.col(name).isNotNull())
    return rows.groupBy(name).agg(F.sum(int_or_zero(F.col(OPENINGS))).alias("vacantes")).orderBy(
        F.desc("vacantes"), name
    )


def detail(vacancies: DataFrame, as_of: dt.date | None = None, tz_exact: bool = False) -> DataFrame:
    """Open authorised vacancies with their days, confidential positions masked, longest first."""
    rows = with_days(_with_authorised_openings(vacancies), as_of, tz_exact, "dias_cobertura")
    return rows.select(
        "id_sistema",
        F.col("fecha_autorizacion").cast("date").alias("fecha_autorizacion"),
        "empresa_vacante",
        text.mask_confidential(F.col("puesto_vacante"), F.col("confidencial")).alias("puesto_vacante"),
        "plaza_vacante",
        int_or_zero(F.col(OPENINGS)).alias(OPENINGS),
        "dias_cobertura",
        "fase_proceso",
    ).orderBy(F.desc_nulls_last("dias_cobertura"), "id_sistema")


def pivot_openings(
    vacancies: DataFrame, as_of: dt.date | None = None, limit: int = catalogs.LONG_FILL_DAYS, tz_exact: bool = False
) -> DataFrame:
    """Pivot of open vacancies by id, company and position: openings, mean days, long-fill flag, and totals.

    ``nivel`` counts the keys of a row: 3 for a cell, 2 and 1 for subtotals, 0 for the grand total.
    """
    rows = with_days(_with_authorised_openings(vacancies), as_of, tz_exact, "dias_cobertura").withColumn(
        "puesto_vacante", text.mask_confidential(F.col("puesto_vacante"), F.col("confidencial"))
    )
    totals = pivot.totals_rollup(
        rows,
        ["id_sistema", "empresa_vacante", "puesto_vacante"],
        {"vacantes": F.sum(int_or_zero(F.col(OPENINGS))), "dias_promedio": F.avg("dias_cobertura")},
    )
    return totals.withColumn("cobertura_larga", measures.long_fill(F.col("dias_promedio"), limit))


def stage_funnel(vacancies: DataFrame) -> DataFrame:
    """Open vacancies per stage before hiring, fewest first."""
    rows = open_now(vacancies).where(predicates.in_funnel())
    return rows.groupBy("fase_proceso").agg(F.count("*").alias("cantidad")).orderBy("cantidad", "fase_proceso")


def _hired_days(vacancies: DataFrame, as_of: dt.date | None, tz_exact: bool) -> DataFrame:
    return with_days(vacancies.where(lenient_int(F.col("vacantes_contratados")) > 0), as_of, tz_exact)


def days_by(vacancies: DataFrame, column: str, as_of: dt.date | None = None, tz_exact: bool = False) -> DataFrame:
    """Mean days of coverage of hired vacancies per site or position, longest first, with the rounded mean."""
    means = (
        _hired_days(vacancies, as_of, tz_exact).where(F.col(column).isNotNull())
        .groupBy(column).agg(F.avg("dias").alias("dias_promedio"))
    )
    return means.withColumn("dias", F.bround("dias_promedio", 0)).orderBy(F.desc_nulls_last("dias_promedio"), column)


def days_summary(
    vacancies: DataFrame, as_of: dt.date | None = None, goal: float = catalogs.SITE_GOAL_DAYS, tz_exact: bool = False
) -> DataFrame:
    """Overall mean against the goal, and the site and position with the longest mean; one row.

    One pass over the rows: sums and counts per (site, position), from which all means follow.
    """
    site, position = "plaza_vacante", "puesto_vacante"
    cells = _hired_days(vacancies, as_of, tz_exact).groupBy(site, position).agg(
        F.sum("dias").alias("_suma"), F.count("dias").alias("_n")
    )
    means = cells.groupingSets([[F.col(site)], [F.col(position)], []], site, position).agg(
        (F.sum("_suma") / F.when(F.sum("_n") > 0, F.sum("_n"))).alias("_dias"),
        F.grouping(site).alias("_g_plaza"),
        F.grouping(position).alias("_g_puesto"),
    )

    def longest(level: Column, name: str) -> Column:
        usable = level & F.col(name).isNotNull() & F.col("_dias").isNotNull()
        return F.min(F.when(usable, F.struct((-F.col("_dias")).alias("menos"), F.col(name).alias("nombre"))))

    is_site = (F.col("_g_plaza") == 0) & (F.col("_g_puesto") == 1)
    is_position = (F.col("_g_plaza") == 1) & (F.col("_g_puesto") == 0)
    is_all = (F.col("_g_plaza") == 1) & (F.col("_g_puesto") == 1)
    top = means.agg(
        F.max(F.when(is_all, F.col("_dias"))).alias("_todo"),
        longest(is_site, site).alias("_plaza"),
        longest(is_position, position).alias("_puesto"),
    )
    return top.select(
        F.bround("_todo", 0).alias("promedio_global"),
        F.lit(float(goal)).alias("meta"),
        F.col("_plaza.nombre").alias("plaza_mas_alta"),
        F.bround(-F.col("_plaza.menos"), 0).alias("plaza_mas_alta_dias"),
        F.col("_puesto.nombre").alias("puesto_mas_alto"),
        F.bround(-F.col("_puesto.menos"), 0).alias("puesto_mas_alto_dias"),
    )
