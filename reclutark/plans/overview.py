"""Headline figures of the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reclutark import catalogs
from reclutark.functions import measures, predicates, text
from reclutark.functions.calendar import Period
from reclutark.functions.coerce import int_or_zero, lenient_int
from reclutark.operators import series
from reclutark.plans import hires as hires_plan
from reclutark.sources.tables import latest_snapshot


def leavers_total(leavers: DataFrame, period: Period = Period()) -> DataFrame:
    """Leavers with a valid id in the period."""
    return period.filter(leavers, "fecha_baja").where(predicates.valid_leaver_id()).agg(F.count("*").alias("bajas"))


def vacancy_figures(vacancies: DataFrame, period: Period = Period(), recruiter: str = "Todos") -> DataFrame:
    """Open positions today, requisitions and unrequisitioned vacancies of the period, in one pass.

    The open positions look at all vacancies; the other two at those authorised in the period, of the recruiter.
    """
    requested = int_or_zero(F.col("vacantes_solicitadas"))
    hired = lenient_int(F.col("vacantes_contratados"))
    counted = period.holds(F.col("fecha_autorizacion"))
    if recruiter != "Todos":
        counted = counted & text.any_word_is(F.col("responsable_vacante"), recruiter)
    open_authorised = predicates.is_open() & F.col("fecha_autorizacion").isNotNull()

    def total(condition: Column, value: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).alias(name)

    return vacancies.agg(
        total(open_authorised, requested, "vacantes"),
        total(counted, requested + hired, "requisiciones"),
        F.count_if(counted & (F.col("fase_proceso") == catalogs.NO_REQUISITION_STAGE)).alias("no_requisitadas"),
    )


def figures(
    hires: DataFrame,
    leavers: DataFrame,
    vacancies: DataFrame,
    snapshots: DataFrame,
    period: Period = Period(),
    recruiter: str = "Todos",
) -> DataFrame:
    """One row: hires, leavers, open positions and their change since the last snapshot, requisitions."""
    row = series.one_row(
        hires_plan.total(hires_plan.selected(hires, period, recruiter)),
        leavers_total(leavers, period),
        vacancy_figures(vacancies, period, recruiter),
        latest_snapshot(snapshots),
    )
    return row.withColumns(
        {
            "vacantes_variacion_pct": measures.change_pct(F.col("vacantes"), F.col("n_vacantes_anterior")),
            "contrataciones_pct": measures.ratio_pct(F.col("contratados"), F.col("requisiciones")),
        }
    )
