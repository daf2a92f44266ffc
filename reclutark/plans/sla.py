"""Service levels of hired vacancies and the capacity of the recruiting team."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reclutark import catalogs
from reclutark.functions import calendar, measures, predicates, text
from reclutark.functions.calendar import Period
from reclutark.functions.coerce import lenient_int
from reclutark.operators import series
from reclutark.plans.vacancies import open_total_for_capacity, with_days

AREAS = ("OPERATIVA", "ADMINISTRATIVA")


def sla_rows(
    vacancies: DataFrame, period: Period = Period(), as_of: dt.date | None = None, tz_exact: bool = False
) -> DataFrame:
    """Hired vacancies with valid days, by fill date of the period."""
    hired = vacancies.where(lenient_int(F.col("vacantes_contratados")) > 0)
    rows = with_days(period.filter(hired, "fecha_cobertura"), as_of, tz_exact)
    return rows.where(predicates.valid_sla_days())


def by_area(rows: DataFrame, goals: Mapping[str, float] = catalogs.GOAL_DAYS) -> DataFrame:
    """Per area: rows, share within the goal, mean days; 0 without rows, where "in goal" has no value."""
    spine = series.values_frame(rows.sparkSession, "area", AREAS)
    goal = F.create_map(*[F.lit(v) for area in AREAS for v in (area, float(goals[area]))])[F.col("area")]
    found = rows.select(F.col("funcion_area_vacante").alias("area"), "dias").where(F.col("area").isin(*AREAS))
    stats = (
        found.unionByName(spine.withColumn("dias", F.lit(None).cast("int")))
        .groupBy("area")
        .agg(
            F.count("dias").alias("registros"),
            F.coalesce(F.count_if(F.col("dias") <= goal) / F.nullif(F.count("dias"), F.lit(0)) * 100, F.lit(0.0))
            .alias("dentro_meta_pct"),
            F.coalesce(F.avg("dias"), F.lit(0.0)).alias("dias_promedio"),
        )
    )
    in_goal = F.when(F.col("registros") > 0, F.col("dias_promedio") <= goal)
    return stats.withColumns({"meta": goal, "en_meta": in_goal}).orderBy("area")


def _mean_for(area: str) -> Column:
    """Mean of one area, rounded to one digit; no value without rows."""
    mean = F.avg(F.when(F.col("funcion_area_vacante") == area, F.col("dias")))
    return F.bround(mean, 1).alias(area.lower())


def by_recruiter(rows: DataFrame, listed: Sequence[str] = catalogs.RECRUITERS) -> DataFrame:
    """Mean days per listed recruiter and area; a missing combination stays empty."""
    found = rows.select(
        text.first_listed_word(F.col("responsable_vacante"), listed).alias("ejecutivo"),
        "funcion_area_vacante",
        "dias",
    ).where(F.col("ejecutivo").isNotNull())
    spine = series.values_frame(rows.sparkSession, "ejecutivo", listed).select(
        "ejecutivo", F.lit(None).cast("string").alias("funcion_area_vacante"), F.lit(None).cast("int").alias("dias")
    )
    return found.unionByName(spine).groupBy("ejecutivo").agg(*[_mean_for(a) for a in AREAS]).orderBy("ejecutivo")


def monthly_trend(rows: DataFrame) -> DataFrame:
    """Mean days per fill month and area, gaps empty; rows without a fill date come last under no month."""
    month = calendar.year_month(F.col("fecha_cobertura")).alias("mes")
    return rows.groupBy(month).agg(*[_mean_for(a) for a in AREAS]).orderBy(F.asc_nulls_last("mes"))


def capacity(
    vacancies: DataFrame,
    activity_hours: Sequence[tuple[str, float]] = catalogs.ACTIVITY_HOURS,
    people: int = catalogs.TEAM_SIZE,
    hours: int = catalogs.HOURS_PER_DAY,
    days: int = catalogs.WORKDAYS_PER_MONTH,
) -> DataFrame:
    """Team hours, positions they can fill, and the open positions in percent of that, with its band."""
    per_position = sum(time for _, time in activity_hours)
    team_hours = people * hours * days
    efficiency = F.col("vacantes_activas") / F.col("capacidad_teorica") * 100
    return (
        open_total_for_capacity(vacancies)
        .select(
            F.col("vacantes").alias("vacantes_activas"),
            F.lit(team_hours).cast("bigint").alias("horas_trabajador"),
            (F.lit(float(team_hours)) / F.lit(per_position)).alias("capacidad_teorica"),
        )
        .withColumn("eficiencia_pct", efficiency)
        .withColumn("interpretacion", measures.efficiency_band(F.col("eficiencia_pct")))
    )


def activity_table(vacancies: DataFrame, activity_hours: Sequence[tuple[str, float]] = catalogs.ACTIVITY_HOURS) -> DataFrame:
    """Hours per activity for one position and for all open ones."""
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("orden"), F.lit(name).alias("actividad"), F.lit(time).alias("horas"))
            for i, (name, time) in enumerate(activity_hours, start=1)
        ]
    )
    return (
        open_total_for_capacity(vacancies)
        .select("vacantes", F.inline(pairs))
        .select("orden", "actividad", "horas", (F.col("horas") * F.col("vacantes")).alias("horas_requeridas"))
        .orderBy("orden")
    )
