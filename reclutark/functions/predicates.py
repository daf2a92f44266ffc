"""Lifecycle conditions.  Two readings of "open" exist side by side and differ on missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from reclutark import catalogs
from reclutark.functions.coerce import int_or_zero, lenient_int
from reclutark.functions.measures import not_authorised_date


def _not_in_or_missing(c: Column, values: Sequence[str]) -> Column:
    return c.isNull() | ~c.isin(list(values))


def is_open(
    status: str = "estatus_solicitud",
    stage: str = "fase_proceso",
    closed: Sequence[str] = catalogs.CLOSED_STATUSES,
) -> Column:
    """Open on the dashboard: a missing status or stage does not close a vacancy."""
    return _not_in_or_missing(F.col(status), closed) & _not_in_or_missing(F.col(stage), [catalogs.HIRED_STAGE])


def is_open_for_capacity(closed: Sequence[str] = catalogs.CAPACITY_CLOSED_STATUSES) -> Column:
    """Open for the capacity model, in SQL logic: a missing status or stage drops the row; must be authorised."""
    return (
        (F.col("fase_proceso") != catalogs.HIRED_STAGE)
        & ~F.col("estatus_solicitud").isin(list(closed))
        & F.col("fecha_autorizacion").isNotNull()
    )


def is_ageing(area: str | None = None) -> Column:
    """Open with a true authorisation date, of one area or any."""
    condition = is_open() & (F.col("fecha_autorizacion") != not_authorised_date())
    return condition if area is None else condition & (F.col("funcion_area_vacante") == area)


def has_authorised_openings() -> Column:
    return (int_or_zero(F.col("vacantes_solicitadas")) > 0) & F.col("fecha_autorizacion").isNotNull()


def in_funnel(excluded: Sequence[str] = catalogs.FUNNEL_EXCLUDED_STATUSES) -> Column:
    """At a known stage before hiring, authorised, with openings; a missing status does not exclude."""
    return (
        (F.col("fase_proceso") != catalogs.HIRED_STAGE)
        & _not_in_or_missing(F.col("estatus_solicitud"), excluded)
        & has_authorised_openings()
    )


def is_hired() -> Column:
    return F.col("fase_proceso") == catalogs.HIRED_STAGE


def is_closed(area: str | None = None) -> Column:
    """Hired with a fill date and a true authorisation date, of one area or any."""
    condition = (
        F.col("fecha_cobertura").isNotNull()
        & (F.col("fecha_autorizacion") != not_authorised_date())
        & (lenient_int(F.col("vacantes_contratados")) > 0)
    )
    return condition if area is None else condition & (F.col("funcion_area_vacante") == area)


def is_public(flag: str = "confidencial") -> Column:
    """Not marked confidential; a missing mark is public."""
    return _not_in_or_missing(F.col(flag), ["SI"])


def area_is(column: str, area: str | None) -> Column:
    """One area, or all for None / "Todas"."""
    return F.lit(True) if area in (None, "Todas") else F.col(column) == area


def chosen(c: Column, values: Sequence[str] | None) -> Column:
    """Multi-select: None is no filter, an empty choice matches nothing."""
    if values is None:
        return F.lit(True)
    return c.isin(list(values)) if len(values) else F.lit(False)


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def valid_leaver_id(column: str = "id") -> Column:
    return F.col(column) > 0


def valid_sla_days(column: str = "dias") -> Column:
    return F.col(column) >= 0
