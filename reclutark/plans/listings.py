"""Full listings of hires, leavers and vacancies as the data page shows them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from reclutark.functions import coerce, measures, predicates, text
from reclutark.operators import tableview
from reclutark.sources.tables import read_range

# Column titles of the listings, in the order shown.
HIRES = {
    "id": "ID",
    "fecha_alta": "Fecha de alta",
    "empresa_alta": "Empresa",
    "puesto_alta": "Puesto",
    "plaza_alta": "Plaza",
    "area_alta": "Función de área",
    "contratados_alta": "Contratados",
    "medio_reclutamiento_alta": "Medio de reclutamiento",
    "responsable_alta": "Responsable",
}
LEAVERS = {
    "id": "ID",
    "no_colaborador": "No. Colaborador",
    "nombre_completo": "Nombre",
    "empresa": "Empresa",
    "puesto": "Puesto",
    "plaza": "Plaza",
    "funcion_area": "Función de área",
    "departamento": "Departamento",
    "tipo_nomina": "Tipo de nómina",
    "fecha_ingreso": "Fecha de ingreso",
    "fecha_baja": "Fecha de baja",
    "motivo_baja": "Motivo de baja",
    "gerente": "Gerente",
    "jefe": "Jefe",
}
VACANCIES = {
    "id_sistema": "ID del Sistema",
    "fecha_solicitud": "Fecha de solicitud",
    "tipo_solicitud": "Tipo de solicitud",
    "estatus_solicitud": "Estatus de solicitud",
    "fase_proceso": "Fase del proceso",
    "fecha_avance": "Fecha del avance",
    "fecha_autorizacion": "Fecha de autorización",
    "puesto_vacante": "Puesto",
    "plaza_vacante": "Plaza",
    "empresa_vacante": "Empresa",
    "funcion_area_vacante": "Función de área",
    "vacantes_solicitadas": "Vacantes solicitadas",
    "vacantes_contratados": "Contratados",
    "responsable_vacante": "Responsable",
    "comentarios_vacante": "Comentarios",
    "tipo_reclutamiento_vacante": "Tipo de reclutamiento",
    "medio_reclutamiento_vacante": "Medio de reclutamiento",
    "fecha_cobertura": "Fecha de cobertura",
    "dias_cobertura": "Días de cobertura",
}


def hires(df: DataFrame) -> DataFrame:
    """All hires by id."""
    return tableview.rename(df.orderBy(F.asc_nulls_last("id")), HIRES)


def leavers(df: DataFrame, since: dt.date, until: dt.date | None = None) -> DataFrame:
    """Leavers from a day on with their full name, latest first."""
    named = read_range(df, "fecha_baja", since, until).withColumn(
        "nombre_completo", text.full_name(*[F.col(c) for c in ("nombre", "apellido_paterno", "apellido_materno")])
    )
    return tableview.rename(named.orderBy(F.desc_nulls_last("fecha_baja"), "id"), LEAVERS)


def vacancies(df: DataFrame, as_of: dt.date | None = None, tz_exact: bool = False) -> DataFrame:
    """Vacancies that are not confidential with their days of coverage, highest system id first."""
    dates = {c: coerce.lenient_date(F.col(c)) for c in ("fecha_solicitud", "fecha_autorizacion", "fecha_cobertura")}
    days = measures.listing_days(
        F.col("fecha_autorizacion"), F.col("fecha_solicitud"), F.col("fecha_cobertura"), as_of, tz_exact
    )
    shown = df.where(predicates.is_public()).withColumns(dates).withColumn("dias_cobertura", days)
    return tableview.rename(shown.orderBy(F.desc_nulls_last("id_sistema"), "id"), VACANCIES)
