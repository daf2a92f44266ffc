"""Checking SQL for the named queries, for DuckDB over the same test tables."""

from __future__ import annotations

import re

from reclutark import catalogs
from reclutark.sources import fixtures as fx

_LOOKUPS = "orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"

_SOURCES = {
    "altas": (fx.ALTAS, _LOOKUPS),
    "vacantes": (fx.VACANTES, _LOOKUPS),
    "registros_rh": (fx.REGISTROS_RH, _LOOKUPS),
    "importacion": (fx.IMPORT_STAGING, "orders"),
    "bajas_sistema": (fx.BAJAS_SISTEMA, "events"),
    "bajas": (fx.BAJAS, "events"),
    "respuestas": (fx.RESPUESTAS, "events"),
    "contestaciones": (fx.REPLIES, "events"),
    "fechas": (fx.DATE_TEXTS, "orders"),
    "lineas_csv": (fx.DROPPED_LINES, "orders"),
    "colaboradores": (fx.COLABORADORES_ACTIVOS, "customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "catalogo": (fx.CATALOGO_DOCUMENTOS, "(SELECT DISTINCT l_linenumber FROM lineitem) AS l"),
    "archivos": (fx.ARCHIVOS_EXPEDIENTES, "lineitem JOIN orders ON l_orderkey = o_orderkey"),
}

_CTES = {
    name: f"{name} AS (SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in table.items()) + f" FROM {source})"
    for name, (table, source) in _SOURCES.items()
}
_CTES["snapshot"] = (
    "snapshot AS (SELECT COUNT(*) AS n_vacantes, week(o_orderdate) AS semana_iso, year(o_orderdate) AS anio FROM orders GROUP BY 2, 3)"
)
_LONG_KEYS = "importacion AS (SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in fx.IMPORT_LONG_KEYS.items()) + " FROM orders)"
# Rows of a drop folder are numbered in the order in which they were written.
_NUMBERED = _CTES["importacion"].replace(
    "importacion AS (SELECT", "importacion AS (SELECT * REPLACE (row_number() OVER (ORDER BY row_idx) - 1 AS row_idx) FROM (SELECT", 1
) + ")"

_AS_OF = "DATE '2001-12-31'"
_HIRES = "CAST(contratados_alta AS BIGINT)"
_HIRED = "COALESCE(TRY_CAST(vacantes_contratados AS BIGINT), 0)"
_OPENINGS = "CAST(vacantes_solicitadas AS BIGINT)"
_OPEN = (
    "(estatus_solicitud IS NULL OR estatus_solicitud NOT IN ('CANCELADO', 'FINALIZADO', 'PAUSADO')) "
    "AND (fase_proceso IS NULL OR fase_proceso <> 'CONTRATADO')"
)
_OPEN_CAPACITY = (
    "fase_proceso <> 'CONTRATADO' AND estatus_solicitud NOT IN ('FINALIZADO', 'PAUSADO', 'CANCELADO', 'RECHAZADA') "
    "AND fecha_autorizacion IS NOT NULL"
)
_AUTHORISED_OPENINGS = "vacantes_solicitadas > 0 AND fecha_autorizacion IS NOT NULL"
_START = "COALESCE(fecha_autorizacion, fecha_solicitud)"
_END = (
    f"CASE WHEN {_HIRED} > 0 AND fecha_cobertura IS NOT NULL THEN fecha_cobertura "
    f"WHEN vacantes_solicitadas > 0 THEN {_AS_OF} END"
)
_DAYS = (
    f"CASE WHEN fecha_autorizacion = DATE '1900-01-01' THEN 1 "
    f"ELSE CAST(date_diff('day', {_START}, {_END}) AS INT) END"
)
_DAYS_TZ = (
    "CASE WHEN fecha_autorizacion = DATE '1900-01-01' THEN 1 ELSE CAST(floor(("
    f"epoch(CAST({_END} AS TIMESTAMP) AT TIME ZONE 'America/Mexico_City') - "
    f"epoch(CAST({_START} AS TIMESTAMP) AT TIME ZONE 'America/Mexico_City')) / 86400) AS INT) END"
)
_MASKED = "CASE WHEN confidencial = 'SI' THEN 'VACANTE' ELSE {0} END"
_WORDS = "string_split_regex(upper(trim({0})), '\\s+')"
_LISTED = "list_filter(" + _WORDS + ", lambda w: w IN ('DIEGO', 'YULIANA', 'LETICIA', 'ELENA'))[1]"
_HELEN = "list_has_any(" + _WORDS + ", ['MARTA', 'ELENA', 'HELEN'])"


def _month(column: str, labels: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{m}'" for m in labels) + f"][{column}]"


_LONG_MONTH = _month("mes", catalogs.MONTHS)
_SHORT_MONTH = _month("mes", catalogs.MONTHS_SHORT)


def _sql(body: str, *names: str) -> str:
    return "WITH " + ", ".join(_CTES[n] for n in names) + " " + body


def _period(hires_where: str, leavers_where: str) -> str:
    return _sql(
        f"SELECT (SELECT CAST(COALESCE(SUM({_HIRES}), 0) AS BIGINT) FROM altas WHERE {hires_where}) AS contratados, "
        f"(SELECT COUNT(*) FROM bajas_sistema WHERE id > 0 AND {leavers_where}) AS bajas",
        "altas", "bajas_sistema",
    )


def _share_by(key: str, where: str, name: str, having: str = "TRUE") -> str:
    return _sql(
        f", t AS (SELECT {key} AS {name}, CAST(SUM({_HIRES}) AS BIGINT) AS contratados FROM altas "
        f"WHERE {_HIRES} > 0 AND {where} GROUP BY 1 HAVING {key} IS NOT NULL AND {having}) "
        f"SELECT {name}, contratados, contratados / (SELECT SUM(contratados) FROM t)::BIGINT * 100 AS porcentaje FROM t",
        "altas",
    )


_QUARTER = "fecha_alta BETWEEN DATE '1998-04-01' AND DATE '1998-06-30'"
_IN_1998 = "BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
_IN_RANGE = "BETWEEN DATE '1998-02-10' AND DATE '1998-11-05'"

_WINDOWS = (
    "w AS (SELECT * FROM (VALUES (1996, DATE '1996-02-29', DATE '1996-08-15'), "
    "(1997, DATE '1997-02-28', DATE '1997-08-15'), (1998, DATE '1998-02-28', DATE '1998-08-15')) AS v(anio, fi, ff))"
)


def _yearly(where: str) -> str:
    return _sql(
        ", t AS (SELECT CAST(year(fecha_alta) AS INT) AS anio, "
        f"CAST(SUM({_HIRES}) AS BIGINT) AS contratados FROM altas WHERE fecha_alta IS NOT NULL AND {where} GROUP BY 1) "
        "SELECT t.anio, t.contratados, CASE WHEN p.contratados > 0 "
        "THEN (t.contratados - p.contratados) / p.contratados * 100 END AS variacion_pct "
        "FROM t LEFT JOIN t AS p ON p.anio = t.anio - 1",
        "altas",
    )


def _closed(where: str) -> str:
    return _sql(
        ", d AS (SELECT funcion_area_vacante AS area, "
        "CASE WHEN date_diff('day', fecha_autorizacion, fecha_cobertura) >= 0 "
        "THEN date_diff('day', fecha_autorizacion, fecha_cobertura) END AS dias FROM vacantes "
        f"WHERE {_HIRED} > 0 AND fecha_cobertura IS NOT NULL AND fecha_autorizacion <> DATE '1900-01-01' AND {where}), "
        "m AS (SELECT AVG(dias) AS promedio, AVG(dias) FILTER (area = 'ADMINISTRATIVA') AS promedio_administrativas, "
        "AVG(dias) FILTER (area = 'OPERATIVA') AS promedio_operativas FROM d) "
        "SELECT *, CASE WHEN promedio_administrativas > 0 THEN 45.0::DOUBLE / promedio_administrativas * 100 END "
        "AS meta_pct_administrativas, CASE WHEN promedio_operativas > 0 "
        "THEN 15.0::DOUBLE / promedio_operativas * 100 END AS meta_pct_operativas FROM m",
        "vacantes",
    )


def _openings(key: str, name: str) -> str:
    return _sql(
        f"SELECT {key} AS {name}, CAST(SUM({_OPENINGS}) AS BIGINT) AS vacantes FROM vacantes "
        f"WHERE {_OPEN} AND {_AUTHORISED_OPENINGS} AND {key} IS NOT NULL GROUP BY 1",
        "vacantes",
    )


def _days_by(column: str, where: str, days: str = _DAYS) -> str:
    return _sql(
        f", d AS (SELECT {column}, {days} AS dias FROM vacantes WHERE {_HIRED} > 0 AND {where}) "
        f"SELECT {column}, AVG(dias) AS dias_promedio, round_even(AVG(dias), 0) AS dias FROM d "
        f"WHERE {column} IS NOT NULL GROUP BY 1",
        "vacantes",
    )


def _pivot_openings(days: str) -> str:
    return _sql(
        f", d AS (SELECT id_sistema, empresa_vacante, {_MASKED.format('puesto_vacante')} AS puesto_vacante, "
        f"{_OPENINGS} AS n, {days} AS dias FROM vacantes WHERE {_OPEN} AND {_AUTHORISED_OPENINGS}) "
        "SELECT id_sistema, empresa_vacante, puesto_vacante, CAST(SUM(n) AS BIGINT) AS vacantes, "
        "AVG(dias) AS dias_promedio, CAST(3 - GROUPING(id_sistema) - GROUPING(empresa_vacante) "
        "- GROUPING(puesto_vacante) AS INT) AS nivel, AVG(dias) > 15 AS cobertura_larga "
        "FROM d GROUP BY ROLLUP (id_sistema, empresa_vacante, puesto_vacante)",
        "vacantes",
    )


def _sla(where: str, body: str) -> str:
    return _sql(
        f", s AS (SELECT * FROM (SELECT *, {_DAYS} AS dias FROM vacantes WHERE {_HIRED} > 0 AND {where}) "
        f"WHERE dias >= 0) {body}",
        "vacantes",
    )


def _means_by_area() -> str:
    return (
        "round_even(AVG(dias) FILTER (funcion_area_vacante = 'OPERATIVA'), 1) AS operativa, "
        "round_even(AVG(dias) FILTER (funcion_area_vacante = 'ADMINISTRATIVA'), 1) AS administrativa"
    )


_REQUIRED = "(SELECT id FROM catalogo WHERE requerido)"
_DELIVERED = (
    f"e AS (SELECT DISTINCT id_colaborador, id_documento FROM archivos WHERE estatus_pdf "
    f"AND id_documento IN {_REQUIRED}), "
    "n AS (SELECT id_colaborador, COUNT(DISTINCT id_documento) AS documentos FROM e GROUP BY 1), "
    f"c AS (SELECT id_colaborador FROM n WHERE documentos >= (SELECT COUNT(*) FROM {_REQUIRED}))"
)


def _grid(order: str, page: str) -> str:
    return _sql(
        ", f AS (SELECT id, id_sistema, puesto_vacante, estatus_solicitud, funcion_area_vacante, fecha_solicitud "
        "FROM vacantes WHERE funcion_area_vacante = 'OPERATIVA' AND estatus_solicitud IN ('PROCESO', 'PENDIENTE')), "
        "t AS (SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(GREATEST(1, CEIL(COUNT(*) / 25.0)) AS INT) AS paginas FROM f), "
        f"r AS (SELECT f.*, CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS fila FROM f), "
        f"p AS (SELECT *, CAST({page} AS INT) AS pagina FROM t) "
        "SELECT r.*, p.pagina, p.paginas, p.total FROM r, p "
        "WHERE fila > (pagina - 1) * 25 AND fila <= pagina * 25",
        "vacantes",
    )


def _titles(names: dict[str, str], expressions: dict[str, str] | None = None) -> str:
    expressions = expressions or {}
    return ", ".join(f'{expressions.get(c, c)} AS "{title}"' for c, title in names.items())


def _cell(header: str) -> str:
    return f'NULLIF(trim("{header}"), \'\')'


def _whole(header: str) -> str:
    plain = f"TRY_CAST(split_part({_cell(header)}, '.', 1) AS BIGINT)"
    return (
        f"CASE WHEN regexp_full_match({_cell(header)}, '[-+]?[0-9]+([.][0-9]*)?') THEN {plain} "
        f"ELSE TRY_CAST(trunc(TRY_CAST({_cell(header)} AS DOUBLE)) AS BIGINT) END"
    )


def _bad(header: str) -> str:
    return f"({_cell(header)} IS NOT NULL AND ({_whole(header)}) IS NULL)"


def _date(header: str) -> str:
    return f"CASE WHEN NOT regexp_full_match(\"{header}\", '[0-9]+') THEN TRY_CAST(\"{header}\" AS DATE) END"


_REQ, _HIR = "No.Vacantes Solicitadas", "No. Vacantes Contratados"
_STAGE = f"upper({_cell('Fase del Proceso')})"
_CLEANSED = f"""
limpia AS (SELECT row_idx,
  {_date('Fecha Solicitud')} AS fecha_solicitud,
  upper({_cell('Tipo de solicitud')}) AS tipo_solicitud,
  upper({_cell('Estatus De Solicitud')}) AS estatus_solicitud,
  {_STAGE} AS fase_proceso,
  {_date('Fecha de avance del proceso')} AS fecha_avance,
  CASE WHEN {_date('Fecha Autorizada')} >= DATE '2000-01-01' THEN {_date('Fecha Autorizada')} END AS fecha_autorizacion,
  upper({_cell('Puesto solicitado')}) AS puesto_vacante,
  trim("Plaza") AS plaza_vacante,
  trim("Empresa") AS empresa_vacante,
  upper({_cell('Función Área')}) AS funcion_area_vacante,
  CAST(greatest(CASE WHEN {_whole(_REQ)} IS NOT NULL AND {_whole(_HIR)} > 0 THEN {_whole(_REQ)} - {_whole(_HIR)}
       WHEN {_whole(_REQ)} IS NOT NULL THEN {_whole(_REQ)} ELSE 0 END, 0) AS BIGINT) AS vacantes_solicitadas,
  COALESCE({_whole(_HIR)}, 0) AS vacantes_contratados,
  COALESCE({_cell('Responsable Del Proceso')}, 'SIN ESPECIFICAR') AS responsable_vacante,
  upper({_cell('Comentarios Del Seguimiento Del Proceso')}) AS comentarios_vacante,
  upper(COALESCE({_cell('Tipo de Reclutamiento')}, 'SIN ESPECIFICAR')) AS tipo_reclutamiento_vacante,
  upper(COALESCE({_cell('Medio de Reclutamiento/HeadHunter')}, 'SIN ESPECIFICAR')) AS medio_reclutamiento_vacante,
  CASE WHEN {_STAGE} = 'CONTRATADO' THEN {_date('Fecha Del Seguimiento Del Proceso')} END AS fecha_cobertura,
  {_whole('ID')} AS id_sistema,
  trim("Función Área") AS area,
  CASE WHEN {_bad('ID')} THEN 'ID no es un número'
       WHEN {_bad(_REQ)} THEN 'vacantes solicitadas no es un número'
       WHEN {_bad(_HIR)} THEN 'vacantes contratados no es un número'
       WHEN {_cell('Puesto solicitado')} IS NULL THEN 'puesto_vacante es obligatorio' END AS motivo
FROM importacion)"""

_PAYLOAD = (
    "fecha_solicitud", "tipo_solicitud", "estatus_solicitud", "fase_proceso", "fecha_avance", "fecha_autorizacion",
    "puesto_vacante", "plaza_vacante", "empresa_vacante", "funcion_area_vacante", "vacantes_solicitadas",
    "vacantes_contratados", "responsable_vacante", "comentarios_vacante", "tipo_reclutamiento_vacante",
    "medio_reclutamiento_vacante", "fecha_cobertura", "id_sistema",
)
_MATCHED = f"""{_CLEANSED},
validas AS (SELECT *, CASE WHEN id_sistema <> 0 THEN CAST(id_sistema AS STRING) ELSE CONCAT('fila ', row_idx) END AS clave
  FROM limpia WHERE motivo IS NULL),
ultimas AS (SELECT *, MIN(row_idx) OVER (PARTITION BY clave) AS primera, COUNT(*) OVER (PARTITION BY clave) AS filas,
  row_number() OVER (PARTITION BY clave ORDER BY row_idx DESC) AS lugar FROM validas),
primeras AS (SELECT CAST(id_sistema AS STRING) AS clave, MIN(id) AS id_vacante FROM vacantes
  WHERE id_sistema <> 0 GROUP BY 1),
casadas AS (SELECT u.*, p.id_vacante FROM ultimas u LEFT JOIN primeras p USING (clave) WHERE lugar = 1)"""
_FOLDED = "translate({0}, 'ÁÉÍÓÚ', 'AEIOU')"


def _kind(column: str, expression: str) -> str:
    return f"CAST({expression} AS STRING)" if column == "vacantes_contratados" else expression


def _import_body() -> str:
    def updated(c: str) -> str:
        value = f"m.{c}"
        if c == "comentarios_vacante":
            value = _FOLDED.format(value)
        if c == "vacantes_solicitadas":
            value = f"CAST({value} AS INT)"
        return f"CASE WHEN m.id_vacante IS NOT NULL THEN {_kind(c, value)} ELSE v.{c} END AS {c}"

    def inserted(c: str) -> str:
        if c == "comentarios_vacante":
            return f"CASE WHEN filas > 1 THEN {_FOLDED.format(c)} ELSE {c} END AS {c}"
        return f"{_kind(c, f'CAST({c} AS INT)' if c == 'vacantes_solicitadas' else c)} AS {c}"

    return (
        f"{_MATCHED} SELECT v.id, v.id_registro, {', '.join(updated(c) for c in _PAYLOAD)}, v.confidencial "
        "FROM vacantes v LEFT JOIN casadas m ON m.id_vacante = v.id UNION ALL "
        "SELECT (SELECT MAX(id) FROM vacantes) + 1 + primera AS id, "
        "(SELECT MAX(id) FROM registros_rh) + 1 + primera AS id_registro, "
        f"{', '.join(inserted(c) for c in _PAYLOAD)}, NULL AS confidencial FROM casadas WHERE id_vacante IS NULL"
    )


def _import_upsert() -> str:
    return _sql(f", {_import_body()}", "vacantes", "registros_rh", "importacion")


def _import_twice() -> str:
    """The rows of one status first, the others into the outcome."""

    def step(staged: str, vacancies: str, master: str) -> str:
        body = _import_body()
        for name, stands_for in (("importacion", staged), ("vacantes", vacancies), ("registros_rh", master)):
            body = re.sub(rf"FROM {name}\b", f"FROM {stands_for}", body)
        return f"(WITH {body})"

    status = "\"Estatus De Solicitud\" = 'Finalizado'"
    return _sql(
        f", primeras_filas AS (SELECT * FROM importacion WHERE {status}), otras_filas AS (SELECT * FROM importacion WHERE NOT {status}), "
        f"uno AS {step('primeras_filas', 'vacantes', 'registros_rh')}, "
        "maestra_uno AS (SELECT id FROM registros_rh UNION ALL SELECT id_registro FROM uno), "
        f"dos AS {step('otras_filas', 'uno', 'maestra_uno')} SELECT * FROM dos",
        "vacantes", "registros_rh", "importacion",
    )


def _window_from_daily() -> str:
    """The windows' totals over the outcome of the import."""
    body = _import_body()
    filled = f"SELECT CAST(COALESCE(SUM({_HIRED}), 0) AS BIGINT) FROM uno WHERE fecha_solicitud BETWEEN fi AND ff AND fase_proceso = 'CONTRATADO'"
    return _sql(
        f", {_WINDOWS}, uno AS (WITH {body}) SELECT CAST(anio AS INT) AS anio, "
        f"(SELECT CAST(COALESCE(SUM({_HIRES}), 0) AS BIGINT) FROM altas WHERE fecha_alta BETWEEN fi AND ff) AS contratados, "
        f"({filled} AND tipo_solicitud = 'NUEVO') AS nuevas, ({filled} AND tipo_solicitud = 'REEMPLAZO') AS reemplazos FROM w",
        "altas", "vacantes", "registros_rh", "importacion",
    )


def _dashboard_cube() -> str:
    def block(table: str, name: str, key: str, amount: str, mean: str, source: str, detail: str = "NULL", share: str = "NULL") -> str:
        return (
            f"SELECT '{table}' AS tabla, '{name}' AS bloque, CAST({key} AS STRING) AS clave, CAST({detail} AS STRING) AS detalle, "
            f"CAST({amount} AS BIGINT) AS cantidad, CAST({mean} AS DOUBLE) AS promedio, CAST({share} AS DOUBLE) AS porcentaje FROM {source}"
        )

    def hired(name: str, key: str, where: str, **more: str) -> str:
        share = "SUM(n) / (SUM(SUM(n)) OVER ())::BIGINT * 100" if name in ("canal", "empresa") else "NULL"
        return block("altas", name, key, "SUM(n)", "NULL", f"h WHERE {where} GROUP BY ALL", share=share, **more)

    def total(name: str, where: str) -> str:
        return block("altas", "totales", f"'{name}'", f"COALESCE(SUM(n) FILTER ({where}), 0)", "NULL", "h")

    def openings(name: str, key: str) -> str:
        return block("vacantes", name, key, f"SUM({_OPENINGS})", "NULL", f"vacantes WHERE {_OPEN} AND {_AUTHORISED_OPENINGS} AND {key} IS NOT NULL GROUP BY ALL")

    def days(name: str, key: str) -> str:
        return block("vacantes", name, key, "NULL", "AVG(dias)", f"d WHERE {key} IS NOT NULL AND dias IS NOT NULL GROUP BY ALL")

    alias = "CASE nombre WHEN 'MARTA' THEN 'HELEN' WHEN 'LETICIA' THEN 'LETY' WHEN 'YULIANA' THEN 'YULI' ELSE nombre END"
    parts = [
        hired("canal", "medio_reclutamiento_alta", "medio_reclutamiento_alta IS NOT NULL"),
        hired("empresa", "empresa_alta", "empresa_alta IS NOT NULL"),
        hired("ejecutivo", alias, "nombre IS NOT NULL AND area_alta IS NOT NULL", detail="area_alta"),
        hired("mes", "month(fecha_alta)", "fecha_alta IS NOT NULL"),
        total("contratados_totales", "TRUE"), total("contratados_redes_pagadas", "medio_reclutamiento_alta = 'REDES PAGADAS'"),
        total("contratados_operativas", "area_alta = 'OPERATIVA'"),
        total("contratados_operativas_redes_pagadas", "area_alta = 'OPERATIVA' AND medio_reclutamiento_alta = 'REDES PAGADAS'"),
        openings("vacantes_empresa", "empresa_vacante"), openings("vacantes_area", "funcion_area_vacante"),
        block(
            "vacantes", "embudo", "fase_proceso", "COUNT(*)", "NULL",
            f"vacantes WHERE {_OPEN} AND fase_proceso <> 'CONTRATADO' AND (estatus_solicitud IS NULL OR estatus_solicitud NOT IN "
            f"('PENDIENTE', 'CANCELADO', 'PAUSADO')) AND {_AUTHORISED_OPENINGS} GROUP BY ALL",
        ),
        days("dias_plaza", "plaza_vacante"), days("dias_puesto", "puesto_vacante"),
        block("vacantes", "totales", "'vacantes'", f"COALESCE(SUM({_OPENINGS}), 0)", "NULL", f"vacantes WHERE {_OPEN} AND fecha_autorizacion IS NOT NULL"),
        block("vacantes", "totales", "'dias_promedio'", "NULL", "AVG(dias)", "d"),
    ]
    return _sql(
        f", h AS (SELECT *, string_split_regex(trim(responsable_alta), '\\s+')[1] AS nombre, {_HIRES} AS n FROM altas WHERE {_HIRES} > 0 AND {_QUARTER}), "
        f"d AS (SELECT plaza_vacante, puesto_vacante, {_DAYS} AS dias FROM vacantes WHERE {_HIRED} > 0) " + " UNION ALL ".join(parts),
        "altas", "vacantes",
    )


def _import_master() -> str:
    return _sql(
        f", {_MATCHED}, cambios AS (SELECT v.id_registro, m.* FROM casadas m JOIN vacantes v ON v.id = m.id_vacante) "
        "SELECT r.id, r.tipo_registro, strftime(r.fecha_creacion, '%Y-%m-%d') AS fecha_creacion, r.ultima_actualizacion, "
        "CASE WHEN c.clave IS NULL THEN r.puesto ELSE c.puesto_vacante END AS puesto, "
        "CASE WHEN c.clave IS NULL THEN r.empresa ELSE c.empresa_vacante END AS empresa, "
        "CASE WHEN c.clave IS NULL THEN r.plaza ELSE c.plaza_vacante END AS plaza, "
        "CASE WHEN c.clave IS NULL THEN r.area ELSE c.area END AS area "
        "FROM registros_rh r LEFT JOIN cambios c ON c.id_registro = r.id UNION ALL "
        "SELECT (SELECT MAX(id) FROM registros_rh) + 1 + primera, 'Vacante', '2001-12-31', NULL, puesto_vacante, empresa_vacante, "
        "plaza_vacante, area FROM casadas WHERE id_vacante IS NULL",
        "vacantes", "registros_rh", "importacion",
    )


def _typed(position: str) -> str:
    return f"CASE WHEN id % 29 = 0 THEN '  ' ELSE CONCAT(' ', lower({position}), ' á') END"


def _appended(table: str, position: str, cells: dict[str, str], columns: dict[str, str]) -> str:
    """Child rows of a batch made from the stored table itself."""
    shown = {"id": f"(SELECT MAX(id) FROM {table}) + 1 + id", "id_registro": "(SELECT MAX(id) FROM registros_rh) + 1 + id"}
    picked = ", ".join(f"{cells.get(c, shown.get(c, c))} AS {c}" for c in columns)
    return _sql(
        f"SELECT {picked} FROM {table} WHERE trim({_typed(position)}) <> ''", table, "registros_rh"
    )


_FILLED = f"{_HIRED} > 0"


def _of_filled(column: str) -> str:
    return f"CASE WHEN {_FILLED} THEN COALESCE(upper(trim({column})), 'SIN ESPECIFICAR') ELSE 'SIN ESPECIFICAR' END"


def oracle_sql() -> dict[str, str]:
    from reclutark.plans import hires, listings

    wide = ", ".join(
        f"CAST(COALESCE(SUM(h) FILTER (responsable_alta = '{name}' AND area_alta = '{area}'), 0) AS BIGINT) "
        f'AS "{name} / {area}"'
        for name in ("AGENCIA", "DIEGO TRES", "Leticia Dos", "MARTA ELENA UNO", "SIN ESPECIFICAR", "YULIANA  CUATRO")
        for area in ("ADMINISTRATIVA", "OPERATIVA")
    )
    return {
        "dashboard_cube": _dashboard_cube(),
        "hires_by_channel": _share_by("medio_reclutamiento_alta", _QUARTER, "medio_reclutamiento_alta"),
        "hires_by_company": _share_by(
            "CASE empresa_alta WHEN 'AUTOMOBILE' THEN 'AUTO' WHEN 'MACHINERY' THEN 'MAQ' "
            "WHEN 'HOUSEHOLD' THEN 'HOGAR' ELSE empresa_alta END", "TRUE", "empresa_alta",
        ),
        "hires_by_company_chosen": _share_by("empresa_alta", "empresa_alta IN ('BUILDING', 'FURNITURE')", "empresa_alta"),
        "hires_by_recruiter_area": _sql(
            ", h AS (SELECT string_split_regex(trim(responsable_alta), '\\s+')[1] AS nombre, area_alta, "
            f"{_HIRES} AS n FROM altas) "
            "SELECT CASE nombre WHEN 'MARTA' THEN 'HELEN' WHEN 'LETICIA' THEN 'LETY' WHEN 'YULIANA' THEN 'YULI' "
            "ELSE nombre END AS ejecutivo, "
            "CAST(COALESCE(SUM(n) FILTER (area_alta = 'OPERATIVA'), 0) AS BIGINT) AS operativa, "
            "CAST(COALESCE(SUM(n) FILTER (area_alta = 'ADMINISTRATIVA'), 0) AS BIGINT) AS administrativa "
            "FROM h WHERE n > 0 AND nombre IS NOT NULL AND area_alta IS NOT NULL GROUP BY 1",
            "altas",
        ),
        "hires_by_month": _sql(
            f", t AS (SELECT CAST(month(fecha_alta) AS INT) AS mes, CAST(SUM({_HIRES}) AS BIGINT) AS contratados "
            f"FROM altas WHERE {_HIRES} > 0 AND fecha_alta IS NOT NULL GROUP BY 1) "
            f"SELECT mes, {_LONG_MONTH} AS nombre_mes, contratados FROM t",
            "altas",
        ),
        "paid_media_totals": _sql(
            f", h AS (SELECT *, {_HIRES} AS n, medio_reclutamiento_alta = 'REDES PAGADAS' AS pagada, "
            "area_alta = 'OPERATIVA' AS op FROM altas) SELECT "
            "CAST(COALESCE(SUM(n), 0) AS BIGINT) AS contratados_totales, "
            "CAST(COALESCE(SUM(n) FILTER (pagada), 0) AS BIGINT) AS contratados_redes_pagadas, "
            "CAST(COALESCE(SUM(n) FILTER (op), 0) AS BIGINT) AS contratados_operativas, "
            "CAST(COALESCE(SUM(n) FILTER (op AND pagada), 0) AS BIGINT) AS contratados_operativas_redes_pagadas "
            "FROM h WHERE n > 0",
            "altas",
        ),
        "paid_media_monthly": _sql(
            f", h AS (SELECT *, {_HIRES} AS n, CAST(month(fecha_alta) AS INT) AS mes FROM altas WHERE {_HIRES} > 0 "
            "AND fecha_alta IS NOT NULL), "
            "a AS (SELECT mes, CAST(SUM(n) AS BIGINT) AS operativas FROM h WHERE area_alta = 'OPERATIVA' GROUP BY 1), "
            "b AS (SELECT mes, CAST(SUM(n) AS BIGINT) AS redes_pagadas FROM h "
            "WHERE medio_reclutamiento_alta = 'REDES PAGADAS' GROUP BY 1) "
            f"SELECT mes, {_LONG_MONTH} AS nombre_mes, operativas, redes_pagadas FROM a FULL JOIN b USING (mes)",
            "altas",
        ),
        "pivot_hires": _sql(
            f"SELECT fecha_alta, responsable_alta, area_alta, CAST(SUM({_HIRES}) AS BIGINT) AS contrataciones, "
            "COUNT(id) AS registros, CASE WHEN GROUPING(fecha_alta) = 0 AND GROUPING(responsable_alta) = 0 THEN 'celda' "
            "WHEN GROUPING(fecha_alta) = 0 THEN 'total_fila' WHEN GROUPING(responsable_alta) = 0 THEN 'total_columna' "
            f"ELSE 'total_general' END AS nivel FROM altas WHERE {_HIRES} > 0 GROUP BY GROUPING SETS "
            "((fecha_alta, responsable_alta, area_alta), (fecha_alta), (responsable_alta, area_alta), ())",
            "altas",
        ),
        "pivot_hires_wide": _sql(
            f", h AS (SELECT *, {_HIRES} AS h FROM altas WHERE {_HIRES} > 0) "
            "SELECT CASE WHEN GROUPING(CAST(fecha_alta AS STRING)) = 1 THEN 'TOTAL' ELSE CAST(fecha_alta AS STRING) END "
            f"AS fecha_alta, {wide}, CAST(SUM(h) AS BIGINT) AS \"TOTAL\" FROM h "
            "GROUP BY GROUPING SETS ((CAST(fecha_alta AS STRING)), ())",
            "altas",
        ),
        "hires_detail": _sql(
            f"SELECT {_titles(hires.DETAIL_COLUMNS, {'puesto_alta': _MASKED.format('puesto_alta')})} FROM altas "
            f"WHERE fecha_alta {_IN_1998}",
            "altas",
        ),
        "period_all": _period("TRUE", "TRUE"),
        "period_year": _period("year(fecha_alta) = 1998", "year(fecha_baja) = 2024"),
        "period_quarter": _period(_QUARTER, "fecha_baja BETWEEN DATE '2024-01-01' AND DATE '2024-03-31'"),
        "period_month": _period(
            "year(fecha_alta) = 1998 AND month(fecha_alta) = 3", "year(fecha_baja) = 2024 AND month(fecha_baja) = 1"
        ),
        "period_week": _period(
            "isoyear(fecha_alta) = 1998 AND weekofyear(fecha_alta) = 53",
            "isoyear(fecha_baja) = 2024 AND weekofyear(fecha_baja) = 3",
        ),
        "period_range": _period(
            f"fecha_alta {_IN_RANGE}", "fecha_baja >= DATE '2024-01-05' AND fecha_baja <= DATE '2024-01-20'"
        ),
        "recruiter_filter": _sql(
            f"SELECT id, responsable_alta, contratados_alta FROM altas WHERE {_HELEN.format('responsable_alta')}", "altas"
        ),
        "overview_kpis": _overview(),
        "last_update": _sql(
            "SELECT CAST(MAX(ultima_actualizacion) AS DATE) AS ultima_actualizacion FROM registros_rh", "registros_rh"
        ),
        "last_update_indexed": _sql(
            "SELECT CAST(MAX(ultima_actualizacion) AS DATE) AS ultima_actualizacion FROM registros_rh", "registros_rh"
        ),
        "years_available": _sql(
            "SELECT DISTINCT CAST(anio AS INT) AS anio FROM (SELECT year(fecha_solicitud) AS anio FROM vacantes UNION ALL "
            "SELECT year(fecha_cobertura) FROM vacantes UNION ALL SELECT year(fecha_alta) FROM altas UNION ALL "
            "SELECT year(fecha_baja) FROM bajas_sistema) WHERE anio IS NOT NULL",
            "vacantes", "altas", "bajas_sistema",
        ),
        "years_filled": _sql(
            "SELECT DISTINCT CAST(year(fecha_cobertura) AS INT) AS anio FROM vacantes WHERE fecha_cobertura IS NOT NULL",
            "vacantes",
        ),
        "open_null_keeping": _sql(
            f"SELECT CAST(COALESCE(SUM({_OPENINGS}), 0) AS BIGINT) AS vacantes, COUNT(*) AS registros FROM vacantes "
            f"WHERE {_OPEN} AND fecha_autorizacion IS NOT NULL",
            "vacantes",
        ),
        "open_sql_nulls": _sql(
            f"SELECT CAST(COALESCE(SUM({_OPENINGS}), 0) AS BIGINT) AS vacantes, COUNT(*) AS registros FROM vacantes "
            f"WHERE {_OPEN_CAPACITY}",
            "vacantes",
        ),
        "open_age": _sql(
            f", d AS (SELECT funcion_area_vacante AS area, {_DAYS} AS dias FROM vacantes WHERE {_OPEN} "
            "AND fecha_autorizacion IS NOT NULL AND fecha_autorizacion <> DATE '1900-01-01') SELECT "
            "CAST(COALESCE(round_even(AVG(dias), 0), 0) AS BIGINT) AS promedio, "
            "CAST(COALESCE(round_even(AVG(dias) FILTER (area = 'ADMINISTRATIVA'), 0), 0) AS BIGINT) "
            "AS promedio_administrativas, "
            "CAST(COALESCE(round_even(AVG(dias) FILTER (area = 'OPERATIVA'), 0), 0) AS BIGINT) AS promedio_operativas "
            "FROM d",
            "vacantes",
        ),
        "closed_days": _closed(f"fecha_cobertura {_IN_1998}"),
        "closed_days_recruiter": _closed(
            f"fecha_cobertura {_IN_RANGE} AND list_contains({_WORDS.format('responsable_vacante')}, 'YULIANA')"
        ),
        "coverage_days": _sql(
            f"SELECT id, {_DAYS} AS dias, CAST(date_diff('day', {_START}, COALESCE(fecha_cobertura, {_AS_OF})) AS INT) "
            "AS dias_listado, CASE WHEN fecha_cobertura >= fecha_autorizacion "
            "THEN CAST(date_diff('day', fecha_autorizacion, fecha_cobertura) AS INT) END AS dias_cerrada FROM vacantes",
            "vacantes",
        ),
        "coverage_days_tz": _sql(
            f", d AS (SELECT id, fecha_autorizacion, {_START} AS ini, {_END} AS fin FROM vacantes) "
            "SELECT id, CASE WHEN fecha_autorizacion = DATE '1900-01-01' THEN 1 ELSE CAST(floor(("
            "epoch(CAST(fin AS TIMESTAMP) AT TIME ZONE 'America/Mexico_City') - "
            "epoch(CAST(ini AS TIMESTAMP) AT TIME ZONE 'America/Mexico_City')) / 86400) AS INT) END AS dias FROM d",
            "vacantes",
        ),
        "openings_by_company": _openings("empresa_vacante", "empresa"),
        "openings_by_area": _openings("funcion_area_vacante", "funcion_area"),
        "vacancy_detail": _sql(
            f"SELECT id_sistema, fecha_autorizacion, empresa_vacante, {_MASKED.format('puesto_vacante')} "
            f"AS puesto_vacante, plaza_vacante, {_OPENINGS} AS vacantes_solicitadas, {_DAYS} AS dias_cobertura, "
            f"fase_proceso FROM vacantes WHERE {_OPEN} AND {_AUTHORISED_OPENINGS}",
            "vacantes",
        ),
        "pivot_openings": _pivot_openings(_DAYS),
        "pivot_openings_tz": _pivot_openings(_DAYS_TZ),
        "pivot_export": _pivot_openings(_DAYS),
        "pivot_export_csv": _pivot_openings(_DAYS),
        "stage_funnel": _sql(
            f"SELECT fase_proceso, COUNT(*) AS cantidad FROM vacantes WHERE {_OPEN} AND fase_proceso <> 'CONTRATADO' "
            "AND (estatus_solicitud IS NULL OR estatus_solicitud NOT IN ('PENDIENTE', 'CANCELADO', 'PAUSADO')) "
            f"AND {_AUTHORISED_OPENINGS} GROUP BY 1",
            "vacantes",
        ),
        "days_by_site": _days_by("plaza_vacante", "TRUE"),
        "days_by_site_tz": _days_by("plaza_vacante", "TRUE", _DAYS_TZ),
        "days_by_position": _days_by("puesto_vacante", f"fecha_cobertura {_IN_1998}"),
        "days_summary": _sql(
            f", d AS (SELECT plaza_vacante, puesto_vacante, {_DAYS} AS dias FROM vacantes WHERE {_HIRED} > 0), "
            "a AS (SELECT plaza_vacante AS n, AVG(dias) AS m FROM d WHERE plaza_vacante IS NOT NULL GROUP BY 1 "
            "ORDER BY m DESC NULLS LAST, n LIMIT 1), "
            "b AS (SELECT puesto_vacante AS n, AVG(dias) AS m FROM d WHERE puesto_vacante IS NOT NULL GROUP BY 1 "
            "ORDER BY m DESC NULLS LAST, n LIMIT 1) "
            "SELECT (SELECT round_even(AVG(dias), 0) FROM d) AS promedio_global, 30.0::DOUBLE AS meta, "
            "(SELECT n FROM a) AS plaza_mas_alta, (SELECT round_even(m, 0) FROM a) AS plaza_mas_alta_dias, "
            "(SELECT n FROM b) AS puesto_mas_alto, (SELECT round_even(m, 0) FROM b) AS puesto_mas_alto_dias",
            "vacantes",
        ),
        "yearly_yoy": _yearly("TRUE"),
        "yearly_yoy_area": _yearly("area_alta = 'ADMINISTRATIVA'"),
        "monthly_of_year": _sql(
            ", m AS (SELECT CAST(range AS INT) AS mes FROM range(1, 13)), "
            f"h AS (SELECT CAST(month(fecha_alta) AS INT) AS mes, SUM({_HIRES}) AS n FROM altas "
            "WHERE year(fecha_alta) = 2001 GROUP BY 1) "
            "SELECT CAST(2001 AS INT) AS anio, mes, CAST(COALESCE(n, 0) AS BIGINT) AS contratados, "
            f"{_SHORT_MONTH} AS nombre_mes FROM m LEFT JOIN h USING (mes)",
            "altas",
        ),
        "monthly_grid": _sql(
            ", m AS (SELECT CAST(range AS INT) AS mes FROM range(1, 13)), "
            f"h AS (SELECT CAST(year(fecha_alta) AS INT) AS anio, CAST(month(fecha_alta) AS INT) AS mes, "
            f"SUM({_HIRES}) AS n FROM altas WHERE fecha_alta IS NOT NULL GROUP BY 1, 2), "
            "y AS (SELECT DISTINCT anio FROM h) "
            "SELECT anio, mes, CAST(COALESCE(n, 0) AS BIGINT) AS contratados, "
            f"{_SHORT_MONTH} AS nombre_mes FROM y CROSS JOIN m LEFT JOIN h USING (anio, mes) "
            "WHERE (SELECT COUNT(*) FROM y) >= 2",
            "altas",
        ),
        "new_vs_replacement": _sql(
            ", h AS (SELECT CAST(year(fecha_solicitud) AS INT) AS anio, tipo_solicitud, "
            f"{_HIRED} AS n FROM vacantes WHERE fase_proceso = 'CONTRATADO' AND year(fecha_solicitud) >= 1997), "
            "t AS (SELECT y.anio, k.tipo_solicitud, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS contratados "
            "FROM (SELECT DISTINCT anio FROM h) y CROSS JOIN (VALUES ('NUEVO'), ('REEMPLAZO')) k(tipo_solicitud) "
            "LEFT JOIN h ON h.anio = y.anio AND h.tipo_solicitud = k.tipo_solicitud GROUP BY 1, 2) "
            "SELECT t.anio, t.tipo_solicitud, t.contratados, CASE WHEN p.contratados > 0 "
            "THEN (t.contratados - p.contratados) / p.contratados * 100 END AS variacion_pct "
            "FROM t LEFT JOIN t AS p ON p.anio = t.anio - 1 AND p.tipo_solicitud = t.tipo_solicitud",
            "vacantes",
        ),
        "recruiter_year": _sql(
            f", h AS (SELECT CAST(year(fecha_alta) AS INT) AS anio, {_LISTED.format('responsable_alta')} AS ejecutivo, "
            f"{_HIRES} AS n FROM altas) "
            "SELECT y.anio, e.ejecutivo, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS contratados "
            "FROM (SELECT DISTINCT anio FROM h WHERE ejecutivo IS NOT NULL AND anio IS NOT NULL) y "
            "CROSS JOIN (VALUES ('DIEGO'), ('YULIANA'), ('LETICIA'), ('ELENA')) e(ejecutivo) "
            "LEFT JOIN h ON h.anio = y.anio AND h.ejecutivo = e.ejecutivo GROUP BY 1, 2",
            "altas",
        ),
        "window_totals": _sql(
            f", {_WINDOWS} SELECT CAST(anio AS INT) AS anio, "
            f"(SELECT CAST(COALESCE(SUM({_HIRES}), 0) AS BIGINT) FROM altas WHERE fecha_alta BETWEEN fi AND ff) AS contratados, "
            f"(SELECT CAST(COALESCE(SUM({_HIRED}), 0) AS BIGINT) FROM vacantes WHERE fecha_solicitud BETWEEN fi AND ff "
            "AND fase_proceso = 'CONTRATADO' AND tipo_solicitud = 'NUEVO') AS nuevas, "
            f"(SELECT CAST(COALESCE(SUM({_HIRED}), 0) AS BIGINT) FROM vacantes WHERE fecha_solicitud BETWEEN fi AND ff "
            "AND fase_proceso = 'CONTRATADO' AND tipo_solicitud = 'REEMPLAZO') AS reemplazos FROM w",
            "altas", "vacantes",
        ),
        "window_monthly": _sql(
            f", {_WINDOWS}, m AS (SELECT CAST(range AS INT) AS mes FROM range(2, 9)) "
            f"SELECT CAST(w.anio AS INT) AS anio, mes, CAST(COALESCE(SUM({_HIRES}), 0) AS BIGINT) AS contratados, "
            f"{_SHORT_MONTH} AS nombre_mes FROM w CROSS JOIN m LEFT JOIN altas ON fecha_alta BETWEEN fi AND ff "
            "AND month(fecha_alta) = mes GROUP BY w.anio, mes",
            "altas",
        ),
        "window_recruiter": _sql(
            f", {_WINDOWS}, h AS (SELECT fecha_alta, {_LISTED.format('responsable_alta')} AS ejecutivo, {_HIRES} AS n "
            "FROM altas) SELECT CAST(w.anio AS INT) AS anio, e.ejecutivo, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS contratados "
            "FROM w CROSS JOIN (VALUES ('DIEGO'), ('YULIANA'), ('LETICIA'), ('ELENA')) e(ejecutivo) "
            "LEFT JOIN h ON h.ejecutivo = e.ejecutivo AND fecha_alta BETWEEN fi AND ff GROUP BY 1, 2",
            "altas",
        ),
        "range_totals": _sql(
            f"SELECT (SELECT CAST(COALESCE(SUM({_HIRES}), 0) AS BIGINT) FROM altas WHERE fecha_alta {_IN_RANGE}) AS contratados, "
            f"CAST(COALESCE(SUM({_HIRED}) FILTER (tipo_solicitud = 'NUEVO'), 0) AS BIGINT) AS nuevas, "
            f"CAST(COALESCE(SUM({_HIRED}) FILTER (tipo_solicitud = 'REEMPLAZO'), 0) AS BIGINT) AS reemplazos "
            f"FROM vacantes WHERE fase_proceso = 'CONTRATADO' AND fecha_solicitud {_IN_RANGE}",
            "altas", "vacantes",
        ),
        "range_monthly": _sql(
            f", m AS (SELECT CAST(range AS INT) AS mes FROM range(2, 12)) SELECT mes, "
            f"CAST(COALESCE(SUM({_HIRES}), 0) AS BIGINT) AS contratados, {_SHORT_MONTH} AS nombre_mes FROM m "
            f"LEFT JOIN altas ON month(fecha_alta) = mes AND fecha_alta {_IN_RANGE} GROUP BY mes",
            "altas",
        ),
        "range_recruiter": _sql(
            f", h AS (SELECT {_LISTED.format('responsable_alta')} AS ejecutivo, {_HIRES} AS n FROM altas "
            f"WHERE fecha_alta {_IN_RANGE}) SELECT e.ejecutivo, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS contratados "
            "FROM (VALUES ('DIEGO'), ('YULIANA'), ('LETICIA'), ('ELENA')) e(ejecutivo) "
            "LEFT JOIN h ON h.ejecutivo = e.ejecutivo GROUP BY 1",
            "altas",
        ),
        "sla_by_area": _sla(
            f"fecha_cobertura {_IN_1998}",
            "SELECT a.area, CAST(COUNT(dias) AS BIGINT) AS registros, "
            "COALESCE(COUNT(*) FILTER (dias <= meta) / NULLIF(COUNT(dias), 0) * 100, 0) AS dentro_meta_pct, "
            "COALESCE(AVG(dias), 0) AS dias_promedio, a.meta, "
            "CASE WHEN COUNT(dias) > 0 THEN AVG(dias) <= a.meta END AS en_meta "
            "FROM (VALUES ('OPERATIVA', 15.0::DOUBLE), ('ADMINISTRATIVA', 45.0::DOUBLE)) a(area, meta) "
            "LEFT JOIN s ON s.funcion_area_vacante = a.area GROUP BY a.area, a.meta",
        ),
        "sla_recruiter": _sla(
            "fecha_cobertura BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'",
            f"SELECT e.ejecutivo, {_means_by_area()} "
            "FROM (VALUES ('DIEGO'), ('YULIANA'), ('LETICIA'), ('ELENA')) e(ejecutivo) "
            f"LEFT JOIN s ON {_LISTED.format('responsable_vacante')} = e.ejecutivo GROUP BY 1",
        ),
        "sla_trend": _sla(
            "TRUE", f"SELECT strftime(fecha_cobertura, '%Y-%m') AS mes, {_means_by_area()} FROM s GROUP BY 1"
        ),
        "capacity": _sql(
            ", v AS (SELECT CAST(COALESCE(SUM(vacantes_solicitadas), 0) AS BIGINT) AS n FROM vacantes "
            f"WHERE {_OPEN_CAPACITY}), k AS (SELECT n AS vacantes_activas, CAST(4 * 9 * 22 AS BIGINT) AS horas_trabajador, "
            "792.0::DOUBLE / 13.1::DOUBLE AS capacidad_teorica FROM v), "
            "p AS (SELECT *, vacantes_activas / capacidad_teorica * 100 AS eficiencia_pct FROM k) "
            "SELECT *, CASE WHEN eficiencia_pct > 150 THEN 'Riesgo de saturación del proceso' "
            "WHEN eficiencia_pct > 100 THEN 'Sobrecarga operativa' WHEN eficiencia_pct >= 80 THEN 'Operación estable' "
            "ELSE 'Capacidad disponible / subutilización' END AS interpretacion FROM p",
            "vacantes",
        ),
        "activity_hours": _sql(
            f", v AS (SELECT COALESCE(SUM(vacantes_solicitadas), 0) AS n FROM vacantes WHERE {_OPEN_CAPACITY}), "
            "a AS (SELECT * FROM (VALUES "
            + ", ".join(f"({i}, '{name}', {time}::DOUBLE)" for i, (name, time) in enumerate(catalogs.ACTIVITY_HOURS, 1))
            + ") x(orden, actividad, horas)) "
            "SELECT CAST(orden AS INT) AS orden, actividad, horas, horas * n::DOUBLE AS horas_requeridas FROM a, v",
            "vacantes",
        ),
        "file_kpis": _sql(
            f", {_DELIVERED}, k AS (SELECT COUNT(*) AS t, COUNT(*) FILTER (id_colaborador IN (SELECT id_colaborador FROM c)) "
            "AS ok FROM colaboradores WHERE activo) SELECT t AS expedientes_totales, ok AS expedientes_completos, "
            "t - ok AS expedientes_faltantes, CASE WHEN t > 0 THEN ok / t * 100 ELSE 0 END AS completos_pct FROM k",
            "colaboradores", "catalogo", "archivos",
        ),
        "file_matrix": _sql(
            f", {_DELIVERED} SELECT p.nombre_completo AS colaborador, p.empresa, p.plaza, p.departamento, p.puesto, "
            "CASE WHEN p.id_colaborador IN (SELECT id_colaborador FROM c) THEN 'COMPLETO' ELSE 'INCOMPLETO' END AS estatus, "
            + ", ".join(
                f"EXISTS (SELECT 1 FROM e WHERE e.id_colaborador = p.id_colaborador AND e.id_documento = {i}) AS \"DOC_{i}\""
                for i in (1, 2, 3)
            )
            + " FROM colaboradores p WHERE p.activo",
            "colaboradores", "catalogo", "archivos",
        ),
        "file_matrix_long": _sql(
            f", {_DELIVERED} SELECT p.id_colaborador, p.nombre_completo AS colaborador, p.empresa, p.plaza, p.departamento, "
            "p.puesto, CASE WHEN p.id_colaborador IN (SELECT id_colaborador FROM c) THEN 'COMPLETO' ELSE 'INCOMPLETO' END "
            "AS estatus, d.id AS id_documento, d.nombre_documento AS documento, "
            "(p.id_colaborador, d.id) IN (SELECT (id_colaborador, id_documento) FROM e) AS entregado "
            "FROM colaboradores p, (SELECT * FROM catalogo WHERE requerido) d WHERE p.activo",
            "colaboradores", "catalogo", "archivos",
        ),
        "documents_per_person": _sql(f", {_DELIVERED} SELECT * FROM n", "catalogo", "archivos"),
        "incomplete_files": _sql(
            f", {_DELIVERED} SELECT id_colaborador, nombre_completo FROM colaboradores WHERE activo "
            "AND id_colaborador NOT IN (SELECT id_colaborador FROM c)",
            "colaboradores", "catalogo", "archivos",
        ),
        "facets": _sql(
            " UNION ALL ".join(
                f"SELECT DISTINCT '{c}' AS columna, {c} AS valor, {c} AS etiqueta FROM colaboradores WHERE {c} <> ''"
                for c in ("empresa", "plaza", "departamento", "puesto")
            )
            + " UNION ALL SELECT * FROM (VALUES ('activo', 'true', 'Entregado'), ('activo', 'false', 'Faltante')) b",
            "colaboradores",
        ),
        "facet_search": _sql(
            " UNION ALL ".join(
                f"SELECT DISTINCT '{c}' AS columna, {c} AS valor, {c} AS etiqueta FROM colaboradores "
                f"WHERE contains(lower({c}), 'chin')"
                for c in ("empresa", "plaza", "departamento", "puesto")
            ),
            "colaboradores",
        ),
        "grid_page": _grid("lower(COALESCE(puesto_vacante, '')) DESC, id", "LEAST(3, paginas)"),
        "grid_last_page": _grid("lower(COALESCE(puesto_vacante, '')), id", "paginas"),
        "grid_middle_page": _grid("lower(COALESCE(puesto_vacante, '')), id", "LEAST(12, paginas)"),
        "listing_hires": _sql(f"SELECT {_titles(listings.HIRES)} FROM altas", "altas"),
        "listing_leavers": _leavers("fecha_baja >= DATE '2024-01-01'"),
        "listing_leavers_range": _leavers("fecha_baja BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'"),
        "listing_vacancies": _sql(
            "SELECT "
            + _titles(
                listings.VACANCIES,
                {"dias_cobertura": f"CAST(date_diff('day', {_START}, COALESCE(fecha_cobertura, {_AS_OF})) AS INT)"},
            )
            + " FROM vacantes WHERE confidencial IS NULL OR confidencial <> 'SI'",
            "vacantes",
        ),
        "records_json": _sql(
            "SELECT CAST(to_json(struct_pack(id := id, fecha_alta := fecha_alta, puesto_alta := puesto_alta, "
            "contratados_alta := contratados_alta, responsable_alta := responsable_alta, confidencial := confidencial)) "
            "AS STRING) AS registro FROM altas",
            "altas",
        ),
        "catalog_positions": _sql("SELECT DISTINCT trim(puesto_alta) AS puesto_alta FROM altas WHERE trim(puesto_alta) <> ''", "altas"),
        "chat_last_n": (
            "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r "
            "FROM conversations) WHERE r <= 10"
        ),
        "json_payload": _sql(
            ", j AS (SELECT id, texto, CASE WHEN texto LIKE '{%' THEN texto "
            "WHEN contains(texto, '```json') THEN regexp_extract(texto, '```json(.*)```', 1) END AS externo FROM respuestas), "
            "k AS (SELECT *, CASE WHEN json_extract_string(externo, '$.output') LIKE '{%}' "
            "THEN json_extract_string(externo, '$.output') ELSE externo END AS contenido FROM j) "
            "SELECT id, texto, contenido, CASE WHEN contenido IS NULL THEN texto ELSE "
            "COALESCE(json_extract_string(contenido, '$.output'), 'He procesado tu solicitud.') END AS respuesta, "
            "json_extract_string(contenido, '$.chart') AS grafica FROM k",
            "respuestas",
        ),
        "json_replies": _sql(
            ", j AS (SELECT *, id % 10 AS k, "
            "regexp_extract(texto, '(?s)\\{.*\\}') AS cuerpo FROM contestaciones), "
            "c AS (SELECT *, CASE WHEN k IN (4, 5, 6) THEN CASE WHEN k = 5 THEN CAST(json_extract(texto, '$[0]') AS STRING) ELSE cuerpo END "
            "WHEN k = 8 THEN json_extract_string(texto, '$.output') WHEN k = 9 THEN texto END AS contenido FROM j) "
            "SELECT id, texto, contenido, CASE WHEN contenido IS NULL THEN texto WHEN k = 9 THEN regexp_extract(texto, '\"([a-z_]*)\"}$', 1) "
            "WHEN k IN (4, 5, 6) THEN json_extract_string(contenido, '$.output') "
            "ELSE COALESCE(json_extract_string(contenido, '$.output'), 'He procesado tu solicitud.') END AS respuesta, "
            "json_extract_string(contenido, '$.chart') AS grafica FROM c",
            "contestaciones",
        ),
        "append_hires": _appended("altas", "puesto_alta", {
            "puesto_alta": f"upper(trim({_typed('puesto_alta')}))",
        }, fx.ALTAS),
        "append_hires_master": _sql(
            "SELECT (SELECT MAX(id) FROM registros_rh) + 1 + id AS id, 'Alta' AS tipo_registro, '2001-12-31' AS fecha_creacion, "
            "CAST(NULL AS STRING) AS ultima_actualizacion, "
            f"upper(trim({_typed('puesto_alta')})) AS puesto, trim(empresa_alta) AS empresa, trim(plaza_alta) AS plaza, "
            f"trim(area_alta) AS area FROM altas WHERE trim({_typed('puesto_alta')}) <> ''",
            "altas", "registros_rh",
        ),
        "append_hires_rejects": _sql(
            "SELECT id AS row_idx, 'puesto_alta es obligatorio' AS motivo FROM altas WHERE id % 29 = 0", "altas"
        ),
        "append_master": _sql(
            "SELECT (SELECT MAX(id) FROM registros_rh) + 1 + id - 2000000 AS id, tipo_registro, '2001-12-31' AS fecha_creacion, "
            "upper(trim(puesto)) AS puesto, trim(empresa) AS empresa, trim(plaza) AS plaza, trim(area) AS area, "
            "CAST(NULL AS STRING) AS ultima_actualizacion FROM registros_rh WHERE id % 5 <> 0 AND id % 7 <> 0",
            "registros_rh",
        ),
        "append_master_rejects": _sql(
            "SELECT id - 2000000 AS row_idx, 'tipo_registro inválido' AS motivo FROM registros_rh WHERE id % 5 = 0 OR id % 7 = 0",
            "registros_rh",
        ),
        "append_leavers": _appended("bajas", "puesto_baja", {
            "puesto_baja": _FOLDED.format(f"upper(trim({_typed('puesto_baja')}))"),
            "motivo_baja": _FOLDED.format("upper(trim(motivo_baja))"),
        }, fx.BAJAS),
        "append_vacancies": _appended("vacantes", "puesto_vacante", {
            "puesto_vacante": f"upper(trim({_typed('puesto_vacante')}))",
            "fecha_autorizacion": "COALESCE(fecha_autorizacion, DATE '1900-01-01')",
            "fecha_cobertura": f"CASE WHEN {_FILLED} THEN fecha_cobertura END",
            "vacantes_solicitadas": f"CAST(vacantes_solicitadas - {_HIRED} AS INT)",
            "vacantes_contratados": f"CAST({_HIRED} AS STRING)",
            "comentarios_vacante": "upper(trim(comentarios_vacante))",
            "tipo_reclutamiento_vacante": _of_filled("tipo_reclutamiento_vacante"),
            "medio_reclutamiento_vacante": _of_filled("medio_reclutamiento_vacante"),
        }, fx.VACANTES),
        "edit_vacancies": _edit_vacancies(),
        "patch_partitioned": _edit_vacancies(),
        "edit_leavers": _sql(
            "SELECT * REPLACE (CASE WHEN tipo_baja = 'VOLUNTARIA' THEN CONCAT(upper(motivo_baja), ' POR DECISION PROPIA') "
            "ELSE motivo_baja END AS motivo_baja) FROM bajas",
            "bajas",
        ),
        "update_vacancies": _sql(
            "SELECT * REPLACE ("
            "CASE WHEN fase_proceso = 'CONTRATADO' THEN upper(trim(puesto_vacante)) ELSE puesto_vacante END AS puesto_vacante, "
            "CASE WHEN fase_proceso = 'CONTRATADO' THEN CASE WHEN vacantes_solicitadas > 1 THEN 'SEGUN PLAN' END "
            "ELSE comentarios_vacante END AS comentarios_vacante, "
            "CASE WHEN fase_proceso = 'CONTRATADO' AND id % 5 = 0 THEN NULL ELSE vacantes_solicitadas END AS vacantes_solicitadas, "
            "CASE WHEN fase_proceso = 'CONTRATADO' AND id % 3 = 0 THEN NULL ELSE vacantes_contratados END AS vacantes_contratados, "
            "CASE WHEN fase_proceso = 'CONTRATADO' THEN NULL ELSE fecha_avance END AS fecha_avance) FROM vacantes",
            "vacantes",
        ),
        "update_master": _sql(
            "SELECT id, tipo_registro, CASE WHEN area = 'OPERATIVA' THEN CONCAT(upper(puesto), ' B') ELSE puesto END AS puesto, "
            "empresa, plaza, area FROM registros_rh",
            "registros_rh",
        ),
        "vacancies_by_key": _sql(
            f", {_CLEANSED} SELECT id, id_sistema, puesto_vacante, fase_proceso FROM vacantes "
            "WHERE id_sistema IN (SELECT id_sistema FROM limpia WHERE id_sistema IS NOT NULL)",
            "vacantes", "importacion",
        ),
        "lookup_pruned": _sql(
            f", {_CLEANSED} SELECT id, id_sistema, puesto_vacante, fase_proceso FROM vacantes "
            "WHERE id_sistema IN (SELECT id_sistema FROM limpia WHERE id_sistema IS NOT NULL AND motivo IS NOT NULL)",
            "vacantes", "importacion",
        ),
        "import_cleansed": _sql(f", {_CLEANSED} SELECT * FROM limpia", "importacion"),
        "import_upsert": _import_upsert(),
        "import_master": _import_master(),
        "import_commit": _import_twice(),
        "window_from_daily": _window_from_daily(),
        "import_report": _sql(
            f", {_MATCHED} SELECT CAST(SUM(CASE WHEN id_vacante IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nuevos, "
            "CAST(SUM(CASE WHEN id_vacante IS NULL THEN filas - 1 ELSE filas END) AS BIGINT) AS actualizados, "
            "(SELECT COUNT(*) FROM limpia WHERE motivo IS NOT NULL) AS fallidos, "
            "(SELECT COUNT(*) FROM validas) AS procesados, "
            "(SELECT GREATEST(COUNT(*) - 10, 0) FROM limpia WHERE motivo IS NOT NULL) AS errores_no_mostrados FROM casadas",
            "vacantes", "importacion",
        ),
        "import_long_keys": _sql(f", {_CLEANSED} SELECT row_idx, id_sistema, motivo FROM limpia", "importacion").replace(
            _CTES["importacion"], _LONG_KEYS
        ),
        "import_long_keys_upsert": _import_upsert().replace(_CTES["importacion"], _LONG_KEYS),
        "drop_folder_import": _import_upsert().replace(_CTES["importacion"], _NUMBERED),
        "drop_folder_rejects": _sql("SELECT 'número de columnas' AS motivo, linea AS texto FROM lineas_csv WHERE orden % 10 IN (0, 5)", "lineas_csv"),
        "drop_folder_rows": _sql(
            "SELECT CAST(o_orderkey AS STRING) AS \"ID\", CASE WHEN o_orderkey % 10 = 2 THEN 'puesto, con coma' ELSE o_orderpriority END AS \"Puesto solicitado\", "
            "CASE WHEN o_orderkey % 10 = 2 THEN CONCAT('primera ', CAST(o_orderkey AS STRING), CHR(10), 'segunda') "
            "WHEN o_orderkey % 2 = 0 THEN 'dijo \"sí\"' END AS \"Comentarios Del Seguimiento Del Proceso\", "
            "CASE WHEN o_orderkey % 2 = 1 THEN CONCAT('plaza ', CAST(o_custkey % 9 AS STRING)) END AS \"Plaza\" "
            "FROM orders, lineas_csv WHERE orden = o_orderkey AND o_orderkey % 10 NOT IN (0, 5)",
            "lineas_csv",
        ),
        "import_dates": _sql("SELECT id, esperada AS fecha FROM fechas", "fechas"),
        "strict_dates": _sql(
            "SELECT id, CASE WHEN id % 21 = 0 THEN esperada END AS estricta, esperada AS leida, CAST(esperada AS STRING) AS iso FROM fechas",
            "fechas",
        ),
        "weeks_in_years": _sql(
            "SELECT DISTINCT CAST(year(fecha_alta) AS INT) AS anio, CAST(week(make_date(year(fecha_alta), 12, 28)) AS INT) AS semanas FROM altas", "altas"
        ),
        "catalog_check": _sql(_outside_catalogs(), "vacantes"),
        "import_rejects": _sql(
            f", {_CLEANSED} SELECT row_idx, motivo FROM limpia WHERE motivo IS NOT NULL", "importacion"
        ),
        "import_first_errors": _sql(
            f", {_CLEANSED} SELECT row_idx, CONCAT('Error en fila ', row_idx + 1, ': ', motivo) AS error FROM limpia "
            "WHERE motivo IS NOT NULL ORDER BY row_idx LIMIT 10",
            "importacion",
        ),
        "import_preview": _sql("SELECT * FROM importacion ORDER BY row_idx LIMIT 10", "importacion"),
        "text_rules": _sql(
            f", n AS (SELECT *, string_split_regex(trim(responsable_alta), '\\s+')[1] AS p FROM altas) "
            f"SELECT id, {_MASKED.format('puesto_alta')} AS puesto_visible, CASE p WHEN 'MARTA' THEN 'HELEN' "
            "WHEN 'LETICIA' THEN 'LETY' WHEN 'YULIANA' THEN 'YULI' ELSE p END AS primer_nombre, "
            f"{_LISTED.format('responsable_alta')} AS ejecutivo, "
            f"COALESCE({_HELEN.format('responsable_alta')}, FALSE) AS es_helen, "
            f"{_FOLDED.format('upper(empresa_alta)')} AS empresa_plana, "
            "COALESCE(NULLIF(trim(responsable_alta), ''), 'SIN ESPECIFICAR') AS responsable FROM n",
            "altas",
        ),
    }


def _edit_vacancies() -> str:
    return _sql(
        "SELECT * REPLACE ("
        "CASE WHEN estatus_solicitud = 'PENDIENTE' THEN 'EN PRUEBA TECNICA' ELSE fase_proceso END AS fase_proceso, "
        "CASE WHEN estatus_solicitud = 'PENDIENTE' THEN CASE WHEN confidencial = 'SI' THEN 'SEGUN PLAN, ÑANDU' END "
        "ELSE comentarios_vacante END AS comentarios_vacante) FROM vacantes",
        "vacantes",
    )


def _outside_catalogs() -> str:
    def odd(column: str, allowed: tuple[str, ...]) -> str:
        listed = ", ".join(f"'{v}'" for v in allowed)
        return (
            f"SELECT '{column}' AS columna, trim({column}) AS valor, COUNT(*) AS filas FROM vacantes "
            f"WHERE trim({column}) <> '' AND trim({column}) NOT IN ({listed}) GROUP BY 2"
        )

    return " UNION ALL ".join(odd(c, allowed) for c, allowed in catalogs.VACANCY_DOMAINS.items())


def _overview() -> str:
    return _sql(
        ", q AS (SELECT * FROM vacantes WHERE year(fecha_autorizacion) = 1998 "
        f"AND list_has_any({_WORDS.format('responsable_vacante')}, ['LETICIA', 'LETY'])), "
        "b AS (SELECT "
        f"(SELECT CAST(COALESCE(SUM({_HIRES}), 0) AS BIGINT) FROM altas WHERE year(fecha_alta) = 1998 "
        f"AND list_has_any({_WORDS.format('responsable_alta')}, ['LETICIA', 'LETY'])) AS contratados, "
        "(SELECT COUNT(*) FROM bajas_sistema WHERE id > 0 AND year(fecha_baja) = 1998) AS bajas, "
        f"(SELECT CAST(COALESCE(SUM({_OPENINGS}), 0) AS BIGINT) FROM vacantes WHERE {_OPEN} "
        "AND fecha_autorizacion IS NOT NULL) AS vacantes, "
        f"(SELECT CAST(COALESCE(SUM({_OPENINGS} + {_HIRED}), 0) AS BIGINT) FROM q) AS requisiciones, "
        "(SELECT COUNT(*) FROM q WHERE fase_proceso = 'SIN SOLICITUD DE REQUISICION') AS no_requisitadas, "
        "(SELECT CAST(n_vacantes AS BIGINT) FROM snapshot ORDER BY anio DESC, semana_iso DESC LIMIT 1) "
        "AS n_vacantes_anterior, "
        "(SELECT CONCAT('S', semana_iso, ' ', anio) FROM snapshot ORDER BY anio DESC, semana_iso DESC LIMIT 1) "
        "AS semana_anterior) "
        "SELECT *, (vacantes - n_vacantes_anterior) / n_vacantes_anterior * 100 AS vacantes_variacion_pct, "
        "CASE WHEN requisiciones > 0 THEN round_even(contratados / requisiciones * 100, 2) ELSE 0.0::DOUBLE END "
        "AS contrataciones_pct FROM b",
        "altas", "bajas_sistema", "vacantes", "snapshot",
    )


def _leavers(where: str) -> str:
    from reclutark.plans import listings

    name = "trim(CONCAT(COALESCE(nombre, ''), ' ', COALESCE(apellido_paterno, ''), ' ', COALESCE(apellido_materno, '')))"
    return _sql(
        f"SELECT {_titles(listings.LEAVERS, {'nombre_completo': name})} FROM bajas_sistema WHERE {where}", "bajas_sistema"
    )
