"""Workforce tables derived from the test data (see FIXTURES.md).

Every derivation is one SQL expression that Spark and DuckDB read alike, so the checking SQL uses the same
text.  A table only joins what the asked columns need: ``customer`` and ``nation`` are looked up by their
primary keys with left joins, so leaving a lookup out changes no other column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RECRUITER = (
    "CASE o_custkey % 7 WHEN 0 THEN 'MARTA ELENA UNO' WHEN 1 THEN 'Leticia Dos' WHEN 2 THEN 'DIEGO TRES' "
    "WHEN 3 THEN 'YULIANA  CUATRO' WHEN 4 THEN 'AGENCIA' WHEN 5 THEN 'SIN ESPECIFICAR' ELSE NULL END"
)
CONFIDENTIAL = "CASE WHEN o_orderkey % 11 = 0 THEN 'SI' WHEN o_orderkey % 11 = 1 THEN NULL ELSE 'NO' END"
ORDER_DATE = "CAST(o_orderdate AS DATE)"

ALTAS = {
    "id": "o_orderkey",
    "id_registro": "o_orderkey + 1000000",
    "fecha_alta": ORDER_DATE,
    "empresa_alta": (
        "CASE o_custkey % 9 WHEN 0 THEN 'SICMART SA DE CV' WHEN 1 THEN 'Ñandú Construcción S.A.' WHEN 2 THEN NULL "
        "ELSE c_mktsegment END"
    ),
    "puesto_alta": "o_orderpriority",
    "plaza_alta": "n_name",
    "area_alta": "CASE WHEN o_orderkey % 3 = 0 THEN 'ADMINISTRATIVA' ELSE 'OPERATIVA' END",
    "contratados_alta": "CAST(o_orderkey % 4 AS STRING)",
    "medio_reclutamiento_alta": (
        "CASE o_custkey % 5 WHEN 0 THEN 'REDES PAGADAS' WHEN 1 THEN 'INDEED' WHEN 2 THEN 'OCC' "
        "WHEN 3 THEN 'REFERIDO' ELSE 'SIN ESPECIFICAR' END"
    ),
    "responsable_alta": RECRUITER,
    "confidencial": CONFIDENTIAL,
}

VACANTES = {
    "id": "o_orderkey",
    "id_registro": "o_orderkey + 2000000",
    "id_sistema": "o_orderkey + 1",
    "fecha_solicitud": ORDER_DATE,
    "tipo_solicitud": "CASE o_custkey % 3 WHEN 0 THEN 'NUEVO' WHEN 1 THEN 'REEMPLAZO' ELSE 'SIN ESPECIFICAR' END",
    "estatus_solicitud": (
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'FINALIZADO' "
        "WHEN o_orderkey % 7 = 0 THEN 'PAUSADO' WHEN o_orderkey % 7 = 1 THEN 'CANCELADO' "
        "WHEN o_orderkey % 7 = 2 THEN 'RECHAZADA' WHEN o_orderkey % 7 = 3 THEN 'PENDIENTE' ELSE 'PROCESO' END"
    ),
    "fase_proceso": (
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'CONTRATADO' "
        "WHEN o_orderpriority = '1-URGENT' THEN 'SIN SOLICITUD DE REQUISICION' "
        "WHEN o_orderpriority = '2-HIGH' THEN 'EN ENTREVISTA TELEFONICA' "
        "ELSE 'EN PROCESO DE CONTRATACION' END"
    ),
    "fecha_avance": f"{ORDER_DATE} + CAST(o_orderkey % 9 AS INT)",
    "fecha_autorizacion": (
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN DATE '1900-01-01' "
        f"ELSE {ORDER_DATE} + CAST(o_orderkey % 5 AS INT) END"
    ),
    "puesto_vacante": "o_orderpriority",
    "plaza_vacante": "n_name",
    "empresa_vacante": "c_mktsegment",
    "funcion_area_vacante": "CASE WHEN o_custkey % 4 = 0 THEN 'ADMINISTRATIVA' ELSE 'OPERATIVA' END",
    "vacantes_solicitadas": "CAST(o_orderkey % 4 AS INT)",
    "vacantes_contratados": (
        "CASE WHEN o_orderstatus = 'F' THEN CAST(1 + o_orderkey % 3 AS STRING) "
        "WHEN o_orderkey % 23 = 0 THEN 'n/a' ELSE '0' END"
    ),
    "responsable_vacante": RECRUITER,
    "comentarios_vacante": "CASE WHEN o_orderkey % 6 = 0 THEN 'REVISIÓN TÉCNICA' ELSE NULL END",
    "tipo_reclutamiento_vacante": (
        "CASE WHEN o_orderkey % 2 = 0 THEN 'RECLUTAMIENTO EXTERNO' ELSE 'PROMOCION INTERNA' END"
    ),
    "medio_reclutamiento_vacante": "CASE WHEN o_orderkey % 2 = 0 THEN 'INDEED' ELSE 'REFERIDO' END",
    "fecha_cobertura": (
        "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 19 <> 0 "
        f"THEN {ORDER_DATE} + CAST((o_orderkey * 7) % 61 - 2 AS INT) ELSE NULL END"
    ),
    "confidencial": CONFIDENTIAL,
}

REGISTROS_RH = {
    "id": "o_orderkey + 2000000",
    "tipo_registro": "'Vacante'",
    "fecha_creacion": "CAST(o_orderdate AS TIMESTAMP)",
    "puesto": "o_orderpriority",
    "empresa": "c_mktsegment",
    "plaza": "n_name",
    "area": "CASE WHEN o_custkey % 4 = 0 THEN 'ADMINISTRATIVA' ELSE 'OPERATIVA' END",
    "ultima_actualizacion": f"CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST({ORDER_DATE} AS STRING) END",
}

BAJAS_SISTEMA = {
    "id": "event_id",
    "no_colaborador": "user_id",
    "nombre": "CONCAT('N', CAST(user_id AS STRING))",
    "apellido_paterno": "CASE WHEN user_id % 4 = 0 THEN NULL ELSE CONCAT('P', CAST(user_id AS STRING)) END",
    "apellido_materno": "CASE WHEN user_id % 6 = 0 THEN NULL ELSE CONCAT('M', CAST(user_id AS STRING)) END",
    "empresa": "CONCAT('EMPRESA ', CAST(user_id % 5 AS STRING))",
    "puesto": "event_type",
    "plaza": "CONCAT('PLAZA ', CAST(user_id % 8 AS STRING))",
    "funcion_area": "CASE WHEN user_id % 3 = 0 THEN 'ADMINISTRATIVA' ELSE 'OPERATIVA' END",
    "departamento": "CONCAT('DEPTO ', CAST(user_id % 4 AS STRING))",
    "fecha_ingreso": "CAST(ts AS DATE) - CAST(user_id % 400 AS INT)",
    "fecha_baja": "CAST(ts AS DATE)",
    "motivo_baja": "event_type",
    "tipo_nomina": "CASE WHEN user_id % 2 = 0 THEN 'SEMANAL' ELSE 'QUINCENAL' END",
    "gerente": "CONCAT('G', CAST(user_id % 10 AS STRING))",
    "jefe": "CONCAT('J', CAST(user_id % 20 AS STRING))",
}

BAJAS = {
    "id": "event_id",
    "id_registro": "event_id + 3000000",
    "fecha_baja": "CAST(ts AS DATE)",
    "puesto_baja": "event_type",
    "empresa_baja": "CONCAT('EMPRESA ', CAST(user_id % 5 AS STRING))",
    "plaza_baja": "CONCAT('PLAZA ', CAST(user_id % 8 AS STRING))",
    "area_baja": "CASE WHEN user_id % 3 = 0 THEN 'ADMINISTRATIVA' ELSE 'OPERATIVA' END",
    "fecha_ingreso": "CAST(ts AS DATE) - CAST(user_id % 400 AS INT)",
    "tipo_baja": "CASE WHEN event_id % 2 = 0 THEN 'INDUCIDA' ELSE 'VOLUNTARIA' END",
    "motivo_baja": "event_type",
    "fecha_registro_baja": "CAST(ts AS DATE) + CAST(event_id % 3 AS INT)",
}

COLABORADORES_ACTIVOS = {
    "id_colaborador": "c_custkey",
    "nombre_completo": "c_name",
    "empresa": "c_mktsegment",
    "plaza": "n_name",
    "departamento": "CONCAT('DEPTO ', CAST(c_custkey % 6 AS STRING))",
    "puesto": "CONCAT('PUESTO ', CAST(c_custkey % 9 AS STRING))",
    "activo": "CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE c_acctbal > 0 END",
}

CATALOGO_DOCUMENTOS = {
    "id": "CAST(l_linenumber AS BIGINT)",
    "nombre_documento": "CONCAT('DOC_', CAST(l_linenumber AS STRING))",
    "requerido": "l_linenumber <= 3",
}

ARCHIVOS_EXPEDIENTES = {
    "id_colaborador": "o_custkey",
    "id_documento": "CAST(l_linenumber AS BIGINT)",
    "estatus_pdf": "CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'N' THEN FALSE ELSE NULL END",
}

# Staged spreadsheet rows, all text: one per order, with keys repeated, blank, zero or not a number, positions
# blank, dates that are serials or words.
IMPORT_STAGING = {
    "row_idx": "o_orderkey",
    "ID": (
        "CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN '0' "
        "WHEN o_orderkey % 41 = 0 THEN 'abc' WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 45 + 1 AS STRING) "
        "WHEN o_orderkey % 7 = 0 THEN CAST(9000000 + o_orderkey % 63 AS STRING) "
        "WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey + 1 AS STRING) ELSE CAST(8000000 + o_orderkey AS STRING) END"
    ),
    "Fecha Solicitud": (
        f"CASE WHEN o_orderkey % 8 = 1 THEN '45000' WHEN o_orderkey % 8 = 2 THEN 'pendiente' "
        f"ELSE CAST({ORDER_DATE} AS STRING) END"
    ),
    "Tipo de solicitud": "CASE WHEN o_custkey % 3 = 0 THEN ' nuevo ' WHEN o_custkey % 3 = 1 THEN 'Reemplazo' END",
    "Estatus De Solicitud": "CASE WHEN o_orderstatus = 'F' THEN 'Finalizado' ELSE 'proceso ' END",
    "Fase del Proceso": "CASE WHEN o_orderstatus = 'F' THEN ' contratado' ELSE 'En entrevista telefonica' END",
    "Fecha de avance del proceso": f"CAST({ORDER_DATE} AS STRING)",
    "Fecha Autorizada": f"CAST({ORDER_DATE} + CAST(o_orderkey % 5 AS INT) AS STRING)",
    "Puesto solicitado": "CASE WHEN o_orderkey % 29 = 0 THEN '   ' ELSE CONCAT(' ', LOWER(o_orderpriority)) END",
    "Plaza": "CONCAT('plaza ', CAST(o_custkey % 9 AS STRING), ' ')",
    "Empresa": "CONCAT('Empresa ', CAST(o_custkey % 4 AS STRING))",
    "Función Área": "CASE WHEN o_custkey % 4 = 0 THEN 'Administrativa' ELSE 'operativa' END",
    "No.Vacantes Solicitadas": (
        "CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderkey % 47 = 0 THEN 'dos' "
        "ELSE CAST(o_orderkey % 4 AS STRING) END"
    ),
    "No. Vacantes Contratados": "CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 3 AS STRING) END",
    "Responsable Del Proceso": RECRUITER,
    "Comentarios Del Seguimiento Del Proceso": "CASE WHEN o_orderkey % 2 = 0 THEN ' revisión técnica ñ' END",
    "Tipo de Reclutamiento": "CASE WHEN o_orderkey % 4 = 1 THEN 'interno' WHEN o_orderkey % 4 = 2 THEN '  ' END",
    "Medio de Reclutamiento/HeadHunter": "CASE WHEN o_orderkey % 4 = 3 THEN 'Occ ' END",
    "Fecha Del Seguimiento Del Proceso": f"CAST({ORDER_DATE} + 20 AS STRING)",
}

# Replies of an assistant: the JSON of each event inside a code fence, nested as text for every other one.
RESPUESTAS = {
    "id": "event_id",
    "texto": (
        "CASE WHEN event_id % 3 = 0 THEN 'sin datos' WHEN event_id % 3 = 1 "
        "THEN CONCAT('Aquí está: ```json', props, '```') "
        "ELSE CONCAT('{\"output\": \"', REPLACE(props, '\"', CONCAT(CHR(92), '\"')), '\"}') END"
    ),
}

# Staged rows whose keys are long, fractional, in exponent form or beyond a BIGINT.
IMPORT_LONG_KEYS = IMPORT_STAGING | {
    "ID": (
        "CASE o_orderkey % 7 WHEN 0 THEN CAST(9223372036854775807 - o_orderkey AS STRING) WHEN 1 THEN '1.5E+05' "
        "WHEN 2 THEN CONCAT(CAST(o_orderkey + 1 AS STRING), '.75') "
        "WHEN 3 THEN CONCAT('9', CAST(9223372036854775807 - o_orderkey AS STRING)) "
        "WHEN 4 THEN CONCAT(CAST(o_orderkey AS STRING), 'e1') WHEN 5 THEN ' .5 ' ELSE '12e' END"
    ),
}

_KEY = "CAST(o_orderkey AS STRING)"

# Lines of dropped CSV files, whose header depends on the file: too few or too many cells, commas, quotes and line breaks inside quotes.
DROPPED_HEADERS = ("ID,Puesto solicitado,Comentarios Del Seguimiento Del Proceso", " Puesto solicitado ,ID,Plaza")
DROPPED_LINES = {
    "archivo": "CAST(o_orderkey % 4 AS INT)",
    "orden": "o_orderkey",
    "linea": (
        f"CASE WHEN o_orderkey % 10 = 0 THEN CONCAT({_KEY}, ',sólo dos') "
        f"WHEN o_orderkey % 10 = 2 THEN CONCAT({_KEY}, ',\"puesto, con coma\",\"primera ', {_KEY}, CHR(10), 'segunda\"') "
        f"WHEN o_orderkey % 2 = 0 THEN CONCAT({_KEY}, ',', o_orderpriority, ',\"dijo \"\"sí\"\"\"') "
        f"WHEN o_orderkey % 10 = 5 THEN CONCAT('a,', {_KEY}, ',b,c') "
        f"ELSE CONCAT(o_orderpriority, ',', {_KEY}, ',plaza ', CAST(o_custkey % 9 AS STRING)) END"
    ),
}

_Y, _M, _D = "CAST(YEAR(o_orderdate) AS STRING)", *(
    f"LPAD(CAST({part}(o_orderdate) AS STRING), 2, '0')" for part in ("MONTH", "DAY")
)
_ENGLISH = (
    "CASE MONTH(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April' "
    "WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September' "
    "WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END"
)
_SHAPES = (
    (f"CAST({ORDER_DATE} AS STRING)",), (_Y, "'.'", _M, "'.'", _D), (_Y, _M, _D), (_M, "'/'", _D, "'/'", _Y),
    (_M, "'.'", _D, "'.'", _Y), (_M, "'/'", _D, "'/'", f"SUBSTR({_Y}, 3, 2)"), (_ENGLISH, "' '", _D, "', '", _Y),
    (_D, "'-'", f"SUBSTR({_ENGLISH}, 1, 3)", "'-'", _Y), (_D, "' '", f"LOWER({_ENGLISH})", "' '", _Y),
    (_M, "'/'", _D, "'/'", _Y, "' 02:30 PM'"), ("'  '", f"CAST({ORDER_DATE} AS STRING)", "' 11:30:00 AM '"),
    (_Y, "'/'", _M, "'/'", _D, "'T08:15:00'"), ("'45000'",), ("'15 marzo 2024'",), ("'2024-13-01'",),
    (_Y, _M, _D, "' 10:00'"), (_Y, "'-'", f"SUBSTR({_ENGLISH}, 1, 3)", "'-'", _D),
    (_Y, "'-'", _M), (f"SUBSTR({_ENGLISH}, 1, 3)", "' '", _Y), (_M, "'/'", _Y), (_Y, "' '", _ENGLISH),
)

# The day of an order as text, in the shapes that spreadsheets hold, and text that is no date.
DATE_TEXTS = {
    "id": "o_orderkey",
    "esperada": (
        f"CASE WHEN o_orderkey % 21 < 12 OR o_orderkey % 21 IN (15, 16) THEN {ORDER_DATE} "
        f"WHEN o_orderkey % 21 > 16 THEN CAST(DATE_TRUNC('month', {ORDER_DATE}) AS DATE) END"
    ),
    "texto": "CASE o_orderkey % 21 "
    + " ".join(f"WHEN {k} THEN CONCAT({', '.join(shape)})" for k, shape in enumerate(_SHAPES))
    + " END",
}

# Replies whose JSON is broken, followed by other text, in single quotes, nested as an object, a list, or repeats a name.
REPLIES = {
    "id": "event_id",
    "texto": (
        """CASE event_id % 10 WHEN 9 THEN CONCAT('{"output": "primero", "chart": 1, "output": "', event_type, '"}') WHEN 0 THEN CONCAT(props, ' y ', props) WHEN 1 THEN CONCAT('{"output": "x"} fin ', props) """
        """WHEN 2 THEN CONCAT(props, '}') WHEN 3 THEN REPLACE(props, '"', CHR(39)) """
        """WHEN 4 THEN CONCAT('{"output": ', props, '}') WHEN 5 THEN CONCAT('[{"output": "', event_type, '"}]') """
        """WHEN 6 THEN CONCAT('{"output": "', event_type, '", "chart": ', props, '}') """
        """WHEN 7 THEN CONCAT(props, ', {"b": 2}') """
        """ELSE CONCAT('{"output": "', REPLACE(props, '"', CONCAT(CHR(92), '"')), '"}') END"""
    ),
}

ORDER_TABLES = {"altas": ALTAS, "vacantes": VACANTES, "registros_rh": REGISTROS_RH, "importacion": IMPORT_STAGING}
EVENT_TABLES = {"bajas_sistema": BAJAS_SISTEMA, "bajas": BAJAS, "respuestas": RESPUESTAS}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _project(source: DataFrame, table: dict[str, str], columns: tuple[str, ...]) -> DataFrame:
    return source.select(*[F.expr(table[c]).alias(c) for c in columns or table])


def _needs(table: dict[str, str], columns: tuple[str, ...], prefix: str) -> bool:
    return any(prefix in table[c] for c in columns or table)


def _orders(spark: SparkSession, sf_dir: str, table: dict[str, str], columns: tuple[str, ...]) -> DataFrame:
    source = _read(spark, sf_dir, "orders")
    if _needs(table, columns, "n_name") or _needs(table, columns, "c_mktsegment"):
        # The dimensions are joined to each other first, so the orders are joined, and shuffled, once at most.
        people = _customers(spark, sf_dir, _needs(table, columns, "n_name"))
        source = source.join(people, F.expr("o_custkey = c_custkey"), "left")
    return _project(source, table, columns)


def _customers(spark: SparkSession, sf_dir: str, with_nation: bool) -> DataFrame:
    people = _read(spark, sf_dir, "customer")
    if with_nation:
        people = people.join(_read(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"), "left")
    return people


def altas(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _orders(spark, sf_dir, ALTAS, columns)


def vacantes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _orders(spark, sf_dir, VACANTES, columns)


def registros_rh(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _orders(spark, sf_dir, REGISTROS_RH, columns)


def importacion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(_read(spark, sf_dir, "orders"), IMPORT_STAGING, ())


def claves_largas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(_read(spark, sf_dir, "orders"), IMPORT_LONG_KEYS, ())


def fechas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(_read(spark, sf_dir, "orders"), DATE_TEXTS, ())


def lineas_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of dropped files (archivo, orden, linea), their headers first; files of odd number have the second header."""
    lines = _project(_read(spark, sf_dir, "orders"), DROPPED_LINES, ())
    header = F.when(F.col("archivo") % 2 == 0, DROPPED_HEADERS[0]).otherwise(DROPPED_HEADERS[1])
    files = spark.range(4).select(F.col("id").cast("int").alias("archivo"), F.lit(-1).cast("long").alias("orden"))
    return lines.unionByName(files.withColumn("linea", header))


def contestaciones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(_read(spark, sf_dir, "events"), REPLIES, ())


def bajas_sistema(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _project(_read(spark, sf_dir, "events"), BAJAS_SISTEMA, columns)


def bajas(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _project(_read(spark, sf_dir, "events"), BAJAS, columns)


def respuestas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(_read(spark, sf_dir, "events"), RESPUESTAS, ())


def colaboradores_activos(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    source = _customers(spark, sf_dir, _needs(COLABORADORES_ACTIVOS, columns, "n_name"))
    return _project(source, COLABORADORES_ACTIVOS, columns)


def catalogo_documentos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(_read(spark, sf_dir, "lineitem").select("l_linenumber").distinct(), CATALOGO_DOCUMENTOS, ())


def archivos_expedientes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return _project(lines.join(orders, F.expr("l_orderkey = o_orderkey")), ARCHIVOS_EXPEDIENTES, ())


def snapshot_vacantes_semanales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vacancies of each week: the orders of the week."""
    week, year = F.weekofyear("o_orderdate").alias("semana_iso"), F.year("o_orderdate").alias("año")
    return _read(spark, sf_dir, "orders").groupBy(week, year).agg(F.count("*").cast("int").alias("n_vacantes"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations")
