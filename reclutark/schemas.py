"""Stored tables, one schema each in DDL form (readers take it as it is)."""


REGISTROS_RH = (
    "id BIGINT, tipo_registro STRING, fecha_creacion TIMESTAMP, puesto STRING, empresa STRING, plaza STRING, "
    "area STRING, ultima_actualizacion STRING"
)

ALTAS = (
    "id BIGINT, id_registro BIGINT, fecha_alta DATE, empresa_alta STRING, puesto_alta STRING, "
    "plaza_alta STRING, area_alta STRING, contratados_alta STRING, medio_reclutamiento_alta STRING, "
    "responsable_alta STRING, confidencial STRING"
)

BAJAS = (
    "id BIGINT, id_registro BIGINT, fecha_baja DATE, puesto_baja STRING, empresa_baja STRING, "
    "plaza_baja STRING, area_baja STRING, fecha_ingreso DATE, tipo_baja STRING, motivo_baja STRING, "
    "fecha_registro_baja DATE"
)

BAJAS_SISTEMA = (
    "id BIGINT, no_colaborador BIGINT, nombre STRING, apellido_paterno STRING, apellido_materno STRING, "
    "empresa STRING, puesto STRING, plaza STRING, funcion_area STRING, departamento STRING, "
    "fecha_ingreso DATE, fecha_baja DATE, motivo_baja STRING, tipo_nomina STRING, gerente STRING, jefe STRING"
)

VACANTES = (
    "id BIGINT, id_registro BIGINT, id_sistema BIGINT, fecha_solicitud DATE, tipo_solicitud STRING, "
    "estatus_solicitud STRING, fase_proceso STRING, fecha_avance DATE, fecha_autorizacion DATE, "
    "puesto_vacante STRING, plaza_vacante STRING, empresa_vacante STRING, funcion_area_vacante STRING, "
    "vacantes_solicitadas INT, vacantes_contratados STRING, responsable_vacante STRING, "
    "comentarios_vacante STRING, tipo_reclutamiento_vacante STRING, medio_reclutamiento_vacante STRING, "
    "fecha_cobertura DATE, confidencial STRING"
)

SNAPSHOT_VACANTES_SEMANALES = ("n_vacantes INT, semana_iso INT, `año` INT")

CATALOGO_DOCUMENTOS = ("id BIGINT, nombre_documento STRING, requerido BOOLEAN")

COLABORADORES_ACTIVOS = (
    "id_colaborador BIGINT, nombre_completo STRING, empresa STRING, plaza STRING, departamento STRING, "
    "puesto STRING, activo BOOLEAN"
)

ARCHIVOS_EXPEDIENTES = ("id_colaborador BIGINT, id_documento BIGINT, estatus_pdf BOOLEAN")

TABLES = {
    "registros_rh": REGISTROS_RH,
    "altas": ALTAS,
    "bajas": BAJAS,
    "bajas_sistema": BAJAS_SISTEMA,
    "vacantes": VACANTES,
    "snapshot_vacantes_semanales": SNAPSHOT_VACANTES_SEMANALES,
    "catalogo_documentos": CATALOGO_DOCUMENTOS,
    "colaboradores_activos": COLABORADORES_ACTIVOS,
    "archivos_expedientes": ARCHIVOS_EXPEDIENTES,
}
