"""Allowed values, labels, aliases and goals.  Every operator takes them as arguments with these defaults."""

# --- Fixed values -------------------------------------------------------------------------------------------
# These lists, labels and numbers must equal the stored data and the published goals for results to be right.

SITES = (
    "ACAPULCO", "AGUASCALIENTES", "CANCUN", "CIUDAD DE MEXICO", "CIUDAD JUAREZ", "COLIMA", "ENSENADA",
    "GUADALAJARA", "IRAPUATO", "LEON", "MANZANILLO", "MAZATLAN", "MERIDA", "MONTERREY", "MORELIA", "PUEBLA",
    "QUERETARO", "SAN LUIS POTOSI", "TAMPICO", "TECOMAN", "TIJUANA", "VERACRUZ", "VILLAHERMOSA", "ZACATECAS",
)

COMPANY_SHORT_NAMES = {
    "MARKETING EN PUBLICIDAD DE QUERETARO SA DE CV": "MKT QRO",
    "SICMART SA DE CV": "SICMART",
    "SERVICIOS DE ANUNCIOS PUBLICITARIOS SA DE CV": "SAP",
    "ESPECIALISTAS PROFESIONALES DE LEON SA DE CV": "EPL",
    "VINCI GERENCIA ORGANIZACIONAL SA DE CV": "VINCI",
    "KRONOS AMBIENTAL SAPI DE CV": "KRONOS",
    "LUMINA PANTALLAS DIGITALES SA DE CV": "LUMINA",
    "F2 CONSULTING GROUP SA DE CV": "F2",
    "CORPORATIVO PUBLICITARIO MAO SA DE CV": "MAO",
    "DRAUBEN SA DE CV": "DRAUBEN",
    "THE BEST MARKETING SA DE CV": "TBM",
    "MONTAJE SUPERVISION Y CONSTRUCCION SA DE CV": "MSC",
    "FICORMA SA DE CV": "FICORMA",
}

COMPANIES = tuple(COMPANY_SHORT_NAMES)

AREAS = ("ADMINISTRATIVA", "OPERATIVA")

CHANNELS = (
    "COMPUTRABAJO", "HH", "INDEED", "LONAS", "MOVIMIENTO INTERNO", "OCC", "POSTULACION DIRECTA",
    "REDES PAGADAS", "REDES PROPIAS", "REFERIDO", "REINGRESO", "VOLANTEO", "SIN ESPECIFICAR",
)

STATUSES = ("CANCELADO", "CAPTURADA", "FINALIZADO", "PENDIENTE", "PROCESO", "RECHAZADA")

STAGES = (
    "CONTRATADO",
    "EN ENTREVISTA PERSONAL CON CAPITAL HUMANO",
    "EN ENTREVISTA PERSONAL CON GERENCIA DE INSTITUCIONALIZACIÓN / DIRECCIÓN",
    "EN ENTREVISTA PERSONAL CON SOLICITANTE DE LA POSICIÓN",
    "EN ENTREVISTA TELEFONICA",
    "EN INFORME DE LOS CANDIDADATOS SELECCIONADOS",
    "EN PROCESO DE PUBLICACION Y RECLUTAMIENTO",
    "EN PROCESO DE CONTRATACION",
    "EN PRUEBA TÉCNICA",
    "EN PRUEBAS PSICOMETRICAS",
    "EN REVISION Y FILTRO INICIAL DE CANDIDATOS",
    "EN VALIDACION DE REQUISICION DE PERSONAL & DESCRIPCION DE PUESTO",
    "SOLICITUD DE REQUISICION",
    "SIN SOLICITUD DE REQUISICION",
    "CANCELADO",
)

RECRUITING_TYPES = (
    "MOVIMIENTO LATERAL", "PROMOCION INTERNA", "RECLUTAMIENTO EXTERNO", "RECLUTAMIENTO INTERNO",
    "REFERIDO INTERNO", "SIN ESPECIFICAR",
)

REQUEST_TYPES = ("NUEVO", "REEMPLAZO", "SIN ESPECIFICAR")

RECORD_TYPES = ("Alta", "Baja", "Vacante")

MONTHS = (
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
)

MONTHS_SHORT = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")

# Recruiter first-name tokens: list for the annual and SLA reports, two alias tables.
RECRUITERS = ("DIEGO", "YULIANA", "LETICIA", "ELENA")
FILTER_ALIASES = {"MARTA": "HELEN", "ELENA": "HELEN", "LETICIA": "LETY"}
CHART_ALIASES = {"MARTA": "HELEN", "LETICIA": "LETY", "YULIANA": "YULI"}

PAID_MEDIA = "REDES PAGADAS"
UNSPECIFIED = "SIN ESPECIFICAR"
HIRED_STAGE = "CONTRATADO"
NO_REQUISITION_STAGE = "SIN SOLICITUD DE REQUISICION"
CLOSED_STATUSES = ("CANCELADO", "FINALIZADO", "PAUSADO")
CAPACITY_CLOSED_STATUSES = ("FINALIZADO", "PAUSADO", "CANCELADO", "RECHAZADA")
FUNNEL_EXCLUDED_STATUSES = ("PENDIENTE", "CANCELADO", "PAUSADO")
NOT_AUTHORISED = "1900-01-01"

# Goals in days, long-fill threshold, and the capacity parameters (hours per activity; team, hours, days).
GOAL_DAYS = {"OPERATIVA": 15, "ADMINISTRATIVA": 45}
SITE_GOAL_DAYS = 30
LONG_FILL_DAYS = 15
ACTIVITY_HOURS = (
    ("Revisión requisición", 0.1),
    ("Publicación vacante", 2.0),
    ("Filtro de candidatos", 2.0),
    ("Coordinar entrevistas", 3.0),
    ("Formato de competencias y perfil", 0.5),
    ("Entrevistas", 4.0),
    ("Selección final", 1.0),
    ("Envío Admin. de personal / seguimiento", 0.5),
)
TEAM_SIZE, HOURS_PER_DAY, WORKDAYS_PER_MONTH = 4, 9, 22

EFFICIENCY_BANDS = (
    (150.0, "Riesgo de saturación del proceso"),
    (100.0, "Sobrecarga operativa"),
    (80.0, "Operación estable"),
)
SPARE_CAPACITY = "Capacidad disponible / subutilización"

FACET_LABELS = {"true": "Entregado", "false": "Faltante"}
PAGE_SIZES = (10, 15, 25, 50)

# Stored column -> spreadsheet header, for the vacancy import.
IMPORT_COLUMNS = {
    "fecha_solicitud": "Fecha Solicitud",
    "tipo_solicitud": "Tipo de solicitud",
    "estatus_solicitud": "Estatus De Solicitud",
    "fase_proceso": "Fase del Proceso",
    "fecha_avance": "Fecha de avance del proceso",
    "fecha_autorizacion": "Fecha Autorizada",
    "puesto_vacante": "Puesto solicitado",
    "plaza_vacante": "Plaza",
    "empresa_vacante": "Empresa",
    "funcion_area_vacante": "Función Área",
    "vacantes_solicitadas": "No.Vacantes Solicitadas",
    "vacantes_contratados": "No. Vacantes Contratados",
    "responsable_vacante": "Responsable Del Proceso",
    "comentarios_vacante": "Comentarios Del Seguimiento Del Proceso",
    "tipo_reclutamiento_vacante": "Tipo de Reclutamiento",
    "medio_reclutamiento_vacante": "Medio de Reclutamiento/HeadHunter",
    "id_sistema": "ID",
    "fecha_cobertura": "Fecha Del Seguimiento Del Proceso",
}

# Stored vacancy columns and the values that the forms allow for them.
VACANCY_DOMAINS = {
    "tipo_solicitud": REQUEST_TYPES,
    "estatus_solicitud": STATUSES,
    "fase_proceso": STAGES,
    "plaza_vacante": SITES,
    "empresa_vacante": COMPANIES,
    "funcion_area_vacante": AREAS,
    "tipo_reclutamiento_vacante": RECRUITING_TYPES,
    "medio_reclutamiento_vacante": CHANNELS,
}
