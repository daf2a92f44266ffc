"""Named queries over the test data, one or more per operator."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reclutark import catalogs
from reclutark.functions import calendar, coerce, measures, text
from reclutark.functions.calendar import MONTH, QUARTER, RANGE, WEEK, YEAR, Period
from reclutark.operators import series, tableview
from reclutark.plans import annual, conversations, daily, dashboard, files, hires, listings, overview, sla, vacancies
from reclutark.session import scratch_folder
from reclutark.sources import fixtures as fx, ingest, tables
from reclutark.sources.versions import Store

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = dt.date(2001, 12, 31)
AT = dt.datetime(2001, 12, 31, 12)
QUARTER_2_1998 = Period(QUARTER, year=1998, quarter=2)
YEAR_1998 = Period(YEAR, year=1998)
MARCH_1998 = Period(MONTH, year=1998, month=3)
WEEK_53_1998 = Period(WEEK, year=1998, week=53)
RANGE_1998 = Period(RANGE, start=dt.date(1998, 2, 10), end=dt.date(1998, 11, 5))
WINDOWS = calendar.same_window([1996, 1997, 1998], (2, 29), (8, 15))
PIVOT_COLUMNS = [
    (name, area)
    for name in ("AGENCIA", "DIEGO TRES", "Leticia Dos", "MARTA ELENA UNO", "SIN ESPECIFICAR", "YULIANA  CUATRO")
    for area in ("ADMINISTRATIVA", "OPERATIVA")
]
CHARTED = ("id", "fecha_alta", "contratados_alta", "medio_reclutamiento_alta", "area_alta", "responsable_alta")
D1_COLUMNS = ("fecha_autorizacion", "fecha_solicitud", "fecha_cobertura", "vacantes_contratados", "vacantes_solicitadas")
OPEN_COLUMNS = ("estatus_solicitud", "fase_proceso", "funcion_area_vacante", *D1_COLUMNS)

_REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    _REGISTRY[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# --- Hires --------------------------------------------------------------------------------------------------


@query
def hires_by_channel(spark, d):
    rows = fx.altas(spark, d, "fecha_alta", "contratados_alta", "medio_reclutamiento_alta")
    return hires.by_channel(hires.selected(rows, QUARTER_2_1998))


@query
def hires_by_company(spark, d):
    rows = fx.altas(spark, d, "contratados_alta", "empresa_alta")
    names = {"AUTOMOBILE": "AUTO", "MACHINERY": "MAQ", "HOUSEHOLD": "HOGAR"}
    return hires.by_company(rows, names=names)


@query
def hires_by_company_chosen(spark, d):
    rows = fx.altas(spark, d, "contratados_alta", "empresa_alta")
    return hires.by_company(rows, companies=["BUILDING", "FURNITURE"])


@query
def hires_by_recruiter_area(spark, d):
    return hires.by_recruiter_and_area(fx.altas(spark, d, "contratados_alta", "area_alta", "responsable_alta"))


@query
def hires_by_month(spark, d):
    return hires.by_month(fx.altas(spark, d, "fecha_alta", "contratados_alta"))


@query
def paid_media_totals(spark, d):
    return hires.paid_media_totals(fx.altas(spark, d, *CHARTED))


@query
def paid_media_monthly(spark, d):
    return hires.paid_media_monthly(fx.altas(spark, d, *CHARTED))


@query
def pivot_hires(spark, d):
    return hires.pivot_cells(fx.altas(spark, d, *CHARTED))


@query
def pivot_hires_wide(spark, d):
    return hires.pivot_wide(fx.altas(spark, d, *CHARTED), PIVOT_COLUMNS)


@query
def hires_detail(spark, d):
    return hires.detail(hires.selected(fx.altas(spark, d), YEAR_1998))


def _period_totals(spark, d, period: Period, leavers_period: Period) -> DataFrame:
    hired = hires.selected(fx.altas(spark, d, "fecha_alta", "contratados_alta"), period)
    left = fx.bajas_sistema(spark, d, "id", "fecha_baja")
    return series.one_row(hires.total(hired), overview.leavers_total(left, leavers_period))


@query
def dashboard_cube(spark, d):
    """All breakdowns of the dashboard, from one reading of each table."""
    rows = fx.altas(spark, d, *CHARTED, "empresa_alta")
    return dashboard.blocks(hires.selected(rows, QUARTER_2_1998), fx.vacantes(spark, d), AS_OF, {})


@query
def period_all(spark, d):
    return _period_totals(spark, d, Period(), Period())


@query
def period_year(spark, d):
    return _period_totals(spark, d, YEAR_1998, Period(YEAR, year=2024))


@query
def period_quarter(spark, d):
    return _period_totals(spark, d, QUARTER_2_1998, Period(QUARTER, year=2024, quarter=1))


@query
def period_month(spark, d):
    return _period_totals(spark, d, MARCH_1998, Period(MONTH, year=2024, month=1))


@query
def period_week(spark, d):
    return _period_totals(spark, d, WEEK_53_1998, Period(WEEK, year=2024, week=3))


@query
def period_range(spark, d):
    leavers_range = Period(RANGE, start=dt.date(2024, 1, 5), end=dt.date(2024, 1, 20))
    return _period_totals(spark, d, RANGE_1998, leavers_range)


@query
def recruiter_filter(spark, d):
    rows = fx.altas(spark, d, "id", "responsable_alta", "contratados_alta")
    return hires.by_recruiter(rows, "responsable_alta", "HELEN")


# --- Overview and vacancies ---------------------------------------------------------------------------------


@query
def overview_kpis(spark, d):
    return overview.figures(
        fx.altas(spark, d, "fecha_alta", "contratados_alta", "responsable_alta"),
        fx.bajas_sistema(spark, d, "id", "fecha_baja"),
        fx.vacantes(spark, d, *OPEN_COLUMNS, "responsable_vacante"),
        fx.snapshot_vacantes_semanales(spark, d),
        YEAR_1998,
        "LETY",
    )


@query
def last_update(spark, d):
    return tables.last_update(fx.registros_rh(spark, d, "ultima_actualizacion"))


@query
def years_available(spark, d):
    return annual.years_available(
        [
            (fx.vacantes(spark, d, "fecha_solicitud", "fecha_cobertura"), ["fecha_solicitud", "fecha_cobertura"]),
            (fx.altas(spark, d, "fecha_alta"), ["fecha_alta"]),
            (fx.bajas_sistema(spark, d, "fecha_baja"), ["fecha_baja"]),
        ],
        AS_OF,
    )


@query
def years_filled(spark, d):
    return annual.years_of(fx.vacantes(spark, d, "fecha_cobertura"), "fecha_cobertura")


@query
def open_null_keeping(spark, d):
    return vacancies.open_total(fx.vacantes(spark, d, *OPEN_COLUMNS))


@query
def open_sql_nulls(spark, d):
    return vacancies.open_total_for_capacity(fx.vacantes(spark, d, *OPEN_COLUMNS))


@query
def open_age(spark, d):
    return vacancies.open_age(fx.vacantes(spark, d, *OPEN_COLUMNS), AS_OF)


@query
def closed_days(spark, d):
    rows = fx.vacantes(spark, d, *OPEN_COLUMNS, "responsable_vacante")
    return vacancies.closed_days(vacancies.closed_in(rows, YEAR_1998))


@query
def closed_days_recruiter(spark, d):
    rows = fx.vacantes(spark, d, *OPEN_COLUMNS, "responsable_vacante")
    return vacancies.closed_days(vacancies.closed_in(rows, RANGE_1998, "YULIANA"))


@query
def coverage_days(spark, d):
    rows = vacancies.with_days(fx.vacantes(spark, d, "id", *D1_COLUMNS), AS_OF)
    listed = measures.listing_days(F.col("fecha_autorizacion"), F.col("fecha_solicitud"), F.col("fecha_cobertura"), AS_OF)
    closed = measures.closed_days(F.col("fecha_autorizacion"), F.col("fecha_cobertura"))
    return rows.select("id", "dias", listed.alias("dias_listado"), closed.alias("dias_cerrada"))


@query
def coverage_days_tz(spark, d):
    rows = vacancies.with_days(fx.vacantes(spark, d, "id", *D1_COLUMNS), AS_OF, tz_exact=True)
    return rows.select("id", "dias")


@query
def openings_by_company(spark, d):
    return vacancies.by_company(fx.vacantes(spark, d, *OPEN_COLUMNS, "empresa_vacante"))


@query
def openings_by_area(spark, d):
    return vacancies.by_area(fx.vacantes(spark, d, *OPEN_COLUMNS))


@query
def vacancy_detail(spark, d):
    return vacancies.detail(fx.vacantes(spark, d), AS_OF)


@query
def pivot_openings(spark, d):
    return vacancies.pivot_openings(fx.vacantes(spark, d), AS_OF)


@query
def pivot_openings_tz(spark, d):
    return vacancies.pivot_openings(fx.vacantes(spark, d), AS_OF, tz_exact=True)


@query
def stage_funnel(spark, d):
    return vacancies.stage_funnel(fx.vacantes(spark, d, *OPEN_COLUMNS))


@query
def days_by_site(spark, d):
    rows = fx.vacantes(spark, d, *D1_COLUMNS, "plaza_vacante", "responsable_vacante")
    return vacancies.days_by(vacancies.closed_in(rows), "plaza_vacante", AS_OF)


@query
def days_by_site_tz(spark, d):
    rows = fx.vacantes(spark, d, *D1_COLUMNS, "plaza_vacante", "responsable_vacante")
    return vacancies.days_by(vacancies.closed_in(rows), "plaza_vacante", AS_OF, tz_exact=True)


@query
def days_by_position(spark, d):
    rows = fx.vacantes(spark, d, *D1_COLUMNS, "puesto_vacante", "responsable_vacante")
    return vacancies.days_by(vacancies.closed_in(rows, YEAR_1998), "puesto_vacante", AS_OF)


@query
def days_summary(spark, d):
    rows = fx.vacantes(spark, d, *D1_COLUMNS, "plaza_vacante", "puesto_vacante")
    return vacancies.days_summary(rows, AS_OF)


# --- Annual comparison --------------------------------------------------------------------------------------

ANNUAL_HIRES = ("fecha_alta", "contratados_alta", "area_alta", "responsable_alta")
ANNUAL_VACANCIES = ("fecha_solicitud", "tipo_solicitud", "fase_proceso", "vacantes_contratados")


@query
def yearly_yoy(spark, d):
    return annual.yearly(fx.altas(spark, d, *ANNUAL_HIRES))


@query
def yearly_yoy_area(spark, d):
    return annual.yearly(annual.of_area(fx.altas(spark, d, *ANNUAL_HIRES), "area_alta", "ADMINISTRATIVA"))


@query
def monthly_of_year(spark, d):
    return annual.monthly_of_year(fx.altas(spark, d, *ANNUAL_HIRES), 2001)


@query
def monthly_grid(spark, d):
    return annual.monthly_grid(fx.altas(spark, d, *ANNUAL_HIRES))


@query
def new_vs_replacement(spark, d):
    return annual.new_and_replacement(fx.vacantes(spark, d, *ANNUAL_VACANCIES), first_year=1997)


@query
def recruiter_year(spark, d):
    return annual.recruiters_by_year(fx.altas(spark, d, *ANNUAL_HIRES))


@query
def window_totals(spark, d):
    return annual.window_totals(fx.altas(spark, d, *ANNUAL_HIRES), fx.vacantes(spark, d, *ANNUAL_VACANCIES), WINDOWS)


@query
def window_monthly(spark, d):
    return annual.window_monthly(fx.altas(spark, d, *ANNUAL_HIRES), WINDOWS)


@query
def window_recruiter(spark, d):
    return annual.window_recruiters(fx.altas(spark, d, *ANNUAL_HIRES), WINDOWS)


@query
def range_totals(spark, d):
    return annual.range_totals(
        fx.altas(spark, d, *ANNUAL_HIRES), fx.vacantes(spark, d, *ANNUAL_VACANCIES), RANGE_1998.start, RANGE_1998.end
    )


@query
def range_monthly(spark, d):
    return annual.range_monthly(fx.altas(spark, d, *ANNUAL_HIRES), RANGE_1998.start, RANGE_1998.end)


@query
def range_recruiter(spark, d):
    return annual.range_recruiters(fx.altas(spark, d, *ANNUAL_HIRES), RANGE_1998.start, RANGE_1998.end)


# --- Service levels, capacity, files ------------------------------------------------------------------------


def _sla(spark, d, period: Period = Period()) -> DataFrame:
    rows = fx.vacantes(spark, d, *D1_COLUMNS, "funcion_area_vacante", "responsable_vacante")
    return sla.sla_rows(rows, period, AS_OF)


@query
def sla_by_area(spark, d):
    return sla.by_area(_sla(spark, d, YEAR_1998))


@query
def sla_recruiter(spark, d):
    return sla.by_recruiter(_sla(spark, d, MARCH_1998))


@query
def sla_trend(spark, d):
    return sla.monthly_trend(_sla(spark, d))


@query
def capacity(spark, d):
    return sla.capacity(fx.vacantes(spark, d, *OPEN_COLUMNS))


@query
def activity_hours(spark, d):
    return sla.activity_table(fx.vacantes(spark, d, *OPEN_COLUMNS))


@query
def file_kpis(spark, d):
    people = fx.colaboradores_activos(spark, d, "id_colaborador", "activo")
    return files.completeness(people, fx.catalogo_documentos(spark, d), fx.archivos_expedientes(spark, d))


@query
def file_matrix(spark, d):
    shown = [(1, "DOC_1"), (2, "DOC_2"), (3, "DOC_3")]
    people, catalog = fx.colaboradores_activos(spark, d), fx.catalogo_documentos(spark, d)
    return files.matrix(people, catalog, fx.archivos_expedientes(spark, d), shown)


@query
def file_matrix_long(spark, d):
    people, catalog = fx.colaboradores_activos(spark, d), fx.catalogo_documentos(spark, d)
    return files.matrix_long(people, catalog, fx.archivos_expedientes(spark, d))


@query
def documents_per_person(spark, d):
    return files.delivered_counts(fx.archivos_expedientes(spark, d), fx.catalogo_documentos(spark, d))


@query
def incomplete_files(spark, d):
    people = fx.colaboradores_activos(spark, d, "id_colaborador", "nombre_completo", "activo")
    return files.incomplete_people(people, fx.catalogo_documentos(spark, d), fx.archivos_expedientes(spark, d))


# --- Table views and listings -------------------------------------------------------------------------------

FACETED = ("empresa", "plaza", "departamento", "puesto", "activo")


@query
def facets(spark, d):
    return tableview.sorted_facets(tableview.facets(fx.colaboradores_activos(spark, d), FACETED))


@query
def facet_search(spark, d):
    return tableview.facet_search(tableview.facets(fx.colaboradores_activos(spark, d), FACETED), "chIN")


def _grid(spark, d, page: int, descending: bool) -> DataFrame:
    columns = ("id", "id_sistema", "puesto_vacante", "estatus_solicitud", "funcion_area_vacante", "fecha_solicitud")
    rows = tableview.pick(fx.vacantes(spark, d, *columns), [*columns[:4], "no_existe", *columns[4:]])
    chosen = tableview.faceted_filter(
        rows, {"funcion_area_vacante": ["OPERATIVA"], "estatus_solicitud": ["PROCESO", "PENDIENTE"], "id": []}
    )
    return tableview.page_of(chosen, "puesto_vacante", ["id"], page=page, size=25, descending=descending)


@query
def grid_page(spark, d):
    return _grid(spark, d, 3, True)


@query
def grid_middle_page(spark, d):
    return _grid(spark, d, 12, False)


@query
def grid_last_page(spark, d):
    return _grid(spark, d, 1_000_000_000, False)


@query
def listing_hires(spark, d):
    return listings.hires(fx.altas(spark, d))


@query
def listing_leavers(spark, d):
    return listings.leavers(fx.bajas_sistema(spark, d), dt.date(2024, 1, 1))


@query
def listing_leavers_range(spark, d):
    return listings.leavers(fx.bajas_sistema(spark, d), dt.date(2024, 1, 1), dt.date(2024, 1, 15))


@query
def listing_vacancies(spark, d):
    return listings.vacancies(fx.vacantes(spark, d), AS_OF)


@query
def records_json(spark, d):
    columns = ("id", "fecha_alta", "puesto_alta", "contratados_alta", "responsable_alta", "confidencial")
    return tableview.json_records(fx.altas(spark, d, *columns))


@query
def catalog_positions(spark, d):
    return tables.distinct_values(fx.altas(spark, d, "puesto_alta"), "puesto_alta")


@query
def chat_last_n(spark, d):
    return conversations.last_messages(fx.conversations(spark, d).select("conv_id", "turn", "role", "text"))


@query
def json_replies(spark, d):
    return conversations.payloads(fx.contestaciones(spark, d))


@query
def json_payload(spark, d):
    return conversations.payloads(fx.respuestas(spark, d))


# --- Batch writes -------------------------------------------------------------------------------------------


def _incoming(rows: DataFrame, position: str) -> DataFrame:
    """Rows as a form would send them: untrimmed positions in small letters, some blank."""
    typed = F.when(F.col("id") % 29 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.lower(position), F.lit(" á")))
    return rows.withColumn("row_idx", F.col("id")).withColumn(position, typed).drop("id", "id_registro")


def _hires_appended(spark, d) -> ingest.Appended:
    stored = fx.altas(spark, d)
    return ingest.append_hires(_incoming(stored, "puesto_alta"), fx.registros_rh(spark, d), stored, AT)


def _days(master: DataFrame) -> DataFrame:
    """Master rows with the day of their stamp as text, which is the same in every time zone of the session."""
    return master.withColumn("fecha_creacion", coerce.iso_text(F.col("fecha_creacion")))


@query
def append_hires(spark, d):
    return _hires_appended(spark, d).child


@query
def append_hires_master(spark, d):
    return _days(_hires_appended(spark, d).master)


def _master_appended(spark, d) -> tuple[DataFrame, DataFrame]:
    kind = F.when(F.col("id") % 5 == 0, F.lit("Otro")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("tipo_registro"))
    rows = fx.registros_rh(spark, d).withColumns({"row_idx": F.col("id") - 2_000_000, "tipo_registro": kind})
    return ingest.append_master(rows.drop("id"), fx.registros_rh(spark, d), AT)


@query
def append_master(spark, d):
    return _days(_master_appended(spark, d)[0])


@query
def append_master_rejects(spark, d):
    return _master_appended(spark, d)[1]


@query
def append_hires_rejects(spark, d):
    return _hires_appended(spark, d).rejects


@query
def append_leavers(spark, d):
    stored = fx.bajas(spark, d)
    return ingest.append_leavers(_incoming(stored, "puesto_baja"), fx.registros_rh(spark, d), stored).child


@query
def append_vacancies(spark, d):
    stored = fx.vacantes(spark, d)
    return ingest.append_vacancies(_incoming(stored, "puesto_vacante"), fx.registros_rh(spark, d), stored).child


def _vacancy_edits(stored: DataFrame) -> DataFrame:
    return stored.where("estatus_solicitud = 'PENDIENTE'").select(
        "id",
        F.lit("En prueba técnica").alias("fase_proceso"),
        F.concat(F.lit(" "), F.col("puesto_vacante"), F.lit("\t")).alias("puesto_vacante"),
        F.when(F.col("confidencial") == "SI", F.lit("Según plan, ñandú")).alias("comentarios_vacante"),
    )


@query
def edit_vacancies(spark, d):
    stored = fx.vacantes(spark, d)
    return ingest.edit_vacancies(stored, _vacancy_edits(stored))


@query
def edit_leavers(spark, d):
    stored = fx.bajas(spark, d)
    edits = stored.where("tipo_baja = 'VOLUNTARIA'").select(
        "id", F.concat(F.col("motivo_baja"), F.lit(" por decisión propia ")).alias("motivo_baja")
    )
    return ingest.edit_leavers(stored, edits)


@query
def update_vacancies(spark, d):
    stored = fx.vacantes(spark, d)
    rows = stored.where("fase_proceso = 'CONTRATADO'").withColumns(
        {
            "puesto_vacante": F.concat(F.lit(" "), F.lower("puesto_vacante")),
            "comentarios_vacante": F.when(F.col("vacantes_solicitadas") > 1, F.lit(" según plan ")),
            "vacantes_solicitadas": F.when(F.col("id") % 5 != 0, F.col("vacantes_solicitadas")),
            "vacantes_contratados": F.when(F.col("id") % 3 != 0, F.col("vacantes_contratados")),
        }
    )
    return ingest.update_vacancies(stored, rows.drop("fecha_avance", "confidencial"))


@query
def update_master(spark, d):
    stored = fx.registros_rh(spark, d, "id", "tipo_registro", "puesto", "empresa", "plaza", "area")
    rows = stored.where("area = 'OPERATIVA'").withColumn("puesto", F.concat(F.lower("puesto"), F.lit(" b ")))
    return ingest.update_master(stored, rows)


@query
def vacancies_by_key(spark, d):
    keys = ingest.cleanse(fx.importacion(spark, d)).select("id_sistema")
    stored = fx.vacantes(spark, d, "id", "id_sistema", "puesto_vacante", "fase_proceso")
    return tables.rows_with_keys(stored, keys, "id_sistema")


@query
def import_cleansed(spark, d):
    return ingest.cleanse(fx.importacion(spark, d))


def _imported(spark, d) -> ingest.Imported:
    return ingest.plan_import(fx.importacion(spark, d), fx.vacantes(spark, d), fx.registros_rh(spark, d), AT)


@query
def import_upsert(spark, d):
    return _imported(spark, d).vacancies


@query
def import_master(spark, d):
    return _days(_imported(spark, d).master)


@query
def import_report(spark, d):
    return _imported(spark, d).report


@query
def import_long_keys(spark, d):
    return ingest.cleanse(fx.claves_largas(spark, d)).select("row_idx", "id_sistema", "motivo")


@query
def import_long_keys_upsert(spark, d):
    rows = fx.claves_largas(spark, d)
    return ingest.plan_import(rows, fx.vacantes(spark, d), fx.registros_rh(spark, d), AT).vacancies


@query
def import_dates(spark, d):
    return fx.fechas(spark, d).select("id", coerce.import_date(F.col("texto")).alias("fecha"))


@query
def strict_dates(spark, d):
    text_ = F.col("texto")
    strict = coerce.strict_date(F.when(F.col("id") % 21 == 0, text_))
    return fx.fechas(spark, d).select(
        "id", strict.alias("estricta"), coerce.lenient_date(text_).alias("leida"), coerce.iso_text(coerce.lenient_date(text_)).alias("iso")
    )


def _scratch(spark) -> str:
    """A new folder below the one of ``spark.checkpoint.dir``."""
    return f"{scratch_folder(spark)}/{uuid.uuid4().hex}"


@query
def drop_folder_import(spark, d):
    """Staged rows written as files of a drop folder, read from there and imported."""
    folder = _scratch(spark)
    fx.importacion(spark, d).orderBy("row_idx").drop("row_idx").write.option("header", "true").csv(folder)
    staged = tables.read_drop_folder(spark, folder)
    return ingest.plan_import(staged, fx.vacantes(spark, d), fx.registros_rh(spark, d), AT).vacancies


#: Partitions by hash of the stored tables below.
BUCKETS = 16


def _store(spark, d, *names: str, index: tuple[str, ...] = ()) -> Store:
    """The named tables in a new store, by hash of their id."""
    store = Store(spark, _scratch(spark))
    change = store.begin()
    for name in names:
        change.put(name, getattr(fx, name)(spark, d), "id", BUCKETS, index)
    change.commit()
    return store


@query
def import_commit(spark, d):
    """Two imports into a store, each one version; between them one that ends before it is committed."""
    store, staged = _store(spark, d, "vacantes", "registros_rh"), fx.importacion(spark, d)
    first = F.col("Estatus De Solicitud") == "Finalizado"
    ingest.commit_import(store, staged.where(first), AT)
    broken = store.begin()
    broken.put("vacantes", store.read("vacantes").limit(1), "id", BUCKETS)
    ingest.commit_import(store, staged.where(~first), AT)
    return store.read("vacantes")


@query
def window_from_daily(spark, d):
    """The windows' totals from daily totals that an import has moved on."""
    store = _store(spark, d, "vacantes", "registros_rh")
    change = store.begin()
    change.put("diario", daily.of_hires(fx.altas(spark, d)).unionByName(daily.of_vacancies(store.read("vacantes"))))
    change.commit()
    ingest.commit_import(store, fx.importacion(spark, d), AT)
    return daily.window_totals(store.read("diario"), WINDOWS)


@query
def patch_partitioned(spark, d):
    """The edits of ``edit_vacancies`` as a new version of a table that is stored by hash of its id."""
    store = _store(spark, d, "vacantes")
    change = store.begin()
    edits = ingest.vacancy_edits(_vacancy_edits(store.read("vacantes")))
    change.patch("vacantes", edits, [c for c in edits.columns if c != "id"])
    change.commit()
    return store.read("vacantes")


@query
def lookup_pruned(spark, d):
    """Stored vacancies of refused import rows, by the key's index of files."""
    refused = ingest.cleanse(fx.importacion(spark, d)).where("motivo is not null")
    found = _store(spark, d, "vacantes", index=("id_sistema",)).lookup("vacantes", "id_sistema", refused)
    return found.select("id", "id_sistema", "puesto_vacante", "fase_proceso")


def _dropped(spark, d) -> tables.Dropped:
    """CSV lines written as files of a drop folder, in order, and read from there."""
    folder = _scratch(spark)
    lines = fx.lineas_csv(spark, d).repartition("archivo").sortWithinPartitions("archivo", "orden")
    lines.select("archivo", "linea").write.partitionBy("archivo").text(folder)
    return tables.read_drop_lines(spark, folder)


@query
def drop_folder_rejects(spark, d):
    """Bad lines of files with different headers."""
    return _dropped(spark, d).rejects.select("motivo", "texto")


@query
def drop_folder_rows(spark, d):
    """The good ones, by header name."""
    return _dropped(spark, d).rows.select("ID", "Puesto solicitado", "Comentarios Del Seguimiento Del Proceso", "Plaza")


@query
def pivot_export(spark, d):
    """The pivot of openings, exported and read back."""
    pivot, folder = vacancies.pivot_openings(fx.vacantes(spark, d), AS_OF), _scratch(spark)
    tables.export_json(pivot, folder)
    return spark.read.schema(pivot.schema).json(folder)


@query
def last_update_indexed(spark, d):
    """Day of the latest update stamp, from the index of the stored files."""
    bounds = _store(spark, d, "registros_rh", index=("ultima_actualizacion",)).bounds("registros_rh", "ultima_actualizacion")
    return bounds.select(F.col("maximo").cast("date").alias("ultima_actualizacion"))


@query
def pivot_export_csv(spark, d):
    """The same pivot as a CSV file with a header, read back."""
    pivot, folder = vacancies.pivot_openings(fx.vacantes(spark, d), AS_OF), _scratch(spark)
    tables.export_csv(pivot, folder)
    return spark.read.schema(pivot.schema).option("header", "true").csv(folder)


@query
def weeks_in_years(spark, d):
    years = fx.altas(spark, d, "fecha_alta").select(F.year("fecha_alta").alias("anio")).distinct()
    return years.select("anio", calendar.iso_weeks_in_year(F.col("anio")).alias("semanas"))


@query
def catalog_check(spark, d):
    return tables.outside_catalog(fx.vacantes(spark, d), catalogs.VACANCY_DOMAINS)


@query
def import_rejects(spark, d):
    return ingest.rejected(ingest.cleanse(fx.importacion(spark, d)))


@query
def import_first_errors(spark, d):
    return ingest.first_errors(ingest.rejected(ingest.cleanse(fx.importacion(spark, d))))


@query
def import_preview(spark, d):
    return tables.preview(fx.importacion(spark, d))


@query
def text_rules(spark, d):
    """Row-level text rules on the hires."""
    name = F.col("responsable_alta")
    rows = fx.altas(spark, d, "id", "puesto_alta", "empresa_alta", "responsable_alta", "confidencial")
    return rows.select(
        "id",
        text.mask_confidential(F.col("puesto_alta"), F.col("confidencial")).alias("puesto_visible"),
        text.first_word_alias(name).alias("primer_nombre"),
        text.first_listed_word(name).alias("ejecutivo"),
        text.any_word_is(name, "HELEN").alias("es_helen"),
        text.fold_accents(F.col("empresa_alta")).alias("empresa_plana"),
        text.text_or_default(name).alias("responsable"),
    )
