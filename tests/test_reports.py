import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import day, tuples
from reclutark.functions import calendar, predicates
from reclutark.functions.calendar import YEAR, Period
from reclutark.operators import series
from reclutark.plans import annual, conversations, daily, dashboard, files, hires, listings, overview, sla, vacancies
from reclutark.sources import tables
from reclutark.sources.tables import empty_table, last_update, latest_snapshot

AS_OF = dt.date(2024, 1, 31)


def alta(id, fecha, n, **more):
    return {"id": id, "fecha_alta": fecha, "contratados_alta": str(n), **more}


def vacante(id, **more):
    return {"id": id, "id_sistema": id, "vacantes_contratados": "0", "vacantes_solicitadas": 0, **more}


# --- the two readings of open -------------------------------------------------------------------------------


def test_open_readings_differ_on_missing_and_refused(make):
    df = make(
        "vacantes",
        vacante(1, fecha_autorizacion="2024-01-01"),
        vacante(2, fecha_autorizacion="2024-01-01", estatus_solicitud="RECHAZADA", fase_proceso="X"),
        vacante(3, fecha_autorizacion="2024-01-01", estatus_solicitud="PROCESO", fase_proceso="X"),
        vacante(4, fecha_autorizacion="2024-01-01", estatus_solicitud="PAUSADO"),
        vacante(5, fecha_autorizacion="2024-01-01", fase_proceso="CONTRATADO"),
        vacante(6, fecha_autorizacion="1900-01-01", estatus_solicitud="PROCESO", fase_proceso="X"),
    )
    ids = lambda condition: sorted(r["id"] for r in df.where(condition).collect())
    assert ids(predicates.is_open()) == [1, 2, 3, 6]
    assert ids(predicates.is_open_for_capacity()) == [3, 6]
    assert ids(predicates.is_ageing()) == [1, 2, 3]


def test_funnel_keeps_missing_status_and_needs_a_stage(make):
    common = dict(fecha_autorizacion="2024-01-01", vacantes_solicitadas=1)
    df = make(
        "vacantes",
        vacante(1, fase_proceso="X", **common),
        vacante(2, estatus_solicitud="PROCESO", **common),
        vacante(3, fase_proceso="X", estatus_solicitud="PENDIENTE", **common),
        vacante(4, fase_proceso="X", estatus_solicitud="PROCESO", fecha_autorizacion="2024-01-01"),
        vacante(5, fase_proceso="CONTRATADO", **common),
        vacante(6, fase_proceso="Y", estatus_solicitud="PROCESO", **common),
        vacante(7, fase_proceso="X", **common),
    )
    assert tuples(vacancies.stage_funnel(df)) == [("Y", 1), ("X", 2)]


# --- hires --------------------------------------------------------------------------------------------------


def test_channel_shares_and_order(make):
    df = make(
        "altas",
        alta(1, "2024-01-01", 3, medio_reclutamiento_alta="OCC"),
        alta(2, "2024-01-01", 1, medio_reclutamiento_alta="INDEED"),
        alta(3, "2024-01-01", 0, medio_reclutamiento_alta="LONAS"),
        alta(4, "2024-01-01", 5),
    )
    assert tuples(hires.by_channel(df)) == [("INDEED", 1, 25.0), ("OCC", 3, 75.0)]


def test_company_share_is_within_the_choice(make):
    df = make(
        "altas",
        alta(1, "2024-01-01", 3, empresa_alta="SICMART SA DE CV"),
        alta(2, "2024-01-01", 1, empresa_alta="OTRA"),
        alta(3, "2024-01-01", 4, empresa_alta="FICORMA SA DE CV"),
    )
    assert tuples(hires.by_company(df, companies=["SICMART", "OTRA"])) == [("OTRA", 1, 25.0), ("SICMART", 3, 75.0)]
    assert tuples(hires.by_company(df, companies=[])) == []


def test_recruiter_area_table_orders_by_all_areas(make):
    df = make(
        "altas",
        alta(1, "2024-01-01", 2, responsable_alta="MARTA X", area_alta="OPERATIVA"),
        alta(2, "2024-01-01", 1, responsable_alta="Leticia", area_alta="ADMINISTRATIVA"),
        alta(3, "2024-01-01", 5, responsable_alta="AGENCIA", area_alta="OTRA"),
        alta(4, "2024-01-01", 9, area_alta="OPERATIVA"),
    )
    assert tuples(hires.by_recruiter_and_area(df)) == [("Leticia", 0, 1), ("HELEN", 2, 0), ("AGENCIA", 0, 0)]


def test_paid_media_months_line_up(make):
    df = make(
        "altas",
        alta(1, "2024-01-05", 2, area_alta="OPERATIVA", medio_reclutamiento_alta="OCC"),
        alta(2, "2024-03-05", 4, area_alta="ADMINISTRATIVA", medio_reclutamiento_alta="REDES PAGADAS"),
        alta(3, "2023-03-05", 1, area_alta="OPERATIVA", medio_reclutamiento_alta="REDES PAGADAS"),
    )
    assert tuples(hires.paid_media_monthly(df)) == [(1, "Enero", 2, None), (3, "Marzo", 1, 5)]
    assert tuples(hires.paid_media_totals(df)) == [(7, 5, 3, 1)]


def test_pivot_totals_keep_missing_keys_apart(make):
    df = make(
        "altas",
        alta(1, "2024-01-01", 2, responsable_alta="A", area_alta="OPERATIVA"),
        alta(2, "2024-01-01", 3, area_alta="OPERATIVA"),
        alta(3, "2024-01-02", 4, responsable_alta="A", area_alta="OPERATIVA"),
    )
    cells = hires.pivot_cells(df)
    by_level = {level: sorted(r["contrataciones"] for r in cells.where(F.col("nivel") == level).collect())
                for level in ("celda", "total_fila", "total_columna", "total_general")}
    assert by_level == {"celda": [2, 3, 4], "total_fila": [4, 5], "total_columna": [3, 6], "total_general": [9]}
    wide = hires.pivot_wide(df, [("A", "OPERATIVA"), (None, "OPERATIVA")]).orderBy("fecha_alta")
    assert tuples(wide) == [("2024-01-01", 2, 3, 5), ("2024-01-02", 4, 0, 4), ("TOTAL", 6, 3, 9)]


def test_bad_count_stops_the_report(make):
    with pytest.raises(Exception, match="not a valid bigint"):
        hires.by_channel(make("altas", alta(1, "2024-01-01", "dos", medio_reclutamiento_alta="OCC"))).collect()


def test_empty_tables_give_zeros(spark):
    altas, bajas, vacantes = (empty_table(spark, t) for t in ("altas", "bajas_sistema", "vacantes"))
    row = overview.figures(altas, bajas, vacantes, empty_table(spark, "snapshot_vacantes_semanales")).first()
    assert (row["contratados"], row["bajas"], row["vacantes"], row["requisiciones"], row["contrataciones_pct"]) == (0, 0, 0, 0, 0.0)
    assert row["vacantes_variacion_pct"] is None
    assert tuples(vacancies.open_age(vacantes)) == [(0, 0, 0)]
    assert tuples(vacancies.closed_days(vacantes)) == [(None,) * 5]
    assert tuples(hires.by_channel(altas)) == []


def test_snapshot_and_update_stamp(make):
    snaps = make(
        "snapshot_vacantes_semanales",
        {"n_vacantes": 900, "semana_iso": 52, "año": 2000},
        {"n_vacantes": 1100, "semana_iso": 30, "año": 2001},
        {"n_vacantes": 1050, "semana_iso": 9, "año": 2001},
    )
    assert tuples(latest_snapshot(snaps)) == [(1100, "S30 2001")]
    master = make("registros_rh", {"id": 1, "ultima_actualizacion": "2024-05-06"}, {"id": 2})
    assert tuples(last_update(master)) == [(dt.date(2024, 5, 6),)]


def test_overview_scopes(make, spark):
    """Open positions ignore period and recruiter, requisitions follow both."""
    vacantes = make(
        "vacantes",
        vacante(1, fecha_autorizacion="2023-05-01", vacantes_solicitadas=4, fase_proceso="X"),
        vacante(2, fecha_autorizacion="2024-05-01", vacantes_solicitadas=2, vacantes_contratados="3",
                fase_proceso="SIN SOLICITUD DE REQUISICION", responsable_vacante="LETICIA UNO"),
        vacante(3, fecha_autorizacion="2024-05-01", vacantes_solicitadas=7, estatus_solicitud="PAUSADO"),
    )
    altas = make("altas", alta(1, "2024-02-01", 2, responsable_alta="leticia uno"), alta(2, "2024-02-01", 9))
    bajas = make("bajas_sistema", {"id": 0, "fecha_baja": "2024-01-01"}, {"id": 5, "fecha_baja": "2024-12-31"}, {"id": 6})
    snaps = make("snapshot_vacantes_semanales", {"n_vacantes": 5, "semana_iso": 1, "año": 2024})
    row = overview.figures(altas, bajas, vacantes, snaps, Period(YEAR, year=2024), "LETY").first()
    assert (row["contratados"], row["bajas"], row["vacantes"]) == (2, 1, 6)
    assert (row["requisiciones"], row["no_requisitadas"], row["contrataciones_pct"]) == (5, 1, 40.0)
    assert row["vacantes_variacion_pct"] == pytest.approx(20.0)


# --- days ---------------------------------------------------------------------------------------------------


def test_open_age_rounds_to_even(make):
    rows = [
        vacante(i, fecha_autorizacion=date, vacantes_solicitadas=1, funcion_area_vacante=area)
        for i, (date, area) in enumerate(
            [("2024-01-30", "OPERATIVA"), ("2024-01-29", "OPERATIVA"), ("2024-01-29", "ADMINISTRATIVA"),
             ("2024-01-28", "ADMINISTRATIVA"), ("1900-01-01", "OPERATIVA")]
        )
    ]
    assert tuples(vacancies.open_age(make("vacantes", *rows), AS_OF)) == [(2, 2, 2)]


def test_closed_days_and_goals(make):
    common = dict(vacantes_contratados="1", fecha_autorizacion="2024-01-01")
    df = make(
        "vacantes",
        vacante(1, fecha_cobertura="2024-01-31", funcion_area_vacante="OPERATIVA", **common),
        vacante(2, fecha_cobertura="2023-12-31", funcion_area_vacante="OPERATIVA", **common),
        vacante(3, fecha_cobertura="2024-01-01", funcion_area_vacante="ADMINISTRATIVA", **common),
        vacante(4, fecha_cobertura="2024-01-31", vacantes_contratados="1", fecha_autorizacion="1900-01-01"),
    )
    row = vacancies.closed_days(df).first()
    assert (row["promedio"], row["promedio_operativas"], row["promedio_administrativas"]) == (15.0, 30.0, 0.0)
    assert (row["meta_pct_operativas"], row["meta_pct_administrativas"]) == (50.0, None)


def test_days_summary_and_tables(make):
    def filled(id, site, position, days):
        return vacante(id, plaza_vacante=site, puesto_vacante=position, vacantes_contratados="1",
                       fecha_autorizacion="2024-01-01", fecha_cobertura=str(dt.date(2024, 1, 1) + dt.timedelta(days)))

    df = make("vacantes", filled(1, "LEON", "A", 2), filled(2, "LEON", "B", 3), filled(3, "COLIMA", "A", 1), filled(4, None, "A", 30))
    assert tuples(vacancies.days_by(df, "plaza_vacante", AS_OF)) == [("LEON", 2.5, 2.0), ("COLIMA", 1.0, 1.0)]
    row = vacancies.days_summary(df, AS_OF).first()
    assert (row["promedio_global"], row["plaza_mas_alta"], row["plaza_mas_alta_dias"]) == (9.0, "LEON", 2.0)
    assert (row["puesto_mas_alto"], row["puesto_mas_alto_dias"], row["meta"]) == ("A", 11.0, 30.0)


def test_pivot_openings_totals_are_not_means_of_means(make):
    common = dict(fase_proceso="X", vacantes_solicitadas=1, empresa_vacante="E", puesto_vacante="P")
    df = make(
        "vacantes",
        vacante(1, fecha_autorizacion="2024-01-01", **common),
        {**vacante(2, fecha_autorizacion="2024-01-21", **common), "id_sistema": 1},
        vacante(3, fecha_autorizacion="2024-01-31", confidencial="SI", **common),
    )
    rows = {(r["nivel"], r["id_sistema"], r["puesto_vacante"]): r for r in vacancies.pivot_openings(df, AS_OF).collect()}
    assert (rows[3, 1, "P"]["vacantes"], rows[3, 1, "P"]["dias_promedio"], rows[3, 1, "P"]["cobertura_larga"]) == (2, 20.0, True)
    assert rows[3, 3, "VACANTE"]["dias_promedio"] == 0.0
    assert rows[0, None, None]["dias_promedio"] == pytest.approx(40 / 3)


# --- series -------------------------------------------------------------------------------------------------


def test_year_gap_has_no_change(make):
    df = make("altas", alta(1, "2024-01-01", 10), alta(2, "2025-01-01", 15), alta(3, "2027-01-01", 5), alta(4, None, 3))
    assert tuples(annual.yearly(df)) == [(2024, 10, None), (2025, 15, 50.0), (2027, 5, None)]


def test_month_grid_needs_two_years_and_sums_up(make):
    rows = [alta(i, f"{2023 + i % 2}-{i % 12 + 1:02d}-03", i) for i in range(40)]
    df = make("altas", *rows)
    grid = annual.monthly_grid(df).collect()
    assert len(grid) == 24 and sum(r["contratados"] for r in grid) == sum(range(40))
    assert annual.monthly_grid(df.where("year(fecha_alta) = 2023")).count() == 0
    assert annual.monthly_of_year(df, 2023).count() == 12
    assert annual.monthly_of_year(df, 1999).count() == 0


def test_windows_use_the_months_of_the_first(make):
    df = make("altas", alta(1, "2024-02-29", 1), alta(2, "2025-02-28", 2), alta(3, "2025-03-10", 4), alta(4, "2025-03-11", 8))
    windows = calendar.same_window([2024, 2025], (2, 29), (3, 10))
    assert tuples(annual.window_monthly(df, windows), "anio", "mes", "contratados") == [
        (2024, 2, 1), (2024, 3, 0), (2025, 2, 2), (2025, 3, 4),
    ]
    empty = make("vacantes", vacante(1))
    assert tuples(annual.window_totals(df, empty, windows)) == [(2024, 1, 0, 0), (2025, 6, 0, 0)]


def test_ranges(make):
    df = make("altas", alta(1, "2024-02-10", 1, responsable_alta="DIEGO"), alta(2, "2024-04-10", 2))
    start, end = dt.date(2024, 2, 1), dt.date(2024, 4, 30)
    assert tuples(annual.range_monthly(df, start, end), "mes", "contratados") == [(2, 1), (3, 0), (4, 2)]
    assert annual.range_monthly(df, dt.date(2025, 1, 1), dt.date(2025, 2, 1)).count() == 0
    assert annual.range_monthly(df, dt.date(2023, 11, 1), dt.date(2024, 3, 1)).count() == 0
    assert dict(tuples(annual.range_recruiters(df, start, end))) == {"DIEGO": 1, "YULIANA": 0, "LETICIA": 0, "ELENA": 0}


def test_new_and_replacement_year_over_year(make):
    def hired(id, date, kind, n):
        return vacante(id, fecha_solicitud=date, tipo_solicitud=kind, vacantes_contratados=str(n), fase_proceso="CONTRATADO")

    df = make(
        "vacantes", hired(1, "2023-01-01", "NUEVO", 9), hired(2, "2024-01-01", "NUEVO", 2), hired(3, "2025-01-01", "NUEVO", 3),
        hired(4, "2025-02-01", "REEMPLAZO", 4),
    )
    assert tuples(annual.new_and_replacement(df), "tipo_solicitud", "anio", "contratados", "variacion_pct") == [
        ("NUEVO", 2024, 2, None), ("NUEVO", 2025, 3, 50.0), ("REEMPLAZO", 2024, 0, None), ("REEMPLAZO", 2025, 4, None),
    ]


def test_window_across_new_year(spark):
    windows = calendar.windows_frame(spark, [(1, dt.date(2023, 12, 20), dt.date(2024, 1, 10)), (2, dt.date(2024, 1, 5), dt.date(2024, 2, 1))])
    df = spark.createDataFrame([(day(d),) for d in ("2023-12-31", "2024-01-07", "2024-01-31", "2024-03-01")], "d date")
    got = series.join_windows(df, windows, "d").select("d", "anio").orderBy("d", "anio")
    assert [(str(d), w) for d, w in tuples(got)] == [("2023-12-31", 1), ("2024-01-07", 1), ("2024-01-07", 2), ("2024-01-31", 2)]


def test_years_available(make, spark):
    v = make("vacantes", vacante(1, fecha_solicitud="2023-01-01", fecha_cobertura="2025-01-01"), vacante(2))
    a = make("altas", alta(1, "2024-01-01", 1))
    columns = [(v, ["fecha_solicitud", "fecha_cobertura"]), (a, ["fecha_alta"])]
    assert tuples(annual.years_available(columns, AS_OF)) == [(2025,), (2024,), (2023,)]
    nothing = [(empty_table(spark, "altas"), ["fecha_alta"])]
    assert tuples(annual.years_available(nothing, AS_OF)) == [(2024,)]


# --- service levels -----------------------------------------------------------------------------------------


def sla_case(make):
    def filled(id, days, area, who, cob=True):
        date = str(dt.date(2024, 1, 1) + dt.timedelta(days)) if cob else None
        return vacante(id, vacantes_contratados="1", vacantes_solicitadas=1, fecha_autorizacion="2024-01-01",
                       fecha_cobertura=date, funcion_area_vacante=area, responsable_vacante=who)

    return make(
        "vacantes", filled(1, 15, "OPERATIVA", "DIEGO UNO"), filled(2, 16, "OPERATIVA", "ANA LETICIA ELENA"),
        filled(3, -3, "OPERATIVA", "DIEGO UNO"), filled(4, 0, "OPERATIVA", "DIEGO UNO", cob=False), vacante(5),
    )


def test_sla(make):
    rows = sla.sla_rows(sla_case(make), as_of=dt.date(2024, 1, 11))
    by_area = {r["area"]: r for r in sla.by_area(rows).collect()}
    op, admin = by_area["OPERATIVA"], by_area["ADMINISTRATIVA"]
    assert (op["registros"], op["dias_promedio"], op["en_meta"]) == (3, pytest.approx(41 / 3), True)
    assert op["dentro_meta_pct"] == pytest.approx(200 / 3)
    assert (admin["registros"], admin["dentro_meta_pct"], admin["dias_promedio"], admin["en_meta"]) == (0, 0.0, 0.0, None)
    assert tuples(sla.by_recruiter(rows)) == [
        ("DIEGO", 12.5, None), ("ELENA", None, None), ("LETICIA", 16.0, None), ("YULIANA", None, None),
    ]
    assert tuples(sla.monthly_trend(rows)) == [("2024-01", 15.5, None), (None, 10.0, None)]


def test_capacity(make):
    df = make("vacantes", vacante(1, fase_proceso="X", estatus_solicitud="PROCESO", fecha_autorizacion="2024-01-01", vacantes_solicitadas=66))
    row = sla.capacity(df).first()
    assert (row["vacantes_activas"], row["horas_trabajador"]) == (66, 792)
    assert row["capacidad_teorica"] == pytest.approx(792 / 13.1)
    assert row["eficiencia_pct"] == pytest.approx(66 / (792 / 13.1) * 100)
    assert row["interpretacion"] == "Sobrecarga operativa"


# --- files --------------------------------------------------------------------------------------------------


def file_case(make):
    people = make(
        "colaboradores_activos",
        {"id_colaborador": 1, "nombre_completo": "B", "activo": True},
        {"id_colaborador": 2, "nombre_completo": "A", "activo": True},
        {"id_colaborador": 3, "nombre_completo": "C"},
    )
    catalog = make(
        "catalogo_documentos",
        {"id": 1, "nombre_documento": "ACTA", "requerido": True},
        {"id": 2, "nombre_documento": "INE", "requerido": True},
        {"id": 3, "nombre_documento": "OTRO", "requerido": False},
    )
    pairs = [(1, 1, True), (1, 1, True), (1, 2, True), (2, 1, True), (2, 2, False), (2, 3, True), (3, 1, True), (3, 2, True)]
    archive = make(
        "archivos_expedientes", *[{"id_colaborador": p, "id_documento": doc, "estatus_pdf": ok} for p, doc, ok in pairs]
    )
    return people, catalog, archive


def test_file_completeness(make):
    people, catalog, archive = file_case(make)
    assert tuples(files.completeness(people, catalog, archive)) == [(2, 1, 1, 50.0)]
    assert tuples(files.matrix(people, catalog, archive, [(1, "ACTA"), (2, "INE")]), "colaborador", "estatus", "ACTA", "INE") == [
        ("A", "INCOMPLETO", True, False), ("B", "COMPLETO", True, True),
    ]
    assert tuples(files.incomplete_people(people, catalog, archive)) == [(2, "A")]
    assert sorted(tuples(files.delivered_counts(archive, catalog))) == [(1, 2), (2, 1), (3, 2)]
    assert sorted(tuples(files.delivered(archive, catalog))) == [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)]


def test_very_many_required_documents(spark, make):
    """One person has delivered all of 501 documents, one all but the last, in the same plans as ever."""
    people, _, _ = file_case(make)
    catalog = spark.range(1, 502).selectExpr("id", "concat('DOC ', id) AS nombre_documento", "true AS requerido")
    archive = spark.range(1, 502).selectExpr("1L AS id_colaborador", "id AS id_documento", "true AS estatus_pdf").union(
        spark.range(1, 501).selectExpr("2L", "id", "true"))
    assert tuples(files.completeness(people, catalog, archive)) == [(2, 1, 1, 50.0)]
    assert tuples(files.incomplete_people(people, catalog, archive)) == [(2, "A")]
    assert sorted(tuples(files.delivered_counts(archive, catalog))) == [(1, 501), (2, 500)]
    long = files.matrix_long(people, catalog, archive)
    assert long.count() == 1002 and long.where("NOT entregado").select("id_colaborador", "id_documento").collect() == [(2, 501)]
    assert tuples(files.matrix(people, catalog, archive, [(501, "DOC 501")]), "colaborador", "estatus", "DOC 501") == [
        ("A", "INCOMPLETO", False), ("B", "COMPLETO", True)]


def test_no_required_documents(make):
    people, catalog, archive = file_case(make)
    nothing = catalog.where("NOT requerido")
    assert tuples(files.completeness(people, nothing, archive)) == [(2, 0, 2, 0.0)]
    assert tuples(files.matrix(people, nothing, archive, []), "colaborador", "estatus") == [("A", "INCOMPLETO"), ("B", "INCOMPLETO")]
    assert files.incomplete_people(people, nothing, archive).count() == 2


def test_document_name_used_twice(make):
    people, _, archive = file_case(make)
    catalog = make(
        "catalogo_documentos",
        {"id": 1, "nombre_documento": "ACTA", "requerido": True}, {"id": 2, "nombre_documento": "ACTA", "requerido": True},
    )
    assert files.matrix(people, catalog, archive, [(1, "ACTA"), (2, "ACTA")]).columns[-2:] == ["ACTA (1)", "ACTA (2)"]


# --- listings and conversations -----------------------------------------------------------------------------


def test_listings(make):
    v = make(
        "vacantes", vacante(1, fecha_solicitud="2024-01-01"), vacante(2, confidencial="SI"),
        vacante(3, fecha_autorizacion="1900-01-01", fecha_cobertura="1900-01-11", confidencial="NO"),
    )
    assert tuples(listings.vacancies(v, AS_OF), "ID del Sistema", "Días de cobertura") == [(3, 10), (1, 30)]
    b = make("bajas_sistema", {"id": 1, "fecha_baja": "2023-12-31"}, {"id": 2, "fecha_baja": "2024-01-01", "nombre": "ANA", "apellido_materno": "LOPEZ"})
    assert tuples(listings.leavers(b, dt.date(2024, 1, 1)), "ID", "Nombre") == [(2, "ANA  LOPEZ")]
    a = make("altas", alta(2, "2024-01-01", 1), alta(1, "2024-01-01", 1))
    assert tuples(listings.hires(a), "ID") == [(1,), (2,)]
    detail = hires.detail(make("altas", alta(1, "2024-01-01", 1, puesto_alta="CHOFER", confidencial="SI")))
    assert tuples(detail, "Puesto") == [("VACANTE",)] and "Confidencial" not in detail.columns


def test_last_messages(spark):
    df = spark.createDataFrame([(c, t) for c, n in ((1, 25), (2, 3)) for t in range(n)], "conv_id long, turn long")
    kept = sorted(tuples(conversations.last_messages(df)))
    assert kept == [(1, t) for t in range(15, 25)] + [(2, t) for t in range(3)]


def test_replies(spark):
    df = spark.createDataFrame([('{"output": "hola", "chart": {"x": 1}}',), ("nada",), ('{"a": 1}',)], "texto string")
    assert tuples(conversations.payloads(df), "respuesta", "grafica") == [
        ("hola", '{"x":1}'), ("nada", None), ("He procesado tu solicitud.", None),
    ]


def test_the_dashboard_reads_each_table_once(spark, tmp_path, make):
    a = make("altas", alta(1, "2024-01-01", 2, medio_reclutamiento_alta="OCC", empresa_alta=None, responsable_alta="MARTA X", area_alta="OPERATIVA"),
             alta(2, "2024-02-01", 6, medio_reclutamiento_alta="REDES PAGADAS", empresa_alta="E", responsable_alta=None, area_alta="ADMINISTRATIVA"), alta(3, "2024-02-01", 0))
    v = make("vacantes", {"id": 1, "fecha_autorizacion": "2024-01-01", "vacantes_solicitadas": 3, "empresa_vacante": "E", "fase_proceso": "EN ENTREVISTA"},
             {"id": 2, "fase_proceso": "CONTRATADO", "plaza_vacante": "P", "fecha_autorizacion": "2024-01-01", "fecha_cobertura": "2024-01-11", "vacantes_contratados": "1"})
    for name, df in (("altas", a), ("vacantes", v)):
        df.write.parquet(str(tmp_path / name))
    stored = [tables.read_table(spark, str(tmp_path), n) for n in ("altas", "vacantes")]
    df = dashboard.blocks(*stored, dt.date(2024, 3, 1))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Expand") == 2
    got = {(r.bloque, r.clave, r.detalle): (r.cantidad, r.promedio, r.porcentaje) for r in df.collect()}
    assert got[("canal", "REDES PAGADAS", None)] == (6, None, 75.0) and got[("empresa", "E", None)] == (6, None, 100.0)
    assert got[("ejecutivo", "HELEN", "OPERATIVA")] == (2, None, None) and got[("mes", "2", None)][0] == 6
    assert got[("totales", "contratados_totales", None)][0] == 8 and got[("totales", "contratados_operativas_redes_pagadas", None)][0] == 0
    assert got[("vacantes_empresa", "E", None)][0] == 3 and got[("embudo", "EN ENTREVISTA", None)][0] == 1 and got[("dias_plaza", "P", None)][1] == 10.0
    assert got[("totales", "vacantes", None)][0] == 3 and got[("totales", "dias_promedio", None)][1] == 10.0
    assert not any(k[0] in ("canal", "empresa") and k[1] is None for k in got)
    empty = dashboard.blocks(a.limit(0), v.limit(0)).collect()
    assert {(r.clave, r.cantidad) for r in empty} == {(n, 0) for n in (
        "contratados_totales", "contratados_redes_pagadas", "contratados_operativas", "contratados_operativas_redes_pagadas", "vacantes")}


def test_sums_of_daily_parts_are_the_annual_reports(spark, make):
    a = make("altas", *[alta(i, f"202{i % 3}-0{1 + i % 9}-15", i % 4, responsable_alta=("DIEGO X", "ELENA Y", None)[i % 3], area_alta="OPERATIVA") for i in range(40)])
    parts = daily.of_hires(a)
    windows = [(y, dt.date(y, 2, 1), dt.date(y, 8, 31)) for y in (2020, 2021, 2022)]
    assert tuples(daily.window_monthly(parts, windows)) == tuples(annual.window_monthly(a, windows))
    assert tuples(daily.window_recruiters(parts, windows)) == tuples(annual.window_recruiters(a, windows))
    assert tuples(daily.yearly(parts)) == tuples(annual.yearly(a))
    assert daily.difference(parts, parts).count() == 0
