import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, tuples
from reclutark import catalogs
from reclutark.sources import fixtures as fx, ingest, tables

HEADERS = catalogs.IMPORT_COLUMNS
AT = dt.datetime(2024, 5, 6, 7, 8)


@pytest.fixture
def staged(spark):
    def build(*rows):
        columns = ["row_idx", *HEADERS.values()]
        values = [(i, *[row.get(stored) for stored in HEADERS]) for i, row in enumerate(rows)]
        schema = ", ".join(f"`{c}` {'long' if c == 'row_idx' else 'string'}" for c in columns)
        return spark.createDataFrame(values, schema)

    return build


def line(key, **more):
    return {"id_sistema": key, "puesto_vacante": "chofer", **more}


@pytest.fixture
def stored(make):
    vacancies = make(
        "vacantes",
        {"id": 10, "id_registro": 100, "id_sistema": 7, "puesto_vacante": "VIEJO", "confidencial": "SI", "plaza_vacante": "LEON"},
        {"id": 11, "id_registro": 101, "id_sistema": 8, "puesto_vacante": "OTRO"},
        {"id": 12, "id_registro": 102, "id_sistema": 8, "puesto_vacante": "DOBLE"},
        {"id": 13, "id_registro": 103, "puesto_vacante": "SIN CLAVE"},
    )
    master = make("registros_rh", *[{"id": i, "tipo_registro": "Vacante", "puesto": "P"} for i in (100, 101, 102, 103)])
    return vacancies, master


def report(result):
    return tuple(result.report.select("nuevos", "actualizados", "fallidos", "procesados").first())


def test_new_key_three_times(staged, stored):
    rows = staged(
        line("500", comentarios_vacante="uno"), line("500", comentarios_vacante="dos"),
        line("500", comentarios_vacante=" revisión "),
    )
    result = ingest.plan_import(rows, *stored, at=AT)
    assert report(result) == (1, 2, 0, 3)
    added = result.vacancies.where("id_sistema = 500").collect()
    assert [(r["id"], r["id_registro"], r["comentarios_vacante"]) for r in added] == [(14, 104, "REVISION")]
    master = result.master.where("id = 104").first()
    assert (master["tipo_registro"], master["puesto"]) == ("Vacante", "CHOFER")


def test_single_new_row_keeps_its_accents(staged, stored):
    result = ingest.plan_import(staged(line("500", comentarios_vacante="revisión")), *stored)
    assert result.vacancies.where("id_sistema = 500").first()["comentarios_vacante"] == "REVISIÓN"


def test_zero_and_missing_keys_always_insert(staged, stored):
    result = ingest.plan_import(staged(line("0"), line("0"), line(None), line("  ")), *stored)
    assert report(result) == (4, 0, 0, 4)
    assert result.vacancies.count() == 8
    assert result.vacancies.select("id").distinct().count() == 8


def test_refused_rows_have_reasons(staged, stored):
    result = ingest.plan_import(
        staged(
            line("1", puesto_vacante="   "), line("abc"), line("2", vacantes_solicitadas="dos"),
            line("3", vacantes_contratados="x"), line("4"),
        ),
        *stored,
    )
    assert report(result) == (1, 0, 4, 1)
    assert sorted(tuples(result.rejects)) == [
        (0, "puesto_vacante es obligatorio"), (1, "ID no es un número"), (2, "vacantes solicitadas no es un número"),
        (3, "vacantes contratados no es un número"),
    ]
    assert tuples(ingest.first_errors(result.rejects, 1)) == [(0, "Error en fila 1: puesto_vacante es obligatorio")]


def test_last_valid_row_counts(staged, stored):
    result = ingest.plan_import(staged(line("7", plaza_vacante="A"), line("7", plaza_vacante="B"), line("7", puesto_vacante="")), *stored)
    assert report(result) == (0, 2, 1, 2)
    row = result.vacancies.where("id = 10").first()
    assert (row["plaza_vacante"], row["confidencial"], row["puesto_vacante"]) == ("B", "SI", "CHOFER")


def test_update_overwrites_with_null_but_not_the_mark(staged, stored):
    result = ingest.plan_import(staged(line("7", empresa_vacante=" X ", funcion_area_vacante=" operativa ")), *stored)
    row = result.vacancies.where("id = 10").first()
    assert (row["plaza_vacante"], row["empresa_vacante"], row["confidencial"]) == (None, "X", "SI")
    master = result.master.where("id = 100").first()
    assert (master["puesto"], master["empresa"], master["plaza"], master["area"]) == ("CHOFER", "X", None, "operativa")


def test_stored_duplicates_match_the_first_only(staged, stored):
    result = ingest.plan_import(staged(line("8")), *stored)
    positions = dict(tuples(result.vacancies, "id", "puesto_vacante"))
    assert (positions[11], positions[12]) == ("CHOFER", "DOBLE")


def test_cell_rules(staged):
    rows = staged(
        line("1", fecha_autorizacion="1999-12-31", fase_proceso="en entrevista", fecha_cobertura="2024-01-01",
             vacantes_solicitadas="3", vacantes_contratados="5"),
        line("2.0", fase_proceso=" contratado ", fecha_cobertura="25/12/2024", vacantes_solicitadas="3",
             vacantes_contratados="1", fecha_solicitud="45000", tipo_solicitud="  ", responsable_vacante=" ana "),
    )
    first, second = ingest.cleanse(rows).orderBy("row_idx").collect()
    assert (first["fecha_autorizacion"], first["fecha_cobertura"], first["vacantes_solicitadas"]) == (None, None, 0)
    assert (second["id_sistema"], second["fase_proceso"], second["fecha_cobertura"]) == (2, "CONTRATADO", dt.date(2024, 12, 25))
    assert (second["vacantes_solicitadas"], second["fecha_solicitud"], second["tipo_solicitud"]) == (2, None, None)
    assert (second["responsable_vacante"], second["tipo_reclutamiento_vacante"]) == ("ana", "SIN ESPECIFICAR")
    assert first["responsable_vacante"] == "SIN ESPECIFICAR"


def test_file_without_optional_columns(spark, stored):
    rows = spark.createDataFrame([(0, "9", "jefe")], "row_idx long, ID string, `Puesto solicitado` string")
    result = ingest.plan_import(rows, *stored)
    assert report(result) == (1, 0, 0, 1)
    assert result.vacancies.where("id_sistema = 9").first()["plaza_vacante"] is None


def test_import_is_idempotent_for_unique_keys(staged, stored):
    rows = staged(line("500", comentarios_vacante="á"), line("7"))
    once = ingest.plan_import(rows, *stored, at=AT)
    twice = ingest.plan_import(rows, once.vacancies, once.master, at=AT)
    assert report(twice) == (0, 2, 0, 2)
    again = ingest.plan_import(rows, twice.vacancies, twice.master, at=AT)
    assert sorted(map(str, twice.vacancies.collect())) == sorted(map(str, again.vacancies.collect()))


def test_hot_key_and_many_blank_keys(spark, staged, stored):
    """A third of the rows on one key and a third without any: counted whole, one row per imported vacancy."""
    n = 3000
    rows = spark.range(n).select(
        F.col("id").alias("row_idx"),
        F.when(F.col("id") % 3 == 0, "7").when(F.col("id") % 3 == 1, F.lit(None)).otherwise((F.col("id") + 10_000).cast("string")).alias("ID"),
        F.concat(F.lit("p"), F.col("id")).alias("Puesto solicitado"),
    )
    result = ingest.plan_import(rows, *stored)
    assert report(result) == (2 * n // 3, n // 3, 0, n)
    assert result.vacancies.count() == 4 + 2 * n // 3
    assert result.vacancies.where("id = 10").first()["puesto_vacante"] == f"P{n - 3}"


@pytest.mark.parametrize("key, kept", [
    ("9223372036854775807", 9223372036854775807), ("1.5E+05", 150000), (" 1e3", 1000), (".5", 0), ("12.9", 12), ("-7", -7),
    ("9223372036854775808", None), ("1e30", None), ("12e", None), ("abc", None),
])
def test_keys_of_any_size_and_form(staged, key, kept):
    row = ingest.cleanse(staged(line(key))).first()
    assert (row["id_sistema"], row["motivo"]) == (kept, None if kept is not None else "ID no es un número")


def test_last_of_very_many_rows_of_a_long_key(spark, stored):
    key = "9223372036854775807"
    rows = spark.range(1000).selectExpr("id AS row_idx", f"'{key}' AS ID", "concat('p', id) AS `Puesto solicitado`")
    result = ingest.plan_import(rows, *stored, at=AT)
    assert report(result) == (1, 999, 0, 1000)
    assert result.vacancies.where(f"id_sistema = {key}").first()["puesto_vacante"] == "P999"


def test_run_import_writes_new_versions(spark, staged, stored, tmp_path):
    path = str(tmp_path / "v1")
    row = ingest.run_import(staged(line("7"), line("900"), line("x")), *stored, path=path, at=AT).first()
    assert (row["nuevos"], row["actualizados"], row["fallidos"]) == (1, 1, 1)
    written = tables.read_table(spark, path, "vacantes")
    assert written.count() == 5 and tables.read_table(spark, path, "registros_rh").count() == 5
    assert spark.read.parquet(f"{path}/rechazos").count() == 1


# --- appends and edits --------------------------------------------------------------------------------------


def test_append_hires(make, spark):
    master, child = make("registros_rh", {"id": 5}), make("altas", {"id": 3})
    incoming = spark.createDataFrame(
        [(0, " chofer\t", " E ", "P", "OPERATIVA", 2), (1, "  ", "E", "P", "OPERATIVA", 1)],
        "row_idx long, puesto_alta string, empresa_alta string, plaza_alta string, area_alta string, contratados_alta int",
    )
    out = ingest.append_hires(incoming, master, child, AT)
    assert tuples(out.child, "id", "id_registro", "puesto_alta", "contratados_alta", "empresa_alta") == [(4, 6, "CHOFER", "2", " E ")]
    assert tuples(out.master, "id", "tipo_registro", "puesto", "empresa") == [(6, "Alta", "CHOFER", "E")]
    assert tuples(out.rejects) == [(1, "puesto_alta es obligatorio")]


def test_append_leavers_folds(make, spark):
    incoming = spark.createDataFrame(
        [(0, "técnico ñ", "E", "P", "OPERATIVA", " renunció ")],
        "row_idx long, puesto_baja string, empresa_baja string, plaza_baja string, area_baja string, motivo_baja string",
    )
    out = ingest.append_leavers(incoming, make("registros_rh"), make("bajas"), AT)
    assert tuples(out.child, "id", "id_registro", "puesto_baja", "motivo_baja") == [(1, 1, "TECNICO Ñ", "RENUNCIO")]


def test_append_vacancies_form_rules(make, spark):
    columns = ("row_idx long, puesto_vacante string, empresa_vacante string, plaza_vacante string, funcion_area_vacante string, "
               "vacantes_solicitadas int, vacantes_contratados int, fecha_autorizacion date, fecha_cobertura date, "
               "comentarios_vacante string, tipo_reclutamiento_vacante string, medio_reclutamiento_vacante string")
    d = dt.date(2024, 1, 1)
    incoming = spark.createDataFrame(
        [(0, "a", "E", "P", "operativa", 1, 3, d, d, "á", "referido interno", "occ"),
         (1, "b", "E", "P", "operativa", 2, 0, None, d, "", "referido interno", "occ")], columns)
    out = ingest.append_vacancies(incoming, make("registros_rh"), make("vacantes"), AT)
    shown = ("vacantes_solicitadas", "vacantes_contratados", "fecha_autorizacion", "fecha_cobertura", "comentarios_vacante",
             "tipo_reclutamiento_vacante", "medio_reclutamiento_vacante", "funcion_area_vacante", "id_sistema")
    assert tuples(out.child.orderBy("id"), *shown) == [
        (-2, "3", d, d, "Á", "REFERIDO INTERNO", "OCC", "OPERATIVA", None),
        (2, "0", dt.date(1900, 1, 1), None, None, "SIN ESPECIFICAR", "SIN ESPECIFICAR", "OPERATIVA", None),
    ]


def test_append_master_checks_the_type(make, spark):
    incoming = spark.createDataFrame(
        [(0, "Alta", " a ", "e", "p", "x"), (1, "Otro", "b", "e", "p", "x"), (2, None, "c", "e", "p", "x")],
        "row_idx long, tipo_registro string, puesto string, empresa string, plaza string, area string",
    )
    rows, rejects = ingest.append_master(incoming, make("registros_rh", {"id": 9}), AT)
    assert tuples(rows, "id", "tipo_registro", "puesto") == [(10, "Alta", "A")]
    assert sorted(r["row_idx"] for r in rejects.collect()) == [1, 2]


def test_edits(make, spark):
    stored = make("vacantes", {"id": 1, "fase_proceso": "X", "plaza_vacante": "LEON", "confidencial": "SI"}, {"id": 2})
    edits = spark.createDataFrame([(1, "En prueba técnica", None)], "id long, fase_proceso string, plaza_vacante string")
    assert sorted(tuples(ingest.edit_vacancies(stored, edits), "id", "fase_proceso", "plaza_vacante", "confidencial"), key=str) == [
        (1, "EN PRUEBA TECNICA", None, "SI"), (2, None, None, None),
    ]
    leavers = make("bajas", {"id": 1, "motivo_baja": "X"})
    edits = spark.createDataFrame([(1, " decisión ", " LEON ")], "id long, motivo_baja string, plaza_baja string")
    assert tuples(ingest.edit_leavers(leavers, edits), "motivo_baja", "plaza_baja") == [("DECISION", "LEON")]


def test_full_row_updates(make, spark):
    stored = make("vacantes", {"id": 1, "id_registro": 5, "plaza_vacante": "LEON", "confidencial": "SI"}, {"id": 2, "plaza_vacante": "X"})
    rows = spark.createDataFrame(
        [(1, 6, " jefe ", "operativa", " revisión ", "3"), (2, 7, "  ", None, None, None)],
        "id long, id_registro long, puesto_vacante string, funcion_area_vacante string, comentarios_vacante string, vacantes_contratados string",
    )
    shown = ("id", "id_registro", "puesto_vacante", "plaza_vacante", "funcion_area_vacante", "comentarios_vacante",
             "vacantes_solicitadas", "vacantes_contratados", "confidencial")
    assert sorted(tuples(ingest.update_vacancies(stored, rows), *shown)) == [
        (1, 6, "JEFE", None, "OPERATIVA", "REVISION", 0, "3", "SI"), (2, None, None, "X", None, None, None, None, None),
    ]
    master = make("registros_rh", {"id": 5, "tipo_registro": "Vacante", "puesto": "A", "area": "B"})
    rows = spark.createDataFrame([(5, " jefe ", " e ", None, " x ")], "id long, puesto string, empresa string, plaza string, area string")
    assert tuples(ingest.update_master(master, rows), "id", "tipo_registro", "puesto", "empresa", "plaza", "area") == [
        (5, "Vacante", "JEFE", "e", None, "x"),
    ]


# --- files in and out ---------------------------------------------------------------------------------------


def test_drop_folder_numbers_rows_in_file_order(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    for name, start in (("b.csv", 100), ("a.csv", 0)):
        lines = "\n".join(f"{start + i},puesto {start + i}" for i in range(100))
        (folder / name).write_text(f" ID , Puesto solicitado\n{lines}\n", encoding="utf-8")
    rows = tables.read_drop_folder(spark, str(folder))
    assert rows.columns == ["ID", "Puesto solicitado", "row_idx"]
    got = sorted((r["row_idx"], int(r["ID"])) for r in rows.collect())
    assert got == [(i, i) for i in range(200)]
    assert [r["ID"] for r in tables.preview(rows).collect()] == [str(i) for i in range(10)]


def test_drop_folder_of_a_file_in_several_blocks(spark, tmp_path):
    folder = tmp_path / "blocks"
    folder.mkdir()
    (folder / "a.csv").write_text("ID,x\n" + "\n".join(f"{i},{'y' * 90}" for i in range(2000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = tables.read_drop_folder(spark, str(folder))
        assert sorted((r["row_idx"], int(r["ID"])) for r in rows.collect()) == [(i, i) for i in range(2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("file_format", ["json", "parquet"])
def test_drop_folder_formats(spark, tmp_path, file_format):
    path = str(tmp_path / file_format)
    spark.sql("SELECT 7 AS ID, CAST(NULL AS STRING) AS Plaza, 'x' AS `Puesto solicitado`").write.format(file_format).save(path)
    row = tables.read_drop_folder(spark, path, file_format).first()
    assert (row["ID"], row["row_idx"]) == ("7", 0)


def test_write_by_year_and_read_back(spark, make, tmp_path):
    path = str(tmp_path / "altas")
    df = make("altas", {"id": 1, "fecha_alta": "2023-01-01"}, {"id": 2, "fecha_alta": "2024-01-01"}, {"id": 3})
    tables.write_table(df, path, "fecha_alta")
    assert tables.read_table(spark, str(tmp_path), "altas", ["id", "fecha_alta"]).count() == 3
    plan = spark.read.parquet(path).where("anio_particion = 2024")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(anio_particion" in plan
    with pytest.raises(Exception):
        tables.write_table(df, path)


def test_exports(spark, make, tmp_path):
    df = make("altas", {"id": 1, "fecha_alta": "2023-01-01", "puesto_alta": "ñ"}).select("id", "fecha_alta", "puesto_alta")
    tables.export_csv(df, str(tmp_path / "csv"))
    tables.export_json(df, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["puesto_alta"] == "ñ"
    assert '"fecha_alta":"2023-01-01"' in spark.read.text(str(tmp_path / "json")).first()["value"]


def test_lookups_and_catalogs(spark, make):
    v = make("vacantes", {"id": 1, "id_sistema": 7}, {"id": 2, "id_sistema": 8}, {"id": 3})
    keys = spark.createDataFrame([(7,), (7,), (None,)], "id_sistema long")
    assert tuples(tables.rows_with_keys(v, keys, "id_sistema"), "id") == [(1,)]
    a = make("altas", {"id": 1, "puesto_alta": "CHOFER "}, {"id": 2, "puesto_alta": "CHOFER"}, {"id": 3, "puesto_alta": " "})
    assert tuples(tables.distinct_values(a, "puesto_alta")) == [("CHOFER",)]
    v = make("vacantes", {"id": 1, "plaza_vacante": " LEON "}, {"id": 2, "plaza_vacante": "Lugar"}, {"id": 3, "plaza_vacante": " "}, {"id": 4, "plaza_vacante": "Lugar "})
    assert tuples(tables.outside_catalog(v, {"plaza_vacante": catalogs.SITES})) == [("plaza_vacante", "Lugar", 2)]
    assert tables.read_range(make("altas", {"id": 1, "fecha_alta": "2024-01-01"}), "fecha_alta", dt.date(2024, 1, 1)).count() == 1


def dropped(spark, folder, files, **options):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name).write_bytes(text.encode())
    got = tables.read_drop_lines(spark, str(folder), **options)
    rows = [r.asDict() for r in got.rows.orderBy("row_idx").collect()]
    return rows, [tuple(r) for r in got.rejects.orderBy("archivo", "linea").collect()]


def test_files_with_different_headers_meet_by_name(spark, tmp_path):
    rows, bad = dropped(spark, tmp_path / "d", {"a.csv": "ID, Plaza \n1,x\n\n2,\n", "b.csv": "﻿Plaza,Empresa,ID\r\ny,z,3\r\n"})
    assert [(r["ID"], r["Plaza"], r["Empresa"]) for r in rows] == [("1", "x", None), ("2", None, None), ("3", "y", "z")]
    assert [r["row_idx"] for r in rows] == [1, 3, 5] and bad == []


def test_bad_lines_are_told_with_file_and_line(spark, tmp_path):
    text = 'ID,V\n1,"a, ""b"""\n2\n3,"line one\nline two\n\nline four"\n4,x,y\n5,"open\n6,ok\n'
    rows, bad = dropped(spark, tmp_path / "d", {"a.csv": text, "b.csv": "ID\n7\n"})
    assert [(r["ID"], r["V"]) for r in rows] == [("1", 'a, "b"'), ("3", "line one\nline two\n\nline four"), ("6", "ok"), ("7", None)]
    assert bad == [
        ("a.csv", 3, "número de columnas", "2"), ("a.csv", 8, "número de columnas", "4,x,y"), ("a.csv", 9, "comillas sin cerrar", '5,"open'),
    ]


def test_records_of_too_many_lines_are_not_put_together(spark, tmp_path):
    text = "ID,V\n" + '1,"a\n' + "".join(f"{k},x\n" for k in range(2, 9)) + '9",y\n10,z\n'
    rows, bad = dropped(spark, tmp_path / "d", {"a.csv": text}, max_lines=5)
    assert [r["ID"] for r in rows] == ["2", "3", "4", "5", "6", "7", "8", "10"]
    assert [b[:3] for b in bad] == [("a.csv", 2, "comillas sin cerrar"), ("a.csv", 10, "comillas sin cerrar")]
    whole, none = dropped(spark, tmp_path / "d", {"a.csv": text})
    assert [r["ID"] for r in whole] == ["10"] and [b[:3] for b in none] == [("a.csv", 2, "número de columnas")]


def test_lines_are_the_same_however_files_are_split(spark, tmp_path):
    text = "ID,V\n" + "".join(f'{k},"first of {k}\nsecond, of {k}"\n' if k % 3 == 0 else f"{k}\n" if k % 7 == 0 else f"{k},v{k}\n" for k in range(400))
    want = dropped(spark, tmp_path / "d", {"a.csv": text, "b.csv": text})
    assert len(want[0]) == 2 * sum(k % 3 == 0 or k % 7 != 0 for k in range(400)) and len(want[1]) == 2 * sum(k % 7 == 0 and k % 3 != 0 for k in range(400))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert dropped(spark, tmp_path / "d", {}) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headers_alone_empty_files_and_odd_names(spark, tmp_path):
    rows, bad = dropped(spark, tmp_path / "d", {"a.csv": "ID,V\n", "b.csv": "", "c.csv": "ID,,ID\n1,2,3\n"})
    assert [(r["ID"], r["_c1"], r["_c2"], r["V"]) for r in rows] == [("1", "2", "3", None)] and bad == []
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.csv").write_text("")
    got = tables.read_drop_lines(spark, str(tmp_path / "e"))
    assert got.rows.collect() == [] and got.rejects.collect() == []


def test_cleansing_works_out_no_shape_in_a_row_projection(spark):
    """The shapes of dates stand in functions over arrays: as columns they make a method that the JVM does not compile."""
    plan = ingest.cleanse(fx.importacion(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == 2 and plan.count("lambdafunction(") == 2
