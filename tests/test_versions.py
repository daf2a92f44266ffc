"""Versioned tables: commits, conflicts, partitions by hash, index of files, clean-up, imports into a store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reclutark import catalogs
from reclutark.plans import daily
from reclutark.sources import ingest, versions
from reclutark.sources.versions import Conflict, Store

@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def numbers(spark, rows, buckets=8):
    return spark.createDataFrame(rows, "id long, v string"), {"key": "id", "buckets": buckets}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def put(store, name, df, **how):
    change = store.begin()
    change.put(name, df, **how)
    return change.commit()


def test_versions_are_seen_when_committed_and_stay_readable(spark, store):
    df, how = numbers(spark, [(i, "a") for i in range(20)])
    assert store.versions() == [] and store.tables() == {}
    assert put(store, "t", df, **how) == 1
    change = store.begin()
    change.put("t", df.where("id < 3"), **how)
    change.put("u", df.where("id = 7"))
    assert store.read("t").count() == 20 and change.read("t").count() == 3
    assert change.commit() == 2 and store.versions() == [1, 2]
    assert rows(store.read("u")) == [(7, "a")] and store.read("t").count() == 3 and store.read("t", version=1).count() == 20


def test_a_change_that_fails_half_way_is_never_seen(spark, store):
    df, how = numbers(spark, [(i, "a") for i in range(5)])
    put(store, "t", df, **how)
    change = store.begin()
    change.put("t", df.where("id < 1"), **how)
    with pytest.raises(Exception, match="no division"):
        change.put("u", df.select("id", F.raise_error(F.lit("no division")).cast("string").alias("v")))
    assert store.versions() == [1] and store.read("t").count() == 5 and "u" not in store.tables()


def test_the_second_of_two_writers_has_to_start_over(spark, store):
    df, how = numbers(spark, [(1, "a")])
    one, two = store.begin(), store.begin()
    one.put("t", df, **how)
    two.put("t", df.withColumn("v", F.lit("b")), **how)
    assert one.commit() == 1
    with pytest.raises(Conflict):
        two.commit()
    assert rows(store.read("t")) == [(1, "a")] and store.files.names("manifests") == ["000000000001.json"]


def test_a_patch_writes_only_the_buckets_of_its_keys(spark, store):
    df, how = numbers(spark, [(i, "a") for i in range(200)] + [(None, "n"), (None, "n")], buckets=16)
    put(store, "t", df, **how)
    before = store.tables()["t"].folders
    change = store.begin()
    change.patch("t", spark.createDataFrame([(7, None), (9, "z"), (999, "no row")], "id long, v string"), ["v"])
    change.commit()
    after = store.tables()["t"].folders
    touched = set(store.buckets(store.tables()["t"], spark.createDataFrame([(7,), (9,), (999,)], "id long")))
    assert {b for b in after if after[b] != before[b]} == touched & set(before) and 1 <= len(touched) <= 3
    want = [(i, None if i == 7 else "z" if i == 9 else "a") for i in range(200)] + [(None, "n")] * 2
    assert rows(store.read("t")) == sorted(want, key=str) and rows(store.read("t", version=1)) == rows(df)


def test_reading_by_key_reads_only_its_buckets(spark, store):
    df, how = numbers(spark, [(i, "a") for i in range(500)], buckets=32)
    put(store, "t", df, **how)
    some = store.read("t", keys=spark.createDataFrame([(3,), (None,)], "id long"))
    assert len({f.rpartition("/")[0] for f in some.inputFiles()}) == 1 and (3, "a") in rows(some)
    assert store.read("t", keys=spark.createDataFrame([], "id long")).count() == 0


def test_added_rows_leave_stored_files_alone(spark, store):
    df, how = numbers(spark, [(i, "a") for i in range(50)])
    put(store, "t", df, **how)
    before = set(store.read("t").inputFiles())
    change = store.begin()
    change.add("t", df.withColumn("id", F.col("id") + 100))
    change.add("t", df.limit(0))
    change.commit()
    assert before < set(store.read("t").inputFiles()) and store.read("t").count() == 100
    change = store.begin()
    change.patch("t", spark.createDataFrame([(3, "x"), (103, "y")], "id long, v string"), ["v"])
    assert {(3, "x"), (103, "y")} <= set(rows(change.read("t"))) and change.read("t").count() == 100


def test_lookups_read_only_files_that_may_hold_their_keys(spark, store):
    df = spark.range(4000).select("id", F.concat(F.lit("k"), (F.col("id") * 7 % 4001).cast("string")).alias("v"))
    put(store, "t", df, key="id", buckets=16, index=("v", "id"))
    keys = spark.createDataFrame([("k7",), ("k14",), ("none",), (None,)], "v string")
    found = store.lookup("t", "v", keys)
    assert rows(found) == [(1, "k7"), (2, "k14")]
    assert len(found.inputFiles()) <= 6 < len(store.read("t").inputFiles())
    assert rows(store.lookup("t", "id", spark.createDataFrame([(5,), (99999,)], "id long"))) == [(5, "k35")]
    change = store.begin()
    change.patch("t", spark.createDataFrame([(1, "changed")], "id long, v string"), ["v"])
    change.add("t", spark.createDataFrame([(9000, "k7")], "id long, v string"))
    change.commit()
    assert rows(store.lookup("t", "v", keys)) == [(2, "k14"), (9000, "k7")]
    assert rows(store.lookup("t", "v", keys, version=1)) == [(1, "k7"), (2, "k14")]
    assert store.lookup("t", "v", keys.limit(0)).count() == 0


def test_every_stored_key_is_found_by_the_index(spark, store):
    df = spark.range(20_000).select(F.xxhash64("id").alias("id"), F.lit("x").alias("v"))
    put(store, "t", df, key="id", buckets=4, index=("id",))
    assert store.tables()["t"].indexes["id"][0][1] > 1
    assert store.lookup("t", "id", df).count() == 20_000


def test_bounds_come_from_the_index_of_current_files(spark, store):
    df = spark.createDataFrame([(i, f"2024-01-{i:02d}") for i in range(1, 31)] + [(40, None)], "id long, v string")
    put(store, "t", df, key="id", buckets=8, index=("v",))
    assert rows(store.bounds("t", "v")) == [("2024-01-01", "2024-01-30")]
    change = store.begin()
    change.patch("t", spark.createDataFrame([(30, "2023-01-01"), (1, None)], "id long, v string"), ["v"])
    change.commit()
    bounds = store.bounds("t", "v")
    assert rows(bounds) == [("2023-01-01", "2024-01-29")] == [tuple(store.read("t").agg(F.min("v"), F.max("v")).first())]
    table = store.tables()["t"]
    indexes = {folder for folder, _ in table.indexes["v"]}
    assert {"/".join(f.split("/")[-3:-1]) for f in bounds.inputFiles()} <= indexes
    assert rows(store.bounds("t", "v", version=1)) == [("2024-01-01", "2024-01-30")]


def test_empty_tables_and_null_keys(spark, store):
    df, how = numbers(spark, [])
    put(store, "t", df, **how, index=("v",))
    assert store.read("t").columns == ["id", "v"] and rows(store.read("t")) == []
    change = store.begin()
    change.patch("t", spark.createDataFrame([(1, "a")], "id long, v string"), ["v"])
    change.add("t", spark.createDataFrame([(None, None), (None, None)], "id long, v string"))
    change.commit()
    assert rows(store.read("t")) == [(None, None)] * 2
    assert rows(store.lookup("t", "v", spark.createDataFrame([("a",)], "v string"))) == []


def test_clean_up_keeps_what_kept_versions_name(spark, store):
    df, how = numbers(spark, [(i, "a") for i in range(30)])
    put(store, "t", df, **how)
    for k in range(3):
        change = store.begin()
        change.patch("t", spark.createDataFrame([(k, "b")], "id long, v string"), ["v"])
        change.commit()
    lost = store.begin()
    lost.put("t", df, **how)
    assert store.vacuum(keep=2) == []  # all files are young
    assert store.versions() == [3, 4]
    assert len(store.vacuum(keep=1, older_than_seconds=0)) >= 1
    assert store.versions() == [4] and rows(store.read("t")) == sorted([(i, "b" if i < 3 else "a") for i in range(30)], key=str)


def staged(spark, *cells):
    names = {"ID": "id_sistema", "Puesto solicitado": "puesto_vacante"}
    headers = list(catalogs.IMPORT_COLUMNS.values())
    rows = [(i, *[{"ID": c[0], "Puesto solicitado": c[1]}.get(h) for h in headers]) for i, c in enumerate(cells)]
    assert set(names) <= set(headers)
    return spark.createDataFrame(rows, "row_idx long, " + ", ".join(f"`{h}` string" for h in headers))


def test_imports_into_a_store(spark, make, store):
    change = store.begin()
    change.put("vacantes", make("vacantes", {"id": 1, "id_registro": 11, "id_sistema": 5, "puesto_vacante": "OLD", "confidencial": "SI"}), "id", 4)
    change.put("registros_rh", make("registros_rh", {"id": 11, "puesto": "OLD"}), "id", 4)
    change.commit()
    report = ingest.commit_import(store, staged(spark, ("5", "uno"), ("6", "dos"), ("6", "tres"), (None, "cuatro"), ("x", "mal"))).first()
    assert (report.nuevos, report.actualizados, report.fallidos) == (2, 2, 1)
    got = {(r.id_sistema, r.puesto_vacante, r.confidencial) for r in store.read("vacantes").collect()}
    assert got == {(5, "UNO", "SI"), (6, "TRES", None), (None, "CUATRO", None)}
    assert {r.puesto for r in store.read("registros_rh").collect()} == {"UNO", "TRES", "CUATRO"}
    assert [r.row_idx for r in store.read("rechazos").collect()] == [4]
    linked = store.read("vacantes").alias("v").join(store.read("registros_rh").alias("r"), F.expr("v.id_registro = r.id and v.puesto_vacante = r.puesto"))
    assert linked.count() == 3

    def broken(*_):
        raise RuntimeError("lost")

    keep, versions.Change.put = versions.Change.put, broken
    try:
        with pytest.raises(RuntimeError):
            ingest.commit_import(store, staged(spark, ("5", "other")))
    finally:
        versions.Change.put = keep
    assert store.versions() == [1, 2] and {r.puesto_vacante for r in store.read("vacantes").collect()} == {"UNO", "TRES", "CUATRO"}
    ingest.commit_import(store, staged(spark, ("6", "cinco")))
    assert {r.puesto_vacante for r in store.read("vacantes").collect()} == {"UNO", "CINCO", "CUATRO"} and store.read("rechazos").count() == 0


def test_daily_totals_move_on_with_an_import(spark, make, store):
    stored = [
        {"id": 1, "id_registro": 11, "id_sistema": 5, "puesto_vacante": "OLD", "fase_proceso": "CONTRATADO", "fecha_solicitud": "2024-01-05", "tipo_solicitud": "NUEVO",
         "vacantes_contratados": "2"},
        {"id": 2, "id_registro": 12, "id_sistema": 6, "puesto_vacante": "OLD", "fase_proceso": "CONTRATADO", "fecha_solicitud": "2024-01-09", "tipo_solicitud": "NUEVO",
         "vacantes_contratados": "1"},
    ]
    change = store.begin()
    change.put("vacantes", make("vacantes", *stored), "id", 4)
    change.put("registros_rh", make("registros_rh", {"id": 11}, {"id": 12}), "id", 4)
    change.put("diario", daily.of_vacancies(change.read("vacantes")))
    change.commit()
    before = store.tables()["diario"].folders["0"]
    ingest.commit_import(store, staged(spark, ("5", "uno"), ("7", "dos")))
    parts = store.read("diario")
    assert store.tables()["diario"].folders["0"][:1] == before
    want = rows(daily.merged(daily.of_vacancies(store.read("vacantes"))))
    assert rows(daily.merged(parts)) == want and len(want) == 1
    assert {r.dia for r in parts.where("cantidad < 0").collect()} == {dt.date(2024, 1, 5)}
    windows = [(2024, dt.date(2024, 1, 1), dt.date(2024, 12, 31)), (2025, dt.date(2025, 1, 1), dt.date(2025, 12, 31))]
    assert rows(daily.window_totals(parts, windows)) == [(2024, 0, 1, 0), (2025, 0, 0, 0)]
