"""Stored tables in and out."""

from __future__ import annotations

import csv
import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reclutark import schemas
from reclutark.functions.calendar import in_range
from reclutark.functions.text import blank_to_null
from reclutark.operators.changes import dense_index
from reclutark.session import cut_lineage


def read_table(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored table with its declared types, whole or some columns; the scan reads only what is used."""
    df = spark.read.schema(schemas.TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")
    return df.select(*columns) if columns else df


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """A stored table without rows but with its types; every report over it gives zeros or no rows."""
    return spark.createDataFrame([], schemas.TABLES[name])


def read_range(df: DataFrame, date: str, start: dt.date, end: dt.date | None = None) -> DataFrame:
    """Rows from ``start`` on, up to ``end`` if given; pushed to the scan."""
    if end is None:
        return df.where(F.col(date).cast("date") >= F.lit(start))
    return df.where(in_range(F.col(date), start, end))


def last_update(master: DataFrame) -> DataFrame:
    """Day of the latest update stamp; rows without a stamp do not count."""
    return master.agg(F.max("ultima_actualizacion").cast("date").alias("ultima_actualizacion"))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The snapshot of the latest (year, ISO week), compared as numbers."""
    by_week = F.struct(
        F.col("año").cast("int").alias("anio"), F.col("semana_iso").cast("int").alias("semana"), "n_vacantes"
    )
    return snapshots.agg(F.max(by_week).alias("s")).select(
        F.col("s.n_vacantes").cast("bigint").alias("n_vacantes_anterior"),
        F.concat(F.lit("S"), F.col("s.semana"), F.lit(" "), F.col("s.anio")).alias("semana_anterior"),
    )


def rows_with_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the given ones: the batch form of a lookup by business key."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def outside_catalog(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Stored values (columna, valor, filas), trimmed, that the catalog of their column doesn't allow; blank ones don't count.

    One pass: every row gives its odd cells, which are counted before the shuffle.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("columna"), F.when(~blank_to_null(F.col(c)).isin(list(allowed)), blank_to_null(F.col(c))).alias("valor"))
        for c, allowed in domains.items()
    ])
    return df.select(F.inline(cells)).where(F.col("valor").isNotNull()).groupBy("columna", "valor").agg(F.count("*").alias("filas"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """A catalog drawn from stored rows (positions, recruiters): trimmed, without blanks, each value once."""
    return df.select(blank_to_null(F.col(column)).alias(column)).where(F.col(column).isNotNull()).distinct()


def read_drop_folder(spark: SparkSession, path: str, file_format: str = "csv", **options: str) -> DataFrame:
    """Tabular files of a drop folder, every column as text and header names trimmed, plus ``row_idx``.

    ``row_idx`` numbers the rows 0.. in file order (file name, place in the file), which the import needs to
    tell earlier from later rows.  A row's block and its place in the block are the same however often the files are read,
    so nothing is copied for the numbers: the blocks' counts are read first, then the rows.
    """
    if file_format == "csv":
        options = {"header": "true", "inferSchema": "false", **options}
    if file_format == "json":
        options = {"primitivesAsString": "true", **options}
    raw = spark.read.format(file_format).options(**options).load(path)
    cells = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c.strip()) for c in raw.columns]
    staged = raw.select(
        *cells,
        F.col("_metadata.file_path").alias("_archivo"),
        F.col("_metadata.file_block_start").alias("_bloque"),
        F.monotonically_increasing_id().alias("_posicion"),
    )
    return dense_index(staged, ["_archivo", "_bloque"], "_posicion", "row_idx").drop(
        "_archivo", "_bloque", "_posicion"
    )


@dataclass(frozen=True)
class Dropped:
    """Rows of dropped files, every column as text, with ``row_idx``; and bad lines (archivo, linea, motivo, texto)."""

    rows: DataFrame
    rejects: DataFrame


OPEN_QUOTES, WRONG_WIDTH = "comillas sin cerrar", "número de columnas"


def read_drop_lines(spark: SparkSession, path: str, max_lines: int = 1000, **options: str) -> Dropped:
    """CSV files below ``path`` whose headers may differ, with line breaks inside quotes, and a channel for bad lines.

    Columns meet by header name, trimmed; a column that a file lacks is NULL there.  ``row_idx`` is the line's place in the folder (by file name), so it
    rises with file order.  A record whose number of cells isn't its header's, or whose quotes aren't closed, is refused with file and line,
    counted from 1; lines after it are read on.  A record of more than ``max_lines`` lines counts as not closed: its first and last line are refused, those between
    are read as lines.  Blank lines don't count; empty cells are NULL.

    Files are read once, into the checkpoint folder, and split as usual: lines are numbered by counts per block, and a record over several lines is
    found from the lines with an odd number of quotes, which are paired by their number in the file.  Only headers, one per file, reach the driver.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("value").alias("texto"),
        F.col("_metadata.file_path").alias("archivo"),
        F.col("_metadata.file_block_start").alias("bloque"),
        F.monotonically_increasing_id().alias("posicion"),
    )
    lines = dense_index(cut_lineage(raw), ["archivo", "bloque"], "posicion", "row_idx", "linea").drop("posicion")
    quotes = F.char_length("texto") - F.char_length(F.replace("texto", F.lit('"'), F.lit("")))
    odd = lines.where(quotes % 2 == 1).select(
        "archivo", "bloque", "linea", F.row_number().over(Window.partitionBy("archivo", "bloque").orderBy("linea")).alias("n")
    )
    pairs = dense_index(odd, ["archivo", "bloque"], "n", "en_carpeta", "en_archivo").groupBy(
        "archivo", F.floor(F.col("en_archivo") / 2).alias("par")
    ).agg(F.min("linea").alias("abre"), F.max("linea").alias("cierra"), F.count("*").alias("lineas"))
    whole = (F.col("lineas") == 2) & (F.col("cierra") - F.col("abre") < max_lines)
    inside = pairs.where(whole).select("archivo", F.explode(F.sequence("abre", "cierra")).alias("linea"), F.col("abre").alias("registro"))
    left_open = pairs.where(~whole).select("archivo", F.explode(F.array_distinct(F.array("abre", "cierra"))).alias("linea"), F.lit(OPEN_QUOTES).alias("motivo"))
    marked = lines.join(inside.unionByName(left_open, allowMissingColumns=True), ["archivo", "linea"], "left")
    joined = marked.where(F.col("registro").isNotNull()).groupBy("archivo", F.col("registro").alias("linea")).agg(
        F.min("row_idx").alias("row_idx"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("linea", "texto"))), lambda x: x["texto"]), "\n").alias("texto"),
    )
    single = marked.where(F.col("registro").isNull()).select("archivo", "linea", "row_idx", "texto", "motivo")
    records = cut_lineage(single.unionByName(joined, allowMissingColumns=True))

    headers = records.where("linea = 0").select("archivo", F.regexp_replace("texto", "^\ufeff", "").alias("cabecera"))
    data = records.where((F.col("linea") > 0) & (F.trim("texto") != "")).join(headers, "archivo")
    settings = {"escape": '"', **options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malo"}
    rows, broken = None, data.where(F.col("motivo").isNotNull()).select("archivo", "linea", "motivo", "texto")
    for (header,) in headers.select("cabecera").distinct().orderBy("cabecera").collect():
        names = _column_names(next(csv.reader([header], delimiter=options.get("sep", ",")), []))
        kind = ", ".join(f"{c} string" for c in [*(f"c{k}" for k in range(len(names))), "_malo"])
        own = data.where((F.col("cabecera") == header) & F.col("motivo").isNull())
        cells = own.withColumn("celdas", F.from_csv("texto", kind, settings))
        good = cells.where(F.col("celdas._malo").isNull()).select(
            "row_idx", *[F.nullif(F.col(f"celdas.c{k}"), F.lit("")).alias(name) for k, name in enumerate(names)]
        )
        rows = good if rows is None else rows.unionByName(good, allowMissingColumns=True)
        wrong = cells.where(F.col("celdas._malo").isNotNull())
        broken = broken.unionByName(wrong.select("archivo", "linea", F.lit(WRONG_WIDTH).alias("motivo"), "texto"))
    if rows is None:
        rows = spark.createDataFrame([], "row_idx long")
    name = F.regexp_extract("archivo", "([^/]*)$", 1)
    return Dropped(rows, broken.select(name.alias("archivo"), (F.col("linea") + 1).alias("linea"), "motivo", "texto"))


def _column_names(cells: Sequence[str]) -> list[str]:
    """Trimmed header cells; empty and repeated ones are named by their place."""
    names = [c.strip() for c in cells]
    return [n if n and n not in names[:k] else f"_c{k}" for k, n in enumerate(names)]


def preview(staged: DataFrame, rows: int = 10) -> DataFrame:
    """The first rows in file order."""
    return staged.orderBy("row_idx").limit(rows)


def write_table(df: DataFrame, path: str, date: str | None = None) -> None:
    """New version of a table at a new path, by calendar year of ``date`` if given.

    The rebalance hint lets adaptive execution even out the files: a year with most rows is split.
    """
    if date is None:
        df.write.mode("errorifexists").parquet(path)
        return
    by_year = df.withColumn("anio_particion", F.year(date))
    by_year.hint("rebalance", "anio_particion").write.mode("errorifexists").partitionBy("anio_particion").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", "true").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    options = {"dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd", "ignoreNullFields": "false"}
    df.write.mode("errorifexists").options(**options).json(path)
