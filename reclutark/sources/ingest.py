"""Batch writes: appends of hires, leavers and vacancies, edits, and the bulk vacancy import."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reclutark import catalogs
from reclutark.functions import coerce, measures, text
from reclutark.operators import changes, series
from reclutark.plans import daily
from reclutark.session import cut_lineage
from reclutark.sources.tables import write_table
from reclutark.sources.versions import Store

MASTER_COLUMNS = ("puesto", "empresa", "plaza", "area")

# Columns an import row writes into a vacancy; the confidential mark is not among them and so survives.
VACANCY_COLUMNS = (
    "fecha_solicitud", "tipo_solicitud", "estatus_solicitud", "fase_proceso", "fecha_avance",
    "fecha_autorizacion", "puesto_vacante", "plaza_vacante", "empresa_vacante", "funcion_area_vacante",
    "vacantes_solicitadas", "vacantes_contratados", "responsable_vacante", "comentarios_vacante",
    "tipo_reclutamiento_vacante", "medio_reclutamiento_vacante", "fecha_cobertura", "id_sistema",
)


@dataclass(frozen=True)
class Appended:
    """New master rows, new child rows linked to them, and refused rows with their reason."""

    master: DataFrame
    child: DataFrame
    rejects: DataFrame


@dataclass(frozen=True)
class Imported:
    """Outcome of a bulk import: both tables after it, its report and its refused rows."""

    vacancies: DataFrame
    master: DataFrame
    report: DataFrame
    rejects: DataFrame


def _stamp(at: dt.datetime | None) -> Column:
    return F.current_timestamp() if at is None else F.lit(at)


def _reason(*checks: tuple[Column, str]) -> Column:
    """Text of the first failed check, NULL for a valid row."""
    failed, message = checks[0]
    reason = F.when(failed, F.lit(message))
    for failed, message in checks[1:]:
        reason = reason.when(failed, F.lit(message))
    return reason


def _as_table(df: DataFrame, table: DataFrame) -> DataFrame:
    """Columns, order and types of the stored table; columns the rows lack are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table.schema.fields
        ]
    )


def master_rows(incoming: DataFrame, master: DataFrame, at: dt.datetime | None = None) -> DataFrame:
    """Master rows for valid incoming rows (row_idx, tipo_registro, puesto, empresa, plaza, area).

    The new id is the largest id in use plus the row's place in the batch: unique and repeatable without
    sorting or gathering the batch.
    """
    return incoming.select(
        (changes.next_id_base(master) + 1 + F.col("row_idx")).alias("id"),
        F.initcap(text.strip(F.col("tipo_registro"))).alias("tipo_registro"),
        _stamp(at).alias("fecha_creacion"),
        text.strip_upper(F.col("puesto")).alias("puesto"),
        *[text.strip(F.col(c)).alias(c) for c in ("empresa", "plaza", "area")],
    )


def append_master(incoming: DataFrame, master: DataFrame, at: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """New master rows, and the rows refused for their record type."""
    checked = incoming.withColumn(
        "motivo",
        _reason((~F.coalesce(F.col("tipo_registro").isin(*catalogs.RECORD_TYPES), F.lit(False)), "tipo_registro inválido")),
    )
    valid = checked.where(F.col("motivo").isNull())
    rejects = checked.where(F.col("motivo").isNotNull()).select("row_idx", "motivo")
    return _as_table(master_rows(valid, master, at), master), rejects


def _append(
    kind: str, suffix: str, area: str, incoming: DataFrame, cells: dict[str, Column],
    master: DataFrame, child: DataFrame, at: dt.datetime | None,
) -> Appended:
    position = f"puesto_{suffix}"
    checked = incoming.withColumn(
        "motivo", _reason((text.blank_to_null(F.col(position)).isNull(), f"{position} es obligatorio"))
    )
    valid = checked.where(F.col("motivo").isNull()).withColumns(cells)
    new_master = master_rows(
        valid.select(
            "row_idx",
            F.lit(kind).alias("tipo_registro"),
            F.col(position).alias("puesto"),
            F.col(f"empresa_{suffix}").alias("empresa"),
            F.col(f"plaza_{suffix}").alias("plaza"),
            F.col(area).alias("area"),
        ),
        master,
        at,
    )
    linked = valid.withColumns(
        {
            "id": changes.next_id_base(child) + 1 + F.col("row_idx"),
            "id_registro": changes.next_id_base(master) + 1 + F.col("row_idx"),
        }
    )
    rejects = checked.where(F.col("motivo").isNotNull()).select("row_idx", "motivo")
    return Appended(_as_table(new_master, master), _as_table(linked, child), rejects)


def append_hires(
    incoming: DataFrame, master: DataFrame, hires: DataFrame, at: dt.datetime | None = None
) -> Appended:
    """Hires with their master rows; a position is required."""
    cells = {
        "puesto_alta": text.strip_upper(F.col("puesto_alta")),
        "contratados_alta": F.col("contratados_alta").cast("string"),
    }
    return _append("Alta", "alta", "area_alta", incoming, cells, master, hires, at)


def append_leavers(
    incoming: DataFrame, master: DataFrame, leavers: DataFrame, at: dt.datetime | None = None
) -> Appended:
    """Leavers with their master rows; position and reason lose their accents."""
    cells = {
        "puesto_baja": text.fold_accents(text.strip(F.col("puesto_baja"))),
        "motivo_baja": text.fold_accents(text.strip(F.col("motivo_baja"))),
    }
    return _append("Baja", "baja", "area_baja", incoming, cells, master, leavers, at)


def append_vacancies(
    incoming: DataFrame, master: DataFrame, vacancies: DataFrame, at: dt.datetime | None = None
) -> Appended:
    """Vacancies as the form enters them.

    A row without authorisation date gets the not-authorised marker.  A filled one (``vacantes_contratados``
    above 0) has its openings reduced, without a floor; any other has no fill date and unspecified type and
    channel.
    """
    hired = coerce.lenient_int(F.col("vacantes_contratados"))
    filled = hired > 0

    def of_filled(c: Column) -> Column:
        return F.coalesce(F.when(filled, text.strip_upper(c)), F.lit(catalogs.UNSPECIFIED))

    cells = {
        "puesto_vacante": text.strip_upper(F.col("puesto_vacante")),
        "funcion_area_vacante": F.upper("funcion_area_vacante"),
        "fecha_autorizacion": F.coalesce(F.col("fecha_autorizacion"), measures.not_authorised_date()),
        "fecha_cobertura": F.when(filled, F.col("fecha_cobertura")),
        "vacantes_solicitadas": measures.remaining_openings(F.col("vacantes_solicitadas"), hired, floor=False),
        "vacantes_contratados": hired.cast("string"),
        "comentarios_vacante": F.nullif(text.strip_upper(F.col("comentarios_vacante")), F.lit("")),
        "tipo_reclutamiento_vacante": of_filled(F.col("tipo_reclutamiento_vacante")),
        "medio_reclutamiento_vacante": of_filled(F.col("medio_reclutamiento_vacante")),
    }
    return _append("Vacante", "vacante", "funcion_area_vacante", incoming, cells, master, vacancies, at)


def edit_vacancies(vacancies: DataFrame, edits: DataFrame) -> DataFrame:
    """Vacancies after a batch of edits: a row of ``edits`` per id, with any of the stored columns.

    Stage and comments are folded to plain capitals, the position loses its outer blanks.
    """
    return _overlaid(vacancies, vacancy_edits(edits))


def vacancy_edits(edits: DataFrame) -> DataFrame:
    """Edits of vacancies as they are stored."""
    rules = {
        "fase_proceso": text.fold_accents(F.col("fase_proceso")),
        "comentarios_vacante": text.fold_accents(F.col("comentarios_vacante")),
        "puesto_vacante": text.strip(F.col("puesto_vacante")),
    }
    return _ruled(edits, rules)


def edit_leavers(leavers: DataFrame, edits: DataFrame) -> DataFrame:
    """Leavers after a batch of edits: texts lose their outer blanks, the reason is folded to plain capitals."""
    rules = {
        **{c: text.strip(F.col(c)) for c in ("empresa_baja", "puesto_baja", "plaza_baja", "tipo_baja")},
        "motivo_baja": text.fold_accents(text.strip(F.col("motivo_baja"))),
    }
    return _overlaid(leavers, _ruled(edits, rules))


def update_vacancies(vacancies: DataFrame, rows: DataFrame) -> DataFrame:
    """Vacancies with whole rows overwritten by id; the confidential mark stays.

    ``rows`` holds each id once.  A column it lacks becomes NULL (the two counts 0, but a NULL count that is given stays NULL); a
    row without position is left out, as it would be refused.
    """
    given = {c: F.col(c) if c in rows.columns else F.lit(None) for c in (*VACANCY_COLUMNS, "id_registro")}

    def capitals(name: str) -> Column:
        return F.nullif(text.strip_upper(given[name].cast("string")), F.lit(""))

    cells = {
        **given,
        "puesto_vacante": capitals("puesto_vacante"),
        "funcion_area_vacante": F.nullif(F.upper(given["funcion_area_vacante"].cast("string")), F.lit("")),
        "comentarios_vacante": text.fold_accents(capitals("comentarios_vacante")),
        "tipo_reclutamiento_vacante": capitals("tipo_reclutamiento_vacante"),
        "medio_reclutamiento_vacante": capitals("medio_reclutamiento_vacante"),
        **{c: F.lit(0) for c in ("vacantes_solicitadas", "vacantes_contratados") if c not in rows.columns},
    }
    payload = rows.select("id", *[c.alias(name) for name, c in cells.items()])
    return changes.overlay(vacancies, payload.where(F.col("puesto_vacante").isNotNull()), "id", list(cells))


def update_master(master: DataFrame, rows: DataFrame) -> DataFrame:
    """Master rows overwritten by id: position in capitals, all texts without outer blanks."""
    cells = {c: text.strip(F.col(c)) for c in MASTER_COLUMNS}
    cells["puesto"] = F.upper(cells["puesto"])
    return changes.overlay(master, rows.withColumns(cells), "id", MASTER_COLUMNS)


def _ruled(edits: DataFrame, rules: dict[str, Column]) -> DataFrame:
    cells = {name: rule for name, rule in rules.items() if name in edits.columns}
    return edits.withColumns(cells) if cells else edits


def _overlaid(table: DataFrame, edits: DataFrame) -> DataFrame:
    return changes.overlay(table, edits, "id", [c for c in edits.columns if c != "id"])


WHOLE_COLUMNS = ("id_sistema", "vacantes_solicitadas", "vacantes_contratados")
DATE_COLUMNS = ("fecha_solicitud", "fecha_avance", "fecha_autorizacion", "fecha_cobertura")


def cleanse(staged: DataFrame) -> DataFrame:
    """Typed import rows: ``row_idx``, the vacancy columns, the area as written, and ``motivo`` if refused.

    Two projections, so that no expression is worked out twice: cells trimmed or read as whole numbers or dates, then the
    rules and the reason of refusal.
    """
    raw = {
        stored: F.col(f"`{header}`") if header in staged.columns else F.lit(None).cast("string")
        for stored, header in catalogs.IMPORT_COLUMNS.items()
    }
    read = {
        name: coerce.import_int(cell) if name in WHOLE_COLUMNS else text.strip(cell)
        for name, cell in raw.items() if name not in DATE_COLUMNS
    }
    dates = coerce.import_dates([text.strip(raw[name]) for name in DATE_COLUMNS])
    written = {f"_{name}": raw[name] for name in WHOLE_COLUMNS}
    once = staged.select("row_idx", *[c.alias(name) for name, c in {**read, **written, "_fechas": dates}.items()])
    date = {name: F.col("_fechas")[k] for k, name in enumerate(DATE_COLUMNS)}

    def bad_number(name: str) -> Column:
        return F.col(name).isNull() & F.coalesce(F.col(f"_{name}").rlike(text.LETTER), F.lit(False))

    motive = _reason(
        (bad_number("id_sistema"), "ID no es un número"),
        (bad_number("vacantes_solicitadas"), "vacantes solicitadas no es un número"),
        (bad_number("vacantes_contratados"), "vacantes contratados no es un número"),
        (~F.coalesce(F.col("puesto_vacante") != "", F.lit(False)), "puesto_vacante es obligatorio"),
    )

    def capitals(name: str) -> Column:
        return F.when(F.col(name) != "", F.upper(name))

    def or_unspecified(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name)).otherwise(F.lit(catalogs.UNSPECIFIED))

    hired = F.col("vacantes_contratados")
    rules = {
        "tipo_solicitud": capitals("tipo_solicitud"),
        "estatus_solicitud": capitals("estatus_solicitud"),
        "fase_proceso": capitals("fase_proceso"),
        "fecha_autorizacion": coerce.plausible_date(date["fecha_autorizacion"]),
        "fecha_cobertura": measures.fill_date_if_hired(F.upper("fase_proceso"), date["fecha_cobertura"]),
        "puesto_vacante": capitals("puesto_vacante"),
        "funcion_area_vacante": capitals("funcion_area_vacante"),
        "vacantes_solicitadas": measures.remaining_openings(F.col("vacantes_solicitadas"), hired),
        "vacantes_contratados": F.coalesce(hired, F.lit(0).cast("bigint")),
        "responsable_vacante": or_unspecified("responsable_vacante"),
        "comentarios_vacante": capitals("comentarios_vacante"),
        "tipo_reclutamiento_vacante": F.upper(or_unspecified("tipo_reclutamiento_vacante")),
        "medio_reclutamiento_vacante": F.upper(or_unspecified("medio_reclutamiento_vacante")),
    }
    rules = {**date, **rules}
    return once.select(
        "row_idx",
        *[rules.get(name, F.col(name)).alias(name) for name in VACANCY_COLUMNS],
        F.col("funcion_area_vacante").alias("area"),
        motive.alias("motivo"),
    )


def _has_key() -> Column:
    return F.col("id_sistema").isNotNull() & (F.col("id_sistema") != 0)


def match_import(rows: DataFrame, vacancies: DataFrame) -> DataFrame:
    """One row per imported vacancy: its first and last valid row, how many rows it had, and the stored match.

    Per key three whole numbers are aggregated, which combine before the shuffle; the last row of a key is fetched by its key and
    number, so that rows of a hot key are spread.  Rows without a key (missing or 0) stand for themselves: they go round the aggregate and the join, and
    are not shuffled.  Of stored duplicates the one with the smallest id matches.
    """
    valid = rows.where(F.col("motivo").isNull())
    keyed = F.coalesce(_has_key(), F.lit(False))
    number = F.col("row_idx")
    per_key = valid.where(keyed).groupBy("id_sistema").agg(
        F.min(number).alias("primera"), F.max(number).alias("ultima"), F.count("*").alias("filas")
    )
    stored = vacancies.where(_has_key()).select("id", "id_registro", "id_sistema")
    smallest = stored.groupBy("id_sistema").agg(F.min("id").alias("id_vacante"))
    linked = per_key.join(smallest, "id_sistema", "left").withColumnRenamed("id_sistema", "_clave")
    masters = stored.select(F.col("id").alias("id_vacante"), F.col("id_registro").alias("id_maestra"))
    found = linked.join(masters, "id_vacante", "left").select("_clave", "ultima", "primera", "filas", "id_vacante", "id_maestra")
    wide = valid.select("row_idx", *VACANCY_COLUMNS, "area")
    last = [F.col("id_sistema") == F.col("_clave"), number == F.col("ultima")]
    winners = wide.where(keyed).join(found, last).drop("_clave", "row_idx")
    alone = wide.where(~keyed).withColumns(
        {
            "ultima": number, "primera": number, "filas": F.lit(1).cast("bigint"),
            "id_vacante": F.lit(None).cast("bigint"), "id_maestra": F.lit(None).cast("bigint"),
        }
    )
    return winners.unionByName(alone.drop("row_idx"))


def _master_cells(matched: DataFrame) -> DataFrame:
    return matched.withColumns(
        {"puesto": F.col("puesto_vacante"), "empresa": F.col("empresa_vacante"), "plaza": F.col("plaza_vacante")}
    )


def vacancy_changes(matched: DataFrame, vacancies: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updates of stored vacancies by id, and new vacancies.

    A new vacancy seen once keeps the accents of its comment; an update, also of a row that is new in the same
    file, folds them.
    """
    folded = text.fold_accents(F.col("comentarios_vacante"))
    updates = matched.where(F.col("id_vacante").isNotNull()).withColumn("comentarios_vacante", folded)
    inserts = matched.where(F.col("id_vacante").isNull()).withColumns(
        {
            "comentarios_vacante": F.when(F.col("filas") > 1, folded).otherwise(F.col("comentarios_vacante")),
            "id": changes.next_id_base(vacancies) + 1 + F.col("primera"),
            "id_registro": changes.next_id_base(master) + 1 + F.col("primera"),
        }
    )
    return updates.withColumn("id", F.col("id_vacante")), _as_table(inserts, vacancies)


def vacancies_after(matched: DataFrame, vacancies: DataFrame, master: DataFrame) -> DataFrame:
    """Stored vacancies with updates laid over them, and the new ones."""
    updates, inserts = vacancy_changes(matched, vacancies, master)
    return changes.overlay(vacancies, updates, "id", VACANCY_COLUMNS).unionByName(inserts)


def master_changes(matched: DataFrame, master: DataFrame, at: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Updates of stored master rows by id, and new master rows."""
    cells = _master_cells(matched)
    updates = changes.last_per_key(
        cells.where(F.col("id_vacante").isNotNull()).select(
            F.col("id_maestra").alias("id"), "ultima", *MASTER_COLUMNS
        ),
        ["id"],
        "ultima",
    )
    new = cells.where(F.col("id_vacante").isNull()).select(
        F.col("primera").alias("row_idx"), F.lit("Vacante").alias("tipo_registro"), *MASTER_COLUMNS
    )
    return updates, _as_table(master_rows(new, master, at), master)


def master_after(matched: DataFrame, master: DataFrame, at: dt.datetime | None = None) -> DataFrame:
    """Stored master rows with the matched ones overwritten, and the new ones."""
    updates, new = master_changes(matched, master, at)
    return changes.overlay(master, updates, "id", MASTER_COLUMNS).unionByName(new)


ERRORS_SHOWN = 10


def import_report(rows: DataFrame, matched: DataFrame, shown: int = ERRORS_SHOWN) -> DataFrame:
    """New, updated, failed and processed rows, and how many errors there are beyond those shown.

    k rows of a new key are 1 new and k - 1 updates.
    """
    is_new = F.col("id_vacante").isNull()
    done = matched.agg(
        F.count_if(is_new).alias("nuevos"),
        F.coalesce(F.sum(F.col("filas") - is_new.cast("bigint")), F.lit(0)).alias("actualizados"),
    )
    failed = rows.agg(F.count_if(F.col("motivo").isNotNull()).alias("fallidos"))
    return series.one_row(done, failed).withColumns(
        {
            "procesados": F.col("nuevos") + F.col("actualizados"),
            "errores_no_mostrados": F.greatest(F.col("fallidos") - shown, F.lit(0)).cast("bigint"),
        }
    )


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("motivo").isNotNull()).select("row_idx", "motivo")


def first_errors(rejects: DataFrame, shown: int = ERRORS_SHOWN) -> DataFrame:
    """The first refused rows in file order, rows counted from 1."""
    top = rejects.orderBy("row_idx").limit(shown)
    number = (F.col("row_idx") + 1).cast("string")
    return top.select("row_idx", F.concat(F.lit("Error en fila "), number, F.lit(": "), F.col("motivo")).alias("error"))


def plan_rows(rows: DataFrame, vacancies: DataFrame, master: DataFrame, at: dt.datetime | None = None) -> Imported:
    """The whole import of cleansed rows, which should be written or checkpointed before, as they are read several times.

    They are matched once, into the checkpoint folder; both tables and the report follow from that.
    """
    matched = cut_lineage(match_import(rows, vacancies))
    return Imported(
        vacancies_after(matched, vacancies, master),
        master_after(matched, master, at),
        import_report(rows, matched),
        rejected(rows),
    )


def plan_import(staged: DataFrame, vacancies: DataFrame, master: DataFrame, at: dt.datetime | None = None) -> Imported:
    """The import of staged rows: cleansed once into the checkpoint folder, then :func:`plan_rows`."""
    return plan_rows(cut_lineage(cleanse(staged)), vacancies, master, at)


def commit_import(store: Store, staged: DataFrame, at: dt.datetime | None = None) -> DataFrame:
    """Imports staged rows into ``vacantes`` and ``registros_rh`` of a store as one new version; returns the report.

    Only the buckets of updated rows are written anew, new rows go to new files; refused rows replace the store's ``rechazos``.  If the store holds daily
    totals (``diario``), they are moved on by what the import's rows add, less what the rows that they replace had added.  Readers see all of it
    or nothing: a job that fails half way leaves the store as it was, and what it wrote goes with the store's next clean-up.
    """
    change = store.begin()
    vacancies, master = change.read("vacantes"), change.read("registros_rh")
    rows = cut_lineage(cleanse(staged))
    matched = cut_lineage(match_import(rows, vacancies))
    updates, inserts = vacancy_changes(matched, vacancies, master)
    master_updates, master_inserts = master_changes(matched, master, at)
    change.patch("vacantes", updates, VACANCY_COLUMNS)
    change.add("vacantes", inserts)
    change.patch("registros_rh", master_updates, MASTER_COLUMNS)
    change.add("registros_rh", master_inserts)
    change.put("rechazos", rejected(rows))
    if "diario" in change.tables:
        before = vacancies.join(updates.select("id"), "id", "left_semi")
        after = changes.overlay(before, updates, "id", VACANCY_COLUMNS).unionByName(inserts)
        change.add("diario", daily.difference(daily.of_vacancies(after), daily.of_vacancies(before)))
    change.commit()
    return import_report(rows, matched)


def run_import(
    staged: DataFrame, vacancies: DataFrame, master: DataFrame, path: str, at: dt.datetime | None = None
) -> DataFrame:
    """Writes both tables after the import and the refused rows below ``path``, a new folder; returns the report.

    The stored tables are only read, so a failed job leaves nothing half applied; :func:`commit_import` also takes care of the swap.
    """
    planned = plan_import(staged, vacancies, master, at)
    write_table(planned.vacancies, f"{path}/vacantes")
    write_table(planned.master, f"{path}/registros_rh")
    write_table(planned.rejects, f"{path}/rechazos")
    return planned.report
