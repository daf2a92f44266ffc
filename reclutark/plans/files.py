"""Personnel files: completeness figures and the collaborator by document matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reclutark.functions.predicates import is_true

COMPLETE, INCOMPLETE = "COMPLETO", "INCOMPLETO"


def required_documents(catalog: DataFrame) -> DataFrame:
    """Ids and names of the required documents, each id once."""
    return catalog.where(is_true(F.col("requerido"))).groupBy("id").agg(F.min("nombre_documento").alias("nombre_documento"))


def active_people(people: DataFrame) -> DataFrame:
    return people.where(is_true(F.col("activo")))


def numbered_documents(catalog: DataFrame) -> DataFrame:
    """Required documents (id, nombre_documento) with their number from 0, in the order of their ids; as short as the catalog."""
    listed = required_documents(catalog).agg(F.sort_array(F.collect_list(F.struct("id", "nombre_documento"))).alias("_d"))
    return listed.select(F.posexplode("_d").alias("numero", "_d")).select("numero", "_d.*")


WORD = 64


def delivered_bits(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Required documents that were delivered, as bits: a row per person and ``palabra`` of 64 documents, by their number.

    Bits are put together before the shuffle, and a document given twice sets the same bit; so however many file rows a person has, each map
    task sends one number, and no distinct pairs are needed.
    """
    given = files.where(is_true(F.col("estatus_pdf"))).select("id_colaborador", "id_documento")
    return given.join(_bit_of_document(catalog), "id_documento").groupBy("id_colaborador", "palabra").agg(F.bit_or("bit").alias("bits"))


def _bit_of_document(catalog: DataFrame) -> DataFrame:
    word = F.floor(F.col("numero") / WORD).cast("int").alias("palabra")
    return numbered_documents(catalog).select(F.col("id").alias("id_documento"), word, F.expr(f"shiftleft(1L, numero % {WORD})").alias("bit"))


def delivered(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct (person, required document) pairs that were delivered."""
    held = delivered_bits(files, catalog).join(_bit_of_document(catalog), "palabra")
    return held.where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("id_colaborador", "id_documento")


def delivered_counts(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Required documents delivered per person, exact."""
    counted = F.sum(F.bit_count("bits")).cast("bigint").alias("documentos")
    return delivered_bits(files, catalog).groupBy("id_colaborador").agg(counted)


def complete_people(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """People with every required document delivered; nobody if none is required."""
    wanted = required_documents(catalog).agg(F.count("*").alias("n")).scalar()
    return delivered_counts(files, catalog).where(F.col("documentos") >= wanted).select("id_colaborador")


def completeness(people: DataFrame, catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Active people, complete and missing files, and the complete share; 0 complete if nothing is required."""
    marked = complete_people(catalog, files).withColumn("_completo", F.lit(True))
    totals = active_people(people).join(marked, "id_colaborador", "left").agg(
        F.count("*").alias("expedientes_totales"), F.count("_completo").alias("expedientes_completos")
    )
    total, complete = F.col("expedientes_totales"), F.col("expedientes_completos")
    return totals.withColumns(
        {
            "expedientes_faltantes": total - complete,
            "completos_pct": F.when(total > 0, complete / total * 100).otherwise(F.lit(0.0)),
        }
    )


PERSON = ("empresa", "plaza", "departamento", "puesto")


def _with_documents(people: DataFrame, catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Active people with the required documents, those they have delivered, and the status of the file.

    Both lists are bounded by the catalog; no person is paired with a document by a join.
    """
    required = required_documents(catalog).agg(
        F.sort_array(F.collect_list(F.struct("id", "nombre_documento"))).alias("documentos")).scalar()
    has = delivered_bits(files, catalog).groupBy("id_colaborador").agg(
        F.map_from_entries(F.collect_list(F.struct("palabra", "bits"))).alias("_tiene"), F.sum(F.bit_count("bits")).alias("_entregados")
    )
    rows = active_people(people).join(has, "id_colaborador", "left").withColumn("_documentos", required)
    wanted = F.size("_documentos")
    complete = (wanted > 0) & (F.coalesce("_entregados", F.lit(0)) >= wanted)
    return rows.withColumn("estatus", F.when(complete, F.lit(COMPLETE)).otherwise(F.lit(INCOMPLETE)))


def _has(number: Column) -> Column:
    """Whether a person has the document of a number; a missing number stands for a document that isn't required."""
    bits = F.try_element_at("_tiene", F.floor(number / WORD).cast("int"))
    return F.coalesce(F.getbit(bits, (number % WORD).cast("int")) == 1, F.lit(False))


def matrix_long(people: DataFrame, catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Active people by required document, a row for each, with the status of the file; for catalogs of any length."""
    rows = _with_documents(people, catalog, files).select("*", F.posexplode("_documentos").alias("_numero", "_doc"))
    return rows.select(
        "id_colaborador", F.col("nombre_completo").alias("colaborador"), *PERSON, "estatus",
        F.col("_doc.id").alias("id_documento"), F.col("_doc.nombre_documento").alias("documento"), _has(F.col("_numero")).alias("entregado"),
    )


def matrix(people: DataFrame, catalog: DataFrame, files: DataFrame, documents: Sequence[tuple[int, str]]) -> DataFrame:
    """The matrix as a table with a column for each of the ``documents`` (id, name) that the caller shows, ordered by name.

    The status still counts all required documents.  A name used twice gets its id as suffix.
    """
    names = [name for _, name in documents]
    labels = [name if names.count(name) == 1 else f"{name} ({doc})" for doc, name in documents]
    rows = _with_documents(people, catalog, files).withColumn("_ids", F.col("_documentos.id"))

    def number(doc: int) -> Column:
        place = F.array_position("_ids", F.lit(doc).cast("bigint"))
        return F.when(place > 0, (place - 1).cast("int"))

    return rows.orderBy("nombre_completo", "id_colaborador").select(
        F.col("nombre_completo").alias("colaborador"), *PERSON, "estatus",
        *[_has(number(doc)).alias(label) for (doc, _), label in zip(documents, labels)],
    )


def incomplete_people(people: DataFrame, catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Active people whose file is not complete, by an anti join on the complete ones."""
    return active_people(people).join(complete_people(catalog, files), "id_colaborador", "left_anti").select(
        "id_colaborador", "nombre_completo"
    )
