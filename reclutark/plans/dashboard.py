"""The dashboard in one reading of each table: every breakdown is a grouping set of the same aggregate."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reclutark import catalogs
from reclutark.functions import calendar, measures, predicates, text
from reclutark.functions.coerce import int_or_zero, lenient_int
from reclutark.plans import hires as _hires, vacancies as _vacancies

TOTALS = "totales"


def _block(keys: Mapping[str, Sequence[str]], all_keys: Sequence[str]) -> Column:
    """Name of the breakdown that a row of the grouping sets belongs to; rows of missing keys belong to none."""
    name = F.lit(None).cast("string")
    for block, used in keys.items():
        of_set = F.lit(True)
        for k in all_keys:
            of_set = of_set & ((F.grouping(k) == 0) & F.col(k).isNotNull() if k in used else F.grouping(k) == 1)
        name = F.when(of_set, F.lit(block)).otherwise(name)
    return name


def _sets(rows: DataFrame, blocks: Mapping[str, Sequence[str]], all_keys: Sequence[str], *values: Column) -> DataFrame:
    sets = [[F.col(k) for k in keys] for keys in blocks.values()]
    # Without rows there would be no totals, so a row of nothing takes part.
    nothing = rows.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    return rows.unionByName(nothing).groupingSets(sets, *all_keys).agg(_block(blocks, all_keys).alias("bloque"), *values).where(F.col("bloque").isNotNull())


def _long(cube: DataFrame, keys: Mapping[str, Column], details: Mapping[str, Column], cells: Mapping[str, tuple[Column, Column]], totals: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """``bloque, clave, detalle, cantidad, promedio``: a row per group, and a row per figure of the totals."""
    none = F.lit(None)

    def cell(key: Column, detail: Column, amount: Column, mean: Column) -> Column:
        return F.struct(
            key.cast("string").alias("clave"), detail.cast("string").alias("detalle"), amount.cast("bigint").alias("cantidad"), mean.cast("double").alias("promedio")
        )

    shown = F.array(*[cell(F.lit(name), none, *figures) for name, figures in totals.items()])
    of_block = F.when(F.col("bloque") == TOTALS, shown)
    for block, (amount, mean) in cells.items():
        of_block = of_block.when(F.col("bloque") == block, F.array(cell(keys[block], details.get(block, none), amount, mean)))
    return cube.select("bloque", F.inline(of_block)).where(F.col("cantidad").isNotNull() | F.col("promedio").isNotNull())


def hires_blocks(hires: DataFrame, names: Mapping[str, str] = catalogs.COMPANY_SHORT_NAMES, aliases: Mapping[str, str] = catalogs.CHART_ALIASES) -> DataFrame:
    """Hires by channel and company with their shares, by recruiter and area, by month, and the four totals of paid media."""
    rows = _hires.positive(hires).select(
        F.col(_hires.COUNT).alias("n"),
        F.col("medio_reclutamiento_alta").alias("canal"),
        text.short_company(F.col("empresa_alta"), names).alias("empresa"),
        text.first_word_alias(F.col("responsable_alta"), aliases).alias("ejecutivo"),
        F.col("area_alta").alias("area"),
        calendar.month(F.col("fecha_alta")).alias("mes"),
    )
    paid, operative = F.col("canal") == catalogs.PAID_MEDIA, F.col("area") == "OPERATIVA"

    def total(name: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(name)

    blocks = {"canal": ["canal"], "empresa": ["empresa"], "ejecutivo": ["ejecutivo", "area"], "mes": ["mes"], TOTALS: []}
    # The keys of a grouping set are NULL in the others, so the conditions are columns of their own.
    marked = rows.withColumns({"pagada": paid, "operativa": operative})
    cube = _sets(
        marked, blocks, ["canal", "empresa", "ejecutivo", "area", "mes"], F.sum("n").alias("n"),
        total("pagadas", F.col("pagada")), total("operativas", F.col("operativa")), total("operativas_pagadas", F.col("operativa") & F.col("pagada")),
    )
    none, n = F.lit(None), F.col("n")
    figures = {
        "contratados_totales": (F.coalesce(n, F.lit(0)), none), "contratados_redes_pagadas": (F.col("pagadas"), none),
        "contratados_operativas": (F.col("operativas"), none), "contratados_operativas_redes_pagadas": (F.col("operativas_pagadas"), none),
    }
    long = _long(cube, {b: F.col(b) for b in blocks if b != TOTALS}, {"ejecutivo": F.col("area")}, {b: (n, none) for b in blocks if b != TOTALS}, figures)
    # One row per channel or company here, whatever the number of hires.
    whole = F.sum("cantidad").over(Window.partitionBy("bloque"))
    return long.withColumn("porcentaje", F.when(F.col("bloque").isin("canal", "empresa"), measures.share_pct(F.col("cantidad"), whole)))


def vacancies_blocks(
    vacancies: DataFrame, as_of: dt.date | None = None, names: Mapping[str, str] = catalogs.COMPANY_SHORT_NAMES, tz_exact: bool = False
) -> DataFrame:
    """Open authorised openings by company and area, the stage funnel, mean days of hired ones by site and position, and the totals."""
    is_open, authorised = predicates.is_open(), predicates.has_authorised_openings()
    rows = _vacancies.with_days(vacancies, as_of, tz_exact).select(
        text.short_company(F.col("empresa_vacante"), names).alias("empresa"),
        F.col("funcion_area_vacante").alias("area"),
        F.col("fase_proceso").alias("fase"),
        F.col("plaza_vacante").alias("plaza"),
        F.col("puesto_vacante").alias("puesto"),
        F.when(is_open & authorised, int_or_zero(F.col(_vacancies.OPENINGS))).alias("abiertas"),
        F.when(is_open & F.col("fecha_autorizacion").isNotNull(), int_or_zero(F.col(_vacancies.OPENINGS))).alias("vacantes"),
        F.when(is_open & predicates.in_funnel(), F.lit(1)).alias("embudo"),
        F.when(lenient_int(F.col("vacantes_contratados")) > 0, F.col("dias")).alias("dias"),
    )
    blocks = {"vacantes_empresa": ["empresa"], "vacantes_area": ["area"], "embudo": ["fase"], "dias_plaza": ["plaza"], "dias_puesto": ["puesto"], TOTALS: []}
    keys = {block: F.col(of[0]) for block, of in blocks.items() if of}
    cube = _sets(
        rows, blocks, ["empresa", "area", "fase", "plaza", "puesto"],
        *[F.sum(c).alias(c) for c in ("abiertas", "vacantes", "embudo")], F.avg("dias").alias("dias"),
    )
    none, opened = F.lit(None), (F.col("abiertas"), F.lit(None))
    cells = {"vacantes_empresa": opened, "vacantes_area": opened, "embudo": (F.col("embudo"), none), "dias_plaza": (none, F.col("dias")), "dias_puesto": (none, F.col("dias"))}
    figures = {"vacantes": (F.coalesce("vacantes", F.lit(0)), none), "dias_promedio": (none, F.col("dias"))}
    return _long(cube, keys, {}, cells, figures).withColumn("porcentaje", F.lit(None).cast("double"))


def blocks(hires: DataFrame, vacancies: DataFrame, as_of: dt.date | None = None, names: Mapping[str, str] = catalogs.COMPANY_SHORT_NAMES) -> DataFrame:
    """All figures of the dashboard (tabla, bloque, clave, detalle, cantidad, promedio, porcentaje), from one reading of each table.

    Figures that would be missing (a group without open vacancies, say) have no row.
    """
    of_hires = hires_blocks(hires, names).withColumn("tabla", F.lit("altas"))
    of_vacancies = vacancies_blocks(vacancies, as_of, names).withColumn("tabla", F.lit("vacantes"))
    order = ["tabla", "bloque", "clave", "detalle", "cantidad", "promedio", "porcentaje"]
    return of_hires.select(*order).unionByName(of_vacancies.select(*order))
