"""Pivots with totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def totals_cube(
    df: DataFrame, rows: Sequence[str], columns: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Cells, row totals, column totals and the grand total, named in ``nivel``.

    The cells are aggregated first; only they are expanded to the four grouping sets, so the raw rows are
    hashed once.  A missing key is a group of its own and never mixes with a total.
    """
    keys = [*rows, *columns]
    cells = df.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    sets = [
        [F.col(k) for k in keys],
        [F.col(k) for k in rows],
        [F.col(k) for k in columns],
        [],
    ]
    level = (
        F.when((F.grouping(rows[0]) == 0) & (F.grouping(columns[0]) == 0), F.lit("celda"))
        .when(F.grouping(rows[0]) == 0, F.lit("total_fila"))
        .when(F.grouping(columns[0]) == 0, F.lit("total_columna"))
        .otherwise(F.lit("total_general"))
    )
    return cells.groupingSets(sets, *keys).agg(
        *[F.sum(name).alias(name) for name in sums], level.alias("nivel")
    )


def totals_rollup(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """Groups by all keys, subtotals along the key order and the grand total; ``nivel`` counts the keys kept.

    Means are taken from the rows of each level, never from means of means.
    """
    depth = sum((1 - F.grouping(k).cast("int") for k in keys), F.lit(0))
    return df.rollup(*keys).agg(*[c.alias(name) for name, c in aggregates.items()], depth.alias("nivel"))


def wide_totals(cells: DataFrame, row: str, columns: Sequence[tuple], column_names: Sequence[str], value: str,
                total: str = "TOTAL") -> DataFrame:
    """Wide table from :func:`totals_cube`: one column per given key tuple, a total column and a total row."""

    def name_of(key: tuple) -> str:
        return " / ".join(str(part) for part in key)

    def matches(key: tuple) -> Column:
        condition = F.col("nivel").isin("celda", "total_columna")
        for column_name, part in zip(column_names, key):
            condition = condition & F.col(column_name).eqNullSafe(part)
        return condition

    label = F.when(F.col("nivel").isin("total_columna", "total_general"), F.lit(total)).otherwise(
        F.col(row).cast("string")
    )
    picked = [
        F.coalesce(F.sum(F.when(matches(key), F.col(value))), F.lit(0)).alias(name_of(key)) for key in columns
    ]
    all_columns = F.sum(F.when(F.col("nivel").isin("total_fila", "total_general"), F.col(value)))
    return cells.groupBy(label.alias(row)).agg(*picked, all_columns.alias(total))
