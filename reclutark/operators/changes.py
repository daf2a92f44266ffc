"""Change sets over stored tables: overlay by id, dense row numbers, new ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def last_per_key(changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by a unique order column.

    An aggregate of the order column alone, which combines before the shuffle, finds the rows; so a key with very many rows
    costs one row per map task, and no wide row is sorted.
    """
    newest = changes.groupBy(*keys).agg(F.max(order).alias(order))
    return changes.join(newest, [*keys, order], "left_semi").select(*changes.columns)


def overlay(target: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Target with the listed columns overwritten (NULL included) where ``changes`` has its key.

    ``changes`` holds each key once.  Columns that are not listed stay as they are.
    """
    marked = changes.select(
        F.col(key).alias("_clave"), F.struct(*[F.col(c) for c in columns]).alias("_cambio")
    )
    joined = target.join(marked, F.col(key) == F.col("_clave"), "left")

    def value(name: str) -> Column:
        if name not in columns:
            return F.col(name)
        kind = target.schema[name].dataType
        return F.when(F.col("_clave").isNotNull(), F.col(f"_cambio.`{name}`").cast(kind)).otherwise(
            F.col(name)
        ).alias(name)

    return joined.select(*[value(c) for c in target.columns])


def next_id_base(table: DataFrame, key: str = "id") -> Column:
    """Largest id in use, 0 for an empty table, as a scalar subquery."""
    return table.agg(F.coalesce(F.max(key), F.lit(0).cast("bigint")).alias(key)).scalar()


def dense_index(df: DataFrame, blocks: Sequence[str], position: str, name: str, in_file: str | None = None) -> DataFrame:
    """Row number 0.. over all blocks in order, from each row's rising position inside its block; also the number in its file, if named.

    ``position`` must rise by one from row to row of a block.  Counts are put in order per file and then per block of a file; the
    one step in a single task sees a row per file.  The rows themselves are neither sorted nor gathered.
    """
    file, rest = blocks[0], list(blocks[1:])
    per_block = df.groupBy(*blocks).agg(F.count("*").alias("_n"), F.min(position).alias("_primera"))
    earlier = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    files = per_block.groupBy(file).agg(F.sum("_n").alias("_de_archivo")).select(
        file, F.coalesce(F.sum("_de_archivo").over(earlier), F.lit(0)).alias("_archivos_antes")
    )
    inside = Window.partitionBy(file).orderBy(*(rest or [file])).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.withColumn("_bloques_antes", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(files, file).select(
        *blocks, "_primera", "_archivos_antes", "_bloques_antes"
    )
    place = F.col("_bloques_antes") + F.col(position) - F.col("_primera")
    numbers = {name: F.col("_archivos_antes") + place, **({in_file: place} if in_file else {})}
    return df.join(offsets, list(blocks)).withColumns(numbers).drop("_archivos_antes", "_bloques_antes", "_primera")
