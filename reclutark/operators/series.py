"""Zero-filled series, year-over-year, shares, the same window in several years."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reclutark.functions.measures import change_pct, share_pct


def values_frame(spark: SparkSession, name: str, values: Iterable[int | str]) -> DataFrame:
    """One column of given values, in the plan itself."""
    literals = F.array(*[F.lit(v) for v in values])
    return spark.range(1).select(F.explode(literals).alias(name))


def zero_filled_sum(rows: DataFrame, spine: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum per key for every key of the spine, 0 where it has no rows.

    The spine joins in as rows of value 0 before the aggregation, so one shuffle does both and no join is
    needed.  ``rows`` must hold only keys of the spine.
    """
    zeros = spine.select(*keys, F.lit(0).cast("bigint").alias(value))
    return rows.select(*keys, F.col(value).cast("bigint").alias(value)).unionByName(zeros).groupBy(*keys).agg(
        F.sum(value).alias(value)
    )


def sum_by_category(
    df: DataFrame, keys: Sequence[str], category: Column, categories: Sequence[int | str], value: Column
) -> DataFrame:
    """One row per key and one summed column per listed category (0 if none): one pass, one shuffle."""
    sums = [
        F.coalesce(F.sum(F.when(category == c, value)), F.lit(0).cast("bigint")).alias(str(c)) for c in categories
    ]
    return df.groupBy(*keys).agg(*sums)


def dense_by_category(
    df: DataFrame,
    keys: Sequence[str],
    category: Column,
    categories: Sequence[int | str],
    value: Column,
    category_name: str,
    value_name: str,
) -> DataFrame:
    """Long form of :func:`sum_by_category`: every listed category for every key that has rows."""
    wide = sum_by_category(df, keys, category, categories, value)
    return to_long(wide, keys, categories, category_name, value_name)


def to_long(
    wide: DataFrame, keys: Sequence[str], categories: Sequence[int | str], category_name: str, value_name: str
) -> DataFrame:
    """One row per key and category from a column per category."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias(category_name), F.col(f"`{c}`").alias(value_name)) for c in categories]
    )
    return wide.select(*keys, F.inline(pairs))


def year_over_year(
    totals: DataFrame, value: str, year: str = "anio", by: Sequence[str] = (), name: str = "variacion_pct"
) -> DataFrame:
    """Change against exactly the year before; a gap in the years gives no value.

    ``totals`` is already aggregated to one row per calendar year (and ``by``), so the window is small.
    """
    window = Window.partitionBy(*by).orderBy(year).rangeBetween(-1, -1)
    return totals.withColumn(name, change_pct(F.col(value), F.sum(value).over(window)))


def with_share(totals: DataFrame, value: str, name: str = "porcentaje") -> DataFrame:
    """Share of each row in the sum of all given rows, by a scalar subquery over the same aggregate."""
    grand = totals.agg(F.coalesce(F.sum(value), F.lit(0)).alias("total")).scalar()
    return totals.withColumn(name, share_pct(F.col(value), grand))


def join_windows(df: DataFrame, windows: DataFrame, date: str) -> DataFrame:
    """Rows with each window (anio, fecha_ini, fecha_fin) that holds their date: a range join.

    The calendar year is the equality key, so it hashes instead of comparing every pair; a window across New
    Year takes part under both of its years.
    """
    years = F.sequence(F.year("fecha_ini"), F.year("fecha_fin"))
    keyed = windows.withColumn("_anio_ventana", F.explode(years))
    inside = F.col(date).between(F.col("fecha_ini"), F.col("fecha_fin"))
    return (
        df.join(keyed, (F.year(F.col(date)) == F.col("_anio_ventana")) & inside)
        .drop("_anio_ventana")
    )


def one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side, without a cross join: union by name, then the only non-null of each column."""
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame, allowMissingColumns=True)
    return united.agg(*[F.max(c).alias(c) for c in united.columns])
