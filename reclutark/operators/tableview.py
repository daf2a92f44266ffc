"""Table views: facets, faceted filter, sort, page, column choice, JSON records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from reclutark import catalogs


def pick(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Columns in the given order; names the table does not have are skipped, None keeps all."""
    return df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns renamed and put in the order of the mapping; names the table does not have are skipped."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items() if old in df.columns])


def facets(df: DataFrame, columns: Sequence[str], labels: Mapping[str, str] = catalogs.FACET_LABELS) -> DataFrame:
    """Filter choices (columna, valor, etiqueta): distinct values per column, missing and blank ones left out.

    A boolean column always offers its fixed pair, so it is not read at all.
    """
    booleans = [c for c in columns if df.schema[c].dataType == T.BooleanType()]
    others = [c for c in columns if c not in booleans]
    spark = df.sparkSession
    parts = []
    if others:
        pairs = F.array(
            *[F.struct(F.lit(c).alias("columna"), F.col(f"`{c}`").cast("string").alias("valor")) for c in others]
        )
        found = df.select(F.inline(pairs)).where(F.col("valor").isNotNull() & (F.col("valor") != "")).distinct()
        parts.append(found.withColumn("etiqueta", F.col("valor")))
    if booleans:
        pairs = F.array(
            *[
                F.struct(F.lit(c).alias("columna"), F.lit(v).alias("valor"), F.lit(label).alias("etiqueta"))
                for c in booleans
                for v, label in labels.items()
            ]
        )
        parts.append(spark.range(1).select(F.inline(pairs)))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def sorted_facets(found: DataFrame, locale: str = "es") -> DataFrame:
    """Choices per column in the alphabetical order of the language."""
    return found.orderBy("columna", F.collate(F.col("valor"), locale), "valor")


def facet_search(found: DataFrame, term: str | None) -> DataFrame:
    """Choices whose label holds the term, in any case."""
    return found.where(F.lower("etiqueta").contains(term.lower())) if term else found


def faceted_filter(df: DataFrame, choices: Mapping[str, Sequence[str]]) -> DataFrame:
    """Any of the chosen values within a column, all columns together; no choice keeps everything."""
    for column, values in choices.items():
        if values:
            df = df.where(F.col(f"`{column}`").cast("string").isin(list(values)))
    return df


def sort_key(df: DataFrame, column: str) -> Column:
    """Comparable form of a column: text in lower case, missing text as '' and missing numbers as 0."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        return F.lower(F.coalesce(c, F.lit("")))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c.cast("int"), F.lit(0))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c, F.lit(0).cast(kind))
    return c


def sort_order(df: DataFrame, column: str, descending: bool, unique: Sequence[str]) -> list[Column]:
    """Sort columns with a unique tiebreak, so that equal values do not pile up in one range."""
    key = sort_key(df, column)
    first = key.desc_nulls_last() if descending else key.asc_nulls_first()
    return [first, *[F.col(f"`{c}`").asc() for c in unique if c != column]]


def page_bounds(total: int, page: int, size: int) -> tuple[int, int, int, int]:
    """(page, pages, first offset, end offset) with the page, counted from 1, brought into range."""
    pages = max(1, -(-total // size))
    page = min(max(1, page), pages)
    start = (page - 1) * size
    return page, pages, start, min(start + size, total)


@dataclass
class Range:
    """Rows from the key ``low`` on, up to but without ``high`` (None: no bound), and their number."""

    low: tuple | None
    high: tuple | None
    rows: int


class Directory:
    """Order statistics of a sorted table: splitting keys, and the number of rows between them.  Nothing is sorted or written for it.

    It starts as one range.  A page whose range has more than ``leaf`` rows splits that range at the quantiles of a sample of its keys, counts
    the rows of the parts in one more reading, and goes on in the part that holds the page.  So a page costs a few narrow readings and
    a sort of at most ``leaf`` rows, wherever it lies; the splits stay known, and further pages take fewer.  ``unique`` names columns that tell
    all rows apart, and the table must be the same at every reading.  Rows that aren't told apart stay in one range.
    """

    def __init__(self, df: DataFrame, column: str, unique: Sequence[str], descending: bool = False, leaf: int = 1 << 16, ways: int = 64):
        self.df, self.leaf, self.ways = df, leaf, ways
        self.order = sort_order(df, column, descending, unique)
        rest = [c for c in unique if c != column]
        self.keys = [(sort_key(df, column), descending), *[(F.col(f"`{c}`"), False) for c in rest]]
        self.total = df.count()
        self.ranges = [Range(None, None, self.total)]

    def page(self, page: int = 1, size: int = catalogs.PAGE_SIZES[0]) -> DataFrame:
        """One page with ``fila`` (place in the table), ``pagina``, ``paginas``, ``total``."""
        page, pages, start, end = page_bounds(self.total, page, size)
        while (large := next((r for _, r in self._touched(start, end) if r.rows > self.leaf), None)) and self._split(large):
            pass
        touched = self._touched(start, end)
        before = touched[0][0] if touched else 0
        rows = self._between(touched[0][1].low, touched[-1][1].high) if touched else self.df.where(F.lit(False))
        place = (F.row_number().over(Window.orderBy(*self.order)) + before).cast("bigint")  # one task, over a range
        return rows.withColumn("fila", place).where(F.col("fila").between(start + 1, end)).select(
            *[F.col(f"`{c}`") for c in self.df.columns],
            "fila",
            F.lit(page).alias("pagina"),
            F.lit(pages).alias("paginas"),
            F.lit(self.total).cast("bigint").alias("total"),
        ).orderBy("fila")

    def _touched(self, start: int, end: int) -> list[tuple[int, Range]]:
        """Ranges that hold rows of the places, each with the number of rows before it."""
        out, before = [], 0
        for r in self.ranges:
            if before < end and start < before + r.rows:
                out.append((before, r))
            before += r.rows
        return out

    def _split(self, wide: Range) -> bool:
        """Replaces a range by its parts; whether there are any."""
        keys = [k.alias(f"_k{i}") for i, (k, _) in enumerate(self.keys)]
        rows = self._between(wide.low, wide.high).select(*keys)
        names = [F.col(f"_k{i}") for i in range(len(keys))]
        # The rows with the least hashes are a sample that is the same however the rows are dealt.
        sample = rows.orderBy(F.xxhash64(*names)).limit(self.ways * 8)
        by_key = [c.desc_nulls_last() if down else c.asc_nulls_first() for c, (_, down) in zip(names, self.keys)]
        sampled = list(dict.fromkeys(tuple(r) for r in sample.orderBy(*by_key).collect()))
        bounds = sorted({len(sampled) * k // self.ways for k in range(1, self.ways)} - {0})
        bounds = [sampled[k] for k in bounds if k < len(sampled)]
        if not bounds:
            return False
        columns = list(zip(names, [down for _, down in self.keys]))

        def part(low: int, high: int) -> Column:
            """Number of the part, among those from ``low`` to ``high``: a search by halves."""
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(_before(columns, bounds[middle]), part(low, middle)).otherwise(part(middle + 1, high))

        counts = dict(tuple(r) for r in rows.groupBy(part(0, len(bounds)).alias("parte")).count().collect())
        edges = [wide.low, *bounds, wide.high]
        parts = [Range(low, high, counts.get(k, 0)) for k, (low, high) in enumerate(zip(edges, edges[1:]))]
        at = self.ranges.index(wide)
        self.ranges[at : at + 1] = parts
        return max(p.rows for p in parts) < wide.rows

    def _between(self, low: tuple | None, high: tuple | None) -> DataFrame:
        rows = self.df
        if low is not None:
            rows = rows.where(~_before(self.keys, low))
        return rows if high is None else rows.where(_before(self.keys, high))


def _before(columns: Sequence[tuple[Column, bool]], bound: Sequence) -> Column:
    """Whether a row stands before a key, column by column (falling ones marked); missing values are the least."""
    before = F.lit(False)
    for (c, descending), value in reversed(list(zip(columns, bound))):
        if value is None:
            here, same = (c.isNotNull() if descending else F.lit(False)), c.isNull()
        else:
            here = F.coalesce(c > F.lit(value), F.lit(False)) if descending else c.isNull() | (c < F.lit(value))
            same = F.coalesce(c == F.lit(value), F.lit(False))
        before = here | (same & before)
    return before


def page_of(
    df: DataFrame,
    column: str,
    unique: Sequence[str],
    page: int = 1,
    size: int = catalogs.PAGE_SIZES[0],
    descending: bool = False,
) -> DataFrame:
    """One page of the sorted table, with ``fila`` (place in the table), ``pagina``, ``paginas``, ``total``; see :class:`Directory`."""
    return Directory(df, column, unique, descending).page(page, size)


def json_records(df: DataFrame, name: str = "registro") -> DataFrame:
    """One JSON object per row: dates as YYYY-MM-DD, missing and not-a-number as null, letters kept as they are."""

    def cell(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        return c.alias(field.name)

    options = {"dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd", "ignoreNullFields": "false"}
    return df.select(F.to_json(F.struct(*[cell(f) for f in df.schema.fields]), options).alias(name))
