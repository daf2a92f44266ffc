"""Quality rules: text statistics, fixed base rules and robust multivariate outliers, all as DataFrame operations."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from reclutark.llm.common import words
from reclutark.session import cut_lineage

#: Transformed statistics: word length and text length (logarithms), and shares of symbols, repeated lines and repeated words.
VECTOR = ["word_length", "length", "symbols", "dup_lines", "repeats"]

#: Smallest scale of each, in its own units: a statistic that is the same nearly everywhere would else make any other value an
#: outlier.
FLOOR = [0.10, 1.0, 0.05, 0.10, 0.10]

#: Share of a group that the determinant is minimised over, and concentration steps.
SUPPORT, STEPS = 0.75, 6

#: Groups with fewer rows take the estimate of their language, languages with fewer that of all.
LEAST_ROWS = 50

#: Squared distance beyond which a row is rejected: the chi-square of five degrees of freedom passes it once in ten million.
CUTOFF = 41.0

#: Covariance of all rows over that of the inner three quarters, and the bound of the reweighted step: 97.5 % of the
#: chi-square of five degrees of freedom.
CONSISTENCY, REWEIGHT = 1.41, 12.83

#: Tables of groups up to this size are broadcast: a few hundred bytes a group.
BROADCAST_GROUPS = 20_000

#: Position of a window in the low bits of a sort key, its hash in the others.
_PLACE_BITS = 24


def base_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text.

    Everything happens within the row, by array functions: no text is exploded or shuffled.  A null text has no words.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(*keep, text.alias("t"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Each step is a column of its own, as a lambda would work out an expression anew for every element.
    hashed = F.transform(_places(F.col("w")), lambda i: F.shiftright(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)), _PLACE_BITS))
    counted = base.select(
        *keep, "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("l"), hashed.alias("h"),
    )
    keyed = F.transform("h", lambda x, i: F.shiftleft(x, _PLACE_BITS).bitwiseOR(i.cast("long")))
    differ = (F.size(F.array_distinct("h")) == F.size("h")) | (F.size("w") >= (1 << _PLACE_BITS))
    counted = counted.withColumn("o", F.when(differ, F.array().cast("array<bigint>")).otherwise(F.sort_array(keyed)))
    counted = counted.withColumn("c", _candidates(F.col("w"), F.col("o")))
    # Candidates share the upper bits of a hash; the words themselves decide which windows are equal.
    exact = F.sort_array(F.transform("c", lambda i: F.struct(_window(F.col("w"), i).alias("k"), i.alias("i"))))
    found = counted.withColumn("x", exact)
    twice = F.filter("x", lambda y, i: (y["k"] == F.get("x", i - 1)["k"]) | (y["k"] == F.get("x", i + 1)["k"]))
    found = found.withColumn("p", F.sort_array(F.transform(twice, lambda y: y["i"])))
    covered = F.aggregate(
        F.transform("p", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - i, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    return found.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
    )


def _window(w: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))


def _places(w: Column) -> Column:
    return F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))


def _candidates(w: Column, ordered: Column) -> Column:
    """Places of the three-word windows whose hash another window shares in its upper bits: neighbours in the order of hash and
    place.  Texts whose places don't fit the low bits name every window."""
    top = lambda x: F.shiftright(x, _PLACE_BITS)
    same = F.filter(ordered, lambda x, i: (top(x) == top(F.get(ordered, i - 1))) | (top(x) == top(F.get(ordered, i + 1))))
    found = F.transform(same, lambda x: x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1).cast("long")).cast("int"))
    return F.when(F.size(w) >= (1 << _PLACE_BITS), _places(w)).otherwise(found)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, rounded to multiples of 2^-12 so that sums over them don't depend on their order."""
    n = F.greatest("n_words", F.lit(1)).cast("double")
    raw = [
        F.log1p(F.col("word_chars") / n), F.log1p(n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    ]
    return [F.round(x * 4096).cast("long").alias(f"x{k}") for k, x in enumerate(raw)]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sums and sums of products per group, as exact decimals: partial sums combine before the shuffle."""
    p = range(len(VECTOR))
    sums = [F.sum(F.col(f"x{i}").cast("decimal(20,0)")).alias(f"s{i}") for i in p]
    products = [F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(20,0)")).alias(f"s{i}_{j}") for i in p for j in p if j <= i]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *products)


def _estimate(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and inverse Cholesky factor of the floored covariance per group, one row each, written out as columns."""
    p, scale = range(len(VECTOR)), 4096.0
    out = moments.select(*keys, "n", *(((F.col(f"s{i}").cast("double") / F.col("n")) / scale).alias(f"m{i}") for i in p), *(
        (F.col(f"s{i}_{j}").cast("double") / F.col("n") / scale**2).alias(f"q{i}_{j}") for i in p for j in p if j <= i))
    for i in p:  # Cholesky's recursion, a level at a time: each column only names those before it
        for j in range(i + 1):
            cov = F.col(f"q{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (FLOOR[i] ** 2 if i == j else 0.0)
            rest = cov - reduce(add, [F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)], F.lit(0.0))
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}_{j}"))
    return out.select(*keys, "n", *(f"m{i}" for i in p), *(f"l{i}_{j}" for i in p for j in range(i + 1)))


def distances(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance by forward substitution along the Cholesky factor; null for
    rows whose ``key`` has no estimate."""
    p = range(len(VECTOR))
    out = rows.join(_sized(model.drop("n")), "key", "left")
    for i in p:
        rest = F.col(f"x{i}") / 4096.0 - F.col(f"m{i}")
        out = out.withColumn(f"z{i}", reduce(lambda r, j: r - F.col(f"l{i}_{j}") * F.col(f"z{j}"), range(i), rest) / F.col(f"l{i}_{i}"))
    return out.select(*rows.columns, reduce(add, [F.col(f"z{i}") * F.col(f"z{i}") for i in p]).alias("d2"))


def _sized(model: DataFrame) -> DataFrame:
    """Handed to every task if it has few groups; a table of very many groups is joined by a shuffle."""
    return F.broadcast(model) if model.count() <= BROADCAST_GROUPS else model


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and quartile ranges as scales: quartiles of whole numbers, so a group's state is bounded by their range."""
    p = range(len(VECTOR))
    quartiles = rows.groupBy("key").agg(F.count("*").alias("n"), *(F.percentile(f"x{i}", [0.25, 0.5, 0.75]).alias(f"r{i}") for i in p))
    width = lambda i: (F.col(f"r{i}")[2] - F.col(f"r{i}")[0]) / 4096.0 / 1.349
    return quartiles.select(
        "key", "n", *((F.col(f"r{i}")[1] / 4096.0).alias(f"m{i}") for i in p),
        *((F.sqrt(width(i) * width(i) + FLOOR[i] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i in p for j in range(i + 1)),
    )


def fit(rows: DataFrame, steps: int = STEPS, support: float = SUPPORT) -> DataFrame:
    """Minimum-covariance-determinant estimate per ``key``: concentration steps from medians and quartile ranges, then one
    reweighted step.

    A step keeps the ``support`` nearest rows of each group (their bound is a percentile over fine logarithmic bins) and takes mean
    and covariance of those alone; the determinant falls with every step.  What a step hands on is one row per group.
    """
    model = cut_lineage(_start(rows))
    for step in range(steps + 1):
        d2 = distances(rows, model)
        if step < steps:
            binned = d2.withColumn("bin", F.floor(F.log2(1 + F.col("d2")) * 256))
            bounds = binned.groupBy("key").agg(F.percentile("bin", support).alias("bound"))
            inner = binned.join(_sized(cut_lineage(bounds)), "key").filter("bin <= bound")
        else:
            inner = d2.filter(F.col("d2") <= F.lit(REWEIGHT * CONSISTENCY))
        # A group never loses its estimate: its nearest rows are always inside their own percentile.
        model = cut_lineage(_estimate(_moments(inner.select("key", *(f"x{i}" for i in range(len(VECTOR)))), ["key"]), ["key"]))
    return model


def _key(level: int, *columns: str) -> Column:
    """Text that names a group; null is a group of its own."""
    return F.to_json(F.struct(F.lit(level).alias("level"), *columns))


def filtered(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``distance`` (squared) and ``kept`` per row of ``docs``.

    Rows that fail the base rules take no part in the estimates.  Each (lang, source) has its own estimate if it has
    ``LEAST_ROWS`` rows, else that of its lang, else that of all rows; null lang or source is a group of its own.
    A null text has no words and fails the base rules.  Without any estimate, rows that pass the base rules are kept.
    Repeated rows count and are judged each; ties at the support bound are all inside; other columns are left out.
    """
    read = docs.select("doc_id", "text", "lang", "source")
    seen = cut_lineage(base_statistics(read, "doc_id", "lang", "source").withColumn("base_failed", base_failed()))
    points = seen.select("doc_id", "lang", "source", "base_failed", *vector())
    level = [_key(0, "lang", "source"), _key(1, "lang"), _key(2)]
    xs = [f"x{i}" for i in range(len(VECTOR))]
    passed = points.filter("not base_failed")
    sizes = passed.groupBy("lang", "source").count()
    groups = cut_lineage(sizes.select(*(k.alias(f"k{i}") for i, k in enumerate(level)), "count"))
    big = [groups.groupBy(F.col(f"k{i}").alias("key")).agg(F.sum("count").alias("n")).filter(F.col("n") >= LEAST_ROWS) for i in (0, 1)]
    # Only groups that will be asked for are estimated: all of the finest level, and what small ones fall back on.
    wanted = cut_lineage(big[0].union(big[1]).select("key").union(groups.select(F.col("k2").alias("key")).distinct()))
    levels = passed.select(F.explode(F.array(*level)).alias("key"), *xs)
    model = fit(levels.join(_sized(wanted), "key", "left_semi"))
    known = [model.select(F.col("key").alias(f"k{i}"), F.lit(True).alias(f"has{i}")) for i in (0, 1)]
    chosen = groups.join(known[0], "k0", "left").join(known[1], "k1", "left").select(
        "k0", F.when(F.col("has0"), F.col("k0")).when(F.col("has1"), F.col("k1")).otherwise(F.col("k2")).alias("key"))
    resolved = cut_lineage(chosen.join(model, "key").drop("key").withColumnRenamed("k0", "key"))
    judged = distances(seen.withColumns(dict(zip(xs, vector()))).withColumn("key", level[0]), resolved)
    inside = F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("d2").alias("distance"), (~F.col("base_failed") & inside).alias("kept"),
    )
