"""Mixing sources to target weights: budgets flow down a domain-language-source tree, each leaf takes a token prefix of
seeded epochs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from reclutark.llm.common import words
from reclutark.session import cut_lineage

TREE = ["domain", "lang", "source"]

#: Bits of the order within an epoch, and how many of them each refinement of its prefix reads.
ORDER_BITS, BIN_BITS, REFINEMENTS = 60, 12, 2

#: Tables of leaves up to this size are broadcast: about a hundred bytes a leaf.  Larger ones are joined by a shuffle.
BROADCAST_LEAVES = 20_000


@dataclass
class Mixture:
    """What to mix: whole-number weights by name (1 for names that aren't given, 0 for none), the share of the corpus to take as
    tenths, the most epochs of a leaf, and the seed of the epochs' orders."""

    domain: Column
    weights: dict[str, Mapping[str, int]] = field(default_factory=dict)
    tenths: int = 8
    most_epochs: int = 4
    seed: int = 3

    def weight(self, level: str) -> Column:
        given = self.weights.get(level) or {}
        known = F.coalesce(*(F.when(F.col(level) == name, F.lit(w)) for name, w in given.items()), F.lit(1)) if given else F.lit(1)
        return known.cast("long")


def counted(docs: DataFrame, mixture: Mixture, *keep: str) -> DataFrame:
    """``keep``, the names of the leaf and ``n_tokens`` (words) of each whole text; null names are names of their own."""
    return docs.select(*keep, mixture.domain.alias("domain"), "lang", "source", F.size(words(F.col("text"))).cast("long").alias("n_tokens"))


def _divided(nodes: DataFrame, level: str, over: list[str]) -> DataFrame:
    """``budget`` of each node from the ``parent`` budget of its siblings (nodes that share ``over``).

    Siblings get budget in proportion to their weights; who can't use a share is filled up and the shortage goes to the others. In
    the order of capacity by weight the filled ones come first, so sums along that order say who they are.
    What whole numbers leave over goes one by one to the first siblings that still have room.
    """
    by = Window.partitionBy(F.lit(0), *over)
    order = by.orderBy(F.col("capacity") / F.col("weight"), level)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    ranked = nodes.filter("weight > 0").withColumns({
        "below": F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "from_here": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    full = ranked.withColumn("full", wide("capacity") * wide("from_here") <= (wide("parent") - wide("below")) * wide("weight"))
    split = full.withColumns({
        "left": F.col("parent") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(by), F.lit(0)),
        "open": F.sum(F.when(~F.col("full"), F.col("weight"))).over(by),
    }).withColumn("fair", F.when(~F.col("full"), F.expr("cast(left as decimal(38,0)) * weight div open")))
    spread = split.withColumns({
        "over": F.col("left") - F.sum("fair").over(by),
        "turn": F.row_number().over(by.orderBy("full", level)),
    })
    more = (F.col("turn") <= F.col("over")).cast("long")
    return spread.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.col("fair") + more)).select(*nodes.columns, "budget")


def budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """``leaves(domain, lang, source, tokens)`` with ``budget``: a shortage goes to siblings, what the family can't use to
    the siblings of its parent, and so on up."""
    sized = leaves.withColumn("capacity", F.col("tokens") * mixture.most_epochs)
    above = None
    for k, level in enumerate(TREE):
        path = TREE[: k + 1]
        nodes = sized.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", mixture.weight(level))
        if k:
            same = [F.col(f"n.{c}").eqNullSafe(F.col(f"a.{c}")) for c in path[:-1]]
            joined = nodes.alias("n").join(above.alias("a"), reduce(lambda x, y: x & y, same))
            nodes = joined.select("n.*", F.col("a.parent"))
        else:
            total = F.sum("capacity").over(Window.partitionBy(F.lit(0)))
            wanted = F.floor(total / mixture.most_epochs) * mixture.tenths / 10
            nodes = nodes.withColumn("parent", F.least(F.floor(wanted).cast("long"), total))
        above = cut_lineage(_divided(nodes, level, path[:-1]).select(*path, F.col("budget").alias("parent")))
    same = reduce(lambda x, y: x & y, [F.col(f"n.{c}").eqNullSafe(F.col(f"a.{c}")) for c in TREE])
    return leaves.alias("n").join(above.alias("a"), same, "left").select("n.*", F.coalesce("a.parent", F.lit(0)).cast("long").alias("budget"))


def _place(epoch: Column, mixture: Mixture) -> Column:
    """Place of a document in the order of an epoch: the upper bits of a digest of seed, epoch and id."""
    name = F.concat_ws("|", F.lit(str(mixture.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, ORDER_BITS // 4), 16, 10).cast("long")


def plan(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """One row per leaf: ``tokens``, ``budget``, ``epochs`` that it gives whole, and where the prefix of the next epoch ends.

    The prefix is the longest that the rest of the budget holds.  Tokens are added up by bins of the order, the bin in which
    the rest runs out is divided again, and only the rows of the last such bin are sorted; so a leaf with a third
    of all rows is never in one task.
    """
    rows = cut_lineage(counted(docs.withColumn("_digest", _digest(docs)), mixture, "doc_id", "_digest"))
    leaves = cut_lineage(rows.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens")))
    shares = cut_lineage(budgets(leaves, mixture).withColumn("leaf", F.to_json(F.struct(*TREE))).withColumns({
        "epochs": F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long"),
        "rest": F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(0)).cast("long"),
    }))
    named = rows.select(F.to_json(F.struct(*TREE)).alias("leaf"), "doc_id", "_digest", "n_tokens")
    inside = named.join(_sized(shares.filter("rest > 0").select("leaf", "epochs", "rest")), "leaf")
    inside = inside.select("leaf", "doc_id", "_digest", "n_tokens", "rest", _place(F.col("epochs"), mixture).alias("place"), F.lit(0).cast("long").alias("edge"))
    shift = ORDER_BITS
    for _ in range(REFINEMENTS):
        shift -= BIN_BITS
        start = F.shiftleft(F.shiftright("place", shift), shift)
        bins = inside.groupBy("leaf", start.alias("bin"), "rest").agg(F.sum("n_tokens").alias("n"))
        along = Window.partitionBy("leaf").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = bins.withColumn("sum", F.sum("n").over(along)).filter("sum > rest and sum - n <= rest")
        ends = cut_lineage(ends.select("leaf", F.col("bin").alias("edge"), (F.col("rest") - F.col("sum") + F.col("n")).alias("rest")))
        inside = inside.drop("rest", "edge").join(_sized(ends), "leaf").filter(start == F.col("edge"))
    # Equal rows are one, with their number; so rows without an id, which all have one place, don't meet in one task, either.
    same = inside.groupBy("leaf", *KEY, "rest", "edge").agg(F.count("*").alias("n"))
    along = Window.partitionBy("leaf").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = same.withColumn("sum", F.sum(F.col("n_tokens") * F.col("n")).over(along))
    fits, before = F.col("sum") <= F.col("rest"), F.col("sum") - F.col("n_tokens") * F.col("n")
    some = F.expr("(rest - sum + n_tokens * n) div nullif(n_tokens, 0)")
    last = sums.groupBy("leaf").agg(
        F.first("edge").alias("edge"), F.max(F.when(fits, F.struct(*KEY))).alias("cut"),
        F.max(F.when(~fits & (before <= F.col("rest")) & (some > 0), F.struct(F.struct(*KEY).alias("key"), some.alias("n")))).alias("part"),
    )
    return cut_lineage(shares.join(last, "leaf", "left"))


#: Order of a leaf's documents in an epoch.
KEY = ["place", "doc_id", "n_tokens", "_digest"]


def _digest(docs: DataFrame) -> Column:
    """Hash of a whole row, which tells rows of one id apart."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))


def _sized(leaves: DataFrame) -> DataFrame:
    """Handed to every task if there are few leaves, so that texts stay where they lie; very many are joined by a shuffle."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def mixed(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """``doc_id``, the leaf's names, ``n_tokens``, ``epoch`` and ``row`` (all columns of ``docs``) for every time that a document is
    taken.

    The plan is a row per leaf, so texts are only filtered and repeated where they lie, never shuffled.  Null and empty texts
    have no tokens; a leaf without any gives nothing.  Repeated rows count each; rows of one id (or none) are ordered by their tokens and a hash of the
    row, and of equal rows at the end of a prefix as many are taken as it holds.  An empty table gives none.
    """
    leaf = plan(docs, mixture).select("leaf", "epochs", "edge", "cut", "part")
    whole_row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    read = docs.select("doc_id", "text", "lang", "source", _digest(docs).alias("_digest"), whole_row)
    rows = counted(read, mixture, "doc_id", "_digest", "row").withColumn("leaf", F.to_json(F.struct(*TREE)))
    key = F.struct(*KEY)
    taken = (F.col("place") < F.col("edge")) | (key <= F.col("cut"))
    last = F.when(F.coalesce(taken, F.lit(False)), F.array("epochs")).otherwise(F.array().cast("array<bigint>"))
    whole = F.when(F.col("epochs") > 0, F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).otherwise(F.array().cast("array<bigint>"))
    placed = rows.join(_sized(leaf), "leaf").withColumn("place", _place(F.col("epochs"), mixture))
    shown = ["doc_id", "domain", "lang", "source", "n_tokens", "epoch", "row"]
    chosen = placed.withColumn("epoch", F.explode(F.concat(whole, last))).select(*shown)
    if leaf.filter("part is not null").isEmpty():
        return chosen
    # Some of the equal rows of one key: they are one row, and it is given out as often.
    part = placed.filter(key == F.col("part.key")).groupBy("leaf", *KEY).agg(*[F.first(c).alias(c) for c in ("domain", "lang", "source", "row", "part", "epochs")])
    some = part.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("part.n"))).alias("_k"), F.col("epochs").alias("epoch"))
    return chosen.unionByName(some.select(*shown))
