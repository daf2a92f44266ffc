"""Trie of shared conversation prefixes by ROLLUP over positional turn-id columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reclutark.llm.common import ship, words
from reclutark.session import cut_lineage

#: Turns of a conversation that stand side by side in one row; longer conversations go on in further rows.
WIDTH = 8

#: Blocks of a conversation whose running totals are worked out in one window; the windows' totals are added up in a second one.
SPAN = 4096

#: Conversation ids in one piece of an ends list.
PIECE = 1 << 16

#: Low bits of ``monotonically_increasing_id``, which count the rows of a partition.
PLACE_BITS = 33

TURNS = [f"t{j}" for j in range(1, WIDTH + 1)]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, t, words`` per row: the turn's content as a 128-bit digest and its number of words.

    A null role or text counts as empty.  Rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.unhex(F.md5(content)).alias("t"), F.size(words(text)).alias("words")
    )


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``pos``, the place in their conversation from 1: by turn, null first, rows of an equal turn by their digest.

    Rows are put in ranges of (conversation, turn, digest) and written once; a row's place is its place in the range plus the rows of
    its conversation in earlier ranges.  So a conversation of any length is spread, and only its counts per range meet.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t")]
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", PLACE_BITS))
    parts = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return placed.join(before, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("at") - F.col("first_at") + 1).alias("pos"), "t", "words")


def rebuilt(rows: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Ids of all conversations, and the turns of the rebuilt ones.

    Conversation c gets the first h turns of conversation c - c % ``family`` (all if fewer, none if absent) and then its own after
    its first h; h is the unsigned CRC-32 of the decimal c modulo ``heads``.
    """
    own = cut_lineage(numbered(cut_lineage(rows)))  # ranges are drawn from a sample, so texts would be read twice
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    convs = own.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), head)
    starts = own.filter(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "t", "words")
    taken = convs.join(starts, "base").filter("pos <= h").select("conv_id", "pos", "t", "words")
    lengths = starts.groupBy("base").agg(F.max("pos").alias("base_turns"))
    moved = convs.join(lengths, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("k"))
    rest = own.join(moved, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "t", "words")
    return convs.select("conv_id"), taken.unionByName(rest)


def _hashes(pos: Column, turn: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn at its place; those of a prefix are their exclusive or."""
    return F.xxhash64(F.lit(1), pos.cast("long"), turn), F.xxhash64(F.lit(2), pos.cast("long"), turn)


def blocks(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per conversation and ``WIDTH`` turns: the turns side by side, the running words, and the prior block's node.

    ``ka, kb`` name the node of all earlier blocks' turns by its digest, so all blocks of all conversations meet in one ROLLUP.  A conversation
    without turns has one empty block.  ``last`` is the depth at which the conversation ends, null in its other blocks.
    """
    place = ((F.col("pos") - 1) % WIDTH + 1).cast("int")
    a, b = _hashes(F.col("pos"), F.col("t"))
    cells = rows.select("conv_id", F.floor((F.col("pos") - 1) / WIDTH).cast("long").alias("block"), place.alias("j"), "pos", "t", "words", a.alias("a"), b.alias("b"))
    none = convs.select("conv_id", F.lit(0).cast("long").alias("block"))
    wide = cells.unionByName(none, allowMissingColumns=True).groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("j") == j, F.col("t"))).alias(t) for j, t in enumerate(TURNS, 1)],
        *[F.coalesce(F.max(F.when(F.col("j") == j, F.col("words"))), F.lit(0)).cast("long").alias(f"w{j}") for j in range(1, WIDTH + 1)],
        F.coalesce(F.bit_xor("a"), F.lit(0).cast("long")).alias("a"),
        F.coalesce(F.bit_xor("b"), F.lit(0).cast("long")).alias("b"),
        F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("w"),
        F.coalesce(F.max("pos"), F.lit(0)).cast("long").alias("last"),
    )
    wide = wide.withColumn("span", F.floor(F.col("block") / SPAN))
    inside = Window.partitionBy("conv_id", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outside = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = wide.groupBy("conv_id", "span").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("w").alias("w"), F.max("last").alias("end"))
    totals = spans.select(
        "conv_id", "span", *[F.coalesce(f(c).over(outside), F.lit(0).cast("long")).alias(f"{c}_spans") for c, f in (("a", F.bit_xor), ("b", F.bit_xor), ("w", F.sum))],
        F.max("end").over(Window.partitionBy("conv_id")).alias("end"),
    )
    running = [F.coalesce(f(c).over(inside), F.lit(0).cast("long")).alias(f"{c}_before") for c, f in (("a", F.bit_xor), ("b", F.bit_xor), ("w", F.sum))]
    return wide.select("*", *running).join(totals, ["conv_id", "span"]).select(
        "conv_id", "block", *TURNS, *[f"w{j}" for j in range(1, WIDTH + 1)],
        F.col("a_before").bitwiseXOR(F.col("a_spans")).alias("ka"),
        F.col("b_before").bitwiseXOR(F.col("b_spans")).alias("kb"),
        (F.col("w_before") + F.col("w_spans")).alias("words_before"),
        F.when(F.col("last") == F.col("end"), F.col("last")).alias("last"),
    )


def _rollup(rows: DataFrame, aggregates: str) -> DataFrame:
    """Aggregates of every prefix within every block, with ``level``, the number of its turns there."""
    names = ", ".join(TURNS)
    found = rows.sparkSession.sql(
        f"select block, ka, kb, {names}, grouping_id() as gid, {aggregates} from {{rows}} group by block, ka, kb, rollup({names})", rows=rows
    )
    # grouping_id has a bit for each turn column that the row sums over, the last columns first.
    level = F.lit(WIDTH) - F.bit_count("gid").cast("int")
    found = found.withColumn("level", level).filter((F.col("level") > 0) | (F.col("block") == 0))
    there = F.when(F.col("level") == 0, F.lit(True))  # sums over conversations that end before this turn are no prefix
    for j, t in enumerate(TURNS, 1):
        there = there.when(F.col("level") == j, F.col(t).isNotNull())
    return found.filter(there).withColumn("depth", F.col("block") * WIDTH + F.col("level"))


def _at(level: Column, values: list[Column]) -> Column:
    """The value of the level, counted from 1; null for level 0."""
    chosen = F.lit(None)
    for j, v in enumerate(values, 1):
        chosen = F.when(level == j, v).otherwise(chosen)
    return chosen


def _named(found: DataFrame) -> DataFrame:
    """The rows with their node's digest ``a, b`` and their parent's ``pa, pb`` in place of the turns."""
    pairs = [_hashes(F.col("block") * WIDTH + j, F.col(t)) for j, t in enumerate(TURNS, 1)]
    sums = [[F.col("ka")], [F.col("kb")]]
    for pair in pairs:
        for total, h in zip(sums, pair):
            total.append(total[-1].bitwiseXOR(h))
    level, columns = F.col("level"), {}
    for name, total in zip("ab", sums):
        columns[name] = F.coalesce(_at(level, total[1:]), F.col(f"k{name}"))
        columns[f"p{name}"] = _at(level, total[:-1])
    return found.withColumns(columns).drop(*TURNS, "ka", "kb", "gid", "block")


def ends_digests(ends: DataFrame) -> DataFrame:
    """``a, b, depth, ends_sha256`` from ``ends(a, b, depth, conv_id)``: the digest of each node's ids, ascending and joined by commas.

    A digest of one long list is one pass over it, whatever the engine.  Ids are put in ranges, so that all tasks write the list in
    pieces; then a node's pieces stream through the hash in order, one at a time.
    """
    ship(ends.sparkSession)
    key = ["a", "b", "depth"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*held, ids[0], ",".join(map(str, ids)))], names=[*key, "first_id", "piece"])

        for batch in batches:
            for *node, conv_id in zip(*(batch.column(c).to_pylist() for c in (*key, "conv_id"))):
                if ids and (node != held or len(ids) == PIECE):
                    yield row()
                    ids = []
                held = node
                ids.append(conv_id)
        if ids:
            yield row()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out = []
            for *node, piece in zip(*(batch.column(c).to_pylist() for c in (*key, "piece"))):
                if node != held:
                    if held is not None:
                        out.append((*held, state.hexdigest()))
                    held, state = node, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*key, "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*held, state.hexdigest())], names=[*key, "ends_sha256"])

    ranged = ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    cut = ranged.mapInArrow(pieces, "a long, b long, depth long, first_id long, piece string")
    return cut.repartition(*key).sortWithinPartitions(*key, "first_id").mapInArrow(digests, "a long, b long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: a row per distinct sequence of first turns, from the textless root on.

    ``conv_id`` is the node's smallest member, ``parent_conv_id`` its parent's; ``n_convs`` counts members, ``n_children`` children, ``n_leaves`` the childless
    nodes of its subtree; ``saved_tokens`` sums (n_convs - 1) times the words of the last turn over its subtree; ``ends_sha256`` digests the ids of
    members that end there.

    One ROLLUP over the turn columns of all blocks makes the nodes.  Sums over subtrees need no walk: the words that a member shares with a
    smaller one are a prefix of its own, up to the node of which it is the smallest member; so a subtree's savings are the sum, over
    the node's members, of such words from the node's depth on, and its leaves are those of which a member is the smallest.  A second ROLLUP adds both up.

    Null roles and texts are empty, null turns come first, equal turns are ordered by digest; repeated rows are turns of their own; rows without
    conv_id and other columns are left out.  An empty table has no conversation and gives no node.
    """
    ids, rows = rebuilt(turns(conversations))
    rows = cut_lineage(rows)
    cells = cut_lineage(blocks(ids, rows))
    word = ", ".join(f"max(w{j}) as w{j}" for j in range(1, WIDTH + 1))
    found = _rollup(cells.withColumn("closes", F.col("last") - F.col("block") * WIDTH), f"min(conv_id) as conv_id, count(*) as n_convs, {word}")
    nodes = cut_lineage(_named(found).select("depth", "conv_id", "n_convs", "a", "b", "pa", "pb"))

    ends = cells.filter("last is not null")
    level = F.col("last") - F.col("block") * WIDTH
    ends = _named(ends.withColumns({"level": level.cast("int"), "gid": F.lit(0)})).select("a", "b", F.col("last").alias("depth"), "conv_id")
    closing = ends.groupBy("a", "b", "depth").agg(F.count("*").alias("n_ends"))
    children = nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = cut_lineage(nodes.join(closing, ["a", "b", "depth"], "left").join(children, ["a", "b", "depth"], "left").fillna(0, ["n_ends", "n_children"]))

    first_own = nodes.groupBy("conv_id").agg(F.min("depth").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    shared = rows.join(first_own, "conv_id", "left").filter("own is null or pos < own").groupBy("conv_id").agg(F.sum("words").alias("shared"))
    before = F.col("words_before")
    saved = {}
    for j in range(1, WIDTH + 1):
        saved[f"s{j}"] = F.greatest(F.col("shared") - before, F.lit(0))
        before = before + F.col(f"w{j}")
    facts = cells.join(first_own.drop("own"), "conv_id", "left").join(shared, "conv_id", "left").fillna(0, ["leaf", "shared"]).withColumns(saved)
    sums = ", ".join(f"sum(s{j}) as s{j}" for j in range(1, WIDTH + 1))
    below = _named(_rollup(facts, f"sum(leaf) as n_leaves, sum(shared) as s0, {sums}"))
    below = below.select("a", "b", "depth", "n_leaves", F.coalesce(_at(F.col("level"), [F.col(f"s{j}") for j in range(1, WIDTH + 1)]), F.col("s0")).alias("saved_tokens"))

    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.join(below, ["a", "b", "depth"]).join(parents, ["pa", "pb", "depth"], "left").join(ends_digests(ends), ["a", "b", "depth"], "left")
    return linked.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")
    )
