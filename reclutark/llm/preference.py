"""Preference formatting: the common turn prefix of two conversations once as prompt, the rest as paired masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What ends a turn, a fixed format.
CLOSE = "<|end|>\n"

#: Role whose words are learnt.
SPEAKER = "assistant"


#: The two sides of a pair.
CHOSEN, REJECTED = 0, 1


def sides(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``side, pair_id, turn, role, text`` of the turns of either side."""
    columns = ["pair_id", "turn", "role", "text"]
    return chosen.select(F.lit(CHOSEN).alias("side"), *columns).unionByName(rejected.select(F.lit(REJECTED).alias("side"), *columns))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit(CLOSE))


def segments(turns: DataFrame) -> DataFrame:
    """``pair_id, part, turn, place, role, segment, learnt_from, learnt_to`` for turns ``side, pair_id, turn, role, text``.

    ``part`` is ``prompt`` for the longest prefix of equal turns, which is given once, else ``chosen`` or ``rejected``.  Segments of a
    part, joined in the order of turn and place, are its text; characters from ``learnt_from`` to before ``learnt_to``
    of a segment are learnt, all others are masked (both null: none).  Only words of the assistant in completions are learnt, with the mark that
    ends them.  Equal conversations are all prompt; a conversation that ends with the prefix has no completion.

    A null turn stands before all others, a null role is ``unknown``, a null text is empty; a null pair_id is no conversation.
    Rows of one turn lie in one task, sorted: different ones are told apart by place, in the order of role and text, and
    repeated rows count once.  So both sides meet per turn, and a pair is never gathered in one task however long it is.
    """
    known = turns.select(
        "side", "pair_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).filter("pair_id is not null")
    by = Window.partitionBy("pair_id", "turn", "side").orderBy("role", "text")
    placed = known.repartition("pair_id", "turn").withColumn("part", F.dense_rank().over(by))
    said = F.struct("role", "text")
    places = placed.groupBy("pair_id", "turn", "part").agg(
        F.max(F.when(F.col("side") == 0, said)).alias("chosen"), F.max(F.when(F.col("side") == 1, said)).alias("rejected"))
    here = F.struct("turn", "part")
    split = places.withColumn("differs", ~F.col("chosen").eqNullSafe(F.col("rejected")))
    ends = split.groupBy("pair_id").agg(F.min(F.when(F.col("differs"), here)).alias("end"))
    known = split.join(ends, "pair_id").withColumn("prompt", F.coalesce(here < F.col("end"), F.lit(True)))
    either = F.when(F.col("prompt"), F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("said")))).otherwise(F.array(
        F.struct(F.lit("chosen").alias("part"), F.col("chosen").alias("said")), F.struct(F.lit("rejected").alias("part"), F.col("rejected").alias("said"))))
    rows = known.select("pair_id", "turn", F.col("part").alias("place"), F.explode(either).alias("x")).filter("x.said is not null")
    role, text = F.col("x.said.role"), F.col("x.said.text")
    learnt = (F.col("x.part") != "prompt") & (role == SPEAKER)
    start = F.length(role) + len("<||>\n")
    return rows.select(
        "pair_id", F.col("x.part").alias("part"), "turn", "place", role.alias("role"), rendered(role, text).alias("segment"),
        F.when(learnt, start).alias("learnt_from"), F.when(learnt, start + F.length(text) + len(CLOSE)).alias("learnt_to"),
    )


def with_other_reply(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns of both sides for conversations without ratings: chosen is a conversation, rejected the same up to its last reply with
    the last reply of its neighbour (the id with the lowest bit turned) in its place.

    The neighbour's reply is what a judge would reject as off the subject.  Without reply of their own, both sides are the
    conversation; without a neighbour's reply, the rejected side ends before the reply.
    """
    told = conversations.select(F.col(key).alias("pair_id"), "turn", "role", "text").filter("pair_id is not null")
    replies = told.filter((F.col("role") == SPEAKER) & F.col("turn").isNotNull())
    ends = replies.groupBy("pair_id").agg(F.max("turn").alias("end"))
    before = F.col("end").isNull() | F.col("turn").isNull() | (F.col("turn") < F.col("end"))
    both = F.when(before, F.array(F.lit(CHOSEN), F.lit(REJECTED))).otherwise(F.array(F.lit(CHOSEN)))
    ended = told.join(ends, "pair_id", "left")
    shared = ended.select(F.explode(both).alias("side"), "pair_id", "turn", "role", "text")
    last = ended.filter((F.col("role") == SPEAKER) & (F.col("turn") == F.col("end")))
    other = last.groupBy(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id")).agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    instead = other.join(ends, "pair_id").select(F.lit(REJECTED).alias("side"), "pair_id", F.col("end").alias("turn"), F.lit(SPEAKER).alias("role"), "text")
    return shared.unionByName(instead)
