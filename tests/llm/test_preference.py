import pytest

from reclutark.llm import preference

TURN = "pair_id long, turn long, role string, text string"


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql(same, folder):
    assert same("op1_preference", folder)


def segments(spark, chosen, rejected):
    turns = preference.sides(spark.createDataFrame(chosen, TURN), spark.createDataFrame(rejected, TURN))
    rows = preference.segments(turns).collect()
    return sorted(((r.pair_id, r.part, r.turn, r.segment, r.segment[r.learnt_from : r.learnt_to] if r.learnt_from is not None else None) for r in rows), key=str)


def test_prompt_once_and_masked_completions(spark):
    start = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a")]
    got = segments(spark, [*start, (1, 3, "user", "x"), (1, 4, "assistant", "good")], [*start, (1, 3, "user", "y"), (1, 4, "assistant", "bad")])
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got == sorted([
        (1, "prompt", 0, say("system", "s"), None), (1, "prompt", 1, say("user", "q"), None), (1, "prompt", 2, say("assistant", "a"), None),
        (1, "chosen", 3, say("user", "x"), None), (1, "chosen", 4, say("assistant", "good"), "good<|end|>\n"),
        (1, "rejected", 3, say("user", "y"), None), (1, "rejected", 4, say("assistant", "bad"), "bad<|end|>\n")], key=str)


def test_a_later_equal_turn_is_not_prompt(spark):
    got = segments(spark, [(1, 0, "user", "a"), (1, 1, "user", "b")], [(1, 0, "user", "c"), (1, 1, "user", "b")])
    assert {g[1] for g in got} == {"chosen", "rejected"} and len(got) == 4


def test_awkward_conversations(spark):
    chosen = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (None, 0, "user", "z"), (3, 5, "user", "long " * 40_000), (4, 0, "b", "x"), (4, 0, "a", "x")]
    got = segments(spark, chosen, [(1, 0, "user", "a"), (2, None, None, None), (4, 0, "a", "x"), (4, 0, "b", "x")])
    assert [g[:2] for g in got] == [(1, "prompt"), (2, "prompt"), (3, "chosen"), (4, "prompt"), (4, "prompt")]
    assert got[1][3] == "<|unknown|>\n<|end|>\n"
    assert segments(spark, [], []) == []


def test_pairs_with_the_neighbours_reply(spark):
    rows = [(2, 0, "user", "q"), (2, 1, "assistant", "own"), (2, 2, "user", "bye"), (3, 0, "user", "p"), (3, 1, "assistant", "other"), (8, 0, "assistant", "alone"), (9, 0, "user", "mute")]
    told = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as side", "1 as part")
    turns = preference.with_other_reply(told)
    of = lambda side: sorted(map(tuple, turns.filter(f"side = {side}").drop("side").collect()))
    assert of(preference.CHOSEN) == sorted(rows)
    assert of(preference.REJECTED) == [(2, 0, "user", "q"), (2, 1, "assistant", "other"), (3, 0, "user", "p"), (3, 1, "assistant", "own"), (9, 0, "user", "mute")]


def test_no_python_in_the_plan(spark, table):
    plan = preference.segments(preference.with_other_reply(table("conversations")))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
