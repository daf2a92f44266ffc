import hashlib
import random
import re
import zlib

import pytest

from reclutark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(turn):
    role, text = turn
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    """The nodes by walking the trie, in the columns of the operator."""
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, digest((role or "", text or "")), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(v, key=lambda t: t[:3])] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        full[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = {}
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            nodes.setdefault(tuple(full[c][:d]), []).append(c)
    kids = {p: [] for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out, sums = [], {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [sums[k] for k in kids[p]]
        sums[p] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(nodes[p]) - 1) * words)
        ends = ",".join(str(c) for c in nodes[p] if len(full[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(nodes[p]), len(p), parent, len(nodes[p]), len(kids[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=str)


def test_checking_sql(same):
    same("op11_prefix_trie", "/root/testdata/sf0.01")


@pytest.mark.parametrize("seed, lengths", [(1, range(0, 5)), (2, [1, 7, 8, 9, 16, 17, 40])])
def test_brute_force(spark, monkeypatch, seed, lengths):
    monkeypatch.setattr(prefix_trie, "SPAN", 2)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    pick = random.Random(seed)
    rows = [
        (c, t, pick.choice(["user", "bot", None]) if t > 20 else "user", pick.choice(["a b", "a b", "c", "", None]) if t % 9 == 8 else "same words here")
        for c in [*range(-30, 70, 2), 10**12]
        for t in range(pick.choice(list(lengths)))
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert got(df) == want
    assert got(df.repartition(7)) == want


def test_awkward_rows(spark):
    rows = [
        (None, 1, "user", "x"), (0, None, None, None), (0, 1, "user", " \t\n"), (0, 1, "user", " \t\n"), (0, 1, "bot", "tie"), (1, 0, "a", "bc"), (2, 0, "ab", "c"),
        (3, 0, "user", "w " * 30_000), (23, 5, None, ""), (-7, 2, "user", "  one"), (-7, None, "user", "  one"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as t", "1 as block", "2 as depth", "3 as words", "4 as a")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []
    assert got(df.filter("conv_id is null")) == []


def test_many_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 4000, 20) for t in range(3)]
    nodes = got(spark.createDataFrame(rows, SCHEMA))
    assert nodes == brute(rows) and len(nodes) == 4


def test_conversations_longer_than_a_block_meet_in_one_rollup(spark):
    plan = prefix_trie._rollup(
        prefix_trie.blocks(*prefix_trie.rebuilt(prefix_trie.turns(spark.createDataFrame([(0, t, "u", "x") for t in range(30)], SCHEMA)))), "count(*) as n"
    )
    assert sorted(r.depth for r in plan.collect()) == list(range(31))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Expand") >= 1
