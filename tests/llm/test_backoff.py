import math
import re
from collections import Counter

import numpy as np
import pytest
from llm.samples import AWKWARD
from pyspark.sql import functions as F

from reclutark.llm import backoff
from reclutark.llm.common import crc_fold

def held_out():
    return crc_fold(F.col("doc_id"), 10) == 0


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [" start", *re.findall(r"[^\x20\x09-\x0D]+", lowered), " end"]


def model(rows, order):
    """Tokens, counts of n-grams, and the probability of an n-gram's last token, from plain dictionaries; rows are (id, text, held out)."""
    counts, follow = Counter(), Counter()
    for _, text, held in rows:
        t = tokens(text)
        if not held:
            counts.update(tuple(t[i : i + k]) for k in range(1, order + 1) for i in range(len(t) - k + 1))
    for gram in counts:
        follow[gram[:-1]] += 1
    total = sum(n for g, n in counts.items() if len(g) == 1 and g != (" start",))
    distinct = sum(len(g) == 1 and g != (" start",) for g in counts)

    def probability(gram):
        if len(gram) == 1:
            return (counts[gram] + 0.1) / (total + 0.1 * (distinct + 1))
        shorter = probability(gram[1:])
        context = gram[:-1]
        if not follow[context]:
            return shorter
        return (max(counts[gram] - backoff.DISCOUNT, 0) + backoff.DISCOUNT * follow[context] * shorter) / counts[context]

    return total, counts, probability


def brute(rows, order=3):
    """(known, base, score) of each row's text."""
    total, counts, probability = model(rows, order)
    out = []
    for _, text, _ in rows:
        t = tokens(text)
        out.append((
            sum(counts[(w,)] > 0 for w in t[1:]), sum(math.log10(probability((w,))) for w in t[1:]),
            sum(math.log10(probability(tuple(t[max(0, i - order + 1) : i + 1]))) for i in range(1, len(t))),
        ))
    return total, out


def held(rows, got, order=3):
    total, want = brute(rows, order)
    found = {}
    for r in got:
        found.setdefault((r.doc_id, r.held_out, r.n_tokens), []).append(r)
    assert len(got) == len(rows)
    for (doc_id, text, out), (known, base, score) in zip(rows, want):
        near = found[(doc_id, out, len(tokens(text)) - 1)]
        assert any(r.n_known == known and r.train_tokens == total and abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6 for r in near)


@pytest.mark.parametrize("order, block, piece, part_bytes, hot", [
    (3, 10**6, 1024, 10**8, 10**6), (3, 4000, 16, 20_000, 20), (2, 3000, 7, 30_000, 0), (1, 3000, 7, 30_000, 10**6), (4, 5000, 3, 50_000, 3),
])
def test_brute_force_however_the_work_is_cut(table, order, block, piece, part_bytes, hot):
    docs = table("documents")
    rows = [(r.doc_id, r.text, r.out) for r in docs.select("doc_id", "text", held_out().alias("out")).collect()]
    held(rows, backoff.scores(docs.repartition(3), held_out(), order, part_bytes, block, piece, hot).collect(), order)


@pytest.mark.parametrize("context", [(), ("a",), ("a", "b"), ("b", "a"), ("never", "seen"), (" start",), (" start", "a")])
def test_probabilities_after_a_context_sum_to_one(context):
    """Over all known tokens and one for all unknown ones; the operator's scores are held against the same function."""
    total, _, probability = model([(1, "a b a c", False), (2, "a b b", False), (3, "c a b", False)], 3)
    assert total == 13
    assert sum(probability((*context, w)) for w in ["a", "b", "c", " end", "unknown"]) == pytest.approx(1)


def test_held_out_texts_are_likelier_than_under_the_base(table):
    got = backoff.scores(table("documents", "/root/testdata/sf0.01"), held_out()).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) * 0.95
    assert all(math.isfinite(r.score) and r.score <= 0 and r.n_known <= r.n_tokens for r in got)


def test_awkward_rows(documents):
    docs = documents(*AWKWARD, AWKWARD[4])
    rows = [(a[0], a[1], bool(int(r.out))) for a, r in zip([*AWKWARD, AWKWARD[4]], docs.select(held_out().cast("int").alias("out")).collect())]
    held(rows, backoff.scores(docs, held_out()).collect())
    assert backoff.scores(docs.limit(0), held_out()).collect() == []
    none = backoff.scores(docs, F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known, r.score, r.base_score) for r in none} == {(0, 0, 0.0, 0.0)}
    assert {r.held_out for r in backoff.scores(docs, F.lit(None).cast("boolean")).collect()} == {False}


def test_packed_numbers():
    for values in ([], [0], [0, 0, 0], [1, 255, 256], [2**64 - 1, 0], list(range(1000))):
        for rising in (False, True):
            of = np.array(sorted(values) if rising else values, dtype=np.uint64)
            got = backoff.unpack(backoff.pack(of, rising))
            assert got.tolist() == of.tolist()


def test_packed_small_numbers():
    for values in ([], [0], [0, 127, 128, 16_383, 16_384, 2**21 - 1, 2**21, 2**28, 2**32 - 1], list(range(40_000))):
        of = np.array(values, dtype=np.uint32)
        assert backoff.unpack_small(backoff.pack_small(of)).tolist() == values
