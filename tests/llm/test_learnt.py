"""Quality classifier and language identification: held-out accuracy and awkward training data."""

import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
from llm.samples import long_text
from pyspark.sql import functions as F

from reclutark.llm import language, rules
from reclutark.llm.common import crc_fold

FOLDER = "/root/testdata/sf0.1"


def test_classifier_on_held_out_labels(spark, table):
    import __spark_entry__ as entry

    rows = {r.doc_id: r for r in entry.queries()["op5_rules"](spark, FOLDER).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    held = [(r.quality, rows[r.doc_id].predicted) for r in table("labels", FOLDER).collect() if rows[r.doc_id].held_out]
    assert len(held) > 500 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_a_rule_is_a_column_and_a_filter_on_the_score_stays_above(documents):
    model = rules.Ensemble(-1.0, {rules.Rule((("n_words", True, 2.0), ("symbol_share", False, 0.1))): 3.0})
    docs = documents((1, "a b c d e f g h i j k"), (2, "a # * $"), (3, None), (4, long_text(40_000)))
    got = {r.doc_id: r.score for r in rules.scored(docs, model, "doc_id").collect()}
    high, low = 1 / (1 + 2.718281828459045**-2.0), 1 / (1 + 2.718281828459045**1.0)
    assert got == {1: pytest.approx(high), 2: pytest.approx(low), 3: pytest.approx(low), 4: pytest.approx(high)}
    kept = rules.keep_good(docs, model, 0.5)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4] and kept.columns == docs.columns


def test_labels_that_teach_nothing(spark, documents):
    docs = documents((1, "a b"), (2, "c d"))
    held = crc_fold(F.col("doc_id"), 5) == 0
    none = spark.createDataFrame([(None, 1), (1, None), (9, 5)], "doc_id long, quality int")
    assert [r.score for r in rules.classify(docs, rules.fit(docs, none, held), held).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(i, 1) for i in range(1, 20)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in rules.classify(docs, rules.fit(docs, ones, held), held).collect())


def test_language_on_held_out_documents(spark, table):
    import __spark_entry__ as entry

    rows = {r.doc_id: r for r in entry.queries()["op9_language"](spark, FOLDER).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [(r.lang, rows[r.doc_id].lang_pred) for r in table("documents", FOLDER).collect() if rows[r.doc_id].held_out]
    assert len(held) > 2000 and sum(a == b for a, b in held) >= 0.98 * len(held)


def test_mixtures_letters_and_awkward_texts(spark, documents):
    docs = documents(*[(i, "the thing was in the house and other words " * 3, "en") for i in range(5)], *[(i, "der die und nicht das ist ein wort von " * 3, "de") for i in range(5, 10)],
                     (20, None, "en"), (21, "text without language", None), (22, "", "en"))
    model = language.learn(docs)
    assert model.languages == ["de", "en"]
    name, share = model.mixture("the thing was in the house and other words " * 6 + "der die und nicht das ist ein wort von " * 2)
    assert name == "en" and 0.55 < share < 0.9
    assert model.mixture("der die das")[0] == "de"
    asked = documents((1, None), (2, ""), (3, "123 !?"), (4, "the"), (None, "und"), (4, "the"), (5, "the words " * 50_000))
    got = [(r.doc_id, r.lang_pred) for r in language.identify(asked, model).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "de"), (4, "en"), (5, "en")]
    nobody = language.learn(documents((1, None, "en")))
    assert [r.lang_pred for r in language.identify(asked, nobody).collect()] == ["und"] * 7


def test_counts_do_not_depend_on_the_pieces(monkeypatch):
    text = long_text(3000)
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "CHUNK", 1000)
    pieces = language.gram_counts(text)
    assert all((a == b).all() for a, b in zip(whole, pieces))


def plain_statistics(text):
    """The statistics of a text in plain Python."""
    text = text or ""
    words, lines, chars = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n"), max(1, len(text))
    n = max(1, len(words))

    def share(kind):
        return sum(c in kind for c in text) / chars

    return {
        "n_words": math.log1p(len(words)), "word_length": len(text) / n, "symbol_share": share("#*$%&<>"), "mark_share": share("!?"), "bar_share": share("|"),
        "capital_share": sum(unicodedata.category(c) == "Lu" for c in text) / chars, "digit_share": share("0123456789"),
        "repeat_share": sum(a == b for a, b in zip(words, words[1:])) / n, "distinct_share": len(set(words)) / n,
        "dup_line_share": (len(lines) - len(set(lines))) / len(lines), "line_words": len(words) / len(lines),
    }


def test_statistics_and_scores_against_plain_ones(documents, table):
    odd = [(i, t) for i, t in enumerate(["a a b\n\na a b\n", "ÑÉ É! ? | 12 #$", None, "", "\t \n", "x" * 999, "a\x85b　c d d d"], 10_000)]
    docs = table("documents", "/root/testdata/sf0.001").select("doc_id", "text").unionByName(documents(*odd, clashes=False).select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r for r in rules.statistics(docs, "doc_id").collect()}
    want = {i: plain_statistics(t) for i, t in texts.items()}
    for i, own in want.items():
        assert {s: getattr(found[i], s) for s in rules.STATISTICS} == pytest.approx(own, abs=1e-12), i
    ensemble = rules.Ensemble(-0.4, {
        rules.Rule((("n_words", True, 3.0),)): 1.5, rules.Rule((("capital_share", False, 0.05), ("distinct_share", True, 0.4))): -0.7,
        rules.Rule((("line_words", False, 9.5), ("mark_share", True, 0.0), ("word_length", False, 7.0))): 2.0,
    })
    got = {r.doc_id: (r.score, r.predicted) for r in rules.classify(docs, ensemble, F.lit(False)).collect()}
    for i, own in want.items():
        total = -0.4 + sum(w for rule, w in ensemble.weights.items() if all((own[s] > b) == above for s, above, b in rule.bounds))
        assert got[i] == (pytest.approx(1 / (1 + math.exp(-total))), int(1 / (1 + math.exp(-total)) >= 0.3))


def test_paths_of_trees_are_the_rules_that_a_row_follows(documents, spark, table):
    docs, labels = table("documents", "/root/testdata/sf0.01"), table("labels", "/root/testdata/sf0.01")
    model = rules.fit(docs, labels, crc_fold(F.col("doc_id"), 5) == 0)
    assert model.weights and all(b[0] in rules.STATISTICS for r in model.weights for b in r.bounds)
    texts = {r.doc_id: plain_statistics(r.text) for r in docs.collect()}
    got = {r.doc_id: r.score for r in rules.scored(docs, model, "doc_id").collect()}
    for i, own in texts.items():
        near = any(abs(own[s] - b) < 1e-9 for r in model.weights for s, _, b in r.bounds)
        total = model.intercept + sum(w for rule, w in model.weights.items() if all((own[s] > b) == above for s, above, b in rule.bounds))
        assert near or got[i] == pytest.approx(1 / (1 + math.exp(-total)))


def test_no_rules_give_the_share_of_the_labels(spark, documents):
    docs = documents(*[(i, "the same text") for i in range(40)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int")
    model = rules.fit(docs, labels, F.lit(False))
    assert not model.weights and {round(r.score, 9) for r in rules.classify(docs, model, F.lit(False)).collect()} == {0.25}


def plain_mixture(model, text):
    """Expectation-maximisation over lists, n-gram by n-gram."""
    cells, counts = language.gram_counts(text)
    p = [[math.exp(float(v)) for v in model.log_likelihood[c]] for c in cells]

    def maximise(which, rounds):
        share = [1 / len(which)] * len(which)
        for _ in range(rounds):
            moved = [0.0] * len(which)
            for row, n in zip(p, counts):
                whole = sum(s * row[k] for s, k in zip(share, which))
                for j, k in enumerate(which):
                    moved[j] += n * share[j] * row[k] / whole
            moved = [m / sum(counts) for m in moved]
            done = max(abs(a - b) for a, b in zip(moved, share)) < language.TOLERANCE
            share = moved
            if done:
                break
        return share, sum(n * math.log(sum(s * row[k] for s, k in zip(share, which))) for row, n in zip(p, counts))

    first, _ = maximise(range(len(model.languages)), language.ROUNDS // 4)
    order = sorted(range(len(first)), key=lambda k: -first[k])
    chosen, best = order[:1], sum(n * math.log(row[order[0]]) for row, n in zip(p, counts))
    share = [1.0]
    for k in range(2, len(order) + 1):
        shares, value = maximise(order[:k], language.ROUNDS)
        if value - best <= language.PENALTY * math.log(sum(counts) + 1):
            break
        chosen, share, best = order[:k], shares, value
    main = max(range(len(share)), key=lambda j: share[j])
    return model.languages[chosen[main]], share[main]


def test_mixtures_against_plain_expectation_maximisation(table):
    docs = table("documents", "/root/testdata/sf0.001")
    model = language.learn(docs)
    rows = [r for r in docs.collect() if r.text and any(map(str.isalpha, r.text))]
    texts = [r.text[:600] for r in rows[:40]] + [a.text[:300] + " " + b.text[:200] for a, b in zip(rows[40:60], rows[60:80])]
    for text in texts:
        name, share = plain_mixture(model, text)
        got = model.mixture(text)
        assert got[0] == name and got[1] == pytest.approx(share, abs=2e-3)


def test_counted_cells_are_those_of_every_text(documents, table):
    docs = table("documents", "/root/testdata/sf0.001")
    model = language.learn(docs)
    totals = np.full((language.CELLS, len(model.languages)), language.SMOOTHING)
    for r in docs.filter("lang is not null and text is not null").collect():
        cells, counts = language.gram_counts(r.text)
        totals[cells, model.languages.index(r.lang)] += counts
    assert np.allclose(model.log_likelihood, np.log(totals / totals.sum(axis=0)), atol=1e-5)
