import math
import re
from collections import Counter

import numpy as np
import pytest

from reclutark.llm import outliers


def plain(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def base(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words


TEXTS = ["", None, " ", "a", "a b", "a b c", "a b c a b c", "a a a a a", "a a a a", "x\n\nx\n x\nx", "\n \n \n", "ñ😀 | <b> #$%\x0b&*\n", "a b c d a b c e a b c", " p q ",
         "l1\nl1\nl2\nl1\r\nl1", "a\x85b c", "one two three " * 40]


@pytest.mark.parametrize("bits", [24, 2])
def test_base_statistics(documents, monkeypatch, bits):
    """Two bits for places: every window must then be named by itself."""
    monkeypatch.setattr(outliers, "_PLACE_BITS", bits)
    docs = documents(*enumerate(TEXTS))
    for r in outliers.base_statistics(docs, "doc_id").collect():
        assert base(r) == plain(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def numpy_estimate(x):
    """The same concentration steps over a plain matrix."""
    floor = np.array(outliers.FLOOR)
    q = np.percentile(np.round(x * 4096), [25, 50, 75], axis=0) / 4096
    mean, factor = q[1], np.diag(np.sqrt(((q[2] - q[0]) / 1.349) ** 2 + floor**2))
    d2 = lambda: (np.linalg.solve(factor, (x - mean).T) ** 2).sum(axis=0)
    for step in range(outliers.STEPS + 1):
        d = d2()
        bins = np.floor(np.log2(1 + d) * 256)
        inner = x[bins <= np.percentile(bins, 75)] if step < outliers.STEPS else x[d <= outliers.REWEIGHT * outliers.CONSISTENCY]
        mean, factor = inner.mean(axis=0), np.linalg.cholesky(np.cov(inner.T, bias=True) + np.diag(floor**2))
    return d2()


def vectors(rows):
    out = []
    for r in rows:
        n = max(r.n_words, 1)
        raw = [math.log1p(r.word_chars / n), math.log1p(n), *(math.sqrt(v / n) for v in (r.n_symbols, r.n_dup_lines, r.n_repeat_words))]
        out.append([math.floor(v * 4096 + 0.5) / 4096 for v in raw])
    return np.array(out)


def test_query_equals_plain_concentration(spark, table):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    rows = entry.queries()["op4_outliers"](spark, folder).collect()
    docs = {r.doc_id: r for r in table("documents", folder).collect()}
    assert len(rows) == len(docs) and all(base(r) == plain(docs[r.doc_id].text) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert all(r.kept == (not r.base_failed and r.distance <= outliers.CUTOFF) for r in rows)
    groups = {}
    for r in rows:
        if not r.base_failed:
            groups.setdefault((docs[r.doc_id].lang, docs[r.doc_id].source), []).append(r)
    by_lang = {}
    for (lang, _), members in groups.items():
        by_lang.setdefault(lang, []).extend(members)
    checked = 0
    for (lang, _), members in groups.items():
        pool = members if len(members) >= outliers.LEAST_ROWS else by_lang[lang] if len(by_lang[lang]) >= outliers.LEAST_ROWS else None
        if pool:
            want = dict(zip([r.doc_id for r in pool], numpy_estimate(vectors(pool))))
            for r in members:
                assert r.distance == pytest.approx(want[r.doc_id], rel=1e-6)
                checked += 1
    assert checked > 500


def test_labelled_good_documents_are_kept(spark, table):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table("labels", folder).collect()}
    rows = [r for r in entry.queries()["op4_outliers"](spark, folder).collect() if not r.base_failed and r.doc_id in labels]
    assert all(r.kept for r in rows if labels[r.doc_id] == 1)
    assert sum(not r.kept for r in rows if labels[r.doc_id] == 0) >= 0.9 * sum(labels[r.doc_id] == 0 for r in rows)
