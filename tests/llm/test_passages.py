import random

import numpy as np
import pytest

from reclutark.llm import passages


def some_words(seed, n):
    rnd = random.Random(seed)
    return [f"{rnd.choice('bcdfglmnprst')}{rnd.choice('aeiou')}{rnd.randint(0, 9999)}" for _ in range(n)]


def text(*parts):
    return " ".join(w for p in parts for w in p)


def test_equal_runs_of_twenty_words_share_a_seed():
    rnd = random.Random(1)
    for k in range(200):
        shared = some_words(k, passages.SEED + passages.WINDOW - 1)
        a, b = ([*some_words(1000 + 2 * k + s, rnd.randint(40, 90)), *shared, *some_words(9000 + 2 * k + s, rnd.randint(40, 90))] for s in (0, 1))
        (x, _), (y, _) = (passages.seed_places(text(t)) for t in (a, b))
        assert set(x.tolist()) & set(y.tolist())


def test_repeated_words_keep_a_seed_in_every_window_and_few_more():
    for period in (1, 2, 3, 7):
        unit = some_words(period, period)
        h, at = passages.seed_places(text(unit * (600 // period)))
        last = 600 // period * period - passages.SEED + 1
        assert all(((at >= s) & (at < s + passages.WINDOW)).any() for s in range(last - passages.WINDOW + 1)) and len(at) < 90


def brute_chain(pos, src):
    best = [1.0] * len(pos)
    for j in range(len(pos)):
        for i in range(j):
            if pos[i] < pos[j] and src[i] < src[j]:
                best[j] = max(best[j], best[i] + 1 - passages.GAP_COST * (pos[j] - pos[i] + src[j] - src[i]))
    return max(best)


def test_fenwick_chains_are_as_good_as_brute_force(monkeypatch):
    monkeypatch.setattr(passages, "WIDEST_GAP", 10**9)
    rnd = random.Random(2)
    for _ in range(200):
        n = rnd.randint(1, 40)
        found = sorted({(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(n)})
        pos, src = np.array([p for p, _ in found]), np.array([s for _, s in found])
        chains = passages.best_chains(pos, src)
        worth = lambda c: len(c) - passages.GAP_COST * (pos[c[-1]] - pos[c[0]] + src[c[-1]] - src[c[0]])
        assert sorted(i for c in chains for i in c) == list(range(len(found)))
        assert all(pos[a] < pos[b] and src[a] < src[b] for c in chains for a, b in zip(c, c[1:]))
        assert max(map(worth, chains)) == pytest.approx(brute_chain(pos.tolist(), src.tolist()))


def test_the_fewest_rows_cover_the_same_words():
    import pyarrow as pa

    rnd = random.Random(5)
    rows = sorted({(d, s, n) for d in range(4) for s, n in ((rnd.randint(0, 300), rnd.randint(45, 90)) for _ in range(60))}, key=lambda r: (r[0], r[1], -r[2]))
    schema = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 7])], schema=schema) for k in range(0, len(rows), 7)]
    kept = [r for b in passages._uncovered(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    times = {}
    for d, s, n in kept:
        for w in range(s, s + n):
            times[d, w] = times.get((d, w), 0) + 1
    assert set(times) == {(d, w) for d, s, n in rows for w in range(s, s + n)} and max(times.values()) <= 2 and set(kept) <= set(rows)
    assert list(passages._uncovered(iter([]))) == []


def test_spans_are_as_by_sets_of_shingles():
    rnd = random.Random(6)
    for _ in range(300):
        a = [str(rnd.randint(0, 30)) for _ in range(rnd.randint(50, 160))]
        b = [w if rnd.random() > 0.03 else "x" for w in a]
        aligned, k = [], 0
        while k < len(a):
            n = 0
            while k + n < len(a) and a[k + n] == b[k + n]:
                n += 1
            if n:
                aligned.append((k, k, n))
            k += n + 1
        want, reached = [], -1
        for i, (s, t, _) in enumerate(aligned):
            best = None
            for j in range(i, len(aligned)):
                e, u = (aligned[j][c] + aligned[j][2] for c in (0, 1))
                x, y = ({tuple(w[k : k + 5]) for k in range(o, p - 4)} for w, o, p in ((a, s, e), (b, t, u)))
                if max(e - s, u - t) >= passages.LEAST_WORDS and len(x & y) / max(1, len(x | y)) >= passages.SIMILARITY:
                    best = j, (s, e, t, u, len(x & y) / max(1, len(x | y)))
            if best and best[0] > reached:
                reached = best[0]
                want.append(best[1])
        assert passages.similar_spans(*(passages._hashes_of(text(w)) for w in (a, b)), aligned) == want


def test_passages_are_found_whole_and_clean_documents_left_alone(documents):
    shared = some_words(1, 60)
    changed = [*shared[:30], "changed", *shared[31:]]
    far = [*shared[:10], "a", *shared[11:20], "b", *shared[21:30], "c", *shared[31:40], "d", *shared[41:50], "e", *shared[51:]]
    docs = documents(
        (1, text(some_words(2, 80), shared, some_words(3, 50))), (2, text(some_words(4, 30), shared)), (3, text(changed, some_words(5, 40))),
        (4, text(some_words(6, 200))), (5, text(some_words(7, 60), shared[:30], some_words(8, 60))), (6, text(far, some_words(9, 90))), (None, text(shared)),
        (7, None), (8, ""), (9, text(shared)), (9, text(shared)),
    )
    found = {(r.doc_id, r.start_word, r.n_words, r.first_doc_id, r.first_start_word) for r in passages.repeated(docs).collect()}
    assert {(2, 30, 60, 1, 80), (3, 0, 60, 1, 80), (9, 0, 60, 1, 80)} <= found
    assert {f[0] for f in found} == {2, 3, 9}


def test_a_copy_of_a_changed_copy_is_found_beside_it(documents):
    """Seeds of a changed place are first met in the changed copy, all others in the original."""
    base = some_words(11, 400)
    changed = [w if i % 30 else "new" + w for i, w in enumerate(base)]
    docs = documents((1, text(base)), (3_000_000, text(changed)), (6_000_000, text(changed)))
    covered = set()
    for r in passages.repeated(docs).collect():
        if r.doc_id == 6_000_000:
            covered |= set(range(r.start_word, r.start_word + r.n_words))
    assert covered == set(range(400))


def test_cutting_keeps_the_rest(documents):
    shared, own = some_words(1, 60), some_words(2, 30)
    docs = documents((1, text(shared) + "\n tail  one"), (2, text(own) + " \n" + text(shared) + "\tend  here"), (3, None), (None, text(shared)), (4, text(shared)))
    rows = {r.doc_id: r for r in passages.without_repeats(docs, passages.repeated(docs)).collect()}
    assert rows[1].text == text(shared) + "\n tail  one" and rows[3].text is None and rows[None].text == text(shared)
    assert rows[2].text == text(own) + " \nend  here" and rows[2].n_chars == len(rows[2].text)
    assert rows[4].text == "" and rows[2].row == "x" and len(rows) == 5


def test_rows_of_one_id_with_other_texts_are_not_cut(documents):
    shared, other = some_words(1, 60), some_words(2, 80)
    rows = [(1, text(shared)), (2, text(some_words(3, 20), shared)), (2, text(other)), (3, text(shared, some_words(4, 9))), (3, text(shared, some_words(4, 9))), (None, text(shared))]
    docs = documents(*rows)
    for d in (docs, docs.repartition(3)):
        found = passages.repeated(d)
        kept = sorted(((r.doc_id, r.text) for r in passages.without_repeats(d, found).collect()), key=str)
        own = [(2, text(other)), (1, text(shared)), (None, text(shared))] + [(3, text(some_words(4, 9)))] * 2
        first, second = (sorted([*own, (2, t)], key=str) for t in (text(some_words(3, 20)) + " ", text(some_words(3, 20), shared)))
        assert kept in (first, second)
    assert passages.without_repeats(docs, passages.repeated(docs)).filter("doc_id = 2").count() == 2


def test_every_exact_window_is_covered_on_the_tables(spark, table):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    covered = {}
    for r in entry.queries()["op2_passages"](spark, folder).collect():
        assert r.first_doc_id < r.doc_id and r.similarity >= 0.8
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    seen, missed = {}, 0
    for r in sorted(table("documents", folder).collect(), key=lambda r: r.doc_id):
        words = (r.text or "").encode().split()
        for k in range(len(words) - 50):
            if seen.setdefault(tuple(words[k : k + 51]), r.doc_id) != r.doc_id:
                missed += not set(range(k, k + 51)) <= covered.get(r.doc_id, set())
    assert missed == 0



def test_lines_that_others_hold_alone_do_not_hide_the_document_of_both(documents):
    """Every seed and every line is first, and last before, in a document that holds one line alone."""
    lost = []
    for k in range(30):
        one, two = some_words(100 + k, 25), some_words(200 + k, 25)
        alone = [(10 * k + i, text(some_words(5000 + 10 * k + i, 30), (one, two)[i % 2], some_words(7000 + 10 * k + i, 30))) for i in (1, 2, 4, 5, 6, 7)]
        lost += [*alone, (10 * k + 3, text(one, two)), (10 * k + 9, text(some_words(9000 + k, 20), one, two))]
    found = {(r.doc_id, r.start_word, r.n_words, r.first_doc_id) for r in passages.repeated(documents(*lost)).collect()}
    assert {(10 * k + 9, 20, 50, 10 * k + 3) for k in range(30)} <= found


def test_blocks_of_ids_only_split_the_work(documents, monkeypatch):
    docs = []
    for k in range(8):
        one, two = some_words(300 + k, 30), some_words(400 + k, 30)
        parts = [[one, some_words(1, 5), two], [one], [two], [one, two], [two, one], [one, two]]
        docs += [(1000 * i + k, text(some_words(500 + 10 * k + i, 40), *p)) for i, p in enumerate(parts)]
    docs = documents(*docs)
    whole = sorted(passages.repeated(docs).collect())
    assert len(passages.block_bounds(docs)) == 0
    for block in (3, 7, 20):
        monkeypatch.setattr(passages, "BLOCK", block)
        assert len(passages.block_bounds(docs)) == -(-48 // block) - 1
        assert sorted(passages.repeated(docs).collect()) == whole


def test_a_chain_that_fails_does_not_hide_an_equal_one(documents):
    """The first document's version has three other words, mostly where no seed is kept."""
    rows, wanted = [], set()
    for k in range(40):
        shared = some_words(600 + k, 60)
        other = [*shared[:28], "x", "y", "z", *shared[31:]]
        rows += [(10 * k + 1, text(some_words(1600 + k, 40), other)), (10 * k + 2, text(some_words(2600 + k, 40), shared)), (10 * k + 3, text(some_words(3600 + k, 40), shared))]
        wanted.add((10 * k + 3, 40, 60, 10 * k + 2))
    assert wanted <= {(r.doc_id, r.start_word, r.n_words, r.first_doc_id) for r in passages.repeated(documents(*rows)).collect()}


def test_a_change_anywhere_in_51_words_leaves_the_passage(documents):
    rows = []
    for at in range(51):
        shared = some_words(800 + at, 51)
        rows += [(2 * at, text(some_words(1800 + at, 30), shared, some_words(2800 + at, 30))),
                 (2 * at + 1, text(some_words(3800 + at, 30), [*shared[:at], "changed", *shared[at + 1 :]], some_words(4800 + at, 30)))]
    found = {r.doc_id: r for r in passages.repeated(documents(*rows)).collect()}
    for at in range(51):
        r = found[2 * at + 1]
        assert r.start_word <= 30 + (at + 1 if at < 3 else 0) and r.start_word + r.n_words >= 81 - (51 - at if at > 47 else 0) and r.similarity >= 0.8


def test_lines_repeated_on_and_on_have_few_chains(spark):
    """A line that fills many texts has a key at every place; the chains that can cover nothing more are not verified, and the same words are covered."""
    rows = [(i, " ".join([*(f"w{i}x{k}" for k in range(30 + i)), *["Is", "onhe."] * 200, *(f"v{i}x{k}" for k in range(i))])) for i in range(8)]
    made, kept = [], passages.chains
    try:
        passages.chains = lambda found: made.append(kept(found)) or made[-1]
        got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        passages.chains = kept
    assert made[0].groupBy("doc_id").count().agg({"count": "max"}).first()[0] < 120
    for i in range(1, 8):
        covered = {k for r in got if r.doc_id == i for k in range(r.start_word, r.start_word + r.n_words)}
        assert covered == set(range(30 + i, 430 + i))


def test_needed_chains_cover_what_all_cover():
    random = np.random.default_rng(3)
    for _ in range(300):
        spans = []
        for _ in range(random.integers(1, 40)):
            start, run = int(random.integers(0, 400)), bool(random.integers(0, 2))
            last = start + int(random.integers(0, 30))
            spans.append((start, last, last + passages.LEAST_WORDS if run else start))
        need = passages.needed(spans)
        sure = {w for (a, _, e), n in zip(spans, need) if n for w in range(a, e)}
        assert sure == {w for a, _, e in spans for w in range(a, e)}
        for (a, b, _), n in zip(spans, need):
            assert n or sure >= set(range(max(0, a - passages.MARGIN), b + passages.SEED + passages.MARGIN))
