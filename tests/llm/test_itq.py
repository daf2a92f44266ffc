import numpy as np
import pytest
from llm.test_simhash import components

from reclutark.llm import itq


def brute(rows, cosine=0.98):
    """Links of usable vectors of one label, and components, over row numbers."""
    good = {}
    for k, (vec_id, vector, label) in enumerate(rows):
        if vec_id is not None and label is not None and vector is not None and None not in vector and np.isfinite(vector).all() and np.any(vector):
            good.setdefault((label, len(vector)), []).append(k)
    links = []
    for at in good.values():
        x = np.array([rows[k][1] for k in at], dtype=float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links += [(at[i], at[j]) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1)))]
    return links


def check(rows, got):
    links = brute(rows)
    ids = [r[0] for r in rows]
    degree = np.bincount([k for pair in links for k in pair], minlength=len(rows))
    found = {r.vec_id: r for r in got}
    assert sum(found[i].n_links for i in ids) >= 0.97 * degree.sum() and all(found[i].n_links <= degree[k] for k, i in enumerate(ids))
    want = components(sorted(ids), [(ids[a], ids[b]) for a, b in links])
    assert sum(found[i].component_id == want[i] for i in ids) >= 0.97 * len(ids)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("folder, block", [("/root/testdata/sf0.01", 1024), ("/root/testdata/sf0.1", 16)])
def test_recall_on_the_tables(table, folder, block):
    vectors = table("embeddings", folder)
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    check(rows, itq.components(vectors, block=block).collect())


def test_no_pair_is_counted_twice_however_a_bucket_is_cut(spark):
    random = np.random.default_rng(1)
    base = random.normal(size=16)
    rows = [(i, (base + 0.001 * random.normal(size=16)).tolist(), 1) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block in (1024, 7, 1):
        got = itq.components(vectors, block=block).collect()
        assert {r.n_links for r in got} == {59} and {r.component_id for r in got} == {0}


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1),
        (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [-0.0, 1.0], 3), (14, [0.0, 1.0], 3), (None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1),
        (15, [1.0, 0.0, 0.0], 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as node", "'y' as keys")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.components(vectors).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), *((k, 0, k, True) for k in range(4, 12)), (12, 1, 12, True), (13, 1, 13, True), (14, 1, 13, False),
            (None, 0, None, True), (2, 3, 1, False), (15, 1, 12, False)]
    assert got == sorted(want, key=str)
    assert itq.components(vectors.limit(0)).collect() == []


def test_a_vec_id_on_other_labels_lengths_and_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [0.0, 1.0, 0.0], 1), (3, [1.0, 0.001], 1), (4, [1.0, 0.0], 2), (1, [1.0, 0.0], 2), (5, [0.0, 1.0], 2),
        (1, None, 1), (6, [1.0, 0.0], 3),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.components(vectors).collect())
    # All that share a class or a link with a row of id 1 are its component; each row counts its own links.
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 1, False), (1, 1, 1, True), (5, 0, 5, True), (1, 0, 1, True), (6, 0, 6, True)])


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e-200, 1e-200], 1), (3, [5e-324, 5e-324], 1), (4, [1.7e308, -1.7e308], 1), (5, [-1e-300, 1e-300], 1), (6, [1e200, 1e-200], 1),
            (7, [1.0, 0.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.components(vectors).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 6)}


def test_rotation_balances_codes():
    random = np.random.default_rng(2)
    x = random.normal(size=(2000, 24)) @ np.diag(np.linspace(1, 5, 24))
    rotation = itq.Rotation(x, 24)
    assert np.allclose(rotation.matrix.T @ rotation.matrix, np.eye(24), atol=1e-8)
    assert np.abs(rotation.codes(x).mean(axis=0) - 0.5).max() < 0.08
