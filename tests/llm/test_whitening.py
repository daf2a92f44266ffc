import numpy as np
import pytest

from reclutark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def spectrum(values, seed=0):
    random = np.random.default_rng(seed)
    q = np.linalg.qr(random.normal(size=(len(values), len(values))))[0]
    return (q * np.array(values, dtype=float)) @ q.T


def brute(rows, wanted=32):
    """Eigenvalues and projector onto the components by a dense solver, and the exact numbers, in plain Python."""
    good = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in good], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * row - sums) ** 2)) for row in x]
    off = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x.tolist()], dtype=float)
    v = off.T @ off / n
    e, u = np.linalg.eigh(v)
    return n, deviation, off, e[::-1][:wanted], u[:, ::-1][:, :wanted], np.trace(v)


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1, 41), [5.0] * 12 + [1.0] * 30, [1e6, 1e-3, 1e-3, 0, 0], [1.0], np.logspace(3, -5, 64), [0, 0], [2, 2 + 1e-12, 2 - 1e-12, 1], 1 / np.arange(1, 130) ** 2,
        [1.0] * 40,
    ],
)
def test_components_against_a_dense_solver(values):
    matrix = spectrum(values)
    got, vectors = whitening.largest_components(matrix, 32)
    want = np.sort(values)[::-1][:32]
    want = want[want > whitening.NOISE * np.sum(values)]
    assert len(got) == len(want) and np.allclose(got, want, rtol=1e-9, atol=1e-13 * np.sum(values))
    assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-12)
    assert np.abs(matrix @ vectors - vectors * got).max(initial=0) <= 1e-12 * np.sum(values)


def test_negative_counts():
    random = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 33):
        for _ in range(20):
            a = random.normal(size=(n, n)) * random.choice([1, 0], size=(n, n), p=[0.6, 0.4])
            a = a + a.T
            e = np.linalg.eigvalsh(a)
            if np.abs(e).min() > 1e-9:
                assert whitening.negative_count(a) == (e < 0).sum()
    assert whitening.negative_count(np.zeros((4, 4))) == 0


def held(rows, got):
    n, deviation, off, e, u, trace = brute(rows)
    ids = [r[0] for r in rows if r[1] is not None and all(c is not None and np.isfinite(np.float32(c)) for c in r[1])]
    assert {(r.n, r.identity_error) for r in got} == {(n, got[0].identity_error)} and got[0].identity_error <= 1e-4
    w = np.zeros((n, max(r.component for r in got)))
    at = {i: k for k, i in enumerate(ids)}
    for r in got:
        w[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[at[r.vec_id]]
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9)
    assert len(got) == w.size
    want = off @ u[:, : w.shape[1]] / np.sqrt(e[: w.shape[1]])
    signs = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * signs).max() < 1e-6
    assert np.abs(w.T @ w / n - np.eye(w.shape[1])).max() <= 1e-4


def test_brute_force_on_the_table(table):
    vectors = table("embeddings", "/root/testdata/sf0.01")
    held([tuple(r) for r in vectors.collect()], whitening.whiten(vectors.repartition(5)).collect())


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    random = np.random.default_rng(5)
    rows = [(i, [float(c) for c in random.normal(size=3)], 1) for i in range(30)]
    bad = [(90, None, 1), (91, [nan, 1.0, 1.0], 1), (92, [inf, 1.0, 1.0], 1), (93, [None, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "'x' as component", "'y' as whitened", "1 as n")
    held(rows + bad, whitening.whiten(df).collect())
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.filter("vec_id >= 90")).collect() == []
    assert whitening.whiten(df.filter("vec_id = 3")).collect() == []  # no variance
    twice = df.filter("vec_id < 10").unionByName(df.filter("vec_id = 3").selectExpr("cast(null as long) as vec_id", "* except (vec_id)"))
    got = whitening.whiten(twice).collect()
    assert {r.n for r in got} == {11} and sum(r.vec_id is None for r in got) == 3
    same = {v: sorted((r.component, r.whitened, r.deviation) for r in got if r.vec_id == v) for v in (3, None)}
    assert same[3] == same[None]


def test_short_long_and_huge_vectors(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [1.0], 1), (3, [], 1), (4, [0.0, 5.0, 1e300], 1), (5, [1.0, 1.0, -1e300], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = whitening.whiten(df).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4, 5} and all(r.deviation is None for r in got if r.vec_id in (4, 5))
    small = whitening.whiten(df.filter("vec_id < 4")).collect()
    # (64, 128), (64, 0) and (0, 0), three times, less the sums (128, 128)
    assert {(r.vec_id, r.deviation) for r in small} == {(1, 64**2 + 256**2), (2, 64**2 + 128**2), (3, 128**2 + 128**2)}
