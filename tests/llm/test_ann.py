import numpy as np
import pytest

from braidgraph.llm import ann


def brute(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, x in ok:
        if q % 100 == 0:
            near = sorted((float(ann.distances(x[None], y[None])[0]), i) for i, y in ok if i != q and len(x) == len(y))[:k]
            out |= {(q, r, i, d) for r, (d, i) in enumerate(near, 1)}
    return out


def test_exact(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert set(map(tuple, ann.nearest(vectors).collect())) == brute(rows)


def test_grid_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP", 40)
    monkeypatch.setattr(ann, "TILE", 16)
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.integers(-2, 3, 6).astype(float).tolist()) for i in range(0, 1000, 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert set(map(tuple, ann.nearest(df).collect())) == brute(rows)


def test_bounds_hold():
    """The rounded product is never farther from the true one than the bound says."""
    rnd = np.random.default_rng(6)
    for scale in (1e-6, 1.0, 1e5):
        x, y = rnd.normal(size=(50, 64)) * scale, rnd.normal(size=(80, 64)) * scale * rnd.exponential(size=(80, 1))
        (a, s, n, e), (b, t, m, f) = ann.rounded(x), ann.rounded(y)
        dot = (a.astype(float) @ b.astype(float).T) * s[:, None] * t[None]
        assert (np.abs(dot - x @ y.T) <= n[:, None] * f[None] + e[:, None] * (m + f)[None] + 1e-12 * scale**2).all()


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few(spark, n):
    rows = [(i * 100, [1.0, float(i)]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert set(map(tuple, ann.nearest(df).collect())) == brute(rows)


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, None), (200, []), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, [None, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0, 1.0]), (-100, [5.0, 5.0]), (4, [1e30, 1e-30])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, id int, score string")
    assert set(map(tuple, ann.nearest(df).collect())) == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    twice = spark.createDataFrame([(0, [1.0, 2.0])] * 2 + [(1, [2.0, 2.0])] * 2 + [(0, [1.0, 5.0])], "vec_id bigint, embedding array<float>")
    got = sorted(map(tuple, ann.nearest(twice).collect()))
    near = [(0, 1, 0, 0.0), (0, 2, 1, 1.0), (0, 3, 1, 1.0), (0, 4, 0, 3.0)]  # of the row that occurs twice
    far = [(0, 1, 0, 3.0), (0, 2, 0, 3.0), (0, 3, 1, 10**0.5), (0, 4, 1, 10**0.5)]
    assert got == sorted(near + far)
    none = twice.where("vec_id = 7")
    assert ann.nearest(none).count() == 0 and ann.nearest(none).columns == ["query_id", "rank", "vec_id", "score"]


def test_far_and_close(spark):
    """Squares that overflow or vanish lose no neighbour."""
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [-1e200, 0.0]), (100, [1e-200, 0.0]), (3, [3e-200, 0.0]), (4, [-1e-200, 5e-201]), (5, [1.0, 1.0]), (200, [1.7e308, 1.7e308]), (6, [-1.7e308, -1.7e308])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: len(x) for q, x in by.items()} == {0: 8, 100: 8, 200: 8}
    assert by[0][0] == 1 and by[100][:2] == [3, 4] or by[100][:2] == [4, 3]
    score = {(r.query_id, r.vec_id): r.score for r in got}
    assert score[0, 2] == pytest.approx(2e200) and score[100, 3] == pytest.approx(2e-200) and score[0, 1] == 1.0


def test_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP_NUMBERS", 3000)
    rnd = np.random.default_rng(8)
    rows = [(i * 50, rnd.normal(size=300).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert set(map(tuple, ann.nearest(df).collect())) == brute(rows)
