import numpy as np

from tonearm.operators import filters


def _frame(spark, x):
    return spark.createDataFrame([("a", k, int(v)) for k, v in enumerate(x)], "s string, frame_idx bigint, sample bigint")


def test_recursive_filter_in_chunks(spark):
    x = np.random.default_rng(1).integers(-1000, 1000, 700)
    b, a = filters.high_pass(8000, 900)
    want = filters.recursive(x.astype(float), b, a)
    got = {r.frame_idx: r.value for r in filters.filtered(_frame(spark, x), "s", b, a, chunk=128, warm_up=96).collect()}
    assert len(got) == 700 and max(abs(got[k] - want[k]) for k in range(700)) < 1e-6


def test_resampler(spark):
    t = np.arange(900)
    x = np.round(10000 * np.sin(2 * np.pi * 0.03 * t))
    got = {r.frame_idx: r.value for r in filters.resampled(_frame(spark, x), "s", 441, 480, chunk=256).collect()}
    assert len(got) == 900 * 480 // 441
    want = 10000 * np.sin(2 * np.pi * 0.03 * np.arange(len(got)) * 441 / 480)
    assert max(abs(got[k] - want[k]) for k in range(80, len(got) - 80)) < 30
    one = {r.frame_idx: r.value for r in filters.resampled(_frame(spark, x), "s", 441, 480, chunk=4096).collect()}
    assert max(abs(got[k] - one[k]) for k in got) < 1e-6


def test_prediction(spark):
    x = np.random.default_rng(2).normal(size=500)
    for k in range(2, 500):
        x[k] += 1.2 * x[k - 1] - 0.5 * x[k - 2]
    r = np.array([np.dot(x[: 500 - k], x[k:]) for k in range(5)])
    a, error = filters.levinson(r, 4)
    matrix = np.array([[r[abs(i - j)] for j in range(4)] for i in range(4)])
    assert np.allclose(a, np.linalg.solve(matrix, r[1:])) and 0 < error < r[0]
    rows = filters.predictors(spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(r)] + [("silent", 0, 0.0)], "s string, lag int, r double"), "s", 4).collect()
    assert all(abs(q.quantized / (1 << q.shift) - q.coefficient) < 0.01 for q in rows) and len(rows) == 8
