import math

import numpy as np
import pytest

from tidemark.functions import forecast as S


def test_minimise():
    assert S.minimise(lambda x: (x - 3) ** 2 + 1, 1.0) == pytest.approx(3, abs=1e-2)
    assert S.minimise(lambda x: math.cosh(x + 2), 5.0) == pytest.approx(-2, abs=5e-2)
    assert S.minimise(lambda x: 4.0, 1.0) == 1.0


def test_level_filter_by_hand():
    """y = 1, 3, missing, 2 with ratio q = 0.5: gains p / (p + 1)."""
    y, q = np.array([1.0, 3.0, math.nan, 2.0]), 0.5
    squares, logs, levels, spread = S._level_pass(y, q, keep=True)
    p0 = 1.5
    k1 = p0 / (p0 + 1)
    a1, p1 = 1 + k1 * 2, k1 + q
    p2 = p1 + q
    k3 = p2 / (p2 + 1)
    assert levels == pytest.approx([1, a1, a1, a1 + k3 * (2 - a1)])
    assert spread == pytest.approx([p0, p1, p2, k3 + q])
    assert squares == pytest.approx(4 / (p0 + 1) + (2 - a1) ** 2 / (p2 + 1))
    assert logs == pytest.approx(math.log(p0 + 1) + math.log(p1 + 1) + math.log(p2 + 1))


def test_shapes_and_trend():
    y = np.arange(1.0, 21.0)
    for name, period in (("LL", 0), ("LLT", 0), ("LLP", 3), ("LLP5", 3), ("LLP5", 0)):
        f = S.fit(name, y, period, 4)
        assert len(f.state) == len(f.var) == 24 and np.isfinite(f.state).all() and (f.var >= 0).all()
    assert S.trend(y, 3).state[-1] == pytest.approx(23, abs=1e-6)
    flat = S.level(np.array([math.nan, 5.0, 5.0, 5.0]), 2)
    assert math.isnan(flat.state[0]) and flat.state[-1] == 5.0
    long = S.level_in_pieces(np.sin(np.arange(4500.0)), 5)
    assert len(long.state) == 4505 and np.isfinite(long.state).all()
    with pytest.raises(ValueError):
        S.trend(np.array([1.0]), 2)


def test_period():
    assert S.find_period(np.tile([1.0, 2.0, 3.0, 9.0], 12)) == 4
    assert S.find_period(np.ones(20)) == -1
    gaps = np.tile([1.0, 2.0, 3.0, 9.0], 12)
    gaps[3] = math.nan
    assert S.find_period(gaps) == 4
    periodic = S.periodic(np.array([math.nan, 2.0, 3.0, 1.0, 2.0, 3.0]), 3, 3)
    assert np.isfinite(periodic.state).all()


def test_trend_vector(spark):
    """A published input and its trend forecast, to the optimiser's tolerance."""
    from tidemark.operators.predict import predict

    counts = [4991.0, 5804.0, 5847.0, 5578.0, 5552.0, 5414.0, 5747.0, 599.0]
    want = [4991.0, 5804.0, 5477.298068047165, 5479.23770444985, 5499.003019533617, 5358.135655380545, 5772.073516337712, 42.02676356023676, -482.0252994484413, -1006.0773624571193, -1530.1294254657973, -2054.1814884744754, -2578.2335514831534]
    times = ["2025-12-30T00:00:00.000+0800", "2025-12-31T00:00:00.000+0800", *(f"2026-01-0{i}T00:00:00.000+0800" for i in range(1, 7))]
    df = spark.createDataFrame(list(zip(times, counts, strict=True)), "_time string, count double")
    rows = predict(df, "count", algorithm="LLT", future_timespan=7, mode="model").orderBy("_time").collect()
    assert len(rows) == 15
    assert [r["prediction_count"] for r in rows][: len(want)] == pytest.approx(want, rel=1e-3)
