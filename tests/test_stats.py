import numpy as np
import pandas as pd
import pytest

from ratelab.operators import stats


def points(seed=0):
    rng = np.random.default_rng(seed)
    a = pd.DataFrame({"g": "a", "x": rng.normal(size=40).round(1), "y": rng.normal(size=40).round(1)})
    b = a.assign(g="b", y=a.x * 0.5 + rng.normal(size=40) * 0.1)
    return pd.concat([a, b], ignore_index=True)


@pytest.mark.parametrize("limit", [10**9, 8])
def test_spearman_with_ties(spark, limit):
    pdf = points()
    got = {r.g: (r.rho, r.n) for r in stats.spearman(spark.createDataFrame(pdf), ["g"], "x", "y", limit).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g][0] == pytest.approx(np.corrcoef(part.x.rank(), part.y.rank())[0, 1], abs=1e-12)
        assert got[g][1] == 40


def test_spearman_edges(spark):
    rows = [("const", 1.0, 1.0), ("const", 1.0, 2.0), ("const", 1.0, 3.0), ("two", 1.0, 5.0), ("two", 2.0, 4.0),
            ("hole", 1.0, 1.0), ("hole", 2.0, None), ("hole", 3.0, 3.0), ("up", 1.0, 1.0), ("up", 2.0, 2.0), ("up", 3.0, 9.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in stats.with_pvalue(stats.spearman(df, ["g"], "x", "y")).collect()}
    assert got["const"].rho is None and got["hole"].rho is None and got["hole"].p_value is None
    assert got["two"].rho == pytest.approx(-1) and got["two"].p_value is None
    assert got["up"].rho == pytest.approx(1) and got["up"].p_value == pytest.approx(0, abs=1e-6)


# Tabulated values of Student's t.
@pytest.mark.parametrize("df, quantile", [(1, 12.7062047), (2, 4.30265273), (5, 2.57058184), (10, 2.22813885), (30, 2.04227246), (120, 1.97993041), (1e6, 1.95996636)])
def test_student_quantile_and_tail(df, quantile):
    assert stats.student_quantile(0.975, np.array([df]))[0] == pytest.approx(quantile, rel=1e-7)
    assert stats.student_tail(np.array([quantile]), np.array([df]))[0] == pytest.approx(0.05, rel=1e-6)


def test_student_quantile_of_very_many_degrees():
    # Cornish-Fisher, exact to the places compared
    z, df = 1.959963984540054, np.array([2e2, 3e4, 1.2e5, 179_998.0, 1e6, 1e9])
    want = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)
    np.testing.assert_allclose(stats.student_quantile(0.975, df), want, rtol=1e-8)
    np.testing.assert_allclose(stats.student_tail(want, df), 0.05, rtol=1e-7)
    assert stats.student_tail(np.array([0.0, np.inf]), np.array([1e6, 1e6])).tolist() == pytest.approx([1.0, 0.0], abs=1e-14)


def test_student_tail_is_one_curve():
    t, at = np.array([0.01, 0.5, 1.96, 6.0, 40.0]), stats.MANY_DEGREES
    ends = [stats.student_tail(t, np.full(5, df)) for df in (at - 1e-6, at)]
    np.testing.assert_allclose(*ends, rtol=1e-4)
    np.testing.assert_allclose(ends[0][:3], ends[1][:3], rtol=1e-8)


def test_student_tail_closed_form():
    t = np.array([0.0, 0.3, 1.0, 8.0])
    np.testing.assert_allclose(stats.student_tail(t, np.full(4, 1.0)), 1 - 2 / np.pi * np.arctan(t), atol=1e-12)
    np.testing.assert_allclose(stats.student_tail(t, np.full(4, 2.0)), 1 - t / np.sqrt(2 + t * t), atol=1e-12)


def test_line_and_band(spark):
    pdf = points(2)
    df = spark.createDataFrame(pdf)
    line = {r.g: r for r in stats.ols_line(df, ["g"], "x", "y").collect()}
    band = stats.confidence_band(df, ["g"], "x", "y").toPandas()
    for g, part in pdf.groupby("g"):
        slope, intercept = np.polyfit(part.x, part.y, 1)
        resid = np.sqrt(((part.y - slope * part.x - intercept) ** 2).sum() / 38)
        assert line[g].slope == pytest.approx(slope) and line[g].intercept == pytest.approx(intercept)
        assert line[g].residual_sd == pytest.approx(resid)
        b = band[band.g == g].sort_values("point")
        grid = np.linspace(part.x.min() - 0.005, part.x.max() + 0.005, 200)
        se = resid * np.sqrt(1 / 40 + (grid - part.x.mean()) ** 2 / ((part.x - part.x.mean()) ** 2).sum())
        np.testing.assert_allclose(b.x, grid)
        np.testing.assert_allclose(b.high - b.fit, 2.024394164 * se, rtol=1e-7)
        np.testing.assert_allclose(b.fit - b.low, b.high - b.fit)


def test_line_through_too_few_points(spark):
    df = spark.createDataFrame([("two", 1.0, 1.0), ("two", 2.0, 3.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 4.0)], "g string, x double, y double")
    got = {r.g: r for r in stats.ols_line(df, ["g"], "x", "y").collect()}
    assert got["two"].slope == 2 and got["two"].residual_sd is None and got["flat"].slope is None
    assert stats.confidence_band(df, ["g"], "x", "y").count() == 0


def test_tail_of_very_many_degrees_and_of_a_fraction_that_does_not_settle(monkeypatch):
    from ratelab.operators import stats

    import numpy as np
    import pytest

    # beyond a million degrees the distribution is normal to six places
    assert abs(stats.student_tail(np.array([1.959963984540054]), np.array([5e6]))[0] - 0.05) < 1e-6
    with pytest.raises(ArithmeticError):
        stats._beta_fraction(np.array([1e3]), np.array([0.5]), np.array([0.99999999]))
