"""The fit of the cell model: its end point by brute force, by the SQL of its check, and odd inputs."""

import duckdb
import numpy as np
import pytest

from perimeter.config import FUEL_CODES
from perimeter.operators import scoring as M
from perimeter.plans.queries.fitted import newton_views

CLASSES = len(FUEL_CODES) + 1


def cells(n=3000, seed=5):
    rng = np.random.default_rng(seed)
    x, fuel = rng.normal(size=(n, 3)), rng.integers(0, 6, n)
    x[:, 2] += 0.7 * x[:, 0]
    y = rng.random(n) < 1 / (1 + np.exp(-(x @ [1.5, -0.8, 0.2] + 0.4 * fuel - 3)))
    return x, fuel, y


def frame(spark, x, fuel, y):
    rows = [(*map(float, a), int(f), bool(t)) for a, f, t in zip(x, fuel, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, fuel_idx int, target boolean")


def slope(x, fuel, y, weight, at):
    """Gradient of the objective, from its definition."""
    full = np.hstack((np.ones((len(x), 1)), x, np.eye(CLASSES)[fuel]))
    w = np.where(y, weight, 1.0)
    p = 1 / (1 + np.exp(-(full @ at)))
    return full.T @ (w * (p - y)) / w.sum() + M.RIDGE * np.r_[0, at[1:]]


def flat(model):
    return np.array([model.intercept, *model.weights.values(), *model.fuel])


def test_the_fit_ends_where_the_gradient_is_zero(spark):
    x, fuel, y = cells()
    model = M.fit_cells(frame(spark, x, fuel, y), "abc", 4.0)
    assert model.slope < 1e-9 and np.abs(slope(x, fuel, y, 4.0, flat(model))).max() < 1e-10
    assert all(w == 0 for w in model.fuel[6:])  # classes without cells


def test_nearly_separable_cells_need_halved_steps(spark):
    x, fuel, _ = cells(400)
    y = x[:, 0] > 1.9
    model = M.fit_cells(frame(spark, 30 * x, fuel, y), "abc", 50.0)
    assert np.abs(slope(30 * x, fuel, y, 50.0, flat(model))).max() < 1e-8


def test_sql_fit_agrees(spark):
    x, fuel, y = cells()
    model = M.fit_cells(frame(spark, x, fuel, y), "abc", 4.0)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (f INTEGER, y DOUBLE, w DOUBLE, x0 DOUBLE, x1 DOUBLE, x2 DOUBLE, x3 DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, 1, ?, ?, ?)", [(int(f), float(t), 4.0 if t else 1.0, *map(float, a)) for a, f, t in zip(x, fuel, y)])
    parts = [f"{n} AS ({s})" for n, s in newton_views("t", 4, CLASSES)]
    b, u = con.execute("WITH RECURSIVE " + ", ".join(parts) + " SELECT b, u FROM v_coef").fetchone()
    assert np.allclose(np.array([*b, *u]), flat(model), atol=1e-9)


def test_nulls_repeats_and_no_cells(spark):
    x, fuel, y = cells(300)
    df = frame(spark, x, fuel, y)
    odd = df.selectExpr("CAST(NULL AS double) AS a", "b", "c", "fuel_idx", "target").unionByName(
        df.selectExpr("a", "b", "c", "CAST(NULL AS int) AS fuel_idx", "target")).unionByName(df.selectExpr("a", "b", "c", "fuel_idx", "CAST(NULL AS boolean) AS target"))
    want = flat(M.fit_cells(df, "abc", 2.0))
    assert np.allclose(flat(M.fit_cells(df.unionByName(odd), "abc", 2.0)), want, atol=1e-9)
    assert np.allclose(flat(M.fit_cells(df.unionByName(df), "abc", 2.0)), want, atol=1e-9)  # a mean, so repeats change nothing
    assert not flat(M.fit_cells(df.limit(0), "abc", 2.0)).any()
    with pytest.raises(RuntimeError, match="no minimum"):
        M.fit_cells(df, "abc", 2.0, most=2)
