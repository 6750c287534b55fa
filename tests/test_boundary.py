import numpy as np
import pandas as pd
import pytest

from gridloom.operators import boundary
from gridloom.operators.boundary import OneClassMachine, fit_one_class, kernel, one_class_flags, solve


def _project(v, total):
    """Nearest point with entries in 0..1 and the given sum, by halving the shift."""
    lo, hi = v.min() - 1.0, v.max()
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(v - mid, 0, 1).sum() > total else (lo, mid)
    return np.clip(v - (lo + hi) / 2, 0, 1)


@pytest.mark.parametrize("nu", [0.1, 0.33, 1.0])
def test_solution_is_the_least(nu):
    """Against projected gradient steps; copies and a far row among the rows."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(40, 3)), np.zeros((6, 3)), [[9.0, 9.0, 9.0]]])
    k = kernel(x, x, 1 / 3)
    weight, rho = solve(x, nu, 1 / 3, 1e-7)
    plain = _project(np.full(len(x), nu), nu * len(x))
    for _ in range(4000):
        plain = _project(plain - 0.03 * (k @ plain), nu * len(x))
    assert weight.sum() == pytest.approx(nu * len(x)) and weight.min() >= 0 and weight.max() <= 1
    assert weight @ k @ weight == pytest.approx(plain @ k @ plain, rel=1e-5)
    slope = k @ weight
    assert (slope[weight < 1] >= rho - 1e-6).all() and (slope[weight > 0] <= rho + 1e-6).all()


def test_conditions_hold_on_a_full_sample():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(boundary.SAMPLE, 8))
    weight, rho = solve(x, 0.05, 1 / 8)
    slope = kernel(x, x[weight > 0], 1 / 8) @ weight[weight > 0]
    assert slope[weight > 0].max() - slope[weight < 1].min() <= 1.01 * boundary.TOLERANCE
    assert abs((slope < rho).mean() - 0.05) < 0.005


def test_flags_stored_machine_and_odd_rows(spark, folder):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(900, 2)), rng.normal(8, 0.5, size=(9, 2))])
    frame = pd.DataFrame(x, columns=["a", "b.c"]).assign(id=range(len(x)), _key=1)
    rows = [tuple(r) for r in frame.itertuples(index=False)]
    rows += [(None, 1.0, 909, 1), (float("nan"), 1.0, 910, 1), (float("inf"), 0.0, 911, 1)]
    df = spark.createDataFrame(rows, "a double, `b.c` double, id long, _key int").repartition(5)
    out = {r["id"]: r for r in one_class_flags(df, "id", ["a", "b.c"], 0.05).collect()}
    machine = fit_one_class(df, "id", ["a", "b.c"], 0.05)
    weight, rho = solve(x, 0.05, 0.5)
    want = kernel(x, x, 0.5) @ weight - rho
    assert len(out) == 912 and out[0]["_key"] == 1
    assert all(out[i]["ocsvm_score"] == pytest.approx(want[i], abs=1e-9) for i in range(909))
    assert all(out[i]["ocsvm_anomaly"] == int(want[i] < 0) for i in range(909))
    assert all(out[i]["ocsvm_score"] is None and out[i]["ocsvm_anomaly"] is None for i in (909, 910, 911))
    assert abs(np.mean([out[i]["ocsvm_anomaly"] for i in range(909)]) - 0.05) < 0.02
    machine.save(spark, folder)
    again = OneClassMachine.load(spark, folder)
    assert again.columns == machine.columns and np.array_equal(again.vectors, machine.vectors)
    scored = {r["id"]: r["s"] for r in df.withColumn("s", again.score(df)).collect()}
    assert all(scored[i] == out[i]["ocsvm_score"] for i in out)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, a double")
    assert one_class_flags(df, "id", ["a"]).collect() == []
