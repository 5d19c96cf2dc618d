import numpy as np
import pandas as pd

from barloom.operators import scoring


def brute(pdf, temperature):
    out = []
    for _, part in pdf.groupby("date", dropna=False):
        x = part["x"].to_numpy()
        z = np.where(x[:, None] == x[None, :], 0.0, x[:, None] - x[None, :]) / temperature
        out.append(pd.Series((0.5 * (1 + np.tanh(0.5 * z))).sum(axis=1), part.index))
    return pd.concat(out).sort_index()


def test_curves_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    spread = [rng.normal(size=700), np.round(rng.normal(size=500), 1), np.exp(rng.normal(0, 4, 600)), 1e9 + rng.normal(size=200), rng.normal(0, 1e17, 40),
              np.full(50, 3.25), rng.uniform(0, 3000, 4000)]
    pdf = pd.DataFrame({"date": np.repeat([f"d{i}" for i in range(len(spread))], [len(x) for x in spread]), "x": np.concatenate(spread)})
    pdf.loc[pdf["date"] == "d3", "date"] = None
    pdf["id"] = np.arange(len(pdf))
    rows = spark.createDataFrame(pdf).repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for temperature, batch in ((0.1, "10000"), (0.1, "50"), (0.37, "7")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = scoring.soft_rank(rows, ["x"], temperature).toPandas().sort_values("id")["soft_rank_x"].to_numpy()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        want = brute(pdf, temperature).to_numpy()
        assert (np.abs(got - want) <= 1e-10 * np.maximum(want, 1)).all()


def test_infinite_values_and_two_columns(spark):
    pdf = pd.DataFrame({"date": 1, "id": range(4), "x": [float("-inf"), 0.0, 0.1, float("inf")], "z": [0.0, 0.2, 0.1, 0.3]})
    got = scoring.soft_rank(spark.createDataFrame(pdf), ["x", "z"]).toPandas().sort_values("id")
    s = 1 / (1 + np.exp(-1))
    x = got["soft_rank_x"].to_numpy()
    assert np.isnan(x[[0, 3]]).all() and np.allclose(x[1:3], [1 + 0.5 + 1 - s, 1 + 0.5 + s], atol=1e-12)
    assert np.allclose(got["soft_rank_z"], brute(pdf.rename(columns={"x": "_", "z": "x"}), 0.1), atol=1e-12)


def test_no_task_holds_a_key(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 0.6)], "date int, x double")
    plan = scoring.soft_rank(rows, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan
