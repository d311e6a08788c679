import numpy as np
import pandas as pd
import pytest

from tidewright.functions.quantiles import exact_quantiles, with_quantiles


@pytest.mark.parametrize("accuracy, most", [(100, 100_000), (10_000, 100_000), (100, 40), (1000, 3)])
def test_equals_numpy_on_a_hot_group_with_ties(spark, accuracy, most):
    rng = np.random.default_rng(0)
    hot = np.round(np.concatenate([rng.normal(0, 1, 15_000), np.full(8_000, 0.25), rng.pareto(1.2, 7_000)]), 3)
    small = rng.normal(5, 2, 37)
    pdf = pd.DataFrame({"k": ["hot"] * len(hot) + ["small"] * len(small) + ["none"] * 2, "v": [*hot, *small, None, None]})
    assert len(set(hot)) > 5000
    df = spark.createDataFrame(pdf.replace({np.nan: None}), "k string, v double").repartition(8)
    probs = {"p0": 0.0, "p1": 0.01, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    rows = {r.k: r for r in exact_quantiles(df, ["k"], {n: ("v", p) for n, p in probs.items()}, accuracy, most).collect()}
    for name, values in (("hot", hot), ("small", small)):
        for column, p in probs.items():
            assert rows[name][column] == pytest.approx(np.quantile(values, p), abs=1e-12)
    assert "none" not in rows
    kept = {r.k: r.p50 for r in with_quantiles(df, ["k"], {"p50": ("v", 0.5)}, accuracy).select("k", "p50").distinct().collect()}
    assert kept["none"] is None and kept["small"] == pytest.approx(np.median(small))


def test_without_keys(spark):
    df = spark.range(1, 11).toDF("v")
    row = exact_quantiles(df, [], {"q": ("v", 0.95)}).first()
    assert row.q == pytest.approx(9.55)
