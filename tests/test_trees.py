"""Boosted trees per key: both ways of growing agree, single trees equal brute force, keys do not see each other."""

import numpy as np
import pytest

from tidewright.operators import trees

KEYS = ["station_id"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for station, sign in (("a", 1.0), ("b", -1.0)):
        x = np.round(rng.normal(size=(300, 3)), 3)
        y = sign * np.where(x[:, 0] > 0.2, 1.0, -0.5) + 0.3 * x[:, 1] + 0.01 * rng.normal(size=300)
        out += [(station, i, x[i].tolist(), float(y[i])) for i in range(300)]
    out += [("a", 900, [1.0, None, 0.0], 5.0), ("b", 901, [1.0, float("nan"), 0.0], 5.0), ("b", 902, [1.0, 0.0, 0.0], None)]
    return spark.createDataFrame(out, "station_id string, i int, features array<double>, label double")


def told(models):
    return {r.station_id: (r.base, r.trees, r.train_rows) for r in models.collect()}


def test_both_ways_grow_the_same_trees(rows):
    options = dict(rounds=3, depth=2, bins=16, rate=0.3)
    local = told(trees.fit(rows, KEYS, ["i"], **options))
    spread = told(trees.fit(rows.repartition(5), KEYS, ["i"], most=10, **options))
    assert local == spread and {v[2] for v in local.values()} == {300}


def test_a_stump_is_the_best_cut(rows):
    models = told(trees.fit(rows, KEYS, ["i"], rounds=1, depth=1, rate=1.0, rows=1.0, columns=1.0, bins=16))
    for station in ("a", "b"):
        data = [(r.features, r.label) for r in rows.where(f"station_id = '{station}' and i < 300").collect()]
        x, y = np.array([d[0] for d in data]), np.array([d[1] for d in data])
        res, best = y - y.mean(), (-1.0, None)
        for f in range(3):
            ranked = np.sort(x[:, f])
            for e in sorted({ranked[int(np.ceil(k / 16 * len(x))) - 1] for k in range(1, 16)}):
                left = x[:, f] <= e
                if left.all():
                    continue
                gain = res[left].sum() ** 2 / (left.sum() + 1) + res[~left].sum() ** 2 / ((~left).sum() + 1) - res.sum() ** 2 / (len(x) + 1)
                if gain > best[0]:
                    best = (gain, f, e, res[left].sum() / (left.sum() + 1), res[~left].sum() / ((~left).sum() + 1))
        tree = models[station][1][0]
        assert tree.feature[0] == best[1] and tree.cut[0] == best[2]
        assert np.allclose(tree.value[1:], best[3:], atol=1e-6)


def test_ensembles_learn_their_own_key_and_apply_to_raw_features(rows):
    clean = rows.where("i < 300")
    made = trees.predict(clean, trees.fit(clean, KEYS, ["i"], rounds=60, rate=0.2), KEYS).collect()
    error = np.array([r.predicted_m - r.label for r in made])
    spread = np.array([r.label for r in made])
    assert len(made) == 600 and error.std() < 0.2 * spread.std()


def test_no_rows_no_models(rows):
    assert trees.fit(rows.limit(0), KEYS, ["i"], rounds=2).collect() == []
