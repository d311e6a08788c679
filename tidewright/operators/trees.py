"""Gradient-boosted regression trees, one ensemble per key, grown from histograms of gradients.

Features are cut once into quantile bins. A level of a tree then needs, for every node, feature and bin, only the sum of
the residuals and the number of rows; the best cut of a node maximises the drop of the penalised squared error, and a leaf
gives ``rate * G / (n + penalty)``. Residuals enter as whole numbers of a unit fixed per key, so sums are exact, and trees do
not depend on how rows are dealt out or on which of two ways grew them:

* a key of at most ``most`` training rows is one group, its bins one byte matrix in one task;
* for larger keys every level is one aggregation: tasks sum histograms of their rows, Spark adds them per (key, node,
  feature, bin), and one small group per key chooses its cuts. Rows stay where they are; predictions are written every
  ``HOLD`` rounds, so lineage stays short and a lost executor costs one level.

Rows and features of a round are drawn by hashes, which retries cannot change.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.storage import stored

# Usual settings of the boosted corrections.
ROUNDS, DEPTH, RATE, ROWS, COLUMNS, PENALTY, SEED = 300, 4, 0.05, 0.8, 0.7, 1.0, 42
BINS = 64
MOST = 200_000
HOLD = 10
_UNITS = 30  # bits of a residual: sums of MOST of them stay whole in a double
_TREE = "array<struct<feature:array<int>,cut:array<double>,value:array<double>>>"


def _drawn(row: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """Rows of one round, by a hash of row and round."""
    if share >= 1:
        return np.ones(len(row), bool)
    with np.errstate(over="ignore"):
        h = (row.view(np.uint64) + np.uint64(seed * 1_000_003 + number + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def _columns(width: int, seed: int, number: int, share: float) -> np.ndarray:
    """Features of one round."""
    keep = max(1, int(np.ceil(width * share)))
    return np.sort(np.random.default_rng([seed, number]).permutation(width)[:keep])


def _histogram(bins: np.ndarray, node: np.ndarray, units: np.ndarray, nodes: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Residual sums and row counts by (node, feature, bin)."""
    width = bins.shape[1]
    place = ((node[:, None] * width + np.arange(width)) * size + bins).ravel()
    shape = (nodes, width, size)
    sums = np.bincount(place, np.repeat(units.astype(np.float64), width), nodes * width * size)
    return sums.reshape(shape), np.bincount(place, minlength=nodes * width * size).reshape(shape)


def _best_cuts(sums: np.ndarray, counts: np.ndarray, penalty: float, unit: float) -> list[tuple[int, int]]:
    """(feature, bin) per node, the first of the best in order; (-1, -1) where no cut lowers the error."""
    out = []
    for g, n in zip(sums, counts):
        left_g, left_n = np.cumsum(g, axis=1)[:, :-1] * unit, np.cumsum(n, axis=1)[:, :-1]
        all_g, all_n = g.sum(1, keepdims=True) * unit, n.sum(1, keepdims=True)
        right_g, right_n = all_g - left_g, all_n - left_n
        gain = left_g**2 / (left_n + penalty) + right_g**2 / (right_n + penalty) - all_g**2 / (all_n + penalty)
        gain[(left_n == 0) | (right_n == 0)] = -np.inf
        best = int(np.argmax(gain)) if gain.size else 0
        good = gain.size and gain.flat[best] > 1e-15
        out.append(tuple(int(x) for x in np.unravel_index(best, gain.shape)) if good else (-1, -1))
    return out


def _grow(bins: np.ndarray, goal: np.ndarray, row: np.ndarray, base: float, unit: float, size: int, p: dict) -> list[tuple]:
    """All trees of one key in one task, as heaps (feature, bin, value)."""
    made, trees = np.full(len(goal), base), []
    heap = 2 ** (p["depth"] + 1) - 1
    for number in range(p["rounds"]):
        units = np.rint((goal - made) / unit)
        drawn, chosen = _drawn(row, p["seed"], number, p["rows"]), _columns(bins.shape[1], p["seed"], number, p["columns"])
        feature, cut, value = np.full(heap, -1, np.int32), np.full(heap, -1, np.int32), np.zeros(heap)
        node = np.zeros(len(goal), np.int64)
        for level in range(p["depth"] + 1):
            first, many = 2**level - 1, 2**level
            here = drawn & (node >= first)
            if level == p["depth"]:
                sums, counts = np.bincount(node[here] - first, units[here], many), np.bincount(node[here] - first, minlength=many)
                value[first:] = p["rate"] * sums * unit / (counts + p["penalty"])
                break
            sums, counts = _histogram(bins[here][:, chosen], node[here] - first, units[here], many, size)
            value[first:first + many] = p["rate"] * sums[:, 0].sum(1) * unit / (counts[:, 0].sum(1) + p["penalty"])
            for k, (f, b) in enumerate(_best_cuts(sums, counts, p["penalty"], unit)):
                if f >= 0:
                    feature[first + k], cut[first + k] = chosen[f], b
                    at = np.flatnonzero(node == first + k)
                    node[at] = 2 * (first + k) + 1 + (bins[at, chosen[f]] > b)
        made = made + value[node]
        trees.append((feature, cut, value))
    return trees


def _told(trees: list[tuple], edges: list[np.ndarray]) -> list[dict]:
    """Trees with cuts in units of their features."""
    return [{"feature": f.tolist(), "cut": [float(edges[i][b]) if i >= 0 else None for i, b in zip(f, c)], "value": v.tolist()} for f, c, v in trees]


def fit(
    df: DataFrame, keys: Sequence[str], row: Sequence[str], features: str = "features", target: str = "label", rounds: int = ROUNDS,
    depth: int = DEPTH, rate: float = RATE, rows: float = ROWS, columns: float = COLUMNS, penalty: float = PENALTY, bins: int = BINS,
    seed: int = SEED, most: int = MOST,
) -> DataFrame:
    """``keys, base, trees, train_rows``: one ensemble per key, for :func:`predict`.

    ``row`` are columns that tell the rows of a key apart. Rows with a missing or non-finite entry do not count. ``most`` decides
    which way a key is grown, never its trees.
    """
    names, p = list(keys), {"rounds": rounds, "depth": depth, "rate": rate, "rows": rows, "columns": columns, "penalty": penalty, "seed": seed}
    bad = F.exists(features, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    goal = F.col(target).cast("double")
    known = df.where(~bad & goal.isNotNull() & ~F.isnan(goal) & (F.abs(goal) < float("inf")))
    known = stored(known.select(*names, F.xxhash64(*row).alias("_row"), F.col(features).cast("array<double>").alias("_x"), goal.alias("_y")), "tree-rows")
    width = known.agg(F.max(F.size("_x"))).first()[0] or 1
    marks = [k / bins for k in range(1, bins)]
    edges = F.array(*(F.array_distinct(F.percentile_approx(F.get("_x", F.lit(i)), marks, 1_000_000)) for i in range(width)))
    spread = F.max(F.abs("_y"))
    unit = F.when(spread > 0, F.pow(F.lit(2.0), F.ceil(F.log2(spread)) + 1 - _UNITS)).otherwise(1.0)
    heads = stored(known.groupBy(*names).agg(F.count("*").alias("train_rows"), (F.sum(F.col("_y").cast("decimal(28,12)")).cast("double") / F.count("*")).alias("base"), unit.alias("unit"), edges.alias("edges")), "tree-heads")
    out = T.StructType([*(heads.schema[k] for k in names), T.StructField("base", T.DoubleType()),
                        *T.StructType.fromDDL(f"trees {_TREE}").fields, T.StructField("train_rows", T.LongType())])

    def whole(rows: pa.Table, head: pa.Table) -> pa.Table:
        cuts = [np.array(e, float) for e in head["edges"][0].as_py()]
        x = rows["_x"].combine_chunks().flatten().to_numpy().reshape(-1, len(cuts))
        order = np.argsort(rows["_row"].to_numpy(), kind="stable")
        binned = np.stack([np.searchsorted(e, x[order, i]) for i, e in enumerate(cuts)], axis=1).astype(np.uint8)
        trees = _grow(binned, rows["_y"].to_numpy()[order], rows["_row"].to_numpy()[order], head["base"][0].as_py(), head["unit"][0].as_py(), bins, p)
        told = _told(trees, cuts)
        return pa.table({**{k: head[k] for k in names}, "base": head["base"], "trees": pa.array([told], _arrow_trees()), "train_rows": head["train_rows"]})

    small = heads.where(F.col("train_rows") <= most)
    found = known.join(small.select(*names), names, "left_semi").groupBy(*names).cogroup(small.groupBy(*names)).applyInArrow(whole, out)
    large = heads.where(F.col("train_rows") > most)
    return found if large.isEmpty() else found.unionByName(_level_by_level(known, large, names, width, bins, p))


def _arrow_trees() -> pa.DataType:
    return pa.list_(pa.struct([("feature", pa.list_(pa.int32())), ("cut", pa.list_(pa.float64())), ("value", pa.list_(pa.float64()))]))


def _leaf(tree: Column, depth: int, goes_left) -> Column:
    """Heap place where a row ends: ``goes_left(feature, place)`` decides at each cut."""
    def step(place: Column, _: Column) -> Column:
        feature = F.get(tree["feature"], place)
        return F.when(feature < 0, place).otherwise(2 * place + F.when(goes_left(feature, place), F.lit(1)).otherwise(F.lit(2)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def predict(df: DataFrame, models: DataFrame, keys: Sequence[str], features: str = "features", name: str = "predicted_m") -> DataFrame:
    """``df`` with the forecast of its key's ensemble; expressions only. Rows of a key without a model are left out."""
    def one(total: Column, tree: Column) -> Column:
        depth = F.floor(F.log2(F.size(tree["value"]) + F.lit(0.5))).cast("int")  # a heap of 2 ** (depth + 1) - 1 places

        def step(place: Column, _: Column) -> Column:
            feature = F.get(tree["feature"], place)
            left = F.get(F.col(features), feature) <= F.get(tree["cut"], place)
            return F.when(feature < 0, place).otherwise(2 * place + F.when(left, F.lit(1)).otherwise(F.lit(2)))

        return total + F.get(tree["value"], F.aggregate(F.sequence(F.lit(1), depth), F.lit(0), step))

    value = F.aggregate("_trees", F.col("_base"), one)
    heads = models.select(*keys, F.col("base").alias("_base"), F.col("trees").alias("_trees"))
    return df.join(heads, list(keys)).withColumn(name, value).drop("_base", "_trees")


# --- keys with more rows than one task should hold ----------------------------------------------------------------------


def _level_by_level(known: DataFrame, heads: DataFrame, names: list[str], width: int, size: int, p: dict) -> DataFrame:
    depth, heap = p["depth"], 2 ** (p["depth"] + 1) - 1
    binned = F.transform("_x", lambda x, i: F.size(F.filter(F.get("edges", i), lambda e: e < x)).cast("short"))
    state = stored(known.join(heads, names).select(*names, "_row", "_y", "unit", binned.alias("_bins"), F.col("base").alias("_made")), "tree-state")
    whole_tree = "array<struct<feature:array<int>,cut:array<int>,value:array<double>>>"
    held = heads.select(*names, F.array().cast(whole_tree).alias("_recent"))
    grown: list[DataFrame] = []

    def place(tree: Column) -> Column:
        return _leaf(tree, depth, lambda feature, at: F.get("_bins", feature) <= F.get(tree["cut"], at))

    def now(rows: DataFrame) -> Column:
        return F.aggregate("_recent", F.col("_made"), lambda s, t: s + F.get(t["value"], place(t)))

    schema = T.StructType([*(known.schema[k] for k in names), *T.StructType.fromDDL("node long, feature int, bin int, g long, n long, unit double").fields])
    for number in range(p["rounds"]):
        chosen = _columns(width, p["seed"], number, p["columns"])
        tree = heads.select(*names, F.struct(*(F.array_repeat(F.lit(v), heap).alias(c) for c, v in (("feature", -1), ("cut", -1), ("value", 0.0)))).alias("_tree"))
        for level in range(depth + 1):
            rows = state.join(held, names).join(tree, names)
            rows = rows.select(*names, "_row", "_bins", "unit", F.rint((F.col("_y") - now(rows)) / F.col("unit")).alias("_units"), place(F.col("_tree")).cast("long").alias("_node"))

            def partial(batches, level=level, number=number, chosen=chosen):
                first, many = 2**level - 1, 2**level
                for batch in batches:
                    table = pa.Table.from_batches([batch])
                    node, units = table["_node"].to_numpy(), table["_units"].to_numpy()
                    x = table["_bins"].combine_chunks().flatten().to_numpy().reshape(-1, width)
                    keep = _drawn(table["_row"].to_numpy(), p["seed"], number, p["rows"]) & (node >= first)
                    frame = table.select([*names, "unit"]).to_pandas()
                    for key, at in frame.groupby(names, sort=False, dropna=False).indices.items():
                        at = at[keep[at]]
                        if not len(at):
                            continue
                        g, n = _histogram(x[at][:, chosen] if level < depth else np.zeros((len(at), 1), np.int64), node[at] - first, units[at], many, size)
                        k, f, b = np.nonzero(n)
                        part = pd.DataFrame({"node": k + first, "feature": chosen[f].astype("int32") if level < depth else np.full(len(f), -1, "int32"), "bin": b.astype("int32"),
                                             "g": g[k, f, b].astype("int64"), "n": n[k, f, b].astype("int64"), "unit": float(frame["unit"].iloc[at[0]])})
                        for i, (name, value) in enumerate(zip(names, key if isinstance(key, tuple) else (key,), strict=True)):
                            part.insert(i, name, value)
                        yield pa.RecordBatch.from_pandas(part, preserve_index=False)

            sums = rows.mapInArrow(partial, schema).groupBy(*names, "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.max("unit").alias("unit"))
            tree = stored(_next_level(sums, tree, names, level, chosen, size, p), "tree-level")
        grown.append(tree)
        held = held.join(tree, names).select(*names, F.concat("_recent", F.array("_tree")).alias("_recent"))
        if (number + 1) % HOLD == 0:
            rows = state.join(held, names)
            state = stored(rows.select(*names, "_row", "_y", "unit", "_bins", now(rows).alias("_made")), "tree-state")
            held = heads.select(*names, F.array().cast(whole_tree).alias("_recent"))
    out = heads
    for start in range(0, len(grown), 50):
        part = grown[start].select(*names, F.array("_tree").alias("_trees"))
        for tree in grown[start + 1:start + 50]:
            part = part.join(tree, names).select(*names, F.concat("_trees", F.array("_tree")).alias("_trees"))
        part = stored(part.withColumnRenamed("_trees", f"_t{start}"), "trees")
        out = out.join(part, names)
    every = F.flatten(F.array(*(F.col(f"_t{s}") for s in range(0, len(grown), 50))))
    in_units = F.transform(every, lambda t: F.struct(
        t["feature"].alias("feature"), F.transform(t["feature"], lambda f, i: F.when(f >= 0, F.get(F.get("edges", f), F.get(t["cut"], i)))).alias("cut"), t["value"].alias("value")))
    return out.select(*names, "base", in_units.alias("trees"), "train_rows")


def _next_level(sums: DataFrame, tree: DataFrame, names: list[str], level: int, chosen: np.ndarray, size: int, p: dict) -> DataFrame:
    """The trees with the cuts and values of one more level, chosen per key from its summed histogram."""
    first, many = 2**level - 1, 2**level
    at = {int(f): i for i, f in enumerate(chosen)}

    def choose(cells: pa.Table, held: pa.Table) -> pa.Table:
        old = held["_tree"][0].as_py()
        width = len(chosen) if level < p["depth"] else 1
        g, n = np.zeros((many, width, size)), np.zeros((many, width, size), np.int64)
        if cells.num_rows:
            where = (cells["node"].to_numpy() - first, np.array([at.get(f, 0) for f in cells["feature"].to_pylist()]), cells["bin"].to_numpy())
            g[where], n[where] = cells["g"].to_numpy(), cells["n"].to_numpy()
            unit = cells["unit"][0].as_py()
            old["value"][first:first + many] = (p["rate"] * g[:, 0].sum(1) * unit / (n[:, 0].sum(1) + p["penalty"])).tolist()
            if level < p["depth"]:
                for k, (f, b) in enumerate(_best_cuts(g, n, p["penalty"], unit)):
                    if f >= 0:
                        old["feature"][first + k], old["cut"][first + k] = int(chosen[f]), b
        return pa.table({**{k: held[k] for k in names}, "_tree": pa.array([old], held["_tree"].type)})

    return sums.groupBy(*names).cogroup(tree.groupBy(*names)).applyInArrow(choose, tree.schema)
