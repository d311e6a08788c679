"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so a cosine threshold is a distance epsilon. Vectors are sorted by
the cells of an epsilon grid over their leading principal dimensions (from summed products over all vectors) and cut
into sequence intervals of bounded size. Pairs of intervals are found by descending a tree: pairs of large runs of
intervals first, then of their parts, dropping every pair whose boxes lie further apart than epsilon. Inside a pair the
task goes on halving both sides the same way and compares what is left by matrix products in double precision.
Intervals travel in tiles: a task gets two runs of intervals and compares all their pairs, so an interval is sent once
to each tile it may meet, not once to each interval.

Equal vectors are one vector with a weight, so copies are never compared. A pair of intervals returns link counts and
a spanning forest of its links, not the links themselves.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors link
with those of their own length only, each length in a join of its own; each row keeps a row, repeated ids are
separate rows that may link and take the same component; a row without id links but is nobody's component; an empty
table has no rows; other columns, labels too, are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.storage import scratch, stored
from tidewright.llm.components import components

INTERVAL = 1024
LEAF = 128
LEADING = 8
FAN = 32
TILES = 24  # tiles at least, where there are enough vectors: tasks enough for the pairs
TILE_BYTES = 16 << 20  # vectors of a tile at most
SLACK = 1e-9


def _usable():
    """Whether a vector is finite throughout and not zero."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.maximum(np.abs(m).max(1, keepdims=True), 1e-300)  # so that squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Leading principal dimensions of all vectors; the sums are size x size numbers a task."""
    def fold(batches):
        total, products, n = np.zeros(size), np.zeros((size, size)), 0
        for batch in batches:
            u = _unit(_matrix(batch.column(0))) if len(batch.column(0)) else np.zeros((0, size))
            total, products, n = total + u.sum(0), products + u.T @ u, n + len(u)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(products.tolist()), pa.array([*[float(x) for x in total]]),
                                          pa.array([float(n)] * size)], names=["row", "products", "total", "n"])

    parts = vectors.select("v").mapInArrow(fold, "row int, products array<double>, total double, n double")
    cells = parts.select("row", "total", "n", F.posexplode("products").alias("col", "x")).groupBy("row", "col").agg(
        F.sum("x").alias("x"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    products, total, n = np.zeros((size, size)), np.zeros(size), 1.0
    for row, col, x, t, k in cells.collect():  # size x size rows
        products[row, col], total[row], n = x, t, max(k, 1.0)
    mean = total / n
    values, axes = np.linalg.eigh(products / n - np.outer(mean, mean))
    return axes[:, np.argsort(-values)[:LEADING]]


def _intervals(vectors: DataFrame, axes: np.ndarray, epsilon: float, exact: str) -> DataFrame:
    """Rows of at most INTERVAL vectors that follow each other in grid order, with the box they fill."""
    def project(batches):
        for batch in batches:
            m = _matrix(batch.column(1))
            cells = np.floor(_unit(m) @ axes / epsilon).astype(np.int32) if len(m) else np.zeros((0, axes.shape[1]), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), *(pa.array(c) for c in cells.T)],
                                             names=["cls", "weight", "v", *(f"g{k}" for k in range(axes.shape[1]))])

    grid = [f"g{k}" for k in range(axes.shape[1])]
    kind = f"cls long, weight long, v {vectors.schema['v'].dataType.simpleString()}, " + ", ".join(f"{g} int" for g in grid)
    keyed = vectors.select("cls", "v", "weight").mapInArrow(project, kind)
    parts = max(1, math.ceil(vectors.count() / (4 * INTERVAL)))
    ordered = keyed.repartitionByRange(parts, *grid, "cls").sortWithinPartitions(*grid, "cls")

    def cut(batches):
        at, held, k = TaskContext.get().partitionId() << 32, [], 0
        size = 0

        def row():
            ids, weights, m = (np.concatenate([h[j] for h in held]) for j in range(3))
            p = _unit(m) @ axes
            return pa.RecordBatch.from_arrays(
                [pa.array([at + k], pa.int64()), pa.array([ids.tobytes()]), pa.array([weights.tobytes()]), pa.array([m.astype(exact).tobytes()]),
                 pa.array([p.min(0).tolist()]), pa.array([p.max(0).tolist()])], names=["block", "ids", "weights", "vectors", "low", "high"])

        for batch in batches:
            ids, weights = (batch.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 1))
            m, done = _matrix(batch.column(2)), 0
            while done < len(ids):
                take = min(INTERVAL - size, len(ids) - done)
                held.append((ids[done:done + take], weights[done:done + take], m[done:done + take]))
                size, done = size + take, done + take
                if size == INTERVAL:
                    yield row()
                    held, size, k = [], 0, k + 1
        if held:
            yield row()

    return ordered.select("cls", "weight", "v").mapInArrow(
        cut, "block long, ids binary, weights binary, vectors binary, low array<double>, high array<double>")


def _close(epsilon: float):
    apart = F.aggregate(
        F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))),
        F.lit(0.0), lambda s, x: s + x * x)
    return apart <= epsilon ** 2 + SLACK


def _parents(level: int):
    """The run of nodes that a node of ``level`` lies in: a block's partition, then runs of FAN partitions."""
    return F.shiftright("node", 32) if level == 0 else F.floor(F.col("node") / FAN)


def _block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(a, b) with a <= b of the blocks whose boxes are near, found by descending a tree of runs of blocks."""
    last = blocks.agg(F.max(F.shiftright("block", 32))).first()[0]
    levels = 1 + max(1, math.ceil(math.log((last or 0) + 1, FAN)))
    tree = [blocks.select(F.col("block").alias("node"), "low", "high")]
    for level in range(levels):
        sides = tree[-1].select(_parents(level).cast("long").alias("node"), F.posexplode(F.arrays_zip("low", "high")).alias("dim", "z"))
        boxes = sides.groupBy("node", "dim").agg(F.min("z.low").alias("low"), F.max("z.high").alias("high"))
        listed = boxes.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("dim", "low", "high"))).alias("box"))
        tree.append(listed.select("node", F.col("box.low").alias("low"), F.col("box.high").alias("high")))
    pairs = tree[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(range(levels)):
        below = tree[level].withColumn("up", _parents(level).cast("long"))
        left = below.select(F.col("up").alias("a"), F.col("node").alias("x"), "low", "high")
        right = below.select(F.col("up").alias("b"), F.col("node").alias("y"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        pairs = pairs.join(left, "a").join(right, "b").where(F.col("x") <= F.col("y")).where(_close(epsilon)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return pairs


def _descend(p, q, i, j, limit):
    """Pairs of index ranges of two sequences, at most LEAF long, whose boxes are near."""
    (a, b), (c, d) = i, j
    gap = np.maximum(0, np.maximum(p[a:b].min(0) - q[c:d].max(0), q[c:d].min(0) - p[a:b].max(0)))
    if (gap * gap).sum() > limit:
        return
    if max(b - a, d - c) <= LEAF:
        yield i, j
    elif b - a >= d - c:
        m = (a + b) // 2
        yield from _descend(p, q, (a, m), j, limit)
        yield from _descend(p, q, (m, b), j, limit)
    else:
        m = (c + d) // 2
        yield from _descend(p, q, i, (c, m), limit)
        yield from _descend(p, q, i, (m, d), limit)


def _run(n: int, width: int) -> int:
    """Partitions of intervals in a tile, for ``n`` vectors of ``width`` bytes."""
    return max(1, min(TILE_BYTES // width, math.ceil(n / TILES)) // (4 * INTERVAL))


def _sent(pairs: DataFrame, run: int) -> DataFrame:
    """(tile, tile2, block): each block once for every pair of tiles in which it is near another block."""
    tile = {c: F.floor(F.shiftright(c, 32) / run) for c in ("a", "b")}
    sides = [pairs.select(tile["a"].alias("tile"), tile["b"].alias("tile2"), F.col(c).alias("block")) for c in ("a", "b")]
    return sides[0].unionByName(sides[1]).distinct()


def _compared(x: tuple, y: tuple, same: bool, cosine: float, epsilon: float) -> tuple[list, list]:
    """Weighted link counts by class and a spanning forest of the links of two intervals (or of one with itself)."""
    (ids, wx, ux, px), (ids2, wy, uy, py) = x, y
    counts, counts2 = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64)
    label = np.arange(len(ids) + len(ids2))
    label2 = label[:len(ids)] if same else label[len(ids):]
    forest = []
    for (a, b), (c, d) in _descend(px, py, (0, len(ids)), (0, len(ids2)), epsilon ** 2 + SLACK):
        if same and c >= b:
            continue  # the mirror image, below the diagonal, stands for both
        near = ux[a:b] @ uy[c:d].T >= cosine
        if same:
            near &= np.arange(a, b)[:, None] > np.arange(c, d)[None]
        counts[a:b] += near @ wy[c:d]
        counts2[c:d] += wx[a:b] @ near
        for r in np.flatnonzero(near.any(1)):
            met = np.flatnonzero(near[r]) + c
            others, at = np.unique(label2[met], return_index=True)
            new = others != label[a + r]
            if new.any():
                forest += [(int(ids[a + r]), int(ids2[met[k]])) for k in at[new]]
                label[np.isin(label, others[new])] = label[a + r]
    if same:
        return [(int(k), int(n)) for k, n in zip(ids, counts + counts2) if n], forest
    return [(int(k), int(n)) for k, n in zip(np.concatenate((ids, ids2)), np.concatenate((counts, counts2))) if n], forest


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    epsilon = math.sqrt(2 - 2 * cosine) + SLACK

    def named(batches):
        for batch in batches:
            m = _matrix(batch.column(1)) + 0.0  # -0.0 becomes 0.0
            ids = [int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "little", signed=True) for r in m]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64())], names=["vec_id", "v", "cls"])

    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v"))
    exact = "<f4" if given.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"
    if exact == "<f8":
        given = given.withColumn("v", F.col("v").cast("array<double>"))
    usable = given.where(_usable())
    sizes = [r[0] for r in usable.groupBy(F.size("v").alias("size")).count().where("count > 1").orderBy("size").collect()]  # a lone vector has no partner
    joined = F.coalesce(_usable() & F.size("v").isin(sizes), F.lit(False))
    out = given.where(~joined).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for size in sizes:
        out = out.unionByName(_linked(usable.where(F.size("v") == size), size, named, exact, cosine, epsilon))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(usable: DataFrame, size: int, named, exact: str, cosine: float, epsilon: float) -> DataFrame:
    """(vec_id, n_links, component_id) of the rows of usable vectors of one length."""
    rows_kind = f"vec_id long, v array<{'float' if exact == '<f4' else 'double'}>, cls long"
    rows = usable.select("vec_id", "v").mapInArrow(named, rows_kind)
    members = stored(rows.select("vec_id", "cls"), "members")
    weights = members.groupBy("cls").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    first = rows.select("cls", "v").dropDuplicates(["cls"])
    with scratch():
        distinct = stored(first.join(weights, "cls"), "distinct")
        run = _run(distinct.count(), size * np.dtype(exact).itemsize + 16)
        axes = _axes(distinct, size)
        blocks = stored(_intervals(distinct, axes, epsilon, exact), "intervals")
        pairs = stored(_block_pairs(blocks, epsilon), "interval_pairs")

        def compare(key, group):
            tile, tile2 = (k.as_py() for k in key)
            known = []
            for block, i, w, v in zip(*(group.column(c).to_pylist() for c in ("block", "ids", "weights", "vectors"))):
                u = _unit(np.frombuffer(v, exact).astype(np.float64).reshape(-1, size))
                known.append((block, (np.frombuffer(i, np.int64), np.frombuffer(w, np.int64), u, u @ axes)))
            total, links = Counter(), []
            for a, x in known:
                for b, y in known:
                    if a <= b and (a >> 32) // run == tile and (b >> 32) // run == tile2:
                        counts, forest = _compared(x, y, a == b, cosine, epsilon)
                        links += forest
                        for cls, n in counts:
                            total[cls] += n
            rows = [(k, None, n) for k, n in total.items()] + [(v, w, 0) for v, w in links]
            columns = list(zip(*rows)) or [[]] * 3
            return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cls", "other", "n"])

        tiles = 1 + (blocks.agg(F.max(F.shiftright("block", 32))).first()[0] or 0) // run
        met = _sent(pairs, run).join(blocks.select("block", "ids", "weights", "vectors"), "block")
        met = met.repartition(min(tiles * (tiles + 1) // 2, 2000), "tile", "tile2")  # little to send, much to compare
        found = stored(met.groupBy("tile", "tile2").applyInArrow(compare, "cls long, other long, n long"), "links", out=True)
    counts = found.where("other is null").groupBy("cls").agg(F.sum("n").alias("others"))
    parts = components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")), "a", "b")
    classes = (
        weights.join(counts, "cls", "left").join(parts.select(F.col("id").alias("cls"), F.col("component_id").alias("part")), "cls", "left")
        .withColumn("part", F.coalesce("part", "cls"))
    )
    least = classes.groupBy("part").agg(F.min("least").alias("component_id"))
    known = classes.join(least, "part").select("cls", "component_id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return members.join(known, "cls").select("vec_id", "n_links", "component_id")
