"""Logistic probes for all penalties and all labels at once.

Every probe is one of a stack: a softmax over classes, or one sigmoid for each label of label vectors, under each of many
penalties. Rows are packed once into blocks of numbers. While the blocks are small (``SHIPPED`` bytes) they travel to the
tasks, and each task fits some of the probes; beyond that the rows stay where they are, and one pass over them gives
the losses and slopes of the whole stack, for all probes that still move. Either way the same search (limited memory BFGS
with halved steps, on centred features scaled by a bound of the second derivatives) makes the next points.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.operators.metrics import average_precision
from probeloom.sources.place import written

#: Bytes of packed rows up to which they are shipped; rows of a block; remembered steps of the search.
SHIPPED, BLOCK, MEMORY = 32 << 20, 4096, 10
_Call = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def pack(rows: DataFrame, target: str = "label") -> DataFrame:
    """split, n, x, y: blocks of rows as bytes (doubles in row order); y is the class number or the label vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                split = np.asarray(batch.column(0).to_pylist())
                x = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(split), -1)
                y = batch.column(2)
                y = np.asarray(y.flatten() if pa.types.is_list(y.type) else y, np.float64).reshape(len(split), -1)
                out = [(s, int((split == s).sum()), x[split == s].tobytes(), y[split == s].tobytes()) for s in np.unique(split)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["split", "n", "x", "y"])

    kind = "array<double>" if rows.schema[target].dataType.typeName() == "array" else "double"
    return written(rows.select("split", F.col("features").cast("array<double>"), F.col(target).cast(kind)).mapInArrow(run, "split string, n long, x binary, y binary"), "blocks")


def _block(x: bytes, y: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(x).reshape(n, -1), np.frombuffer(y).reshape(n, -1)


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for s, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("split", "n", "x", "y")), strict=True):
        yield (s, *_block(x, y, n))


def outputs(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores (n, m, k) of a stack of weights (m, d + 1, k), intercepts first."""
    m, d, k = w.shape
    return (x @ w[:, 1:].transpose(1, 0, 2).reshape(d - 1, m * k)).reshape(len(x), m, k) + w[:, 0][None]


def _chances(z: np.ndarray, classes: bool) -> np.ndarray:
    if not classes:
        return 0.5 * (1 + np.tanh(z / 2))
    e = np.exp(z - z.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)


def loss_and_slope(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Summed cross-entropy (m) of each of a stack of weights over rows, and its slope (m, d + 1, k)."""
    z = outputs(x, w)
    if classes:
        own = y[:, 0].astype(int)
        top = z.max(axis=2)
        loss = (top + np.log(np.exp(z - top[..., None]).sum(axis=2)) - np.take_along_axis(z, own[:, None, None], 2)[..., 0]).sum(axis=0)
        q = _chances(z, True)
        q[np.arange(len(x)), :, own] -= 1
    else:
        loss = (np.logaddexp(0, z) - y[:, None, :] * z).sum(axis=(0, 2))
        q = _chances(z, False) - y[:, None, :]
    n, m, k = q.shape
    slope = (x.T @ q.reshape(n, m * k)).reshape(-1, m, k).transpose(1, 0, 2)
    return loss, np.concatenate([q.sum(axis=0)[:, None], slope], axis=1)


def minimise(call: _Call, w: np.ndarray, passes: int, tol: float) -> np.ndarray:
    """Points (m, p) that make each of m functions least; ``call(which, points)`` gives values and slopes of those that still move."""
    f, g = call(np.arange(len(w)), w)
    w, d = w.copy(), -g / np.maximum(1, np.linalg.norm(g, axis=1))[:, None]
    step, live = np.ones(len(w)), np.abs(g).max(axis=1) > tol
    kept = [deque(maxlen=MEMORY) for _ in w]
    for _ in range(passes):
        ids = np.flatnonzero(live)
        if not len(ids):
            break
        points = w[ids] + step[ids, None] * d[ids]
        values, slopes = call(ids, points)
        for i, point, value, slope in zip(ids, points, values, slopes, strict=True):
            if not value <= f[i] + 1e-4 * step[i] * (g[i] @ d[i]) + 1e-15 * abs(f[i]):  # near the end a fall is lost in rounding
                step[i] /= 2
                live[i] = step[i] > 1e-12
                continue
            s, u = point - w[i], slope - g[i]
            if s @ u > 1e-14:
                kept[i].append((s, u, 1 / (s @ u)))
            w[i], f[i], g[i], step[i] = point, value, slope, 1.0
            live[i] = np.abs(slope).max() > tol
            q, back = slope.copy(), []
            for s, u, r in reversed(kept[i]):
                a = r * (s @ q)
                q -= a * u
                back.append(a)
            if kept[i]:
                s, u, r = kept[i][-1]
                q *= (s @ u) / (u @ u)
            for (s, u, r), a in zip(kept[i], reversed(back), strict=True):
                q += s * (a - r * (u @ q))
            d[i] = -q
    return w


def _search(call: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], n: float, mean: np.ndarray, square: np.ndarray, ridge: np.ndarray, k: int, passes: int, tol: float) -> np.ndarray:
    """Weights (m, d + 1, k) on the features as they are; ``call(which, weights)`` sums loss and slope over rows, ridge (m) is 1 / (C n)."""
    d = len(mean)
    curve = np.concatenate([np.ones((len(ridge), 1)), np.maximum(square - mean**2, 0)[None] + 4 * ridge[:, None] + 1e-12], axis=1) / 4
    scale = 1 / np.sqrt(curve)[:, :, None]  # a step of one is a good one for every weight

    def plain(u: np.ndarray, which: np.ndarray) -> np.ndarray:
        w = u.reshape(len(which), d + 1, k) * scale[which]
        w[:, 0] -= np.einsum("d,mdk->mk", mean, w[:, 1:])
        return w

    def scaled(which: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = plain(u, which)
        loss, slope = call(which, w)
        loss, slope = loss / n, slope / n
        slope[:, 1:] -= mean[None, :, None] * slope[:, :1]
        loss = loss + 0.5 * ridge[which] * (w[:, 1:] ** 2).sum(axis=(1, 2))
        slope[:, 1:] += ridge[which, None, None] * w[:, 1:]
        return loss, (slope * scale[which]).reshape(len(which), -1)

    u = minimise(scaled, np.zeros((len(ridge), (d + 1) * k)), passes, tol)
    return plain(u, np.arange(len(ridge)))


def fit(blocks: DataFrame, grid: Sequence[float], splits: Sequence[str] = ("train",), classes: bool = True, passes: int = 400, tol: float = 1e-9, shipped: int = SHIPPED) -> np.ndarray:
    """Weights (len(grid), d + 1, k) that make mean cross-entropy + |W|^2 / (2 C n) least for each C, intercepts (first) free.

    Label vectors have a probe for each label, with the same C. No rows: an error.
    """
    some = blocks.where(F.col("split").isin(*splits))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        out = None
        for batch in batches:
            for _, x, y in _pairs(batch):
                part = np.concatenate([[len(x), y.max() + 1 if classes else y.shape[1], x.nbytes + y.nbytes], x.sum(axis=0), (x * x).sum(axis=0)])
                out = part if out is None else np.concatenate([[out[0] + part[0], max(out[1], part[1]), out[2] + part[2]], out[3:] + part[3:]])
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()])], names=["v"])

    parts = np.array([r.v for r in some.mapInArrow(moments, "v array<double>").collect()])  # a row for each task
    if not len(parts):
        raise ValueError("no rows to fit on")
    n, k, size = parts[:, 0].sum(), int(parts[:, 1].max()), parts[:, 2].sum()
    mean, square = np.split(parts[:, 3:].sum(axis=0) / n, 2)
    ridge = 1 / (np.asarray(grid, float) * n)
    spark = blocks.sparkSession
    if size <= shipped:
        table = some.toPandas()
        x, y = (np.concatenate(p) for p in zip(*(_block(*b) for b in zip(table["x"], table["y"], table["n"], strict=True)), strict=True))
        shared = spark.sparkContext.broadcast((x, y))

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                for i in df["i"]:
                    own = ridge[i : i + 1]
                    w = _search(lambda which, w: loss_and_slope(*shared.value, w, classes), n, mean, square, own, k, passes, tol)
                    yield pd.DataFrame({"i": [i], "w": [w.ravel()]})

        found = spark.range(len(grid), numPartitions=len(grid)).select(F.col("id").alias("i")).mapInPandas(solve, "i long, w array<double>").collect()
        return np.array([r.w for r in sorted(found, key=lambda r: r.i)]).reshape(len(grid), -1, k)

    def call(which: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                for _, x, y in _pairs(batch):
                    loss, slope = loss_and_slope(x, y, shared.value, classes)
                    part = np.concatenate([loss, slope.ravel()])
                    out = part if out is None else out + part
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["v"])

        total = _added(some.mapInArrow(run, "v binary"))
        shared.destroy()
        return total[: len(which)], total[len(which) :].reshape(w.shape)

    return _search(call, n, mean, square, ridge, k, passes, tol)


def _added(parts: DataFrame) -> np.ndarray:
    """The sum of vectors of doubles (v, as bytes), a row for each task: first by groups of tasks, so that few reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for v in batch.column("v"):
                part = np.frombuffer(v.as_py())
                out = part.copy() if out is None else out + part
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["v"])

    tasks = parts.rdd.getNumPartitions()
    if tasks > 64:
        parts = parts.repartition(int(np.ceil(np.sqrt(tasks)))).mapInArrow(run, "v binary")
    return np.sum([np.frombuffer(r.v) for r in parts.collect()], axis=0)


def predict(rows: DataFrame, w: np.ndarray, classes: bool = True) -> DataFrame:
    """rows with logits, probs and, for classes, pred, of one probe (d + 1, k)."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("array<double>")
    def logits(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(outputs(np.stack(x.to_numpy()).astype(float), shared.value[None])[:, 0]))

    out = rows.withColumn("logits", logits(F.col("features").cast("array<double>")))
    if not classes:
        return out.withColumn("probs", F.transform("logits", lambda z: 1 / (1 + F.exp(-z))))
    top = F.array_max("logits")
    e = F.transform(F.arrays_zip("logits", F.array_repeat(top, F.size("logits")).alias("top")), lambda z: F.exp(z["logits"] - z["top"]))
    out = out.withColumn("_e", e).withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)).withColumn("probs", F.zip_with("_e", F.array_repeat("_s", F.size("_e")), lambda x, s: x / s)).drop("_e", "_s")
    return out.withColumn("pred", (F.array_position("logits", top) - 1).cast("int"))


def scores(blocks: DataFrame, w: np.ndarray, grid: Sequence[float], classes: bool = True) -> DataFrame:
    """c, split, score of every probe of the stack in one pass: accuracy, or micro average precision of label vectors (null without a positive)."""
    shared = blocks.sparkSession.sparkContext.broadcast(w)
    grid = [float(c) for c in grid]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, x, y in _pairs(batch):
                hit = (outputs(x, shared.value).argmax(axis=2) == y[:, :1]).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(grid), pa.array([s] * len(grid)), pa.array(hit, pa.int64()), pa.array([len(x)] * len(grid), pa.int64())], names=["c", "split", "hit", "n"])

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, x, y in _pairs(batch):
                z = _chances(outputs(x, shared.value), False)
                for i, c in enumerate(grid):
                    flat = z[:, i].ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), c)), pa.array([s] * len(flat)), pa.array(flat), pa.array(y.ravel())], names=["c", "split", "score", "positive"])

    if classes:
        return blocks.mapInArrow(hits, "c double, split string, hit long, n long").groupBy("c", "split").agg((F.sum("hit") / F.sum("n")).alias("score"))
    return average_precision(blocks.mapInArrow(marks, "c double, split string, score double, positive double"), "c", "split").select("c", "split", F.col("ap").alias("score"))


def sweep(blocks: DataFrame, grid: Sequence[float], splits: Sequence[str] = ("train", "val", "test"), classes: bool = True, passes: int = 400, shipped: int = SHIPPED) -> DataFrame:
    """c and the score on each split of probes fitted on ``train``, for every C of the grid."""
    w = fit(blocks, grid, ("train",), classes, passes, shipped=shipped)
    found = scores(blocks.where(F.col("split").isin(*splits)), w, grid, classes)
    return found.groupBy("c").pivot("split", list(splits)).agg(F.first("score"))
