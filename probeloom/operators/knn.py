"""k-nearest-neighbour joins by Euclidean distance and the probes on top of them.

Training sets of up to ``BLOCK`` rows are shipped to the tasks, and the queries are not shuffled. Larger ones are dealt to
cells, each row to the nearest of some training rows (pivots), of which the radius is known. A query first meets the
cell of its nearest pivot; the k-th distance found there bounds what is still to be found, and by the triangle inequality
it then meets only cells that reach into that distance. Cells are shipped in rounds of bounded size; a task reads its
queries with the best found so far, meets the cells of the round block by block, and writes them again. Nothing is shuffled or
copied by pairs, so the disk holds the queries twice and the training rows once, whatever the number of rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probeloom.operators import metrics as M
from probeloom.sources.place import drop, tables, written

BLOCK = 4096


def _nearest(x: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, exclude_self: bool) -> pd.DataFrame:
    """sample_id, train_id, distance of the k rows of y (ids ascending) nearest to each row of x."""
    out = []
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        d = np.maximum((part**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * part @ y.T, 0)
        if exclude_self:
            d[own[at : at + 512, None] == ids[None, :]] = np.inf
        m = min(k + 8, len(ids))
        near = np.argpartition(d, m - 1, axis=1)[:, :m]
        exact = np.sqrt(((part[:, None, :] - y[near]) ** 2).sum(axis=2))
        exact[~np.isfinite(np.take_along_axis(d, near, 1))] = np.inf
        order = np.lexsort((ids[near], exact), axis=1)[:, :k]
        edge = np.take_along_axis(d, near, 1).max(axis=1, keepdims=True)
        tied = (d <= edge * (1 + 1e-9) + 1e-9) & np.isfinite(d)
        near, exact = np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)
        for r in np.flatnonzero(tied.sum(axis=1) > m):  # more rows tie with the last candidate: all of them are looked at
            some = np.flatnonzero(tied[r])
            away = np.sqrt(((part[r] - y[some]) ** 2).sum(axis=1))
            best = np.lexsort((ids[some], away))[: near.shape[1]]
            near[r], exact[r] = some[best], away[best]
        out.append(pd.DataFrame({"sample_id": np.repeat(own[at : at + 512], near.shape[1]), "train_id": ids[near].ravel(), "distance": exact.ravel()}))
    found = pd.concat(out) if out else pd.DataFrame({"sample_id": [], "train_id": [], "distance": []})
    return found[np.isfinite(found["distance"])]


def _shipped(q: DataFrame, t: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The k nearest of a training set of one block."""
    table = t.toPandas().sort_values("id")  # BLOCK rows at most
    sets = {g: (np.stack(part["x"].to_numpy()), part["id"].to_numpy()) for g, part in table.groupby("g")}
    shared = q.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for g, part in df.groupby("g"):
                if g in shared.value:
                    y, ids = shared.value[g]
                    yield _nearest(np.stack(part["x"].to_numpy()), part["id"].to_numpy(), y, ids, k, exclude_self)

    return q.mapInPandas(run, "sample_id long, train_id long, distance double")


def neighbours(queries: DataFrame, train: DataFrame, k: int, by: str | None = None, exclude_self: bool = False, stats: dict | None = None) -> DataFrame:
    """sample_id, train_id, distance, rank (from 1) of each query's k nearest training rows (ties: smaller id).

    ``by`` names a column that must agree (a fold); k is clamped to the training rows; ids may be excluded. ``stats`` gets
    how often a query met a block of training rows (``met``), and how often it would without bounds (``all``).
    """
    group = F.col(by).cast("string") if by else F.lit("")
    side = lambda df: df.select(group.alias("g"), F.col("sample_id").alias("id"), F.col("features").cast("array<double>").alias("x"))
    order = Window.partitionBy("sample_id").orderBy("distance", "train_id")
    n = train.count()
    if n <= BLOCK:
        return _shipped(side(queries), side(train), k, exclude_self).withColumn("rank", F.row_number().over(order))
    return _by_cells(side(queries), side(train), n, k, exclude_self, stats).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Pivots at most, and bytes of them that are shipped; bytes of training rows in a round (about).
PIVOTS, PIVOT_BYTES, ROUND_BYTES = 4096, 32 << 20, 8 << 20
#: Pairs whose distances are computed coordinate by coordinate at a time.
PAIRS = 1 << 16


def _spread(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T, 0))


def _packed(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(x)]


def _unpacked(column: pd.Series, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _better(x: np.ndarray, own: np.ndarray, ids: np.ndarray, far: np.ndarray, y: np.ndarray, names: np.ndarray, exclude_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest (ids, distances; ties: smaller id) of those known so far and the rows of y; unused places have no finite distance."""
    k = ids.shape[1]
    nx, ny = (x**2).sum(1), (y**2).sum(1)
    d = np.maximum(nx[:, None] + ny[None, :] - 2 * x @ y.T, 0)
    if exclude_self:
        d[own[:, None] == names[None, :]] = np.inf
    most = far[:, -1] ** 2
    if k < len(y) and np.isinf(most).any():
        most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
    most = most * (1 + 1e-9) + 1e-9 + 1e-12 * (nx + ny.max())  # squares by products lose digits
    row, at = np.nonzero((d <= most[:, None]) & np.isfinite(d))
    if not len(row):
        return ids, far
    away = np.concatenate([np.sqrt(((x[row[i : i + PAIRS]] - y[at[i : i + PAIRS]]) ** 2).sum(axis=1)) for i in range(0, len(row), PAIRS)])
    row = np.concatenate([np.repeat(np.arange(len(x)), k), row])
    name, away = np.concatenate([ids.ravel(), names[at]]), np.concatenate([far.ravel(), away])
    order = np.lexsort((name, away, row))
    first = np.searchsorted(row[order], np.arange(len(x)))
    best = order[first[:, None] + np.arange(k)]  # every row has its k old places at least
    return name[best], away[best]


def _by_cells(q: DataFrame, t: DataFrame, n: int, k: int, exclude_self: bool, stats: dict | None) -> DataFrame:
    """sample_id, train_id, distance of the k nearest of each query; q and t have g, id and x."""
    spark, before = q.sparkSession, tables()
    width = t.select(F.size("x")).first()[0]
    most = max(1, min(PIVOTS, -(-n // BLOCK), PIVOT_BYTES // (8 * max(width, 1))))
    pivots = np.array([r.x for r in t.orderBy(F.xxhash64("id"), "id").select("x").limit(most).collect()])
    shared = spark.sparkContext.broadcast(pivots)
    # a distance by its square loses half of the digits near zero; bounds are moved by as much
    slack = 1e-6 * (1 + float(np.abs(pivots).max(initial=0)) * np.sqrt(width))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                x = np.stack(df["x"].to_numpy()).astype(float)
                d = _spread(x, shared.value)
                yield df.assign(x=_packed(x), cell=d.argmin(axis=1).astype(np.int32), far=d.min(axis=1))

    schema = "g string, id long, x binary, cell int, far double"
    train, rows = written(t.mapInPandas(deal, schema), "cells"), written(q.mapInPandas(deal, schema).drop("far"), "queries")
    known = {r.cell: r for r in train.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row for each pivot
    radius = np.full(len(pivots), -np.inf)
    for c, r in known.items():
        radius[c] = r.far
    room = max(BLOCK, ROUND_BYTES // (8 * max(width, 1)))
    rounds, left = [[]], room  # of (cell, part of it), with about ``room`` rows
    for c, r in sorted(known.items()):
        parts = -(-r.n // room)
        for i in range(parts):
            if rounds[-1] and left < r.n / parts:
                rounds.append([])
                left = room
            rounds[-1].append((c, i, parts))
            left -= r.n / parts
    met = spark.sparkContext.accumulator(0) if stats is not None else None

    def ship(which: list[tuple[int, int, int]]):
        """The training rows of these parts of cells: (cell, part) -> g -> rows and ids in blocks."""
        table = F.broadcast(spark.createDataFrame(which, "cell int, part int, parts int"))
        some = train.join(table, "cell").where(F.pmod(F.xxhash64("id"), "parts") == F.col("part")).select("g", "id", "x", "cell", "part").toPandas()  # about ROUND_BYTES
        sets: dict = {}
        for (c, i, g), own in some.sort_values("id").groupby(["cell", "part", "g"], dropna=False):
            y, names = _unpacked(own["x"]), own["id"].to_numpy()
            sets.setdefault((c, i), {})[g] = [(y[a : a + BLOCK], names[a : a + BLOCK]) for a in range(0, len(y), BLOCK)]
        return spark.sparkContext.broadcast(sets)

    def meeting(sets, home: bool):
        """Queries with the best found so far meet what ``sets`` has: the first part of their own cell (``home``), or all else that reaches them."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                if not len(df):
                    continue
                df = df.sort_values(["cell", "id"])
                x, own, cell, g = _unpacked(df["x"]), df["id"].to_numpy(), df["cell"].to_numpy(), df["g"].to_numpy()
                if "ids" in df.columns:
                    ids, far = _unpacked(df["ids"], np.int64).copy(), _unpacked(df["fars"]).copy()
                else:
                    ids, far = np.full((len(df), k), np.iinfo(np.int64).max), np.full((len(df), k), np.inf)
                for at in range(0, len(df), 512):
                    part = slice(at, at + 512)
                    low = None if home else _spread(x[part], shared.value) - radius[None]
                    for (c, i), groups in sets.value.items():
                        due = (cell[part] == c) if home else (low[:, c] <= far[part, -1] * (1 + 1e-9) + slack) & ~((cell[part] == c) & (i == 0))
                        if not due.any() or (home and i):
                            continue
                        for name, blocks in groups.items():
                            r = at + np.flatnonzero(due & (g[part] == name))
                            for y, names in blocks:
                                if len(r):
                                    ids[r], far[r] = _better(x[r], own[r], ids[r], far[r], y, names, exclude_self)
                                    if met is not None:
                                        met.add(len(r))
                yield df[["g", "id", "x", "cell"]].assign(ids=_packed(ids), fars=_packed(far))

        return run

    state = "g string, id long, x binary, cell int, ids binary, fars binary"
    held = None
    for which in rounds:  # first each query meets its own cell, which bounds what is still to be found
        cells = [c for c, i, _ in which if i == 0]
        if cells:
            sets = ship([p for p in which if p[1] == 0])
            part = written(rows.where(F.col("cell").isin(cells)).mapInPandas(meeting(sets, True), state), "home")
            sets.destroy()
            held = part if held is None else held.union(part)
    homeless = rows.where(~F.col("cell").isin(sorted(known)))
    none = lambda v: F.lit(np.full(k, v).tobytes())
    held = held.union(homeless.select("g", "id", "x", "cell", none(np.iinfo(np.int64).max), none(np.inf)))
    first = tables()
    for which in rounds:
        sets, old = ship(which), [x for x in tables() if x not in first]
        held = written(held.mapInPandas(meeting(sets, False), state), "held")
        sets.destroy()
        drop(old)
    if stats is not None:
        stats["met"] = met.value
        stats["all"] = rows.count() * sum(-(-r.n // BLOCK) for r in known.values())

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                far = _unpacked(df["fars"]).ravel()
                out = pd.DataFrame({"sample_id": np.repeat(df["id"].to_numpy(), k), "train_id": _unpacked(df["ids"], np.int64).ravel(), "distance": far})
                yield out[np.isfinite(far)]

    near = written(held.mapInPandas(told, "sample_id long, train_id long, distance double"), "near")
    drop([x for x in tables() if x not in before][:-1])
    return near


def vote(near: DataFrame, train: DataFrame) -> DataFrame:
    """sample_id, pred, share: the class with most votes (ties: the lowest), and its part of them."""
    votes = near.join(train.select(F.col("sample_id").alias("train_id"), "label"), "train_id").groupBy("sample_id", "label").agg(F.count("*").alias("v"))
    return votes.groupBy("sample_id").agg(F.max_by("label", F.struct("v", -F.col("label"))).alias("pred"), (F.max("v") / F.sum("v")).alias("share"))


def vote_many(near: DataFrame, train: DataFrame) -> DataFrame:
    """sample_id, place, prob, pred for label vectors: the mean of the neighbours' labels, positive above one half."""
    rows = near.join(train.select(F.col("sample_id").alias("train_id"), "labels"), "train_id").select("sample_id", F.posexplode("labels").alias("place", "y"))
    return rows.groupBy("sample_id", "place").agg(F.avg("y").alias("prob")).withColumn("pred", (F.col("prob") > 0.5).cast("int"))


def standardise(rows: DataFrame, stats_from: DataFrame) -> DataFrame:
    """Features scaled by mean and population deviation of another table (deviation zero counts as one)."""
    x = F.col("features").cast("array<double>")
    s = stats_from.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    s = s.agg(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("st"))  # one row for each dimension
    return rows.join(F.broadcast(s)).withColumn("features", F.zip_with(x, "st", lambda v, t: (v - t["m"]) / t["s"])).drop("st")


def evaluate(queries: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """Accuracy of the k-nearest-neighbour vote on labelled queries."""
    pred = vote(neighbours(queries, train, k), train)
    return queries.join(pred, "sample_id").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def class_shares(near: DataFrame, train: DataFrame, classes: int) -> DataFrame:
    """sample_id, probs: the part of each query's neighbours that each class from 0 on has."""
    votes = near.join(train.select(F.col("sample_id").alias("train_id"), "label"), "train_id").groupBy("sample_id", "label").agg(F.count("*").alias("v"))
    found = votes.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "v"))).alias("m"), F.sum("v").alias("n"))
    return found.select("sample_id", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0)) / F.col("n")).alias("probs"))


def report(queries: DataFrame, train: DataFrame, k: int, bins: int | None = None, resamples: int = 200, seed: int = 0) -> DataFrame:
    """metric, mean, low, high (bootstrap), n, ece, rms, mce and bins (k + 1 by default) of the k-nearest-neighbour vote.

    Rows with ``label`` are judged by accuracy, rows with label vectors (``labels``) by micro average precision.
    """
    bins = bins or k + 1
    near = neighbours(queries, train, k)
    if "labels" in queries.columns:
        shares = vote_many(near, train)
        flat = shares.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("place", "prob"))).alias("p"))  # a row's labels
        rows = written(queries.join(flat, "sample_id").select("sample_id", "labels", F.transform("p", lambda x: x["prob"]).alias("probs")), "shares")
        marks = rows.select("sample_id", F.explode(F.arrays_zip(F.col("probs").alias("p"), F.col("labels").alias("y"))).alias("x")).select("sample_id", F.col("x.p").alias("score"), F.col("x.y").cast("int").alias("positive"))
        score = M.average_precision(marks).select(F.col("ap").alias("metric"))
        found = score.join(M.bootstrap_ap(marks, "sample_id", resamples, seed=seed)).join(rows.agg(F.count("*").alias("n")))
        gaps = M.calibration_labels(rows, bins)
    else:
        classes = int(train.agg(F.max("label")).first()[0]) + 1
        shares = class_shares(near, train, classes)
        rows = written(queries.join(shares, "sample_id").select("sample_id", "label", "probs", (F.array_position("probs", F.array_max("probs")) - 1).alias("pred")), "shares")
        found = M.bootstrap_accuracy(rows, resamples=resamples, seed=seed).select(F.col("accuracy").alias("metric"), "mean", "low", "high", "n")
        gaps = M.calibration(rows, bins)
    return found.join(gaps).select("metric", "mean", "low", "high", "n", "ece", "rms", "mce", F.lit(bins).alias("bins"))  # one row each


def held_out_accuracy(train: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """accuracy, n of test rows as queries on training rows, both scaled by the training rows' statistics."""
    return evaluate(standardise(test, train), standardise(train, train), k)


def fold_accuracy(rows: DataFrame, folds: DataFrame, k: int, n_folds: int) -> DataFrame:
    """fold, accuracy: each fold's rows as queries on the others, scaled by the others' statistics."""
    out = None
    placed = rows.join(folds, "sample_id")
    for f in range(n_folds):
        train, test = placed.where(F.col("fold") != f), placed.where(F.col("fold") == f)
        part = held_out_accuracy(train, test, k).withColumn("fold", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out


def nonzero_two(rows: DataFrame) -> DataFrame:
    """sample_id, d1, d2 of rows whose two nearest distances are both above zero."""
    near = neighbours(rows, rows, 2, exclude_self=True)
    return near.groupBy("sample_id").agg(F.min("distance").alias("d1"), F.max("distance").alias("d2"), F.count("*").alias("n")).where("n = 2 AND d1 > 0 AND d2 > 0").drop("n")
