"""Coordinate benchmarks: selection, filters, folds, location encoders, ridge probes from sufficient statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from probeloom.operators.ranges import placed

DEFAULT_YEAR = 2021
ALPHAS = tuple(10.0 ** (k / 2) for k in range(-8, 13))


def select_benchmarks(catalog: DataFrame, selection: str) -> DataFrame:
    """name, place: the catalogue's names that a comma text asks for (``all``, families, names), once, in order.

    A family that bears a benchmark's name wins over it; an unknown word is an error.
    """
    spark = catalog.sparkSession
    words = [w.strip() for w in selection.split(",") if w.strip()]
    asked = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, i int")
    known = catalog.select(F.col("family").alias("word"), "name", "pos").union(catalog.select(F.lit("all"), "name", "pos"))
    single = catalog.join(known.select("word").distinct(), catalog["name"] == F.col("word"), "left_anti").select(F.col("name").alias("word"), "name", "pos")
    known = known.union(single)
    missing = [r.word for r in asked.join(known, "word", "left_anti").collect()]
    if missing:
        raise ValueError(f"unknown benchmarks: {', '.join(sorted(missing))}")
    found = asked.join(known, "word").groupBy("name").agg(F.min(F.struct("i", "pos")).alias("at"))
    return found.select("name", F.row_number().over(Window.orderBy("at")).alias("place"))  # the catalogue's rows


def plan_evaluations(benchmarks: DataFrame, split_mode: str = "both") -> DataFrame:
    """Benchmarks crossed with the methods and splits that apply: neighbours only for classes, official splits once."""
    methods = F.when(F.col("task_type") == "classification", F.array(F.lit("linear"), F.lit("knn5"))).otherwise(F.array(F.lit("linear")))
    modes = F.array(*map(F.lit, ("random", "spatial") if split_mode == "both" else (split_mode,)))
    splits = F.when(F.col("has_official"), F.array(F.lit("official"))).otherwise(modes)
    return benchmarks.withColumn("method", F.explode(methods)).withColumn("split", F.explode(splits))


def lonlat_columns(columns: Sequence[str]) -> tuple[str, str]:
    """The longitude and latitude columns of a table by name."""
    lower = {c.lower(): c for c in columns}
    pick = lambda names: next((lower[n] for n in names if n in lower), None)
    lon, lat = pick(("lon", "longitude", "lng", "x")), pick(("lat", "latitude", "y"))
    if lon is None or lat is None:
        raise ValueError("no longitude and latitude columns")
    return lon, lat


def task_columns(schema: T.StructType, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are no coordinates and not excluded, in the order of the table."""
    skip = {c.lower() for c in (*exclude, *lonlat_columns(schema.names))}
    return [f.name for f in schema.fields if f.name.lower() not in skip and isinstance(f.dataType, T.NumericType)]


def label_column(schema: T.StructType, word: str, exclude: Sequence[str] = (), prefix: str = "mean", fallback: str = "price") -> str | None:
    """Of the task columns: the first whose name contains the word, else begins with the prefix, else is the fallback, else the first; null if there is none."""
    columns = task_columns(schema, exclude)
    rules = (lambda c: word.lower() in c, lambda c: c.startswith(prefix), lambda c: c == fallback, lambda c: True)
    return next((c for rule in rules for c in columns if rule(c.lower())), None)


def load_config(spark, root: str, config: str) -> DataFrame:
    """The normalised coordinate table of one configuration."""
    return spark.read.parquet(f"{root}/{config}")


def official_split(rows: DataFrame, column: str = "split") -> DataFrame:
    """rows with is_test from a split column."""
    return rows.withColumn("is_test", F.coalesce(F.col(column) == "test", F.lit(False)))


def without_nodata(rows: DataFrame, rules: dict[str, float | int | None]) -> DataFrame:
    """Rows whose columns are not null and do not hold the given no-data value."""
    for c, value in rules.items():
        rows = rows.where(F.col(c).isNotNull() & ((F.col(c) != value) if value is not None else F.lit(True)))
    return rows


def long_tasks(rows: DataFrame, ids: Sequence[str], tasks: Sequence[str]) -> DataFrame:
    return rows.unpivot(list(ids), list(tasks), "task", "y")


def infer_task_types(tasks: DataFrame, most: int = 100) -> DataFrame:
    """Per task: classification if all labels are finite and whole, with at most ``most`` values; else regression."""
    y = F.col("y")
    finite = y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))
    whole = F.abs(y - F.round(y)) <= 1e-8 + 1e-5 * F.abs(F.round(y))
    found = tasks.groupBy("task").agg(F.bool_and(finite & whole).alias("w"), F.countDistinct("y").alias("n"))
    return found.select("task", F.when(F.col("w") & (F.col("n") <= most), "classification").otherwise("regression").alias("task_type"))


def year_of(epoch_ms: Column) -> Column:
    return F.year(F.timestamp_millis(epoch_ms))


def valid(label: Column, features: Column, classification: bool) -> Column:
    """Rows that a probe may use: label and all features there and finite."""
    fine = F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return fine & label.isNotNull() & (F.lit(True) if classification else ~F.isnan(label) & (F.abs(label) < float("inf")))


def test_sample_count(rows: DataFrame, task_type: str, official: bool) -> DataFrame:
    """Samples that a score rests on: the test rows, else rows with finite labels, else all rows."""
    if official:
        return rows.agg(F.count_if("is_test").alias("n"))
    return rows.agg((F.count_if(~F.isnan("y_num") & F.col("y_num").isNotNull()) if task_type == "regression" else F.count("*")).alias("n"))


def _dealt(rows: DataFrame, order: Column, k: int, out: str) -> DataFrame:
    """Rows dealt in turn over k folds in an order, of equal ones by row_id."""
    return placed(rows, (), (order, "row_id"), "_n").withColumn(out, F.pmod(F.col("_n") - 1, F.lit(k)).cast("int")).drop("_n")


def random_folds(rows: DataFrame, folds: int, seed: int = 0) -> DataFrame:
    """Balanced random folds: rows in the order of md5(id:seed), dealt in turn."""
    return _dealt(rows, F.md5(F.concat(F.col("row_id").cast("string"), F.lit(f":{seed}"))), folds, "fold")


def strided_folds(rows: DataFrame, folds: int) -> DataFrame:
    """Rows in row order, dealt in turn."""
    return _dealt(rows, F.col("row_id"), folds, "fold")


#: The fold of rows that an official split holds out.
HELD = -1


def nested_folds(rows: DataFrame, folds: int) -> DataFrame:
    """An official split: ``is_test`` rows have the fold HELD, the others (the pool) are dealt in turn in row order, to choose a penalty on."""
    return strided_folds(rows.where("NOT is_test"), folds).unionByName(rows.where("is_test").withColumn("fold", F.lit(HELD)))


def cell_of(lat: Column, lon: Column, degrees: float) -> Column:
    return (F.floor(lat / degrees) * 100003 + F.floor(lon / degrees)).cast("long")


def spatial_folds(rows: DataFrame, folds: int, degrees: float = 10.0, seed: int = 0) -> DataFrame:
    """Folds of whole grid cells: cells in the order of md5(cell:seed), dealt in turn. A globe has few cells."""
    placed = rows.withColumn("cell", cell_of(F.col("lat"), F.col("lon"), degrees))
    cells = placed.select("cell").distinct()
    place = F.row_number().over(Window.orderBy(F.md5(F.concat(F.col("cell").cast("string"), F.lit(f":{seed}"))))) - 1
    return placed.join(F.broadcast(cells.withColumn("fold", F.pmod(place, F.lit(folds)).cast("int"))), "cell")


def sincos(lat: Column, lon: Column) -> Column:
    return F.array(F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(F.radians(lon)), F.cos(F.radians(lon)))


def fourier(lat: Column, lon: Column, frequencies: int) -> Column:
    """Sine and cosine of both angles at doubling frequencies."""
    wave = lambda i: F.array(*(f(F.radians(x) * F.pow(F.lit(2.0), i)) for x in (lat, lon) for f in (F.sin, F.cos)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(frequencies - 1)), wave))


def year_waves(year: Column, n: int, default: int = DEFAULT_YEAR) -> Column:
    t = (F.coalesce(year, F.lit(default)) - default) / 4
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array(F.sin(t * F.pow(F.lit(2.0), i)), F.cos(t * F.pow(F.lit(2.0), i)))))


def equal_earth(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Equal-Earth map coordinates (Savric, Patterson, Jenny 2018)."""
    a1, a2, a3, a4 = 1.340264, -0.081106, 0.000893, 0.003796  # fixed values of the projection
    t = F.asin(F.sqrt(F.lit(3.0)) / 2 * F.sin(F.radians(lat)))
    t2 = t * t
    t6 = t2 * t2 * t2
    x = 2 * F.sqrt(F.lit(3.0)) * F.radians(lon) * F.cos(t) / (3 * (9 * a4 * t6 * t2 + 7 * a3 * t6 + 3 * a2 * t2 + a1))
    return x, t * (a4 * t6 * t2 + a3 * t6 + a2 * t2 + a1)


def encode(rows: DataFrame, encoder: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], dim: int | None = None) -> DataFrame:
    """features from any batch encoder (lon, lat, year) -> (N, D); cut to the first ``dim``; non-finite output is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = np.asarray(encoder(df["lon"].to_numpy(), df["lat"].to_numpy(), df["year"].fillna(DEFAULT_YEAR).to_numpy()), np.float64)[:, :dim]
            if not np.isfinite(out).all():
                raise ValueError("the encoder gave values that are not finite")
            yield df[["row_id"]].assign(features=list(out))

    return rows.select("row_id", "lon", "lat", F.col("year").cast("double").alias("year")).mapInPandas(run, "row_id long, features array<double>")


def gram(rows: DataFrame, targets: int) -> dict[int, np.ndarray]:
    """fold -> M'M over rows [1, features, targets]: partial sums per task, one row for each matrix entry in the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for df in batches:
            for f, part in df.groupby("fold"):
                m = np.column_stack([np.ones(len(part)), np.stack(part["features"].to_numpy()), np.stack(part["targets"].to_numpy())])
                sums[f] = sums.get(f, 0) + m.T @ m
        for f, s in sums.items():
            yield pd.DataFrame({"fold": f, "i": np.repeat(np.arange(len(s)), len(s)), "j": np.tile(np.arange(len(s)), len(s)), "v": s.ravel()})

    found = rows.select("fold", "features", "targets").mapInPandas(run, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    table = found.toPandas()  # folds times (dimensions + targets) squared numbers
    for f, part in table.groupby("fold"):
        n = part["i"].max() + 1
        out[f] = np.zeros((n, n))
        out[f][part["i"], part["j"]] = part["v"]
    return out


def ridge_weights(g: np.ndarray, targets: int, alpha: float) -> np.ndarray:
    """Intercept and weights (rows) for each target from a Gram matrix of [1, x, y]: x scaled by its sample deviation (1e-6 at least), y centred."""
    n, d = g[0, 0], len(g) - 1 - targets
    mx, my = g[0, 1 : d + 1] / n, g[0, d + 1 :] / n
    cov = g[1 : d + 1, 1 : d + 1] - n * np.outer(mx, mx)
    s = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0) / max(n - 1, 1)), 1e-6)
    cross = (g[1 : d + 1, d + 1 :] - n * np.outer(mx, my)) / s[:, None]
    w = np.linalg.solve(cov / np.outer(s, s) + alpha * np.eye(d), cross) / s[:, None]
    return np.vstack([my - mx @ w, w])


def training_grams(grams: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each fold the Gram matrix of the rows that it is scored with: the other folds, but never the rows HELD out."""
    pool = sum(g for f, g in grams.items() if f != HELD)
    return {f: pool - (g if f != HELD else 0) for f, g in grams.items()}


def ridge_r2(rows: DataFrame, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """fold, alpha, r2 of regression (y) with each fold held out; one pass over the rows for all folds and alphas."""
    grams = gram(rows.withColumn("targets", F.array("y")), 1)
    train = training_grams(grams)
    out = []
    for f, g in sorted(grams.items()):
        for a in alphas:
            w = np.append(-ridge_weights(train[f], 1, a)[:, 0], 1.0)
            sse, n = float(w @ g @ w), g[0, 0]
            sst = g[-1, -1] - g[0, -1] ** 2 / n
            out.append((int(f), float(a), float(1 - sse / sst) if sst > 0 else None))
    return rows.sparkSession.createDataFrame(out, "fold int, alpha double, r2 double")


def ridge_accuracy(rows: DataFrame, classes: Sequence, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """fold, alpha, accuracy of one-hot ridge with each fold held out; weights of all folds are shipped with the scoring pass."""
    hot = F.array(*(F.when(F.col("y_cls") == c, 1.0).otherwise(0.0) for c in classes))
    rows = rows.withColumn("targets", hot).withColumn("label", (F.array_position(F.array(*map(F.lit, classes)), F.col("y_cls")) - 1).cast("int"))
    weights = {int(f): [ridge_weights(g, len(classes), a) for a in alphas] for f, g in training_grams(gram(rows, len(classes))).items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for f, part in df.groupby("fold"):
                x = np.column_stack([np.ones(len(part)), np.stack(part["features"].to_numpy())])
                for a, w in zip(alphas, weights[f], strict=True):
                    out.append((f, a, int(((x @ w).argmax(axis=1) == part["label"].to_numpy()).sum()), len(part)))
            yield pd.DataFrame(out, columns=["fold", "alpha", "hit", "n"])

    return rows.select("fold", "features", "label").mapInPandas(run, "fold int, alpha double, hit long, n long").groupBy("fold", "alpha").agg((F.sum("hit") / F.sum("n")).alias("accuracy"))


def best_alpha(scores: DataFrame, score: str) -> DataFrame:
    """alpha, mean, std (population) over folds of the first alpha with the best mean score, and whether it lies at an end of the grid."""
    means = scores.groupBy("alpha").agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    ends = scores.agg(F.min("alpha").alias("a"), F.max("alpha").alias("b"))
    top = means.orderBy(F.round("mean", 12).desc(), "alpha").limit(1)  # sums in another order do not break a tie
    return top.join(F.broadcast(ends)).select("alpha", "mean", "std", F.col("alpha").isin(F.col("a"), F.col("b")).alias("at_edge"))


def official_score(scores: DataFrame, score: str) -> DataFrame:
    """alpha, score, at_edge: the penalty with the best mean over the pool's folds, and the score with it on the rows HELD out."""
    best = best_alpha(scores.where(F.col("fold") != HELD), score).select("alpha", "at_edge")
    return scores.where(F.col("fold") == HELD).join(F.broadcast(best), "alpha").select("alpha", F.col(score).alias("score"), "at_edge")


def stratified_split(files: DataFrame, seed: int = 0) -> DataFrame:
    """class, name, split: 60/20/20 in each class by the order of md5(name:seed), sizes rounded half to even."""
    ranked = placed(files.select("class", "name"), ("class",), (F.md5(F.concat("name", F.lit(f":{seed}"))), "name"), "k")
    sizes = files.groupBy("class").agg(F.count("*").alias("n"))
    a, b = F.bround(F.col("n") * F.lit(0.6)), F.bround(F.col("n") * F.lit(0.2))
    split = F.when(F.col("k") <= a, "train").when(F.col("k") <= a + b, "val").otherwise("test")
    return ranked.join(sizes, ranked["class"].eqNullSafe(sizes["class"])).select(ranked["class"], "name", split.alias("split"))


def subsample(rows: DataFrame, cap: int, seed: int = 0, id_col: str = "sample_id") -> DataFrame:
    """At most ``cap`` rows, the first by md5(id:seed)."""
    return rows.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), id_col).limit(cap)
