"""A coordinate benchmark from tables to result rows: plan, resume, encode once, fold, probe, append."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeloom.operators import coords as C
from probeloom.operators import knn as N
from probeloom.operators.results import pending_runs
from probeloom.sources.place import written

KEYS = ("dataset", "task", "method", "model", "split")


def folded(rows: DataFrame, split: str, folds: int, seed: int, degrees: float = 10.0) -> DataFrame:
    """rows (row_id, lon, lat, is_test, ...) with fold; an official split holds the test rows out, and its pool has folds to choose a penalty on."""
    if split == "official":
        return C.nested_folds(rows, folds)
    return C.random_folds(rows, folds, seed) if split == "random" else C.spatial_folds(rows, folds, degrees, seed)


def score(rows: DataFrame, task_type: str, method: str, folds: int, alphas: tuple[float, ...], official: bool = False) -> tuple[float, float, int]:
    """Mean and population deviation over folds, and their number, of the probe's score on rows (row_id, fold, features, y or y_cls).

    ``official``: one score on the rows held out, with the penalty that is best on the folds of the others.
    """
    if method.startswith("knn"):
        classes = sorted(r[0] for r in rows.select("y_cls").distinct().collect())  # class names
        label = (F.array_position(F.array(*map(F.lit, classes)), F.col("y_cls")) - 1).cast("int")
        table = rows.select(F.col("row_id").alias("sample_id"), "features", label.alias("label"), "fold")
        if official:
            return N.held_out_accuracy(table.where(F.col("fold") != C.HELD), table.where(F.col("fold") == C.HELD), int(method[3:])).first().accuracy, 0.0, 1
        each = N.fold_accuracy(table.drop("fold"), table.select("sample_id", "fold"), int(method[3:]), folds)
        return (*each.agg(F.avg("accuracy"), F.stddev_pop("accuracy")).first(), folds)
    if task_type == "regression":
        scores, name = C.ridge_r2(rows, alphas), "r2"
    else:
        classes = sorted(r[0] for r in rows.select("y_cls").distinct().collect())
        scores, name = C.ridge_accuracy(rows, classes, alphas), "accuracy"
    if official:
        return C.official_score(scores, name).first().score, 0.0, 1
    best = C.best_alpha(scores, name).first()
    return best["mean"], best["std"], folds


SCHEMA = "dataset string, task string, task_type string, method string, model string, split string, metric_name string, metric_value double, ci_lower double, ci_upper double, n_folds int, cell_deg double, feature_dim int, n_samples long, n_test long, seed int"


def run(benchmarks: DataFrame, points: Callable[[str, str], DataFrame], encoder: Column, model: str, stored: DataFrame | None = None, folds: int = 5, seed: int = 0, alphas: tuple[float, ...] = C.ALPHAS, degrees: float = 10.0) -> DataFrame:
    """Result rows (``SCHEMA``) of every benchmark (name, task, task_type, has_official) that ``stored`` does not hold.

    ``points(name, task)`` gives row_id, lon, lat, year, y, y_cls and is_test of one task. Encoded rows and folds are written
    where all executors see them.
    """
    spark = benchmarks.sparkSession
    plan = C.plan_evaluations(benchmarks).select(F.col("name").alias("dataset"), "task", "task_type", "method", F.lit(model).alias("model"), "split")
    if stored is not None:
        plan = pending_runs(plan, stored, KEYS)
    planned: dict[tuple, list] = {}
    for p in plan.orderBy(*KEYS).collect():  # the planned evaluations
        planned.setdefault((p.dataset, p.task, p.task_type), []).append(p)
    out = []
    for (dataset, task, task_type), runs in planned.items():
        rows = points(dataset, task)
        target = F.col("y") if task_type == "regression" else F.col("y_cls")
        fine = C.valid(target, F.col("features"), task_type != "regression")
        encoded = written(rows.select("row_id", "lon", "lat", "y", "y_cls", "is_test", encoder.alias("features")).withColumn("fine", fine), "encoded")  # once for all methods and splits
        dim, n = encoded.agg(F.max(F.size("features")), F.count("*")).first()
        usable = encoded.where("fine")
        for split in dict.fromkeys(p.split for p in runs):
            official = split == "official"
            placed = written(folded(usable, split, folds, seed, degrees).select("row_id", "fold", "features", "y", "y_cls"), "folds")
            n_test = C.test_sample_count(encoded.withColumn("y_num", F.col("y")), task_type, official).first().n
            for p in (p for p in runs if p.split == split):
                mean, std, scored = score(placed, task_type, p.method, folds, alphas, official)
                out.append((dataset, task, task_type, p.method, p.model, split, "r2" if task_type == "regression" else "accuracy", float(mean), float(mean - std), float(mean + std), scored, degrees, dim or 0, n, n_test, seed))
    return spark.createDataFrame(out, SCHEMA)
