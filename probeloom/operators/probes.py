"""Logistic probes, temperature, feature spectra and intrinsic dimensions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probeloom.operators import metrics as M
from probeloom.operators import stacked as S
from probeloom.operators.coords import subsample
from probeloom.operators.knn import neighbours, nonzero_two
from probeloom.sources.place import written

#: The grid of C: 40 values from 1e-6 to 1e4, evenly spaced in logarithm.
GRID = tuple(10 ** (-6 + 10 * k / 39) for k in range(40))


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("_x", array_to_vector(F.col("features").cast("array<double>")))


def fit_logistic(train: DataFrame, c: float, iterations: int = 200, label: str = "label", family: str = "multinomial"):
    """Logistic regression of mean cross-entropy + |W|^2 / (2 C n), intercepts free; ``binomial`` has one weight vector for two classes."""
    from pyspark.ml.classification import LogisticRegression

    n = train.count()
    return LogisticRegression(featuresCol="_x", labelCol=label, family=family, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-9).fit(_vectors(train))


def sweep(rows: DataFrame, grid: Sequence[float] = GRID, splits: Sequence[str] = ("train", "val", "test"), passes: int = 400) -> DataFrame:
    """c and the score on each split of probes fitted on ``train``: accuracy, or micro average precision of rows with label vectors (``labels``)."""
    many = "labels" in rows.columns
    return S.sweep(S.pack(rows, "labels" if many else "label"), grid, splits, not many, passes)


def sweep_report(rows: DataFrame, grid: Sequence[float] = GRID, passes: int = 400) -> DataFrame:
    """c, log10_c, train_score, val_score, test_score, feature_dim, n_train, n_val, n_test of ``sweep``."""
    sizes = rows.agg(F.max(F.size("features")).alias("feature_dim"), *(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")))
    swept = sweep(rows, grid, passes=passes).select("c", F.log10("c").alias("log10_c"), *(F.col(s).alias(f"{s}_score") for s in ("train", "val", "test")))
    return swept.join(F.broadcast(sizes))


def select_c(swept: DataFrame, on: str = "val") -> float:
    """The first C with the best score; a sweep without any finite score is an error."""
    best = swept.where(F.col(on).isNotNull() & ~F.isnan(on)).orderBy(F.col(on).desc(), "c").select("c").first()
    if best is None:
        raise ValueError("no C gave a finite validation score")
    return best[0]


def evaluate_logistic(rows: DataFrame, grid: Sequence[float] = GRID, merge_val: bool = True, bins: int = 15, resamples: int = 200, seed: int = 0, passes: int = 400) -> DataFrame:
    """best_c, metric, mean, low, high (bootstrap), n, ece, rms, mce on test: C chosen on val, refit on train and val.

    Rows with ``label`` are judged by accuracy, rows with label vectors (``labels``) by micro average precision. Without
    ``merge_val`` the probe stays that of train, and temperature, ece_ts, rms_ts and mce_ts are added, with the temperature fitted on val.
    """
    many = "labels" in rows.columns
    blocks = S.pack(rows, "labels" if many else "label")
    w = S.fit(blocks, grid, ("train",), not many, passes)
    val = S.scores(blocks.where("split = 'val'"), w, grid, not many)
    c = select_c(val.select("c", F.col("score").alias("val")))
    best = S.fit(blocks, [c], ("train", "val"), not many, 2 * passes)[0] if merge_val else w[list(grid).index(c)]
    judged = written(S.predict(rows.where("split = 'test'"), best, not many).drop("features"), "judged")
    gaps = M.calibration_labels(judged, bins) if many else M.calibration(judged, bins)
    if many:
        marks = judged.select("sample_id", F.explode(F.arrays_zip(F.col("probs").alias("p"), F.col("labels").alias("y"))).alias("x")).select("sample_id", F.col("x.p").alias("score"), F.col("x.y").cast("int").alias("positive"))
        found = M.average_precision(marks).select(F.col("ap").alias("metric")).join(M.bootstrap_ap(marks, "sample_id", resamples, seed=seed)).join(judged.agg(F.count("*").alias("n")))
    else:
        found = M.bootstrap_accuracy(judged, resamples=resamples, seed=seed).select(F.col("accuracy").alias("metric"), "mean", "low", "high", "n")
    out = found.join(gaps).select(F.lit(c).alias("best_c"), "metric", "mean", "low", "high", "n", "ece", "rms", "mce")  # one row each
    if merge_val:
        return out
    held = S.predict(rows.where("split = 'val'"), best, not many)
    t = (M.temperature_labels if many else M.temperature)(held)
    cooled = S.predict(rows.where("split = 'test'"), best / t, not many)
    again = M.calibration_labels(cooled, bins) if many else M.calibration(cooled, bins)
    return out.withColumn("temperature", F.lit(t)).join(again.select(*(F.col(x).alias(f"{x}_ts") for x in ("ece", "rms", "mce"))))


def evaluate_multilabel(train: DataFrame, test: DataFrame, places: int, c: float, passes: int = 400) -> DataFrame:
    """sample_id, place, y, prob of one sigmoid probe for each place of the label vectors: mean cross-entropy + |w|^2 / (2 C n) each."""
    marks = lambda df: df.withColumn("split", F.lit("train")).withColumn("labels", F.slice("labels", 1, places))
    w = S.fit(S.pack(marks(train), "labels"), [c], ("train",), False, passes)[0]
    out = S.predict(marks(test), w, False)
    return out.select("sample_id", F.posexplode(F.arrays_zip(F.col("labels").alias("y"), F.col("probs").alias("p"))).alias("place", "x")).select("sample_id", "place", F.col("x.y").cast("int").alias("y"), F.col("x.p").alias("prob"))


def probe_probabilities(rows: DataFrame, c: float, passes: int = 400) -> DataFrame:
    """split, sample_id, label, probs of train and test rows, from a probe fitted on train and val."""
    w = S.fit(S.pack(rows), [c], ("train", "val"), True, passes)[0]
    return S.predict(rows.where("split IN ('train', 'test')"), w).select("split", "sample_id", "label", "probs")


def second_moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, column sums and X'X of features: one partial sum for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = None
        for df in batches:
            x = np.stack(df["features"].to_numpy()).astype(float)
            m = np.column_stack([np.ones(len(x)), x])
            s = m.T @ m if s is None else s + m.T @ m
        if s is not None:
            yield pd.DataFrame({"i": np.repeat(np.arange(len(s)), len(s)), "j": np.tile(np.arange(len(s)), len(s)), "v": s.ravel()})

    t = rows.select("features").mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # dimensions squared
    g = np.zeros((int(t["i"].max()) + 1,) * 2) if len(t) else np.zeros((1, 1))
    g[t["i"], t["j"]] = t["v"]
    return int(round(g[0, 0])), g[0, 1:], g[1:, 1:]


def spectrum(rows: DataFrame, cap: int | None = 10_000, seed: int = 0) -> DataFrame:
    """effective_rank, participation_ratio, pc1, pc10, anisotropy (0 to 1) of the features' covariance; no variance is an error.

    Without ``cap`` all rows count; one pass of partial second moments serves any number of them.
    """
    if cap is not None:
        rows = subsample(rows, cap, seed)
    n, s, q = second_moments(rows)
    values = np.linalg.eigvalsh(q - np.outer(s, s) / max(n, 1))[::-1].clip(min=0) if n else np.zeros(0)
    if not values.sum() > 0:
        raise ValueError("features without variance")
    p = values / values.sum()
    d = min(len(p), n - 1)
    rank = float(np.exp(-(p[p > 0] * np.log(p[p > 0])).sum()))
    ratio = float(1 / (p * p).sum())
    flat = float(np.clip(1 - (ratio - 1) / (d - 1), 0, 1)) if d > 1 else 1.0
    return rows.sparkSession.createDataFrame([(rank, ratio, float(p[0]), float(p[:10].sum()), flat)], "effective_rank double, participation_ratio double, pc1 double, pc10 double, anisotropy double")


def two_nn(rows: DataFrame) -> DataFrame:
    """two_nn: slope through the origin of -log(1 - F) on log(d2 / d1), F the rank share; the last rank is left out."""
    near = nonzero_two(rows).withColumn("x", F.log(F.col("d2") / F.col("d1")))
    n = near.count()
    ranked = near.withColumn("k", F.row_number().over(Window.orderBy("x", "sample_id"))).where(F.col("k") < n)  # a capped sample
    y = -F.log(1 - F.col("k") / n)
    return ranked.agg((F.sum(F.col("x") * y) / F.sum(F.col("x") * F.col("x"))).alias("two_nn"))


def mle_dimension(rows: DataFrame, k: int = 20) -> DataFrame:
    """mle: mean of the inverse mean log ratios of the k-th to nearer distances (Levina and Bickel)."""
    near = neighbours(rows, rows, k, exclude_self=True).where("distance > 0")
    each = near.groupBy("sample_id").agg(F.max("distance").alias("top"), F.count("*").alias("n"), F.sum(F.log("distance")).alias("s")).where("n > 2")
    m = (F.col("n") - 2) / (F.col("n") * F.log("top") - F.col("s"))
    return each.where(F.col("n") * F.log("top") > F.col("s")).agg(F.avg(m).alias("mle"))


def pca_dimension(rows: DataFrame, ratio: float = 0.05) -> DataFrame:
    """lpca: covariance eigenvalues over ``ratio`` of the largest."""
    n, s, q = second_moments(rows)
    values = np.linalg.eigvalsh(q - np.outer(s, s) / n)
    return rows.sparkSession.createDataFrame([(int((values > ratio * values.max()).sum()),)], "lpca long")


ESTIMATORS = ("two_nn", "mle", "lpca")
SPECTRUM = ("effective_rank", "participation_ratio", "pc1", "pc10", "anisotropy")


def diagnostic_rows(rows: DataFrame, splits: Sequence[str], cap: int = 10_000, stored: DataFrame | None = None) -> DataFrame:
    """metric_name, metric_value: ``spectrum_<m>_<split>`` and ``id_<m>_<split>`` of each split; NaN where a split has no variance.

    Metrics that ``stored`` (metric_name) holds are left out, and what they alone need is not computed.
    """
    kinds = [("spectrum", m) for m in SPECTRUM] + [("id", m) for m in ESTIMATORS]
    spark = rows.sparkSession
    wanted = {(k, m, s) for k, m in kinds for s in splits}
    if stored is not None:
        named = spark.createDataFrame([(f"{k}_{m}_{s}", k, m, s) for k, m, s in sorted(wanted)], "metric_name string, k string, m string, s string")
        wanted = {(r.k, r.m, r.s) for r in named.join(stored.select("metric_name"), "metric_name", "left_anti").collect()}
    jobs = {"two_nn": two_nn, "mle": mle_dimension, "lpca": pca_dimension}
    out = spark.createDataFrame([], "metric_name string, metric_value double")
    for s in splits:
        due = [(k, m) for k, m in kinds if (k, m, s) in wanted]
        if not due:
            continue
        part = written(subsample(rows.where(F.col("split") == s), cap), "capped")
        try:
            if not second_moments(part)[0]:
                raise ValueError("no rows")
            tables = [spectrum(part, cap)]  # says whether there is variance
            tables += [jobs[m](part) for k, m in due if k == "id"]
        except ValueError:
            tables = [spark.createDataFrame([(float("nan"),) * len(kinds)], ", ".join(f"{m} double" for _, m in kinds))]
        table = tables[0]
        for t in tables[1:]:
            table = table.join(t)  # one row each
        made = table.select(F.explode(F.array(*(F.struct(F.lit(f"{k}_{m}_{s}").alias("metric_name"), F.col(m).cast("double").alias("metric_value")) for k, m in due))).alias("m")).select("m.*")
        out = out.unionByName(made)
    return out
