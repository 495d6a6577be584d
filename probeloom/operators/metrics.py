"""Scores of predictions: accuracy, average precision, calibration, confusion matrices, bootstrap intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probeloom.functions.draws import index_draws, poisson_weights
from probeloom.operators.ranges import running


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def average_precision(rows: DataFrame, *by: str, score: str = "score", positive: str = "positive") -> DataFrame:
    """Average precision per group; equal scores are one threshold; null where nothing is positive.

    Rows are first added up per distinct score; running sums over these are taken in ranges, not in a window over a group.
    """
    steps = rows.groupBy(*by, score).agg(F.sum(F.col(positive).cast("double")).alias("tp"), F.count("*").alias("n"))
    total = F.sum("tp")
    found = precision_steps(steps, by, score).groupBy(*by).agg(F.when(total > 0, F.sum("part") / total).alias("ap"), F.coalesce(total.cast("long"), F.lit(0)).alias("n_positive"))
    return found


def precision_steps(steps: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """steps (by, score, tp, n: one row for each score of a group) with part: the score's positives times the precision from it up."""
    run = running(steps, by, ((score, True),), all_tp=F.col("tp"), all_n=F.col("n"))
    return run.withColumn("part", F.col("tp") * F.col("all_tp") / F.col("all_n")).drop("all_tp", "all_n")


def binomial_draws(n: int, hits: int, resamples: int, seed: int = 0) -> np.ndarray:
    """Draws from the binomial law of n trials with share hits / n: the inverse of its distribution at hashed numbers.

    Twelve deviations on either side of the mean are tabulated, so the table grows with the root of n.
    """
    if not 0 < hits < n:
        return np.full(resamples, hits)
    share = hits / n
    reach = 12 * np.sqrt(n * share * (1 - share)) + 12
    low, high = max(0, int(hits - reach)), min(n, int(hits + reach) + 1)
    k = np.arange(low, high)
    steps = np.concatenate([[0.0], np.cumsum(np.log((n - k) / (k + 1)) + np.log(share / (1 - share)))])
    law = np.cumsum(np.exp(steps - steps.max()))
    u = [(int(hashlib.md5(f"{seed}:{n}:{hits}:{r}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32 for r in range(1, resamples + 1)]
    return low + np.minimum(np.searchsorted(law / law[-1], u, "left"), high - low)


def bootstrap_accuracy(rows: DataFrame, *by: str, resamples: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """accuracy with its bootstrap mean and percentile interval; resampling 0/1 outcomes is a binomial draw, so only counts are needed."""
    found = accuracy(rows, *by)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = [binomial_draws(int(n), int(round(a * n)), resamples, seed) / n for a, n in zip(df["accuracy"], df["n"], strict=True)]
            yield df.assign(mean=[x.mean() for x in out], low=[np.quantile(x, (1 - level) / 2) for x in out], high=[np.quantile(x, (1 + level) / 2) for x in out])

    return found.mapInPandas(draw, ", ".join([*(f"{c} {found.schema[c].dataType.simpleString()}" for c in found.columns), "mean double, low double, high double"]))


def bootstrap_ap(rows: DataFrame, unit: str, resamples: int = 100, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Interval of micro average precision when units (samples) are resampled; draws without positives are left out."""
    drawn = poisson_weights(rows.select(unit, "score", "positive"), unit, resamples, seed)
    steps = drawn.groupBy("r", "score").agg(F.sum(F.col("w") * F.col("positive")).cast("double").alias("tp"), F.sum("w").alias("n"))
    each = precision_steps(steps, ("r",), "score").groupBy("r").agg((F.sum("part") / F.nullif(F.sum("tp"), F.lit(0.0))).alias("ap")).where("ap IS NOT NULL")
    return each.agg(F.avg("ap").alias("mean"), F.percentile("ap", (1 - level) / 2).alias("low"), F.percentile("ap", (1 + level) / 2).alias("high"))


def calibration(rows: DataFrame, n_bins: int, probs: str = "probs", label: str = "label") -> DataFrame:
    """Expected, root-mean-square and largest gap between confidence and accuracy over equal bins, closed on the left.

    Rows are scaled to sum one; the confidence is the largest probability, of equals the first class.
    """
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    conf = F.array_max(probs) / total
    right = ((F.array_position(probs, F.array_max(probs)) - 1) == F.col(label)).cast("double")
    binned = rows.select(conf.alias("conf"), right.alias("right")).withColumn("bin", F.floor(F.col("conf") * n_bins))
    bins = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg("right").alias("acc"))
    gap = F.abs(F.col("conf") - F.col("acc"))
    return bins.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.sqrt(F.sum(F.col("n") * gap * gap) / F.sum("n")).alias("rms"), F.max(gap).alias("mce"))


def calibration_labels(rows: DataFrame, n_bins: int, probs: str = "probs", labels: str = "labels") -> DataFrame:
    """The same three gaps for label vectors: of each label's probability against the label, averaged over the labels that have both outcomes (NaN without any)."""
    each = rows.select(F.posexplode(F.arrays_zip(F.col(probs).alias("p"), F.col(labels).alias("y"))).alias("place", "x")).select("place", F.least(F.greatest(F.col("x.p").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("p"), F.col("x.y").cast("double").alias("y"))
    bins = each.groupBy("place", F.floor(F.col("p") * n_bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("acc"), F.min("y").alias("low"), F.max("y").alias("high"))
    gap = F.abs(F.col("conf") - F.col("acc"))
    places = bins.groupBy("place").agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.sqrt(F.sum(F.col("n") * gap * gap) / F.sum("n")).alias("rms"), F.max(gap).alias("mce"), (F.min("low") < F.max("high")).alias("both"))
    return places.where("both").agg(*(F.coalesce(F.avg(c), F.lit(float("nan"))).alias(c) for c in ("ece", "rms", "mce")))


def confusions(masks: DataFrame, n_classes: int, ignore: int = 255) -> DataFrame:
    """image_id, t, p, n from pixel arrays ``mask`` and ``pred``: counted within each row, cells alone are shuffled on."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for i, m, p in zip(df["image_id"], df["mask"], df["pred"], strict=True):
                m, p = np.asarray(m), np.asarray(p)
                here = m != ignore
                cells = np.bincount(m[here] * n_classes + p[here], minlength=n_classes * n_classes)
                out += [(i, k // n_classes, k % n_classes, int(cells[k])) for k in np.flatnonzero(cells)]
            yield pd.DataFrame(out, columns=["image_id", "t", "p", "n"])

    return masks.select("image_id", "mask", "pred").mapInPandas(count, "image_id long, t int, p int, n long").groupBy("image_id", "t", "p").agg(F.sum("n").alias("n"))


def class_counts(cells: DataFrame, *by: str) -> DataFrame:
    """Per class: true positives, labelled and predicted pixels, from confusion cells (t, p, n)."""
    both = cells.select(*by, F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("labelled"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("labelled"), F.col("n").alias("predicted")))).alias("x"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    return both.groupBy(*by, F.col("x.c").alias("class")).agg((F.sum("hit") / 2).alias("tp"), F.sum("x.labelled").alias("labelled"), F.sum("x.predicted").alias("predicted"))


def segmentation_scores(cells: DataFrame) -> DataFrame:
    """Mean and frequency-weighted IoU, macro precision, recall and F1; classes that occur nowhere do not count."""
    c = class_counts(cells)
    union = F.col("labelled") + F.col("predicted") - F.col("tp")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return c.where(union > 0).agg(
        F.avg(F.col("tp") / union).alias("miou"), (F.sum(F.col("tp") / union * F.col("labelled")) / F.sum("labelled")).alias("fw_iou"),
        F.avg(ratio(F.col("tp"), F.col("predicted"))).alias("precision"), F.avg(ratio(F.col("tp"), F.col("labelled"))).alias("recall"), F.avg(2 * F.col("tp") / (F.col("labelled") + F.col("predicted"))).alias("f1"),
    )


def bootstrap_miou(cells: DataFrame, resamples: int = 100, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Interval of the mean IoU when images are resampled; replicate weights are summed per cell before the next shuffle. Under one resample: NaN."""
    if resamples < 1:
        return cells.sparkSession.createDataFrame([(float("nan"),) * 3], "mean double, low double, high double")
    drawn = poisson_weights(cells.select("image_id", "t", "p", "n"), "image_id", resamples, seed)
    summed = drawn.groupBy("r", "t", "p").agg(F.sum(F.col("w") * F.col("n")).alias("n"))
    c = class_counts(summed, "r")
    union = F.col("labelled") + F.col("predicted") - F.col("tp")
    each = c.where(union > 0).groupBy("r").agg(F.avg(F.col("tp") / union).alias("miou"))
    return each.agg(F.avg("miou").alias("mean"), F.percentile("miou", (1 - level) / 2).alias("low"), F.percentile("miou", (1 + level) / 2).alias("high"))


def mean_delta_interval(deltas: DataFrame, by: str, resamples: int = 20_000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Per group: mean delta and its bootstrap interval. Groups of deltas are the comparisons of a study; those of equal size share their draws."""
    order = Window.partitionBy(by).orderBy("delta")
    known = deltas.where("delta IS NOT NULL").select(by, "delta", (F.row_number().over(order) - 1).alias("i"), F.count("*").over(Window.partitionBy(by)).alias("n"))
    means = known.join(index_draws(known, resamples, seed), ["n", "i"]).groupBy(by, "r").agg(F.avg("delta").alias("m"))
    spread = means.groupBy(by).agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))
    return known.groupBy(by).agg(F.avg("delta").alias("mean")).join(spread, by)


def temperature(rows: DataFrame, logits: str = "logits", label: str = "label", rounds: int = 15) -> float:
    """T = exp(t) that minimises the mean negative log likelihood of softmax(logits / T); each pass sums two derivatives."""
    top = rows.agg(F.max(F.size(logits)), F.max(label)).first()
    if top[0] is None or top[1] >= top[0]:
        raise ValueError("no rows, or a label that the logits do not have")
    high = F.array_repeat(F.array_max(logits), F.size(logits))  # outside the lambda, so that it is taken once for a row
    shifted = F.zip_with(logits, high, lambda x, h: x - h)
    own = F.element_at(logits, (F.col(label) + 1).cast("int"))

    def derivatives(scale: float) -> tuple[Column, Column]:
        e = F.transform(shifted, lambda x: F.exp(x * scale))
        sums = F.aggregate(F.zip_with(e, logits, lambda p, x: F.struct(p.alias("z"), (p * x).alias("a"), (p * x * x).alias("b"))), F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, x: F.struct((s["z"] + x["z"]).alias("z"), (s["a"] + x["a"]).alias("a"), (s["b"] + x["b"]).alias("b")))
        mean, square = sums["a"] / sums["z"], sums["b"] / sums["z"]
        return own - mean, square - mean * mean

    return _scaled(rows, derivatives, rounds)


def temperature_labels(rows: DataFrame, logits: str = "logits", labels: str = "labels", rounds: int = 15) -> float:
    """T = exp(t) that minimises the mean binary cross-entropy of sigmoid(logits / T) over all labels of all rows."""
    each = rows.select(F.explode(F.arrays_zip(F.col(logits).alias("z"), F.col(labels).alias("y"))).alias("x")).select(F.col("x.z").cast("double").alias("z"), F.col("x.y").cast("double").alias("y"))
    if each.isEmpty():
        raise ValueError("no labels")

    def derivatives(scale: float) -> tuple[Column, Column]:
        p = 1 / (1 + F.exp(-F.col("z") * scale))
        return F.col("z") * (F.col("y") - p), F.col("z") * F.col("z") * p * (1 - p)

    return _scaled(each, derivatives, rounds)


def _scaled(rows: DataFrame, derivatives: Callable[[float], tuple[Column, Column]], rounds: int) -> float:
    """exp(t) by Newton steps of one at most on a loss of exp(-t), whose first (negative) and second derivatives are means over rows; a pass for each step."""
    t = 0.0
    for _ in range(rounds):
        scale = float(np.exp(-t))
        g, h = rows.agg(*map(F.avg, derivatives(scale))).first()
        slope, curve = scale * g, scale * scale * h - scale * g  # of the loss in t
        step = slope / curve if curve > 1e-12 else np.sign(slope) * 0.5
        t -= float(np.clip(step, -1, 1))
        if abs(step) < 1e-8:
            break
    return float(np.exp(t))
