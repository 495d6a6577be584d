"""Ranks, complete-coverage views, ratings and their agreement, from long result rows (model, dataset, score)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probeloom.functions.draws import index_draws
from probeloom.functions.keys import clean, floored
from probeloom.sources.place import written


def average_rank(score: str, *by: str) -> Column:
    """Rank within ``by``, best first, ties sharing the mean of their places."""
    part = Window.partitionBy(*by)
    return F.rank().over(part.orderBy(F.col(score).desc())) + (F.count("*").over(Window.partitionBy(*by, score)) - 1) / 2


def bench_scores(rows: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """One score for each model and dataset: its tasks' floored scores averaged; with the dataset's family."""
    value = floored(F.col("metric_name"), clean(F.col("metric_value")))
    out = rows.groupBy("model_name", "dataset").agg(F.avg(value).alias("score"))
    if families is None:
        return out
    return out.join(families.select("dataset", "family"), "dataset", "left").withColumn("family", F.coalesce("family", F.lit("other")))


def family_board(scores: DataFrame) -> DataFrame:
    """Per model and family, and over all as ``macro``: mean average-tie rank, mean score, datasets."""
    ranked = scores.where("score IS NOT NULL").withColumn("rank", average_rank("score", "dataset"))
    wide = ranked.withColumn("family", F.explode(F.array("family", F.lit("macro"))))
    return wide.groupBy("model_name", "family").agg(F.avg("rank").alias("mean_rank"), F.avg("score").alias("mean_score"), F.count("*").alias("n"))


def split_views(rows: DataFrame, views: Sequence[str] = ("random", "spatial"), both: str = "official") -> DataFrame:
    """Rows once for each view that they count in: their own split's, or all if their split is official."""
    return rows.withColumn("view", F.explode(F.array(*map(F.lit, views)))).where((F.col("split") == F.col("view")) | (F.col("split") == both))


def prefer_substitutes(rows: DataFrame, keys: Sequence[str], flag: str = "is_substitute") -> DataFrame:
    """Plain rows go where a substitute row of the same key exists."""
    some = F.max(F.col(flag).cast("int")).over(Window.partitionBy(*keys))
    return rows.withColumn("_some", some).where(F.col(flag) | (F.col("_some") == 0)).drop("_some")


def harmonise(rows: DataFrame, drop_datasets: Sequence[str], metric_names: dict[str, str], aliases: dict[str, str]) -> DataFrame:
    """Raw rows as quality rows: datasets dropped, metrics and models named canonically, pooling and substitute from the name.

    A blank normalisation is an error; rows without a numeric score go.
    """
    df = rows.where(~F.col("dataset").isin(*drop_datasets) & F.col("metric_name").isin(*metric_names))
    if not df.where(F.coalesce(F.trim("normalization"), F.lit("")) == "").isEmpty():
        raise ValueError("rows without a normalisation")
    lookup = lambda table, c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), c) if table else c
    base = F.regexp_replace("name", "(_cls|_sub)$", "")
    return df.select(
        "*", F.when(F.col("name").endswith("_cls"), "cls").otherwise("mean").alias("pooling"), F.col("name").endswith("_sub").alias("is_substitute"),
        lookup(aliases, base).alias("model"), lookup(metric_names, F.col("metric_name")).alias("metric"), clean(F.col("metric_value").try_cast("double")).alias("score"),
    ).where("score IS NOT NULL")


def alias_collisions(rows: DataFrame, keys: Sequence[str], source: str = "name") -> DataFrame:
    """Keys under which several source models or several rows meet; a board over such rows would be wrong."""
    found = rows.groupBy(*keys).agg(F.countDistinct(source).alias("sources"), F.count("*").alias("n_rows"))
    return found.where("sources > 1 OR n_rows > 1")


def complete_view(rows: DataFrame, prefer: Sequence[str] = ("model_native", "bandspec_zscore")) -> DataFrame:
    """The rows of models that cover every dataset and metric under one normalisation, the preferred one that is complete."""
    cells = rows.select("dataset", "metric").distinct().count()
    have = rows.groupBy("model", "normalization").agg(F.countDistinct("dataset", "metric").alias("cells"), F.count("*").alias("n")).where((F.col("cells") == cells) & (F.col("n") == cells))
    place = F.array_position(F.array(*map(F.lit, prefer)), F.col("normalization"))
    best = have.where(place > 0).groupBy("model").agg(F.min_by("normalization", place).alias("normalization"))
    return rows.join(best, ["model", "normalization"], "left_semi")


def mean_rank(scores: DataFrame) -> DataFrame:
    """Per model: mean average-tie rank over datasets."""
    return scores.withColumn("rank", average_rank("score", "dataset")).groupBy("model").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n"))


def won_pairs(scores: DataFrame) -> DataFrame:
    """dataset, a, b, won (1, 0 or, for equal scores, one half) of every ordered pair of models on every dataset."""
    a, b = scores.select("dataset", F.col("model").alias("a"), F.col("score").alias("x")), scores.select("dataset", F.col("model").alias("b"), F.col("score").alias("y"))
    won = F.when(F.col("x") > F.col("y"), 1.0).when(F.col("x") == F.col("y"), 0.5).otherwise(0.0)
    return a.join(b, "dataset").where("a <> b").select("dataset", "a", "b", won.alias("won"))


def wins(scores: DataFrame) -> DataFrame:
    """a, b, wins of a over b (ties count half) and datasets in common, of every ordered pair of models."""
    return won_pairs(scores).groupBy("a", "b").agg(F.sum("won").alias("wins"), F.count("*").alias("n"))


def fit_ratings(won: np.ndarray, rounds: int = 500, tolerance: float = 1e-12) -> np.ndarray:
    """Bradley-Terry strengths of win tables (..., models, models) on a scale of 400 log10, mean 1000; half a win smooths each pair that met."""
    won = won + 0.5 * (won + np.swapaxes(won, -1, -2) > 0)
    games, strength = won + np.swapaxes(won, -1, -2), np.ones(won.shape[:-1])
    for _ in range(rounds):
        before = strength
        strength = won.sum(-1) / np.maximum((games / (before[..., :, None] + before[..., None, :])).sum(-1), 1e-300)
        strength = strength / np.exp(np.log(strength).mean(-1, keepdims=True))
        if np.abs(strength - before).max(initial=0) < tolerance:
            break
    return 1000 + 400 * np.log10(strength)


def ratings(table: list[tuple[str, str, float]], rounds: int = 500) -> dict[str, float]:
    """Ratings of one table of (a, b, wins of a over b)."""
    names = sorted({x for a, b, _ in table for x in (a, b)})
    at = {n: i for i, n in enumerate(names)}
    won = np.zeros((len(names), len(names)))
    for a, b, w in table:
        won[at[a], at[b]] += w
    return dict(zip(names, map(float, fit_ratings(won, rounds)), strict=True))


def elo(scores: DataFrame, resamples: int = 0, seed: int = 0, rounds: int = 500) -> DataFrame:
    """model, rating, and the 2.5 and 97.5 percentiles over resamples of as many datasets, drawn with replacement.

    Wins are summed per resample before the fit; the tables of many resamples (models squared each) are fitted
    together in a task.
    """
    places = scores.select("dataset").distinct().withColumn("i", F.row_number().over(Window.orderBy("dataset")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))  # a row for each dataset
    drawn = places.select("dataset", F.lit(0).alias("r"), F.lit(1).alias("w"))
    if resamples:
        drawn = drawn.union(index_draws(places, resamples, seed).join(places, ["n", "i"]).groupBy("dataset", "r").agg(F.count("*").alias("w")).select("dataset", "r", "w"))
    sums = won_pairs(scores).join(drawn, "dataset").groupBy("r", "a", "b").agg(F.sum(F.col("won") * F.col("w")).alias("wins"))

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        same = df.groupby("r")["a"].agg(lambda x: tuple(sorted(set(x))))  # models of a resample; those that met nobody are not rated
        for names, rs in same.groupby(same).groups.items():
            part = df[df["r"].isin(rs)]
            number, at = {r: i for i, r in enumerate(rs)}, {n: i for i, n in enumerate(names)}
            won = np.zeros((len(rs), len(names), len(names)))
            won[part["r"].map(number), part["a"].map(at), part["b"].map(at)] = part["wins"]
            out.append(pd.DataFrame({"r": np.repeat(list(rs), len(names)), "model": list(names) * len(rs), "rating": fit_ratings(won, rounds).ravel()}))
        return pd.concat(out)

    each = sums.withColumn("block", F.floor(F.col("r") / 64)).groupBy("block").applyInPandas(fit, "r int, model string, rating double")
    again = F.when(F.col("r") > 0, F.col("rating"))
    return each.groupBy("model").agg(F.max(F.when(F.col("r") == 0, F.col("rating"))).alias("rating"), F.percentile(again, 0.025).alias("low"), F.percentile(again, 0.975).alias("high"))


def improvability(scores: DataFrame) -> DataFrame:
    """Per model: mean share (%) of its remaining error that it must remove to tie each dataset's best."""
    best = F.max("score").over(Window.partitionBy("dataset"))
    gap = F.when(F.col("score") == F.col("best"), 0.0).otherwise(100 * (F.col("best") - F.col("score")) / (1 - F.col("score")))
    return scores.withColumn("best", best).groupBy("model").agg(F.avg(gap).alias("improvability"))


def cost_conflicts(costs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with several values of a cost, or with one that is no finite number."""
    number = F.col(value).try_cast("double")
    filled = costs.where(F.coalesce(F.trim(F.col(value).cast("string")), F.lit("")) != "")
    found = filled.groupBy(*keys).agg(F.countDistinct(number).alias("values"), F.count_if(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))).alias("bad"))
    return found.where("values > 1 OR bad > 0")


def extract_costs(costs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One cost for each key; conflicting or non-numeric values are an error."""
    if not cost_conflicts(costs, keys, value).isEmpty():
        raise ValueError(f"conflicting or non-numeric {value}")
    return costs.groupBy(*keys).agg(F.max(F.col(value).try_cast("double")).alias(value)).where(F.col(value).isNotNull())


def with_costs(rows: DataFrame, costs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(costs, list(keys), "left")


def delta_to(rows: DataFrame, keys: Sequence[str], variant: str, base: str, value: str = "score") -> DataFrame:
    """Each variant's difference from the base variant of the same key; null where the base is missing.

    The rows are written first, so that both sides read the same values: sums of doubles that are computed twice differ
    in their last digits, and the base variant would seem better or worse than itself.
    """
    rows = written(rows, "variants")
    control = rows.where(F.col(variant) == base).select(*keys, F.col(value).alias("base"))
    return rows.join(control, list(keys), "left").withColumn("delta", F.col(value) - F.col("base"))


def variant_summary(deltas: DataFrame, variant: str) -> DataFrame:
    """Per variant: count, mean, median, least and largest delta, how many improved and regressed."""
    d = F.col("delta")
    return deltas.where("delta IS NOT NULL").groupBy(variant).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.median(d).alias("median"), F.min(d).alias("least"), F.max(d).alias("most"), F.count_if(d > 0).alias("improved"), F.count_if(d < 0).alias("regressed"))


def best_variant(rows: DataFrame, variant: str) -> DataFrame:
    """Per model: the variant with the best mean score (ties: the first by name)."""
    means = rows.groupBy("model", variant).agg(F.avg("score").alias("score"))
    return means.groupBy("model").agg(F.min(F.struct(-F.col("score"), F.col(variant)))[variant].alias("best"))


def kendall(views: DataFrame) -> DataFrame:
    """Kendall tau-b of every pair of views (view, model, rank), on the models that both hold."""
    a, b = views.select(F.col("view").alias("va"), "model", F.col("rank").alias("ra")), views.select(F.col("view").alias("vb"), "model", F.col("rank").alias("rb"))
    shared = a.join(b, "model")
    left, right = shared.select("va", "vb", F.col("model").alias("m1"), F.col("ra").alias("a1"), F.col("rb").alias("b1")), shared.select("va", "vb", F.col("model").alias("m2"), F.col("ra").alias("a2"), F.col("rb").alias("b2"))
    pairs = left.join(right, ["va", "vb"]).where("m1 < m2")
    x, y = F.signum(F.col("a1") - F.col("a2")), F.signum(F.col("b1") - F.col("b2"))
    sums = pairs.groupBy("va", "vb").agg(F.sum(x * y).alias("s"), F.sum(F.abs(x)).alias("nx"), F.sum(F.abs(y)).alias("ny"))
    sizes = shared.groupBy("va", "vb").agg(F.count("*").alias("n_models"))
    tau = F.when((F.col("nx") > 0) & (F.col("ny") > 0), F.col("s") / F.sqrt(F.col("nx") * F.col("ny")))
    return sizes.join(sums, ["va", "vb"], "left").select("va", "vb", "n_models", tau.alias("tau"), (F.col("n_models") < 10).alias("few"))


def paired_settings(rows: DataFrame, keys: Sequence[str], setting: str, a: str, b: str) -> DataFrame:
    """The same cell under two settings: both scores and b - a."""
    one = rows.where(F.col(setting) == a).select(*keys, F.col("score").alias("score_a"))
    two = rows.where(F.col(setting) == b).select(*keys, F.col("score").alias("score_b"))
    return one.join(two, list(keys)).withColumn("delta", F.col("score_b") - F.col("score_a"))


def top_row(rows: DataFrame, by: Sequence[str], score: str = "metric_value", tie: str = "append_seq") -> DataFrame:
    """The best row of each group; of equals the first appended."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def view_keys(rows: DataFrame, order: dict[str, Sequence[str]]) -> DataFrame:
    """The distinct slices of the rows, numbered in the preferred order of each column's values (others after, by name)."""
    keys = list(order)
    sort = [x for k in keys for x in (F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order[k])), F.col(k)), F.lit(0)), F.lit(1_000_000)), F.col(k))]
    return rows.select(*keys).distinct().withColumn("place", F.row_number().over(Window.orderBy(*sort)))  # a few slices


def first_metric(rows: DataFrame, seq: str = "append_seq") -> DataFrame:
    """Per dataset: the metric of its first row."""
    return rows.groupBy("dataset").agg(F.min_by("metric_name", seq).alias("metric_name"))


def median_winner(rows: DataFrame) -> DataFrame:
    """Per dataset: the median score over models and the winner (ties: the first by name)."""
    return rows.groupBy("dataset").agg(F.median("score").alias("median"), F.min(F.struct(-F.col("score"), F.col("model")))["model"].alias("winner"))
