"""Label quality, confident learning, per-class reports, co-occurrence and duplicate groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probeloom.operators.metrics import average_precision
from probeloom.operators.ranges import placed


def label_quality(rows: DataFrame) -> DataFrame:
    """Rows with self-confidence, issue score, guessed label and its probability (of equals the first class)."""
    own = F.element_at("probs", (F.col("label") + 1).cast("int"))
    return rows.select("*", own.alias("quality"), (1 - own).alias("issue_score"), (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("guess"), F.array_max("probs").alias("max_prob"))


def label_issues(rows: DataFrame) -> DataFrame:
    """Rows with is_issue by confident learning, pruned by noise rate.

    A class's threshold is the mean self-confidence of its rows. A row counts for the class with the largest
    probability among those at or over their thresholds. The joint counts, scaled to the rows of each given
    class, set how many rows go from a given class to another, those with the largest margin first. Only
    rows that lean to another class are ranked, in ranges, so that no task holds all of a pair of classes.
    """
    known = rows.withColumn("quality", F.element_at("probs", (F.col("label") + 1).cast("int")))
    limits = known.groupBy("label").agg(F.avg("quality").alias("limit"), F.count("*").alias("n"))
    table = F.broadcast(limits.agg(F.map_from_entries(F.collect_list(F.struct("label", "limit"))).alias("limits")))  # a row for each class
    scored = known.join(table)
    sure = F.filter(F.transform("probs", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"), F.try_element_at("limits", i).alias("limit"))), lambda x: x["p"] >= x["limit"])
    scored = scored.withColumn("sure", -F.array_max(F.transform(sure, lambda x: F.struct(x["p"], x["i"])))["i"]).drop("limits")
    joint = scored.where("sure IS NOT NULL").groupBy("label", "sure").agg(F.count("*").alias("c"))
    total = joint.groupBy("label").agg(F.sum("c").alias("t"))
    quota = joint.join(total, "label").join(limits.select("label", "n"), "label").where("label <> sure").select("label", F.col("sure").alias("to"), F.round(F.col("c") / F.col("t") * F.col("n")).cast("int").alias("quota"))
    pairs = known.join(F.broadcast(quota), "label")  # classes squared rows
    margin = F.element_at("probs", (F.col("to") + 1).cast("int")) - F.col("quality")
    lean = pairs.withColumn("margin", margin).where("margin > 0")
    ranked = placed(lean.where("quota > 0").select("label", "to", "margin", "sample_id", "quota"), ("label", "to"), (("margin", True), "sample_id"), "k").where("k <= quota")
    return known.join(ranked.select("sample_id").distinct().withColumn("is_issue", F.lit(True)), "sample_id", "left").withColumn("is_issue", F.coalesce("is_issue", F.lit(False)))


def class_report(rows: DataFrame) -> DataFrame:
    """Per given class: rows, accuracy, average precision of its probability against all other rows, flagged rows and their
    share, the class most often guessed for flagged rows and how often (-1, 0 without any), the other class most often
    guessed for its rows and its share of them (0, 0 without errors), mean quality. Of equally frequent classes the lowest.
    """
    pairs = rows.groupBy("label", "guess").agg(F.count("*").alias("c"), F.count_if("is_issue").alias("f"))  # classes squared
    most = lambda c, keep: F.min(F.when(keep, F.struct((-F.col(c)).alias("c"), "guess")))
    tops = pairs.groupBy("label").agg(most("c", F.col("label") != F.col("guess")).alias("wrong"), most("f", F.col("f") > 0).alias("flagged"))
    base = rows.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("guess")).cast("double")).alias("acc"), F.count_if("is_issue").alias("n_flagged"), F.avg(F.col("is_issue").cast("double")).alias("flag_rate"), F.avg("quality").alias("mean_quality"))
    marks = rows.select("label", F.posexplode("probs").alias("class", "p")).withColumn("y", F.col("label") == F.col("class"))
    ap = average_precision(marks, "class", score="p", positive="y").select(F.col("class").alias("label"), "ap")
    out = base.join(tops, "label").join(ap, "label")
    return out.select(
        "label", "n", "acc", "ap", "n_flagged", "flag_rate", F.coalesce("flagged.guess", F.lit(-1)).alias("top_flagged"), F.coalesce(-F.col("flagged.c"), F.lit(0)).alias("top_flagged_n"),
        F.coalesce("wrong.guess", F.lit(0)).alias("top_confused"), F.coalesce(-F.col("wrong.c") / F.col("n"), F.lit(0.0)).alias("confused_share"), "mean_quality",
    )


def _places(rows: DataFrame, *keep: str) -> DataFrame:
    """place, y, p (probability of the label) of every label of every row."""
    each = rows.select(*keep, F.posexplode(F.arrays_zip("labels", "probs")).alias("place", "x"))
    return each.select(*keep, "place", F.col("x.labels").cast("int").alias("y"), F.col("x.probs").cast("double").alias("p"))


def multilabel_issues(rows: DataFrame) -> DataFrame:
    """sample_id, place, y, p, is_issue: confident learning of ``label_issues`` for each label as a problem of two classes.

    Thresholds and quotas are a few numbers for each label and travel by broadcast; only rows that lean to the
    other class are ranked, in ranges.
    """
    each = _places(rows, "sample_id").withColumn("quality", F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")))
    limits = each.groupBy("place").agg(*(F.avg(F.when(F.col("y") == k, F.col("quality"))).alias(f"t{k}") for k in (0, 1)), *(F.count_if(F.col("y") == k).alias(f"n{k}") for k in (0, 1)))
    limited = each.join(F.broadcast(limits), "place")  # a row for each label
    no, yes = F.coalesce(1 - F.col("p") >= F.col("t0"), F.lit(False)), F.coalesce(F.col("p") >= F.col("t1"), F.lit(False))
    sure = F.when(no & yes, (F.col("p") > 0.5).cast("int")).when(yes, 1).when(no, 0)
    joint = limited.withColumn("sure", sure).where("sure IS NOT NULL").groupBy("place", "y").agg(F.count("*").alias("t"), F.count_if(F.col("sure") != F.col("y")).alias("c"), F.first("n0").alias("n0"), F.first("n1").alias("n1"))
    n = F.when(F.col("y") == 1, F.col("n1")).otherwise(F.col("n0"))
    quota = joint.select("place", "y", F.round(F.col("c") / F.col("t") * n).cast("int").alias("quota"))
    lean = each.where("quality < 0.5").join(F.broadcast(quota), ["place", "y"])  # two rows for each label
    ranked = placed(lean.where("quota > 0").select("place", "y", "quality", "sample_id", "quota"), ("place", "y"), ("quality", "sample_id"), "k").where("k <= quota")
    flags = ranked.select("sample_id", "place", F.lit(True).alias("is_issue"))
    return each.join(flags, ["sample_id", "place"], "left").select("sample_id", "place", "y", "p", F.coalesce("is_issue", F.lit(False)).alias("is_issue"))


def multilabel_samples(rows: DataFrame, issues: DataFrame, alpha: float = 0.8) -> DataFrame:
    """sample_id, n_pos_given, n_pos_pred, issue_score, is_issue (any label is one).

    The score is 1 less the labels' self-confidences, averaged exponentially from the best to the worst, the worst with weight ``alpha``.
    """
    own = F.transform(F.arrays_zip("labels", "probs"), lambda x: F.when(x["labels"] == 1, x["probs"].cast("double")).otherwise(1 - x["probs"].cast("double")))
    best = F.reverse(F.array_sort(own))
    quality = F.aggregate(F.slice(best, 2, F.greatest(F.size(best) - 1, F.lit(0))), best[0], lambda a, x: alpha * x + (1 - alpha) * a)
    flagged = issues.where("is_issue").select("sample_id").distinct().withColumn("is_issue", F.lit(True))
    count = lambda c, f: F.size(F.filter(c, f)).cast("int")
    out = rows.select("sample_id", count("labels", lambda y: y == 1).alias("n_pos_given"), count("probs", lambda p: p > 0.5).alias("n_pos_pred"), (1 - quality).alias("issue_score"))
    return out.join(flagged, "sample_id", "left").withColumn("is_issue", F.coalesce("is_issue", F.lit(False)))


def multilabel_report(rows: DataFrame) -> DataFrame:
    """Per label place of label vectors: positives, predicted positives, average precision, flagged rows and their share, flag rates among positives and negatives, and the nearest other label by Jaccard index."""
    y = F.col("y") == 1
    counts = multilabel_issues(rows).groupBy("place").agg(
        F.count_if(y).alias("n_pos"), F.count_if(F.col("p") > 0.5).alias("n_pred_pos"), F.count_if("is_issue").alias("n_flagged"), F.avg(F.col("is_issue").cast("double")).alias("flag_rate"),
        (F.count_if(F.col("is_issue") & y) / F.greatest(F.count_if(y), F.lit(1))).alias("flag_rate_pos"), (F.count_if(F.col("is_issue") & ~y) / F.greatest(F.count_if(~y), F.lit(1))).alias("flag_rate_neg"),
    )
    ap = average_precision(_places(rows), "place", score="p", positive="y").select("place", "ap")
    return counts.join(ap, "place").join(nearest_label(rows), "place")


def nearest_label(rows: DataFrame) -> DataFrame:
    """Per label place: the other place with the largest Jaccard index over samples (ties: the lower; -1 if none meets it)."""
    places = F.filter(F.transform("labels", lambda y, i: F.when(y == 1, i)), lambda i: i.isNotNull())
    on = rows.select(places.alias("on"))
    single = on.select(F.explode("on").alias("a")).groupBy("a").agg(F.count("*").alias("n"))
    pairs = on.select(F.explode("on").alias("a"), "on").select("a", F.explode("on").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("both"))
    scored = pairs.join(single, "a").join(single.select(F.col("a").alias("b"), F.col("n").alias("m")), "b").withColumn("jaccard", F.col("both") / (F.col("n") + F.col("m") - F.col("both")))
    best = scored.groupBy("a").agg(F.min(F.struct(-F.col("jaccard"), "b"))["b"].alias("nearest"), F.max("jaccard").alias("jaccard"))
    every = rows.select(F.posexplode("labels").alias("a", "y")).select("a").distinct()
    return every.join(best, "a", "left").select(F.col("a").alias("place"), F.coalesce("nearest", F.lit(-1)).alias("nearest"), F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"))


def audit_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: rows, flagged rows, rate, and the most frequent confusion among them as ``given->guess:count``."""
    base = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("is_issue").alias("n_flagged"), F.avg(F.col("is_issue").cast("double")).alias("rate"))
    pairs = rows.where("is_issue AND label <> guess").groupBy(*by, "label", "guess").agg(F.count("*").alias("c"))
    top = pairs.groupBy(*by).agg(F.min(F.struct((-F.col("c")).alias("m"), "label", "guess")).alias("x"))
    top = top.select(*by, F.format_string("%d->%d:%d", "x.label", "x.guess", -F.col("x.m")).alias("top_pair"))
    return base.join(top, list(by), "left")


def top_flagged(rows: DataFrame, by: Sequence[str], k: int, score: str = "issue_score") -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), "sample_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def worst_classes(report: DataFrame, rate: str, k: int) -> DataFrame:
    return report.orderBy(F.col(rate).desc(), "label").limit(k)


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """Hashes that occur in several datasets: rows and the sorted list of datasets. Counted per dataset first."""
    counts = rows.groupBy("hash", "dataset").agg(F.count("*").alias("n"))
    return counts.groupBy("hash").agg(F.sum("n").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("dataset"))).alias("datasets"), F.count("*").alias("k")).where("k > 1").drop("k")


def leaks(rows: DataFrame) -> DataFrame:
    """train and test datasets that share hashes, with the shared hashes and rows on either side; hashes are pre-counted."""
    counts = rows.groupBy("hash", "dataset", "split").agg(F.count("*").alias("n"))
    a, b = counts.where("split = 'train'").select("hash", F.col("dataset").alias("train_set"), F.col("n").alias("x")), counts.where("split = 'test'").select("hash", F.col("dataset").alias("test_set"), F.col("n").alias("y"))
    return a.join(b, "hash").groupBy("train_set", "test_set").agg(F.count("*").alias("hashes"), F.sum("x").alias("train_rows"), F.sum("y").alias("test_rows"))
