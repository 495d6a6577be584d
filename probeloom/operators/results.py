"""The store of result rows: de-duplication, resuming, validation, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probeloom.functions.keys import canonical_cell, kind_of

#: Columns that tell one run from another.
RUN_KEYS = ("dataset", "method", "model", "name", "normalization", "image_size", "interpolation", "partition", "bands", "num_classes", "res", "pool", "config_hash")


def _canonical(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Canonical key cells; a key column that the table lacks reads as empty."""
    return [canonical_cell(c) if c in df.columns else F.lit("") for c in keys]


def dedup(rows: DataFrame, keys: Sequence[str] = RUN_KEYS, seq: str = "append_seq") -> DataFrame:
    """One row for each measurement: a row with a config hash beats one without, then the last appended.

    The key leaves the hash out and takes metric name and seed in. One shuffle on the canonical key, made once. Tables
    without the key columns pass unchanged.
    """
    named = [k for k in (*keys, "metric_name", "seed") if k != "config_hash"]
    if not {"metric_name", *[k for k in named if k in keys][:1]} <= set(rows.columns):
        return rows
    hashed = F.coalesce(F.trim("config_hash"), F.lit("")) != "" if "config_hash" in rows.columns else F.lit(False)
    # rows that cannot be first leave before the shuffle; the digest ahead of the key makes the sort one of numbers
    order = Window.partitionBy("_digest", "_key").orderBy(hashed.desc(), F.col(seq).desc())
    keyed = _keyed(rows, named).withColumn("_digest", F.xxhash64("_key"))
    return keyed.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "_key", "_digest")


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("_key", F.concat_ws("\x1f", *_canonical(df, keys)))


def pending_runs(planned: DataFrame, stored: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Planned runs that the store does not hold."""
    return _keyed(planned, keys).join(_keyed(stored, keys).select("_key"), "_key", "left_anti").drop("_key")


def pending_metrics(planned: DataFrame, stored: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Planned rows (run and metric_name) whose metric the store does not hold for that run."""
    return pending_runs(planned, stored, [*keys, "metric_name"])


def completed_runs(required: DataFrame, stored: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Per run: required and present metrics, and whether every required one is there."""
    have = _keyed(stored, [*keys, "metric_name"]).select("_key").distinct().withColumn("_have", F.lit(1))
    rows = _keyed(required, [*keys, "metric_name"]).join(have, "_key", "left")
    grouped = rows.groupBy(*[c for c in keys if c in required.columns]).agg(F.count("*").alias("required"), F.count("_have").alias("present"))
    return grouped.withColumn("complete", F.col("required") == F.col("present"))


def required_metrics(configs: DataFrame, splits: Sequence[str], estimators: Sequence[str], prefix: str = "id") -> DataFrame:
    """configs crossed with the metric names that a full pass must give (two small fixed lists)."""
    names = [f"{prefix}_{e}_{s}" for s in splits for e in estimators]
    return configs.withColumn("metric_name", F.explode(F.array(*map(F.lit, names))))


def invalid_rows(rows: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Failures per expected key: not exactly one row, or score and interval not finite within [0, 1] and in order."""
    good = lambda c: F.coalesce(~F.isnan(c) & F.col(c).between(0, 1), F.lit(False))
    fine = good("metric_value") & good("ci_lower") & good("ci_upper") & (F.col("ci_lower") <= F.col("metric_value")) & (F.col("metric_value") <= F.col("ci_upper"))
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~fine).alias("bad"))
    out = expected.select(*keys).distinct().join(found, list(keys), "left").na.fill(0, ["n", "bad"])
    return out.where("n <> 1 OR bad > 0")


def key_changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys added or removed between two tables."""
    a, b = (_keyed(t, keys).select("_key", *keys).dropDuplicates(["_key"]) for t in (old, new))
    added = b.join(a, "_key", "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(a.join(b, "_key", "left_anti").withColumn("change", F.lit("removed"))).drop("_key")


def matched_cases(rows: DataFrame, cases: DataFrame, keys: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """De-duplicated rows of the expected cases (all keys equal after canonicalisation), of cases that have every method."""
    found = dedup(rows, keys)
    joined = _keyed(found, keys).join(_keyed(cases, keys).select("_key").distinct(), "_key", "left_semi")
    full = joined.groupBy("_key").agg(F.collect_set("method").alias("m")).where(F.size(F.array_intersect("m", F.array(*map(F.lit, methods)))) == len(methods))
    return joined.join(full.select("_key"), "_key", "left_semi").drop("_key")


def split_kinds(rows: DataFrame) -> DataFrame:
    """Rows with the side table that each goes to."""
    return rows.withColumn("kind", kind_of(F.col("method")))


def kind_counts(rows: DataFrame) -> DataFrame:
    """Rows per side table; their sum is the input's, as a check on a split."""
    return split_kinds(rows).groupBy("kind").agg(F.count("*").alias("n"))


def headline(rows: DataFrame) -> DataFrame:
    """Per method: rows, distinct models and datasets, and the best score with its model."""
    best = F.max(F.struct("metric_value", "name", "dataset"))
    return rows.groupBy("method").agg(F.count("*").alias("n_rows"), F.countDistinct("name").alias("n_models"), F.countDistinct("dataset").alias("n_datasets"), best["metric_value"].alias("best"), best["name"].alias("best_name"))


def long_costs(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str], alias: dict[str, str] | None = None) -> DataFrame:
    """A wide cost table as rows of method ``profile``, blanks skipped and band names unified."""
    rows = wide.unpivot(list(ids), list(metrics), "metric_name", "metric_value").where("metric_value IS NOT NULL").withColumn("method", F.lit("profile"))
    for old, new in (alias or {}).items():
        rows = rows.withColumn("band_config", F.when(F.col("band_config") == old, new).otherwise(F.col("band_config")))
    return rows


def job_summary(jobs: DataFrame) -> DataFrame:
    """Passed and failed jobs, their mean time, the fastest and the slowest (ties: the smaller id)."""
    return jobs.agg(
        F.count_if(F.col("ok")).alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.avg("seconds").alias("mean_seconds"),
        F.min(F.struct("seconds", "job_id"))["job_id"].alias("fastest"), F.min(F.struct(-F.col("seconds"), "job_id"))["job_id"].alias("slowest"),
    )


def last_completed(events: DataFrame) -> DataFrame:
    """job_id and log of each job's last completed event."""
    return events.where("event = 'completed'").groupBy("job_id").agg(F.max_by("log", "seq").alias("log"))


def job_logs(jobs: DataFrame, events: DataFrame, attempts: DataFrame, marker: str) -> DataFrame:
    """job_id, log: that of the job's last completed event, else the only one of its attempts (job_id, log, text) whose text has the marker; null if none or several have."""
    done = attempts.where(F.col("text").contains(marker)).groupBy("job_id").agg(F.count("*").alias("n"), F.min("log").alias("only"))
    found = jobs.select("job_id").join(last_completed(events), "job_id", "left").join(done, "job_id", "left")
    return found.select("job_id", F.coalesce("log", F.when(F.col("n") == 1, F.col("only"))).alias("log"))


def explorer_rows(rows: DataFrame, methods: Sequence[str], snapshot: str, doubles: Sequence[str] = ("metric_value",), ints: Sequence[str] = ("seed",)) -> DataFrame:
    """Rows of the allowed methods with a score, numeric columns cast (null where the text is no number), stamped with a snapshot."""
    out = rows.where(F.col("method").isin(*methods))
    for kind, columns in (("double", doubles), ("int", ints)):
        for c in columns:
            out = out.withColumn(c, F.col(c).try_cast(kind))
    first = doubles[0]
    return out.where(F.col(first).isNotNull() & ~F.isnan(first)).withColumn("snapshot", F.lit(snapshot))
