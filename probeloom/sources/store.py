"""Result stores, snapshots and records as files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeloom.functions.keys import kind_of, safe_name


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _headers(spark: SparkSession, root: str, names: Sequence[str] | None) -> dict[str, list[str]]:
    """Header line -> paths of the CSV files of a folder that are not empty; of each file the first line alone is read."""
    jvm = spark.sparkContext._jvm
    fs, place = _fs(spark, root)
    out: dict[str, list[str]] = {}
    for status in fs.listStatus(place):
        path = status.getPath()
        if status.isFile() and status.getLen() and path.getName().endswith(".csv") and (names is None or path.getName()[:-4] in names):
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(path), "UTF-8"))
            out.setdefault(reader.readLine(), []).append(path.toString())
            reader.close()
    return out


def load_results(spark: SparkSession, root: str, names: Sequence[str] | None = None) -> DataFrame:
    """Every CSV file of a folder (or the files of some safe names) as one table of text columns; files' schemas are united.

    Files that share a header are read together, so the number of reads is that of the different headers.
    Empty files add nothing.
    """
    out = None
    for _, paths in sorted(_headers(spark, root, names).items()):
        part = spark.read.option("header", True).csv(sorted(paths)).withColumn("source_file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "source_file string")


def _newest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content (schema, parts) of the last manifest of a versioned table; 0 and nothing if there is none."""
    fs, place = _fs(spark, f"{path}/_manifests")
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return 0, {"schema": None, "parts": []}
    stream = fs.open(_fs(spark, f"{path}/_manifests/{max(numbers):010}.json")[1])
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return max(numbers), json.loads(text)


def _publish(spark: SparkSession, path: str, number: int, manifest: dict) -> bool:
    """Put a manifest in its place by one rename, which fails if there is one already."""
    jvm = spark.sparkContext._jvm
    fs, staged = _fs(spark, f"{path}/_manifests/.{uuid.uuid4().hex}")
    out = fs.create(staged)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        context.rename(staged, _fs(spark, f"{path}/_manifests/{number:010}.json")[1], spark.sparkContext._gateway.new_array(kind, 0))
    except Py4JJavaError as error:
        fs.delete(staged, False)
        if "FileAlreadyExists" in str(error.java_exception):
            return False
        raise
    return True


def append_version(rows: DataFrame, path: str) -> int:
    """Append to a versioned table and return its version; new columns are united with the old ones (the new rows' order first).

    Rows are written into a folder of their own, and then a manifest that lists the folders and the schema is put in place by
    one rename. A reader sees the table before or after it; a writer that fails leaves it as it was, and of two writers at
    once the later lists the earlier one's rows too. Nothing is copied: older folders lack the new columns, which read as
    null. A column keeps its first type. No rows: nothing happens.
    """
    spark = rows.sparkSession
    if rows.isEmpty():
        return _newest(spark, path)[0]
    part = uuid.uuid4().hex
    known = _newest(spark, path)[1]["schema"]
    types = {f.name: f.dataType for f in T.StructType.fromJson(known)} if known else {}
    rows.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in rows.columns)).write.parquet(f"{path}/{part}")
    written = spark.read.parquet(f"{path}/{part}").schema
    while True:
        number, now = _newest(spark, path)
        old = T.StructType.fromJson(now["schema"]) if now["schema"] else T.StructType()
        clash = [f.name for f in written if f.name in old.names and old[f.name].dataType != f.dataType]
        if clash:
            raise ValueError(f"{path} got other types meanwhile: {', '.join(clash)}")
        schema = T.StructType([*written, *(f for f in old if f.name not in written.names)])
        if _publish(spark, path, number + 1, {"schema": json.loads(schema.json()), "parts": [*now["parts"], part]}):
            return number + 1


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a versioned table as they are now; a table without a version is an error."""
    number, found = _newest(spark, path)
    if not number:
        raise FileNotFoundError(path)
    return spark.read.schema(T.StructType.fromJson(found["schema"])).parquet(*(f"{path}/{p}" for p in found["parts"]))


def write_texts(rows: DataFrame, root: str) -> DataFrame:
    """name of the files written to ``root`` (a folder that tasks reach by its URI), one with the text of each row (name, text).

    A file is written under a name of its own and then renamed, so a repeated task leaves one whole file.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder)
        for df in batches:
            for name, text in zip(df["name"], df["text"], strict=True):
                part = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(text.encode())
                store.move(part, f"{folder}/{name}")
            yield df[["name"]]

    return rows.select("name", "text").mapInPandas(write, "name string")


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """log (name without its ending), text of the files of a folder that end in ``.log``."""
    text = spark.read.option("wholetext", True).text(root, pathGlobFilter="*.log")
    return text.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.log$", 1).alias("log"), F.col("value").alias("text"))


def append_rows(rows: DataFrame, path: str) -> None:
    """Append to a plain Parquet folder, for one writer and no readers at the time (else ``append_version``); new columns are united with the old ones (the new rows' order first), in a staged copy that replaces the table.

    No rows: nothing happens. A failed write leaves the table as it was.
    """
    spark = rows.sparkSession
    if rows.isEmpty():
        return
    fs, place = _fs(spark, path)
    if not fs.exists(place):
        rows.write.parquet(path)
        return
    old = spark.read.parquet(path)
    if set(old.columns) == set(rows.columns):
        rows.select(*old.columns).write.mode("append").parquet(path)
        return
    order = [*rows.columns, *(c for c in old.columns if c not in rows.columns)]
    stage, gone = f"{path}.staged", f"{path}.replaced"
    old.unionByName(rows, allowMissingColumns=True).select(*order).write.mode("overwrite").parquet(stage)
    _, staged = _fs(spark, stage)
    _, replaced = _fs(spark, gone)
    fs.rename(place, replaced)
    if not fs.rename(staged, place):
        fs.rename(replaced, place)
        raise OSError(f"{stage} could not take the place of {path}")
    fs.delete(replaced, True)


def route_rows(rows: DataFrame, root: str) -> None:
    """Rows to one folder for each kind and safe model name; a name without a safe character is an error."""
    named = rows.withColumn("kind", kind_of(F.col("method"))).withColumn("name_safe", safe_name(F.col("name")))
    if not named.where("name_safe = ''").isEmpty():
        raise ValueError("names without a safe character")
    named.write.mode("append").partitionBy("kind", "name_safe").parquet(root)


def write_snapshot(rows: DataFrame, root: str, label: str) -> None:
    rows.withColumn("snapshot", F.lit(label)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").json(root)


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """All snapshots; the folder's label stands, whatever the rows say."""
    return spark.read.option("basePath", root).json(f"{root}/snapshot=*")


def snapshot_order(labels: DataFrame) -> DataFrame:
    """snapshot, place: labels with a date first, the latest ahead; the others by name."""
    day = F.regexp_extract("snapshot", r"(\d{4}-\d{2}-\d{2})", 1)
    order = labels.select("snapshot").distinct().withColumn("day", day).orderBy(F.col("day") == "", F.col("day").desc(), "snapshot")
    from pyspark.sql.window import Window

    return order.select("snapshot", F.row_number().over(Window.orderBy(F.col("day") == "", F.col("day").desc(), "snapshot")).alias("place"))  # a row for each snapshot


def write_record(spark: SparkSession, root: str, name: str, record: dict) -> None:
    """One JSON text with sorted keys for each dataset."""
    text = json.dumps({"name": name} | record, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{name}")


def write_records(records: DataFrame, root: str) -> None:
    """One canonical JSON text (keys sorted) for each row, in a folder of its name."""
    text = F.to_json(F.struct(*sorted(records.columns)))
    records.select(F.col("name").alias("record"), text.alias("value")).repartition("record").write.mode("overwrite").partitionBy("record").text(root)


def read_records(spark: SparkSession, root: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(root)


def missing_records(registry: DataFrame, records: DataFrame) -> DataFrame:
    """Registered datasets that no record names."""
    return registry.join(records.select("name"), "name", "left_anti")


PROBABILITY_KEYS = ("dataset", "model", "split")


def write_probabilities(rows: DataFrame, root: str) -> None:
    """Tables of sample_id, label and probs (as floats), one folder for each dataset, model and split."""
    rows.select(*PROBABILITY_KEYS, "sample_id", "label", F.col("probs").cast("array<float>").alias("probs")).write.mode("overwrite").partitionBy(*PROBABILITY_KEYS).parquet(root)


def read_probabilities(spark: SparkSession, root: str, **wanted: str) -> DataFrame:
    """The tables back, those of the wanted dataset, model or split alone (by their folders)."""
    rows = spark.read.schema("sample_id long, label int, probs array<float>, dataset string, model string, split string").parquet(root)
    for key, value in wanted.items():
        rows = rows.where(F.col(key) == value)
    return rows


def read_partitions(spark: SparkSession, root: str) -> DataFrame:
    """part, split, sample_id of partition files, each one JSON object of split -> ids."""
    text = spark.read.option("wholetext", True).text(root, pathGlobFilter="*_partition.json").withColumn("part", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_partition\.json$", 1))
    split = text.select("part", F.explode(F.from_json("value", "map<string,array<string>>")).alias("split", "ids"))
    return split.select("part", "split", F.explode("ids").alias("sample_id"))


def select_split(samples: DataFrame, parts: DataFrame, split: str, part: str = "default") -> DataFrame:
    """Samples of a split; only the training split of a sub-sampled partition differs from the default."""
    use = part if split == "train" else "default"
    return samples.join(parts.where((F.col("split") == split) & (F.col("part") == use)).select("sample_id"), "sample_id", "left_semi")


def mismatched_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, expected, actual of manifest entries that are missing or whose SHA-256 differs; files has name and content."""
    found = files.select("name", F.sha2("content", 256).alias("actual"))
    return manifest.join(found, "name", "left").where(~F.col("expected").eqNullSafe(F.col("actual")))


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """seq, timestamp, event, job_id, details (free) of a job log of JSON lines."""
    return spark.read.schema("timestamp string, event string, job_id string, details map<string,string>").json(root)


def epoch_metrics(logs: DataFrame, name: str) -> DataFrame:
    """log, epoch, value from texts with lines ``Epoch <n> ... <name>: <x>``."""
    epochs = F.regexp_extract_all("text", F.lit(rf"Epoch (\d+)[^\n]*\b{name}: ([-+0-9.eEnaif]+)"), 1)
    values = F.regexp_extract_all("text", F.lit(rf"Epoch (\d+)[^\n]*\b{name}: ([-+0-9.eEnaif]+)"), 2)
    rows = logs.select("log", F.explode(F.arrays_zip(epochs.alias("e"), values.alias("v"))).alias("x"))
    return rows.select("log", F.col("x.e").cast("int").alias("epoch"), F.col("x.v").try_cast("double").alias("value"))


def curve_summary(curves: DataFrame, epochs: int) -> DataFrame:
    """log, complete (epochs 1 to E, all finite), best_epoch (first of the best), best and last value."""
    fine = F.coalesce(~F.isnan("value") & (F.abs("value") < float("inf")), F.lit(False))
    whole = F.array_sort(F.collect_list("epoch")) == F.sequence(F.lit(1), F.lit(epochs))
    return curves.groupBy("log").agg((whole & F.bool_and(fine)).alias("complete"), F.min(F.struct(-F.col("value"), "epoch"))["epoch"].alias("best_epoch"), F.max("value").alias("best"), F.max_by("value", "epoch").alias("last"))


def decode_metadata(rows: DataFrame, text: str = "meta") -> DataFrame:
    """rows with bands_order, labels and error (null if fine) from metadata texts: an object with a non-empty list of band names and finite labels."""
    m = F.from_json(text, "struct<bands_order:array<string>,label:string>")
    labels = F.when(m["label"].startswith("["), F.from_json(m["label"], "array<double>")).otherwise(F.array(m["label"].try_cast("double")))
    df = rows.withColumn("bands_order", m["bands_order"]).withColumn("labels", labels)
    bad_bands = F.col("bands_order").isNull() | (F.size("bands_order") == 0) | F.exists("bands_order", lambda b: b.isNull() | (b == ""))
    bad_label = F.col("labels").isNull() | F.exists("labels", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.withColumn("error", F.when(m.isNull(), "not an object").when(bad_bands, "bands_order").when(bad_label, "label"))
