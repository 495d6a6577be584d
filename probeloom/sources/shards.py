"""Tar shards of samples: reading members, indexing them, planning new shards and checking a copy."""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.operators.ranges import placed

BANDS, META = ".bands.npz", ".meta.json"


def _members(content: bytes) -> Iterator[tuple[tarfile.TarInfo, bytes]]:
    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
        for m in tar:
            if m.isfile():
                yield m, tar.extractfile(m).read()


def _sample(name: str) -> tuple[str, str]:
    """Sample id (it may hold dots) and part of a member."""
    for part in (BANDS, META):
        if name.endswith(part):
            return name[: -len(part)], part[1:]
    return name, ""


def read_samples(spark: SparkSession, root: str) -> DataFrame:
    """sample_id, height, width, names, bands, meta of every sample of the shards; a task holds the shards of one Arrow batch, and one sample's arrays at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for df in batches:
            for content in df["content"]:
                held: dict[str, dict] = {}
                for m, data in _members(content):
                    sample, part = _sample(m.name)
                    if part:
                        held.setdefault(sample, {})[part] = data
                    if len(held.get(sample, ())) == 2:
                        parts = held.pop(sample)
                        with np.load(io.BytesIO(parts["bands.npz"]), allow_pickle=False) as z:
                            names = list(z.files)
                            bands = [z[n].astype(float) for n in names]
                        yield pd.DataFrame({"sample_id": [sample], "height": bands[0].shape[0], "width": bands[0].shape[1], "names": [names], "bands": [[b.ravel().tolist() for b in bands]], "meta": [json.dumps(json.loads(parts["meta.json"]), sort_keys=True)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(root).select("content")
    return files.mapInPandas(run, "sample_id string, height int, width int, names array<string>, bands array<array<double>>, meta string")


def find_band(names: str, wanted: str):
    """Place (from 0) of a band by its exact name, else of the first that begins with it; null if none."""
    exact = F.array_position(names, wanted)
    prefix = F.array_position(F.transform(names, lambda n: n.startswith(wanted)), True)
    return F.nullif(F.when(exact > 0, exact).otherwise(prefix), F.lit(0)) - 1


def index_members(spark: SparkSession, root: str) -> DataFrame:
    """sample_id with shard, offset and size of its two members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for path, content in zip(df["path"], df["content"], strict=True):
                rows = [(*_sample(m.name), path.rsplit("/", 1)[-1], m.offset_data, m.size) for m, _ in _members(content)]
                yield pd.DataFrame(rows, columns=["sample_id", "part", "shard", "offset", "size"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(root).select("path", "content")
    rows = files.mapInPandas(run, "sample_id string, part string, shard string, offset long, size long").where("part <> ''")
    pick = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c)))
    return rows.groupBy("sample_id").agg(F.min("shard").alias("shard"), *(pick(p, c).alias(f"{n}_{c}") for n, p in (("bands", "bands.npz"), ("meta", "meta.json")) for c in ("offset", "size")))


def plan_shards(samples: DataFrame, size: int = 1000) -> DataFrame:
    """row_id, shard: samples in the order of their ids in shards of ``size``, without one window over all."""
    return placed(samples, (), ("row_id",), "i").withColumn("shard", F.floor((F.col("i") - 1) / size).cast("int")).drop("i")


def write_shards(planned: DataFrame, root: str) -> None:
    """One folder for each shard, its samples in order."""
    planned.repartition("shard").sortWithinPartitions("shard", "row_id").write.mode("overwrite").partitionBy("shard").parquet(root)


def write_tars(samples: DataFrame, root: str) -> DataFrame:
    """shard, n of the tars written to ``root`` (a folder that tasks reach by its URI): a sample (sample_id, shard, height, width, names, bands, meta) is a .bands.npz and a .meta.json, samples in the order of their ids.

    A shard is written under a name of its own and then renamed, so a repeated task leaves one whole file.
    """

    def write(df: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder)
        name = f"{folder}/shard-{int(df['shard'].iloc[0]):06}"
        part = f"{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out, tarfile.open(fileobj=out, mode="w|") as tar:
            for r in df.sort_values("sample_id").itertuples():
                arrays = io.BytesIO()
                np.savez(arrays, **{n: np.asarray(b, np.float32).reshape(r.height, r.width) for n, b in zip(r.names, r.bands, strict=True)})
                for end, body in ((BANDS, arrays.getvalue()), (META, r.meta.encode())):
                    member = tarfile.TarInfo(f"{r.sample_id}{end}")
                    member.size = len(body)
                    tar.addfile(member, io.BytesIO(body))
        store.move(part, f"{name}.tar")
        return pd.DataFrame({"shard": [df["shard"].iloc[0]], "n": [len(df)]})

    return samples.groupBy("shard").applyInPandas(write, "shard int, n long")


def differing(source: DataFrame, copy: DataFrame, id_col: str, value: str, n: int = 50, seed: int = 0) -> DataFrame:
    """Of ``n`` samples of the source (the first by md5(id:seed)): ids that the copy lacks or whose value differs."""
    some = source.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), id_col).limit(n).select(id_col, F.col(value).alias("a"))
    there = copy.select(id_col, F.col(value).alias("b"), F.lit(True).alias("there"))
    return some.join(there, id_col, "left").where(F.col("there").isNull() | ~F.col("a").eqNullSafe(F.col("b"))).select(id_col, F.col("there").isNull().alias("missing"))
