"""Operator 5: mix sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is a stream of its documents in a seeded order, followed by the same stream once more; its
quota of words is a prefix of that stream, cut into blocks. A binary tree over the output shards halves
the blocks that are left: at every node a multivariate hypergeometric draw says how many blocks of each
source go left. So every shard gets an exact number of blocks of every source, the blocks of a shard are
disjoint runs of the permuted stream, and each shard is shuffled by itself.

Positions in the streams come from sums over hash buckets and then within a bucket, so no task and no
window holds a whole source: buckets and the documents of a bucket grow with the root of a source. Blocks
and shards follow from the words of the mix. Only one row for each source reaches the driver (``MAX_SOURCES``).

Defined results: null text has size 0 and takes 0 words; a null source is a source, ordered last; targets
stop at twice the source's size; repeated rows are separate documents of equal size; the same rows, seed
and parameters give the same mix in every run; texts of any length are counted whole, and a document at which
a quota ends is cut there, or with ``whole`` taken wholly or not at all; documents of equal hash are ordered by
size; an empty table gives an empty mix; extra columns are ignored by ``plan`` and kept by ``materialise``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from probeloom.llm.scratch import cut
from probeloom.llm.slabs import slabs, tidied

WEIGHTS = (3, 1, 2)
#: Words of a block at least; larger mixes have larger blocks, so there are ``MAX_BLOCKS`` at most (about).
BLOCK_WORDS, MAX_BLOCKS = 16_384, 500_000_000
#: Words of a shard (about), and shards at least and at most.
SHARD_WORDS, SHARDS, MAX_SHARDS = 32_000_000, 64, 1 << 20
#: Entries of the table of blocks by source and shard at most (8 bytes each, shipped to the tasks).
MAX_ENTRIES = 20_000_000
#: Documents that a hash bucket of a source holds about, at least.
BUCKET_ROWS = 4096
#: Sources at most; their sizes and quotas are handled on the driver.
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights: list[float], share: float, cap: float = 2.0) -> list[float]:
    """Words of each source: ``share`` of all words by weight, at most ``cap`` times its size, the excess reshared."""
    out, left, active = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while active:
        total = sum(weights[i] for i in active)
        over = {i for i in active if left * weights[i] / total > cap * sizes[i]}
        if not over:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        active -= over
    return out


def split_blocks(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) in each shard (rows); column sums are ``blocks``, row sums even to one."""
    out = np.zeros((shards, len(blocks)), np.int64)
    todo = [(0, shards, np.array(blocks, np.int64))]
    while todo:
        low, high, count = todo.pop()
        if high - low == 1 or not count.sum():
            out[low] = count
            continue
        mid = (low + high) // 2
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(count, int(count.sum()) * (mid - low) // (high - low), method="marginals")
        todo += [(low, mid, left), (mid, high, count - left)]
    return out


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shard_count(words: int, sources: int) -> int:
    """Shards for a mix of so many words, as many as the table of blocks by source and shard has room for."""
    return max(SHARDS, min(-(-words // SHARD_WORDS), MAX_SHARDS, MAX_ENTRIES // max(1, sources)))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, seed: int = 17, block_words: int = BLOCK_WORDS, shards: int | None = None, carry: bool = False, whole: bool = False) -> DataFrame:
    """One row for each document: its id, ``size``, ``source_size``, ``target``, ``taken`` and ``draws``.

    ``draws`` has, for each time that the mix takes the document (none, once or twice), the shard, the order
    in it and the words taken, all from the beginning unless the quota ends within the document. With ``whole``
    such a document is taken whole if at least half of it lies within the quota, else not at all.
    ``carry`` keeps the whole input row in a struct ``row``, for ``materialise``.
    """
    spark = docs.sparkSession
    keep = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select(F.col("doc_id"), F.col("source"), word_count("text").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), *keep)
    if not carry:
        rows = cut(rows, "sizes")  # a few numbers for each document, so texts are counted once
    sums = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("k")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    sums = sorted(sums, key=lambda r: (r.source is None, r.source or ""))
    wanted = targets([r.n for r in sums], [weights[i % len(weights)] for i in range(len(sums))], share)
    quota = [min(round(t), 2 * r.n) for t, r in zip(wanted, sums, strict=True)]
    shards = shards or shard_count(sum(quota), len(sums))
    block_words = max(block_words, -(-sum(quota) // MAX_BLOCKS))
    ends = np.cumsum(split_blocks([-(-q // block_words) for q in quota], shards, seed), axis=0).T.copy() if sums else np.zeros((0, shards), np.int64)
    about = spark.createDataFrame(
        [(r.source, i, r.n, t, q, max(1, r.k // max(BUCKET_ROWS, isqrt(r.k)))) for i, (r, t, q) in enumerate(zip(sums, wanted, quota, strict=True))],
        "source string, sid int, source_size long, target double, quota long, buckets long",
    )
    rows = rows.join(F.broadcast(about), rows["source"].eqNullSafe(about["source"])).drop("source")  # MAX_SOURCES rows at most
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.col("buckets")))
    sizes = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = sizes.select("sid", "bucket", (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("sid", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inner) - F.col("size")).join(before, ["sid", "bucket"])
    at = F.col("before") + F.col("inside")
    rows = rows.withColumn("at", at)
    for e in (0, 1):
        within = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("at") - e * F.col("source_size")))
        rows = rows.withColumn(f"t{e}", (F.when(2 * within >= F.col("size"), F.col("size")).otherwise(0) if whole else within).cast("long"))

    @F.pandas_udf("int")
    def shard(sid, block):  # noqa: ANN001, ANN202
        out = np.zeros(len(sid), np.int32)
        for i in np.unique(sid):
            here = (sid == i).to_numpy()
            out[here] = np.searchsorted(ends[i], block[here].to_numpy(), "right")
        import pandas as pd

        return pd.Series(out)

    def draw(e: int) -> Column:
        block = F.floor((F.col("at") + e * F.col("source_size")) / block_words).cast("long")
        return F.struct(shard("sid", block).alias("shard"), F.xxhash64(F.lit(seed + e), "sid", "h").alias("turn"), F.col(f"t{e}").alias("words"))

    draws = F.filter(F.array(draw(0), draw(1)), lambda d: d["words"] > 0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("t0") + F.col("t1")).alias("taken"), draws.alias("draws", metadata={"shards": shards}), *(["row"] if carry else []))


def _cut(text: str | None, words: int) -> str:
    """The text up to the end of its words-th word."""
    slab = next(slabs(pa.array([text or ""])), None)
    _, ends, _ = slab.words()
    return slab.data[: ends[words - 1]].tobytes().decode() if words <= len(ends) else text


def materialise(planned: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: a row of the input's columns for each draw, shard after shard, each shard in its drawn order.

    A document of which not all words are taken is cut after the last one taken. A shard lies in one partition.
    """
    schema = planned.schema["row"].dataType
    names, at = schema.names, schema.names.index(text)
    inner = [f"c{i}" for i in range(len(names))]  # no name of the input can meet those of the draw
    drawn = planned.select("row", "size", F.explode("draws").alias("d"))
    cut_at = F.when(F.col("d.words") < F.col("size"), F.col("d.words"))
    drawn = drawn.select(*(F.col("row").getField(n).alias(c) for n, c in zip(names, inner, strict=True)), F.col("d.shard").alias("shard"), F.col("d.turn").alias("turn"), cut_at.alias("cut"))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(len(names) + 2).to_pylist()
            column = batch.column(at)
            if any(c is not None for c in cuts):
                column = pa.array([t if c is None else _cut(t, c) for t, c in zip(column.to_pylist(), cuts, strict=True)], column.type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], column, *batch.columns[at + 1 : len(names)]], names=inner)

    parts = planned.schema["draws"].metadata["shards"]
    dealt = drawn.repartitionById(parts, "shard").sortWithinPartitions("shard", "turn")  # a partition for each shard
    mixed = dealt.mapInArrow(run, T.StructType([T.StructField(c, f.dataType) for c, f in zip(inner, schema.fields, strict=True)])).toDF(*names)
    return mixed.withColumn("n_chars", F.length(text).cast(schema["n_chars"].dataType)) if "n_chars" in names else mixed
