"""Keys that hold a large part of all rows, found in a sample; they only decide over how many tasks rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeloom.llm.scratch import cut

#: Share of the sampled rows from which a key is dealt over ``SALTS`` tasks; so there are 1 / SHARE such keys at most.
SHARE, SALTS = 0.005, 64
#: Documents in the sample (about), whatever the corpus.
SAMPLE = 5000


def sampled(docs: DataFrame, key: str = "text") -> DataFrame:
    """About ``SAMPLE`` rows of docs by a hash of all columns but ``key``; written, so that it costs one read of docs."""
    every = max(1, docs.count() // SAMPLE)
    return cut(docs.where(F.pmod(F.xxhash64(F.lit("sample"), *(c for c in docs.columns if c != key)), F.lit(every)) == 0), "sampled")


def hot_keys(rows: DataFrame, *keys: str) -> list[tuple]:
    """The values of ``keys`` that hold ``SHARE`` of these (sampled) rows, and two of them at least."""
    counts = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")), "sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [tuple(r[k] for k in keys) for r in counts.where(F.col("n") >= max(2, SHARE * total)).collect()]


def among(found: list[tuple], *keys: str) -> Column:
    """Is the row's key one of these?"""
    if not found:
        return F.lit(False)
    first = F.col(keys[0]).isin([x[0] for x in found])
    if len(keys) == 1:
        return first
    text = F.concat_ws(":", *(F.col(k).cast("string") for k in keys))
    return F.when(first, text.isin([":".join(map(str, x)) for x in found])).otherwise(False)
