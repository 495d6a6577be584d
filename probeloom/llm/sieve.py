"""Leave out rows without a partner before a join shuffles their texts: a Bloom filter of fixed size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter (2 MB), whatever the number of keys; a full filter passes every row.
BITS = 1 << 24


def _places(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(salt), key), F.lit(BITS)) for salt in (1, 2)]


def sieve(rows: DataFrame, on: str, wanted: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose ``on`` is no ``key`` of wanted; it never loses one that is.

    The filter is made of 64-bit words or-ed map-side, of which BITS / 64 at most reach the driver.
    """
    place = F.explode(F.array(*_places(F.col(key))))
    words = wanted.select(place.alias("p")).select(F.shiftright("p", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("m"))
    table = words.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    filled = np.zeros(BITS // 64, np.int64)
    filled[table["w"]] = table["m"]
    shared = rows.sparkSession.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series) -> pd.Series:
        bit = lambda x: shared.value[x.to_numpy() >> 6] >> (x.to_numpy() & 63) & 1
        return pd.Series((bit(a) & bit(b)).astype(bool))

    return rows.where(passes(*_places(F.col(on))))
