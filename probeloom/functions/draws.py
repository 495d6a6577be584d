"""Random draws from hashes: the same in every run, on every cluster and in any SQL engine with md5."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digits(text: Column, place: Column | int, n: int) -> Column:
    """The number that n hex digits of the md5 of a text make, from digit ``place`` (the first is 1)."""
    return F.conv(F.substring(F.md5(text), place, n), 16, 10).cast("long")


def poisson_thresholds(most: int = 8) -> list[float]:
    """Cumulative probabilities of 0, 1, ... under a Poisson law of mean 1."""
    out, term = [], math.exp(-1)
    for k in range(1, most + 1):
        out.append(sum(out[-1:]) + term)
        term /= k
    return out


def poisson_weights(rows: DataFrame, unit: str, replicates: int, seed: int = 0) -> DataFrame:
    """rows for each replicate r (from 1) in which the unit has a weight w above zero, by a Poisson law of mean 1.

    One md5 of ``seed:unit:block`` serves eight replicates, four hex digits each.
    """
    block = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 8)))
    hashed = rows.withColumn("_b", block).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(unit).cast("string"), F.col("_b").cast("string"))))
    number = lambda at, n: F.conv(F.substring("_h", at, n), 16, 10).cast("long")
    wide = hashed.select(*rows.columns, "_b", number(1, 12).alias("_x"), number(13, 12).alias("_y"), number(25, 8).alias("_z"))
    parts = [F.shiftright(c, s).bitwiseAND(65535) for c, shifts in (("_x", (32, 16, 0)), ("_y", (32, 16, 0)), ("_z", (16, 0))) for s in shifts]
    drawn = wide.select(*rows.columns, "_b", F.posexplode(F.array(*parts)).alias("_i", "_v"))
    u, limits = (F.col("_v") + 0.5) / 65536, poisson_thresholds()
    weight = F.lit(len(limits))
    for k in range(len(limits) - 1, -1, -1):  # the smallest weights are tried first
        weight = F.when(u < limits[k], k).otherwise(weight)
    return drawn.select(*rows.columns, (F.col("_b") * 8 + F.col("_i") + 1).alias("r"), weight.alias("w")).where((F.col("w") > 0) & (F.col("r") <= replicates))


def index_draws(sizes: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """n, r, i: for every n of ``sizes`` and each replicate r (from 1), n draws of a place from 0 to n - 1."""
    rows = sizes.select("n").distinct().withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("j").cast("string"))
    return rows.select("n", "r", F.pmod(digits(text, 1, 8), F.col("n")).alias("i"))
