"""Running sums and places along an order, in ranges of the order, so that no task holds all rows or a whole group.

Rows are dealt once over ranges of (group, order). Each range sums up its own rows; the sums of a group's earlier
ranges, a row for each range and group, are added to them. A group that holds a third of all rows lies in many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probeloom.sources.place import written


def same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    """Do these columns agree in both tables, nulls included?"""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


#: A column to sort by; a pair with True sorts downwards.
Key = Column | str | tuple[Column | str, bool]


def running(rows: DataFrame, by: Sequence[str], order: Sequence[Key], parts: int | None = None, **sums: Column) -> DataFrame:
    """rows with running sums (own row included) of columns within each group of ``by`` along ``order``.

    Rows of a group with an equal order come in any order, so it should tell them apart. The ranged table is written: ranges
    come from a sample, which another run of the same plan may draw anew.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = [c if isinstance(c, tuple) else (c, False) for c in order]
    keys = {f"_o{k}": F.col(c) if isinstance(c, str) else c for k, (c, _) in enumerate(pairs)}
    named = rows.withColumns(keys | {f"_v_{n}": c for n, c in sums.items()})
    along = [F.desc(n) if down else F.asc(n) for n, (_, down) in zip(keys, pairs, strict=True)]
    ranged = written(named.repartitionByRange(parts, *by, *along).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*by, "_part").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # rows for each range that holds the group
    ahead = totals.select(*by, "_part", *(F.sum(f"_t_{n}").over(earlier).alias(f"_a_{n}") for n in sums))
    inside = Window.partitionBy("_part", *by).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select(*rows.columns, "_part", *(F.sum(f"_v_{n}").over(inside).alias(f"_s_{n}") for n in sums))
    met = local.join(ahead, same(local, ahead, ["_part", *by]))
    return met.select(*(local[c] for c in rows.columns), *((F.col(f"_s_{n}") + F.coalesce(f"_a_{n}", F.lit(0))).alias(n) for n in sums))


def placed(rows: DataFrame, by: Sequence[str], order: Sequence[Key], out: str = "place", parts: int | None = None) -> DataFrame:
    """rows with their place (from 1, a long) in their group along a whole order."""
    return running(rows, by, order, parts, **{out: F.lit(1).cast("long")})
