"""Connected components over an edge table, and streaming of sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.llm.scratch import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the edges (a long, b long).

    Each round points every node to its smallest neighbour, follows the pointer once more and contracts the
    edges to what is left between different pointers, so the edges shrink geometrically. Minima are taken
    map-side before a shuffle, and rounds are written to the shared folder. Null ends are left out; a node
    with self edges alone is its own component; no edges give no rows.
    """
    sound = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = cut(sound.distinct(), "links")
    labels = cut(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("component")), "labels")
    edges = edges.where("a < b")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")), "pointers")
        up = to.select(F.col("v").alias("p"), F.col("p").alias("q"))
        to = cut(to.join(up, "p").select("v", F.col("q").alias("p")), "pointers")
        labels = cut(labels.join(to, labels["component"] == to["v"], "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        one = edges.join(to.select(F.col("v").alias("a"), F.col("p").alias("x")), "a")
        two = one.join(to.select(F.col("v").alias("b"), F.col("p").alias("y")), "b").where("x <> y")
        edges = cut(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return labels


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``keys`` columns, of a stream sorted by them."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in range(keys))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for k in range(keys):
            values = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        change[0] = bool(held) and key(held[-1], held[-1].num_rows - 1) != key(batch, 0)
        starts = np.flatnonzero(change)
        at = 0
        for s in starts:
            if s > at:
                held.append(batch.slice(at, s - at))
            if held:
                yield pa.Table.from_batches(held)
                held = []
            at = s
        held.append(batch.slice(at, n - at))
    if held:
        yield pa.Table.from_batches(held)


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row of its component."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] >= 0:
            continue
        front, root[i] = np.array([i]), i
        while len(front):
            near = linked[front].any(axis=0) & (root < 0)
            front = np.flatnonzero(near)
            root[front] = i
    return root
