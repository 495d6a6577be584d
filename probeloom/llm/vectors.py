"""Operator 4: embedding near-duplicates by tiled comparison in the order of principal components.

Vectors with the same label and length are compared by cosine. Equal vectors form a class with one
representative. Unit vectors are rotated to their principal components (second moments summed over all
rows). Vectors that reach the threshold lie within sqrt(2 - 2 t) of each other in every component, so a
grid of that width over the first components leaves only neighbouring cells to compare. The grid spans as many
components as it takes for cells to hold about a tile (``GRIDS``); cells are cut into tiles of bounded size, and
a task compares two tiles. It adds up the products of leading components
first, bounds what the rest can add by the product of the suffix norms, and stops for rows and columns
that cannot reach the threshold; what is left is decided by the cosine of the original vectors.

A task returns one row for each linked vector (its links, and its component within the two tiles), not
pairs. Cells, tiles and their pairs are joined as tables; the driver sees the second moments alone.

Defined results: a vector that is null, empty or zero, or that holds null or non-finite components, and one
without label or id, links with nothing; vectors of different lengths never link; repeated rows are other
vectors that link with each other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeloom.llm.graph import components, forest, groups
from probeloom.llm.scratch import cut
from probeloom.llm.slabs import tidied

THRESHOLD = 0.98
#: Rows of a tile (about), components added between two looks at the bound.
TILE, STEP = 768, 16
#: Numbers of components that may span the grid: the first with which cells have two tiles at most on average, else the last.
GRIDS = (3, 4, 5, 6)
#: Longest vectors: the second moments are a square of this side.
MAX_DIMENSIONS = 4096
_SLACK = 1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, safe for any finite magnitude."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of equal or smaller length as rows of a matrix, zeros at the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def principal(vectors: DataFrame) -> np.ndarray:
    """Orthogonal directions (columns), the one with the largest second moment first, of the column ``v``."""
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    if width > MAX_DIMENSIONS:
        raise ValueError(f"vectors of over {MAX_DIMENSIONS} dimensions")
    if not width:
        return np.zeros((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                u = _unit(_matrix(batch.column(0).slice(at, 4096), width))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary())], names=["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(row.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["i", "row"])

    parts = vectors.select("v").mapInArrow(tidied(run), "i int, row binary").repartition("i").mapInArrow(add, "i int, row binary")
    moments = np.zeros((width, width))
    for r in parts.collect():  # width rows of width numbers, as bytes
        moments[r.i] = np.frombuffer(r.row)
    _, directions = np.linalg.eigh((moments + moments.T) / 2)
    return directions[:, ::-1].copy()


def close(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which rows of a reach the threshold with which rows of b."""
    ua, ub = _unit(a), _unit(b)
    ra, rb = ua @ axes, ub @ axes
    out = np.zeros((len(a), len(b)), bool)
    rows, cols = np.arange(len(a)), np.arange(len(b))
    product = np.zeros((len(a), len(b)))
    width = axes.shape[1]
    for at in range(0, width, STEP):
        product = product + ra[rows, at : at + STEP] @ rb[cols, at : at + STEP].T
        rest_a, rest_b = (np.sqrt((r[k, at + STEP :] ** 2).sum(axis=1)) for r, k in ((ra, rows), (rb, cols)))
        alive = product + rest_a[:, None] * rest_b[None, :] >= threshold - _SLACK
        keep_rows, keep_cols = alive.any(axis=1), alive.any(axis=0)
        if not keep_rows.any():
            return out
        product, rows, cols = product[np.ix_(keep_rows, keep_cols)], rows[keep_rows], cols[keep_cols]
    out[np.ix_(rows, cols)] = ua[rows] @ ub[cols].T >= threshold
    return out


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = embeddings.sparkSession
    v = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long"), "label", v.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"), F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit("k2"), "label", "embedding").alias("k2"))
    classes = rows.where("sound").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    classes = cut(classes, "classes")
    axes = principal(classes)
    shared = spark.sparkContext.broadcast(axes)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    every = [f"c{k}" for k in range(GRIDS[-1])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lead = _unit(_matrix(part.column(3), len(axes))) @ axes[:, : len(every)]
                cells = np.zeros((part.num_rows, len(every)), np.int32)
                cells[:, : lead.shape[1]] = np.floor(lead / reach)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(cells[:, k]) for k in range(len(every)))], names=[*part.schema.names, *every])

    placed = classes.select("rep", "copies", "label", "v", F.size("v").alias("dims"))
    placed = placed.mapInArrow(tidied(place), T.StructType([*placed.schema, *(T.StructField(c, T.IntegerType()) for c in every)]))
    spans = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *((F.col(c) if i < k else F.lit(None).cast("int")).alias(c) for i, c in enumerate(every))) for k in GRIDS))).alias("s")
    counts = placed.select("label", "dims", spans).groupBy("label", "dims", "s").agg(F.count("*").alias("n"))
    counts = cut(counts.select("label", "dims", "s.*", "n", F.ceil(F.col("n") / tile).cast("int").alias("subs")), "counts")
    work = {r.k: (r.meets, r.n) for r in counts.groupBy("k").agg(F.sum(F.col("n") * F.col("subs")).alias("meets"), F.sum("n").alias("n")).collect()}  # a row for each of GRIDS
    span = next((k for k in GRIDS if k in work and work[k][0] <= 2 * work[k][1]), GRIDS[-1])
    grid = every[:span]
    home = ["label", "dims", *grid]
    cells = counts.where(F.col("k") == span).select(*home, "subs")
    tiles = cut(placed.select("rep", "copies", "v", *home).join(cells, home).withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int")).drop("subs"), "tiles")
    steps = [step for step in product((-1, 0, 1), repeat=span) if step >= (0,) * span]
    moves = F.explode(F.array(*(F.struct(*(F.lit(s).alias(f"d{k}") for k, s in enumerate(step))) for step in steps))).alias("m")
    first = cells.select("*", moves).select("label", "dims", *(F.col(c).alias(f"a{k}") for k, c in enumerate(grid)), F.col("subs").alias("subs_a"), *((F.col(c) + F.col(f"m.d{k}")).alias(c) for k, c in enumerate(grid)))
    pairs = first.join(cells, home)
    same = reduce(and_, (F.col(f"a{k}") == F.col(c) for k, c in enumerate(grid)))
    pairs = pairs.withColumn("same", same).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("subs_a") - 1)))
    pairs = pairs.withColumn("j", F.explode(F.sequence(F.when(F.col("same"), F.col("i")).otherwise(0), F.col("subs") - 1))).withColumn("one", F.col("same") & (F.col("i") == F.col("j")))
    pairs = cut(pairs.withColumn("p", F.xxhash64(*(f"a{k}" for k in range(span)), "i", *grid, "j")).drop("subs", "subs_a", "same"), "pairs")
    left = pairs.select("label", "dims", *(F.col(f"a{k}").alias(c) for k, c in enumerate(grid)), F.col("i").alias("sub"), "p", F.when(F.col("one"), -1).otherwise(0).alias("side"))
    right = pairs.where("NOT one").select("label", "dims", *grid, F.col("j").alias("sub"), "p", F.lit(1).alias("side"))
    dealt = tiles.join(left.union(right), [*home, "sub"]).select("label", "dims", "p", "side", "rep", "copies", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = shared.value
        for table in groups(batches, 3):
            side, rep, copies = (table.column(c).to_numpy() for c in (3, 4, 5))
            x, split = _matrix(table.column(6), len(axes)), int(np.searchsorted(side, 1))
            if side[0] < 0:  # a tile with itself
                hit = close(x, x, axes, threshold)
                np.fill_diagonal(hit, False)
                hit |= hit.T
            elif not 0 < split < len(x):  # one of the two tiles got no rows
                continue
            else:
                hit = np.zeros((len(x), len(x)), bool)
                hit[:split, split:] = close(x[:split], x[split:], axes, threshold)
                hit |= hit.T
            links = hit.astype(np.float64) @ copies.astype(np.float64)
            some = np.flatnonzero(links)
            if len(some):
                root = np.full(len(x), -1)
                root[some] = some[forest(hit[np.ix_(some, some)])]
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(rep[root[some]])], names=["rep", "links", "root"])

    dealt = dealt.repartition("label", "dims", "p").sortWithinPartitions("label", "dims", "p", "side")
    found = cut(dealt.mapInArrow(tidied(compare), "rep long, links long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    about = classes.select("label", "k1", "k2", "rep", "copies").join(links, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    about = about.select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.where("sound").drop("v").join(about, ["label", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("NOT sound").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
c(vec, comp) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, c.comp FROM c JOIN l ON c.vec = l.a)
SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(m, vec_id) AS component_id, vec_id = coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS k FROM l GROUP BY 1) USING (vec_id) LEFT JOIN (SELECT vec AS vec_id, min(comp) AS m FROM c GROUP BY 1) USING (vec_id)"""
