"""Geography of datasets: density bins, continent shares, spatial join, thinning, raster origins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probeloom.operators.ranges import placed
from probeloom.sources.place import written

OCEAN = "Ocean / unmatched"


def density_bins(points: DataFrame, degrees: float = 0.25) -> DataFrame:
    """x, y, n of the grid cells that hold points."""
    return points.groupBy(F.floor((F.col("lon") + 180) / degrees).cast("int").alias("x"), F.floor((F.col("lat") + 90) / degrees).cast("int").alias("y")).agg(F.count("*").alias("n"))


def bounds(points: DataFrame) -> DataFrame:
    r = lambda c: F.bround(c, 3)
    return points.agg(r(F.min("lon")).alias("west"), r(F.min("lat")).alias("south"), r(F.max("lon")).alias("east"), r(F.max("lat")).alias("north"), F.count("*").alias("n"))


def continent_shares(points: DataFrame) -> DataFrame:
    """continent, n, share (%), place: by count, then name."""
    counts = points.groupBy("continent").agg(F.count("*").alias("n"))
    share = F.bround(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2)  # a row for each continent
    return counts.select("continent", "n", share.alias("share"), F.row_number().over(Window.orderBy(F.col("n").desc(), "continent")).alias("place"))


def weighted_index(records: DataFrame) -> DataFrame:
    """continent, samples and share (%) over records (n, continents as map name -> share %), weighted by samples."""
    rows = records.select("n", F.explode("continents").alias("continent", "share"))
    sums = rows.groupBy("continent").agg(F.sum(F.col("share") * F.col("n") / 100).alias("samples"))
    return sums.select("continent", F.bround("samples", 6).alias("samples"), F.bround(100 * F.col("samples") / F.sum("samples").over(Window.partitionBy()), 2).alias("share"))


def inside(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Which points lie in a closed ring (even-odd rule)."""
    out = np.zeros(len(x), bool)
    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        cross = (y1 > y) != (y2 > y)
        if y1 != y2:
            out ^= cross & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return out


#: Corners of all polygons together up to which they are shipped to the tasks (16 bytes each and their list of cells).
SHIPPED = 1_000_000


#: Points and edges of a cell that meet in a task at most (about).
MET_POINTS, MET_EDGES = 500_000, 50_000
#: Where the grid of cut polygons begins: off the round coordinates, so that no edge runs through a corner of it by design.
ORIGIN = (0.0027182818284590452, 0.0031415926535897932)


def attribute_polygons(points: DataFrame, polygons: DataFrame, degrees: float = 5.0, shipped: int = SHIPPED) -> DataFrame:
    """points (row_id, lon, lat) with the name of one polygon (name, ring as array of [lon, lat]) that holds each, of several the first by name.

    Polygons with ``shipped`` corners at most travel to the tasks, sorted into grid cells, and points are not shuffled. More
    polygons are cut into the cells of a grid, so that a point meets the edges of its cell and not whole rings.
    """
    if (polygons.agg(F.sum(F.size("ring"))).first()[0] or 0) <= shipped:
        return _attribute_shipped(points, polygons, degrees)
    return _attribute_cut(points, polygons, degrees)


def cut_ring(ring: np.ndarray, degrees: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells (cx, cy, flag) of a closed ring's bounding box, and its edges by cell (cx, cy, x1, y1, x2, y2).

    The flag says whether the cell's lower right corner lies in the ring; an edge stands in every cell that it touches. Corners
    and edges on a grid line count as lying below it or left of it; the way of a point runs just above its height and just
    right of the grid line, and nearer to its height than to the line.
    """
    (x1, y1), (ox, oy) = ring.T, ORIGIN
    x2, y2 = np.roll(ring, -1, axis=0).T
    spread = lambda first, last: (np.repeat(np.arange(len(first)), n := np.maximum(last - first + 1, 0)), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n))
    whole = lambda v: np.floor(v).astype(int)
    near = 1e-9
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    edge, cy = spread(whole((low - near - oy) / degrees), whole((high + near - oy) / degrees))
    with np.errstate(divide="ignore", invalid="ignore"):
        at = [np.where(y1[edge] == y2[edge], end[edge], x1[edge] + (x2 - x1)[edge] * ((np.clip(oy + cy * degrees + d, low[edge], high[edge]) - y1[edge]) / (y2 - y1)[edge])) for d, end in ((0.0, x1), (degrees, x2))]
    piece, cx = spread(np.ceil((np.minimum(*at) - near - ox) / degrees).astype(int) - 1, whole((np.maximum(*at) + near - ox) / degrees))
    edge, cy = edge[piece], cy[piece]
    edges = np.column_stack([cx, cy, x1[edge], y1[edge], x2[edge], y2[edge]])
    # along each line between rows of cells: where the ring crosses it, and how many crossings lie right of each corner
    crossing, line = spread(np.ceil((low - oy) / degrees).astype(int), np.ceil((high - oy) / degrees).astype(int) - 1)
    place = (x2 - x1)[crossing] * (oy + line * degrees - y1[crossing]) / (y2 - y1)[crossing] + x1[crossing]
    order = np.lexsort((place, line))
    lines, places = line[order], place[order]
    columns = np.arange(cx.min(), cx.max() + 1)
    cells = []
    for row in range(whole((y1.min() - oy) / degrees), whole((y1.max() - oy) / degrees) + 1):
        here = places[np.searchsorted(lines, row) : np.searchsorted(lines, row, "right")]
        right = len(here) - np.searchsorted(here, ox + (columns + 1) * degrees, "right")
        cells.append(np.column_stack([columns, np.full(len(columns), row), right % 2]))
    return np.concatenate(cells), edges


def crossings(x: np.ndarray, y: np.ndarray, right: np.ndarray, low: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How often edges (x1, y1, x2, y2) cross the way of each point to the right end of its cell and down to its lower corner."""
    out = np.zeros(len(x), np.int64)
    for x1, y1, x2, y2 in edges:
        if y1 != y2:
            at = (x2 - x1) * (y - y1) / (y2 - y1) + x1
            out += ((y1 > y) != (y2 > y)) & (x < at) & (at <= right)
        if x1 != x2:
            at = (y2 - y1) * (right - x1) / (x2 - x1) + y1
            # just right of the line, a rising edge is above the point where it meets the line and a falling one below
            here = (low <= at) & (at < y) if (y2 > y1) == (x2 > x1) and y1 != y2 else (low < at) & (at <= y)
            out += ((x1 > right) != (x2 > right)) & here
    return out


def _attribute_cut(points: DataFrame, polygons: DataFrame, degrees: float) -> DataFrame:
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for name, ring in zip(df["name"], df["ring"], strict=True):
                cells, edges = cut_ring(np.array([list(p) for p in ring], float), degrees)
                yield pd.DataFrame(cells, columns=["cx", "cy", "flag"]).astype({"cx": int, "cy": int, "flag": int}).assign(name=name, x1=np.nan, y1=np.nan, x2=np.nan, y2=np.nan)
                yield pd.DataFrame(edges, columns=["cx", "cy", "x1", "y1", "x2", "y2"]).astype({"cx": int, "cy": int}).assign(name=name, flag=-1)

    parts = written(polygons.select("name", "ring").mapInPandas(split, "cx long, cy long, flag int, name string, x1 double, y1 double, x2 double, y2 double"), "cells").where("flag <> 0")
    fine = (F.abs("lon") < float("inf")) & (F.abs("lat") < float("inf"))
    at = points.select("row_id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).where(fine)
    at = at.withColumns({"cx": F.floor((F.col("lon") - ORIGIN[0]) / degrees), "cy": F.floor((F.col("lat") - ORIGIN[1]) / degrees)})
    rows = lambda df, most, out: df.groupBy("cx", "cy").agg(F.ceil(F.count("*") / most).cast("int").alias(out))
    # crowded cells are split: every part of their points meets every part of their edges
    shares = written(rows(at, MET_POINTS, "ps").join(rows(parts, MET_EDGES, "es"), ["cx", "cy"]), "shares")
    deal = lambda df, own, other, *key: df.join(shares, ["cx", "cy"]).withColumn(own[0], F.pmod(F.xxhash64(*key), F.col(own)).cast("int")).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    null = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    key = ("cx", "cy", "p", "e")
    a = deal(at, "ps", "es", "row_id").select(*key, "row_id", F.col("lon").alias("x1"), F.col("lat").alias("y1"), *null("double", "x2", "y2"), *null("string", "name"), F.lit(0).alias("flag"))
    b = deal(parts, "es", "ps", "name", "flag", "x1", "y1", "x2", "y2").select(*key, *null("long", "row_id"), "x1", "y1", "x2", "y2", "name", "flag")

    def meet(df: pd.DataFrame) -> pd.DataFrame:
        here, out = df[df["flag"] == 0], []
        x, y = here["x1"].to_numpy(float), here["y1"].to_numpy(float)
        right, low = ORIGIN[0] + (here["cx"].to_numpy(float) + 1) * degrees, ORIGIN[1] + here["cy"].to_numpy(float) * degrees
        for name, some in df[df["flag"] != 0].groupby("name"):
            edges = some.loc[some["flag"] < 0, ["x1", "y1", "x2", "y2"]].to_numpy(float)
            count = crossings(x, y, right, low, edges) + int((some["flag"] == 1).sum())
            out.append(pd.DataFrame({"row_id": here["row_id"][count % 2 == 1], "name": name}))
        return pd.concat(out) if out else pd.DataFrame({"row_id": [], "name": []})

    odd = a.unionByName(b).groupBy(*key).applyInPandas(meet, "row_id long, name string")
    found = odd.groupBy("row_id", "name").agg(F.count("*").alias("n")).where("n % 2 = 1").groupBy("row_id").agg(F.min("name").alias("name"))
    return points.join(found, "row_id", "left").withColumn("continent", F.coalesce("name", F.lit(OCEAN))).drop("name")


def _attribute_shipped(points: DataFrame, polygons: DataFrame, degrees: float) -> DataFrame:
    rings = [(r.name, np.array([list(p) for p in r.ring])) for r in polygons.orderBy("name").collect()]  # SHIPPED corners at most
    cells: dict[tuple[int, int], list[int]] = {}
    for k, (_, ring) in enumerate(rings):
        (x1, y1), (x2, y2) = (np.floor(f(ring, axis=0) / degrees).astype(int) for f in (np.min, np.max))
        for cell in ((x, y) for x in range(x1, x2 + 1) for y in range(y1, y2 + 1)):
            cells.setdefault(cell, []).append(k)
    shared = points.sparkSession.sparkContext.broadcast((rings, cells))

    @F.pandas_udf("string")
    def holder(lon: pd.Series, lat: pd.Series) -> pd.Series:
        rings, cells = shared.value
        x, y = lon.to_numpy(float), lat.to_numpy(float)
        out, fine = np.full(len(x), OCEAN, object), np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        place = pd.DataFrame({"x": np.floor(x[fine] / degrees).astype(int), "y": np.floor(y[fine] / degrees).astype(int)})
        for cell, at in place.groupby(["x", "y"]).indices.items():
            left = fine[at]
            for k in cells.get(tuple(map(int, cell)), ()):
                hit = inside(x[left], y[left], rings[k][1])
                out[left[hit]] = rings[k][0]
                left = left[~hit]
        return pd.Series(out)

    return points.withColumn("continent", holder(F.col("lon").cast("double"), F.col("lat").cast("double")))


def thin(points: DataFrame, cap: int) -> DataFrame:
    """row_id, lon, lat (3 decimals) of ``cap`` evenly spaced points in row order, the first and last among them; all if there are fewer."""
    n = points.count()
    numbered = placed(points, (), ("row_id",), "i")
    if n > cap:
        wanted = [k * (n - 1) // (cap - 1) + 1 for k in range(cap)]
        spark = points.sparkSession
        numbered = numbered.join(F.broadcast(spark.createDataFrame([(int(k),) for k in wanted], "i long")), "i", "left_semi")  # cap rows
    return numbered.select("row_id", F.bround("lon", 3).alias("lon"), F.bround("lat", 3).alias("lat"))


def raster_origin(entries: Column) -> Column:
    """Struct x, y, crs of the first entry (transform of 6 or 9 numbers, crs) of a metadata array; null if none."""
    good = F.filter(entries, lambda e: F.size(e["transform"]).isin(6, 9) & e["crs"].isNotNull())
    first = F.get(good, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["transform"][2].alias("x"), first["transform"][5].alias("y"), first["crs"].alias("crs")))


def tolerate(rows: DataFrame, failed: str, most: float = 0.01) -> DataFrame:
    """Rows without read errors; over one per cent of errors is an error itself."""
    share = rows.agg(F.avg(F.col(failed).cast("double"))).first()[0] or 0.0
    if share > most:
        raise ValueError(f"{share:.1%} of the samples failed")
    return rows.where(~F.col(failed)).drop(failed)


def _utm_inverse(zone: np.ndarray, north: np.ndarray, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude (degrees, WGS 84) of UTM coordinates, by the series of Krueger to third order."""
    a, f = 6378137.0, 1 / 298.257223563
    k = f / (2 - f)
    radius = a / (1 + k) * (1 + k**2 / 4 + k**4 / 64)
    beta = (k / 2 - 2 * k**2 / 3 + 37 * k**3 / 96, k**2 / 48 + k**3 / 15, 17 * k**3 / 480)
    delta = (2 * k - 2 * k**2 / 3 - 2 * k**3, 7 * k**2 / 3 - 8 * k**3 / 5, 56 * k**3 / 15)
    xi, eta = (n - np.where(north, 0.0, 1e7)) / (0.9996 * radius), (e - 5e5) / (0.9996 * radius)
    x = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    y = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    chi = np.arcsin(np.sin(x) / np.cosh(y))
    lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    return 6.0 * zone - 183 + np.degrees(np.arctan2(np.sinh(y), np.cos(x))), np.degrees(lat)


def to_lonlat(origins: DataFrame) -> DataFrame:
    """sample_id, lon, lat of raster origins (x, y, crs) in EPSG:4326 or UTM; others and those out of range go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            code = pd.to_numeric(df["crs"].str.extract(r"^EPSG:(\d+)$", expand=False), errors="coerce").fillna(0).astype(int).to_numpy()
            x, y = df["x"].to_numpy(float), df["y"].to_numpy(float)
            utm = ((code > 32600) & (code <= 32660)) | ((code > 32700) & (code <= 32760))
            lon, lat = _utm_inverse(code % 100, code < 32700, x, y)
            lon, lat = np.where(code == 4326, x, np.where(utm, lon, np.nan)), np.where(code == 4326, y, np.where(utm, lat, np.nan))
            ok = np.isfinite(lon) & np.isfinite(lat) & (np.abs(lon) <= 180) & (np.abs(lat) <= 90)
            yield pd.DataFrame({"sample_id": df["sample_id"][ok], "lon": lon[ok], "lat": lat[ok]})

    return origins.select("sample_id", "x", "y", "crs").mapInPandas(run, "sample_id long, lon double, lat double")
