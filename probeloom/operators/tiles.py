"""Image tiles as rows: band tables, selection, units, normalisation, resizing, statistics, hand-made features.

A tile is a row (sample_id, height, width, bands array<array<double>>). What is a plain formula on arrays
is a column expression; windows and spectra over pixels run as numpy over batches of tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

EPSILON = 1e-8
#: Least denominator of shares, spans and ratios in hand-made features.
GUARD = 1e-6
#: Pixels of the tiles that are computed on together (about).
TOGETHER = 1 << 21
LEVELS = ("dn", "reflectance", "uint8")


def canonical_band(name: Column, aliases: dict[str, str]) -> Column:
    """A band's canonical name: lower case without spaces, the head before a dash, then the alias table."""
    head = F.split(F.regexp_replace(F.lower(name), r"\s+", ""), "-")[0]
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    return F.coalesce(F.try_element_at(table, head), head) if aliases else head


def preferred_channels(bands: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """One channel for each canonical band of a dataset: the preferred sensor's, then the first."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, sensors)), F.col("sensor")), F.lit(0)), F.lit(len(sensors) + 1))
    order = Window.partitionBy("dataset", "canonical").orderBy(place, "pos")
    return bands.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def select_bands(tiles: DataFrame, places: Sequence[int]) -> DataFrame:
    """Tiles with the bands at the given places (from 0), in that order; a place the tile lacks is an error."""
    return tiles.withColumn("bands", F.transform(F.array(*map(F.lit, places)), lambda p: F.element_at("bands", p + 1)))


def band_places(names: Sequence[str], wanted: Sequence[str] | str, rgb: Sequence[str] = ("red", "green", "blue")) -> list[int]:
    """Places of the bands asked for: ``all``, ``rgb`` or names in order; an unknown name is an error."""
    asked = list(names) if wanted == "all" else list(rgb) if wanted == "rgb" else list(wanted)
    missing = [b for b in asked if b not in names]
    if missing:
        raise ValueError(f"unknown bands: {missing}")
    return [list(names).index(b) for b in asked]


def map_bands(tiles: DataFrame, names: Sequence[str], targets: Sequence[str], fallback: dict[str, str], zero_fill: bool) -> DataFrame:
    """Bands in the order of targets: by name, by fallback neighbour, else zeros (or an error); ``missing`` marks those."""
    place = [names.index(t) if t in names else names.index(fallback[t]) if fallback.get(t) in names else -1 for t in targets]
    if -1 in place and not zero_fill:
        raise ValueError("bands without a source: " + ", ".join(t for t, p in zip(targets, place, strict=True) if p < 0))
    zeros = F.transform(F.col("bands")[0], lambda x: x * 0)
    return tiles.withColumn("bands", F.array(*(F.col("bands")[p] if p >= 0 else zeros for p in place))).withColumn("missing", F.array(*(F.lit(p < 0) for p in place)))


def wavelengths(bands: DataFrame, table: DataFrame, default: float | None = None) -> DataFrame:
    """bands with wavelength_um from their own column, the table (canonical, um), or the default; none of them is an error."""
    out = bands.join(table, "canonical", "left").withColumn("wavelength_um", F.coalesce("wavelength_um", "um", F.lit(default))).drop("um")
    if not out.where("wavelength_um IS NULL").isEmpty():
        raise ValueError("bands without a wavelength")
    return out


def unit_scale(old: str, new: str) -> float:
    """Factor from one unit of pixel values to another (reflectance 1 = 10 000 DN = 255 in bytes)."""
    size = {"dn": 10_000.0, "reflectance": 1.0, "uint8": 255.0}
    return size[new] / size[old]


def input_units(bands: DataFrame) -> DataFrame:
    """Per dataset and sensor: unit by the largest value. Several units within a dataset are an error."""
    top = bands.groupBy("dataset", "sensor").agg(F.max("max").alias("top"))
    out = top.withColumn("unit", F.when(F.col("top") > 1000, "dn").when(F.col("top") > 10, "uint8").otherwise("reflectance"))
    if not out.groupBy("dataset").agg(F.countDistinct("unit").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a dataset mixes units")
    return out


def _each(bands: str | Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.transform(bands, lambda b, i: F.transform(b, lambda x: f(x, i)))


def convert_unit(tiles: DataFrame, old: str, new: str) -> DataFrame:
    return tiles.withColumn("bands", _each("bands", lambda x, i: x * unit_scale(old, new)))


def normalise(tiles: DataFrame, strategy: str, stats: Sequence[dict[str, float]]) -> DataFrame:
    """Bands by ``zscore``, ``minmax``, ``minmax_zscore`` (with the statistics rescaled alike) or ``identity``; divisors are 1e-8 at least."""
    if strategy == "identity":
        return tiles
    col = lambda f: F.array(*(F.lit(float(f(s))) for s in stats))
    span = lambda s: max(s["max"] - s["min"], EPSILON)
    shift, scale = {
        "zscore": (lambda s: s["mean"], lambda s: max(s["std"], EPSILON)),
        "minmax": (lambda s: s["min"], span),
        "minmax_zscore": (lambda s: s["mean"], lambda s: span(s) * max(s["std"] / span(s), EPSILON)),
    }[strategy]
    return tiles.withColumn("bands", _each("bands", lambda x, i: (x - F.get(col(shift), i)) / F.get(col(scale), i)))


def normalise_valid(tiles: DataFrame, stats: Sequence[dict[str, float]], nodata: float, fill: float = 0.0, clip: tuple[float, float] | None = None) -> DataFrame:
    """Z-scores where pixels are finite and not nodata; others get ``fill`` after scaling."""
    mean, std = (F.array(*(F.lit(float(s[k]) if k == "mean" else max(float(s[k]), EPSILON)) for s in stats)) for k in ("mean", "std"))

    def scaled(x: Column, i: Column) -> Column:
        z = (x - F.get(mean, i)) / F.get(std, i)
        z = F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), z)) if clip else z
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x == nodata), fill).otherwise(z)

    return tiles.withColumn("bands", _each("bands", scaled))


def normalise_native(tiles: DataFrame, old: str, new: str, stats: Sequence[dict[str, float]]) -> DataFrame:
    """Bands in the unit that a model was trained on, scaled by the model's own mean and deviation."""
    return normalise(convert_unit(tiles, old, new), "zscore", stats)


def _policy_band(band: dict, policy: str, model: dict | None) -> tuple[float, float, float]:
    """Factor, shift and divisor of a band under a policy."""
    if policy == "none":
        return 1.0, 0.0, 1.0
    if policy == "model":
        factor = unit_scale(band["unit"], model["unit"])
        return (factor, model["mean"], model["std"]) if model.get("mean") is not None else (factor, 0.0, 1.0)
    low, high = (band.get("mean"), band.get("std")) if policy == "dataset" else (band.get("lower"), band.get("upper"))
    if low is None or high is None or not np.isfinite([low, high]).all():
        raise ValueError(f"{band['name']}: no numbers for the policy {policy}")
    if policy == "minmax" and high <= low:
        raise ValueError(f"{band['name']}: the upper bound must exceed the lower")
    return 1.0, low, high if policy == "dataset" else high - low


def normalise_policy(tiles: DataFrame, bands: Sequence[dict], policy: str = "dataset", model: Sequence[dict] | None = None, clip: bool = False, fill: float = 0.0) -> DataFrame:
    """Bands under a declared policy; what is null, not finite or the band's ``nodata`` gets ``fill`` after the scaling.

    Bands are dicts with name, unit, mean, std, lower, upper and nodata, as far as the policy needs them:
    ``dataset`` scales by mean and std, ``minmax`` by the bounds (``clip``: to 0 .. 1), ``model`` converts the unit
    and scales by the model's bands, ``none`` leaves the values.
    """
    if policy not in ("dataset", "model", "minmax", "none"):
        raise ValueError(f"unknown policy {policy}")
    if clip and policy != "minmax":
        raise ValueError("clip goes with minmax alone")
    if (policy == "model") != (model is not None) or model is not None and [b["name"] for b in bands] != [b["name"] for b in model]:
        raise ValueError("the policy model, and it alone, needs the model's bands in the order of the tiles' bands")
    table = [_policy_band(b, policy, m) for b, m in zip(bands, model or bands, strict=True)]
    factor, shift, divisor = (F.array(*(F.lit(float(v)) for v in column)) for column in zip(*table, strict=True))
    empty = F.array(*(F.lit(None if b.get("nodata") is None else float(b["nodata"])).cast("double") for b in bands))

    def scaled(x: Column, i: Column) -> Column:
        z = x if policy == "none" else (x * F.get(factor, i) - F.get(shift, i)) / F.get(divisor, i)
        z = F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)) if clip else z
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | F.coalesce(x == F.get(empty, i), F.lit(False)), fill).otherwise(z)

    return tiles.withColumn("bands", _each("bands", scaled))


def image_stats(tiles: DataFrame) -> DataFrame:
    """sample_id, features: for every band the mean, population deviation, largest and least value (four blocks).

    One fold over a band sums its distances from the first pixel and their squares.
    """
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def moments(b: Column) -> Column:
        first = F.get(b, F.lit(0))
        add = lambda a, x: F.struct((a["s"] + (x - first)).alias("s"), (a["q"] + (x - first) * (x - first)).alias("q"))
        done = lambda a: F.struct((first + a["s"] / F.size(b)).alias("mean"), F.sqrt(F.greatest(a["q"] / F.size(b) - (a["s"] / F.size(b)) * (a["s"] / F.size(b)), F.lit(0.0))).alias("std"))
        return F.aggregate(b, zero, add, done)

    found = F.transform("bands", lambda b: F.struct(moments(b).alias("m"), F.array_max(b).alias("high"), F.array_min(b).alias("low")))
    part = lambda f: F.transform("found", f)
    return tiles.select("sample_id", found.alias("found")).select("sample_id", F.concat(part(lambda r: r["m"]["mean"]), part(lambda r: r["m"]["std"]), part(lambda r: r["high"]), part(lambda r: r["low"])).alias("features"))


def band_statistics(tiles: DataFrame) -> DataFrame:
    """Per band place: pixels, mean, population deviation (variance 0 at least), least and largest value over all tiles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list[float]] = {}
        for df in batches:
            for bands in df["bands"]:
                for k, b in enumerate(bands):
                    b = np.asarray(b, float)
                    s = sums.setdefault(k, [0.0, 0.0, 0.0, np.inf, -np.inf])
                    sums[k] = [s[0] + len(b), s[1] + b.sum(), s[2] + (b * b).sum(), min(s[3], b.min()), max(s[4], b.max())]
        if sums:
            yield pd.DataFrame([(k, int(s[0]), *s[1:]) for k, s in sums.items()], columns=["band", "n", "s", "q", "low", "high"])

    part = tiles.select("bands").mapInPandas(run, "band int, n long, s double, q double, low double, high double")
    mean = F.sum("s") / F.sum("n")
    return part.groupBy("band").agg(F.sum("n").alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0))).alias("std"), F.min("low").alias("min"), F.max("high").alias("max"))


def stack(parts: DataFrame) -> DataFrame:
    """sample_id, bands of samples whose channels come in rows (sample_id, place, band), in the order of place."""
    return parts.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "band"))), lambda x: x["band"]).alias("bands"))


def pool_time(rows: DataFrame, how: str = "mean") -> DataFrame:
    """sample_id, features: element-wise mean or maximum over the dates of a sample."""
    f = F.avg if how == "mean" else F.max
    each = rows.select("sample_id", F.posexplode("features").alias("i", "x")).groupBy("sample_id", "i").agg(f("x").alias("x"))
    return each.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("features"))


def pool_tokens(tokens: str, mode: str) -> Column:
    """A feature vector from token vectors: the class token (if all but one make a square), the mean of the others, or both joined."""
    n = F.size(tokens)
    square = F.pow(F.floor(F.sqrt(n - 1) + 0.5), 2) == n - 1
    patches = F.when(square, F.slice(tokens, 2, F.greatest(n - 1, F.lit(1)))).otherwise(F.col(tokens))
    total = F.aggregate(patches, F.transform(F.get(F.col(tokens), F.lit(0)), lambda x: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / F.size(patches))
    first = F.when(square, F.get(F.col(tokens), F.lit(0)))
    return {"cls": F.coalesce(first, mean), "mean": mean, "both": F.concat(F.coalesce(first, mean), mean)}[mode]


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) pixel by pixel, 0 where the terms cancel or nearly so."""
    return F.zip_with(a, b, lambda x, y: F.when(F.abs(x + y) > GUARD * (F.abs(x) + F.abs(y)), (x - y) / (x + y)).otherwise(0.0))


#: Spectral indices: name, and the two bands of the normalised difference.
INDICES = (("ndvi", "nir", "red"), ("ndwi", "green", "nir"), ("ndbi", "swir1", "nir"), ("nbr", "nir", "swir2"))


#: Sensors by what they measure; of others, a band with a wavelength counts as optical.
OPTICAL, OTHER = ("s2", "landsat", "aerial", "planet", "worldview"), ("s1", "sar", "dem", "elevation")


def map_plan(bands: DataFrame) -> DataFrame:
    """dataset, sensor, kind, name, available, channels, missing, reason of every map that hand-made features look for.

    bands are rows (dataset, pos, sensor, name, canonical, wavelength_um). Each band is a map; an index is one where the
    sensor has its two roles among optical bands (of several the first; nir falls back to the narrow one). Other indices
    come as skipped, with the roles that are missing and the reason.
    """
    sensor = F.lower("sensor")
    optical = ~sensor.isin(*OTHER) & (sensor.isin(*OPTICAL) | F.col("wavelength_um").isNotNull())
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit(" "), F.lit("%20")), F.lit("."), F.lit("%2E"))
    nth = F.row_number().over(Window.partitionBy("dataset", "sensor", "name").orderBy("pos"))  # a dataset's bands
    mark = F.when(F.col("n") > 1, F.concat(F.lit("#"), F.col("n").cast("string"))).otherwise("")
    none = F.array().cast("array<string>")
    single = bands.withColumn("n", nth).select("dataset", "sensor", F.lit("band").alias("kind"), F.concat(safe("sensor"), F.lit(".band."), safe("name"), mark).alias("name"), F.lit(True).alias("available"), F.array(F.col("pos").cast("int")).alias("channels"), none.alias("missing"), F.lit(None).cast("string").alias("reason"))
    roles = bands.groupBy("dataset", "sensor", "canonical").agg(F.min(F.when(optical, F.col("pos"))).cast("int").alias("at"))
    known = roles.groupBy("dataset", "sensor").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("canonical", "at")), lambda x: x["at"].isNotNull())).alias("at"))
    asked = known.select("dataset", "sensor", "at", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.array(F.lit(a), F.lit(b)).alias("roles")) for n, a, b in INDICES))).alias("i"))
    place = lambda r: F.coalesce(F.try_element_at("at", r), F.when(r == "nir", F.try_element_at("at", F.lit("nir_narrow"))))
    found = asked.withColumns({"channels": F.transform("i.roles", place), "missing": F.filter("i.roles", lambda r: place(r).isNull())})
    whole = F.size("missing") == 0
    reason = F.when(whole, None).when(F.size("at") > 0, "missing optical bands").otherwise("non-optical sensor")
    return single.unionByName(found.select("dataset", "sensor", F.lit("index").alias("kind"), F.concat(safe("sensor"), F.lit(".index."), "i.n").alias("name"), whole.alias("available"), F.when(whole, F.col("channels")).otherwise(F.array().cast("array<int>")).alias("channels"), "missing", reason.alias("reason")))


def index_maps(tiles: DataFrame, names: Sequence[str]) -> DataFrame:
    """Tiles with ``maps`` (name, pixels): their bands and the indices that the bands allow; nir falls back to the narrow one."""
    at = {n: i for i, n in enumerate(names)}
    at.setdefault("nir", at.get("nir_narrow", -1))
    maps = [F.struct(F.lit(n).alias("name"), F.col("bands")[i].alias("px")) for i, n in enumerate(names)]
    maps += [F.struct(F.lit(k).alias("name"), normalized_difference(F.col("bands")[at[a]], F.col("bands")[at[b]]).alias("px")) for k, a, b in INDICES if at.get(a, -1) >= 0 and at.get(b, -1) >= 0]
    return tiles.withColumn("maps", F.array(*maps))


def statistics_of(x: np.ndarray) -> np.ndarray:
    """(..., H, W) -> (..., 9): mean, population deviation, least and largest value, percentiles 10, 25, 50, 75, 90."""
    flat = x.reshape(*x.shape[:-2], -1)
    basic = np.stack([flat.mean(-1), flat.std(-1), flat.min(-1), flat.max(-1)], -1)
    return np.concatenate([basic, np.moveaxis(np.percentile(flat, [10, 25, 50, 75, 90], axis=-1), 0, -1)], -1)


# Most features of a map are linear along its axes: a matrix for the rows, one for the columns, and products of both with the
# pixels give differences, means of cells, boxes and quarters, and moments of weights. Slopes are complex numbers (across
# + i down), so that a square doubles their angle and directions that differ by half a turn agree.


def _apply(rows: np.ndarray, x: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """rows (a x H) and columns (b x W) on (..., H, W): (..., a, b)."""
    return rows @ x @ columns.T


def _differences(n: int) -> np.ndarray:
    """Central differences of n values, one-sided at the ends; of a single one 0."""
    at = np.arange(n)
    low, high = np.maximum(at - 1, 0), np.minimum(at + 1, n - 1)
    out = np.zeros((n, n))
    np.add.at(out, (at, high), 1.0)
    np.add.at(out, (at, low), -1.0)
    return out / np.maximum(high - low, 1)[:, None]


def _members(group: np.ndarray, groups: int) -> np.ndarray:
    """(groups x n): 1 where value j belongs to group i."""
    return (np.arange(groups)[:, None] == group[None, :]).astype(float)


def _means(members: np.ndarray) -> np.ndarray:
    """The rows of a membership matrix as means; a group without members gives 0."""
    return members / np.maximum(members.sum(axis=1, keepdims=True), 1)


def _cells(x: np.ndarray, k: int) -> np.ndarray:
    """Means over k x k cells; cells at the lower and right edge may be smaller."""
    rows, columns = (_means(_members(np.arange(n) // k, -(-n // k))) for n in x.shape[-2:])
    return _apply(rows, x, columns)


def _slopes(x: np.ndarray) -> np.ndarray:
    """Slope of every pixel, across + i down."""
    h, w = x.shape[-2:]
    return x @ _differences(w).T + 1j * (_differences(h) @ x)


def _entropy(weights: np.ndarray) -> np.ndarray:
    """Entropy of the last axis as a part of the largest possible one; no weight at all gives 0."""
    share = weights / np.maximum(weights.sum(axis=-1, keepdims=True), GUARD)
    return np.where(share > 0, share * -np.log(np.where(share > 0, share, 1)), 0).sum(axis=-1) / np.log(weights.shape[-1])


def _counted(code: np.ndarray, bins: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How often (or with what weight) each code below ``bins`` stands in each of (..., H, W): one count for all maps."""
    lead = code.shape[:-2]
    flat = code.reshape(-1, code.shape[-2] * code.shape[-1]) + bins * np.arange(int(np.prod(lead)))[:, None]
    found = np.bincount(flat.ravel(), None if weights is None else weights.ravel(), bins * len(flat))
    return found.reshape(*lead, bins)


def texture_of(x: np.ndarray) -> np.ndarray:
    """(..., H, W) -> (..., 12): at cells of 1, 2 and 4 pixels, mean and deviation of the slope, its coherence, and the entropy of its direction in eight sectors of a half turn.

    Coherence is the length of the mean squared slope as a part of the mean squared length: 1 if all slopes run along one line.
    """
    both = (-2, -1)

    def at(k: int) -> list[np.ndarray]:
        z = _slopes(_cells(x, k))
        steep = np.abs(z)
        least = np.maximum(steep.max(both, keepdims=True), GUARD)
        square = (z / least) ** 2
        turn = np.mod(np.angle(square), 2 * np.pi) / (2 * np.pi)
        sector = np.minimum(np.floor(turn * 8).astype(int), 7)
        coherence = np.abs(square.mean(both)) / np.maximum(np.abs(square).mean(both), GUARD)
        return [steep.mean(both), steep.std(both), coherence, _entropy(_counted(sector, 8, steep / least))]

    return np.stack([f for k in (1, 2, 4) for f in at(k)], axis=-1)


def _patterns(x: np.ndarray) -> np.ndarray:
    """Entropy of the local binary patterns (neighbour above the centre) and the share of those with two turns at most.

    Neighbours go once around in eighths of a turn; a pattern has a turn at every bit that differs from the one before.
    """
    h, w = x.shape[-2:]
    if min(h, w) < 3:
        return np.zeros((*x.shape[:-2], 2))
    code = np.zeros((*x.shape[:-2], h - 2, w - 2), np.uint8)
    for k, angle in enumerate(np.arange(8) * np.pi / 4 - 3 * np.pi / 4):
        i, j = 1 + round(np.sin(angle)), 1 + round(np.cos(angle))
        code |= (x[..., i : h - 2 + i, j : w - 2 + j] > x[..., 1 : h - 1, 1 : w - 1]).astype(np.uint8) << np.uint8(k)
    turns = np.bitwise_count(code ^ ((code << np.uint8(1)) | (code >> np.uint8(7))))
    return np.stack([_entropy(_counted(code.astype(int), 256)), (turns <= 2).mean(axis=(-2, -1))], axis=-1)


def _highest(x: np.ndarray) -> np.ndarray:
    """Largest value within one pixel of each, along one axis and then the other."""
    for axis in (-1, -2):
        y = np.moveaxis(x, axis, -1)
        out = y.copy()
        np.maximum(out[..., 1:], y[..., :-1], out=out[..., 1:])
        np.maximum(out[..., :-1], y[..., 1:], out=out[..., :-1])
        x = np.moveaxis(out, -1, axis)
    return x


def _corners(unit: np.ndarray) -> np.ndarray:
    """Share of pixels that are peaks of the positive Harris response (over a hundredth of the largest), and its mean."""
    box = [_means((np.abs(np.subtract.outer(np.arange(n), np.arange(n))) <= 1).astype(float)) for n in unit.shape[-2:]]
    z = _slopes(unit)
    length = _apply(box[0], np.abs(z) ** 2, box[1])  # the trace of the slopes' second moments, and in the next line twice their deviator
    square = _apply(box[0], z**2, box[1])
    response = np.maximum((length**2 - np.abs(square) ** 2) / 4 - 0.04 * length**2, 0)
    peak = (response > 0.01 * response.max(axis=(-2, -1), keepdims=True)) & (response >= _highest(response))
    return np.stack([peak.mean(axis=(-2, -1)), response.mean(axis=(-2, -1))], axis=-1)


def _quadrants(x: np.ndarray) -> np.ndarray:
    """Mean and deviation of the four quarters; an odd row or column belongs to the upper or left one; an empty quarter gives 0."""
    up, left = (_members((np.arange(n) >= (n + 1) // 2).astype(int), 2) for n in x.shape[-2:])
    mean = _apply(_means(up), x, _means(left))
    apart = x - _apply(up.T, mean, left.T)
    return np.stack([mean, np.sqrt(_apply(_means(up), apart**2, _means(left)))], axis=-1).reshape(*x.shape[:-2], 8)


def _spread(weights: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Anisotropy and root mean square radius of weights over a tile whose axes go from -1 to 1; the weights are taken to sum to ``least`` at least."""
    powers = [np.vander(np.linspace(-1, 1, n) if n > 1 else np.zeros(1), 3, increasing=True).T for n in weights.shape[-2:]]
    share = weights / np.maximum(weights.sum(axis=(-2, -1), keepdims=True), least)
    moment = _apply(powers[0], share, powers[1])  # (i, j): the mean of y^i x^j
    x = np.maximum(moment[..., 0, 2] - moment[..., 0, 1] ** 2, 0)
    y = np.maximum(moment[..., 2, 0] - moment[..., 1, 0] ** 2, 0)
    both = moment[..., 1, 1] - moment[..., 0, 1] * moment[..., 1, 0]
    return np.stack([np.minimum(np.abs(x - y + 2j * both) / np.maximum(x + y, GUARD), 1), np.sqrt(x + y)], axis=-1)


def structure_of(x: np.ndarray) -> np.ndarray:
    """(..., H, W) -> (..., 16): patterns, corners, quarters, and where the values under the first and over the third quartile lie."""
    low, first, third, high = np.percentile(x, [0, 25, 75, 100], axis=(-2, -1), keepdims=True)
    span = np.maximum(high - low, GUARD)
    tails = [_spread(np.maximum(apart, 0), GUARD * span) for apart in (first - x, x - third)]
    return np.concatenate([_patterns(x), _corners((x - low) / span), _quadrants(x), *tails], axis=-1)


def _statistics(m: np.ndarray) -> list[float]:
    return statistics_of(m).tolist()


def _texture(m: np.ndarray) -> list[float]:
    return texture_of(m).tolist()


def _structure(m: np.ndarray) -> list[float]:
    return structure_of(m).tolist()


LEVEL_COLUMNS = {1: 9, 2: 21, 3: 37}


def stacked(df: pd.DataFrame, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one size and number of layers together: their places in df, and their pixels as (rows, layers, height, width)."""
    layers = df[column].map(len)
    for (h, w, n), part in df.groupby([df["height"], df["width"], layers]).indices.items():
        step = max(1, TOGETHER // max(1, h * w * n))
        for at in range(0, len(part), step):
            some = part[at : at + step]
            yield some, np.array([np.stack(x) if n else np.zeros((0, h * w)) for x in df[column].iloc[some]], float).reshape(len(some), n, h, w)


def _per_tile(df: pd.DataFrame, column: str, f: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """f of each tile's layers, computed for many tiles at once."""
    out: list[np.ndarray] = [np.zeros(0)] * len(df)
    for places, x in stacked(df, column):
        for i, v in zip(places, f(x), strict=True):
            out[i] = v
    return out


def handmade(tiles: DataFrame, level: int = 3) -> DataFrame:
    """sample_id, features from the maps of a tile: 9, 21 or 37 columns a map for levels 1 to 3, a level's columns before the next's."""

    def features(x: np.ndarray) -> np.ndarray:
        return np.concatenate([f(x).reshape(len(x), -1) for f in (statistics_of, texture_of, structure_of)[:level]], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"sample_id": df["sample_id"], "features": _per_tile(df, "px", features)})

    px = F.transform("maps", lambda m: m["px"])
    return tiles.select("sample_id", "height", "width", px.alias("px")).mapInPandas(run, "sample_id long, features array<double>")


def feature_manifest(names: Sequence[str], level: int = 3) -> list[str]:
    """Names of ``handmade``'s columns, in order."""
    first = ["mean", "std", "min", "max", "p10", "p25", "p50", "p75", "p90"]
    second = [f"{k}_x{s}" for s in (1, 2, 4) for k in ("gradient_mean", "gradient_std", "coherence", "orientation_entropy")]
    third = ["lbp_entropy", "lbp_uniform", "corner_density", "corner_strength", *(f"{q}_{k}" for q in ("nw", "ne", "sw", "se") for k in ("mean", "std")), *(f"{t}_{k}" for t in ("low", "high") for k in ("anisotropy", "spread"))]
    return [f"{n}_{c}" for cols in (first, second, third)[:level] for n in names for c in cols]


def _weights(old: int, new: int, how: str) -> np.ndarray:
    """Row-stochastic matrix that resamples ``old`` values to ``new``, pixel centres aligned."""
    at = (np.arange(new) + 0.5) * old / new - 0.5
    out = np.zeros((new, old))
    if how == "nearest":
        out[np.arange(new), np.minimum((np.arange(new) * old / new).astype(int), old - 1)] = 1
    elif how == "area":
        edge = np.arange(new + 1) * old / new
        for i in range(new):
            k = np.arange(old)
            out[i] = np.clip(np.minimum(k + 1, edge[i + 1]) - np.maximum(k, edge[i]), 0, None)
    else:
        reach, kernel = (1, lambda d: np.maximum(1 - d, 0)) if how == "bilinear" else (2, lambda d: np.where(d <= 1, (1.25 * d - 2.25) * d * d + 1, np.where(d < 2, ((-0.75 * d + 3.75) * d - 6) * d + 3, 0)))
        base = np.floor(at).astype(int)
        for k in range(1 - reach, reach + 1):
            np.add.at(out, (np.arange(new), np.clip(base + k, 0, old - 1)), kernel(np.abs(at - (base + k))))
    return out / out.sum(axis=1, keepdims=True)


def resize(tiles: DataFrame, height: int, width: int, how: str = "bilinear") -> DataFrame:
    """Tiles resampled to a size (nearest, area, bilinear or bicubic) by a matrix on either side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for h, w, bands in zip(df["height"], df["width"], df["bands"], strict=True):
                a, b = _weights(h, height, how), _weights(w, width, how)
                out.append([(a @ np.asarray(x, float).reshape(h, w) @ b.T).ravel() for x in bands])
            yield pd.DataFrame({"sample_id": df["sample_id"], "height": height, "width": width, "bands": out})

    return tiles.select("sample_id", "height", "width", "bands").mapInPandas(run, "sample_id long, height int, width int, bands array<array<double>>")


def stretch(tiles: DataFrame, low: float = 2, high: float = 98) -> DataFrame:
    """Tiles with bands stretched between two percentiles to whole numbers from 0 to 255."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for bands in df["bands"]:
                part = []
                for b in bands:
                    b = np.asarray(b, float)
                    p, q = np.percentile(b, [low, high])
                    part.append(np.clip(np.floor((b - p) / max(q - p, EPSILON) * 255), 0, 255).astype(int))
                out.append(part)
            yield df.assign(bands=out)

    return tiles.select("sample_id", "height", "width", "bands").mapInPandas(run, "sample_id long, height int, width int, bands array<array<int>>")


def perceptual_hash(tiles: DataFrame, side: int = 16) -> DataFrame:
    """sample_id, hash: signs of the low-frequency cosine coefficients of the mean band against their median, as hex."""
    k = np.arange(2 * side)
    dct = np.cos(np.pi * (2 * k[None, :] + 1) * np.arange(side)[:, None] / (4 * side))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for h, w, bands in zip(df["height"], df["width"], df["bands"], strict=True):
                grey = np.mean([np.asarray(b, float) for b in bands], axis=0).reshape(h, w)
                grey = _weights(h, 2 * side, "area") @ grey @ _weights(w, 2 * side, "area").T
                c = dct @ grey @ dct.T
                c = np.round(c / max(np.abs(c).max(), 1e-300), 9)  # what is zero but for rounding has no sign of its own
                out.append(np.packbits(c.ravel() > np.median(c)).tobytes().hex())
            yield pd.DataFrame({"sample_id": df["sample_id"], "hash": out})

    return tiles.select("sample_id", "height", "width", "bands").mapInPandas(run, "sample_id long, hash string")


def random_filters(bands: int, size: int, n: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, bands * size * size))


def whiten(patches: np.ndarray, least: float = 1e-8, ridge: float = 1e-3) -> np.ndarray:
    """Patches (rows) centred, scaled to length one, and whitened twice (by the inverse of their second moments plus a ridge)."""
    apart = patches - patches.mean(axis=1)[:, None]
    length = np.sqrt((apart**2).sum(axis=1))
    unit = apart / np.where(length < least, 1.0, length)[:, None]
    return np.linalg.solve(unit.T @ unit / len(unit) + ridge * np.eye(unit.shape[1]), unit.T).T


def whitened_filters(tiles: DataFrame, size: int, n: int, seed: int = 0) -> np.ndarray:
    """n whitened filters from patches of the first n tiles by md5(id:seed) (again from the first if there are fewer), one random place each."""
    rows = tiles.orderBy(F.md5(F.concat(F.col("sample_id").cast("string"), F.lit(f":{seed}"))), "sample_id").limit(n).select("height", "width", "bands").toPandas()  # n tiles
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        h, w, bands = rows.iloc[k % len(rows)]
        y, z = rng.integers(0, h - size + 1), rng.integers(0, w - size + 1)
        out.append(np.stack(bands).astype(float).reshape(len(bands), h, w)[:, y : y + size, z : z + size].ravel())
    return whiten(np.array(out))


#: What is pooled of each response, by mode.
POOLS = {"mean": ("mean",), "stdev": ("mean", "std"), "all": ("mean", "std", "max", "min")}


def convolution_features(tiles: DataFrame, filters: np.ndarray, size: int, pool: str = "mean", bias: float = -1.0) -> DataFrame:
    """sample_id, features: for the positive and the negative part of each filter's response plus bias, the mean over the tile; ``stdev`` adds the sample deviation, ``all`` also the largest and least value."""
    kinds = {"mean": lambda r: r.mean(1), "std": lambda r: r.std(1, ddof=1), "max": lambda r: r.max(1), "min": lambda r: r.min(1)}

    def features(x: np.ndarray) -> np.ndarray:
        n, c, h, w = x.shape
        spots = (h - size + 1) * (w - size + 1)
        out = []
        for at in range(0, n, step := max(1, TOGETHER // (spots * c * size * size))):
            part = np.lib.stride_tricks.sliding_window_view(x[at : at + step], (size, size), axis=(2, 3))
            r = part.transpose(0, 2, 3, 1, 4, 5).reshape(-1, spots, filters.shape[1]) @ filters.T + bias
            r = np.concatenate([np.maximum(r, 0), np.maximum(-r, 0)], axis=2)
            out.append(np.concatenate([kinds[k](r) for k in POOLS[pool]], axis=1))
        return np.concatenate(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"sample_id": df["sample_id"], "features": _per_tile(df, "bands", features)})

    return tiles.select("sample_id", "height", "width", "bands").mapInPandas(run, "sample_id long, features array<double>")


def embed(tiles: DataFrame, model: Callable[[np.ndarray], np.ndarray | dict]) -> DataFrame:
    """sample_id, features from any batch image model (B, C, H, W) -> (B, K); of a dict the values join in the order of keys; (B, N, K) tokens are averaged. A batch's tiles must have one size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            x = np.stack([np.stack([np.asarray(b, float).reshape(h, w) for b in bands]) for h, w, bands in zip(df["height"], df["width"], df["bands"], strict=True)])
            out = model(x)
            parts = [out[k] for k in sorted(out)] if isinstance(out, dict) else [out]
            flat = np.concatenate([p.mean(axis=1) if p.ndim == 3 else p for p in map(np.asarray, parts)], axis=1)
            yield pd.DataFrame({"sample_id": df["sample_id"], "features": list(flat.astype(float))})

    return tiles.select("sample_id", "height", "width", "bands").mapInPandas(run, T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("features", T.ArrayType(T.DoubleType()))]))


def shift_classes(mask: str) -> Column:
    """Masks whose classes begin with 1, from 0; 0 stays 0."""
    return F.transform(mask, lambda x: F.greatest(x - 1, F.lit(0)))
