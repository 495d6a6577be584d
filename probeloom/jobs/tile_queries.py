"""Registered queries over tiles and feature tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.jobs.fixtures import oracle, view
from probeloom.jobs.probe_queries import BINOMIAL
from probeloom.operators import probes as P
from probeloom.operators import tiles as X

QUERIES, ORACLES = {}, {}
NAMES = ("red", "green", "blue", "nir")
STATS = [{"mean": 0.1 * k, "std": 0.5 + 0.1 * k, "min": -1.0 - k, "max": 1.0 + k} for k in range(4)]


def register(sql: str | None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, *views)
        return f

    return add


def _tiles(spark, sf_dir, bands: int = 4) -> DataFrame:
    """Vectors of 64 numbers as tiles of four bands of 4 x 4 pixels (or one of 8 x 8)."""
    n, side = 64 // bands, int((64 // bands) ** 0.5)
    parts = F.array(*(F.transform(F.slice("px", n * b + 1, n), lambda x: x.cast("double")) for b in range(bands)))
    return view(spark, sf_dir, "tiles").select("sample_id", "label", F.lit(side).alias("height"), F.lit(side).alias("width"), parts.alias("bands"))


_UN = "WITH u AS (SELECT sample_id, CAST(floor(i / 16) AS INTEGER) AS b, i % 16 AS p, x FROM (SELECT sample_id, unnest(range(0, 64)) AS i, unnest(px::DOUBLE[]) AS x FROM tiles)) "
_OUT = "SELECT sample_id, b, p, round({}, 9) + 0.0 AS x FROM u"


def _long(tiles: DataFrame) -> DataFrame:
    rows = tiles.select("sample_id", F.posexplode("bands").alias("b", "band")).select("sample_id", "b", F.posexplode("band").alias("p", "x"))
    return rows.select("sample_id", "b", F.col("p").cast("long").alias("p"), (F.round("x", 9) + F.lit(0.0)).alias("x"))


@register(_UN + ", s AS (SELECT sample_id, b, avg(x) AS m, stddev_pop(x) AS s, max(x) AS h, min(x) AS l FROM u GROUP BY 1, 2) SELECT sample_id, round(max(m) FILTER (b = 0), 9) AS mean0, round(max(s) FILTER (b = 3), 9) AS std3, max(h) FILTER (b = 1) AS max1, max(l) FILTER (b = 2) AS min2 FROM s GROUP BY 1", "tiles")
def tile_statistics(spark, sf_dir):
    """TF1"""
    f = F.col("features")
    return X.image_stats(_tiles(spark, sf_dir)).select("sample_id", F.round(f[0], 9).alias("mean0"), F.round(f[7], 9).alias("std3"), f[9].alias("max1"), f[14].alias("min2"))


@register(_UN + "SELECT b AS band, count(*) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, min(x) AS min, max(x) AS max FROM u GROUP BY 1", "tiles")
def band_statistics(spark, sf_dir):
    """AG12"""
    return X.band_statistics(_tiles(spark, sf_dir)).select("band", "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "min", "max")


@register(_UN + _OUT.format("(x - 0.1 * b) / (0.5 + 0.1 * b)"), "tiles")
def normalise_zscore(spark, sf_dir):
    """TB6"""
    return _long(X.normalise(_tiles(spark, sf_dir), "zscore", STATS))


@register(_UN + _OUT.format("(x + 1 + b) / (2 + 2 * b)"), "tiles")
def normalise_minmax(spark, sf_dir):
    """TB6"""
    return _long(X.normalise(_tiles(spark, sf_dir), "minmax", STATS))


@register(_UN + _OUT.format("CASE WHEN x = 0 OR p = 3 THEN -9 ELSE greatest(-2, least(2, (x - 0.1 * b) / (0.5 + 0.1 * b))) END"), "tiles")
def normalise_nodata(spark, sf_dir):
    """TB8"""
    holes = _tiles(spark, sf_dir).withColumn("bands", F.transform("bands", lambda b: F.transform(b, lambda x, i: F.when(i == 3, float("nan")).otherwise(x))))
    return _long(X.normalise_valid(holes, STATS, 0.0, -9.0, (-2.0, 2.0)))


@register(_UN + _OUT.format("(x - 0.1 * b) / ((2 + 2 * b) * greatest((0.5 + 0.1 * b) / (2 + 2 * b), 1e-8))"), "tiles")
def normalise_minmax_zscore(spark, sf_dir):
    """TB6"""
    return _long(X.normalise(_tiles(spark, sf_dir), "minmax_zscore", STATS))


@register(_UN + _OUT.format("x"), "tiles")
def normalise_identity(spark, sf_dir):
    """TB6"""
    return _long(X.normalise(_tiles(spark, sf_dir), "identity", STATS))


@register(_UN + _OUT.format("(x * 10000 / 255 - 0.1 * b) / (0.5 + 0.1 * b)"), "tiles")
def normalise_native(spark, sf_dir):
    """TB6"""
    return _long(X.normalise_native(_tiles(spark, sf_dir), "uint8", "dn", STATS))


_HOLE = "CASE WHEN p = 3 OR p = 5 AND b = 1 THEN 7 ELSE {} END"


def _policy(spark, sf_dir, policy: str, **more) -> DataFrame:
    """The tiles with a hole in every band (pixel 3) and a nodata value in the second (pixel 5), under a policy."""
    holes = F.transform("bands", lambda b, k: F.transform(b, lambda x, i: F.when(i == 3, float("inf")).when((i == 5) & (k == 1), -99.0).otherwise(x)))
    bands = [{"name": n, "unit": "reflectance", "mean": q["mean"], "std": q["std"], "lower": q["min"], "upper": q["max"], "nodata": -99.0 if k == 1 else None} for k, (n, q) in enumerate(zip(NAMES, STATS, strict=True))]
    return _long(X.normalise_policy(_tiles(spark, sf_dir).withColumn("bands", holes), bands, policy, fill=7.0, **more))


@register(_UN + _OUT.format(_HOLE.format("(x - 0.1 * b) / (0.5 + 0.1 * b)")), "tiles")
def policy_dataset(spark, sf_dir):
    """TB8"""
    return _policy(spark, sf_dir, "dataset")


@register(_UN + _OUT.format(_HOLE.format("greatest(0, least(1, (x + 1 + b) / (2 + 2 * b)))")), "tiles")
def policy_minmax(spark, sf_dir):
    """TB8"""
    return _policy(spark, sf_dir, "minmax", clip=True)


@register(_UN + _OUT.format(_HOLE.format("CASE WHEN b = 2 THEN x * 10000 ELSE (x * 10000 - b) / (b + 2) END")), "tiles")
def policy_model(spark, sf_dir):
    """TB8"""
    model = [{"name": n, "unit": "dn", "mean": None if k == 2 else float(k), "std": k + 2.0} for k, n in enumerate(NAMES)]
    return _policy(spark, sf_dir, "model", model=model)


@register(_UN + _OUT.format(_HOLE.format("x")), "tiles")
def policy_none(spark, sf_dir):
    """TB8"""
    return _policy(spark, sf_dir, "none")


@register(_UN + _OUT.format("x * 0.0255"), "tiles")
def convert_units(spark, sf_dir):
    """TB7"""
    return _long(X.convert_unit(_tiles(spark, sf_dir), "dn", "uint8"))


@register(_UN + "SELECT sample_id, CASE b WHEN 3 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS b, p, round(x, 9) + 0.0 AS x FROM u WHERE b IN (3, 0, 1)", "tiles")
def select_bands(spark, sf_dir):
    """TB4"""
    return _long(X.select_bands(_tiles(spark, sf_dir), X.band_places(NAMES, ("nir", "red", "green"))))


@register(_UN + "SELECT sample_id, CASE b WHEN 2 THEN 0 ELSE 2 END AS b, p, round(x, 9) + 0.0 AS x FROM u WHERE b IN (2, 3) UNION ALL SELECT sample_id, 1, p, 0.0 FROM u WHERE b = 0", "tiles")
def map_bands(spark, sf_dir):
    """TB3"""
    return _long(X.map_bands(_tiles(spark, sf_dir), NAMES, ("coastal", "swir1", "nir"), {"coastal": "blue"}, True))


_BANDS = "WITH b AS (SELECT concat('d', CAST(s_nationkey % 3 AS STRING)) AS dataset, s_suppkey AS pos, CASE s_suppkey % 3 WHEN 0 THEN 'S2' WHEN 1 THEN 'L8' ELSE 'S1' END AS sensor, CASE s_suppkey % 4 WHEN 0 THEN 'Red' WHEN 1 THEN 'B 04-x' WHEN 2 THEN 'NIR' ELSE 'vv' END AS name, CASE s_nationkey % 3 WHEN 0 THEN abs(s_acctbal::DOUBLE) + 1001 WHEN 1 THEN abs(s_acctbal::DOUBLE) % 240 + 11 ELSE abs(s_acctbal::DOUBLE) / 1000 END AS top, CASE WHEN s_suppkey % 7 = 0 THEN 1.5 END AS own FROM supplier), c AS (SELECT *, CASE split_part(replace(lower(name), ' ', ''), '-', 1) WHEN 'b04' THEN 'red' ELSE split_part(replace(lower(name), ' ', ''), '-', 1) END AS canonical FROM b) "


def _bands(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c + 1).cast("int"))
    size, kind = F.abs(F.col("s_acctbal").cast("double")), F.col("s_nationkey") % 3
    top = F.when(kind == 0, size + 1001).when(kind == 1, size % 240 + 11).otherwise(size / 1000)
    rows = s.select(
        F.concat(F.lit("d"), kind.cast("string")).alias("dataset"), F.col("s_suppkey").alias("pos"), pick(F.col("s_suppkey") % 3, "S2", "L8", "S1").alias("sensor"),
        pick(F.col("s_suppkey") % 4, "Red", "B 04-x", "NIR", "vv").alias("name"), top.alias("max"), F.when(F.col("s_suppkey") % 7 == 0, 1.5).alias("own"),
    )
    return rows.withColumn("canonical", X.canonical_band(F.col("name"), {"b04": "red"}))


@register(_BANDS + "SELECT dataset, pos, canonical FROM c")
def canonical_bands(spark, sf_dir):
    """TB1"""
    return _bands(spark, sf_dir).select("dataset", "pos", "canonical")


@register(_BANDS + "SELECT dataset, canonical, pos FROM (SELECT *, row_number() OVER (PARTITION BY dataset, canonical ORDER BY CASE sensor WHEN 'L8' THEN 1 WHEN 'S2' THEN 2 ELSE 3 END, pos) AS k FROM c) WHERE k = 1")
def preferred_channels(spark, sf_dir):
    """TB2"""
    return X.preferred_channels(_bands(spark, sf_dir), ("L8", "S2")).select("dataset", "canonical", "pos")


@register(_BANDS + "SELECT dataset, pos, coalesce(own, CASE canonical WHEN 'red' THEN 0.665 ELSE 9.0 END) AS wavelength_um FROM c")
def wavelengths(spark, sf_dir):
    """TB5"""
    table = spark.createDataFrame([("red", 0.665)], "canonical string, um double")
    return X.wavelengths(_bands(spark, sf_dir).withColumnRenamed("own", "wavelength_um"), table, 9.0).select("dataset", "pos", "wavelength_um")


@register(_BANDS + "SELECT dataset, sensor, CASE WHEN max(top) > 1000 THEN 'dn' WHEN max(top) > 10 THEN 'uint8' ELSE 'reflectance' END AS unit FROM c GROUP BY 1, 2")
def input_units(spark, sf_dir):
    """AG30"""
    return X.input_units(_bands(spark, sf_dir)).select("dataset", "sensor", "unit")


@register(_BANDS + """, o AS (SELECT *, lower(sensor) NOT IN ('s1', 'sar', 'dem', 'elevation') AND (lower(sensor) IN ('s2', 'landsat', 'aerial', 'planet', 'worldview') OR own IS NOT NULL) AS optical, row_number() OVER (PARTITION BY dataset, sensor, name ORDER BY pos) AS n FROM c),
r AS (SELECT dataset, sensor, min(pos) FILTER (optical AND canonical = 'nir') AS nir, min(pos) FILTER (optical AND canonical = 'red') AS red, bool_or(optical) AS any_optical FROM o GROUP BY 1, 2),
i AS (SELECT dataset, sensor, any_optical, unnest(['ndvi', 'ndwi', 'ndbi', 'nbr']) AS n, unnest([nir, NULL, NULL, nir]) AS a, unnest([red, nir, nir, NULL]) AS b, unnest(['nir', 'green', 'swir1', 'nir']) AS ra, unnest(['red', 'nir', 'nir', 'swir2']) AS rb FROM r)
SELECT dataset, sensor, 'band' AS kind, sensor || '.band.' || replace(name, ' ', '%20') || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS name, true AS available, CAST(pos AS VARCHAR) AS channels, '' AS missing, NULL AS reason FROM o
UNION ALL SELECT dataset, sensor, 'index', sensor || '.index.' || n, a IS NOT NULL AND b IS NOT NULL, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || ',' || b ELSE '' END, CASE WHEN a IS NULL AND b IS NULL THEN ra || ',' || rb WHEN a IS NULL THEN ra WHEN b IS NULL THEN rb ELSE '' END, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN NULL WHEN any_optical THEN 'missing optical bands' ELSE 'non-optical sensor' END FROM i""")
def planned_maps(spark, sf_dir):
    """TF2, TF6: the maps that bands allow, and those that are skipped with the reason"""
    plan = X.map_plan(_bands(spark, sf_dir).withColumnRenamed("own", "wavelength_um"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return plan.select("dataset", "sensor", "kind", "name", "available", text("channels"), text("missing"), "reason")


@register(_UN + "SELECT sample_id, b, p, round(x, 9) + 0.0 AS x FROM u", "tiles")
def stack_channels(spark, sf_dir):
    """TB10"""
    parts = _tiles(spark, sf_dir).select("sample_id", F.posexplode("bands").alias("place", "band")).repartition(7)
    return _long(X.stack(parts))


@register("WITH u AS (SELECT label, unnest(range(0, 64)) AS i, unnest(px::DOUBLE[]) AS x FROM tiles) SELECT label AS sample_id, i, round(avg(x), 9) + 0.0 AS x FROM u GROUP BY 1, 2", "tiles")
def pool_time(spark, sf_dir):
    """TB11"""
    rows = view(spark, sf_dir, "tiles").select(F.col("label").alias("sample_id"), F.col("px").cast("array<double>").alias("features"))
    return X.pool_time(rows).select("sample_id", F.posexplode("features").alias("i", "x")).select("sample_id", F.col("i").cast("long").alias("i"), (F.round("x", 9) + F.lit(0.0)).alias("x"))


@register("SELECT sample_id, round(px[1], 9) + 0.0 AS cls, round((px[5]::DOUBLE + px[9] + px[13] + px[17]) / 4, 9) + 0.0 AS mean FROM (SELECT sample_id, px::DOUBLE[] AS px FROM tiles)", "tiles")
def pool_tokens(spark, sf_dir):
    """TB12"""
    tokens = F.array(*(F.transform(F.slice("px", 4 * k + 1, 4), lambda x: x.cast("double")) for k in range(5)))
    both = view(spark, sf_dir, "tiles").withColumn("tokens", tokens).select("sample_id", X.pool_tokens("tokens", "both").alias("f"))
    return both.select("sample_id", (F.round(F.col("f")[0], 9) + F.lit(0.0)).alias("cls"), (F.round(F.col("f")[4], 9) + F.lit(0.0)).alias("mean"))


@register(_UN + "SELECT n.sample_id, n.p, round(CASE WHEN abs(n.x + r.x) > 1e-6 * (abs(n.x) + abs(r.x)) THEN (n.x - r.x) / (n.x + r.x) ELSE 0 END, 6) + 0.0 AS ndvi FROM u n JOIN u r ON n.sample_id = r.sample_id AND n.p = r.p AND n.b = 3 AND r.b = 0", "tiles")
def index_maps(spark, sf_dir):
    """TF2"""
    maps = X.index_maps(_tiles(spark, sf_dir), NAMES).select("sample_id", F.filter("maps", lambda m: m["name"] == "ndvi")[0]["px"].alias("px"))
    return maps.select("sample_id", F.posexplode("px").alias("p", "x")).select("sample_id", F.col("p").cast("long").alias("p"), (F.round("x", 6) + F.lit(0.0)).alias("ndvi"))


@register(_UN + "SELECT sample_id, round(avg(x), 9) AS mean, round(quantile_cont(x, 0.1), 9) AS p10, round(quantile_cont(x, 0.75), 9) AS p75 FROM u WHERE b = 1 GROUP BY 1", "tiles")
def map_statistics(spark, sf_dir):
    """TF3"""
    made = X.handmade(X.index_maps(_tiles(spark, sf_dir), NAMES), 1)
    return made.select("sample_id", *(F.round(F.col("features")[9 + k], 9).alias(n) for n, k in (("mean", 0), ("p10", 4), ("p75", 7))))


_MAPS = (*NAMES, "ndvi", "ndwi")


def _slope(axis: str, across: str, part: str) -> str:
    """Central difference of v along an axis, one-sided at the ends, 0 for a single pixel."""
    w = f"PARTITION BY {part}, {across} ORDER BY {axis}"
    n = f"(count(*) OVER ({w} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) - 1)"
    return f"(coalesce(lead(v) OVER ({w}), v) - coalesce(lag(v) OVER ({w}), v)) / greatest({n}, 1)"


def _handmade_sql() -> str:
    key, stats = "sample_id, m", ("mean", "std", "min", "max", "p10", "p25", "p50", "p75", "p90")
    slopes = lambda part: f"{_slope('x', 'y', part)} AS gx, {_slope('y', 'x', part)} AS gy"
    rows = lambda table, names, prefix="", suffix="''": f"SELECT {key}, unnest([{', '.join(repr(prefix + n) for n in names)}]) || {suffix} AS name, unnest([{', '.join(names)}]::DOUBLE[]) AS value FROM {table}"
    entropy = lambda p, n: f"-sum({p} * ln(greatest({p}, 1e-6))) / ln({n})"
    return f"""WITH u AS (SELECT sample_id, CAST(i // 16 AS INTEGER) AS m, (i % 16) // 4 AS y, i % 4 AS x, v FROM (SELECT sample_id, unnest(range(0, 64)) AS i, unnest(px::DOUBLE[]) AS v FROM tiles)),
nd AS (SELECT a.sample_id, a.y, a.x, a.m AS ma, b.m AS mb, CASE WHEN abs(a.v + b.v) > 1e-6 * (abs(a.v) + abs(b.v)) THEN (a.v - b.v) / (a.v + b.v) ELSE 0 END AS v FROM u a JOIN u b ON a.sample_id = b.sample_id AND a.y = b.y AND a.x = b.x),
p AS MATERIALIZED (SELECT {key}, y, x, v FROM u UNION ALL SELECT sample_id, 4, y, x, v FROM nd WHERE ma = 3 AND mb = 0 UNION ALL SELECT sample_id, 5, y, x, v FROM nd WHERE ma = 1 AND mb = 3),
s AS MATERIALIZED (SELECT {key}, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, {', '.join(f'quantile_cont(v, 0.{q}) AS p{q}' for q in (10, 25, 50, 75, 90))} FROM p GROUP BY 1, 2),
c AS (SELECT {key}, k, y // k AS y, x // k AS x, avg(v) AS v FROM p, (VALUES (1), (2), (4)) t(k) GROUP BY ALL),
g AS (SELECT {key}, k, {slopes(key + ', k')} FROM c),
e AS (SELECT *, gx / greatest(top, 1e-6) AS ux, gy / greatest(top, 1e-6) AS uy FROM (SELECT *, sqrt(gx * gx + gy * gy) AS size, max(sqrt(gx * gx + gy * gy)) OVER (PARTITION BY {key}, k) AS top FROM g)),
tx AS (SELECT {key}, k, avg(size) AS gradient_mean, stddev_pop(size) AS gradient_std, sqrt((avg(ux * ux) - avg(uy * uy)) ** 2 + (2 * avg(ux * uy)) ** 2) / greatest(avg(ux * ux) + avg(uy * uy), 1e-6) AS coherence FROM e GROUP BY ALL),
d AS (SELECT {key}, k, sum(sqrt(ux * ux + uy * uy)) AS w FROM (SELECT *, CASE WHEN atan2(uy, ux) < 0 THEN atan2(uy, ux) + pi() WHEN atan2(uy, ux) >= pi() THEN atan2(uy, ux) - pi() ELSE atan2(uy, ux) END AS a FROM e) GROUP BY {key}, k, least(7, floor(a * (8 / pi())))),
en AS (SELECT {key}, k, {entropy('q', 8)} AS orientation_entropy FROM (SELECT {key}, k, w / greatest(sum(w) OVER (PARTITION BY {key}, k), 1e-6) AS q FROM d) GROUP BY ALL),
ring AS (SELECT * FROM (VALUES (-1, -1, 0), (-1, 0, 1), (-1, 1, 2), (0, 1, 3), (1, 1, 4), (1, 0, 5), (1, -1, 6), (0, -1, 7)) t(dy, dx, bit)),
lb AS (SELECT c.sample_id, c.m, CAST(sum(CASE WHEN n.v > c.v THEN 1 << bit ELSE 0 END) AS INTEGER) AS code FROM p c CROSS JOIN ring JOIN p n ON n.sample_id = c.sample_id AND n.m = c.m AND n.y = c.y + dy AND n.x = c.x + dx WHERE c.y IN (1, 2) AND c.x IN (1, 2) GROUP BY c.sample_id, c.m, c.y, c.x),
lu AS (SELECT {key}, avg(CASE WHEN list_sum(list_transform(range(0, 8), lambda k: CAST(((code >> k::INTEGER) & 1) <> ((code >> ((k + 1) % 8)::INTEGER) & 1) AS INTEGER))) <= 2 THEN 1.0 ELSE 0.0 END) AS lbp_uniform FROM lb GROUP BY 1, 2),
le AS (SELECT {key}, {entropy('q', 256)} AS lbp_entropy FROM (SELECT {key}, code, count(*) / 4 AS q FROM lb GROUP BY ALL) GROUP BY 1, 2),
un AS MATERIALIZED (SELECT p.sample_id, p.m, y, x, (v - min) / greatest(max - min, 1e-6) AS v, (p25 - min) / greatest(max - min, 1e-6) AS low, (p75 - min) / greatest(max - min, 1e-6) AS high FROM p JOIN s USING (sample_id, m)),
ug AS (SELECT {key}, y, x, {slopes(key)} FROM un),
bx AS (SELECT c.sample_id, c.m, c.y, c.x, avg(n.gx * n.gx) AS a, avg(n.gy * n.gy) AS b, avg(n.gx * n.gy) AS c FROM ug c JOIN ug n ON n.sample_id = c.sample_id AND n.m = c.m AND abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1 GROUP BY ALL),
re AS MATERIALIZED (SELECT {key}, y, x, greatest(a * b - c * c - 0.04 * (a + b) ** 2, 0) AS r, max(greatest(a * b - c * c - 0.04 * (a + b) ** 2, 0)) OVER (PARTITION BY {key}) AS top FROM bx),
pk AS (SELECT c.sample_id, c.m, c.y, c.x, any_value(c.r) AS r, any_value(c.r) > 0.01 * any_value(c.top) AND any_value(c.r) >= max(n.r) AS peak FROM re c JOIN re n ON n.sample_id = c.sample_id AND n.m = c.m AND abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1 GROUP BY c.sample_id, c.m, c.y, c.x),
co AS (SELECT {key}, avg(CASE WHEN peak THEN 1.0 ELSE 0.0 END) AS corner_density, avg(r) AS corner_strength FROM pk GROUP BY 1, 2),
qu AS (SELECT {key}, CASE y // 2 WHEN 0 THEN 'n' ELSE 's' END || CASE x // 2 WHEN 0 THEN 'w' ELSE 'e' END || '_' AS part, avg(v) AS mean, stddev_pop(v) AS std FROM p GROUP BY ALL),
tl AS (SELECT {key}, y * 2 / 3 - 1 AS y, x * 2 / 3 - 1 AS x, unnest(['low_', 'high_']) AS tail, unnest([greatest(low - v, 0), greatest(v - high, 0)]) AS w FROM un),
mo AS (SELECT {key}, tail, sum(q * x * x) - sum(q * x) ** 2 AS a, sum(q * y * y) - sum(q * y) ** 2 AS b, sum(q * x * y) - sum(q * x) * sum(q * y) AS c FROM (SELECT *, w / greatest(sum(w) OVER (PARTITION BY {key}, tail), 1e-6) AS q FROM tl) GROUP BY 1, 2, 3),
sp AS (SELECT {key}, tail, least(1, sqrt((a - b) ** 2 + (2 * c) ** 2) / greatest(greatest(a, 0) + greatest(b, 0), 1e-6)) AS anisotropy, sqrt(greatest(a, 0) + greatest(b, 0)) AS spread FROM mo),
every AS ({rows('s', stats)} UNION ALL {rows('tx', ('gradient_mean', 'gradient_std', 'coherence'), '', "'_x' || k")} UNION ALL {rows('en', ('orientation_entropy',), '', "'_x' || k")}
UNION ALL {rows('lu', ('lbp_uniform',))} UNION ALL {rows('le', ('lbp_entropy',))} UNION ALL {rows('co', ('corner_density', 'corner_strength'))}
UNION ALL SELECT {key}, part || unnest(['mean', 'std']), unnest([mean, std]) FROM qu UNION ALL SELECT {key}, tail || unnest(['anisotropy', 'spread']), unnest([anisotropy, spread]) FROM sp)
SELECT sample_id, ([{', '.join(map(repr, _MAPS))}])[m + 1] || '_' || name AS feature, round(value, 6) + 0.0 AS value FROM every"""


@register(_handmade_sql(), "tiles")
def handmade_features(spark, sf_dir):
    """TF4, TF5, TF6"""
    names = F.array(*map(F.lit, X.feature_manifest(_MAPS)))
    made = X.handmade(X.index_maps(_tiles(spark, sf_dir), NAMES)).select("sample_id", F.posexplode("features").alias("i", "value"))
    return made.select("sample_id", F.get(names, F.col("i")).alias("feature"), (F.round("value", 6) + F.lit(0.0)).alias("value"))


@register(_UN + "SELECT sample_id, b, CAST(floor(p / 8) * 2 + floor((p % 4) / 2) AS BIGINT) AS p, round(avg(x), 9) + 0.0 AS x FROM u GROUP BY 1, 2, 3", "tiles")
def resize_area(spark, sf_dir):
    """TB9"""
    return _long(X.resize(_tiles(spark, sf_dir), 2, 2, "area"))


@register(_UN + ", q AS (SELECT sample_id, b, quantile_cont(x, 0.02) AS l, quantile_cont(x, 0.98) AS h FROM u GROUP BY 1, 2) SELECT sample_id, b, p, CAST(greatest(0, least(255, floor((x - l) / greatest(h - l, 1e-8) * 255))) AS INTEGER) AS x FROM u JOIN q USING (sample_id, b)", "tiles")
def stretch(spark, sf_dir):
    """TF8"""
    rows = X.stretch(_tiles(spark, sf_dir)).select("sample_id", F.posexplode("bands").alias("b", "band")).select("sample_id", "b", F.posexplode("band").alias("p", "x"))
    return rows.select("sample_id", "b", F.col("p").cast("long").alias("p"), "x")


_HASH = """WITH u AS (SELECT sample_id, i // 8 AS y, i % 8 AS x, v FROM (SELECT sample_id, unnest(range(0, 64)) AS i, unnest(px::DOUBLE[]) AS v FROM tiles)),
w AS (SELECT k, i // 4 AS i, sum(cos(pi() * (2 * i + 1) * k / 64)) AS w FROM range(0, 16) a(k), range(0, 32) b(i) GROUP BY 1, 2),
a AS (SELECT sample_id, k, x, sum(v * w) AS v FROM u JOIN w ON w.i = u.y GROUP BY ALL), r AS (SELECT sample_id, a.k, w.k AS l, sum(v * w) AS v FROM a JOIN w ON w.i = a.x GROUP BY ALL), c AS (SELECT sample_id, k, l, round(v / greatest(max(abs(v)) OVER (PARTITION BY sample_id), 1e-300), 9) AS v FROM r),
b AS (SELECT c.sample_id, k * 16 + l AS i, c.v > m.v AS bit FROM c JOIN (SELECT sample_id, median(v) AS v FROM c GROUP BY 1) m USING (sample_id)),
h AS (SELECT sample_id, i // 4 AS i, CAST(sum(CASE WHEN bit THEN 8 >> (i % 4)::INTEGER ELSE 0 END) AS INTEGER) AS n FROM b GROUP BY 1, 2) SELECT sample_id, string_agg(substr('0123456789abcdef', n + 1, 1), '' ORDER BY i) AS hash FROM h GROUP BY 1"""


@register(_HASH, "tiles")
def perceptual_hashes(spark, sf_dir):
    """TF9"""
    return X.perceptual_hash(_tiles(spark, sf_dir, 1))


_FILTERS = X.random_filters(4, 3, 8)
_WEIGHTS = ", ".join(f"({f}, {k // 9}, {k % 9 // 3}, {k % 3}, {w:.17e})" for f, row in enumerate(_FILTERS) for k, w in enumerate(row))


@register(f"""WITH u AS (SELECT sample_id, CAST(i // 16 AS INTEGER) AS c, (i % 16) // 4 AS y, i % 4 AS x, v FROM (SELECT sample_id, unnest(range(0, 64)) AS i, unnest(px::DOUBLE[]) AS v FROM tiles)), w(f, c, dy, dx, w) AS (VALUES {_WEIGHTS}),
r AS (SELECT sample_id, f, y - dy AS y, x - dx AS x, sum(v * w) - 1 AS r FROM u JOIN w USING (c) WHERE y - dy IN (0, 1) AND x - dx IN (0, 1) GROUP BY ALL),
z AS (SELECT sample_id, f, unnest([0, 8]) AS z, unnest([greatest(r, 0), greatest(-r, 0)]) AS r FROM r), a AS (SELECT sample_id, f + z AS p, avg(r) AS m, stddev_samp(r) AS s, max(r) AS h, min(r) AS l FROM z GROUP BY ALL)
SELECT sample_id, CAST(p + unnest([0, 16, 32, 48]) AS INTEGER) AS place, round(unnest([m, s, h, l]), 6) + 0.0 AS value FROM a""", "tiles")
def convolution_features(spark, sf_dir):
    """TF7"""
    made = X.convolution_features(_tiles(spark, sf_dir), _FILTERS, 3, "all")
    return made.select("sample_id", F.posexplode("features").alias("place", "value")).select("sample_id", "place", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@register(None)
def whitened_convolutions(spark, sf_dir):
    """TF7"""
    tiles = _tiles(spark, sf_dir)
    made = X.convolution_features(tiles, X.whitened_filters(tiles, 3, 32), 3, "stdev")
    return made.select("sample_id", F.posexplode("features").alias("place", "value")).select("sample_id", "place", F.round("value", 6).alias("value"))


@register(_UN + "SELECT sample_id, round(avg(x), 9) + 0.0 AS mean FROM u GROUP BY 1", "tiles")
def batch_model(spark, sf_dir):
    """EN6"""
    made = X.embed(_tiles(spark, sf_dir), lambda x: {"a": x.mean(axis=(1, 2, 3))[:, None]})
    return made.select("sample_id", (F.round(F.col("features")[0], 9) + F.lit(0.0)).alias("mean"))


@register("SELECT sample_id, i, greatest(CAST(floor(abs(x) * 4) AS INTEGER) - 1, 0) AS x FROM (SELECT sample_id, unnest(range(0, 64)) AS i, unnest(px::DOUBLE[]) AS x FROM tiles)", "tiles")
def shift_classes(spark, sf_dir):
    """PF26"""
    rows = view(spark, sf_dir, "tiles").select("sample_id", F.transform("px", lambda x: F.floor(F.abs(x.cast("double")) * 4).cast("int")).alias("m"))
    return rows.select("sample_id", F.posexplode(X.shift_classes("m")).alias("i", "x")).select("sample_id", F.col("i").cast("long").alias("i"), "x")


_RATIO = """, u AS (SELECT split, sample_id, unnest(range(0, 64)) AS i, unnest(features::DOUBLE[]) AS x FROM features), m AS (SELECT split, i, avg(x) AS m, count(*) AS n FROM u GROUP BY 1, 2), z AS MATERIALIZED (SELECT u.split, sample_id, u.i, x - m AS x, n FROM u JOIN m ON u.split = m.split AND u.i = m.i),
c AS (SELECT a.split, a.i, b.i AS j, sum(a.x * b.x) AS v, any_value(a.n) AS n FROM z a JOIN z b ON a.split = b.split AND a.sample_id = b.sample_id GROUP BY ALL),
r AS (SELECT split, sum(v) FILTER (i = j) ** 2 / sum(v * v) AS ratio, least(64, any_value(n) - 1) AS d FROM c GROUP BY 1), s AS (SELECT split, ratio, least(1, greatest(0, 1 - (ratio - 1) / (d - 1))) AS anisotropy FROM r)"""


_TURNS = 504
#: Eigenvalues (split, v) of the covariances of _RATIO by Jacobi's rotations, 32 disjoint ones in each step, eight rounds of all pairs.
_EIGEN = f""", cm AS (SELECT split, list(r ORDER BY i) AS m FROM (SELECT split, i, list(v ORDER BY j) AS r FROM c GROUP BY 1, 2) GROUP BY 1),
jac(k, split, m) AS (SELECT 0, split, m FROM cm UNION ALL
  SELECT k + 1, split, list_transform(b, lambda r: list_transform(r, lambda x, j: cs[j] * x + sn[j] * r[p[j] + 1])) FROM (
    SELECT k, split, p, cs, sn, list_transform(m, lambda r, i: list_transform(r, lambda x, j: cs[i] * x + sn[i] * m[p[i] + 1][j])) AS b FROM (
      SELECT k, split, m, p, list_transform(t, lambda x: 1 / sqrt(1 + x * x)) AS cs, list_transform(t, lambda x, i: x / sqrt(1 + x * x) * CASE WHEN i - 1 < p[i] THEN -1 ELSE 1 END) AS sn FROM (
        SELECT k, split, m, p, list_transform(tau, lambda x: CASE WHEN x IS NULL THEN 0.0 WHEN x >= 0 THEN 1 / (x + sqrt(1 + x * x)) ELSE -1 / (-x + sqrt(1 + x * x)) END) AS t FROM (
          SELECT k, split, m, p, list_transform(p, lambda q, i: (m[greatest(i, q + 1)][greatest(i, q + 1)] - m[least(i, q + 1)][least(i, q + 1)]) / nullif(2 * m[least(i, q + 1)][greatest(i, q + 1)], 0)) AS tau FROM (
            SELECT k, split, m, list_transform(range(0, 64), lambda i: CASE WHEN i = 63 THEN k % 63 WHEN (2 * k - i + 126 * 63) % 63 = i THEN 63 ELSE (2 * k - i + 126 * 63) % 63 END) AS p FROM jac WHERE k < {_TURNS})))))),
ev AS MATERIALIZED (SELECT split, greatest(v, 0) AS v FROM (SELECT split, unnest(list_transform(m, lambda r, i: r[i])) AS v FROM jac WHERE k = {_TURNS})),
sp AS (SELECT split, exp(-sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END)) AS effective_rank, max(q) AS pc1, sum(q) FILTER (o <= 10) AS pc10 FROM (SELECT split, v / sum(v) OVER (PARTITION BY split) AS q, row_number() OVER (PARTITION BY split ORDER BY v DESC) AS o FROM ev) GROUP BY 1),
lp AS (SELECT split, count(*) FILTER (v > 0.05 * top) AS lpca FROM (SELECT split, v, max(v) OVER (PARTITION BY split) AS top FROM ev) GROUP BY 1)"""


@register("WITH RECURSIVE x AS (SELECT 1)" + _RATIO + _EIGEN + " SELECT split, round(effective_rank, 6) AS effective_rank, round(ratio, 6) AS participation_ratio, round(pc1, 6) AS pc1, round(pc10, 6) AS pc10, round(anisotropy, 6) AS anisotropy, lpca FROM s JOIN sp USING (split) JOIN lp USING (split)", "features")
def feature_spectrum(spark, sf_dir):
    """PR15, PR18"""
    rows, out = view(spark, sf_dir, "features"), None
    for s in ("train", "val", "test"):
        own = rows.where(F.col("split") == s)
        part = P.spectrum(own, cap=None).join(P.pca_dimension(own)).select(F.lit(s).alias("split"), *(F.round(m, 6).alias(m) for m in P.SPECTRUM), "lpca")
        out = part if out is None else out.unionByName(part)
    return out


@register("WITH x AS (SELECT 1)" + _RATIO + " SELECT split, round(ratio, 6) AS participation_ratio, round(anisotropy, 6) AS anisotropy FROM s", "features")
def spectrum_ratio(spark, sf_dir):
    """PR15"""
    rows, out = view(spark, sf_dir, "features"), None
    for s in ("train", "val", "test"):
        part = P.spectrum(rows.where(F.col("split") == s), cap=None).select(F.lit(s).alias("split"), F.round("participation_ratio", 6).alias("participation_ratio"), F.round("anisotropy", 6).alias("anisotropy"))
        out = part if out is None else out.unionByName(part)
    return out


_NEAREST = """, f AS (SELECT split, sample_id, features::DOUBLE[] AS x FROM features), nn AS (SELECT a.split, a.sample_id, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.sample_id ORDER BY list_distance(a.x, b.x), b.sample_id) AS k FROM f a JOIN f b ON a.split = b.split AND a.sample_id <> b.sample_id),
t AS (SELECT split, sample_id, ln(max(d) / min(d)) AS x FROM nn WHERE k <= 2 GROUP BY 1, 2 HAVING min(d) > 0), o AS (SELECT split, x, row_number() OVER (PARTITION BY split ORDER BY x, sample_id) AS k, count(*) OVER (PARTITION BY split) AS n FROM t),
two AS (SELECT split, sum(-x * ln(1 - k / n)) / sum(x * x) AS two_nn FROM o WHERE k < n GROUP BY 1),
l AS (SELECT split, sample_id, count(*) AS n, ln(max(d)) AS top, sum(ln(d)) AS s FROM nn WHERE k <= 20 AND d > 0 GROUP BY 1, 2 HAVING count(*) > 2), mle AS (SELECT split, avg((n - 2) / (n * top - s)) AS mle FROM l WHERE n * top > s GROUP BY 1)"""


@register("WITH x AS (SELECT 1)" + _NEAREST + " SELECT split, round(two_nn, 6) AS two_nn FROM two", "features")
def two_nn_dimension(spark, sf_dir):
    """PR16, PR17"""
    rows = view(spark, sf_dir, "features")
    parts = [P.two_nn(rows.where(F.col("split") == s)).select(F.lit(s).alias("split"), F.round("two_nn", 6).alias("two_nn")) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("WITH x AS (SELECT 1)" + _NEAREST + " SELECT split, round(mle, 6) AS mle FROM mle", "features")
def mle_dimension(spark, sf_dir):
    """PR18"""
    rows = view(spark, sf_dir, "features")
    parts = [P.mle_dimension(rows.where(F.col("split") == s)).select(F.lit(s).alias("split"), F.round("mle", 6).alias("mle")) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_METRICS = """, v AS (SELECT split, 'spectrum_participation_ratio_' AS m, ratio AS v FROM s UNION ALL SELECT split, 'spectrum_anisotropy_', anisotropy FROM s UNION ALL SELECT split, 'id_two_nn_', two_nn FROM two UNION ALL SELECT split, 'id_mle_', mle FROM mle
UNION ALL SELECT split, 'spectrum_effective_rank_', effective_rank FROM sp UNION ALL SELECT split, 'spectrum_pc1_', pc1 FROM sp UNION ALL SELECT split, 'spectrum_pc10_', pc10 FROM sp UNION ALL SELECT split, 'id_lpca_', lpca FROM lp),
every AS (SELECT m || split AS metric_name, round(v, 6) AS metric_value FROM v WHERE split <> 'val' UNION ALL SELECT m || 'none', CAST('nan' AS DOUBLE) FROM v WHERE split = 'val')"""
_ALL_METRICS = "WITH RECURSIVE x AS (SELECT 1)" + _RATIO + _EIGEN + _NEAREST + _METRICS


def _diagnosed(spark, sf_dir):
    flat = view(spark, sf_dir, "features").where("split = 'val'").select("sample_id", F.transform("features", lambda x: x * 0 + 1).alias("features"), "label", F.lit("none").alias("split"))
    return view(spark, sf_dir, "features").unionByName(flat), ("train", "test", "none")


@register(_ALL_METRICS + " SELECT * FROM every", "features")
def diagnostic_metrics(spark, sf_dir):
    """PR15, PR16, PR17, PR18, PR19"""
    return P.diagnostic_rows(*_diagnosed(spark, sf_dir)).withColumn("metric_value", F.round("metric_value", 6))


@register(_ALL_METRICS + " SELECT * FROM every WHERE metric_name NOT LIKE '%_none'", "features")
def intrinsic_dimensions(spark, sf_dir):
    """PR16, PR17, PR18, PR19"""
    return P.diagnostic_rows(view(spark, sf_dir, "features"), ("train", "test")).withColumn("metric_value", F.round("metric_value", 6))


@register(_ALL_METRICS + " SELECT * FROM every WHERE metric_name NOT LIKE '%_train' AND metric_name NOT LIKE 'id_%_test' AND metric_name <> 'spectrum_pc1_test'", "features")
def missing_diagnostics(spark, sf_dir):
    """PR19: the metrics that the store lacks"""
    made = P.diagnostic_rows(*_diagnosed(spark, sf_dir))
    have = made.select("metric_name").where("metric_name LIKE '%_train' OR metric_name LIKE 'id_%_test' OR metric_name = 'spectrum_pc1_test'")
    return P.diagnostic_rows(*_diagnosed(spark, sf_dir), stored=have).withColumn("metric_value", F.round("metric_value", 6))


@register(None)
def logistic_probe(spark, sf_dir):
    """PR5, PR7, PR9, SO3"""
    return P.evaluate_logistic(view(spark, sf_dir, "features"))


@register(None)
def logistic_probe_cooled(spark, sf_dir):
    """PR9, PR10: the probe of train alone, with the temperature fitted on val"""
    return P.evaluate_logistic(view(spark, sf_dir, "features"), merge_val=False)


@register(None)
def multilabel_logistic_probe(spark, sf_dir):
    """PR7, PR9: C chosen by micro average precision of label vectors"""
    return P.evaluate_logistic(_two_labels(view(spark, sf_dir, "features")))


@register(None)
def c_sweep(spark, sf_dir):
    """PR8"""
    return P.sweep_report(view(spark, sf_dir, "features"))


@register(None)
def multilabel_c_sweep(spark, sf_dir):
    """PR7, PR8"""
    return P.sweep_report(_two_labels(view(spark, sf_dir, "features")))


def _shortened(spark, sf_dir) -> DataFrame:
    """The feature rows with their first three numbers, of which SQL can fit a probe."""
    return view(spark, sf_dir, "features").withColumn("features", F.slice("features", 1, 3))


def _gauss(matrix: str, n: int, table: str) -> str:
    """Common table expression ``inv`` (m DOUBLE[][]) with the inverse of a positive matrix of n rows, by Gauss and Jordan."""
    step = "list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / m[k + 1][k + 1]) ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)"
    unit = f"list_transform({matrix}, lambda r, i: list_concat(r, list_transform(range(0, {n}), lambda j: CASE WHEN j + 1 = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)))"
    return f"g(k, m) AS (SELECT 0, {unit} FROM {table} UNION ALL SELECT k + 1, {step} FROM g WHERE k < {n}), inv AS (SELECT list_transform(m, lambda r: r[{n + 1}:]) AS m FROM g WHERE k = {n})"


def _probe_sql(classes: int, target: str, ridge: float = 1.0, steps: int = 400) -> str:
    """Multinomial logistic regression (on train and val) by steps with a fixed bound of the second derivatives: ``fit`` has the weights of each class."""
    zero = "[" + ", ".join(["[0.0::DOUBLE, 0.0, 0.0, 0.0]"] * classes) + "]"
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT split, sample_id, label, {target} AS y, [1.0::DOUBLE, features[1], features[2], features[3]] AS z FROM features), tr AS MATERIALIZED (SELECT y, z FROM d WHERE split <> 'test'),
h AS (SELECT i, list(v ORDER BY j) AS r FROM (SELECT i, j, sum(z[i] * z[j]) / 2 + CASE WHEN i = j AND i > 1 THEN {ridge} ELSE 0 END AS v FROM tr, range(1, 5) a(i), range(1, 5) b(j) GROUP BY 1, 2) GROUP BY i), hm AS (SELECT list(r ORDER BY i) AS m FROM h),
{_gauss('m', 4, 'hm')},
w(k, w) AS (SELECT 0, {zero} UNION ALL SELECT k + 1, list(nw ORDER BY c) FROM (
  SELECT k, c, any_value(list_transform(m, lambda r, i: 0.0)) AS unused, list_transform(any_value(m), lambda r, i: any_value(w)[c + 1][i] - list_sum(list_transform(r, lambda v, j: v * (gz[j] + CASE WHEN j > 1 THEN {ridge} * any_value(w)[c + 1][j] ELSE 0 END)))) AS nw FROM (
    SELECT k, c, any_value(w) AS w, any_value(m) AS m, [sum(q * z[1]), sum(q * z[2]), sum(q * z[3]), sum(q * z[4])] AS gz FROM (
      SELECT k, w, m, c, z, e[c + 1] / list_sum(e) - CASE WHEN y = c THEN 1 ELSE 0 END AS q FROM (SELECT k, w, m, y, z, list_transform(w, lambda r: exp(list_inner_product(r, z))) AS e FROM w, inv, tr WHERE k < {steps}), range(0, {classes}) t(c)) GROUP BY k, c)
  GROUP BY k, c, gz) GROUP BY k),
fit AS (SELECT w FROM w WHERE k = {steps})"""


@register(_probe_sql(10, "label") + " SELECT d.split, sample_id, label, CAST(list_position(o, list_max(o)) - 1 AS INTEGER) AS pred FROM (SELECT split, sample_id, label, list_transform(w, lambda r: list_inner_product(r, z)) AS o FROM d, fit WHERE split <> 'val') d", "features")
def probe_predictions(spark, sf_dir):
    """PR5, PR23, SO3"""
    out = P.probe_probabilities(_shortened(spark, sf_dir), 1.0, 500)
    return out.select("split", "sample_id", "label", (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("pred"))


def _fits_sql(name: str, grid: str, rows: str, classes: int = 10, steps: int = 130) -> str:
    """``fit_<name>`` (ci, c, w): the weights of ``_probe_sql`` on some rows of d for every C of a table (ci, c), all in one recursion."""
    zero = "[" + ", ".join(["[0.0::DOUBLE, 0.0, 0.0, 0.0]"] * classes) + "]"
    turn = "list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / m[k + 1][k + 1]) ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)"
    unit = "list_transform(list(r ORDER BY i), lambda r, i: list_concat(r, list_transform(range(0, 4), lambda j: CASE WHEN j + 1 = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)))"
    return f"""tr_{name} AS MATERIALIZED (SELECT y, z FROM d WHERE {rows}),
h_{name} AS (SELECT ci, i, list(v ORDER BY j) AS r FROM (SELECT ci, i, j, sum(z[i] * z[j]) / 2 + CASE WHEN i = j AND i > 1 THEN 1 / c ELSE 0 END AS v FROM tr_{name}, {grid}, range(1, 5) a(i), range(1, 5) b(j) GROUP BY ci, c, i, j) GROUP BY 1, 2),
g_{name}(k, ci, m) AS (SELECT 0, ci, {unit} FROM h_{name} GROUP BY ci UNION ALL SELECT k + 1, ci, {turn} FROM g_{name} WHERE k < 4), inv_{name} AS MATERIALIZED (SELECT ci, c, list_transform(m, lambda r: r[5:]) AS m FROM g_{name} JOIN {grid} USING (ci) WHERE k = 4),
w_{name}(k, ci, w) AS (SELECT 0, ci, {zero} FROM {grid} UNION ALL SELECT k + 1, ci, list(nw ORDER BY cl) FROM (
  SELECT k, ci, cl, list_transform(m, lambda r, i: w[cl + 1][i] - list_sum(list_transform(r, lambda v, j: v * (gz[j] + CASE WHEN j > 1 THEN w[cl + 1][j] / c ELSE 0 END)))) AS nw FROM (
    SELECT k, ci, cl, any_value(w) AS w, [sum(q * z[1]), sum(q * z[2]), sum(q * z[3]), sum(q * z[4])] AS gz FROM (
      SELECT k, ci, w, cl, z, e[cl + 1] / list_sum(e) - CASE WHEN y = cl THEN 1 ELSE 0 END AS q FROM (SELECT k, ci, w, y, z, list_transform(w, lambda r: exp(list_inner_product(r, z))) AS e FROM w_{name}, tr_{name} WHERE k < {steps}), range(0, {classes}) t(cl)) GROUP BY k, ci, cl) JOIN inv_{name} USING (ci))
  GROUP BY k, ci),
fit_{name} AS MATERIALIZED (SELECT ci, c, w FROM w_{name} JOIN {grid} USING (ci) WHERE k = {steps})"""


def _sweep_sql() -> str:
    grid = ", ".join(f"({k}, {c!r}::DOUBLE)" for k, c in enumerate(P.GRID))
    return f"""WITH RECURSIVE gr(ci, c) AS (VALUES {grid}), d AS MATERIALIZED (SELECT split, sample_id, label AS y, [1.0::DOUBLE, features[1], features[2], features[3]] AS z FROM features),
{_fits_sql('one', 'gr', "split = 'train'")},
hit AS MATERIALIZED (SELECT c, split, avg(CASE WHEN list_position(o, list_max(o)) - 1 = y THEN 1.0 ELSE 0.0 END) AS a FROM (SELECT c, split, y, list_transform(w, lambda r: list_inner_product(r, z)) AS o FROM fit_one, d) GROUP BY 1, 2)"""


@register(_sweep_sql() + " SELECT c, log10(c) AS log10_c, max(a) FILTER (split = 'train') AS train_score, max(a) FILTER (split = 'val') AS val_score, max(a) FILTER (split = 'test') AS test_score, CAST(3 AS INTEGER) AS feature_dim, (SELECT count(*) FROM d WHERE split = 'train') AS n_train, (SELECT count(*) FROM d WHERE split = 'val') AS n_val, (SELECT count(*) FROM d WHERE split = 'test') AS n_test FROM hit GROUP BY c", "features")
def c_sweep_short(spark, sf_dir):
    """PR7, PR8: the sweep on the first three features, which SQL can fit for all 40 C"""
    return P.sweep_report(_shortened(spark, sf_dir))


@register(_sweep_sql() + f""", top AS MATERIALIZED (SELECT 0 AS ci, c FROM hit WHERE split = 'val' ORDER BY a DESC, c LIMIT 1),
{_fits_sql('two', 'top', "split <> 'test'")},
o AS (SELECT sample_id, y, list_transform(w, lambda r: exp(list_inner_product(r, z))) AS e FROM fit_two, d WHERE split = 'test'), p AS (SELECT y, list_max(e) / list_sum(e) AS conf, list_position(e, list_max(e)) - 1 = y AS ok FROM o),
a AS (SELECT count(*) AS n, count(*) FILTER (ok) AS h FROM p), {BINOMIAL}, b AS (SELECT floor(conf * 15) AS b, count(*) AS n, avg(conf) AS c, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS acc FROM p GROUP BY 1)
SELECT (SELECT c FROM top) AS best_c, h / n AS metric, (SELECT avg(k / n) FROM dr, a) AS mean, (SELECT quantile_cont(k / n, 0.025) FROM dr, a) AS low, (SELECT quantile_cont(k / n, 0.975) FROM dr, a) AS high, n, round((SELECT sum(n * abs(c - acc)) / sum(n) FROM b), 5) AS ece, round((SELECT sqrt(sum(n * abs(c - acc) ** 2) / sum(n)) FROM b), 5) AS rms, round((SELECT max(abs(c - acc)) FROM b), 5) AS mce FROM a""", "features")
def logistic_probe_short(spark, sf_dir):
    """PR9: C chosen on val, refit, interval and calibration, on the first three features"""
    return P.evaluate_logistic(_shortened(spark, sf_dir)).withColumns({c: F.round(c, 5) for c in ("ece", "rms", "mce")})


@register(None)
def probe_probabilities(spark, sf_dir):
    """PR23"""
    out = P.probe_probabilities(view(spark, sf_dir, "features"), 1.0)
    return out.select("split", "sample_id", "label", F.round(F.array_max("probs"), 6).alias("max_prob"))


@register("""WITH RECURSIVE r AS MATERIALIZED (SELECT label, list_transform(features[1:10], lambda x: x::DOUBLE * 5) AS l FROM features),
t(k, t) AS (SELECT 0, 0.0::DOUBLE UNION ALL SELECT k + 1, t - greatest(-1, least(1, (exp(-t) * avg(g)) / greatest(exp(-2 * t) * avg(h) - exp(-t) * avg(g), 1e-12))) FROM (
  SELECT k, t, l[label + 1] - list_sum(list_transform(l, lambda x, i: x * e[i])) / list_sum(e) AS g, list_sum(list_transform(l, lambda x, i: x * x * e[i])) / list_sum(e) - (list_sum(list_transform(l, lambda x, i: x * e[i])) / list_sum(e)) ** 2 AS h
  FROM (SELECT k, t, label, l, list_transform(l, lambda x: exp((x - list_max(l)) * exp(-t))) AS e FROM t, r WHERE k < 15)) GROUP BY k, t)
SELECT round(exp(t), 6) AS temperature FROM t WHERE k = 15""", "features")
def temperature_scaling(spark, sf_dir):
    """PR10"""
    from probeloom.operators.metrics import temperature

    rows = view(spark, sf_dir, "features").select("label", F.transform(F.slice("features", 1, 10), lambda x: x.cast("double") * 5).alias("logits"))
    return spark.createDataFrame([(round(temperature(rows), 6),)], "temperature double")


def _two_labels(rows: DataFrame) -> DataFrame:
    return rows.withColumn("labels", F.array((F.col("label") > 4).cast("int"), F.col("label") % 2))


@register(_probe_sql(2, "label % 2", 2.0) + " SELECT sample_id, y, CAST(list_inner_product(w[2], z) > list_inner_product(w[1], z) AS INTEGER) AS pred FROM d, fit WHERE split = 'test'", "features")
def multilabel_predictions(spark, sf_dir):
    """PR6"""
    rows = _two_labels(_shortened(spark, sf_dir))  # one weight vector under a ridge is two opposite ones under twice the ridge
    out = P.evaluate_multilabel(rows.where("split <> 'test'"), rows.where("split = 'test'"), 2, 1.0, 500)
    return out.where("place = 1").select("sample_id", "y", (F.col("prob") > 0.5).cast("int").alias("pred"))


@register(None)
def multilabel_probe(spark, sf_dir):
    """PR6"""
    rows = _two_labels(view(spark, sf_dir, "features"))
    out = P.evaluate_multilabel(rows.where("split <> 'test'"), rows.where("split = 'test'"), 2, 1.0)
    return out.select("sample_id", "place", "y", F.round("prob", 6).alias("prob"))
