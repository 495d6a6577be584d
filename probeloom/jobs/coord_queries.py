"""Registered queries over coordinates, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeloom.jobs.fixtures import oracle, view
from probeloom.operators import coords as C
from probeloom.operators import geo as G

QUERIES, ORACLES = {}, {}


def register(sql: str | None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, *views)
        return f

    return add


def _catalog(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.lower("n_name").alias("name"), F.lower("r_name").alias("family"), F.col("n_nationkey").alias("pos"))




@register("WITH c AS (SELECT lower(n_name) AS name, lower(r_name) AS family, n_nationkey AS pos FROM nation JOIN region ON n_regionkey = r_regionkey), w AS (SELECT name, min(i * 1000 + pos) AS o FROM (SELECT name, 0 AS i, pos FROM c WHERE family = (SELECT min(family) FROM c) UNION ALL SELECT name, 1, pos FROM c WHERE pos = 7 UNION ALL SELECT name, 2, pos FROM c WHERE family = (SELECT max(family) FROM c)) GROUP BY 1) SELECT name, CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS place FROM w")
def select_benchmarks(spark, sf_dir):
    """PF9"""
    c = _catalog(spark, sf_dir)
    a, b = c.agg(F.min("family"), F.max("family")).first()
    one = c.where("pos = 7").first().name
    return C.select_benchmarks(c, f"{a}, {one}, {b}, {one}")


@register("WITH b AS (SELECT n_name AS name, n_nationkey % 2 = 0 AS cls, n_nationkey % 3 = 0 AS off FROM nation), s AS (SELECT name, CASE WHEN cls THEN 'classification' ELSE 'regression' END AS task_type, unnest(CASE WHEN cls THEN ['linear', 'knn5'] ELSE ['linear'] END) AS method, off FROM b) SELECT name, task_type, method, unnest(CASE WHEN off THEN ['official'] ELSE ['random', 'spatial'] END) AS split FROM s")
def plan_evaluations(spark, sf_dir):
    """PF25"""
    b = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "classification").otherwise("regression").alias("task_type"), (F.col("n_nationkey") % 3 == 0).alias("has_official"))
    return C.plan_evaluations(b).select("name", "task_type", "method", "split")


@register("SELECT row_id, country, ln(1 + abs(y_num)) AS y FROM points WHERE country IS NOT NULL AND country <> 0 AND year IS NOT NULL", "points")
def without_nodata(spark, sf_dir):
    """PF11, PF12"""
    return C.without_nodata(view(spark, sf_dir, "points"), {"country": 0, "year": None}).select("row_id", "country", F.log1p(F.abs("y_num")).alias("y"))


_TASKS = "WITH t AS (SELECT row_id, 'bal' AS task, y_num AS y FROM points UNION ALL SELECT row_id, 'nation', CAST(country AS DOUBLE) FROM points) "


def _tasks(spark, sf_dir):
    rows = view(spark, sf_dir, "points").select("row_id", F.col("y_num").alias("bal"), F.col("country").cast("double").alias("nation"))
    return C.long_tasks(rows, ("row_id",), ("bal", "nation"))


@register(_TASKS + "SELECT * FROM t", "points")
def long_tasks(spark, sf_dir):
    """PF15"""
    return _tasks(spark, sf_dir)


@register(_TASKS + "SELECT task, CASE WHEN bool_and(abs(y - round(y)) <= 1e-8 + 1e-5 * abs(round(y))) AND count(DISTINCT y) <= 100 THEN 'classification' ELSE 'regression' END AS task_type FROM t GROUP BY 1", "points")
def infer_task_types(spark, sf_dir):
    """PF13"""
    return C.infer_task_types(_tasks(spark, sf_dir))


@register("SELECT row_id, CAST(year(make_timestamp(row_id * 1000000 * 1000000)) AS INTEGER) AS year FROM points", "points")
def epoch_years(spark, sf_dir):
    """PF14"""
    return view(spark, sf_dir, "points").select("row_id", C.year_of(F.col("row_id") * 1_000_000_000).alias("year"))


_DEAL = "SELECT row_id, CAST((row_number() OVER (ORDER BY {}, row_id) - 1) % 5 AS INTEGER) AS fold FROM points"


@register(_DEAL.format("md5(row_id || ':0')"), "points")
def random_folds(spark, sf_dir):
    """W4"""
    return C.random_folds(view(spark, sf_dir, "points"), 5).select("row_id", "fold")


@register(_DEAL.format("1"), "points")
def strided_folds(spark, sf_dir):
    """W5"""
    return C.strided_folds(view(spark, sf_dir, "points"), 5).select("row_id", "fold")


@register("WITH p AS (SELECT row_id, CAST(floor(lat / 10) * 100003 + floor(lon / 10) AS BIGINT) AS cell FROM points), c AS (SELECT cell, CAST((row_number() OVER (ORDER BY md5(cell || ':0')) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT cell FROM p)) SELECT row_id, cell, fold FROM p JOIN c USING (cell)", "points")
def spatial_folds(spark, sf_dir):
    """W6"""
    return C.spatial_folds(view(spark, sf_dir, "points"), 5).select("row_id", "cell", "fold")


_R = "round({}, 9)"


@register("SELECT row_id, round(sin(radians(lat)), 9) + 0.0 AS a, round(cos(radians(lat)), 9) + 0.0 AS b, round(sin(radians(lon)), 9) + 0.0 AS c, round(cos(radians(lon)), 9) + 0.0 AS d, round(sin(radians(lat) * 4), 6) + 0.0 AS f8, round(cos(radians(lon) * 4), 6) + 0.0 AS f11, round(sin((coalesce(year, 2021) - 2021) / 4.0 * 2), 9) + 0.0 AS y2 FROM points", "points")
def location_encoders(spark, sf_dir):
    """EN1, EN2, EN4"""
    rows = view(spark, sf_dir, "points").select("row_id", C.sincos(F.col("lat"), F.col("lon")).alias("s"), C.fourier(F.col("lat"), F.col("lon"), 3).alias("f"), C.year_waves(F.col("year"), 2).alias("y"))
    r = lambda c, d=9: F.round(c, d) + F.lit(0.0)
    return rows.select("row_id", *(r(F.col("s")[i]).alias(n) for i, n in enumerate("abcd")), r(F.col("f")[8], 6).alias("f8"), r(F.col("f")[11], 6).alias("f11"), r(F.col("y")[2]).alias("y2"))


_T = "asin(sqrt(3) / 2 * sin(radians(lat)))"


@register(f"SELECT row_id, round(2 * sqrt(3) * radians(lon) * cos(t) / (3 * (9 * 0.003796 * t ** 8 + 7 * 0.000893 * t ** 6 - 3 * 0.081106 * t ** 2 + 1.340264)), 8) AS x, round(t * (0.003796 * t ** 8 + 0.000893 * t ** 6 - 0.081106 * t ** 2 + 1.340264), 8) AS y FROM (SELECT *, {_T} AS t FROM points)", "points")
def equal_earth(spark, sf_dir):
    """EN3"""
    x, y = C.equal_earth(F.col("lat"), F.col("lon"))
    return view(spark, sf_dir, "points").select("row_id", F.round(x, 8).alias("x"), F.round(y, 8).alias("y"))


@register("SELECT row_id, round(sin(lon) + coalesce(year, 2021), 6) AS a FROM points", "points")
def batch_encoder(spark, sf_dir):
    """EN5"""
    import numpy as np

    out = C.encode(view(spark, sf_dir, "points"), lambda lon, lat, year: np.column_stack([np.sin(lon) + year, lat]), 1)
    return out.select("row_id", F.round(F.col("features")[0], 6).alias("a"))


def _probe(spark, sf_dir):
    rows = C.random_folds(view(spark, sf_dir, "points"), 5)
    return rows.select("row_id", "fold", C.fourier(F.col("lat"), F.col("lon"), 3).alias("features"), F.col("y_num").alias("y"), "y_cls")


#: How points get their fold in SQL, from 0 to 4; -1 is held out of all training.
_RANDOM = "(row_number() OVER (ORDER BY md5(row_id || ':0'), row_id) - 1) % 5"
_SPATIAL = "(dense_rank() OVER (ORDER BY md5(CAST(floor(lat / 10) * 100003 + floor(lon / 10) AS BIGINT) || ':0')) - 1) % 5"
_OFFICIAL = "CASE WHEN country % 4 = 1 THEN -1 ELSE (row_number() OVER (PARTITION BY country % 4 = 1 ORDER BY row_id) - 1) % 5 END"
_Y, _R2 = "[y]", "1 - sum((y - p[1]) ** 2) / (var_pop(y) * count(*))"
_HOT, _HITS = "list_transform(classes, lambda c: CASE WHEN c = y_cls THEN 1.0 ELSE 0.0 END)", "avg(CASE WHEN classes[list_position(p, list_max(p))] = y_cls THEN 1.0 ELSE 0.0 END)"
_FOLDED = """SELECT alpha, round(mean, 6) AS mean, round(std, 6) AS std, alpha IN ({a!r}::DOUBLE, {b!r}::DOUBLE) AS at_edge FROM me ORDER BY round(mean, 12) DESC, alpha LIMIT 1""".format(a=C.ALPHAS[0], b=C.ALPHAS[-1])
_HELD = """SELECT b.alpha, round(score, 6) AS score, b.alpha IN ({a!r}::DOUBLE, {b!r}::DOUBLE) AS at_edge FROM (SELECT alpha FROM me ORDER BY round(mean, 12) DESC, alpha LIMIT 1) b JOIN sc ON sc.alpha = b.alpha AND fold = -1""".format(a=C.ALPHAS[0], b=C.ALPHAS[-1])


def _ridge_sql(targets: str, n_targets: int, score: str, fold: str = _RANDOM, result: str = _FOLDED) -> str:
    """Ridge with each fold held out, for the whole grid: Gauss and Jordan on the twelve Fourier features."""
    waves = ", ".join(f"{f}(radians({x}) * {2**i})" for i in range(3) for x in ("lat", "lon") for f in ("sin", "cos"))
    alphas = ", ".join(f"({a!r}::DOUBLE)" for a in C.ALPHAS)
    step = "list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / m[k + 1][k + 1]) ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)"
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT row_id, y_num AS y, y_cls, {fold} AS fold, [{waves}]::DOUBLE[] AS x FROM points), cl AS (SELECT list(DISTINCT y_cls ORDER BY y_cls) AS classes FROM points),
q AS MATERIALIZED (SELECT row_id, fold, x, y, y_cls, {targets} AS t FROM o, cl), tr AS MATERIALIZED (SELECT f AS out, x, t FROM (SELECT DISTINCT fold AS f FROM o) JOIN q ON q.fold >= 0 AND q.fold <> f),
u AS MATERIALIZED (SELECT out, i, v FROM (SELECT out, unnest(range(1, 13)) AS i, unnest(x) AS v FROM tr)), mo AS MATERIALIZED (SELECT out, i, avg(v) AS m, greatest(stddev_samp(v), 1e-6) AS s FROM u GROUP BY 1, 2),
ml AS (SELECT out, list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM mo GROUP BY 1), mt AS (SELECT out, list(v ORDER BY j) AS mt FROM (SELECT out, j, avg(t[j]) AS v FROM tr, range(1, {n_targets + 1}) a(j) GROUP BY 1, 2) GROUP BY 1),
z AS MATERIALIZED (SELECT out, list_transform(x, lambda v, i: (v - m[i]) / s[i]) AS x, list_transform(t, lambda v, j: v - mt[j]) AS t FROM tr JOIN ml USING (out) JOIN mt USING (out)),
g AS (SELECT out, i, list(v ORDER BY j) AS r FROM (SELECT out, i, j, sum(x[i] * CASE WHEN j <= 12 THEN x[least(j, 12)] ELSE t[greatest(j - 12, 1)] END) AS v FROM z, range(1, 13) a(i), range(1, {13 + n_targets}) b(j) GROUP BY ALL) GROUP BY 1, 2),
gm AS MATERIALIZED (SELECT out, list(r ORDER BY i) AS m FROM g GROUP BY 1), al(alpha) AS (VALUES {alphas}),
gj(k, out, alpha, m) AS (SELECT 0, out, alpha, list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = j THEN v + alpha ELSE v END)) FROM gm, al UNION ALL SELECT k + 1, out, alpha, {step} FROM gj WHERE k < 12),
w AS MATERIALIZED (SELECT out, alpha, list_transform(range(0, {n_targets}), lambda j: list_transform(gj.m, lambda r: r[13 + j])) AS w FROM gj WHERE k = 12),
p AS (SELECT q.fold, alpha, y, y_cls, list_transform(w, lambda c, j: mt[j] + list_inner_product(c, list_transform(x, lambda v, i: (v - ml.m[i]) / ml.s[i]))) AS p FROM q JOIN w ON w.out = q.fold JOIN ml ON ml.out = q.fold JOIN mt ON mt.out = q.fold),
sc AS (SELECT fold, alpha, {score} AS score FROM p, cl GROUP BY fold, alpha), me AS (SELECT alpha, avg(score) AS mean, stddev_pop(score) AS std FROM sc WHERE fold >= 0 GROUP BY 1)
{result}"""


def _best(scores, name):
    return C.best_alpha(scores, name).select("alpha", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "at_edge")


@register(_ridge_sql(_Y, 1, _R2), "points")
def ridge_regression(spark, sf_dir):
    """PR11, PR13"""
    return _best(C.ridge_r2(_probe(spark, sf_dir)), "r2")


@register(_ridge_sql(_HOT, 5, _HITS), "points")
def ridge_classification(spark, sf_dir):
    """PR12, PR13"""
    rows = _probe(spark, sf_dir)
    classes = sorted(r.y_cls for r in rows.select("y_cls").distinct().collect())
    return _best(C.ridge_accuracy(rows, classes), "accuracy")


def _official(spark, sf_dir):
    rows = C.nested_folds(view(spark, sf_dir, "points").withColumn("is_test", F.col("country") % 4 == 1), 5)
    return rows.select("row_id", "fold", C.fourier(F.col("lat"), F.col("lon"), 3).alias("features"), F.col("y_num").alias("y"), "y_cls")


@register(_ridge_sql(_Y, 1, _R2, _OFFICIAL, _HELD), "points")
def official_regression(spark, sf_dir):
    """PR13: the penalty is chosen on folds of the pool, and the held-out rows are scored once"""
    return C.official_score(C.ridge_r2(_official(spark, sf_dir)), "r2").withColumn("score", F.round("score", 6))


@register(_ridge_sql(_HOT, 5, _HITS, _OFFICIAL, _HELD), "points")
def official_classification(spark, sf_dir):
    """PR13"""
    rows = _official(spark, sf_dir)
    classes = sorted(r.y_cls for r in rows.select("y_cls").distinct().collect())
    return C.official_score(C.ridge_accuracy(rows, classes), "accuracy").withColumn("score", F.round("score", 6))


def _knn_sql(fold: str, result: str) -> str:
    """Five neighbours on features scaled by each fold's training rows."""
    waves = ", ".join(f"{f}(radians({x}) * {2**i})" for i in range(3) for x in ("lat", "lon") for f in ("sin", "cos"))
    return f"""WITH o AS MATERIALIZED (SELECT row_id, y_cls, {fold} AS fold, [{waves}]::DOUBLE[] AS x FROM points), cl AS (SELECT list(DISTINCT y_cls ORDER BY y_cls) AS classes FROM points), fs AS (SELECT DISTINCT fold AS f FROM o WHERE {'fold = -1' if result.startswith('-') else 'true'}),
u AS (SELECT f, i, avg(v) AS m, stddev_pop(v) AS s FROM (SELECT f, unnest(range(1, 13)) AS i, unnest(x) AS v FROM fs JOIN o ON fold >= 0 AND fold <> f) GROUP BY 1, 2), l AS (SELECT f, list(m ORDER BY i) AS m, list(CASE WHEN s > 0 THEN s ELSE 1 END ORDER BY i) AS s FROM u GROUP BY 1),
z AS MATERIALIZED (SELECT f, fold, row_id, list_position(classes, y_cls) AS c, list_transform(x, lambda v, i: (v - m[i]) / s[i]) AS x FROM l, o, cl),
n AS (SELECT q.f, q.row_id, q.c, t.c AS tc, row_number() OVER (PARTITION BY q.f, q.row_id ORDER BY list_distance(q.x, t.x), t.row_id) AS k FROM z q JOIN z t ON q.f = t.f AND q.fold = q.f AND t.fold <> t.f AND t.fold >= 0),
v AS (SELECT f, row_id, c, tc, count(*) AS v FROM n WHERE k <= 5 GROUP BY ALL), p AS (SELECT f, arg_max(tc, v * 1000 - tc) AS p, any_value(c) AS c FROM v GROUP BY f, row_id), sc AS (SELECT f, avg(CASE WHEN p = c THEN 1.0 ELSE 0.0 END) AS a FROM p GROUP BY 1)
SELECT avg(a) AS mean, stddev_pop(a) AS std FROM sc"""


def _run_sql() -> str:
    """All evaluations of ``coordinate_run``."""
    out = []
    for dataset, task, kind, folds in (("customers", "balance", "regression", ("random", "spatial")), ("customers", "segment", "classification", ("random", "spatial")), ("held", "balance", "regression", ("official",)), ("held", "segment", "classification", ("official",))):
        for split in folds:
            fold = {"random": _RANDOM, "spatial": _SPATIAL, "official": _OFFICIAL}[split]
            held = split == "official"
            end = "SELECT score AS mean, 0.0 AS std FROM (SELECT alpha FROM me ORDER BY round(mean, 12) DESC, alpha LIMIT 1) b JOIN sc ON sc.alpha = b.alpha AND fold = -1" if held else "SELECT mean, std FROM me ORDER BY round(mean, 12) DESC, alpha LIMIT 1"
            made = [("linear", _ridge_sql(*((_Y, 1, _R2) if kind == "regression" else (_HOT, 5, _HITS)), fold, end))]
            if kind == "classification":
                made.append(("knn5", _knn_sql(fold, "-1" if held else "all")))
            n_test = "(SELECT count(*) FILTER (country % 4 = 1) FROM points)" if held else "(SELECT count(*) FROM points)"
            for method, sql in made:
                out.append(f"SELECT '{dataset}' AS dataset, '{task}' AS task, '{kind}' AS task_type, '{method}' AS method, 'fourier3' AS model, '{split}' AS split, '{'r2' if kind == 'regression' else 'accuracy'}' AS metric_name, round(mean, 6) AS metric_value, round(mean - std, 6) AS ci_lower, round(mean + std, 6) AS ci_upper, CAST({1 if held else 5} AS INTEGER) AS n_folds, CAST(10 AS DOUBLE) AS cell_deg, CAST(12 AS INTEGER) AS feature_dim, (SELECT count(*) FROM points) AS n_samples, {n_test} AS n_test, CAST(0 AS INTEGER) AS seed FROM ({sql})")
    return "WITH all_runs AS (" + " UNION ALL ".join(out) + ") SELECT * FROM all_runs"


_DIRTY = "SELECT row_id, CASE WHEN row_id % 5 = 0 THEN NULL WHEN row_id % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE y_num END AS y, CASE WHEN row_id % 3 = 0 THEN NULL ELSE y_cls END AS c, [CASE WHEN row_id % 11 = 0 THEN CAST('inf' AS DOUBLE) ELSE lon END, CASE WHEN row_id % 13 = 0 THEN NULL ELSE lat END] AS x FROM points"


@register(f"SELECT row_id, row_id % 11 <> 0 AND row_id % 13 <> 0 AND row_id % 5 <> 0 AND row_id % 7 <> 0 AS for_regression, row_id % 11 <> 0 AND row_id % 13 <> 0 AND row_id % 3 <> 0 AS for_classes FROM ({_DIRTY})", "points")
def valid_rows(spark, sf_dir):
    """PF17"""
    k = F.col("row_id")
    rows = view(spark, sf_dir, "points").select(
        "row_id", F.when(k % 5 == 0, None).when(k % 7 == 0, float("nan")).otherwise(F.col("y_num")).alias("y"), F.when(k % 3 != 0, F.col("y_cls")).alias("c"),
        F.array(F.when(k % 11 == 0, float("inf")).otherwise(F.col("lon")), F.when(k % 13 != 0, F.col("lat"))).alias("x"),
    )
    return rows.select("row_id", C.valid(F.col("y"), F.col("x"), False).alias("for_regression"), C.valid(F.col("c"), F.col("x"), True).alias("for_classes"))


@register("SELECT row_id, lon, lat, y_num AS air, country * 1.0 AS fallback FROM points", "points")
def discovered_columns(spark, sf_dir):
    """PF10"""
    table = view(spark, sf_dir, "points").select("row_id", F.col("country").alias("Price"), F.col("y_num").alias("MeanTemp"), F.col("lat").alias("LAT"), F.col("lon").alias("Longitude"), F.col("y_cls").alias("temp_name"))
    lon, lat = C.lonlat_columns(table.columns)
    air, fallback = C.label_column(table.schema, "temp", ("row_id",)), C.label_column(table.drop("MeanTemp").schema, "snow", ("row_id",))
    return table.select("row_id", F.col(lon).alias("lon"), F.col(lat).alias("lat"), F.col(air).alias("air"), F.col(fallback).cast("double").alias("fallback"))


@register("SELECT 'points' AS config, row_id, lon, lat, y_num FROM points UNION ALL SELECT 'north', row_id, lon, lat, y_num FROM points WHERE lat > 0", "points")
def coordinate_configs(spark, sf_dir):
    """IO5"""
    from probeloom.sources.place import shared_folder

    root, rows, out = shared_folder(spark, "configs"), view(spark, sf_dir, "points").select("row_id", "lon", "lat", "y_num"), None
    for name, part in (("points", rows), ("north", rows.where("lat > 0"))):
        part.write.parquet(f"{root}/{name}")
        read = C.load_config(spark, root, name).select(F.lit(name).alias("config"), "row_id", "lon", "lat", "y_num")
        out = read if out is None else out.unionByName(read)
    return out


@register("WITH f AS (SELECT source AS class, doc_id || '.jpg' AS name FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5(name || ':0'), name) AS k, count(*) OVER (PARTITION BY class) AS n FROM f) SELECT class, name, CASE WHEN k <= round_even(n * 0.6, 0) THEN 'train' WHEN k <= round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'val' ELSE 'test' END AS split FROM k")
def stratified_split(spark, sf_dir):
    """W7"""
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("class"), F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("name"))
    return C.stratified_split(files)


@register("SELECT sample_id FROM features ORDER BY md5(sample_id || ':0'), sample_id LIMIT 100", "features")
def subsample(spark, sf_dir):
    """W8"""
    return C.subsample(view(spark, sf_dir, "features"), 100).select("sample_id")


@register("SELECT unnest(['official', 'regression', 'classification']) AS kind, unnest([count(*) FILTER (country = 3), count(*) FILTER (row_id % 6 <> 0), count(*)]) AS n FROM points", "points")
def test_sample_count(spark, sf_dir):
    """AG34"""
    gap = F.when(F.col("row_id") % 6 == 0, F.when(F.col("row_id") % 12 == 0, float("nan"))).otherwise(F.col("y_num"))
    rows = view(spark, sf_dir, "points").withColumn("y_num", gap).withColumn("is_test", F.col("country") == 3)
    parts = [C.test_sample_count(rows, task, official).select(F.lit(kind).alias("kind"), "n") for kind, task, official in (("official", "regression", True), ("regression", "regression", False), ("classification", "classification", False))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("SELECT CAST(floor((lon + 180) / 0.25) AS INTEGER) AS x, CAST(floor((lat + 90) / 0.25) AS INTEGER) AS y, count(*) AS n FROM points GROUP BY 1, 2", "points")
def density_bins(spark, sf_dir):
    """AG28"""
    return G.density_bins(view(spark, sf_dir, "points"))


@register("SELECT round(min(lon), 3) AS west, round(min(lat), 3) AS south, round(max(lon), 3) AS east, round(max(lat), 3) AS north, count(*) AS n FROM points", "points")
def point_bounds(spark, sf_dir):
    """AG28"""
    return G.bounds(view(spark, sf_dir, "points"))


_POLYGONS = [("A", [[-170.0, -60.0], [-20.0, -60.0], [-20.0, 70.0], [-170.0, 70.0]]), ("B", [[-30.0, -40.0], [60.0, -40.0], [15.0, 80.0]]), ("C", [[70.0, -10.0], [150.0, -10.0], [150.0, 60.0], [70.0, 60.0]])]
_WHERE = "CASE WHEN lon >= -170 AND lon < -20 AND lat >= -60 AND lat < 70 THEN 'A' WHEN lat >= -40 AND lat < 80 AND lon >= -30 + 45 * (lat + 40) / 120 AND lon < 60 - 45 * (lat + 40) / 120 THEN 'B' WHEN lon >= 70 AND lon < 150 AND lat >= -10 AND lat < 60 THEN 'C' ELSE 'Ocean / unmatched' END AS continent"


def _placed(spark, sf_dir):
    return G.attribute_polygons(view(spark, sf_dir, "points"), spark.createDataFrame(_POLYGONS, "name string, ring array<array<double>>"))


@register(f"SELECT row_id, {_WHERE} FROM points", "points")
def polygon_join(spark, sf_dir):
    """J13"""
    return _placed(spark, sf_dir).select("row_id", "continent")


@register(f"SELECT row_id, {_WHERE} FROM points", "points")
def polygon_join_by_cell(spark, sf_dir):
    """J13: the way for more corners than are shipped"""
    polygons = spark.createDataFrame(_POLYGONS, "name string, ring array<array<double>>")
    return G.attribute_polygons(view(spark, sf_dir, "points"), polygons, shipped=0).select("row_id", "continent")


@register(f"SELECT continent, count(*) AS n, round_even(100 * count(*) / sum(count(*)) OVER (), 2) AS share, CAST(row_number() OVER (ORDER BY count(*) DESC, continent) AS INTEGER) AS place FROM (SELECT {_WHERE} FROM points) GROUP BY 1", "points")
def continent_shares(spark, sf_dir):
    """AG28"""
    return G.continent_shares(_placed(spark, sf_dir))


@register(f"WITH p AS (SELECT country, {_WHERE} FROM points), s AS (SELECT country, continent, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY country) AS share, sum(count(*)) OVER (PARTITION BY country) AS n FROM p GROUP BY 1, 2), t AS (SELECT continent, sum(share * n / 100) AS samples FROM s GROUP BY 1) SELECT continent, round_even(samples, 6) AS samples, round_even(100 * samples / sum(samples) OVER (), 2) AS share FROM t", "points")
def geography_index(spark, sf_dir):
    """AG29"""
    each = _placed(spark, sf_dir).groupBy("country", "continent").agg(F.count("*").alias("c"))
    total = each.groupBy("country").agg(F.sum("c").alias("n"))
    records = each.join(total, "country").groupBy("country", "n").agg(F.map_from_entries(F.collect_list(F.struct("continent", (F.col("c") * 100.0 / F.col("n")).alias("share")))).alias("continents"))
    return G.weighted_index(records)


@register("WITH o AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS i, count(*) OVER () AS n FROM points) SELECT row_id, round(lon, 3) AS lon, round(lat, 3) AS lat FROM o WHERE n <= 50 OR i IN (SELECT k * (n - 1) // 49 FROM range(0, 50) t(k))", "points")
def thinned_points(spark, sf_dir):
    """W10"""
    return G.thin(view(spark, sf_dir, "points"), 50)


@register(_run_sql(), "points")
def coordinate_run(spark, sf_dir):
    """PR14, PR4: benchmarks with folds of their own and with an official split"""
    from probeloom.jobs.coordinate_run import run

    points = view(spark, sf_dir, "points").select("row_id", "lon", "lat", "year", F.col("y_num").alias("y"), "y_cls", (F.col("country") % 4 == 1).alias("is_test"))
    tasks = [(name, task, kind, name == "held") for name in ("customers", "held") for task, kind in (("balance", "regression"), ("segment", "classification"))]
    benchmarks = spark.createDataFrame(tasks, "name string, task string, task_type string, has_official boolean")
    out = run(benchmarks, lambda name, task: points, C.fourier(F.col("lat"), F.col("lon"), 3), "fourier3")
    return out.withColumns({c: F.round(c, 6) for c in ("metric_value", "ci_lower", "ci_upper")})


@register("SELECT sample_id, split = 'test' AS is_test FROM features", "features")
def official_split(spark, sf_dir):
    """PF16"""
    return C.official_split(view(spark, sf_dir, "features")).select("sample_id", "is_test")
