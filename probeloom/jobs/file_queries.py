"""Registered queries over logs, metadata, shards and records, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeloom.jobs.fixtures import oracle, view
from probeloom.operators import geo as G
from probeloom.sources import shards as H
from probeloom.sources import store as S
from probeloom.sources.place import shared_folder

QUERIES, ORACLES = {}, {}


def register(sql: str | None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, *views)
        return f

    return add


@register("SELECT doc_id AS row_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 AS INTEGER) AS shard FROM documents")
def plan_shards(spark, sf_dir):
    """IO8"""
    return H.plan_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("row_id")), 100)


@register("SELECT doc_id, doc_id % 5 = 0 AS missing FROM (SELECT doc_id FROM documents ORDER BY md5(doc_id || ':0'), doc_id LIMIT 50) WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def differing_copies(spark, sf_dir):
    """IO9"""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copy = docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return H.differing(docs, copy, "doc_id", "text")


@register("SELECT doc_id || '.txt' AS name, sha256(text || CASE WHEN doc_id % 9 = 0 THEN '!' ELSE '' END) AS expected, CASE WHEN doc_id % 11 <> 0 THEN sha256(text) END AS actual FROM documents WHERE doc_id % 9 = 0 OR doc_id % 11 = 0")
def mismatched_files(spark, sf_dir):
    """IO11"""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("name", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    manifest = docs.select("name", F.sha2(F.concat("text", F.when(F.col("doc_id") % 9 == 0, "!").otherwise("")), 256).alias("expected"))
    return S.mismatched_files(docs.where("doc_id % 11 <> 0").select("name", F.col("text").alias("content")), manifest)


_LOGS = "WITH l AS (SELECT concat('log_', CAST(user_id AS STRING)) AS log, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, round(value, 2) AS value FROM events)"


def _curves(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    line = F.format_string("12:00 INFO Epoch %d done, loss: 0.5, val_miou: %s\nother", n, F.round("value", 2).cast("string"))
    logs = rows.select("user_id", "event_id", line.alias("line")).groupBy(F.concat(F.lit("log_"), F.col("user_id").cast("string")).alias("log")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("text"))
    root = shared_folder(spark, "logs")
    S.write_texts(logs.select(F.concat("log", F.lit(".log")).alias("name"), "text"), root).count()
    return S.epoch_metrics(S.read_logs(spark, root), "val_miou")


@register(_LOGS + " SELECT log, CAST(epoch AS INTEGER) AS epoch, value FROM l")
def log_curves(spark, sf_dir):
    """IO13"""
    return _curves(spark, sf_dir)


@register(_LOGS + " SELECT log, count(*) = 10 AS complete, CAST(arg_min(epoch, (-value, epoch)) AS INTEGER) AS best_epoch, max(value) AS best, arg_max(value, epoch) AS last FROM l GROUP BY 1")
def curve_summary(spark, sf_dir):
    """AG27"""
    return S.curve_summary(_curves(spark, sf_dir), 10)


@register("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'label' WHEN event_id % 5 = 0 THEN 'bands_order' END AS error, CASE WHEN event_id % 4 <> 0 THEN CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS DOUBLE) END AS label FROM events""")
def decode_metadata(spark, sf_dir):
    """PF21, IO12"""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    label = F.when(F.col("event_id") % 4 == 0, F.lit('"none"')).when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), k, F.lit("]"))).otherwise(k)
    bands = F.when((F.col("event_id") % 5 == 0) & (F.col("event_id") % 4 != 0), F.lit('["red",""]')).otherwise(F.lit('["red","nir"]'))
    meta = rows.withColumn("meta", F.concat(F.lit('{"bands_order":'), bands, F.lit(',"label":'), label, F.lit("}")))
    return S.decode_metadata(meta).select("event_id", "error", F.get("labels", F.lit(0)).alias("label"))


@register("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS x, CASE WHEN event_id % 3 <> 0 THEN value + 1 END AS y, CASE WHEN event_id % 3 <> 0 THEN 'EPSG:4326' END AS crs FROM events")
def raster_origins(spark, sf_dir):
    """PF22"""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    v, z = F.col("value"), F.lit(0.0)
    entry = lambda t, c: F.struct(t.alias("transform"), c.alias("crs"))
    entries = F.array(entry(F.array(z, z), F.lit("EPSG:1")), entry(F.array(z, z, v, z, z, v + 1), F.when(F.col("event_id") % 3 != 0, "EPSG:4326")))
    o = G.raster_origin(entries)
    return rows.select("event_id", o["x"].alias("x"), o["y"].alias("y"), o["crs"].alias("crs"))


@register("SELECT event_id FROM events WHERE event_id % 200 <> 0")
def tolerated_reads(spark, sf_dir):
    """PF23"""
    return G.tolerate(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 200 == 0).alias("failed")), "failed")


def _utm_sql() -> str:
    """Longitude and latitude of x and y in UTM zone 32 north, by the series of Krueger to third order in the third flattening."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    number = lambda x: f"{x:.17e}"
    waves = lambda outer, inner: " ".join(f"- {number(b)} * {outer}({2 * k} * xi) * {inner}({2 * k} * eta)" for k, b in enumerate(beta, 1))
    chi = " ".join(f"+ {number(d)} * sin({2 * k} * chi)" for k, d in enumerate(delta, 1))
    return f"""u AS (SELECT sample_id, y / {number(0.9996 * radius)} AS xi, (x - 500000) / {number(0.9996 * radius)} AS eta FROM o WHERE crs = 'EPSG:32632'),
v AS (SELECT sample_id, xi {waves('sin', 'cosh')} AS x, eta {waves('cos', 'sinh')} AS y FROM u), w AS (SELECT sample_id, 9 + degrees(atan2(sinh(y), cos(x))) AS lon, asin(sin(x) / cosh(y)) AS chi FROM v), l AS (SELECT sample_id, lon, degrees(chi {chi}) AS lat FROM w)"""


@register(f"""WITH o AS (SELECT row_id AS sample_id, CASE WHEN row_id % 2 = 0 THEN 3e5 + row_id * 100 ELSE lon END AS x, CASE WHEN row_id % 2 = 0 THEN 5e6 + row_id * 100 ELSE lat END AS y, CASE WHEN row_id % 2 = 0 THEN 'EPSG:32632' WHEN row_id % 5 = 0 THEN 'EPSG:3035' ELSE 'EPSG:4326' END AS crs FROM points),
{_utm_sql()}, e AS (SELECT sample_id, lon, lat FROM l UNION ALL SELECT sample_id, x, y FROM o WHERE crs = 'EPSG:4326') SELECT sample_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM e WHERE abs(lon) <= 180 AND abs(lat) <= 90""", "points")
def reprojected_origins(spark, sf_dir):
    """TF10"""
    p = view(spark, sf_dir, "points")
    utm = F.col("row_id") % 2 == 0
    rows = p.select(F.col("row_id").alias("sample_id"), F.when(utm, 3e5 + F.col("row_id") * 100).otherwise(F.col("lon")).alias("x"), F.when(utm, 5e6 + F.col("row_id") * 100).otherwise(F.col("lat")).alias("y"), F.when(utm, "EPSG:32632").when(F.col("row_id") % 5 == 0, "EPSG:3035").otherwise("EPSG:4326").alias("crs"))
    out = G.to_lonlat(rows)
    return out.select("sample_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@register("SELECT snapshot, CAST(row_number() OVER (ORDER BY d = '', d DESC, snapshot) AS INTEGER) AS place FROM (SELECT DISTINCT snapshot, regexp_extract(snapshot, '\\d{4}-\\d{2}-\\d{2}') AS d FROM (SELECT CASE WHEN event_id % 50 = 0 THEN event_type ELSE 'run-' || strftime(ts, '%Y-%m-%d') END AS snapshot FROM events))")
def snapshot_order(spark, sf_dir):
    """W13, SO2"""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return S.snapshot_order(rows.select(F.when(F.col("event_id") % 50 == 0, F.col("event_type")).otherwise(F.concat(F.lit("run-"), F.date_format("ts", "yyyy-MM-dd"))).alias("snapshot")))


@register("SELECT DISTINCT source AS name FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE doc_id % 97 = 0)")
def missing_records(spark, sf_dir):
    """IO16, SO4"""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("name"), "doc_id")
    return S.missing_records(docs.select("name").distinct(), docs.where("doc_id % 97 = 0"))


@register("SELECT doc_id FROM documents WHERE doc_id % 3 = 1 AND doc_id % 2 = 0")
def select_split(spark, sf_dir):
    """J4, J5, IO10"""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("sample_id"))
    parts = docs.select(F.when(F.col("sample_id") % 2 == 0, "half").otherwise("default").alias("part"), F.when(F.col("sample_id") % 3 == 1, "train").otherwise("test").alias("split"), "sample_id")
    return S.select_split(docs, parts, "train", "half").withColumnRenamed("sample_id", "doc_id")


@register("SELECT CASE WHEN doc_id % 2 = 0 THEN 'half' ELSE 'default' END AS part, CASE WHEN doc_id % 3 = 1 THEN 'train' ELSE 'test' END AS split, CAST(doc_id AS VARCHAR) AS sample_id FROM documents")
def partition_files(spark, sf_dir):
    """IO10: samples by part and split, from one JSON file for each part"""
    root = shared_folder(spark, "partitions")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    parts = docs.select(F.when(F.col("doc_id") % 2 == 0, "half").otherwise("default").alias("part"), F.when(F.col("doc_id") % 3 == 1, "train").otherwise("test").alias("split"), F.col("doc_id").cast("string").alias("id"))
    splits = parts.groupBy("part", "split").agg(F.collect_list("id").alias("ids")).groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("split", "ids")))).alias("text"))  # a file holds its part
    S.write_texts(splits.select(F.concat("part", F.lit("_partition.json")).alias("name"), "text"), root).count()
    return S.read_partitions(spark, root)


@register("SELECT append_seq::VARCHAR AS append_seq, name, CASE WHEN name < 'm3' THEN dataset END AS dataset, CASE WHEN name >= 'm3' THEN method END AS method, seed::VARCHAR AS seed FROM results WHERE name <> 'm6'", "results")
def load_results(spark, sf_dir):
    """IO1"""
    root, rows = shared_folder(spark, "results"), view(spark, sf_dir, "results")
    for part, columns in (("name < 'm3'", ("name", "dataset", "seed", "append_seq")), ("name >= 'm3' AND name <> 'm6'", ("append_seq", "name", "method", "seed"))):
        rows.where(part).select(*columns).write.mode("append").option("header", True).csv(root)
    return S.load_results(spark, root).select("append_seq", "name", "dataset", "method", "seed")


@register("SELECT append_seq, name, CASE WHEN seed = 0 THEN NULL ELSE metric_value END AS metric_value, CASE WHEN seed = 2 THEN NULL ELSE dataset END AS dataset FROM results", "results")
def append_with_drift(spark, sf_dir):
    """IO2"""
    path, rows = shared_folder(spark, "appended"), view(spark, sf_dir, "results")
    S.append_version(rows.where("seed = 0").select("append_seq", "name", "dataset"), path)
    S.append_version(rows.where("seed = 1").select("metric_value", "name", "append_seq", "dataset"), path)
    S.append_version(rows.where("seed = 2").select("append_seq", "metric_value", "name"), path)
    S.append_version(rows.where("seed = 7").select("append_seq"), path)
    return S.read_version(spark, path).select("append_seq", "name", "metric_value", "dataset")


@register("SELECT CASE method WHEN 'knn5' THEN 'profiles' ELSE 'models' END AS kind, name || '_' || dataset AS name_safe, count(*) AS n, round(sum(metric_value), 6) AS total FROM results GROUP BY 1, 2", "results")
def routed_rows(spark, sf_dir):
    """IO3"""
    root = shared_folder(spark, "routed")
    method = F.when(F.col("method") == "knn5", "profile").otherwise(F.col("method"))
    S.route_rows(view(spark, sf_dir, "results").select(method.alias("method"), F.concat("name", F.lit("/"), "dataset").alias("name"), "metric_value"), root)
    return spark.read.parquet(root).groupBy("kind", "name_safe").agg(F.count("*").alias("n"), F.round(F.sum("metric_value"), 6).alias("total"))


def _sharded(spark, sf_dir):
    """Tiles of four bands of 4 x 4 pixels with metadata, in tar shards of 100 samples; the folder."""
    root = shared_folder(spark, "shards")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "label", "embedding")
    bands = F.array(*(F.slice("embedding", 16 * k + 1, 16) for k in range(4)))
    meta = F.to_json(F.struct(F.array(F.lit("red"), F.lit("nir")).alias("bands_order"), "label"))
    planned = H.plan_shards(rows, 100).select(F.format_string("s.%06d", "row_id").alias("sample_id"), "shard", F.lit(4).alias("height"), F.lit(4).alias("width"), F.array(*map(F.lit, ("red", "green", "blue", "nir_08"))).alias("names"), bands.alias("bands"), meta.alias("meta"))
    S.append_version(H.write_tars(planned, root), f"{root}/_written")
    return root


@register("SELECT printf('s.%06d', vec_id) AS sample_id, label, CAST(embedding[16] AS DOUBLE) AS red_last, CAST(embedding[49] AS DOUBLE) AS nir_first FROM embeddings")
def shard_samples(spark, sf_dir):
    """IO6"""
    rows = H.read_samples(spark, _sharded(spark, sf_dir))
    pixel = lambda name, k: F.get(F.get("bands", H.find_band("names", name)), F.lit(k))
    return rows.select("sample_id", F.get_json_object("meta", "$.label").cast("int").alias("label"), pixel("red", 15).alias("red_last"), pixel("nir", 0).alias("nir_first"))


@register("SELECT printf('s.%06d', vec_id) AS sample_id, printf('shard-%06d.tar', (row_number() OVER (ORDER BY vec_id) - 1) // 100) AS shard, length('{\"bands_order\":[\"red\",\"nir\"],\"label\":' || label || '}') AS meta_size, true AS in_order FROM embeddings")
def shard_index(spark, sf_dir):
    """IO7"""
    index = H.index_members(spark, _sharded(spark, sf_dir))
    in_order = (F.col("bands_offset") % 512 == 0) & (F.col("meta_offset") >= F.col("bands_offset") + F.col("bands_size"))
    return index.select("sample_id", "shard", "meta_size", in_order.alias("in_order"))


@register("SELECT job_id, event, count(*) AS n, max(k) AS top FROM (SELECT user_id::VARCHAR AS job_id, event_type AS event, json_extract_string(props, '$.k')::INTEGER AS k FROM events) GROUP BY 1, 2")
def job_events(spark, sf_dir):
    """IO12"""
    root = shared_folder(spark, "events")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("job_id"), F.from_json("props", "map<string,string>").alias("details")))).write.text(root)
    return S.read_events(spark, root).groupBy("job_id", "event").agg(F.count("*").alias("n"), F.max(F.col("details")["k"].cast("int")).alias("top"))


@register("SELECT 'v2024-01-02' AS snapshot, append_seq, metric_value FROM results WHERE seed = 0 UNION ALL SELECT 'main', append_seq, metric_value FROM results WHERE seed > 0", "results")
def stored_snapshots(spark, sf_dir):
    """IO14"""
    root, rows = shared_folder(spark, "snapshots"), view(spark, sf_dir, "results").select("append_seq", "metric_value", "seed", F.lit("its own").alias("snapshot"))
    S.write_snapshot(rows.drop("seed"), root, "main")
    for label, part in (("v2024-01-02", "seed = 0"), ("main", "seed > 0")):  # the second one replaces what is there
        S.write_snapshot(rows.where(part).drop("seed"), root, label)
    return S.read_snapshots(spark, root).select("snapshot", "append_seq", "metric_value")


@register("WITH e AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: exp(CAST(x AS DOUBLE) * 3)) AS e FROM embeddings) SELECT 'd' || vec_id % 2 AS dataset, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, vec_id AS sample_id, label, round(CAST(list_max(e) / list_sum(e) AS FLOAT)::DOUBLE, 5) AS max_prob FROM e WHERE vec_id % 2 = 1")
def probability_tables(spark, sf_dir):
    """IO15"""
    root = shared_folder(spark, "probabilities")
    e = F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(x.cast("double") * 3))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("d"), (F.col("vec_id") % 2).cast("string")).alias("dataset"), F.lit("m").alias("model"), F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"), F.col("vec_id").alias("sample_id"), "label", e.alias("e"))
    S.write_probabilities(rows.withColumn("probs", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y))), root)
    return S.read_probabilities(spark, root, dataset="d1").select("dataset", "split", "sample_id", "label", F.round(F.array_max("probs").cast("double"), 5).alias("max_prob"))


@register("SELECT source AS name, count(*) AS n, max(doc_id) AS last FROM documents WHERE source IS NOT NULL GROUP BY 1")
def geography_records(spark, sf_dir):
    """IO16"""
    root = shared_folder(spark, "records")
    S.write_records(spark.read.parquet(f"{sf_dir}/documents.parquet").where("source IS NOT NULL").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"), F.max("doc_id").alias("last")), root)
    return S.read_records(spark, root, "name string, n long, last long")
