"""Registered queries over result rows and boards, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeloom.functions import keys as K
from probeloom.jobs.fixtures import oracle, view
from probeloom.operators import leaderboard as L
from probeloom.operators import results as R

RUN = ("dataset", "method", "name", "normalization", "image_size", "bands", "config_hash")
CANON = """CASE WHEN regexp_matches(trim({0}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]{{1,2}})?$') AND TRY_CAST(trim({0}) AS DOUBLE) = floor(TRY_CAST(trim({0}) AS DOUBLE)) THEN CAST(CAST(TRY_CAST(trim({0}) AS DOUBLE) AS DECIMAL(38,0)) AS VARCHAR) ELSE coalesce(trim({0}), '') END"""
QUERIES, ORACLES = {}, {}


def register(sql: str | None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, *views)
        return f

    return add


_SIZE = CANON.format("image_size")


@register(f"SELECT append_seq, {_SIZE} AS image_size_key, {CANON.format('CAST(metric_value AS VARCHAR)')} = '0' AS is_zero, {CANON.format('config_hash')} AS hash_key FROM results", "results")
def canonical_keys(spark, sf_dir):
    """PF1"""
    rows = view(spark, sf_dir, "results")
    return rows.select("append_seq", K.canonical_cell("image_size").alias("image_size_key"), (K.canonical_cell("metric_value") == "0").alias("is_zero"), K.canonical_cell("config_hash").alias("hash_key"))


_DEDUP = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY dataset, method, name, normalization, {_SIZE}, bands, metric_name, seed ORDER BY coalesce(config_hash, '') <> '' DESC, append_seq DESC) AS k FROM results)
SELECT * EXCLUDE (k) FROM r WHERE k = 1"""


@register(_DEDUP, "results")
def dedup_results(spark, sf_dir):
    """W1"""
    return R.dedup(view(spark, sf_dir, "results"), RUN)


@register("SELECT append_seq, CASE WHEN name LIKE 'm3%' AND normalization = 'bandspec_zscore' THEN 'model_native' ELSE normalization END AS normalization FROM results", "results")
def relabel_family(spark, sf_dir):
    """PF3"""
    return view(spark, sf_dir, "results").select("append_seq", K.relabel(F.col("name"), F.col("normalization"), "m3", "bandspec_zscore", "model_native").alias("normalization"))


@register("""SELECT append_seq, substr(sha256('{"bands":"' || bands || '","dataset":"' || dataset || '","hash":' || coalesce('"' || config_hash || '"', 'null') || '}'), 1, 16) AS fingerprint FROM results""", "results")
def config_fingerprint(spark, sf_dir):
    """PF4"""
    return view(spark, sf_dir, "results").select("append_seq", K.fingerprint({"dataset": F.col("dataset"), "bands": F.col("bands"), "hash": F.col("config_hash")}).alias("fingerprint"))


@register("SELECT append_seq, array_to_string(list_filter(list_transform(string_split(bands || ' , ' || dataset || ',,', ','), lambda x: trim(x)), lambda x: x <> ''), ',') AS bands, regexp_replace(regexp_replace(concat('_', name, '/', dataset, '..'), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS safe FROM results", "results")
def bands_and_names(spark, sf_dir):
    """PF2, IO3"""
    text = F.concat("bands", F.lit(" , "), "dataset", F.lit(",,"))
    return view(spark, sf_dir, "results").select("append_seq", K.bands_text(K.parse_bands(text)).alias("bands"), K.safe_name(F.concat(F.lit("_"), "name", F.lit("/"), "dataset", F.lit(".."))).alias("safe"))


_RUN_SQL = ", ".join(_SIZE if k == "image_size" else f"coalesce({k}, '')" for k in RUN)


@register(f"SELECT DISTINCT name, dataset, method, bands, normalization, seed FROM results WHERE seed = 2 AND ({_RUN_SQL}) NOT IN (SELECT ({_RUN_SQL}) FROM results WHERE seed = 1)", "results")
def pending_runs(spark, sf_dir):
    """J1, J3"""
    rows = view(spark, sf_dir, "results")
    return R.pending_runs(rows.where("seed = 2"), rows.where("seed = 1"), RUN).select("name", "dataset", "method", "bands", "normalization", "seed").distinct()


_REQUIRED = """WITH q AS (SELECT DISTINCT name, dataset, metric_name FROM (SELECT name, dataset FROM results) CROSS JOIN (VALUES ('accuracy'), ('map')) v(metric_name)),
s AS (SELECT DISTINCT name, dataset, metric_name FROM results WHERE seed = 0)
"""


@register(_REQUIRED + "SELECT q.name, q.dataset, count(*) AS required, count(s.name) AS present, count(*) = count(s.name) AS complete FROM q LEFT JOIN s USING (name, dataset, metric_name) GROUP BY 1, 2", "results")
def completed_runs(spark, sf_dir):
    """J2"""
    rows = view(spark, sf_dir, "results")
    required = rows.select("name", "dataset").distinct().withColumn("metric_name", F.explode(F.array(F.lit("accuracy"), F.lit("map"))))
    return R.completed_runs(required, rows.where("seed = 0"), ("name", "dataset"))


@register(_REQUIRED + "SELECT name, dataset, metric_name FROM q EXCEPT SELECT * FROM s", "results")
def pending_metrics(spark, sf_dir):
    """J2, SO4"""
    rows = view(spark, sf_dir, "results")
    required = rows.select("name", "dataset").distinct().withColumn("metric_name", F.explode(F.array(F.lit("accuracy"), F.lit("map"))))
    return R.pending_metrics(required, rows.where("seed = 0"), ("name", "dataset"))


@register("SELECT DISTINCT name, dataset, 'id_' || e || '_' || s AS metric_name FROM results, (VALUES ('twonn'), ('mle')) a(e), (VALUES ('train'), ('test')) b(s)", "results")
def required_metrics(spark, sf_dir):
    """PF24"""
    return R.required_metrics(view(spark, sf_dir, "results").select("name", "dataset").distinct(), ["train", "test"], ["twonn", "mle"])


@register("""WITH x AS (SELECT name, dataset, metric_value AS v, metric_value - 0.05 AS lo, metric_value + 0.05 AS hi FROM results WHERE seed = 1),
g AS (SELECT name, dataset, count(*) AS n, count(*) FILTER (NOT (v BETWEEN 0 AND 1 AND lo BETWEEN 0 AND 1 AND hi BETWEEN 0 AND 1)) AS bad FROM x GROUP BY 1, 2)
SELECT e.name, e.dataset, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad FROM (SELECT DISTINCT name, dataset FROM results) e LEFT JOIN g USING (name, dataset) WHERE coalesce(n, 0) <> 1 OR bad > 0""", "results")
def invalid_rows(spark, sf_dir):
    """PF20"""
    rows = view(spark, sf_dir, "results")
    some = rows.where("seed = 1").withColumn("ci_lower", F.col("metric_value") - 0.05).withColumn("ci_upper", F.col("metric_value") + 0.05)
    return R.invalid_rows(some, rows, ("name", "dataset"))


@register("""WITH o AS (SELECT DISTINCT name, dataset, bands FROM results WHERE name <> 'm2' AND append_seq % 7 < 3), w AS (SELECT DISTINCT name, dataset, bands FROM results WHERE dataset <> 'd1' AND append_seq % 11 < 4)
SELECT *, 'added' AS change FROM (SELECT * FROM w EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM w)""", "results")
def key_changes(spark, sf_dir):
    """J10"""
    rows = view(spark, sf_dir, "results")
    return R.key_changes(rows.where("name <> 'm2' AND append_seq % 7 < 3"), rows.where("dataset <> 'd1' AND append_seq % 11 < 4"), ("name", "dataset", "bands"))


@register("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY name, dataset, metric_name, seed ORDER BY coalesce(config_hash, '') <> '' DESC, append_seq DESC) AS k FROM results),
d AS (SELECT * EXCLUDE (k) FROM r WHERE k = 1), f AS (SELECT name, dataset FROM d WHERE name IN ('m1', 'm2', 'm3') GROUP BY ALL HAVING count(DISTINCT method) = 2)
SELECT name, dataset, seed, method, metric_value FROM d SEMI JOIN f USING (name, dataset)""", "results")
def matched_cases(spark, sf_dir):
    """J9"""
    rows = view(spark, sf_dir, "results")
    cases = rows.where("name IN ('m1', 'm2', 'm3')").select("name", "dataset").distinct()
    return R.matched_cases(rows, cases, ("name", "dataset"), ("knn5", "linear")).select("name", "dataset", "seed", "method", "metric_value")


@register("SELECT CASE method WHEN 'knn5' THEN 'profiles' ELSE 'models' END AS kind, count(*) AS n FROM results GROUP BY 1", "results")
def kind_counts(spark, sf_dir):
    """IO4"""
    return R.kind_counts(view(spark, sf_dir, "results").withColumn("method", F.when(F.col("method") == "knn5", "profile").otherwise(F.col("method"))))


@register("""SELECT method, count(*) AS n_rows, count(DISTINCT name) AS n_models, count(DISTINCT dataset) AS n_datasets, max(metric_value) AS best, max(name) FILTER (k = 1) AS best_name
FROM (SELECT *, rank() OVER (PARTITION BY method ORDER BY metric_value DESC) AS k FROM results) GROUP BY 1""", "results")
def headline(spark, sf_dir):
    """AG31"""
    return R.headline(view(spark, sf_dir, "results"))


@register("SELECT name, CASE WHEN band_config = 's2' THEN 'all' ELSE band_config END AS band_config, metric_name, metric_value, 'profile' AS method FROM (SELECT name, band_config, 'gflops' AS metric_name, gflops AS metric_value FROM costs UNION ALL SELECT name, band_config, 'params', params FROM costs) WHERE metric_value IS NOT NULL", "costs")
def long_costs(spark, sf_dir):
    """PF19, SO1"""
    return R.long_costs(view(spark, sf_dir, "costs"), ("name", "band_config"), ("gflops", "params"), {"s2": "all"})


@register("SELECT count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, avg(seconds) AS mean_seconds, (SELECT job_id FROM jobs ORDER BY seconds, job_id LIMIT 1) AS fastest, (SELECT job_id FROM jobs ORDER BY seconds DESC, job_id LIMIT 1) AS slowest FROM jobs", "jobs")
def job_summary(spark, sf_dir):
    """AG32"""
    return R.job_summary(view(spark, sf_dir, "jobs"))


@register("SELECT job_id, max_by(log, seq) AS log FROM events_log WHERE event = 'purchase' GROUP BY 1", "events_log")
def last_completed(spark, sf_dir):
    """J20"""
    return R.last_completed(view(spark, sf_dir, "events_log").withColumn("event", F.when(F.col("event") == "purchase", "completed").otherwise(F.col("event"))))


_SCORES = """WITH s AS (SELECT model_name, dataset, avg(CASE WHEN metric_name = 'r2' THEN greatest(v, -1) ELSE v END) AS score FROM (SELECT *, CASE WHEN NOT isnan(metric_value) THEN metric_value END AS v FROM scores) GROUP BY 1, 2),
b AS (SELECT s.*, coalesce(family, 'other') AS family FROM s LEFT JOIN families USING (dataset))
"""


@register("""WITH e AS (SELECT event_id, user_id AS job_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), j AS (SELECT DISTINCT job_id FROM e),
c AS (SELECT job_id, 'done_' || max(event_id) AS log FROM e WHERE event_type = 'purchase' AND job_id % 3 = 0 GROUP BY 1), a AS (SELECT job_id, min(job_id || '.attempt' || k) AS log FROM e WHERE k = 2 OR k = 3 AND job_id % 2 = 1 GROUP BY 1 HAVING count(*) = 1)
SELECT job_id, coalesce(c.log, a.log) AS log FROM j LEFT JOIN c USING (job_id) LEFT JOIN a USING (job_id)""")
def job_logs(spark, sf_dir):
    """J20"""
    from pyspark.sql.window import Window

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.col("user_id").alias("job_id"), "event_type")
    events = rows.where("job_id % 3 = 0").select("seq", "job_id", F.when(F.col("event_type") == "purchase", "completed").otherwise("started").alias("event"), F.concat(F.lit("done_"), F.col("seq").cast("string")).alias("log"))
    tries = rows.withColumn("k", F.row_number().over(Window.partitionBy("job_id").orderBy("seq")))
    done = (F.col("k") == 2) | (F.col("k") == 3) & (F.col("job_id") % 2 == 1)  # odd jobs have two logs with the success text
    attempts = tries.select("job_id", F.concat_ws(".attempt", F.col("job_id").cast("string"), F.col("k").cast("string")).alias("log"), F.when(done, "a\nBenchmark complete.\n").otherwise("failed").alias("text"))
    return R.job_logs(rows.select("job_id").distinct(), events, attempts, "Benchmark complete.")


@register(_SCORES + "SELECT * FROM b", "scores", "families")
def bench_scores(spark, sf_dir):
    """AG1, PF7, PF8"""
    return L.bench_scores(view(spark, sf_dir, "scores"), view(spark, sf_dir, "families"))


_RANKED = ", k AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0 AS rank FROM b WHERE score IS NOT NULL), w AS (SELECT model_name, family, rank, score FROM k UNION ALL SELECT model_name, 'macro', rank, score FROM k) "


@register(_SCORES + _RANKED + "SELECT model_name, family, avg(rank) AS mean_rank, avg(score) AS mean_score, count(*) AS n FROM w GROUP BY 1, 2", "scores", "families")
def family_leaderboard(spark, sf_dir):
    """AG2, W2"""
    return L.family_board(L.bench_scores(view(spark, sf_dir, "scores"), view(spark, sf_dir, "families")))


@register("SELECT v AS view, count(*) AS n, count(DISTINCT model_name) AS n_models FROM scores, (VALUES ('random'), ('spatial')) t(v) WHERE split = v OR split = 'official' GROUP BY 1", "scores")
def split_views(spark, sf_dir):
    """AG2"""
    return L.split_views(view(spark, sf_dir, "scores")).groupBy("view").agg(F.count("*").alias("n"), F.countDistinct("model_name").alias("n_models"))


@register("SELECT * EXCLUDE (s) FROM (SELECT append_seq, name, dataset, bands, bands = 'rgb' AND append_seq % 5 = 0 AS is_substitute, max(bands = 'rgb' AND append_seq % 5 = 0) OVER (PARTITION BY name, dataset, config_hash, seed) AS s FROM results) WHERE is_substitute OR NOT s", "results")
def prefer_substitutes(spark, sf_dir):
    """W3"""
    rows = view(spark, sf_dir, "results").withColumn("is_substitute", F.expr("bands = 'rgb' AND append_seq % 5 = 0"))
    return L.prefer_substitutes(rows, ("name", "dataset", "config_hash", "seed")).select("append_seq", "name", "dataset", "bands", "is_substitute")


def _raw(spark, sf_dir):
    suffix = F.when(F.col("append_seq") % 3 == 0, "_cls").when(F.col("append_seq") % 3 == 1, "_sub").otherwise("")
    return view(spark, sf_dir, "results").withColumn("name", F.concat("name", suffix))


@register("""WITH r AS (SELECT *, concat(name, CASE append_seq % 3 WHEN 0 THEN '_cls' WHEN 1 THEN '_sub' ELSE '' END) AS full_name FROM results WHERE dataset NOT IN ('d4'))
SELECT append_seq, CASE WHEN full_name LIKE '%\\_cls' ESCAPE '\\' THEN 'cls' ELSE 'mean' END AS pooling, full_name LIKE '%\\_sub' ESCAPE '\\' AS is_substitute, CASE name WHEN 'm1' THEN 'model-one' ELSE name END AS model, 'acc' AS metric, metric_value AS score FROM r""", "results")
def harmonised_rows(spark, sf_dir):
    """PF5, PF6"""
    return L.harmonise(_raw(spark, sf_dir), ["d4"], {"accuracy": "acc"}, {"m1": "model-one"}).select("append_seq", "pooling", "is_substitute", "model", "metric", "score")


@register("SELECT dataset, bands, seed, count(DISTINCT name) AS sources, count(*) AS n_rows FROM results GROUP BY ALL HAVING count(DISTINCT name) > 1 OR count(*) > 1", "results")
def alias_collisions(spark, sf_dir):
    """AG4"""
    return L.alias_collisions(view(spark, sf_dir, "results"), ("dataset", "bands", "seed"))


_CELLS = "WITH c AS (SELECT name AS model, dataset, normalization, 'acc' AS metric, avg(metric_value) AS score FROM results WHERE NOT (name = 'm2' AND dataset = 'd1' AND normalization = 'model_native') AND NOT (name = 'm4' AND dataset = 'd3') GROUP BY 1, 2, 3)"


@register(_CELLS + """, u AS (SELECT count(DISTINCT (dataset, metric)) AS n FROM c), h AS (SELECT model, normalization FROM c GROUP BY 1, 2 HAVING count(*) = (SELECT n FROM u)),
b AS (SELECT model, CASE WHEN bool_or(normalization = 'model_native') THEN 'model_native' ELSE 'bandspec_zscore' END AS normalization FROM h GROUP BY 1)
SELECT c.* FROM c SEMI JOIN b USING (model, normalization)""", "results")
def complete_view(spark, sf_dir):
    """AG3"""
    rows = view(spark, sf_dir, "results").where("NOT (name = 'm2' AND dataset = 'd1' AND normalization = 'model_native') AND NOT (name = 'm4' AND dataset = 'd3')")
    cells = rows.groupBy(F.col("name").alias("model"), "dataset", "normalization", F.lit("acc").alias("metric")).agg(F.avg("metric_value").alias("score"))
    return L.complete_view(cells)


@register("SELECT model, avg(r) AS mean_rank, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0 AS r FROM board) GROUP BY 1", "board")
def mean_rank(spark, sf_dir):
    """AG5"""
    return L.mean_rank(view(spark, sf_dir, "board"))


@register("SELECT a.model AS a, b.model AS b, CAST(sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS DOUBLE) AS wins, count(*) AS n FROM board a JOIN board b USING (dataset) WHERE a.model <> b.model GROUP BY 1, 2", "board")
def pair_wins(spark, sf_dir):
    """J14"""
    return L.wins(view(spark, sf_dir, "board"))


@register("""WITH RECURSIVE p AS (SELECT dataset, row_number() OVER (ORDER BY dataset) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT dataset FROM board)),
d AS (SELECT dataset, 0 AS r, 1 AS w FROM p UNION ALL SELECT dataset, r, count(*) FROM (SELECT r, CAST('0x' || substr(md5('0:' || r || ':' || j), 1, 8) AS BIGINT) % n AS i FROM (SELECT DISTINCT n FROM p), range(1, 1001) t(r), range(0, 64) v(j) WHERE j < n) JOIN p USING (i) GROUP BY 1, 2),
g AS (SELECT r, a.model AS a, b.model AS b, sum(w * CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) + 0.5 AS won, sum(w) + 1.0 AS games FROM board a JOIN board b ON a.dataset = b.dataset AND a.model <> b.model JOIN d ON d.dataset = a.dataset GROUP BY 1, 2, 3),
h AS (SELECT r, a, sum(won) AS won, f.games AS games FROM (SELECT r, a, sum(won) AS won FROM g GROUP BY 1, 2) q JOIN (SELECT r, a, list(games ORDER BY b) AS games FROM (SELECT r, a, b, games FROM g UNION ALL SELECT DISTINCT r, a, a, 0.0 FROM g) GROUP BY 1, 2) f USING (r, a) GROUP BY ALL),
m AS MATERIALIZED (SELECT r, list(a ORDER BY a) AS names, list(won ORDER BY a) AS won, list(games ORDER BY a) AS games FROM h GROUP BY 1),
s(k, r, s) AS (SELECT 0, r, list_transform(won, lambda x: 1.0::DOUBLE) FROM m UNION ALL SELECT k + 1, r, list_transform(s, lambda x: x / exp(list_avg(list_transform(s, lambda y: ln(y))))) FROM (
  SELECT k, r, list_transform(won, lambda x, i: (x / list_sum(list_transform(games[i], lambda y, j: y / (z.s[i] + z.s[j]))))::DOUBLE) AS s FROM s z JOIN m USING (r) WHERE k < 150)),
e AS (SELECT r, unnest(names) AS model, unnest(list_transform(s, lambda x: 1000 + 400 * log10(x))) AS rating FROM s JOIN m USING (r) WHERE k = 150)
SELECT model, round(max(rating) FILTER (r = 0), 4) AS rating, round(quantile_cont(rating, 0.025) FILTER (r > 0), 4) AS low, round(quantile_cont(rating, 0.975) FILTER (r > 0), 4) AS high FROM e GROUP BY 1""", "board")
def elo_ratings(spark, sf_dir):
    """AG6"""
    return L.elo(view(spark, sf_dir, "board"), resamples=1000).select("model", *(F.round(c, 4).alias(c) for c in ("rating", "low", "high")))


@register("SELECT model, avg(CASE WHEN score = b THEN 0.0 ELSE 100 * (b - score) / (1 - score) END) AS improvability FROM (SELECT *, max(score) OVER (PARTITION BY dataset) AS b FROM board) GROUP BY 1", "board")
def improvability(spark, sf_dir):
    """AG7"""
    return L.improvability(view(spark, sf_dir, "board"))


@register("SELECT band_config, count(DISTINCT gflops) AS values, CAST(0 AS BIGINT) AS bad FROM costs WHERE gflops IS NOT NULL GROUP BY 1 HAVING count(DISTINCT gflops) > 1", "costs")
def cost_conflicts(spark, sf_dir):
    """AG9"""
    return L.cost_conflicts(view(spark, sf_dir, "costs"), ("band_config",), "gflops")


@register("SELECT append_seq, r.name, gflops FROM (SELECT append_seq, concat('s', substr(name, 2)) AS name FROM results) r LEFT JOIN (SELECT name, max(gflops) AS gflops FROM costs WHERE gflops IS NOT NULL GROUP BY 1) USING (name)", "results", "costs")
def rows_with_costs(spark, sf_dir):
    """AG9, J6"""
    rows = view(spark, sf_dir, "results").select("append_seq", F.concat(F.lit("s"), F.substring("name", 2, 9)).alias("name"))
    return L.with_costs(rows, L.extract_costs(view(spark, sf_dir, "costs"), ("name",), "gflops"), ("name",))


_DELTA = "WITH c AS (SELECT name AS model, dataset, bands, normalization, avg(metric_value) AS score FROM results WHERE NOT (name = 'm3' AND bands = 'all') GROUP BY ALL), d AS (SELECT c.*, b.score AS base, c.score - b.score AS delta FROM c LEFT JOIN (SELECT model, dataset, normalization, score FROM c WHERE bands = 'all') b USING (model, dataset, normalization)) "


def _variants(spark, sf_dir):
    rows = view(spark, sf_dir, "results").where("NOT (name = 'm3' AND bands = 'all')")
    return rows.groupBy(F.col("name").alias("model"), "dataset", "bands", "normalization").agg(F.avg("metric_value").alias("score"))


@register(_DELTA + "SELECT model, dataset, normalization, bands, round(score, 9) AS score, round(base, 9) AS base, round(delta, 9) AS delta FROM d", "results")
def delta_to_baseline(spark, sf_dir):
    """J7, J8"""
    r = lambda c: F.round(c, 9).alias(c)
    return L.delta_to(_variants(spark, sf_dir), ("model", "dataset", "normalization"), "bands", "all").select("model", "dataset", "normalization", "bands", r("score"), r("base"), r("delta"))


@register(_DELTA + "SELECT bands, count(*) AS n, round(avg(delta), 9) AS mean, round(median(delta), 9) AS median, round(min(delta), 9) AS least, round(max(delta), 9) AS most, count(*) FILTER (delta > 0) AS improved, count(*) FILTER (delta < 0) AS regressed FROM d WHERE delta IS NOT NULL GROUP BY 1", "results")
def variant_summary(spark, sf_dir):
    """AG26"""
    out = L.variant_summary(L.delta_to(_variants(spark, sf_dir), ("model", "dataset", "normalization"), "bands", "all"), "bands")
    return out.select("bands", "n", *(F.round(c, 9).alias(c) for c in ("mean", "median", "least", "most")), "improved", "regressed")


@register(_DELTA + "SELECT model, arg_max(normalization, s) AS best FROM (SELECT model, normalization, avg(score) AS s FROM c GROUP BY 1, 2) GROUP BY 1", "results")
def best_variant(spark, sf_dir):
    """AG26"""
    return L.best_variant(_variants(spark, sf_dir), "normalization")


@register(_DELTA + "SELECT a.model, a.dataset, a.bands, round(a.score, 9) AS score_a, round(b.score, 9) AS score_b, round(b.score - a.score, 9) AS delta FROM c a JOIN c b USING (model, dataset, bands) WHERE a.normalization = 'bandspec_zscore' AND b.normalization = 'model_native'", "results")
def paired_settings(spark, sf_dir):
    """J11"""
    out = L.paired_settings(_variants(spark, sf_dir), ("model", "dataset", "bands"), "normalization", "bandspec_zscore", "model_native")
    return out.select("model", "dataset", "bands", *(F.round(c, 9).alias(c) for c in ("score_a", "score_b", "delta")))


_VIEWS = "WITH v AS (SELECT bands || normalization AS view, name AS model, avg(metric_value) AS s FROM results GROUP BY 1, 2), k AS (SELECT view, model, rank() OVER (PARTITION BY view ORDER BY s DESC) AS rank FROM v) "


@register(_VIEWS + """, p AS (SELECT a.view AS va, b.view AS vb, a.model AS m, a.rank AS ra, b.rank AS rb FROM k a JOIN k b USING (model)), q AS (SELECT va, vb, sum(sign(x.ra - y.ra) * sign(x.rb - y.rb)) AS s, sum(abs(sign(x.ra - y.ra))) AS nx, sum(abs(sign(x.rb - y.rb))) AS ny FROM p x JOIN p y USING (va, vb) WHERE x.m < y.m GROUP BY 1, 2)
SELECT va, vb, n_models, round(s / sqrt(nx * ny), 9) AS tau, n_models < 10 AS few FROM (SELECT va, vb, count(*) AS n_models FROM p GROUP BY 1, 2) LEFT JOIN q USING (va, vb)""", "results")
def rank_agreement(spark, sf_dir):
    """AG8, J15, SO5"""
    rows = view(spark, sf_dir, "results").groupBy(F.concat("bands", "normalization").alias("view"), F.col("name").alias("model")).agg(F.avg("metric_value").alias("s"))
    return L.kendall(rows.select("view", "model", L.average_rank("s", "view").alias("rank"))).withColumn("tau", F.round("tau", 9))


@register("SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY metric_value DESC, append_seq) AS k FROM results) WHERE k = 1", "results")
def best_stored_row(spark, sf_dir):
    """J19"""
    return L.top_row(view(spark, sf_dir, "results"), ("dataset", "method"))


@register("SELECT bands, method, CAST(row_number() OVER (ORDER BY CASE bands WHEN 'rgb' THEN 1 ELSE 1000000 END, bands, CASE method WHEN 'linear' THEN 1 WHEN 'knn5' THEN 2 ELSE 1000000 END, method) AS INTEGER) AS place FROM (SELECT DISTINCT bands, method FROM results)", "results")
def view_keys(spark, sf_dir):
    """AG10"""
    return L.view_keys(view(spark, sf_dir, "results"), {"bands": ("rgb",), "method": ("linear", "knn5")})


@register("SELECT dataset, arg_min(method, append_seq) AS metric_name FROM results GROUP BY 1", "results")
def first_metric(spark, sf_dir):
    """AG11"""
    return L.first_metric(view(spark, sf_dir, "results").withColumn("metric_name", F.col("method")))


@register("SELECT dataset, median(score) AS median, min(model) FILTER (k = 1) AS winner FROM (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score DESC) AS k FROM board) GROUP BY 1", "board")
def median_winner(spark, sf_dir):
    """AG33"""
    return L.median_winner(view(spark, sf_dir, "board"))


@register("SELECT name, dataset, seed, metric_value, 'now' AS snapshot, append_seq FROM results WHERE method = 'linear' AND append_seq % 13 <> 0", "results")
def explorer_rows(spark, sf_dir):
    """PF18"""
    rows = view(spark, sf_dir, "results").withColumn("metric_value", F.when(F.col("append_seq") % 13 == 0, "none").otherwise(F.col("metric_value").cast("string"))).withColumn("seed", F.col("seed").cast("string"))
    return R.explorer_rows(rows, ("linear", "profile"), "now").select("name", "dataset", "seed", "metric_value", "snapshot", "append_seq")
