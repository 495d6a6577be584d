"""Registered queries over predictions, features and labels, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeloom.functions.draws import poisson_thresholds
from probeloom.jobs.fixtures import oracle, view
from probeloom.operators import audit as A
from probeloom.operators import knn as N
from probeloom.operators import metrics as M

QUERIES, ORACLES = {}, {}


def register(sql: str | None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, *views)
        return f

    return add


@register("SELECT class, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM judged GROUP BY 1", "judged")
def class_accuracy(spark, sf_dir):
    """AG13"""
    return M.accuracy(view(spark, sf_dir, "judged"), "class")


_AP = "WITH s AS (SELECT {g} score, sum(positive) AS tp, count(*) AS n FROM judged GROUP BY ALL), r AS (SELECT *, sum(tp) OVER w AS atp, sum(n) OVER w AS an FROM s WINDOW w AS ({p} ORDER BY score DESC)) SELECT {g} sum(tp * atp / an) / sum(tp) AS ap, CAST(sum(tp) AS BIGINT) AS n_positive FROM r {e}"


@register(_AP.format(g="", p="", e=""), "judged")
def micro_average_precision(spark, sf_dir):
    """AG14, W9"""
    return M.average_precision(view(spark, sf_dir, "judged"))


@register(_AP.format(g="class,", p="PARTITION BY class", e="GROUP BY class"), "judged")
def class_average_precision(spark, sf_dir):
    """AG15"""
    return M.average_precision(view(spark, sf_dir, "judged"), "class")


_U32 = "(CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) + 0.5) / 4294967296"
#: The draws that poisson_weights makes for a unit: r and w.
_POISSON = "SELECT {cols}, b * 8 + i + 1 AS r, (" + " + ".join(f"CAST(u >= {t!r} AS INTEGER)" for t in poisson_thresholds()) + ") AS w FROM (SELECT {cols}, b, i, (CAST('0x' || substr(md5('0:' || {unit} || ':' || b), 4 * i + 1, 4) AS BIGINT) + 0.5) / 65536 AS u FROM {table}, range(0, 13) t(b), range(0, 8) v(i) WHERE b * 8 + i < 100)"


@register("""WITH a AS (SELECT class, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n, count(*) FILTER (pred = label) AS h FROM judged GROUP BY 1),
k AS (SELECT class, n, h, unnest(range(greatest(0, CAST(trunc(h - s) AS BIGINT)), least(n, CAST(trunc(h + s) AS BIGINT) + 1) + 1)) AS k FROM (SELECT *, CASE WHEN h IN (0, n) THEN 0 ELSE 12 * sqrt(n * (h / n) * (1 - h / n)) + 12 END AS s FROM a)),
l AS (SELECT *, coalesce(sum(CASE WHEN h IN (0, n) THEN -1000 WHEN k < n THEN ln((n - k) / (k + 1)) + ln(h / n) - ln(1 - h / n) END) OVER (PARTITION BY class ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM (SELECT * FROM k WHERE k <= n)),
m AS (SELECT *, exp(l - max(l) OVER (PARTITION BY class)) AS q FROM l), c AS (SELECT class, k, sum(q) OVER (PARTITION BY class ORDER BY k) / sum(q) OVER (PARTITION BY class) AS c FROM m),
d AS (SELECT class, r, min(k) AS k FROM (SELECT class, r, """ + _U32.format("'0:' || n || ':' || h || ':' || r") + """ AS u FROM a, range(1, 201) t(r)) JOIN c USING (class) WHERE c >= u GROUP BY 1, 2)
SELECT class, accuracy, n, avg(k / n) AS mean, quantile_cont(k / n, 0.025) AS low, quantile_cont(k / n, 0.975) AS high FROM d JOIN a USING (class) GROUP BY ALL""", "judged")
def bootstrap_accuracy(spark, sf_dir):
    """AG16"""
    return M.bootstrap_accuracy(view(spark, sf_dir, "judged"), "class")


@register("WITH d AS (" + _POISSON.format(cols="score, positive", unit="sample_id", table="judged") + """), s AS (SELECT r, score, sum(w * positive) AS tp, sum(w) AS n FROM d WHERE w > 0 GROUP BY 1, 2),
a AS (SELECT r, tp, sum(tp) OVER w AS atp, sum(n) OVER w AS an FROM s WINDOW w AS (PARTITION BY r ORDER BY score DESC)), e AS (SELECT r, sum(tp * atp / an) / nullif(sum(tp), 0) AS ap FROM a GROUP BY 1)
SELECT round(avg(ap), 9) AS mean, round(quantile_cont(ap, 0.025), 9) AS low, round(quantile_cont(ap, 0.975), 9) AS high FROM e""", "judged")
def bootstrap_average_precision(spark, sf_dir):
    """AG17"""
    out = M.bootstrap_ap(view(spark, sf_dir, "judged"), "sample_id")
    return out.select(*(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


_PROBS = "WITH e AS (SELECT vec_id AS sample_id, label, list_transform(embedding[1:10], lambda x: exp(CAST(x AS DOUBLE) * 3)) AS e FROM embeddings), p AS (SELECT sample_id, label, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM e), q AS (SELECT *, probs[label + 1] AS quality, list_max(probs) AS max_prob, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS guess FROM p) "


def _probs(spark, sf_dir):
    e = F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(x.cast("double") * 3))
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), "label", e.alias("e"))
    return df.select("sample_id", "label", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("probs"))


@register(_PROBS + ", b AS (SELECT floor(max_prob * 15) AS b, count(*) AS n, avg(max_prob) AS c, avg(CASE WHEN guess = label THEN 1.0 ELSE 0.0 END) AS a FROM q GROUP BY 1) SELECT sum(n * abs(c - a)) / sum(n) AS ece, sqrt(sum(n * abs(c - a) ** 2) / sum(n)) AS rms, max(abs(c - a)) AS mce FROM b")
def calibration_errors(spark, sf_dir):
    """AG20"""
    return M.calibration(_probs(spark, sf_dir), 15)


@register("""WITH m AS (SELECT vec_id, unnest([CAST(label > 4 AS INTEGER), label % 2, CAST(label % 3 = 0 AS INTEGER), 1]) AS y, unnest(list_transform(embedding[1:4], lambda x: 1 / (1 + exp(-5 * CAST(x AS DOUBLE))))) AS p, unnest([0, 1, 2, 3]) AS place FROM embeddings),
b AS (SELECT place, floor(p * 15) AS b, count(*) AS n, avg(p) AS c, avg(y) AS a FROM m GROUP BY 1, 2), e AS (SELECT place, sum(n * abs(c - a)) / sum(n) AS ece, sqrt(sum(n * abs(c - a) ** 2) / sum(n)) AS rms, max(abs(c - a)) AS mce FROM b GROUP BY 1)
SELECT avg(ece) AS ece, avg(rms) AS rms, avg(mce) AS mce FROM e WHERE place IN (SELECT place FROM m GROUP BY 1 HAVING min(y) < max(y))""")
def calibration_of_labels(spark, sf_dir):
    """AG20: the mean over labels with both outcomes; the last label has one only"""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    marks = F.array((F.col("label") > 4).cast("int"), F.col("label") % 2, (F.col("label") % 3 == 0).cast("int"), F.lit(1))
    return M.calibration_labels(df.select(marks.alias("labels"), F.transform(F.slice("embedding", 1, 4), lambda x: 1 / (1 + F.exp(-5 * x.cast("double")))).alias("probs")), 15)


_COUNTS = "WITH x AS (SELECT t AS c, n AS l, 0 AS p, CASE WHEN t = p THEN n ELSE 0 END AS h FROM confusions UNION ALL SELECT p, 0, n, 0 FROM confusions), c AS (SELECT c, sum(h) AS tp, sum(l) AS l, sum(p) AS p FROM x GROUP BY 1) "


@register(_COUNTS + "SELECT avg(tp / (l + p - tp)) AS miou, sum(tp / (l + p - tp) * l) / sum(l) AS fw_iou, avg(tp / p) AS precision, avg(tp / l) AS recall, avg(2 * tp / (l + p)) AS f1 FROM c", "confusions")
def segmentation_scores(spark, sf_dir):
    """AG22"""
    return M.segmentation_scores(view(spark, sf_dir, "confusions"))


@register("WITH d AS (" + _POISSON.format(cols="t, p, n", unit="image_id", table="confusions") + """), z AS (SELECT r, t, p, sum(w * n) AS n FROM d WHERE w > 0 GROUP BY ALL),
x AS (SELECT r, t AS c, n AS l, 0 AS p, CASE WHEN t = p THEN n ELSE 0 END AS h FROM z UNION ALL SELECT r, p, 0, n, 0 FROM z), c AS (SELECT r, c, sum(h) AS tp, sum(l) + sum(p) - sum(h) AS u FROM x GROUP BY 1, 2), e AS (SELECT r, avg(tp / u) AS m FROM c WHERE u > 0 GROUP BY 1)
SELECT round(avg(m), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM e""", "confusions")
def bootstrap_miou(spark, sf_dir):
    """AG18"""
    return M.bootstrap_miou(view(spark, sf_dir, "confusions")).select(*(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


@register("""WITH m AS (SELECT vec_id AS image_id, list_transform(embedding, lambda x, i: CASE WHEN i % 16 = 0 THEN 255 ELSE least(3, greatest(0, CAST(floor((CAST(x AS DOUBLE) + 1) * 2) AS INTEGER))) END) AS mask, list_transform(embedding, lambda x, i: least(3, greatest(0, CAST(floor((CAST(x AS DOUBLE) + 1.1) * 2) AS INTEGER)))) AS pred FROM embeddings),
z AS (SELECT image_id, unnest(mask) AS t, unnest(pred) AS p FROM m) SELECT image_id, t, p, count(*) AS n FROM z WHERE t <> 255 GROUP BY ALL""")
def image_confusions(spark, sf_dir):
    """AG21"""
    level = lambda x, d: F.least(F.lit(3), F.greatest(F.lit(0), F.floor((x.cast("double") + d) * 2).cast("int")))
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return M.confusions(df.select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda x, i: F.when((i + 1) % 16 == 0, 255).otherwise(level(x, 1))).alias("mask"), F.transform("embedding", lambda x: level(x, 1.1)).alias("pred")), 4)


@register("""WITH d AS (SELECT model AS variant, score - 0.5 AS delta, row_number() OVER (PARTITION BY model ORDER BY score - 0.5) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM board),
g AS (SELECT n, r, CAST('0x' || substr(md5('0:' || r || ':' || j), 1, 8) AS BIGINT) % n AS i FROM (SELECT DISTINCT n FROM d), range(1, 20001) t(r), range(0, 64) v(j) WHERE j < n), m AS (SELECT variant, r, avg(delta) AS m FROM d JOIN g USING (n, i) GROUP BY 1, 2)
SELECT variant, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high FROM (SELECT variant, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1) JOIN (SELECT variant, avg(delta) AS mean FROM d GROUP BY 1) USING (variant)""", "board")
def mean_delta_intervals(spark, sf_dir):
    """AG19"""
    rows = view(spark, sf_dir, "board").select(F.col("model").alias("variant"), (F.col("score") - 0.5).alias("delta"))
    return M.mean_delta_interval(rows, "variant").select("variant", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


_NEAR = """WITH f AS (SELECT sample_id, features::DOUBLE[] AS x, label, split FROM features), n AS (SELECT q.sample_id, q.label, t.sample_id AS train_id, t.label AS tl, list_distance(q.x, t.x) AS distance, row_number() OVER (PARTITION BY q.sample_id ORDER BY list_distance(q.x, t.x), t.sample_id) AS rank FROM f q JOIN f t ON q.split = 'test' AND t.split = 'train') """
_VOTE = _NEAR + ", v AS (SELECT sample_id, any_value(label) AS label, tl, count(*) AS c FROM n WHERE rank <= 5 GROUP BY sample_id, tl), p AS (SELECT sample_id, arg_max(tl, c * 1000 - tl) AS pred, max(c) / sum(c) AS share, any_value(label) AS label FROM v GROUP BY 1) "


def _split(spark, sf_dir):
    rows = view(spark, sf_dir, "features")
    return rows.where("split = 'test'"), rows.where("split = 'train'")


@register(_NEAR + "SELECT sample_id, train_id, round(distance, 9) AS distance, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 5", "features")
def knn_join(spark, sf_dir):
    """J12"""
    return N.neighbours(*_split(spark, sf_dir), 5).withColumn("distance", F.round("distance", 9))


@register(_VOTE + "SELECT sample_id, pred, share FROM p", "features")
def knn_vote(spark, sf_dir):
    """PR1"""
    test, train = _split(spark, sf_dir)
    return N.vote(N.neighbours(test, train, 5), train)


#: The 200 draws that bootstrap_accuracy makes for the counts (n, h) of a table a: dr (r, k).
BINOMIAL = """k AS (SELECT n, h, unnest(range(greatest(0, CAST(trunc(h - s) AS BIGINT)), least(n, CAST(trunc(h + s) AS BIGINT) + 1) + 1)) AS k FROM (SELECT *, CASE WHEN h IN (0, n) THEN 0 ELSE 12 * sqrt(n * (h / n) * (1 - h / n)) + 12 END AS s FROM a)),
l AS (SELECT *, coalesce(sum(CASE WHEN h IN (0, n) THEN -1000 WHEN k < n THEN ln((n - k) / (k + 1)) + ln(h / n) - ln(1 - h / n) END) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM (SELECT * FROM k WHERE k <= n)),
mm AS (SELECT *, exp(l - max(l) OVER ()) AS q FROM l), cc AS (SELECT k, sum(q) OVER (ORDER BY k) / sum(q) OVER () AS c FROM mm),
dr AS (SELECT r, min(k) AS k FROM (SELECT r, """ + _U32.format("'0:' || n || ':' || h || ':' || r") + """ AS u FROM a, range(1, 201) t(r)) JOIN cc ON c >= u GROUP BY 1)"""


@register(_VOTE + """, a AS (SELECT count(*) AS n, count(*) FILTER (pred = label) AS h FROM p), """ + BINOMIAL + """, b AS (SELECT floor(share * 6) AS b, count(*) AS n, avg(share) AS c, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS acc FROM p GROUP BY 1)
SELECT h / n AS metric, (SELECT avg(k / n) FROM dr, a) AS mean, (SELECT quantile_cont(k / n, 0.025) FROM dr, a) AS low, (SELECT quantile_cont(k / n, 0.975) FROM dr, a) AS high, n, (SELECT sum(n * abs(c - acc)) / sum(n) FROM b) AS ece, (SELECT sqrt(sum(n * abs(c - acc) ** 2) / sum(n)) FROM b) AS rms, (SELECT max(abs(c - acc)) FROM b) AS mce, CAST(6 AS INTEGER) AS bins FROM a""", "features")
def knn_evaluate(spark, sf_dir):
    """PR3: accuracy, its interval and calibration with a bin more than neighbours"""
    return N.report(*_split(spark, sf_dir), 5)


_KNN_LABELS = _NEAR + """, y AS (SELECT sample_id, label, unnest([CAST(tl > 4 AS INTEGER), tl % 2, CAST(tl % 3 = 0 AS INTEGER)]) AS s, unnest([0, 1, 2]) AS place FROM n WHERE rank <= 5),
m AS MATERIALIZED (SELECT sample_id, place, avg(s) AS score, any_value(CASE place WHEN 0 THEN CAST(label > 4 AS INTEGER) WHEN 1 THEN label % 2 ELSE CAST(label % 3 = 0 AS INTEGER) END) AS positive FROM y GROUP BY 1, 2), """


@register(_KNN_LABELS + "d AS (" + _POISSON.format(cols="score, positive", unit="sample_id", table="m") + """), st AS (SELECT r, score, sum(w * positive) AS tp, sum(w) AS n FROM (SELECT *  FROM d WHERE w > 0 UNION ALL SELECT score, positive, 0, 1 FROM m) GROUP BY 1, 2),
ra AS (SELECT r, tp, sum(tp) OVER o AS atp, sum(n) OVER o AS an FROM st WINDOW o AS (PARTITION BY r ORDER BY score DESC)), e AS (SELECT r, sum(tp * atp / an) / nullif(sum(tp), 0) AS ap FROM ra GROUP BY 1),
b AS (SELECT place, floor(score * 6) AS b, count(*) AS n, avg(score) AS c, avg(positive) AS acc FROM m GROUP BY 1, 2), g AS (SELECT sum(n * abs(c - acc)) / sum(n) AS ece, sqrt(sum(n * abs(c - acc) ** 2) / sum(n)) AS rms, max(abs(c - acc)) AS mce FROM b GROUP BY place)
SELECT (SELECT ap FROM e WHERE r = 0) AS metric, (SELECT avg(ap) FROM e WHERE r > 0) AS mean, (SELECT quantile_cont(ap, 0.025) FROM e WHERE r > 0) AS low, (SELECT quantile_cont(ap, 0.975) FROM e WHERE r > 0) AS high, (SELECT count(DISTINCT sample_id) FROM m) AS n, (SELECT avg(ece) FROM g) AS ece, (SELECT avg(rms) FROM g) AS rms, (SELECT avg(mce) FROM g) AS mce, CAST(6 AS INTEGER) AS bins""", "features")
def knn_evaluate_labels(spark, sf_dir):
    """PR3, PR2: micro average precision of label vectors, its interval and the labels' mean calibration"""
    marks = F.array((F.col("label") > 4).cast("int"), F.col("label") % 2, (F.col("label") % 3 == 0).cast("int"))
    test, train = (df.withColumn("labels", marks) for df in _split(spark, sf_dir))
    return N.report(test, train, 5, resamples=100)


@register(_NEAR + ", y AS (SELECT sample_id, unnest([CAST(tl > 4 AS INTEGER), tl % 2, CAST(tl % 3 = 0 AS INTEGER)]) AS y, unnest([0, 1, 2]) AS place FROM n WHERE rank <= 5) SELECT sample_id, place, avg(y) AS prob, CAST(avg(y) > 0.5 AS INTEGER) AS pred FROM y GROUP BY 1, 2", "features")
def knn_multilabel(spark, sf_dir):
    """PR2"""
    test, train = _split(spark, sf_dir)
    marks = F.array((F.col("label") > 4).cast("int"), F.col("label") % 2, (F.col("label") % 3 == 0).cast("int"))
    return N.vote_many(N.neighbours(test, train, 5), train.withColumn("labels", marks))


@register("""WITH f AS (SELECT sample_id, features::DOUBLE[] AS x FROM features), n AS (SELECT a.sample_id, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.sample_id ORDER BY list_distance(a.x, b.x), b.sample_id) AS k FROM f a JOIN f b ON a.sample_id <> b.sample_id)
SELECT sample_id, round(min(d), 9) AS d1, round(max(d), 9) AS d2 FROM n WHERE k <= 2 GROUP BY 1 HAVING min(d) > 0""", "features")
def two_nearest(spark, sf_dir):
    """PR16"""
    return N.nonzero_two(view(spark, sf_dir, "features")).select("sample_id", F.round("d1", 9).alias("d1"), F.round("d2", 9).alias("d2"))


@register("""WITH f AS (SELECT sample_id, label, features::DOUBLE[] AS x, sample_id % 3 AS fold FROM features), u AS (SELECT fold, unnest(range(1, 65)) AS i, unnest(x) AS x FROM f),
s AS (SELECT t.fold, i, avg(x) AS m, stddev_pop(x) AS s FROM range(0, 3) t(fold) JOIN u ON u.fold <> t.fold GROUP BY 1, 2), l AS (SELECT fold, list(m ORDER BY i) AS m, list(CASE WHEN s > 0 THEN s ELSE 1 END ORDER BY i) AS s FROM s GROUP BY 1),
z AS MATERIALIZED (SELECT l.fold, f.fold AS own, sample_id, label, list_transform(x, lambda v, i: (v - m[i]) / s[i]) AS x FROM f, l),
n AS (SELECT q.fold, q.sample_id, q.label, t.label AS tl, row_number() OVER (PARTITION BY q.sample_id ORDER BY list_distance(q.x, t.x), t.sample_id) AS k FROM z q JOIN z t ON q.fold = t.fold AND q.own = q.fold AND t.own <> t.fold),
v AS (SELECT fold, sample_id, any_value(label) AS label, tl, count(*) AS c FROM n WHERE k <= 5 GROUP BY 1, 2, 4), p AS (SELECT fold, arg_max(tl, c * 1000 - tl) AS pred, any_value(label) AS label FROM v GROUP BY fold, sample_id)
SELECT avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n, CAST(fold AS INTEGER) AS fold FROM p GROUP BY fold""", "features")
def knn_folds(spark, sf_dir):
    """PR4"""
    rows = view(spark, sf_dir, "features")
    return N.fold_accuracy(rows, rows.select("sample_id", (F.col("sample_id") % 3).cast("int").alias("fold")), 5, 3)


def _judged(spark, sf_dir):
    return A.label_quality(A.label_issues(_probs(spark, sf_dir)).drop("quality"))


_ISSUES = _PROBS + """, lim AS (SELECT label, avg(quality) AS lim, count(*) AS n FROM q GROUP BY 1), u AS (SELECT sample_id, label, quality, unnest(probs) AS p, unnest(range(0, 10)) AS c FROM q),
s AS (SELECT sample_id, any_value(u.label) AS label, arg_max(c, p) AS sure FROM u JOIN lim ON lim.label = c WHERE p >= lim GROUP BY 1), jt AS (SELECT label, sure, count(*) AS c FROM s GROUP BY 1, 2),
qu AS (SELECT jt.label, sure, round(c / sum(c) OVER (PARTITION BY jt.label) * n) AS quota FROM jt JOIN lim USING (label)),
rk AS (SELECT sample_id, quota, row_number() OVER (PARTITION BY u.label, c ORDER BY p - quality DESC, sample_id) AS k FROM u JOIN qu ON u.label = qu.label AND u.c = qu.sure WHERE u.label <> c AND p > quality),
f AS (SELECT q.*, sample_id IN (SELECT sample_id FROM rk WHERE k <= quota) AS is_issue FROM q) """


@register(_PROBS + "SELECT sample_id, quality, 1 - quality AS issue_score, guess, max_prob FROM q")
def label_quality(spark, sf_dir):
    """PR20"""
    return A.label_quality(_probs(spark, sf_dir)).select("sample_id", "quality", "issue_score", "guess", "max_prob")


@register(_ISSUES + "SELECT sample_id, is_issue FROM f")
def label_issues(spark, sf_dir):
    """PR21"""
    return A.label_issues(_probs(spark, sf_dir)).select("sample_id", "is_issue")


@register(_ISSUES + """, w AS (SELECT label, arg_max(guess, c * 1000 - guess) AS g, max(c) AS m FROM (SELECT label, guess, count(*) AS c FROM f WHERE label <> guess GROUP BY 1, 2) GROUP BY 1),
fl AS (SELECT label, arg_max(guess, c * 1000 - guess) AS g, max(c) AS m FROM (SELECT label, guess, count(*) AS c FROM f WHERE is_issue GROUP BY 1, 2) GROUP BY 1),
st AS (SELECT c, p, count(*) AS n, count(*) FILTER (label = c) AS tp FROM u GROUP BY 1, 2), rn AS (SELECT c, tp, sum(tp) OVER o AS atp, sum(n) OVER o AS an FROM st WINDOW o AS (PARTITION BY c ORDER BY p DESC)), av AS (SELECT c AS label, sum(tp * atp / an) / sum(tp) AS ap FROM rn GROUP BY 1)
SELECT f.label, count(*) AS n, avg(CASE WHEN f.label = guess THEN 1.0 ELSE 0.0 END) AS acc, any_value(ap) AS ap, count(*) FILTER (is_issue) AS n_flagged, avg(CASE WHEN is_issue THEN 1.0 ELSE 0.0 END) AS flag_rate, coalesce(any_value(fl.g), -1) AS top_flagged, coalesce(any_value(fl.m), 0) AS top_flagged_n, coalesce(any_value(w.g), 0) AS top_confused, coalesce(any_value(w.m), 0) / count(*) AS confused_share, avg(quality) AS mean_quality
FROM f LEFT JOIN w USING (label) LEFT JOIN fl USING (label) JOIN av USING (label) GROUP BY 1""")
def class_report(spark, sf_dir):
    """AG23"""
    return A.class_report(_judged(spark, sf_dir))


@register(_ISSUES + ", w AS (SELECT sample_id % 2 AS half, label, guess, count(*) AS c FROM f WHERE is_issue AND label <> guess GROUP BY ALL), t AS (SELECT half, arg_max(label || '->' || guess || ':' || c, c * 1000000 - label * 1000 - guess) AS top_pair FROM w GROUP BY 1) SELECT half, count(*) AS n, count(*) FILTER (is_issue) AS n_flagged, avg(CASE WHEN is_issue THEN 1.0 ELSE 0.0 END) AS rate, any_value(top_pair) AS top_pair FROM (SELECT *, sample_id % 2 AS half FROM f) LEFT JOIN t USING (half) GROUP BY 1")
def audit_summary(spark, sf_dir):
    """AG25"""
    return A.audit_summary(_judged(spark, sf_dir).withColumn("half", F.col("sample_id") % 2), "half")


@register(_PROBS + "SELECT label, sample_id, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY 1 - quality DESC, sample_id) AS k FROM q) WHERE k <= 3")
def top_flagged(spark, sf_dir):
    """W11"""
    return A.top_flagged(A.label_quality(_probs(spark, sf_dir)), ("label",), 3).select("label", "sample_id", "place")


@register(_ISSUES + "SELECT label, avg(CASE WHEN is_issue THEN 1.0 ELSE 0.0 END) AS flag_rate FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def worst_classes(spark, sf_dir):
    """W12"""
    return A.worst_classes(A.class_report(_judged(spark, sf_dir)), "flag_rate", 3).select("label", "flag_rate")


_MULTI = "WITH m AS (SELECT vec_id AS sample_id, [CAST(label > 4 AS INTEGER), label % 2, CAST(label % 3 = 0 AS INTEGER)] AS labels, list_transform(embedding[1:3], lambda x: 1 / (1 + exp(-5 * CAST(x AS DOUBLE)))) AS probs FROM embeddings), u AS (SELECT sample_id, unnest(labels) AS y, unnest(probs) AS p, unnest([0, 1, 2]) AS place FROM m) "


def _multi(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    marks = F.array((F.col("label") > 4).cast("int"), F.col("label") % 2, (F.col("label") % 3 == 0).cast("int"))
    return df.select(F.col("vec_id").alias("sample_id"), marks.alias("labels"), F.transform(F.slice("embedding", 1, 3), lambda x: 1 / (1 + F.exp(-5 * x.cast("double")))).alias("probs"))


_FLAGS = _MULTI + """, q AS (SELECT *, CASE WHEN y = 1 THEN p ELSE 1 - p END AS q FROM u), lim AS (SELECT place, y AS c, avg(q) AS lim, count(*) AS n FROM q GROUP BY 1, 2),
s AS (SELECT sample_id, place, any_value(y) AS y, arg_max(c, z - c / 1e12) AS sure FROM (SELECT sample_id, q.place, y, c, CASE WHEN c = 1 THEN p ELSE 1 - p END AS z, lim FROM q JOIN lim ON q.place = lim.place) WHERE z >= lim GROUP BY 1, 2),
jt AS (SELECT place, y, count(*) AS t, count(*) FILTER (sure <> y) AS c FROM s GROUP BY 1, 2), qu AS (SELECT jt.place, y, round(jt.c / t * n) AS quota FROM jt JOIN lim ON jt.place = lim.place AND jt.y = lim.c),
rk AS (SELECT sample_id, q.place, quota, row_number() OVER (PARTITION BY q.place, q.y ORDER BY q, sample_id) AS k FROM q JOIN qu ON q.place = qu.place AND q.y = qu.y WHERE q < 0.5),
g AS (SELECT q.sample_id, q.place, q.y, q.p, q.q, coalesce(k <= quota, false) AS f FROM q LEFT JOIN rk ON q.sample_id = rk.sample_id AND q.place = rk.place) """
_JACCARD = """, a AS (SELECT place, count(*) AS n FROM u WHERE y = 1 GROUP BY 1), b AS (SELECT x.place, z.place AS other, count(*) AS c FROM u x JOIN u z ON x.sample_id = z.sample_id AND x.place <> z.place AND x.y = 1 AND z.y = 1 GROUP BY 1, 2),
j AS (SELECT b.place, other, b.c / (a.n + o.n - b.c) AS jac FROM b JOIN a ON a.place = b.place JOIN a o ON o.place = other), nl AS (SELECT p.place, coalesce(arg_max(other, jac * 1000 - other / 1e6), -1) AS nearest, coalesce(max(jac), 0) AS jaccard FROM (VALUES (0), (1), (2)) p(place) LEFT JOIN j USING (place) GROUP BY 1),
st AS (SELECT place, p, sum(y) AS tp, count(*) AS n FROM u GROUP BY 1, 2), rn AS (SELECT place, tp, sum(tp) OVER w AS atp, sum(n) OVER w AS an FROM st WINDOW w AS (PARTITION BY place ORDER BY p DESC)), ap AS (SELECT place, sum(tp * atp / an) / sum(tp) AS ap FROM rn GROUP BY 1)"""


@register(_FLAGS + "SELECT sample_id, place, y, f AS is_issue FROM g")
def multilabel_issues(spark, sf_dir):
    """PR22"""
    return A.multilabel_issues(_multi(spark, sf_dir)).select("sample_id", "place", "y", "is_issue")


@register(_FLAGS + """, o AS (SELECT sample_id, list(q ORDER BY q DESC) AS q, bool_or(f) AS is_issue, CAST(sum(y) AS INTEGER) AS n_pos_given, CAST(count(*) FILTER (p > 0.5) AS INTEGER) AS n_pos_pred FROM g GROUP BY 1)
SELECT sample_id, n_pos_given, n_pos_pred, round(1 - (0.8 * q[3] + 0.2 * (0.8 * q[2] + 0.2 * q[1])), 9) AS issue_score, is_issue FROM o""")
def multilabel_samples(spark, sf_dir):
    """PR22"""
    rows = _multi(spark, sf_dir)
    return A.multilabel_samples(rows, A.multilabel_issues(rows)).withColumn("issue_score", F.round("issue_score", 9))


@register(_FLAGS + _JACCARD + " SELECT g.place, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (p > 0.5) AS n_pred_pos, any_value(ap) AS ap, count(*) FILTER (f) AS n_flagged, avg(CASE WHEN f THEN 1.0 ELSE 0.0 END) AS flag_rate, count(*) FILTER (f AND y = 1) / greatest(count(*) FILTER (y = 1), 1) AS flag_rate_pos, count(*) FILTER (f AND y = 0) / greatest(count(*) FILTER (y = 0), 1) AS flag_rate_neg, any_value(nearest) AS nearest, any_value(jaccard) AS jaccard FROM g JOIN ap USING (place) JOIN nl USING (place) GROUP BY g.place")
def multilabel_report(spark, sf_dir):
    """AG24, PR22"""
    return A.multilabel_report(_multi(spark, sf_dir))


@register(_MULTI + ", a AS (SELECT place, count(*) AS n FROM u WHERE y = 1 GROUP BY 1), b AS (SELECT x.place, z.place AS other, count(*) AS c FROM u x JOIN u z ON x.sample_id = z.sample_id AND x.place <> z.place AND x.y = 1 AND z.y = 1 GROUP BY 1, 2), j AS (SELECT b.place, other, c / (a.n + o.n - c) AS jac FROM b JOIN a ON a.place = b.place JOIN a o ON o.place = other) SELECT p.place, coalesce(arg_max(other, jac * 1000 - other / 1e6), -1) AS nearest, coalesce(max(jac), 0) AS jaccard FROM (VALUES (0), (1), (2)) p(place) LEFT JOIN j USING (place) GROUP BY 1")
def nearest_label(spark, sf_dir):
    """J16"""
    return A.nearest_label(_multi(spark, sf_dir))


@register("SELECT hash, count(*) AS n, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets FROM (SELECT md5(concat('h', CAST(l_partkey % 40 AS VARCHAR))) AS hash, l_returnflag AS dataset FROM lineitem) GROUP BY 1 HAVING count(DISTINCT dataset) > 1")
def duplicate_groups(spark, sf_dir):
    """J17"""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return A.duplicate_groups(rows.select(F.md5(F.concat(F.lit("h"), (F.col("l_partkey") % 40).cast("string"))).alias("hash"), F.col("l_returnflag").alias("dataset")))


@register("WITH c AS (SELECT hash, dataset, split, count(*) AS n FROM duplicates GROUP BY ALL) SELECT a.dataset AS train_set, b.dataset AS test_set, count(*) AS hashes, CAST(sum(a.n) AS BIGINT) AS train_rows, CAST(sum(b.n) AS BIGINT) AS test_rows FROM c a JOIN c b ON a.hash = b.hash AND a.split = 'train' AND b.split = 'test' GROUP BY 1, 2", "duplicates")
def split_leaks(spark, sf_dir):
    """J18"""
    return A.leaks(view(spark, sf_dir, "duplicates"))
