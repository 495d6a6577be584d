"""Views of the given tables in the shapes that the operators take; the SQL means the same in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "results": """SELECT concat('m', CAST(l_suppkey % 7 AS STRING)) AS name, concat('d', CAST(l_partkey % 5 AS STRING)) AS dataset,
        CASE WHEN l_linenumber % 2 = 0 THEN 'knn5' ELSE 'linear' END AS method, CASE WHEN l_returnflag = 'R' THEN 'model_native' ELSE 'bandspec_zscore' END AS normalization,
        CASE WHEN l_linestatus = 'O' THEN 'rgb' ELSE 'all' END AS bands, CASE WHEN l_orderkey % 2 = 0 THEN '224' ELSE ' 224.0' END AS image_size, CAST(l_linenumber % 3 AS INT) AS seed,
        CASE WHEN l_orderkey % 3 = 0 THEN '' WHEN l_orderkey % 17 = 0 THEN NULL ELSE concat('h', CAST(l_orderkey % 11 AS STRING)) END AS config_hash, 'accuracy' AS metric_name,
        CAST(l_discount AS DOUBLE) * 5 + CAST(l_tax AS DOUBLE) AS metric_value, ((CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS append_seq FROM {lineitem}""",
    "scores": """SELECT concat('m', CAST(o_custkey % 6 AS STRING)) AS model_name, CASE o_orderkey % 8 WHEN 0 THEN 'income' WHEN 1 THEN 'population' WHEN 2 THEN 'air_temp' WHEN 3 THEN 'elevation' WHEN 4 THEN 'landcover' WHEN 5 THEN 'ecoregion' WHEN 6 THEN 'odd' ELSE 'crop' END AS dataset,
        CASE o_orderkey % 3 WHEN 0 THEN 'random' WHEN 1 THEN 'spatial' ELSE 'official' END AS split, CASE WHEN o_orderkey % 8 < 4 THEN 'r2' ELSE 'accuracy' END AS metric_name,
        CASE WHEN o_orderkey % 19 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(o_totalprice AS DOUBLE) / 250000 - 1.5 END AS metric_value FROM {orders}""",
    "families": "SELECT * FROM (VALUES ('income', 'socio'), ('population', 'socio'), ('air_temp', 'env'), ('elevation', 'env'), ('landcover', 'land'), ('ecoregion', 'land'), ('crop', 'land')) AS f(dataset, family)",
    "board": """SELECT concat('m', CAST(o_custkey % 9 AS STRING)) AS model, concat('d', CAST(o_orderkey % 8 AS STRING)) AS dataset, round(avg(CAST(o_totalprice AS DOUBLE)) / 300000, 3) AS score FROM {orders} GROUP BY 1, 2""",
    "points": """SELECT c_custkey AS row_id, CAST(c_custkey * 137 % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST(c_custkey * 89 % 18000 AS DOUBLE) / 100 - 90 AS lat, CAST(c_acctbal AS DOUBLE) AS y_num, c_mktsegment AS y_cls, c_nationkey AS country, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 2015 + c_custkey % 8 END AS year FROM {customer}""",
    "features": """SELECT vec_id AS sample_id, embedding AS features, label, CASE vec_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split FROM {embeddings}""",
    "judged": """SELECT l_orderkey * 8 + l_linenumber AS sample_id, CAST(l_partkey % 5 AS INT) AS label, CAST((l_partkey + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END) % 5 AS INT) AS pred, CAST(l_discount AS DOUBLE) * 5 + CAST(l_quantity AS DOUBLE) / 100 AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS positive, concat('c', CAST(l_suppkey % 4 AS STRING)) AS class FROM {lineitem}""",
    "confusions": """SELECT l_orderkey AS image_id, CAST(l_partkey % 4 AS INT) AS t, CAST(CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 4 ELSE l_partkey % 4 END AS INT) AS p, CAST(l_quantity AS BIGINT) AS n FROM {lineitem}""",
    "duplicates": """SELECT doc_id AS sample_id, lang AS dataset, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, md5(text) AS hash FROM {documents}""",
    "events_log": """SELECT event_id AS seq, user_id AS job_id, event_type AS event, concat('log_', CAST(event_id AS STRING)) AS log FROM {events}""",
    "jobs": """SELECT event_id AS job_id, value AS seconds, event_id % 10 <> 3 AS ok FROM {events}""",
    "costs": """SELECT concat('s', CAST(s_suppkey AS STRING)) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 's2' ELSE 'rgb' END AS band_config, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_acctbal AS DOUBLE) END AS gflops, CAST(s_nationkey AS DOUBLE) AS params FROM {supplier}""",
    "tiles": """SELECT vec_id AS sample_id, label, vec_id % 5 AS fold, embedding AS px FROM {embeddings}""",
}
_TABLE = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_TABLE.findall(sql))})


def oracle(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views as common table expressions before ``sql`` (which may begin with more of them)."""
    if not names:
        return sql
    views = ", ".join(f"{n} AS ({_TABLE.sub(r'\1', VIEWS[n])})" for n in names)
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {sql[15:]}"
    return f"WITH {views}{', ' + sql[5:] if sql.startswith('WITH ') else ' ' + sql}"
