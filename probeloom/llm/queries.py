"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeloom.llm import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from probeloom.llm import bpe

    return bpe.round_trip(_table(spark, sf_dir, "documents"), bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN, ids=False)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from probeloom.llm import mixing

    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda total, d: total + d["words"])
    shards = F.concat_ws(",", F.transform("draws", lambda d: d["shard"].cast("string")))
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeloom.llm import urls

    return urls.judge(_table(spark, sf_dir, "pages"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeloom.llm import licenses

    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeloom.llm import html

    return html.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeloom.llm import neardup

    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from probeloom.llm import suffixes

    rows = suffixes.remove_repeated(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "shared_passage")


def op4_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeloom.llm import vectors

    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeloom.llm import lines

    return lines.judge(_table(spark, sf_dir, "documents"), short=True)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeloom.llm import postings

    return postings.digest(postings.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeloom.llm import ranked

    return ranked.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeloom.llm import runs

    return runs.digest(runs.find(runs.with_loops(_table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_byte_bpe, op3_url_filters, op4_vector_near_dedup, op5_source_mixing, op6_license_scans, op7_html_extraction, op8_superminhash, op9_repeated_windows, op10_line_edit_join, op11_decontamination, op12_ranked_search, op13_periodic_runs)}


def _oracles() -> dict[str, str]:
    from probeloom.llm import licenses, postings, ranked, urls, vectors

    return {"op3_url_filters": urls.oracle(), "op4_vector_near_dedup": vectors.ORACLE, "op6_license_scans": licenses.oracle(), "op11_decontamination": postings.ORACLE, "op12_ranked_search": ranked.ORACLE}


ORACLES = _oracles()
