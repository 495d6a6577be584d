"""The stages of the pipeline and the queries on tables with odd rows: nulls in any column, empty and very long texts, ties, repeated rows, clashing names, no rows (of the pipeline; the operators' own tests have empty tables)."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

EXTRA = ("row", "id", "t", "i", "u", "lines", "size", "shard", "key", "rep", "component", "_shard", "h1", "digest", "words", "term", "host")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _rows() -> list[tuple]:
    """(doc_id, text, lang, source) of 60 plain documents and of the odd ones."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    plain = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(n))
    rows = [(k, plain(4), "en", f"s{k % 3}") for k in range(60)]
    rows += [(k + 100, rows[k][1], "de", None) for k in range(5)]  # copies under other ids
    rows += [rows[7]] * 3  # repeated rows
    rows += [(8, plain(4), None, "s1")]  # a tie: one id, two texts
    rows += [(None, plain(4), "en", "s0"), (None, None, None, None), (200, None, "en", "s1"), (201, "", "en", "s1"), (202, " \n\t\r\n ", None, "s2")]
    rows += [(300, plain(6000), "en", "s2"), (301, "x" * 400_000, "en", "s2"), (302, "\n" * 50_000 + plain(4), "en", None), (303, plain(4).replace(" ", " \U0001f600 "), "fr", "")]
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in _rows()], "doc_id long, text string, lang string, source string, n_chars long")
    clashing = lambda df: df.select("*", *(F.lit(c).alias(c) for c in EXTRA if c not in df.columns))
    clashing(docs).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, None if k % 7 == 0 else k % 2, 0) for k in range(0, 60, 2)] + [(None, 1, None), (8, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    first = _rows()[0][1]
    items = [(1, first[:200]), (2, None), (3, ""), (4, first[:20]), (4, first[:20]), (None, first[:90]), (5, "nowhere zzqq")]
    clashing(spark.createDataFrame(items, "item_id long, text string")).write.parquet(f"{at}/benchmark.parquet")
    page = "<html><body><div class='nav'>menu</div><p>one &amp; two</p><article><p>main text</p></article></body></html>"
    pages = [(1, "http://a.net/x", page), (2, None, page), (3, "http://a.net/y", None), (4, "", ""), (None, "http://b.org/fr/1", page), (1, "http://a.net/x", page), (5, "no scheme", "<p>" * 30_000 + "deep"), (6, "http://", "<" * 50_000)]
    clashing(spark.createDataFrame(pages, "page_id long, url string, html string")).write.parquet(f"{at}/pages.parquet")
    vectors = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (8, [0.0, 1.0], 2)]
    clashing(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")).write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def _empty(spark, odd, path):
    for name in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _sha(text) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    for name in ("quality_rules", "line_dedup", "near_dedup", "source_mixing"):  # each on the odd rows themselves
        stages[name](spark, docs, odd).write.parquet(f"{tmp_path}/{name}")
    got = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in ("quality_rules", "line_dedup", "near_dedup", "source_mixing")}
    assert all(df.columns == docs.columns for df in got.values())
    out = {name: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr) for name, df in got.items()}
    assert {r.row for r in got["source_mixing"].select("row").distinct().collect()} == {"row"}

    # the rules judge by the text alone, so equal texts fare alike; texts of under ten words go
    kept = out["quality_rules"]
    assert all(len(WORD.findall(t or "")) >= 10 for _, t in kept) and {t for _, t in kept} <= {t for _, t in rows}
    assert sum(t == rows_text for _, t in kept for rows_text in [_rows()[7][1]]) in (0, 4)

    # every row stays, a null text null; of equal lines the first one's document keeps it
    lined = out["line_dedup"]
    assert len(lined) == len(rows) and sorted(map(repr, (i for i, _ in lined))) == sorted(map(repr, (i for i, _ in rows)))
    assert sum(t is None for _, t in lined) == sum(t is None for _, t in rows)
    texts = {i: t for i, t in lined if i is not None and i != 8}
    assert texts[7] == _rows()[7][1] and all(not WORD.search(texts[k + 100]) for k in range(5)) and len(texts[300]) > 300_000 and texts[301] == "x" * 400_000

    # repeated rows and copies become one; null ids stay; no text without a word
    near = out["near_dedup"]
    assert len(set(near)) == len(near) and {i for i, _ in near if i is not None} == {*range(60), 300, 301, 302, 303} and sum(i is None for i, _ in near) == 1
    assert sum(i == 8 for i, _ in near) == 2

    # the mix holds whole documents, at most twice each row
    mixed, times = out["source_mixing"], {}
    for r in rows:
        times[r] = times.get(r, 0) + 2
    assert set(mixed) <= set(rows) and all(mixed.count(r) <= times[r] for r in set(mixed)) and all(WORD.search(t or "") for _, t in mixed)

    ids = stages["byte_bpe"](spark, docs, odd).collect()
    assert sorted((repr(r.doc_id), r.decoded_sha256) for r in ids) == sorted((repr(i), _sha(t)) for i, t in rows)
    assert {r.n_tokens for r in ids if r.decoded_sha256 == _sha("")} == {0}


def test_pipeline_on_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, odd).count() > 30
    empty = _empty(spark, odd, tmp_path)
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_queries_on_odd_rows(spark, odd):
    from probeloom.llm.queries import QUERIES

    tables = {"op3": "pages", "op7": "pages", "op4": "embeddings", "op12": "benchmark"}
    for name, query in QUERIES.items():
        got, table = query(spark, odd).collect(), tables.get(name.split("_")[0], "documents")
        if table != "benchmark":
            assert len(got) == spark.read.parquet(f"{odd}/{table}.parquet").count(), name
