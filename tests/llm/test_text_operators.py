"""Operators 1, 2 and 5 against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probeloom.llm import bpe, mixing, quality

WORD = re.compile("[^\x20\x09-\x0d]+")
HARD = [None, "", " ", "\n", "a", "a b c d e", "a b c d e a b c d e", "x\nx\n\nx\n \n", "é ü\x85z q\x1cw", "w " * 5000, "ab\r\nab\r\n", "#*$ %&|<> 12 Ab.", "a b c d e f\na b c d e f"]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


def test_measure_is_brute_force():
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(200))) for _ in range(300)]
    m = quality.measure(pa.array(texts, pa.string()))
    assert np.column_stack([m[k] for k in quality.STATS]).tolist() == [brute(t) for t in texts]


def test_trees_are_monotone_and_accurate():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = (x[:, 2] + 0.3 * x[:, 0] + 0.05 * rng.standard_normal(4000) < 0.6).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    grid = np.repeat(rng.random((50, x.shape[1])), 20, axis=0)
    grid[:, 2] = np.tile(np.linspace(0, 1, 20), 50)
    assert (np.diff(model.score(grid).reshape(50, 20), axis=1) <= 1e-12).all()


def test_quality_on_held_out_rows_and_odd_tables(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    held = quality.judge(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good = held[(held.quality == 1) & ~held.base_failed]
    assert good.kept.mean() > 0.99 and held[held.quality == 0].kept.mean() < 0.05
    odd = spark.createDataFrame([(i, t, True) for i, t in enumerate(HARD)] + [(None, "a b", None)], "doc_id long, text string, kept boolean")
    assert quality.judge(odd, None).count() == len(HARD) + 1
    assert quality.keep_good(odd, None).columns == odd.columns
    assert quality.judge(odd.limit(0), model).count() == 0
    assert quality.train(odd, labels.limit(0)) is None


def test_training_takes_a_document_for_each_label(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)) or quality.Trees(*(np.zeros((1, 1)) for _ in range(3)), 0.0))
    monkeypatch.setattr(quality.Trees, "score", lambda self, x: np.zeros(len(x)))
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["a", "bc", "def"]) for _ in range(30))) for k in range(40)]
    labels = spark.createDataFrame([(k, float(k % 2)) for k in range(400)], "doc_id long, quality double")  # 360 without a document
    copies = rows + [rows[7]] * 300 + [(9, f"other {k}") for k in range(300)]
    for limit, n in ((1000, 40), (40, 40), (25, 25)):
        seen.clear()
        quality.train(spark.createDataFrame(copies, "doc_id long, text string"), labels, rows=limit)
        assert len(seen[-1][1]) == n
    seen.clear()
    for some in (rows, rows + [rows[7]] * 300):
        quality.train(spark.createDataFrame(some, "doc_id long, text string"), labels)
    assert np.array_equal(seen[1][0], seen[3][0]) and np.array_equal(seen[1][1], seen[3][1])


@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN


def test_bpe_equals_the_library(vocabulary):
    import tiktoken

    ranks, pattern = vocabulary
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks)
    packed, rng = bpe._Packed(codec), random.Random(3)
    texts = [t or "" for t in HARD] + ["".join(chr(rng.choice([*range(32, 127), *range(9, 14), 28, 133, 160, 0xE9, 0x4E2D, 0x1F600, 0x3042, 0x0939])) for _ in range(rng.randrange(120))) for _ in range(1500)]
    texts += ["".join(rng.choice(["the", "er", "a", "aa", "ing", "tion"]) for _ in range(40)) for _ in range(300)] + ["a" * 3000, "ab" * 1500]
    for t in texts:
        ids = bpe._pack(t, bpe._pattern(pattern), packed)
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t.encode()


def test_bpe_tables(spark, vocabulary):
    ranks, pattern = vocabulary
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(HARD)], "doc_id long, text string, ids binary")
    rows = bpe.round_trip(docs, ranks, pattern).toPandas().set_index("doc_id")
    assert [rows.decoded_sha256[i] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(HARD)] == [True] * len(HARD)
    assert rows.n_tokens[0] == 0
    assert bpe.round_trip(docs.limit(0), ranks, pattern).count() == 0


def test_targets_and_tree():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    got = mixing.split_blocks([1000, 10, 0, 333], 7, 5)
    assert got.sum(0).tolist() == [1000, 10, 0, 333] and np.ptp(got.sum(1)) <= 1
    assert (got == mixing.split_blocks([1000, 10, 0, 333], 7, 5)).all()
    assert mixing.targets([], [], 1.5) == []


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(60))), rng.choice(["a", "b", None, "c", "hot", "hot", "hot"]), 0) for i in range(800)]
    rows += [(1, None, "a", 0), (1, None, "a", 0), (None, "x y z", "b", 0), (5, "x " * 3000, "hot", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    planned = mixing.plan(docs, block_words=64, shards=8, carry=True).cache()
    got = planned.toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all() and got["size"].sum() == sum(len((r[1] or "").split()) for r in rows)
    for _, part in got.groupby(["source_size", "target"]):
        assert part.taken.sum() == round(part.target.iloc[0])
    mix = mixing.materialise(planned)
    assert mix.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mix.collect()) == got.taken.sum()
    again = mixing.plan(docs.repartition(7), block_words=64, shards=8, carry=True).toPandas()
    key = lambda x: sorted(map(str, zip(x.doc_id.fillna(-1), x["size"], x.taken)))
    assert key(got) == key(again)
    assert mixing.plan(docs.limit(0)).count() == 0
