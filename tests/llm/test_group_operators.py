"""Operators 4, 8, 9 and 10 against brute force on small tables with nulls, repeats, ties and long texts."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probeloom.llm import lines, neardup, scratch, suffixes, vectors

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n int"


def corpus(seed=4, n=60):
    """Random texts with copies, near copies, shared passages and lines, empty texts, a null and a repeated row."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    texts, passage = [], " ".join(words(120))
    common = " ".join(words(14))
    for k in range(n):
        base = words(rng.choice([0, 1, 3, 5, 40, 120, 200]))
        text = " ".join(w if i % 13 else w + "\n" for i, w in enumerate(base))
        if k % 6 == 0:
            text += f"\n{common}\n{passage}"
        texts.append(text)
    for k in range(40):
        near = list(re.split(r"( |\n)", texts[4]))
        near[2 * rng.randrange(len(near) // 2)] = "X"
        texts.append("".join(near))
    line = rng.choice([x for t in texts for x in t.split("\n") if len(x) >= 50])
    texts += [texts[0], texts[0], texts[4].upper(), f"{line}!\n{line[:20]}{line[21:]}x\n{line}", "y " * 4000, " ".join(words(6000))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(500, None), (501, ""), (502, " \n "), (2, texts[2])]
    return [(i, t, "en", "s", len(t or ""), True, 1) for i, t in rows]


def components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_near_duplicates(spark, monkeypatch):
    rows = corpus()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(text):
        w = WORD.findall((text or "").translate(fold))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(r[0], shingles(r[1])) for r in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    want = components({i for i, _ in sets}, links)
    docs = spark.createDataFrame(rows + [(None, "a b c", "en", "s", 5, True, 1)], SCHEMA)
    for tile in (256, 7):  # 7: clusters of many tiles, with pivots and outer tiles
        monkeypatch.setattr(neardup, "TILE_ROWS", tile)
        got = neardup.near_duplicates(docs).toPandas()
        assert len(got) == len(rows) + 1
        assert all(want[int(i)] == c for i, c in zip(got.doc_id, got.component_id) if i == i)
        assert sorted(got.n_shingles.tolist()) == sorted([len(s) for _, s in sets] + [1])
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({i for i, c in want.items() if i == c})
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_links_from_80(spark, tmp_path):
    import corpus_pipeline

    for link in (neardup.CONTRACT, neardup.CORPUS):
        assert (1 - (link.numerator / link.denominator) ** link.rows) ** link.bands < 2.5e-6 and link.bands * link.rows <= neardup.SLOTS
    rng = random.Random(6)
    rows, kept, links = [], set(), 0
    for k in range(60):  # a text and its tail cut: similarity exactly small / large
        large = 100
        small = (79, 80, 82, 84, 85)[k % 5]
        base = [f"{k}x{rng.randrange(10**6)}" for _ in range(large + 4)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: small + 4]))]
        kept |= {2 * k} | ({2 * k + 1} if small < 80 else set())
        links += small >= 85
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), True, 1) for i, t in rows], SCHEMA)
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(kept)
    assert neardup.keep_one(docs).count() == len(rows) - links


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for share in (0.5, 0.85):
        k = int(400 * share)
        keys = np.concatenate([np.sort(base), np.sort(np.concatenate([base[:k], rng.integers(0, 2**63, 400 - k, dtype=np.uint64)]))])
        a, b = neardup.signatures(keys, np.array([0, 400, 800]))
        assert abs((a == b).mean() - k / (800 - k)) < 0.12
    one = neardup.signatures(base[:1], np.array([0, 1, 1]))
    assert (one[0] < 2**64 - 1).all() and (one[1] == 2**64 - 1).all()


def test_chained_buckets_keep_every_tie():
    import pyarrow as pa

    rows = np.array([(7, 100 + i // 50, i, 0, 0, 0) for i in range(3000)] + [(8, 10, 5, 0, 0, 0), (9, 10, 6, 0, 0, 0), (9, 11, 7, 0, 0, 0)], np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(part[:, k]) for k in range(6)], names=list("kncxyz")) for part in np.array_split(rows, 9)]
    pairs = [p for b in neardup._tied(iter(batches)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    got = components(range(3000), [p for p in pairs if max(p) < 3000])
    assert set(got.values()) == {0} and (6, 7) in pairs


def test_line_edit_join(spark):
    rng = random.Random(5)
    for _ in range(3000):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12)))
        b = bytearray(a)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = bytes(rng.choice(b"abc") for _ in range(rng.randrange(2)))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert [lines.within_edits(a, bytes(b), e) for e in (1, 2, 3)] == [row[-1] <= e for e in (1, 2, 3)]
    rows = corpus(8)
    found = collections.defaultdict(list)
    for i, t in sorted({(r[0], r[1]) for r in rows if r[1]}):
        for k, x in enumerate(t.split("\n")):
            if len(x.encode()) >= lines.MIN_BYTES:
                found[x.encode()].append((i, k))
    every = sorted(found)
    group = components(every, [(x, y) for k, x in enumerate(every) for y in every[:k] if lines.within_edits(x, y, lines.EDITS)])
    lost = collections.defaultdict(set)
    for c in set(group.values()):
        for i, k in sorted(o for x in every if group[x] == c for o in found[x])[1:]:
            lost[i].add(k)
    assert any(group[x] != x for x in every)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lines.judge(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.removed == ",".join(map(str, sorted(lost[r.doc_id]))) and r.n_removed == len(lost[r.doc_id])
    texts = dict((r[0], r[1]) for r in rows)
    after = lines.remove_lines(docs)
    assert after.columns == docs.columns
    for r in after.collect():
        want = texts[r.doc_id]
        want = want and "\n".join(x for k, x in enumerate(want.split("\n")) if k not in lost[r.doc_id])
        assert r.text == want and (want is None or r.n_chars == len(want))
    assert lines.judge(docs.limit(0)).count() == 0


def test_line_dedup_gets_texts_in_small_batches(spark, monkeypatch):
    docs = spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.md5(F.col("id").cast("string")), 125).alias("text"))
    seen, found = [], lines.occurrences

    def _batch_sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    def spied(named, short=False):
        seen.extend(named.select("text").mapInArrow(_batch_sizes, "rows long, bytes long").collect())
        return found(named, short)

    monkeypatch.setattr(lines, "occurrences", spied)
    before = spark.conf.get(scratch.BATCH, None)
    lines.removed_lines(docs, short=True)
    assert sum(r.rows for r in seen) == 1500 and max(r.bytes for r in seen) < 1.1 * scratch.BATCH_BYTES
    assert spark.conf.get(scratch.BATCH, None) == before


def test_pipeline_stages_set_small_batches(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "one line", "en", "a", 8)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {key: spark.conf.get(key, None) for key in (scratch.BATCH, corpus_pipeline.BATCHES)}
    try:
        corpus_pipeline.line_dedup(spark, docs, "")
        assert int(spark.conf.get(scratch.BATCH).rstrip("b")) == scratch.BATCH_BYTES
    finally:
        for key, value in kept.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_short_lines(spark, tmp_path):
    import corpus_pipeline
    from probeloom.llm.queries import QUERIES

    rng = random.Random(9)
    planted = ["ok", "}", "Released under the MIT License.", " ", "", "é" * 15]
    for n in (29, 31, 32, 33, 40, 46, 47, 48, 49, 50):
        line = "".join(rng.choice("abcdef ghij") for _ in range(n - 1)) + "k"
        planted += [line, line, "z" + line[1:], line + "!", line[:-1], "zz" + line[2:], line[2:], "zzz" + line[3:]]
    rng.shuffle(planted)
    rows = corpus(8) + [(600 + k, "\n".join(planted[k::7]), "en", "s", 1, True, 1) for k in range(7)]
    rows += [(700 + k, "Released under the MIT License.\n \nok", "en", "s", 1, True, 1) for k in range(3)]
    found = collections.defaultdict(list)
    for i, t in sorted({(r[0], r[1]) for r in rows if r[1]}):
        for k, x in enumerate(t.split("\n")):
            if len(x.encode()) >= 48 or WORD.search(x):
                found[x.encode()].append((i, k))
    every = sorted(found)
    edits = lambda n: 2 if n >= 48 else 1 if n >= 32 else 0
    group = components(every, [(x, y) for k, x in enumerate(every) for y in every[:k] if lines.within_edits(x, y, edits(min(len(x), len(y))))])
    lost = collections.defaultdict(set)
    for c in set(group.values()):
        for i, k in sorted(o for x in every if group[x] == c for o in found[x])[1:]:
            lost[i].add(k)
    assert lost[701] == lost[702] == {0, 2} and any(group[x] != x and len(x) < 48 for x in every)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_line_edit_join"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.removed == ",".join(map(str, sorted(lost[r.doc_id])))
    texts = dict((r[0], r[1]) for r in rows)
    for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect():
        want = texts[r.doc_id]
        assert r.text == (want and "\n".join(x for k, x in enumerate(want.split("\n")) if k not in lost[r.doc_id]))


@pytest.mark.parametrize("limit", [8192, 2])  # 2: all classes by the shuffle
def test_repeated_windows(spark, limit):
    rows = corpus(11) + [(900, "é" * 450, "", "", 0, True, 0), (901, "z" + "é" * 430, "", "", 0, True, 0), (902, "q" * 1000, "", "", 0, True, 0)]
    data = [(r[1] or "").encode() for r in rows]
    hits = suffixes.brute(data)
    want = collections.Counter()
    for r, t, h in zip(rows, data, hits):
        kept = bytes(b for b, x in zip(t, h) if not x)
        runs = sum(x and not y for x, y in zip(h, [False, *h]))
        want[r[0], len(t), sum(h), runs, hashlib.sha256(kept).hexdigest()] += 1
    docs = spark.createDataFrame(rows, SCHEMA)
    got = suffixes.remove_repeated(docs, limit).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == want
    assert suffixes.remove_repeated(docs.limit(0)).count() == 0


def test_sieve(spark):
    from probeloom.llm.sieve import sieve

    rows = spark.range(5000).selectExpr("id * 7 AS k", "id AS v")
    assert {r.k for r in sieve(rows, "k", spark.range(0, 35000, 70), "id").collect()} >= set(range(0, 35000, 70))
    assert sieve(rows, "k", spark.range(0, 35000, 70), "id").count() < 600 and sieve(rows, "k", spark.range(0), "id").count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 12))
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(base)]
    rows += [(100 + k, (base[k % 5] + 0.08 * rng.standard_normal(12)).tolist(), k % 5 % 3) for k in range(60)]
    rows += [(200, base[0].tolist(), 0), (0, base[0].tolist(), 0), (201, None, 0), (202, [0.0] * 12, 0), (203, [float("nan")] + [1.0] * 11, 0), (204, base[0].tolist(), None), (205, [], 0), (206, [1.0, None], 0), (207, [1.0, 2.0], 0), (208, [1e200, 2e200], 0), (209, (1e-3 * base[0]).tolist(), 0), (None, base[0].tolist(), 0)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, kept int")
    sound = [(k, r) for k, r in enumerate(rows) if r[0] is not None and r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    unit = {k: np.array(r[1]) / max(map(abs, r[1])) / np.linalg.norm(np.array(r[1]) / max(map(abs, r[1]))) for k, r in sound}
    links = [(i, j) for i, a in sound for j, b in sound if i != j and a[2] == b[2] and len(a[1]) == len(b[1]) and unit[i] @ unit[j] >= 0.98]
    group = components({r[0] for r in rows if r[0] is not None}, [(rows[i][0], rows[j][0]) for i, j in links])
    want = collections.Counter((r[0], sum(i == k for i, _ in links), group.get(r[0]), group.get(r[0]) in (r[0], None)) for k, r in enumerate(rows))
    for tile in (768, 4, 1):  # 4 and 1: a grid over more components
        got = vectors.near_vectors(docs, tile=tile).collect()
        assert collections.Counter(map(tuple, got)) == want
    assert vectors.near_vectors(docs.limit(0)).count() == 0


def test_shared_passages(spark, monkeypatch):
    from probeloom.llm import hot

    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [words(n) for n in (20, 29, 49, 50, 51, 60, 90)]
    rows = [(k, " ".join([*words(rng.randrange(40)), *passages[k % 7], *words(rng.randrange(40))])) for k in range(56)]
    rows += [(100, " ".join(words(300))), (101, None), (102, ""), (103, " ".join(passages[5])), (104, " ".join(passages[5])), (105, "w " * 400)]
    tokens = [WORD.findall(t or "") for _, t in rows]
    runs = [{tuple(w[i : i + 50]) for i in range(len(w) - 49)} for w in tokens]
    short = [{tuple(w[i : i + 30]) for i in range(len(w) - 29)} for w in tokens]
    must = {rows[i][0] for i in range(len(rows)) if any(runs[i] & runs[j] for j in range(len(rows)) if i != j)}
    may = {rows[i][0] for i in range(len(rows)) if any(short[i] & short[j] for j in range(len(rows)) if i != j)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (hot.SHARE, 0.0):  # 0: every fingerprint that occurs twice in the sample is hot
        monkeypatch.setattr(hot, "SHARE", share)
        got = {r.doc_id for r in suffixes.remove_repeated(docs).where("shared_passage").collect()}
        assert must <= got <= may and must and 100 not in got and 105 not in got


def test_hot_keys_give_the_same_result(spark, monkeypatch):
    from probeloom.llm import hot

    rows = corpus(13)
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda got: sorted(map(str, got.collect()))
    want = key(suffixes.remove_repeated(docs)), key(lines.judge(docs, short=True))
    monkeypatch.setattr(hot, "SHARE", 0.0)
    assert (key(suffixes.remove_repeated(docs)), key(lines.judge(docs, short=True))) == want


def test_clashing_names(spark):
    from probeloom.llm import mixing

    names = ["doc_id", "text", "source", "_shard", "_turn", "_cut", "_i", "_u", "lines", "row", "shard", "size", "n_chars"]
    rows = [(k, f"line {k % 3} of some text that is long enough to count as one\nown {k} words here", "s", *(str(k) for _ in range(9)), k) for k in range(12)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    mixed = mixing.materialise(mixing.plan(docs, carry=True, whole=True))
    assert mixed.columns == names and mixed.count() == 18
    assert neardup.keep_one(docs).columns == names and neardup.keep_one(docs).count() == 12
    out = lines.remove_lines(docs)
    assert out.columns == names and sorted(r._i for r in out.collect()) == sorted(map(str, range(12)))
