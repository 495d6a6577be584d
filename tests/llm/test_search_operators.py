"""Operators 11, 12 and 13 against brute force on small tables with nulls, repeats, ties and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from probeloom.llm import postings, ranked, runs

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, item_id string, pos int, n int, w string, start int"  # names that the operators use themselves


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 7, "y", 7) for i, t in rows], SCHEMA)


def texts(seed=1):
    """Items and documents with planted phrases, repeats of words, edges, nulls, repeated rows and odd characters."""
    rng = random.Random(seed)
    names = ["a", "the", "É", "ünd", "x1", "9", "straße", "İ", "中文", "Ａ", "q r"] + [f"w{k}" for k in range(60)]
    some = lambda k: rng.choices(names, [30, 20] + [2] * 69, k=k)
    items = [" ".join(some(k)) for k in (1, 2, 3, 9, 10, 11, 25, 40)] + [None, "", "...", "a a a a a a a a a a a a", "the THE the"]
    items = [(k, t) for k, t in enumerate(items)] + [(None, " ".join(some(12))), (6, " ".join(some(15))), (4, items[4])]
    docs = []
    for k in range(40):
        parts = some(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            item = words(rng.choice(items)[1])
            cut = rng.randrange(len(item) + 1)
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = item[cut:] if rng.random() < 0.5 else item
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in parts)))
    docs += [(50, None), (51, ""), (52, " .\x00- "), (None, docs[3][1]), (3, docs[3][1]), (4, docs[5][1]), (None, None), (53, "a " * 3000), (54, f"!{items[7][1]}?")]
    return docs, items


def test_exact_and_proximity_matches(spark, monkeypatch):
    docs, items = texts()
    phrases = lambda text, width: {tuple(w[i : i + width]) for w in [words(text)] if w for i in range(max(1, len(w) - width + 1))}
    for width, slop, limits in ((10, 0, None), (3, 0, 1), (4, 1, None)):
        if limits:  # beyond these sizes nothing is broadcast
            for name in ("MAX_TERMS", "MAX_PHRASES", "MAX_DOCUMENTS"):
                monkeypatch.setattr(postings, name, limits)
        else:
            monkeypatch.undo()

        def expected(row):
            ws = words(row[1])
            hit, found = set(), set()
            places = {}
            for k, w in enumerate(ws):
                places.setdefault(w, set()).add(k)
            for item, text in items:
                for p in phrases(text, width):
                    starts = {k - i + d for i, w in enumerate(p[:1]) for k in places.get(w, ()) for d in range(-slop, slop + 1)}
                    for s in starts:
                        if s >= 0 and all(any(s + i + d in places.get(w, ()) for d in range(-slop, slop + 1)) for i, w in enumerate(p)):
                            hit |= {k for k in range(s, s + len(p))}
                            found |= {str(item)} if item is not None else set()
            return row[0], len(ws), len(hit), len(found), ",".join(sorted(found))

        got = postings.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), width, slop).collect()
        key = lambda r: (r[0] is None, r)
        got = sorted((tuple(r[:4]) + (",".join(r[4]),) for r in got), key=lambda r: (str(r[0]), r[1:]))
        assert got == sorted((expected(r) for r in docs), key=lambda r: (str(r[0]), r[1:])), (width, slop)
        assert sum(r[2] > 0 for r in got) > 5
    out = postings.digest(postings.decontaminate(table(spark, []), spark.createDataFrame(items, "item_id long, text string")))
    assert out.count() == 0 and out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    out = postings.digest(postings.decontaminate(table(spark, docs), spark.createDataFrame([], "item_id long, text string")))
    assert out.where("contaminated").count() == 0 and out.count() == len(docs)
    with pytest.raises(ValueError):
        postings.phrases(table(spark, docs), 0)


def test_decontamination_runs_no_python(spark):
    docs, items = texts()
    out = postings.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_ranked_search(spark):
    docs, items = texts(2)
    rows = [words(t) for _, t in docs]
    n_docs, n_terms = sum(1 for w in rows if w), sum(map(len, rows))
    df = Counter(t for w in rows for t in set(w))

    def expected(text, k):
        out = []
        for (doc, _), ws in zip(docs, rows, strict=True):
            if ws:
                m, tf = 100 - 25 + (25 * len(ws) * n_docs) // n_terms, Counter(ws)
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in words(text))
                if score > 0:
                    out.append((-score, doc is None, doc or 0, doc))
        return [(k + 1, d[3], -d[0]) for k, d in enumerate(sorted(out)[:k])]

    for k, shard, most in ((20, 4_000_000, 500_000), (3, 200, 500_000), (20, 50, 60)):
        out = ranked.rank(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), k, shard, most)
        got = sorted(map(tuple, out.collect()), key=repr)
        assert got == sorted(((i, *x) for i, t in items for x in expected(t, k)), key=repr), (k, shard, most)
    for d, q in (([], items), (docs, []), (docs, [(1, None), (2, "...")])):
        out = ranked.rank(table(spark, d), spark.createDataFrame(q, "item_id long, text string"))
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_are_the_best_cut():
    """The dynamic programme against a plain one over all cuts; no list at all, lists of one unit and lists beyond the longest block."""
    rng = np.random.default_rng(5)
    lists = [rng.integers(1, 1000, n) for n in (1, 3, 4, 5, 40, 200, 0, 17)] + [np.full(300, 7)]
    offs = np.cumsum([0, *map(len, lists)])
    ends, blocks = ranked.cut_blocks(np.concatenate(lists), offs)
    at = 0
    for values, n, begin in zip(lists, blocks, offs, strict=False):
        units = [values[i : i + ranked.UNIT] for i in range(0, len(values), ranked.UNIT)]
        price = lambda a, b: sum(map(len, units[a:b])) * max(int(u.max()) for u in units[a:b]) + ranked.COST * int(values.max())
        least = [0.0]
        for b in range(1, len(units) + 1):
            least.append(min(least[a] + price(a, b) for a in range(max(0, b - ranked.LONGEST), b)))
        stops = ends[at : at + n] - begin
        at += n
        assert (stops[-1] if n else 0) == len(values)
        own = [-(-int(x) // ranked.UNIT) for x in stops]
        assert sum(price(a, b) for a, b in zip([0, *own], own, strict=False)) == least[-1]


def test_search_skips_blocks():
    """A rare term with a large weight decides; the blocks of the frequent term elsewhere stay unread."""
    n = 20_000
    row = {"ids": np.arange(n), "sizes": np.full(n, 100), "terms": np.array([0, 1]), "counts": np.array([n, 100]), "docs": np.concatenate([np.arange(n), np.arange(5000, 5100)]), "tfs": np.ones(n + 100, np.int64)}
    shard = ranked.Shard(row, 3, n, 100 * n)
    docs, scores = shard.search(np.array([0, 1, 2]), np.array([1, 5000, 10]), 20)
    assert set(docs) == set(range(5000, 5100)) and len(set(scores)) == 1
    assert shard.read < 0.05 * len(shard.end)


def plain_runs(ws):
    """All runs by trying every period at every start."""
    found = {}
    for q in range(1, len(ws) // runs.TIMES + 1):
        k = 0
        while k + q < len(ws):
            e = k
            while e + q < len(ws) and ws[e] == ws[e + q]:
                e += 1
            if e - k + q >= max(runs.LEAST, runs.TIMES * q) and e > k:
                found.setdefault((k, e - k + q), q)  # the smallest period comes first
            k = e + 1
    out = []
    for (s, n), q in found.items():
        if not any(p < q and all(ws[i] == ws[i + p] for i in range(s, s + n - p)) for p in range(1, q)):
            out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(doc, text):
    ws = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    g, n = h // 10, len(ws)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    return ws


def test_periodic_runs(spark):
    rng = random.Random(9)
    rows = []
    for k in range(300):
        ws = [rng.choice("ab" if k % 3 else "abcdefgh") * rng.choice((1, 1, 3)) for _ in range(rng.randrange(80))]
        for _ in range(k % 4):
            at = rng.randrange(len(ws) + 1)
            part = ws[at : at + rng.randrange(1, 9)] or ["é"]
            ws[at:at] = (part * 12)[: rng.randrange(4 * len(part), 12 * len(part))]
        rows.append((k, rng.choice([" ", "\n\t", "   "]).join(ws)))
    rows += [(900, None), (901, ""), (902, " \n "), (None, "a a a a a a a"), (None, None), (7, rows[7][1]), (903, "y " * 3000), (904, " x" * 6), (905, "x y " * 9 + "z"), (906, " ".join(rng.choice("abc") for _ in range(3000)))]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def expected(doc, text):
        ws = looped(doc, text)
        found = plain_runs(ws) if doc != 903 else [(0, 3000, 1)]
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if found else None
        return doc, len(found), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))

    got = runs.digest(runs.find(runs.with_loops(table(spark, rows)))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert sum(r.n_runs > 0 for r in got) > 100
    assert runs.find(table(spark, [])).count() == 0


def test_lag_counts_of_frequent_and_rare_words():
    """Words frequent enough for the transform, and texts of all sizes, against counting every pair."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 3, 3000), np.zeros(0, int), np.zeros(1200, int), np.concatenate([np.zeros(900, int), rng.integers(5, 500, 900)]), np.array([1, 1])]
    base = np.cumsum([0, *map(len, texts)])
    counts, to = runs.lag_counts(np.concatenate(texts).astype(np.uint64), base)
    for k, t in enumerate(texts):
        want = [int((t[q:] == t[: len(t) - q]).sum()) for q in range(1, len(t) // runs.TIMES + 1)]
        assert counts[to[k] + 1 : to[k + 1]].tolist() == want


def test_long_texts_of_one_word_take_one_lag():
    n = 400_000
    keys = np.zeros(n, np.uint64)
    counts, _ = runs.lag_counts(keys, np.array([0, n]))
    assert runs.runs_of(keys, counts) == [(0, n, 1)]
