"""Operator 1: quality rules from gradient-boosted trees over document statistics.

A bounded, hash-ordered sample of labelled documents trains boosted trees in numpy on the driver. Chosen
statistics (symbols, repeated lines, repeated words) may only lower the score: splits on them are
monotone. The trees are flattened into node arrays, shipped with the tasks, and score whole Arrow batches.

Defined results: a null or empty text has zero in all statistics and fails the base rules; texts of any
length are read whole; repeated rows are judged alike; without labels of both kinds there is no model and
the base rules alone decide; a null id stays null; ties with the threshold are kept; an empty table gives an
empty result; ``judge`` ignores extra columns, ``keep_good`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.llm.slabs import WHITE, Slab, per_text, repeated, slabs, span_hash, tidied, windows, within

#: Labelled documents at most that train the model: its cost and the driver's memory do not grow with the corpus.
TRAIN_ROWS = 20_000
#: Share of good held-out documents that the threshold may reject at most; it is never above one half.
GOOD_LOST = 0.002
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_chars", "n_upper", "n_digits", "n_points", "n_distinct")
#: Features of the model and the direction in which each may move the score (0: either).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": 0, "digit_share": 0, "point_share": 0, "distinct_share": 0, "words_per_line": 0,
}


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_DIGIT = _table(b"0123456789")
_POINT = _table(b".,;:!?")


def _measure(slab: Slab) -> dict[str, np.ndarray]:
    data, offs = slab.data, slab.offs
    starts, ends, base = slab.words()
    prefix = slab.prefix()
    words = span_hash(prefix, starts, ends)
    lead = (data & 0xC0) != 0x80
    runs, at, to = windows(words, base, 5, False)
    twice, _ = repeated(within(runs, to))
    edge = np.bincount(at[twice], minlength=len(words) + 5) - np.bincount(at[twice] + 5, minlength=len(words) + 5) if len(at) else np.zeros(len(words) + 5, int)
    covered = np.cumsum(edge)[: len(words)] > 0
    first, last, rows = slab.lines()
    filled = np.searchsorted(starts, first) < np.searchsorted(starts, last)
    _, again = repeated(within(span_hash(prefix, first, last), rows))
    _, known = repeated(within(words, base))
    return {
        "n_words": np.diff(base),
        "word_chars": per_text(lead & ~WHITE[data], offs),
        "n_symbols": per_text(_SYMBOL[data], offs),
        "n_dup_lines": per_text(again & filled, rows),
        "n_repeat_words": per_text(covered, base),
        "n_lines": np.diff(rows),
        "n_chars": per_text(lead, offs),
        "n_upper": per_text(_UPPER[data], offs),
        "n_digits": per_text(_DIGIT[data], offs),
        "n_points": per_text(_POINT[data], offs),
        "n_distinct": np.diff(base) - per_text(known, base),
    }


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """Statistics of each text of an Arrow column."""
    parts = [_measure(s) for s in slabs(column)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (*STATS, *_MORE)}


def features(m: dict[str, np.ndarray]) -> np.ndarray:
    """The model's features, one column for each entry of FEATURES."""
    words, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    return np.column_stack([
        np.log1p(m["n_words"]), m["word_chars"] / words, m["n_symbols"] / words, m["n_dup_lines"] / np.maximum(m["n_lines"], 1), m["n_repeat_words"] / words,
        m["n_upper"] / chars, m["n_digits"] / chars, m["n_points"] / chars, m["n_distinct"] / words, m["n_words"] / np.maximum(m["n_lines"], 1),
    ]).astype(np.float64)


@dataclass
class Trees:
    """Boosted trees of equal depth, each an array of nodes in heap order."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float
    threshold: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good document, for all rows tree by tree."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, signs: tuple[int, ...] = tuple(FEATURES.values())) -> Trees:
    """Boost depth-bounded trees on the logistic loss.

    A split on a feature with a sign counts only if its two values stand in that order, and the values
    below it are held on their side of the middle, so the whole score is monotone in that feature.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    inner, share = 2**depth - 1, np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    total, out = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(len(y), np.int64)
        low, high, mean = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf), np.zeros(2 * inner + 1)
        mean[0] = g.sum() / (h.sum() + ridge)
        for k in range(inner):
            here = node == k
            best, best_gain = None, 1e-9
            if here.sum() >= 20:
                gs, hs = g[here], h[here]
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[here, j], gs, len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[here, j], hs, len(e) + 1))[:-1]
                    gr, hr = gs.sum() - gl, hs.sum() - hl
                    left, right = np.clip(gl / (hl + ridge), low[k], high[k]), np.clip(gr / (hr + ridge), low[k], high[k])
                    gain = gl * left - (hl + ridge) * left**2 / 2 + gr * right - (hr + ridge) * right**2 / 2 - (gs.sum() * mean[k] - (hs.sum() + ridge) * mean[k] ** 2 / 2)
                    gain[(hl < 1e-3) | (hr < 1e-3) | (signs[j] * (right - left) < 0)] = -np.inf
                    b = int(np.argmax(gain))
                    if gain[b] > best_gain:
                        best_gain, best = gain[b], (j, b, left[b], right[b])
            a, b2 = 2 * k + 1, 2 * k + 2
            low[[a, b2]], high[[a, b2]], mean[[a, b2]] = low[k], high[k], mean[k]
            if best:
                j, b, left, right = best
                feature[k], cut[k] = j, edges[j][b]
                mean[a], mean[b2] = left, right
                if signs[j]:
                    down, up = (b2, a) if signs[j] < 0 else (a, b2)
                    high[down] = low[up] = (left + right) / 2
            node[here] = np.where(x[here, feature[k]] > cut[k], b2, a)
        value[:] = rate * mean[inner:]
        total += value[node - inner]
        out.append((feature, cut, value))
    return Trees(*(np.array(part) for part in zip(*out, strict=True)), start)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, good_lost: float = GOOD_LOST) -> Trees | None:
    """Fit on at most ``rows`` labelled documents, the first in an order of hashes; a fifth of them sets the threshold.

    Of documents with the same id, that with the least text digest stands for all.
    """
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    texts = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("t"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).join(texts, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).join(F.broadcast(known), ["doc_id", "t"]).select("doc_id", "text", "y")  # known: bounded by rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(measure(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = sample.mapInArrow(tidied(run), "doc_id long, y double, x array<double>").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy()
    if len(set(y)) < 2:
        return None
    x = np.array(got["x"].to_list())
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[~held])) < 2:
        return fit(x, y)
    good = np.sort(fit(x[~held], y[~held]).score(x[held & (y == 1)]))
    model = fit(x, y)
    model.threshold = min(0.5, float(good[int(good_lost * len(good))])) if len(good) else 0.5
    return model


def _verdict(m: dict[str, np.ndarray], model: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    score = model.score(features(m)) if model is not None else np.ones(len(failed))
    return failed, score, ~failed & (score >= (model.threshold if model is not None else 0))


def judge(docs: DataFrame, model: Trees | None) -> DataFrame:
    """doc_id, the statistics, base_failed, score and kept of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(batch.column(1))
            failed, score, kept = _verdict(m, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[k], pa.int64()) for k in STATS), pa.array(failed), pa.array(score), pa.array(kept)], names=["doc_id", *STATS, "base_failed", "score", "kept"])

    schema = f"doc_id long, {', '.join(f'{k} long' for k in STATS)}, base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), schema)


def keep_good(docs: DataFrame, model: Trees | None, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_verdict(measure(batch.column(at)), model)[2]))

    return docs.mapInArrow(tidied(run), docs.schema)
