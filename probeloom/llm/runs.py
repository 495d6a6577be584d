"""Operator 13: runs of repeated word sequences, found by counting heavy and light lags.

A run is a stretch of words with smallest period q that goes on for ``TIMES`` periods and ``LEAST`` words at least and
that no neighbouring word extends. For every lag up to a ``TIMES``-th of a text, the places whose word stands again
that many words on are counted exactly: by pairs of places for words that are rare in the text, by the autocorrelation
of the places (a Fourier transform) for frequent ones. Only lags with as many matches as a run needs are looked at. A
lag is probed at its multiples first, as a run matches at three of them in a row, and then around such places word by
word. What a run adds to the counts of multiples of its period is taken off again, so a long run of one word costs one
lag, not one for each multiple. The time is near n log n plus the pairs of rare words, of which a word has at most
about sqrt(n log n) times its own number.

Documents stay where they are; nothing is shuffled. Words are known by 64-bit digests. Memory is about 150 bytes for each
word of the longest text of a task.

Defined results: a null or empty text, or one of white space, has no words and no runs; texts of any length are read
whole; repeated rows are judged alike; a null id is returned as it is (and its text stays as it is); among runs with
equal exponents the first, then that with the least period, is the best; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeloom.llm.slabs import WHITE, slabs, span_hash, tidied

TIMES, LEAST = 4, 6
_U = np.uint64
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _needed(q: np.ndarray | int) -> np.ndarray:
    """Matches in a row that a run of period q has at least."""
    return np.maximum(LEAST - q, (TIMES - 1) * q)


def lag_counts(keys: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text keys[base[k]:base[k+1]], how often each lag from 0 to a TIMES-th of its words has equal words; and where each text's counts begin."""
    n = np.diff(base)
    to = np.concatenate([[0], np.cumsum(n // TIMES + 1)])
    counts = np.zeros(to[-1], np.int64)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((keys, text))  # stable: places of a word ascend
    ranked, of, place = keys[order], text[order], order - base[text[order]]
    new = np.ones(len(order), bool)
    new[1:] = (ranked[1:] != ranked[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.concatenate([first, [len(order)]]))
    size = 2.0 ** np.ceil(np.log2(2 * np.maximum(n[of[first]], 1)))  # of the transform
    heavy = times.astype(float) ** 2 > 10_000 + size * np.log2(size) / 2
    for k in np.flatnonzero(heavy):
        t, m, most = of[first[k]], int(size[k]), n[of[first[k]]] // TIMES
        here = np.zeros(m)
        here[place[first[k] : first[k] + times[k]]] = 1
        wave = np.fft.rfft(here)
        counts[to[t] : to[t + 1]] += np.rint(np.fft.irfft((wave * wave.conj()).real, m)[: most + 1]).astype(np.int64)
    rest = np.where(heavy, 0, times)
    at = np.repeat(first, rest) + np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest)
    end = np.repeat(first + rest, rest)
    limit = (n // TIMES)[of]
    step = 1
    while True:
        inside = at + step < end
        at, end = at[inside], end[inside]
        if not len(at):
            break
        lag = place[at + step] - place[at]
        near = lag <= limit[at]
        at, end, lag = at[near], end[near], lag[near]  # a farther pair of the same place is farther still
        counts += np.bincount(to[of[at]] + lag, minlength=len(counts)) if len(at) * 8 > len(counts) else 0
        if len(at) * 8 <= len(counts):
            np.add.at(counts, to[of[at]] + lag, 1)
        step += 1
    return counts, to


def _islands(keys: np.ndarray, q: int) -> list[tuple[int, int]]:
    """Start and length of the stretches of keys with period q, long enough for a run and as long as can be."""
    grid = keys[: len(keys) - q : q] == keys[q::q][: -(-(len(keys) - q) // q)]
    three = np.flatnonzero(grid[:-2] & grid[1:-1] & grid[2:])
    if not len(three):
        return []
    out, least = [], int(_needed(q))
    first = three[np.concatenate([[True], np.diff(three) > 1])]
    last = three[np.concatenate([np.diff(three) > 1, [True]])] + 2
    for a, b in zip(first, last, strict=True):
        lo, hi = max(0, (a - 1) * q + 1), min(len(keys) - q, (b + 1) * q)
        same = np.zeros(hi - lo + 2, np.int8)
        same[1:-1] = keys[lo:hi] == keys[lo + q : hi + q]
        turn = np.diff(same)
        begin, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        long = stop - begin >= least
        out += [(lo + s, n + q) for s, n in zip(begin[long].tolist(), (stop - begin)[long].tolist(), strict=True)]
    return out


def runs_of(keys: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text, by start, then period; ``counts`` of its lags are used up."""
    need = _needed(np.arange(len(counts)))
    found: list[tuple[int, int, int]] = []
    lags = np.flatnonzero(counts[1:] >= need[1:]) + 1
    for q in lags.tolist():
        if counts[q] < need[q]:
            continue
        for s, length in _islands(keys, q):
            if any(q % p == 0 and a <= s and s + length <= a + size for a, size, p in found):
                continue
            found.append((s, length, q))
            more = np.arange(2 * q, min(length, len(counts)), q)
            counts[more] -= length - more  # such matches lie in no run of the multiple
    return sorted(found, key=lambda r: (r[0], r[2]))


def dropped(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in found:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (the words outside repeats, joined by a space) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column(1)):
                starts, ends, base = slab.words()
                keys = span_hash(slab.prefix(), starts, ends)
                counts, to = lag_counts(keys, base)
                keep = ~WHITE[slab.data]
                gap = np.ones(len(starts), bool)
                gap[base[:-1][np.diff(base) > 0]] = False  # no space before a text's first word
                data = slab.data.copy()
                keep[starts[gap] - 1] = True
                data[starts[gap] - 1] = 0x20
                runs, texts = [], []
                for k in range(slab.rows):
                    a, b = base[k], base[k + 1]
                    found = runs_of(keys[a:b], counts[to[k] : to[k + 1]]) if b - a >= LEAST else []
                    if found:
                        for w in np.flatnonzero(dropped(int(b - a), found)) + a:
                            keep[starts[w] - 1 : ends[w]] = False  # a dropped word has one before it
                    lo, hi = slab.offs[k], slab.offs[k + 1]
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    texts.append(data[lo:hi][keep[lo:hi]].tobytes())
                ids = batch.column(0).slice(slab.first, slab.rows)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(base), pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), SCHEMA)


def best(runs: Column) -> Column:
    """The run with the greatest length for its period, exactly; of equal ones the first, then that with the least period."""
    ahead = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]  # noqa: E731  runs come by start, then period
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(ahead(b, a), b).otherwise(a))


def digest(rows: DataFrame) -> DataFrame:
    """The rows of ``find`` with the best run and digests in place of runs and texts."""
    text = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    top = rows.withColumn("best", best(F.col("runs")))
    whole = F.expr("(1000 * best.length) div best.period")
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", whole.alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document by the checksum of its id repeats a stretch of its words to its end; the others as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def looped(ws: Column) -> Column:
        n = F.size(ws)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        word = lambda i: F.get(ws, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")).otherwise("")

    split = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    once = F.transform(F.array(split), looped)[0]  # a lambda's variable, so that the text isn't split for each word
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), once).otherwise(F.col("text")).alias("text"))
