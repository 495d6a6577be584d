"""Operator 12: ranked lexical search with variable blocks of postings and their greatest impacts.

Documents stay where they are: every task inverts runs of its documents into shards of about ``SHARD_TERMS`` terms, so
nothing is shuffled and a frequent term lies in all shards. A shard is one row (its documents and the posting lists of
the terms that some query holds). Three sums over the shards give what all scores need: documents, terms, and
documents of each term. In a shard, dynamic programming cuts each list into blocks of any length so that the sum over
postings of (greatest impact of the block - own impact) plus a fixed cost for each block is least. A query then adds up
the greatest impacts of the blocks that cover a stretch of documents: this bounds all scores there. Stretches are taken
from the largest bound down, blocks that cover none of them are not read, and the search ends when no bound reaches the
``k``-th best score so far. Bounds are never below a score and equal bounds are searched, so the result is exact.

Queries are shipped to the tasks, ``MAX_TERMS`` words of them at most; more queries are searched in several rounds. Terms
are known by 64-bit digests. Scores are sums of whole numbers below 2^53.

Defined results: a null or empty text has no terms and no rank; an item without terms gets no rows; texts of any length
are read whole; repeated rows of documents are ranked one by one (in any order), repeated items give their rows again;
among equal scores a null id comes last; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probeloom.llm.scratch import cut
from probeloom.llm.slabs import LOWER, slabs, span_hash, tidied

BEST = 20
#: Terms of a shard (about), and words of the queries of one round at most.
SHARD_TERMS, MAX_TERMS = 4_000_000, 500_000
#: Postings of a unit; units of a block at most; the cost of a block in greatest impacts of its list.
UNIT, LONGEST, COST = 4, 32, 6
#: Documents that are scored in a step of the search, as multiples of what is wanted.
STEP = 16
GAPS = np.zeros(256, bool)
GAPS[:128] = True
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    GAPS[_a:_b] = False
SHARD = "ids array<long>, sizes array<int>, n_docs long, n_terms long, terms array<int>, counts array<int>, docs array<int>, tfs array<int>"


def _shard(parts: list[tuple]) -> pa.RecordBatch:
    """One shard of parts (ids, sizes, text, term, tf), with the postings of a term together and in the order of the documents."""
    ids = pa.concat_arrays([p[0] for p in parts])
    first = np.cumsum([0, *(len(p[0]) for p in parts)])
    sizes, term, tf = (np.concatenate([p[k] for p in parts]) for k in (1, 3, 4))
    doc = np.concatenate([p[2] + a for p, a in zip(parts, first, strict=False)])
    order = np.lexsort((doc, term))
    names, counts = np.unique(term, return_counts=True)
    one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x.astype(kind)))
    columns = [one(ids, None), one(sizes, np.int32), pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), one(names, np.int32), one(counts, np.int32), one(doc[order], np.int32), one(tf[order], np.int32)]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "sizes", "n_docs", "n_terms", "terms", "counts", "docs", "tfs"])


def shards(docs: DataFrame, terms: np.ndarray, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The shards of docs (``SHARD``); ``terms`` are the sorted digests of the words to be indexed, known by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for slab in slabs(batch.column(1)):
                starts, ends, base = slab.words(GAPS)
                key = span_hash(slab.prefix(LOWER), starts, ends)
                sizes = np.diff(base)
                at = np.minimum(np.searchsorted(terms, key), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == key)
                text = np.repeat(np.arange(slab.rows), sizes)[hit]
                pair, tf = np.unique(text * len(terms) + at[hit], return_counts=True)
                parts.append((batch.column(0).slice(slab.first, slab.rows), sizes, pair // len(terms), pair % len(terms), tf))
                held += int(sizes.sum())
                if held >= shard_terms:
                    yield _shard(parts)
                    parts, held = [], 0
        if parts:
            yield _shard(parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), SHARD)


def cut_blocks(impact: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks of each list impact[offs[k]:offs[k+1]] end, all lists in a row, and how many blocks each has.

    Of all cuts at multiples of ``UNIT`` into blocks of ``LONGEST`` units at most, the one with the least sum of (greatest
    impact of the block - own impact) over postings plus COST times the list's greatest impact for each block.
    """
    sizes = np.diff(offs)
    units = -(-sizes // UNIT)
    base = np.concatenate([[0], np.cumsum(units)])
    list_of = np.repeat(np.arange(len(sizes)), units)
    nth = np.arange(base[-1]) - base[list_of]
    begin = offs[list_of] + nth * UNIT
    top = np.maximum.reduceat(impact, begin).astype(np.float64) if len(begin) else np.zeros(0)
    some = units > 0
    fixed = np.zeros(len(sizes))
    fixed[some] = COST * np.maximum.reduceat(top, base[:-1][some]) if len(begin) else 0
    held = np.minimum(offs[list_of + 1] - begin, UNIT)
    order = np.argsort(-units, kind="stable")  # the lists that are still going on stand in front
    going = np.searchsorted(-units[order], -np.arange(1, units.max(initial=0) + 1), "right")
    best = np.zeros(len(sizes))
    most = np.zeros((len(sizes), LONGEST))  # greatest impact of the last 1, 2, ... units
    area = np.full((len(sizes), LONGEST), np.inf)  # cost up to the start of such a block
    size = np.zeros((len(sizes), LONGEST))
    back = np.zeros(base[-1], np.int64)
    for j, n in enumerate(going):
        rows = order[:n]
        at = base[rows] + j
        for x, fresh in ((most, 0.0), (area, best[:n]), (size, 0.0)):
            x[:n, 1:] = x[:n, :-1].copy()
            x[:n, 0] = fresh
        np.maximum(most[:n], top[at][:, None], out=most[:n])
        size[:n] += held[at][:, None]
        cost = area[:n] + size[:n] * most[:n]
        pick = cost.argmin(axis=1)
        best[:n] = cost[np.arange(n), pick] + fixed[rows]
        back[at] = pick + 1
    ends = np.zeros(base[-1], bool)
    at = base[1:][some] - 1
    while len(at):
        ends[at] = True
        to = at - back[at]
        at = to[to >= base[list_of[at]]]
    last = np.flatnonzero(ends)
    return np.minimum(begin[last] + UNIT, offs[list_of[last] + 1]), np.bincount(list_of[last], minlength=len(sizes))


class Shard:
    """The lists of a shard with impacts and blocks."""

    def __init__(self, row: dict[str, np.ndarray], vocabulary: int, n_docs: int, n_terms: int):
        self.ids, self.docs = row["ids"], row["docs"].astype(np.int64)
        counts = np.zeros(vocabulary, np.int64)
        counts[row["terms"]] = row["counts"]
        offs = np.concatenate([[0], np.cumsum(counts)])
        m = 75 + (25 * row["sizes"].astype(np.int64) * n_docs) // max(1, n_terms)
        tf = row["tfs"].astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.docs])
        self.end, blocks = cut_blocks(self.impact, offs)
        self.start = np.concatenate([[0], self.end[:-1]]) if len(self.end) else self.end
        self.of = np.concatenate([[0], np.cumsum(blocks)])  # first block of each term
        self.top = np.maximum.reduceat(self.impact, self.start) if len(self.end) else self.end
        self.read = 0  #: blocks that searches have read

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in the shard) that may be among the k best by the sum of weight * impact, all these among them, and their scores."""
        n = self.of[terms + 1] - self.of[terms]
        block = np.repeat(self.of[terms] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        weight = np.repeat(weights, n)
        first, stop = self.docs[self.start[block]], self.docs[self.end[block] - 1] + 1
        change = np.bincount(np.concatenate([first, stop]), np.concatenate([weight * self.top[block], -weight * self.top[block]]), len(self.ids) + 1)
        edges = np.unique(np.concatenate([first, stop]))  # bounds change here only
        bound, left, right = np.cumsum(change[edges])[:-1], edges[:-1], edges[1:]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        width = np.cumsum((right - left)[order])
        docs, scores, least, at = [np.zeros(0, np.int64)], [np.zeros(0)], 1.0, 0
        while at < len(order) and bound[order[at]] >= least:
            to = int(np.searchsorted(width, (width[at - 1] if at else 0) + STEP * k)) + 1
            some = order[at:to][bound[order[at:to]] >= least]
            edge = np.zeros(len(self.ids) + 1, np.int64)
            np.add.at(edge, left[some], 1)
            np.add.at(edge, right[some], -1)
            open_ = np.cumsum(edge)[:-1] > 0
            covered = np.concatenate([[0], np.cumsum(open_)])
            live = np.flatnonzero(covered[stop] > covered[first])
            self.read += len(live)
            size = self.end[block[live]] - self.start[block[live]]
            post = np.repeat(self.start[block[live]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            got = np.bincount(self.docs[post], np.repeat(weight[live], size) * self.impact[post], len(self.ids))
            here = np.flatnonzero(open_ & (got >= least))
            docs.append(here)
            scores.append(got[here])
            every = np.concatenate(scores)
            if len(every) >= k:
                least = max(least, np.partition(every, len(every) - k)[len(every) - k])
            at = to
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        keep = scores >= least
        return docs[keep], scores[keep].astype(np.int64)


def search(index: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int = BEST) -> DataFrame:
    """q, doc_id, score: the k best documents of each shard for each query (places of its terms, repeats included)."""
    ready = [(q, *np.unique(terms, return_counts=True)) for q, terms in enumerate(queries) if len(terms)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                values = {n: batch.column(n)[r].values for n in ("ids", "sizes", "terms", "counts", "docs", "tfs")}
                ids = values["ids"]
                known = np.asarray(ids.is_valid())
                shard = Shard({n: v.fill_null(0).to_numpy() for n, v in values.items()}, len(weights), n_docs, n_terms)
                found = []
                for q, terms, times in ready:
                    docs, scores = shard.search(terms, times * weights[terms], k)
                    order = np.lexsort((shard.ids[docs], ~known[docs], -scores))[:k]
                    found.append((np.full(len(order), q), docs[order], scores[order]))
                if found:
                    q, docs, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), ids.take(pa.array(docs)), pa.array(scores, pa.int64())], names=["q", "doc_id", "score"])

    return index.mapInArrow(tidied(run), "q long, doc_id long, score long")


def weight(n_docs: int, df: int) -> int:
    """The weight of a term that df of n_docs documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def rank(docs: DataFrame, items: DataFrame, k: int = BEST, shard_terms: int = SHARD_TERMS, max_terms: int = MAX_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents with the highest scores above 0 for each item, ties by doc_id."""
    spark = docs.sparkSession
    rows = items.select("item_id", "text", F.octet_length("text").alias("b")).where("text IS NOT NULL")
    rounds = max(1, -(-int(rows.agg(F.sum("b")).first()[0] or 0) // (2 * max_terms)))  # a word and its gap have two bytes at least
    if rounds > 1:
        rows = cut(rows, "queries")
    out = None
    for part in range(rounds):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == part).select("item_id", "text").toArrow()
        keys = [span_hash(s.prefix(LOWER), *s.words(GAPS)[:2])[a:b] for s in slabs(some.column("text")) for base in [s.words(GAPS)[2]] for a, b in zip(base, base[1:], strict=False)]
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]))
        if not len(terms):
            continue
        index = cut(shards(docs, terms, shard_terms), "shards")
        n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        pair = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.counts").alias("df")).toArrow()
        df = np.zeros(len(terms), np.int64)
        df[pair.column("t").to_numpy()] = pair.column("df").to_numpy()
        weights = np.array([weight(n_docs or 0, int(x)) for x in df], np.int64)
        found = search(index, [np.searchsorted(terms, x) for x in keys], weights, n_docs or 0, n_terms or 0, k)
        names = spark.createDataFrame(some.append_column("q", pa.array(range(some.num_rows), pa.int64())).select(["q", "item_id"]))
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        found = found.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")  # names: max_terms rows at most
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "rank int, doc_id long, score long").join(items.select("item_id").limit(0)).select("item_id", "rank", "doc_id", "score")
    return out


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: DuckDB SQL for ``rank(documents, benchmark)``.
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
a AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(ws)) AS BIGINT) AS big_l FROM d WHERE len(ws) > 0),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM f GROUP BY term), a),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY i, item_id, term),
m AS (SELECT r, doc_id, 75 + (25 * len(ws) * big_n) // big_l AS m FROM d, a WHERE len(ws) > 0),
s AS (SELECT i, item_id, doc_id, r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY i, item_id, doc_id, r),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {BEST}"""
