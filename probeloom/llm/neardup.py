"""Operator 8: near-duplicate documents by SuperMinHash, banding, verification on full sets and components.

A document's set is that of its distinct word shingles (A-Z folded). Documents with equal sets form a class
with one representative; only representatives go on. SuperMinHash gives every shingle a permutation of the
signature's slots, drawn step by step: step j offers value j + r to the slot at rank j, and a document stops
as soon as no later step can lower any slot. Bands of the signature are the buckets; within a bucket, pairs
that also agree in a one-bit sketch of the signature tie documents into clusters. Each cluster is then
verified on full shingle sets: all its pairs, in tiles of bounded size, as products of incidence matrices.

A cluster of one tile is one comparison. A larger one is first compared tile by tile together with a few
pivots that every tile gets; then all documents outside the largest component found are compared with all
tiles. So no link between different components is lost, and a group of any size costs about its own size
unless its links really are sparse. Buckets over ``RUN`` are chained whole in order of set size, without
the sketch, which only enlarges the cluster. A bucket that holds many rows of a sample is dealt over several tasks.

A ``Link`` is a threshold with its bands and sketch bound: ``CONTRACT`` (85/100, operator 8) and ``CORPUS`` (80/100,
the pipeline). At either threshold a pair shares no band with probability 2e-6 and fails the sketch with 5e-6 (about).

Defined results: null texts and texts without words have an empty set and are linked with nothing, not even
with each other; repeated rows each give a row of the same component; a row with null id has no component
and stays; texts of any length are read whole; ties take the smaller id; an empty table gives an empty result;
``near_duplicates`` ignores extra columns, ``keep_one`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.llm.graph import components, forest, groups
from probeloom.llm.hot import SALTS, among, hot_keys, sampled
from probeloom.llm.scratch import cut
from probeloom.llm.sieve import sieve
from probeloom.llm.slabs import mix, shingles, slabs, stream, tidied

SLOTS = 168
#: Rows of a bucket up to which its pairs are looked at one by one.
RUN = 16
#: Documents and shingles of a tile at most (about).
TILE_ROWS, TILE_SHINGLES = 256, 400_000
_U = np.uint64
_STEP = stream(0x5A17, SLOTS)


@dataclass(frozen=True)
class Link:
    """From which Jaccard similarity (a fraction) sets link, and the candidates that lose next to none at it."""

    numerator: int
    denominator: int
    bands: int
    rows: int  #: slots of a band; bands * rows are SLOTS at most
    agree: int  #: bits of the sketch that must agree


#: A pair at the threshold agrees in 155 of 168 bits on average.
CONTRACT = Link(85, 100, 28, 6, 140)
#: A pair at the threshold agrees in 151 of 168 bits on average.
CORPUS = Link(80, 100, 33, 5, 132)


def distinct_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slab of texts: the sorted distinct shingle hashes text by text, and where each text's begin."""
    for slab in slabs(column):
        keys, to = shingles(slab)
        parts = [np.unique(keys[a:b]) for a, b in zip(to[:-1], to[1:], strict=True)]
        yield np.concatenate(parts) if parts else keys, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def signatures(keys: np.ndarray, to: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of the sets keys[to[i]:to[i+1]]: step in the top bits, random rest below."""
    docs = len(to) - 1
    out = np.full(docs * slots, ~_U(0))
    with np.errstate(over="ignore"):
        owner = np.repeat(np.arange(docs), np.diff(to))
        x = mix(keys + _STEP[0])
        slot = ((x >> _U(32)) * _U(slots) >> _U(32)).astype(np.int64)
        np.minimum.at(out, owner * slots + slot, mix(x) >> _U(9))
        open_doc = out.reshape(docs, slots).max(axis=1) >= _U(1) << _U(55)
        live = open_doc[owner]
        keys, owner, slot = keys[live], owner[live], slot[live]
        order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(keys), 1))
        rows = np.arange(len(keys))
        order[rows, slot] = 0
        order[:, 0] = slot
        for j in range(1, slots):
            if not len(keys):
                break
            x = mix(keys + _STEP[j])
            k = j + ((x >> _U(32)) * _U(slots - j) >> _U(32)).astype(np.int64)
            slot = order[rows, k].copy()
            order[rows, k] = order[:, j]
            order[:, j] = slot
            np.minimum.at(out, owner * slots + slot, (_U(j) << _U(55)) | (mix(x) >> _U(9)))
            open_doc = out.reshape(docs, slots).max(axis=1) >= _U(j + 1) << _U(55)
            live = open_doc[owner]
            if live.sum() < 0.8 * len(live):
                keys, owner, order = keys[live], owner[live], order[live]
                rows = np.arange(len(keys))
    return out.reshape(docs, slots)


def _band_keys(signature: np.ndarray, link: Link = CONTRACT) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = signature[:, : link.bands * link.rows].reshape(len(signature), link.bands, link.rows)
        key = np.broadcast_to(stream(0xBA2D, link.bands), (len(signature), link.bands)).copy()
        for r in range(link.rows):
            key = mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def signed(docs: DataFrame, link: Link = CONTRACT) -> DataFrame:
    """doc_id, t (digest of the text), n (set size), k1 and k2 (digest of the set), bands, sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for keys, to in distinct_sets(batch.column(2)):
                n, docs = np.diff(to), len(to) - 1
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([[_U(0)], np.cumsum(mix(keys ^ s), dtype=_U)]) for s in stream(0xD1, 2)]
                    digest = [s[to[1:]] - s[to[:-1]] for s in sums]
                signature = signatures(keys, to)
                bits = np.zeros((docs, 192), np.uint8)
                bits[:, :SLOTS] = signature & _U(1)
                sketch = np.packbits(bits, axis=1).view(np.int64)
                keep = n > 0
                lists = lambda x, w: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(keep * w)]).astype(np.int32), pa.array(x[keep].view(np.int64).ravel()))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, docs) for c in (0, 1)), pa.array(n.astype(np.int64)), *(pa.array(d.view(np.int64)) for d in digest), lists(_band_keys(signature, link), link.bands), lists(sketch, 3)],
                    names=["doc_id", "t", "n", "k1", "k2", "bands", "sketch"],
                )
                at += docs

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text").mapInArrow(tidied(run), "doc_id long, t long, n long, k1 long, k2 long, bands array<long>, sketch array<long>")


def _tied(batches: Iterator[pa.RecordBatch], link: Link = CONTRACT) -> Iterator[pa.RecordBatch]:
    """Candidate ties of sorted bucket rows (key, n, rep, s0, s1, s2)."""
    held, last = None, None  # the open bucket's rows; the last row of an open bucket that is already chained

    def ties(rows: np.ndarray, open_end: bool) -> pa.RecordBatch:
        nonlocal last
        key, n, rep, bits = rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3:].view(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        small = np.repeat(size <= RUN, size)
        if last is not None and last[0] == key[0]:
            small[: size[0]] = False
        if open_end:
            small[first[-1] :] = False
        pairs, near = [], []
        for lag in range(1, min(RUN, len(key))):
            i = np.flatnonzero(small[:-lag] & (key[:-lag] == key[lag:]))
            if not len(i):
                break
            i = i[n[i] * link.denominator >= n[i + lag] * link.numerator]
            same = SLOTS - np.bitwise_count(bits[i] ^ bits[i + lag]).sum(axis=1, dtype=np.int64)
            i = i[same >= link.agree]
            near.append((i, i + lag))
        if near:  # of the pairs in a bucket, those that span its components are enough
            i, j = (np.concatenate(x) for x in zip(*near, strict=True))
            root = np.arange(len(key))
            while True:
                low = np.minimum(root[i], root[j])
                if (low == root[i]).all() and (low == root[j]).all():
                    break
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
            i = np.flatnonzero(root != np.arange(len(key)))
            pairs.append(np.column_stack([rep[root[i]], rep[i]]))
        i = np.flatnonzero(~small[1:] & (key[1:] == key[:-1]) & (n[:-1] * link.denominator >= n[1:] * link.numerator))
        pairs.append(np.column_stack([rep[i], rep[i + 1]]))
        if last is not None and last[0] == key[0] and last[1] * link.denominator >= n[0] * link.numerator:
            pairs.append(np.array([[last[2], rep[0]]]))
        last = rows[-1] if open_end else None
        made = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])

    for batch in batches:
        rows = np.column_stack([c.to_numpy() for c in batch.columns]) if batch.num_rows else np.zeros((0, 6), np.int64)
        rows = rows if held is None else np.concatenate([held, rows])
        if not len(rows):
            continue
        begin = int(np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))[-1])
        if len(rows) - begin > 64 * RUN:  # the open bucket is large: chain what there is of it and keep its last row alone
            held = None
            yield ties(rows, True)
            continue
        held = rows[begin:]
        if begin:
            yield ties(rows[:begin], False)
    if held is not None and len(held):
        yield ties(held, False)


def linked(sets: list[np.ndarray], link: Link = CONTRACT) -> np.ndarray:
    """Which pairs of sets reach the threshold, as a symmetric matrix with a false diagonal."""
    k, n = len(sets), np.array([len(s) for s in sets])
    if k == 2:
        inter = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
        inter[1] = inter[0][::-1]
    else:
        keys, owner = np.concatenate(sets), np.repeat(np.arange(k), n)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        code = np.cumsum(new) - 1
        often = np.bincount(code) > 1
        place = np.cumsum(often) - 1
        here = often[code]
        code, owner = place[code[here]], owner[here]
        inter, width = np.zeros((k, k), np.int64), max(1024, (1 << 22) // k)
        for at in range(0, int(often.sum()), width):
            a, b = np.searchsorted(code, [at, at + width])
            block = np.zeros((k, width), np.float32)
            block[owner[a:b], code[a:b] - at] = 1
            inter += np.rint(block @ block.T).astype(np.int64)
    out = link.denominator * inter >= link.numerator * (n[:, None] + n[None, :] - inter)
    np.fill_diagonal(out, False)
    return out


def linked_texts(texts: pa.ChunkedArray, link: Link = CONTRACT) -> np.ndarray:
    """Which pairs of texts have shingle sets that reach the threshold."""
    sets = []
    for keys, to in distinct_sets(texts):
        sets += [keys[a:b].copy() for a, b in zip(to[:-1], to[1:], strict=True)]
    return linked(sets, link)


def verify(texts: DataFrame, clusters: DataFrame, link: Callable[[pa.ChunkedArray], np.ndarray], tile_rows: int, tile_size: int) -> DataFrame:
    """Links (a, b) that span the components of the link graph within clusters (rep, n, cluster).

    texts (rep, text) has what ``link`` compares, a symmetric matrix for the texts of a tile; n is the size of
    a text, of which a tile holds about ``tile_size``, in ``tile_rows`` rows at most (about).
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):  # sides 1 and 2 meet each other, and side 1 itself
            if table.num_rows < 2:
                continue
            reps, side = (table.column(c).to_numpy() for c in (3, 4))
            root = forest(link(table.column(5)) & ~((side[:, None] == 2) & (side[None, :] == 2)))
            child = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(reps[child]), pa.array(reps[root[child]])], names=["a", "b"])

    def compare(placed: DataFrame) -> DataFrame:
        rows = placed.join(texts, "rep").select("cluster", "x", "y", "rep", "side", "text")
        return cut(rows.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y").mapInArrow(tidied(found), "a long, b long"), "verified")

    sizes = clusters.groupBy("cluster").agg(
        F.count("*").alias("rows"), F.sum("n").alias("size"), F.min("rep").alias("p0"), F.max("rep").alias("p1"),
        F.min_by("rep", F.xxhash64("rep")).alias("p2"), F.max_by("rep", F.xxhash64("rep")).alias("p3"),
    )
    # written, so that a join with it has nothing but exchanges below and Spark can split a large cluster
    sizes = cut(sizes.withColumn("tiles", F.greatest(F.ceil(F.col("rows") / tile_rows), F.ceil(F.col("size") / tile_size)).cast("int")), "sizes")
    tile = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    members = cut(clusters.join(sizes, "cluster").withColumn("tile", tile).withColumn("pivot", F.col("rep").isin(*map(F.col, ("p0", "p1", "p2", "p3")))), "members")
    # a pivot goes to every tile of its cluster
    first = members.select("rep", "cluster", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))).alias("x"))
    one = compare(first.select("cluster", "x", F.lit(0).alias("y"), "rep", F.lit(1).alias("side")))
    large = members.where("tiles > 1")
    if large.isEmpty():
        return one
    known = components(one)
    large = large.join(known, large["rep"] == known["node"], "left").select("rep", "cluster", "tiles", "tile", F.coalesce("component", "rep").alias("component"))
    counts = large.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    core = counts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("core"), F.sum("n").alias("n"), F.max("n").alias("most"))
    core = cut(core.where("n > most").withColumn("outer_tiles", F.ceil((F.col("n") - F.col("most")) / tile_rows).cast("int")), "core")
    large = cut(large.join(core, "cluster").withColumn("y", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("outer_tiles")).cast("int")), "outer")
    if large.isEmpty():
        return one
    outside = F.col("component") != F.col("core")
    probes = large.where(outside).select("cluster", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("x"), "y", "rep", F.lit(1).alias("side"))
    rest = large.select("cluster", F.col("tile").alias("x"), F.explode(F.sequence(F.lit(0), F.col("outer_tiles") - 1)).alias("y"), "rep", F.lit(2).alias("side"))
    return one.union(compare(probes.union(rest)))


def judged(docs: DataFrame, link: Link = CONTRACT) -> DataFrame:
    """doc_id, t (digest of the text), n_shingles, component_id, kept of every document."""
    rows = cut(signed(docs, link), "signed")
    known = rows.where("n > 0 AND doc_id IS NOT NULL")
    same = known.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("r"))
    reps = same.select(F.col("r.doc_id").alias("rep"), "n", "r.bands", "r.sketch")
    buckets = reps.select(F.explode("bands").alias("key"), "n", "rep", *(F.col("sketch")[i].alias(f"s{i}") for i in range(3)))
    hot = among(hot_keys(sampled(reps, "bands").select(F.explode("bands").alias("key")), "key"), "key")
    salt = F.when(hot, F.pmod(F.xxhash64("rep"), F.lit(SALTS))).otherwise(0)
    ties = buckets.repartition("key", salt).sortWithinPartitions("key", "n", "rep").mapInArrow(tidied(lambda batches: _tied(batches, link)), "a long, b long")
    # the parts of a hot key don't know of each other: their rows are tied to the key itself as well, which can only enlarge a cluster
    tied = components(ties.union(buckets.where(hot).select(F.col("rep").alias("a"), F.col("key").alias("b"))))
    sizes = known.groupBy(F.col("doc_id").alias("rep")).agg(F.max("n").alias("n"))
    clusters = tied.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(sizes, "rep")
    texts = sieve(docs.select(F.col("doc_id").cast("long").alias("rep"), "text"), "rep", tied, "node")
    linked_reps = components(verify(texts, clusters, partial(linked_texts, link=link), TILE_ROWS, TILE_SHINGLES))
    classes = known.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"))
    classes = classes.join(linked_reps, classes["rep"] == linked_reps["node"], "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "t", "n", "k1", "k2").join(cut(classes, "classes"), ["k1", "k2", "n"], "left")  # written, so that Spark can split a large class
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, link: Link = CONTRACT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return judged(docs, link).drop("t")


def keep_one(docs: DataFrame, link: Link = CONTRACT) -> DataFrame:
    """The rows of docs that are the smallest id of their component, one row for each id and text; all columns as they are."""
    verdicts = judged(docs, link).where("kept").select(F.col("doc_id").alias("id"), F.col("t").alias("digest")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("u"))
    kept = rows.join(verdicts, F.col("i").eqNullSafe(F.col("id")) & (F.col("u") == F.col("digest")), "left_semi")
    if not rows.groupBy("i", "u").count().where("count > 1").isEmpty():  # repeated rows: rare, so only then a second look at all columns
        kept = kept.dropDuplicates(["i", "u"])
    return kept.select("row.*")
