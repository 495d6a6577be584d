"""Operator 9: repeated byte windows by a depth-limited radix sort of sampled suffixes.

Ordering every suffix through 400 bytes would shuffle many times the input, so the sort keeps one suffix
for each run of windows: a window's anchor is the leftmost least hash among the 128-byte grams inside it.
Equal windows have equal anchors at equal offsets, so nothing is lost. Most-significant-digit passes then
refine groups of anchors, and what stands alone after a pass leaves:

1. the digit is the anchor's gram; an anchor whose gram occurs once has no repeated window;
2. the digit is the hull, all bytes that windows with this anchor can reach; if it occurs twice, all these
   windows are repeated, and its copies leave but for one;
3. the digits are the bytes left and right of the gram: for each offset of the window from the anchor, the
   distinct hulls of a gram are grouped by the bytes that the window has on either side.

A gram that holds many anchors is dealt over several tasks by hull, and a hull that does by document; such keys
come from a sample of documents. Groups of the third pass hold distinct hulls of one gram. Up to ``CLASS`` of them are one sort in memory;
the windows of larger groups are counted by a shuffle on their digests, with map-side combining.

Defined results: null text is empty; texts shorter than the window lose nothing; repeated rows are
documents of their own, so all windows of theirs are repeated; matches never cross documents; a null id is
returned as it is; texts of any length are read whole; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.llm.graph import groups
from probeloom.llm.hot import SALTS, among, hot_keys, sampled
from probeloom.llm.scratch import cut
from probeloom.llm.sieve import sieve
from probeloom.llm.slabs import _BASE, _TABLE, Slab, mix, slabs, span_hash, tidied, windows

WINDOW, GRAM = 400, 128
REACH = WINDOW - GRAM
#: Distinct hulls of a gram that are compared in one task at most.
CLASS = 8192
#: Words of a passage that counts as shared between documents, and of the runs that are compared.
PASSAGE, SHINGLE = 50, 30
_U = np.uint64


def anchors(slab: Slab) -> dict[str, np.ndarray]:
    """Anchors of all windows of the slab's texts: text, at (in the text), lo and hi (offsets from window start to anchor), key, hull."""
    n, none = len(slab.data), np.zeros(0, np.int64)
    sizes = np.diff(slab.offs)
    if not (sizes >= WINDOW).any():
        return {"text": none, "at": none, "lo": none, "hi": none, "key": none.view(_U), "hull": none.view(_U)}
    prefix = slab.prefix()
    i = np.arange(n - GRAM + 1)
    value = (span_hash(prefix, i, i + GRAM) >> _U(32) << _U(32)) | i.astype(_U)
    width = REACH + 1
    padded = np.full(-(-len(value) // width) * width, ~_U(0))
    padded[: len(value)] = value
    blocks = padded.reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    edge = np.zeros(n + 1, np.int64)
    long = sizes >= WINDOW
    np.add.at(edge, slab.offs[:-1][long], 1)
    np.add.at(edge, slab.offs[1:][long] - WINDOW + 1, -1)
    p = np.flatnonzero(np.cumsum(edge)[:n])
    at = (np.minimum(back[p], forth[p + width - 1]) & _U(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(slab.offs, p, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([first[1:], [len(p)]]) - 1
    a, t = at[first], text[first]
    begin, end = np.maximum(slab.offs[t], a - REACH), np.minimum(slab.offs[t + 1], a + WINDOW)
    with np.errstate(over="ignore"):
        hull = mix(span_hash(prefix, begin, end) + (a - begin).astype(_U) * _U(_BASE))
    return {"text": t, "at": a - slab.offs[t], "lo": a - p[last], "hi": a - p[first], "key": span_hash(prefix, a, a + GRAM), "hull": hull}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == _U else x, pa.int64())


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each hull of each text, with all places where the text has it: a periodic text has few hulls."""
    for batch in batches:
        at = 0
        for slab in slabs(batch.column(3)):
            found = anchors(slab)
            order = np.lexsort((found["at"], found["hull"], found["key"], found["text"]))
            found = {k: v[order] for k, v in found.items()}
            new = np.ones(len(order), bool)
            for_all = [found[k][1:] == found[k][:-1] for k in ("text", "key", "hull")]
            new[1:] = ~np.logical_and.reduce(for_all)
            first = np.flatnonzero(new)
            places = pa.ListArray.from_arrays(np.concatenate([first, [len(order)]]).astype(np.int32), pa.array(found["at"], pa.int64()))
            found = {k: v[first] for k, v in found.items()}
            ids = [batch.column(c).slice(at, slab.rows).take(pa.array(found["text"])) for c in range(3)]
            at += slab.rows
            yield pa.RecordBatch.from_arrays([_signed(found["key"]), _signed(found["hull"]), *ids, places, _signed(found["lo"]), _signed(found["hi"])], names=["key", "hull", "d", "t1", "t2", "places", "lo", "hi"])


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and hull: those whose key occurs twice, with ``twice`` (so does the hull) and ``lead`` (first of its hull).

    A task has one part of a hot key (hot 1: whole hulls; 2: some rows of one hull), which occurs elsewhere too.
    """
    held = None

    def done(table: pa.Table, more: tuple[int, int] | None, less: tuple[int, int] | None) -> pa.Table:
        key, hull = (np.concatenate([[x[c] if x else 0] for x in (less,)] + [table.column(c).to_numpy()] + [[x[c] if x else 0] for x in (more,)]) for c in (0, 1))
        same_key, same_hull = key[1:] == key[:-1], (key[1:] == key[:-1]) & (hull[1:] == hull[:-1])
        if less is None:
            same_key[0] = same_hull[0] = False
        if more is None:
            same_key[-1] = same_hull[-1] = False
        several = pc.greater(pc.list_value_length(table.column(5)), 1).combine_chunks().to_numpy(zero_copy_only=False)
        hot = table.column(8).to_numpy()
        out = table.drop_columns(["hot"]).append_column("twice", pa.array(same_hull[1:] | same_hull[:-1] | several | (hot == 2))).append_column("lead", pa.array(~same_hull[:-1]))
        return out.filter(pa.array(same_key[1:] | same_key[:-1] | several | (hot > 0)))

    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        head = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
        if held is not None:
            yield from done(held, head, before).to_batches()
            before = (held.column(0)[-1].as_py(), held.column(1)[-1].as_py())
        held = pa.Table.from_batches([batch])
    if held is not None:
        yield from done(held, None, before).to_batches()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around the anchors of each text: REACH before, and REACH after the gram, zeros beyond the text."""
    for batch in batches:
        out: list[tuple] = []
        for text, found in zip(batch.column(0), batch.column(1), strict=True):
            data = (text.as_py() or "").encode()
            for a in found.as_py():
                left = data[max(0, a["at"] - REACH) : a["at"]]
                right = data[a["at"] + GRAM : a["at"] + WINDOW]
                out.append((a["key"], a["hull"], a["many"], a["lo"], a["hi"], left.rjust(REACH, b"\0") + right.ljust(REACH, b"\0")))
                if len(out) >= 4096:
                    yield _context_batch(out)
                    out = []
        if out:
            yield _context_batch(out)


def _context_batch(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=["key", "hull", "many", "lo", "hi", "around"])


def _window_digests(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each offset: which rows have such a window, and the digests of these windows (with their key)."""
    key = table.column(0).to_numpy().view(_U)
    lo, hi = table.column(3).to_numpy(), table.column(4).to_numpy()
    around = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(len(key), 2 * REACH)
    left, right = around[:, :REACH], around[:, REACH:]
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[_U(1)], np.full(REACH, _U(_BASE))]))
        before = np.zeros(len(key), _U)
        after = np.zeros(len(key), _U)
        for e in range(REACH):
            after += _TABLE[right[:, e]] * up[e]
        for d in range(REACH + 1):  # the window has d bytes before the anchor and REACH - d after its gram
            here = np.flatnonzero((lo <= d) & (d <= hi))
            if len(here):
                yield d, here, mix(mix(before[here] + key[here]) + after[here] * _U(0xD6E8FEB86659FD93))
            if d < REACH:
                before += _TABLE[left[:, REACH - 1 - d]] * up[d]
                after -= _TABLE[right[:, REACH - 1 - d]] * up[REACH - 1 - d]


def _small_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, hull, d of the windows that occur twice among the distinct hulls of their key; whole keys at a time."""
    held: list[pa.Table] = []
    size = 0

    def done() -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(held).combine_chunks()
        hull, key = table.column(1).to_numpy(), table.column(0).to_numpy()
        new = np.concatenate([[True], (hull[1:] != hull[:-1]) | (key[1:] != key[:-1])])  # a hull read twice counts once
        table = table.filter(pa.array(new))
        key, hull = key[new], hull[new]
        for d, here, digest in _window_digests(table):
            order = np.argsort(digest)
            ranked = digest[order]
            same = np.concatenate([[False], ranked[1:] == ranked[:-1], [False]])
            hit = here[order[same[1:] | same[:-1]]]
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(hull[hit]), pa.array(np.full(len(hit), d))], names=["key", "hull", "d"])

    for group in groups(batches, 1):
        held.append(group)
        size += group.num_rows
        if size >= CLASS:
            yield from done()
            held, size = [], 0
    if held:
        yield from done()


def _large_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        key, hull = (table.column(c).to_numpy() for c in (0, 1))
        for d, here, digest in _window_digests(table):
            yield pa.RecordBatch.from_arrays([pa.array(key[here]), pa.array(hull[here]), pa.array(np.full(len(here), d)), _signed(digest)], names=["key", "hull", "d", "w"])


def _long(docs: DataFrame, least: int) -> DataFrame:
    return docs.select(F.coalesce("d", F.lit(0)).alias("d"), "t1", "t2", "text").where(F.octet_length("text") >= least)


def repeated_spans(docs: DataFrame, class_rows: int = CLASS, sample: DataFrame | None = None) -> DataFrame:
    """t1, t2 (digest of a text), spans: the byte ranges [a, b) of each text that repeated windows cover, not merged."""
    rows = _long(docs, WINDOW)
    schema = "key long, hull long, d long, t1 long, t2 long, places array<long>, lo long, hi long"
    found = rows.mapInArrow(tidied(_anchor_rows), schema)
    some = cut(_long(sampled(docs) if sample is None else sample, WINDOW).mapInArrow(tidied(_anchor_rows), schema).select("key", "hull"), "sample")
    hot = F.when(among(hot_keys(some, "key", "hull"), "key", "hull"), 2).when(among(hot_keys(some, "key"), "key"), 1).otherwise(0)
    part = F.when(F.col("hot") == 2, F.pmod(F.xxhash64("t1", "t2", "d"), F.lit(SALTS))).when(F.col("hot") == 1, F.pmod("hull", F.lit(SALTS))).otherwise(0)
    dealt = found.withColumn("hot", hot).repartition("key", part).sortWithinPartitions("key", "hull")
    kept = cut(dealt.mapInArrow(tidied(_second_pass), found.schema.add("twice", "boolean").add("lead", "boolean")), "anchors")
    lead = kept.where("lead")
    many = cut(lead.groupBy("key").agg(F.count("*").alias("hulls")).where("hulls > 1"), "hulls")  # written, so that Spark can split a large key in the join
    lead = lead.join(many, "key").withColumn("many", F.col("hulls") > class_rows)
    wanted = lead.groupBy("d", "t1", "t2").agg(F.collect_list(F.struct("key", "hull", "many", F.col("places")[0].alias("at"), "lo", "hi")).alias("found"))
    around = sieve(rows, "t1", lead, "t1").join(wanted, ["d", "t1", "t2"]).select("text", "found").mapInArrow(tidied(_contexts), "key long, hull long, many boolean, lo long, hi long, around binary")
    around = cut(around, "around")
    small = around.where("NOT many").repartition("key").sortWithinPartitions("key", "hull").mapInArrow(tidied(_small_classes), "key long, hull long, d long")
    large = around.where("many")
    hits = small
    if not large.isEmpty():
        windows = large.mapInArrow(tidied(_large_classes), "key long, hull long, d long, w long")
        twice = windows.groupBy("key", "d", "w").agg(F.min("hull").alias("x"), F.max("hull").alias("y")).where("x <> y")
        twice = cut(twice, "windows")
        hits = hits.union(windows.join(twice, ["key", "d", "w"]).select("key", "hull", "d"))
    offsets = hits.groupBy("key", "hull").agg(F.collect_set("d").alias("ds"))
    whole = kept.where("twice").select("t1", "t2", "lo", "hi", F.explode("places").alias("at")).select("t1", "t2", (F.col("at") - F.col("hi")).alias("a"), (F.col("at") - F.col("lo") + WINDOW).alias("b"))
    part = kept.where("NOT twice").join(offsets, ["key", "hull"]).select("t1", "t2", F.col("places")[0].alias("at"), F.explode("ds").alias("ds")).select("t1", "t2", (F.col("at") - F.col("ds")).alias("a"), (F.col("at") - F.col("ds") + WINDOW).alias("b"))
    return whole.union(part).groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """f, t1: of every run of PASSAGE words, the least hash among its runs of SHINGLE words, each once for a text."""
    width = PASSAGE - SHINGLE + 1
    for batch in batches:
        at = 0
        for slab in slabs(batch.column(1)):
            first, last, base = slab.words()
            key, _, to = windows(span_hash(slab.prefix(), first, last), base, SHINGLE, False)
            text = np.repeat(np.arange(slab.rows), np.diff(to))
            least = np.zeros(0, np.int64)
            if len(key) >= width:
                least = np.lib.stride_tricks.sliding_window_view(key, width).argmin(axis=1) + np.arange(len(key) - width + 1)
                least = least[text[: len(least)] == text[width - 1 :]]
            least = np.unique(least)
            order = least[np.lexsort((key[least], text[least]))]
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1])
            order = order[new]
            yield pa.RecordBatch.from_arrays([_signed(key[order]), batch.column(0).slice(at, slab.rows).take(pa.array(text[order]))], names=["f", "t1"])
            at += slab.rows


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t1 of rows sorted by f whose f occurs twice."""
    held = before = None

    def done(table: pa.RecordBatch, less: int | None, more: int | None) -> pa.RecordBatch:
        f = table.column(0).to_numpy()
        same = np.concatenate([[less is not None and f[0] == less], f[1:] == f[:-1], [more is not None and f[-1] == more]])
        return pa.RecordBatch.from_arrays([pa.array(np.unique(table.column(1).to_numpy()[same[1:] | same[:-1]]))], names=["t1"])

    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield done(held, before, batch.column(0)[0].as_py())
                before = held.column(0)[-1].as_py()
            held = batch
    if held is not None:
        yield done(held, before, None)


def shared_passages(docs: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """t1 (digest) of every text that has a passage of ``PASSAGE`` words in common with another row of docs (d, t1, text).

    Two texts with such a passage have one of its fingerprints in common, a run of ``SHINGLE`` words, and texts
    that have one in common count. Fingerprints that hold many rows are found in a sample and not shuffled.
    """
    schema = "f long, t1 long"
    prints = _long(docs, 2 * PASSAGE - 1).select("t1", "text").mapInArrow(tidied(_fingerprints), schema)
    some = _long(sampled(docs) if sample is None else sample, 2 * PASSAGE - 1)
    hot = among(hot_keys(some.select("t1", "text").mapInArrow(tidied(_fingerprints), schema), "f"), "f")
    dealt = prints.withColumn("hot", hot).repartition("f", F.when(F.col("hot"), F.pmod("t1", F.lit(SALTS))).otherwise(0)).sortWithinPartitions("f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: list[pa.RecordBatch] = []

        def rare() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mark = batch.column(2)
                often.append(pa.RecordBatch.from_arrays([batch.column(1).filter(mark).unique()], names=["t1"]))
                yield pa.RecordBatch.from_arrays([c.filter(pc.invert(mark)) for c in batch.columns[:2]], names=["f", "t1"])

        for met in _met(rare()):
            yield from often
            often.clear()
            yield met
        yield from often

    return dealt.mapInArrow(tidied(run), "t1 long").distinct()


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeated(docs: DataFrame, class_rows: int = CLASS, passages: bool = True) -> DataFrame:
    """doc_id, kept (the text's bytes without repeated windows), n_bytes, n_removed, n_spans of every document.

    With ``passages``, shared_passage says whether the document also has a passage of ``PASSAGE`` words in common with
    another one (``shared_passages``), which may have fewer bytes than a window and then stays; it is null otherwise.
    """
    named = docs.select("doc_id", "text", F.col("doc_id").alias("d"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("t2"), "text").alias("t2"))
    sample = sampled(named)
    spans = repeated_spans(named, class_rows, sample)
    marks = shared_passages(named, sample).withColumn("shared", F.lit(True)) if passages else spans.select("t1").limit(0).withColumn("shared", F.lit(True))
    found = cut(spans.join(marks, "t1", "full_outer"), "spans")  # written, so that Spark can split a large group of copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                kept, sizes, removed, counts = [], [], [], []
                for text, found in zip(batch.column(1), batch.column(2), strict=True):
                    data, runs, parts, last = (text.as_py() or "").encode(), merged(found.as_py()), [], 0
                    for a, b in runs:
                        parts.append(data[last:a])
                        last = b
                    parts.append(data[last:])
                    kept.append(b"".join(parts))
                    sizes.append(len(data))
                    removed.append(len(data) - len(kept[-1]))
                    counts.append(len(runs))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), batch.column(3)], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "shared_passage"])

    match = (named["t1"] == found["t1"]) & (found["t2"].isNull() | (named["t2"] == found["t2"]))  # a text that only shares a passage is known by t1
    joined = named.join(found, match, "left").select(F.col("doc_id").cast("long"), "text", "spans", F.coalesce("shared", F.lit(False if passages else None)).alias("shared"))
    return joined.mapInArrow(tidied(run), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, shared_passage boolean")


def brute(texts: list[bytes], window: int = WINDOW) -> list[list[bool]]:
    """Which bytes of each text a repeated window covers, by counting every window; for tests."""
    seen: dict[bytes, int] = {}
    digest = lambda t, i: hashlib.blake2b(t[i : i + window], digest_size=16).digest()
    for t in texts:
        for i in range(len(t) - window + 1):
            k = digest(t, i)
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t in texts:
        hit = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[digest(t, i)] > 1:
                hit[i : i + window] = [True] * window
        out.append(hit)
    return out
