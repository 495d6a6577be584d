"""Vectorised views of many texts at once: Arrow buffers as byte arrays, words, lines and span hashes.

A slab is a run of consecutive rows of an Arrow string column whose bytes lie in one array, of half a
MB about (a longer text makes a slab of its own), so numpy temporaries stay bounded.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which after its task gives the memory that it freed back to the system: workers stay alive and wait beside other tasks."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15))


_TABLE = stream(0x5EED, 256)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) <= n:
        size = max(SLAB_BYTES + 1, n + 1)
        for name, base in (("up", _BASE), ("down", _INV)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Slab:
    first: int  #: row of the batch with which the slab begins
    data: np.ndarray  #: bytes of all its texts
    offs: np.ndarray  #: where each text begins; one more entry for the end

    @property
    def rows(self) -> int:
        return len(self.offs) - 1

    def prefix(self, table: np.ndarray | None = None) -> np.ndarray:
        """Prefix sums for ``span_hash``; ``table`` may fold bytes (as LOWER does) before hashing."""
        up, _ = _power(len(self.data))
        with np.errstate(over="ignore"):
            out = np.zeros(len(self.data) + 1, _U)
            np.cumsum(_TABLE[self.data if table is None else table[self.data]] * up[: len(self.data)], out=out[1:])
        return out

    def words(self, gaps: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs without gaps (bytes, ASCII white space by default); per text, the index of its first word."""
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = ~gaps[self.data]
        first = np.zeros(len(self.data) + 1, bool)
        first[self.offs] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
        return starts, ends, np.searchsorted(starts, self.offs)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the \\n-split lines (an empty text has one, empty); per text, the index of its first line."""
        cuts = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.offs[:-1], cuts + 1])
        kind = np.concatenate([np.zeros(self.rows, np.int8), np.ones(len(cuts), np.int8)])
        text = np.concatenate([np.arange(self.rows), np.searchsorted(self.offs, cuts, "right") - 1])
        order = np.lexsort((starts, kind, text))
        starts, text = starts[order], text[order]
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        base = np.searchsorted(text, np.arange(self.rows + 1))
        ends[base[1:] - 1] = self.offs[1:]
        return starts, ends, base


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever the same bytes lie."""
    _, down = _power(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))


def slabs(column: pa.Array, limit: int = SLAB_BYTES) -> Iterator[Slab]:
    """Slabs of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        to = min(to, n)
        yield Slab(at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


def per_text(values: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Sums of values[base[i]:base[i+1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[base[1:]] - total[base[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: does its key occur twice or more; is it a later occurrence of an earlier one."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    if len(keys) > 1:
        same[1:-1] = ranked[1:] == ranked[:-1]
    twice, later = np.empty(len(keys), bool), np.empty(len(keys), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def windows(words: np.ndarray, base: np.ndarray, width: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words within each text, the first word of each, and where each text's begin.

    ``short``: a text with fewer words (but some) gives its whole sequence as one run.
    """
    count = np.diff(base)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1) if short else 0)
    to = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(to[-1], _U)
    at = np.repeat(base[:-1] - to[:-1], made) + np.arange(to[-1])
    length = np.repeat(np.minimum(count, width), made)
    full = bool((length == width).all())
    with np.errstate(over="ignore"):
        for k in range(width):
            if full:
                out = mix((out + words[at + k]) * _U(_BASE))
            else:
                here = k < length
                out[here] = mix((out[here] + words[at[here] + k]) * _U(_BASE))
    return out, at, to


def shingles(slab: Slab, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text (A-Z folded to a-z) and where each text's begin.

    A text with fewer words gives its whole sequence as one shingle; without words, none. Repeats stay.
    """
    starts, ends, base = slab.words()
    out, _, to = windows(span_hash(slab.prefix(LOWER), starts, ends), base, width, True)
    return out, to


def within(keys: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Keys made different from text to text, so that equal ones meet within a text only."""
    with np.errstate(over="ignore"):
        return mix(keys + np.repeat(np.arange(1, len(base), dtype=_U), np.diff(base)) * _U(_BASE))
