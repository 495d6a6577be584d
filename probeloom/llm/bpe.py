"""Operator 2: byte-level BPE encoding by backtracking over longest matches, and decoding.

Bytes stand as Latin-1 characters in an Aho-Corasick automaton over the vocabulary, which gives the
longest token that begins at each byte of a piece. The encoder takes longest matches and backs off to
the next shorter token when the last two tokens could not stand side by side in a merge sequence.
Whether two tokens may be neighbours depends on those two alone, so that answer is memoised and every
position fails at most once: the time is linear in the piece.

The pieces of a portion of texts that are not known yet go through this together: one run of the automaton
over all of them, then steps of the backtracking for all pieces at once as array operations. Long pieces
are encoded one by one. Known pieces are kept in two generations, so a full memo loses only what was not
met again; answers about neighbours are kept in a table of fixed size. ``round_trip`` encodes, decodes and
digests in one pass of Python over the texts.

Defined results: a null text encodes as the empty text (no ids); an empty table gives an empty one; texts of
any length are encoded whole, piece by piece; repeated rows give equal rows; null ids decode to null; other
columns of the input pass through ``encode`` and ``decode`` untouched unless they bear the name of an output
column, which replaces them, and ``round_trip`` ignores them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeloom.llm.slabs import tidied

#: Pieces in a generation of the memo.
MEMO = 120_000
#: Slots of the table of neighbours, entries of the dictionary that single pieces use.
SLOTS, FITS = 1 << 18, 50_000
#: Bytes of a piece up to which it is encoded together with others, and pieces that are so at a time.
SHORT, TOGETHER = 64, 16_384
#: Characters of a text from which its pieces are taken in portions.
LONG = 1 << 20
#: Bytes of text in a portion (about).
PORTION = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file, read on the driver (a vocabulary is a few MB)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Codec:
    """Exact BPE of one vocabulary: the pair with the lowest rank merges first, the leftmost of equals.

    The driver finds how the tokens are made of each other; ``state`` has that as arrays of a few MB for the tasks,
    from which ``restore`` builds the lookups and the automaton.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.width = max(self.token, default=0) + 1
        self.size = [len(self.token.get(i, b"")) for i in range(self.width)]
        self.shorter = [-1] * self.width
        for t, i in ranks.items():
            self.shorter[i] = next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), -1)
        self.merged: dict[int, int] = {}  # by left * width + right
        self.left, self.right = list(range(self.width)), list(range(self.width))
        self._fits: dict[tuple[int, int], bool] = {}
        self.apart: set[int] = set()  # tokens that no sequence of merges makes; they stand for whole pieces only
        for i in sorted(self.token):
            self.left[i], self.right[i] = self._split(i)
        while self.apart & set(self.shorter):
            self.shorter = [self.shorter[s] if s in self.apart else s for s in self.shorter]
        self._ready()

    def state(self) -> dict:
        order = sorted(self.token)
        number = lambda x: np.array(x, np.int32)
        return {
            "bytes": b"".join(self.token[i] for i in order), "ids": number(order), "size": number(self.size), "shorter": number(self.shorter), "left": number(self.left), "right": number(self.right),
            "pairs": np.fromiter(self.merged, np.int64, len(self.merged)), "made": np.fromiter(self.merged.values(), np.int32, len(self.merged)), "apart": number(sorted(self.apart)),
        }

    @classmethod
    def restore(cls, state: dict) -> Codec:
        self = cls.__new__(cls)
        self.size, self.shorter, self.left, self.right = (state[k].tolist() for k in ("size", "shorter", "left", "right"))
        self.width, self.apart = len(self.size), set(state["apart"].tolist())
        self.token, at = {}, 0
        for i in state["ids"].tolist():
            self.token[i] = state["bytes"][at : at + self.size[i]]
            at += self.size[i]
        self.ranks = {t: i for i, t in self.token.items()}
        self.merged = dict(zip(state["pairs"].tolist(), state["made"].tolist(), strict=True))
        self._ready()
        return self

    def _ready(self) -> None:
        """The automaton, and by token id the arrays that the encoding of many pieces and the decoding look up."""
        import ahocorasick

        self._fits = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            if i not in self.apart:
                self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._size, self._shorter, self._left, self._right = (np.array(x, np.int64) for x in (self.size, self.shorter, self.left, self.right))
        keys = np.fromiter(self.merged, np.int64, len(self.merged))
        order = np.argsort(keys)
        self._pairs = keys[order]
        self._made = np.fromiter(self.merged.values(), np.int64, len(keys))[order]
        self._known, self._ok = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self._bytes = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(self.width)), np.uint8)
        self._begin = np.cumsum(self._size) - self._size

    def _split(self, i: int) -> tuple[int, int]:
        """The two tokens whose merge is token i; the token itself for a single byte."""
        whole, left = self.token[i], self.shorter[i]
        if len(whole) == 1:
            return i, i
        while left != -1:
            right = self.ranks.get(whole[self.size[left] :])
            if right is not None and left < i and right < i and left not in self.apart and right not in self.apart and self.fits(left, right):
                self.merged[left * self.width + right] = i
                return left, right
            left = self.shorter[left]
        self.apart.add(i)
        return i, i

    def fits(self, a: int, b: int) -> bool:
        """May a and b be neighbours: no merge across their border comes before the merges that made them."""
        key = (a, b)
        known = self._fits.get(key)
        if known is not None:
            return known
        limit, ok = 1 << 62, True
        while True:
            across = self.merged.get(a * self.width + b)
            if across is not None and across < limit:
                ok = False
                break
            if a > b:  # undo the later of the two merges; of equals, the right one was later
                limit, a = a, self.right[a]
                if a == limit:
                    limit, b = b + 1, self.left[b]
                    if b + 1 == limit:
                        break
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    if a == limit:
                        break
        if len(self._fits) >= FITS:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def _walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs at once."""
        ok, at, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), np.int64(1) << 62)
        while len(at):
            key = a * self.width + b
            place = np.minimum(np.searchsorted(self._pairs, key), max(0, len(self._pairs) - 1))
            across = len(self._pairs) > 0
            bad = (self._pairs[place] == key) & (self._made[place] < limit) if across else np.zeros(len(a), bool)
            ok[at[bad]] = False
            first, right, left = a > b, self._right[a], self._left[b]
            end_a, end_b = right == a, left == b
            take_a = np.where(first, ~end_a, end_b)  # a is undone where it is its turn, or where b cannot be
            over = np.where(first, end_a & end_b, end_a & end_b)
            limit = np.where(take_a, a, b + 1)
            a, b = np.where(take_a, right, a), np.where(take_a, b, left)
            go = ~bad & ~over
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return ok

    def fits_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs, by way of the table of neighbours: a slot keeps the last pair that fell on it."""
        key = a * self.width + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        out, new = self._ok[slot], np.flatnonzero(self._known[slot] != key)
        if len(new):
            out[new] = self._walk(a[new], b[new])
            self._known[slot[new]], self._ok[slot[new]] = key[new], out[new]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        out: list[bytes | None] = [None] * len(pieces)
        short = []
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > SHORT:
                out[i] = np.array(self.encode_piece(p), "<u4").tobytes()
            else:
                short.append(i)
        for k in range(0, len(short), TOGETHER):
            some = short[k : k + TOGETHER]
            for i, packed in zip(some, self._together([pieces[i] for i in some]), strict=True):
                out[i] = packed
        return out

    def _together(self, pieces: list[bytes]) -> Iterator[bytes]:
        """Packed ids of short pieces that are no tokens: the backtracking of all of them, step by step."""
        text = "\u0100".join([p.decode("latin-1") for p in pieces])  # no token has the mark between them
        found = np.fromiter(self.automaton.iter(text), [("end", np.int64), ("token", np.int64)])
        longest = np.full(len(text) + 1, -1)
        longest[found["end"] + 1 - self._size[found["token"]]] = found["token"]  # ends ascend, so the longest is the last
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.cumsum(lengths + 1) - lengths - 1
        stop = at + lengths
        failed, depth = np.zeros(len(text) + 1, bool), np.zeros(len(pieces), np.int64)
        taken = np.zeros((len(pieces), int(lengths.max()) + 1), np.int64)
        token, live = longest[at], np.arange(len(pieces))
        while len(live):
            t, end, d = token[live], at[live] + self._size[token[live]], depth[live]
            ok = ~failed[end]
            check = np.flatnonzero(ok & (d > 0))
            ok[check] = self.fits_many(taken[live[check], d[check] - 1], t[check])
            on = live[ok]
            taken[on, depth[on]] = t[ok]
            depth[on] += 1
            at[on] = end[ok]
            token[on] = longest[at[on]]
            off = live[~ok]
            token[off] = self._shorter[t[~ok]]
            off = off[token[off] < 0]
            while len(off):  # nothing shorter: the position fails, and the token before it is shortened
                failed[at[off]] = True
                depth[off] -= 1
                last = taken[off, depth[off]]
                at[off] -= self._size[last]
                token[off] = self._shorter[last]
                off = off[token[off] < 0]
            live = live[at[live] < stop[live]]
        packed = taken[np.arange(taken.shape[1]) < depth[:, None]].astype("<u4").tobytes()
        ends = (4 * np.cumsum(depth)).tolist()
        return (packed[a:b] for a, b in zip([0, *ends], ends))

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, size, shorter, fits = len(piece), self.size, self.shorter, self.fits
        longest = [-1] * n
        for end, tok in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size[tok]] = tok  # ends ascend, so the longest is the last
        failed, out, at, tok = bytearray(n + 1), [], 0, longest[0]
        while at < n:
            end = at + size[tok]
            if not failed[end] and (not out or fits(out[-1], tok)):
                out.append(tok)
                at = end
                tok = longest[at] if at < n else -1
                continue
            tok = shorter[tok]
            while tok == -1:
                failed[at] = 1
                last = out.pop()
                at -= size[last]
                tok = shorter[last]
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of packed little-endian 32-bit ids."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        size = self._size[i]
        to = np.cumsum(size)
        return self._bytes[np.repeat(self._begin[i] - to + size, size) + np.arange(to[-1] if len(to) else 0)].tobytes()


class _Packed(dict):
    """Pieces and their packed ids in two generations: what the older one has moves here when it is met again."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self[piece] = self.old[piece]
        return out

    def learn(self, pieces: list[str]) -> None:
        """Makes sure that all these pieces can be looked up until the next call."""
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        new = list(set(pieces).difference(self, self.old)) if len(pieces) < len(self.old) else [p for p in set(pieces) if p not in self and p not in self.old]
        self.update(zip(new, self.codec.encode_pieces([p.encode() for p in new]), strict=True))


@lru_cache(4)
def _pattern(text: str):
    import regex

    return regex.compile(text)


def pack(texts: list[str | None], pattern, memo: _Packed) -> list[bytes]:
    """Packed ids of each text; texts together are a portion of a few MB at most, but for one long text alone."""
    if len(texts) == 1 and len(texts[0] or "") >= LONG:
        pieces, parts = (m.group() for m in pattern.finditer(texts[0])), []
        while some := list(islice(pieces, 100_000)):
            memo.learn(some)
            parts.append(b"".join(map(memo.__getitem__, some)))
        return [b"".join(parts)]
    split = [pattern.findall(t) if t else [] for t in texts]
    memo.learn(list(chain.from_iterable(split)))
    return [b"".join(map(memo.__getitem__, pieces)) for pieces in split]


def _pack(text: str | None, pattern, memo: _Packed) -> bytes:
    """Packed ids of one text."""
    return pack([text], pattern, memo)[0]


def _portions(column: pa.Array, limit: int = PORTION) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes each, a longer value alone."""
    size = np.diff(np.frombuffer(column.cast(pa.large_binary()).buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int64)
    to, at = np.cumsum(size), 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(to, (to[at - 1] if at else 0) + limit, "right")))
        yield at, end
        at = end


def _with(df: DataFrame, source: str, out: str, begin, work) -> DataFrame:
    """df with the binary column ``out`` = work(begin() of the task, values of ``source`` in a portion of rows)."""
    keep = [c for c in df.columns if c != out]
    frame = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{source}`").alias(out))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = held or begin()
            last = batch.num_columns - 1
            for a, b in _portions(batch.column(last)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(work(held, part.column(last).to_pylist()), pa.binary())], names=part.schema.names)

    return frame.mapInArrow(tidied(run), schema)


def _shared(df: DataFrame, ranks: dict[bytes, int]) -> Broadcast:
    """What tasks need of the vocabulary (a few MB, whatever the corpus)."""
    return df.sparkSession.sparkContext.broadcast(Codec(ranks).state())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column of packed little-endian 32-bit token ids for each text; one row for each row."""
    shared = _shared(docs, ranks)
    return _with(docs, text, ids, lambda: (_Packed(Codec.restore(shared.value)),), lambda held, values: pack(values, _pattern(pattern), held[0]))


def decode(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with a binary column of the bytes that the packed ids stand for; null ids give null."""
    shared = _shared(rows, ranks)
    return _with(rows, ids, out, lambda: (Codec.restore(shared.value),), lambda held, values: [None if v is None else held[0].decode(v) for v in values])


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (packed; left out without ``ids``), ids_sha256, decoded_sha256 of every document.

    A task builds its codec and memo and drops them at its end, so they do not stay in workers that go on to other work.
    """
    shared = _shared(docs, ranks)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    names = ["doc_id", "n_tokens", *["ids"] * ids, "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = None
        for batch in batches:
            memo = _Packed(Codec.restore(shared.value)) if memo is None else memo
            for a, b in _portions(batch.column(1)):
                packed = pack(batch.column(1).slice(a, b - a).to_pylist(), _pattern(pattern), memo)
                columns = [pa.array([len(p) // 4 for p in packed], pa.int64()), *[pa.array(packed, pa.binary())] * ids, pa.array(map(digest, packed)), pa.array([digest(memo.codec.decode(p)) for p in packed])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=names)

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(f"n_tokens long, {'ids binary, ' * ids}ids_sha256 string, decoded_sha256 string").fields])
    return docs.select("doc_id", "text").mapInArrow(tidied(run), schema)
