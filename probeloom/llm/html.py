"""Operator 7: main text of web pages, by differencing against the page with the nearest URL and by structure.

A tolerant tokenizer turns html into lines (blocks) and marks each: boilerplate by its element (menus,
headers, footers, sidebars, adverts, notices, comments, forms), main (within article, or within main if the
page has no article), beside (within main, but outside the page's article), or open.
Differencing meets every page: pages are sorted by host and path over range partitions, every page is paired
with that neighbour in its host whose path agrees longer, the two pages' lines are aligned by longest common
subsequence, and shared lines are deleted. Then the marks check what is left: lines of boilerplate elements go
although no neighbour shares them, and shared main lines come back, for articles repeat lines of each other. So
do the open lines of a page that agrees with its neighbour in almost all of them (``COPY``) and the lines beside
an article that agrees as much: such a page is a copy.

The keys are written once; cut points and the pages at the edges of partitions come from them (``MAX_PARTS``
times ``SAMPLE`` on the driver at most). Pages are parsed once and sorted with the texts of their lines but
without html; edge pages travel to both sides, as digests of their lines. A partition is streamed, three pages
in memory at a time. A row repeated so often that it fills partitions (equal cut points) is dealt over them.

Defined results: null or empty html gives an empty text; a null url belongs to no host and is not paired;
a page alone in its host keeps its open lines; repeated rows are pages of their own, paired with their
copies; very long pages are read whole; of neighbours whose paths agree equally the one before counts; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from random import Random

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.llm.scratch import cut
from probeloom.llm.slabs import tidied
from probeloom.llm.urls import host_and_path

#: Pages of a sort partition (about), sort partitions at most, and keys sampled for each cut point.
PART_ROWS, MAX_PARTS, SAMPLE = 20_000, 10_000, 40
#: Share of its open lines, or of its article, from which a page counts as a copy of its neighbour.
COPY = 0.8
#: Equal pairs of lines that an alignment looks at one by one; with more of them the pages are halved first.
MATCHES = 200_000
#: Comments, elements whose content is no text, and tags. Every part runs forward only: a tag that is not closed ends at the
#: next "<", and a quote without an end is a character like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|button)\b.*?(?:</\1\s*>|\Z)|</?[a-zA-Z](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+(?:>|(?=<)|\Z)|<[!?][^<>]*+(?:>|(?=<)|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(.*)", re.S)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BARE = frozenset("nav header footer aside form menu head title dialog".split())
_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header menu masthead nav navbar navigation newsletter notice notices pagination pager popup modal promo promotion related share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo search skip".split())
#: Parts of a class name that say where something stands, not what it is.
_PLACES = frozenset("area bar block bottom box container content global inner item items left links list main outer page primary right secondary section site slot small sticky the top unit wrap wrapper".split())
_SPACE = re.compile(r"\s+")
BOILER, OPEN, MAIN, BESIDE = 0, 1, 2, 3


def _says_boiler(token: str) -> bool:
    """A class, id or role that is one of the words, or made of them and of places (``site-header``, not ``social-science``)."""
    parts = [p for p in re.split(r"[^a-z]+", token.lower()) if p]
    return any(p in _WORDS for p in parts) and all(p in _WORDS or p in _PLACES for p in parts)


def _is_boiler(name: str, rest: str) -> bool:
    if name in _BARE:
        return True
    if not rest or name in ("html", "body", "main"):
        return False
    return any(_says_boiler(token) for a, b, c in _MARK.findall(rest) for token in (a or b or c).split())


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """The page's blocks in order, white space joined and trimmed, each BOILER, OPEN, MAIN or BESIDE."""
    out: list[tuple[str, int]] = []
    open_names: dict[str, int] = {}
    stack: list[tuple[str, int, int]] = []  # element, mark outside it, and where an inline advert or the like begins in the buffer
    kind, buffer, at, html = OPEN, [], 0, html or ""

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", unescape("".join(buffer))).strip()
            if text:
                out.append((text, kind))
            buffer.clear()

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            buffer.append(html[at : m.start()])
        at = m.end()
        tag = None if m.group(1) else _TAG.fullmatch(m.group().removesuffix(">"))
        if tag is None:
            continue
        name = tag.group(2).lower()
        if name in _BLOCK:
            flush()
        elif name == "br":
            buffer.append(" ")
            continue
        if name in _VOID:
            continue
        if tag.group(1):
            for k in range(len(stack) - 1 if open_names.get(name) else -1, -1, -1):
                if stack[k][0] == name:
                    for gone, _, _ in stack[k:]:
                        open_names[gone] -= 1
                    kind = stack[k][1]
                    inline = [m for _, _, m in stack[k:] if m >= 0]
                    if inline:
                        del buffer[min(inline) :]
                    del stack[k:]
                    break
        elif name in _BLOCK or name in ("span", "a"):
            if name == "p" and stack and stack[-1][0] == "p":
                kind = stack.pop()[1]
                open_names["p"] -= 1
            open_names[name] = open_names.get(name, 0) + 1
            if name not in _BLOCK:
                stack.append((name, kind, len(buffer) if kind != BOILER and _is_boiler(name, tag.group(3)) else -1))
                continue
            stack.append((name, kind, -1))
            if name == "article" and _is_boiler(name, tag.group(3)):
                kind = BOILER
            elif name in ("article", "main") and not (kind == BOILER and any(s[0] not in ("nav", "header", "footer", "menu") and s[1] != BOILER for s in stack[-2:-1])):
                kind = MAIN if name == "article" or kind == MAIN else BESIDE
            elif kind != BOILER and _is_boiler(name, tag.group(3)):
                kind = BOILER
    if at < len(html):
        buffer.append(html[at:])
    flush()
    return out if any(k == MAIN for _, k in out) else [(t, MAIN if k == BESIDE else k) for t, k in out]


def _few(a: list[int], b: list[int]) -> set[int]:
    """Positions in a of a longest common subsequence of a and b (Hunt-Szymanski)."""
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            k = bisect_right(tails, j - 1)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Length of the longest common subsequence of b and each beginning of a, a row of bits for each line of b."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        met = row & masks.get(y, 0)
        row = (row + met | row - met) & full
    return [0, *accumulate(bit == "0" for bit in reversed(f"{row:0{len(a)}b}"))]


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions in a of a longest common subsequence of a and b; equal ends and lines of one page alone are set aside first."""
    out: set[int] = set()
    todo = [(list(enumerate(a)), b)]
    while todo:
        one, two = todo.pop()
        both = {x for _, x in one}.intersection(two)
        one, two = [(i, x) for i, x in one if x in both], [y for y in two if y in both]
        n = next((k for k, ((_, x), y) in enumerate(zip(one, two)) if x != y), min(len(one), len(two)))
        out.update(i for i, _ in one[:n])
        one, two = one[n:], two[n:]
        n = next((k for k, ((_, x), y) in enumerate(zip(reversed(one), reversed(two))) if x != y), min(len(one), len(two)))
        out.update(i for i, _ in one[len(one) - n :])
        one, two = one[: len(one) - n], two[: len(two) - n]
        times, lines = Counter(two), [x for _, x in one]
        if sum(times[x] for x in lines) <= MATCHES:
            out.update(one[k][0] for k in _few(lines, two))
            continue
        half = len(two) // 2
        ahead, behind = _lengths(lines, two[:half]), _lengths(lines[::-1], two[half:][::-1])
        at = max(range(len(lines) + 1), key=lambda k: ahead[k] + behind[len(lines) - k])  # noqa: B023
        todo += [(one[:at], two[:half]), (one[at:], two[half:])]
    return out


def _nearest(page: dict, before: dict | None, after: dict | None) -> dict | None:
    """That neighbour of the same host whose path agrees longer; the one before in a tie."""
    best, length = None, -1
    for other in (before, after):
        if other is not None and page["host"] and other["host"] == page["host"]:
            n = next((i for i, (x, y) in enumerate(zip(page["path"], other["path"])) if x != y), min(len(page["path"]), len(other["path"])))
            if n > length:
                best, length = other, n
    return best


def deleted(kinds: list[int], codes: list[int], other: list[int]) -> tuple[set[int], int]:
    """Positions of lines that a page loses to another one, given the digests of both pages' lines, and the number of shared lines."""
    shared = shared_lines(codes, other)
    lines, common = Counter(kinds), Counter(kinds[i] for i in shared)
    given_back = {MAIN}
    if common[OPEN] >= COPY * lines[OPEN]:
        given_back.add(OPEN)
    if common[MAIN] >= COPY * lines[MAIN]:
        given_back.add(BESIDE)
    return {i for i in shared if kinds[i] not in given_back}, len(shared)


def _edges(keys: DataFrame) -> tuple[int, list[str], dict[str, list[int]]]:
    """Number of sort partitions, their cut points, and the partitions that the page of a key visits beside its own."""
    spark, pages = keys.sparkSession, keys.count()
    parts = min(MAX_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), pages // PART_ROWS))
    sample = sorted(r.k for r in keys.sample(min(1.0, SAMPLE * parts / max(1, pages)), seed=7).collect())  # about SAMPLE keys for each part
    cuts = [sample[len(sample) * i // parts] for i in range(1, parts)] if len(sample) > parts else sample

    @F.pandas_udf("int")
    def part(k):  # noqa: ANN001, ANN202
        return k.map(lambda x: bisect_right(cuts, x)).astype("int32")

    ends = keys.groupBy(part("k").alias("p")).agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("p").collect()  # one row for each part
    guests: dict[str, list[int]] = {}
    for one, two in zip(ends, ends[1:]):
        if one.b.split("\x00")[0] == two.a.split("\x00")[0]:
            guests.setdefault(one.b, []).append(two.p)
            guests.setdefault(two.a, []).append(one.p)
    return parts, cuts, guests


_PARSED = "k string, page_id long, url string, host string, path string, places array<int>, twin boolean, text string, kinds array<tinyint>, codes array<long>"
_JUDGED = "page_id long, url string, text string, n_chars long, paired long, n_shared long"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of sorted pages, each aligned with its nearest neighbour."""
    before = page = None
    out: list[tuple] = []

    def done(after: dict | None) -> None:
        if page is None or not page["own"]:
            return
        other = page if page["twin"] and page["host"] else _nearest(page, before, after if after and after["p"] == page["p"] else None)
        kinds, text = page["kinds"], page["text"]
        gone, n = deleted(kinds, page["codes"], other["codes"]) if other else (set(), None)
        if any(kinds[i] != BOILER for i in gone):
            kept = [i for i, kind in enumerate(kinds) if kind != BOILER]
            text = "\n".join(t for i, t in zip(kept, text.split("\n"), strict=True) if i not in gone)
        paired = other["page_id"] if other and (OPEN in kinds or BESIDE in kinds) else None
        out.append((page["page_id"], page["url"], text, len(text), paired, n))

    def made() -> pa.RecordBatch:
        rows = list(zip(*out)) if out else ((),) * 6
        out.clear()
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["page_id", "url", "text", "n_chars", "paired", "n_shared"])

    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            for row in whole.slice(at, 256).to_pylist():
                done(row)
                before, page = (page if page and page["p"] == row["p"] else None), row
            yield made()
    done(None)
    yield made()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, paired and n_shared of every page.

    n_shared counts the lines of all marks that the page shares with its nearest page in order (null: it has none);
    paired is that page's page_id if there are open lines, or lines beside an article, that differencing alone judges.
    """
    host, path = host_and_path("url")
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("k", F.concat_ws("\x00", "host", "path", F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0"), F.hex(F.xxhash64("url", "html"))))
    parts, cuts, guests = _edges(cut(rows.select("k"), "keys"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rng, sent = Random(TaskContext.get().partitionId()), set()
        types = (pa.list_(pa.int32()), pa.bool_(), pa.string(), pa.list_(pa.int8()), pa.list_(pa.int64()))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, out = whole.slice(at, 256), []
                for k, visits, html in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), batch.column(6)):
                    low, high = bisect_left(cuts, k), bisect_right(cuts, k)
                    twin = high - low > 1  # equal keys are equal rows: each has a copy, and one of them in a task stands for all as a neighbour
                    places = [rng.randint(low + 1, high) if twin else high]
                    if (visits or twin) and k not in sent:
                        sent.add(k)
                        places += [*(visits or ()), *([high] if twin else ())]
                    lines = lines_of(html.as_py())
                    codes = [xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in lines]
                    out.append((places, twin, "\n".join(t for t, kind in lines if kind), [kind for _, kind in lines], codes))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(c, t) for c, t in zip(zip(*out), types, strict=True))], names=["k", "page_id", "url", "host", "path", "places", "twin", "text", "kinds", "codes"])

    visits = pages.sparkSession.createDataFrame(list(guests.items()), "k string, visits array<int>")  # two visits for each part
    met = rows.join(F.broadcast(visits), "k", "left").select("k", "page_id", "url", "host", "path", "visits", "html")
    placed = met.mapInArrow(tidied(parse), _PARSED).select("k", "page_id", "url", "host", "path", "twin", "text", "kinds", "codes", F.posexplode("places").alias("visit", "p"))
    own = F.col("visit") == 0
    dealt = placed.select("p", "k", own.alias("own"), "page_id", F.when(own, F.col("url")).alias("url"), "host", "path", "twin", F.when(own, F.col("text")).alias("text"), "kinds", "codes")
    return dealt.repartitionById(parts, "p").sortWithinPartitions("p", "k").mapInArrow(tidied(_judge), _JUDGED)
