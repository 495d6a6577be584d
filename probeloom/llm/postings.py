"""Operator 11: benchmark decontamination by a distributed positional inverted index, with DataFrame functions only.

The index holds a posting (term, document, position) for each word of a document that some phrase holds, and one for
each document's end. It is sharded by document: every task inverts its own part and sorts it by term, so building it
shuffles nothing and a frequent term lies in all shards. Phrases are matched by their postings alone: the list of a
phrase's rarest term gives candidate starts, the list of the next one, shifted by its offset, leaves few of them, and
the lists of all other terms are read for the documents that are left. ``slop`` lets every word stand so many places
beside its own, which makes it a proximity search.

Terms and phrases are broadcast while they are few (``MAX_TERMS``, ``MAX_PHRASES``), and so are the documents that the
first two lists leave (``MAX_DOCUMENTS``); beyond that the same joins shuffle, on keys that no document or term fills.

Defined results: a null or empty text has no words; texts of any length are read whole; a row with an id and text
that another row has gets the same result; a null id is returned as it is; an item without an id marks words, and
counts as no item; items that have an id in common are one item; empty tables give no matches; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeloom.llm.scratch import cut

WIDTH = 10
MAX_TERMS, MAX_PHRASES, MAX_DOCUMENTS = 500_000, 500_000, 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, once A-Z are folded.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The term of the posting at a document's end; no word is empty.
END = ""
_KEY = ("doc_id", "h")


def words(text: str) -> Column:
    """The words of a text with A-Z folded."""
    plain = F.coalesce(F.col(text), F.lit(""))
    ascii_only = F.octet_length(plain) == F.length(plain)  # lower() is quick, and folds nothing else there
    return F.array_remove(F.split(F.when(ascii_only, F.lower(plain)).otherwise(F.translate(plain, _UPPER, _LOWER)), GAP), "")


def small(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has ``most`` rows at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def phrases(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, phrase (words joined by spaces): each run of ``width`` words of the items, or all words of a shorter item."""
    if not 1 <= width <= 62:
        raise ValueError("phrases have 1 to 62 words")
    ws = F.col("ws")
    starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - (width - 1), F.lit(1)))
    runs = F.transform(starts, lambda s: F.array_join(F.slice(ws, s, width), " "))
    return items.select("item_id", words("text").alias("ws")).where(F.size(ws) > 0).select("item_id", F.explode(runs).alias("phrase")).distinct()


def vocabulary(found: DataFrame) -> DataFrame:
    """term, id of the words of ``phrases``, and of the end of a document."""
    terms = found.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
    return cut(terms.select("term", F.monotonically_increasing_id().alias("id")).union(terms.sparkSession.createDataFrame([(END, -1)], "term string, id long")), "terms")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The written index of docs: doc_id, h (digest of the text), id (of the term), pos, sorted by term in each shard."""
    places = F.posexplode(F.concat(words("text"), F.array(F.lit(END)))).alias("pos", "term")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), places)
    return cut(rows.join(small(terms, MAX_TERMS), "term").select("id", "doc_id", "h", "pos").sortWithinPartitions("id", "doc_id", "h", "pos"), "postings")


def lists(postings: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """w (number), phrase, size and slots (frequency, offset, id of each word, rarest first) of the phrases whose words all occur."""
    numbered = cut(found.select("phrase").distinct().withColumn("w", F.monotonically_increasing_id()), "phrases")
    counts = postings.where("id >= 0").groupBy("id").agg(F.count("*").alias("n"))
    known = cut(terms.join(counts, "id", "left"), "counts")
    slots = numbered.select("w", "phrase", F.posexplode(F.split("phrase", " ")).alias("off", "term")).join(small(known, MAX_TERMS), "term")
    rows = slots.groupBy("w", "phrase").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "id"))).alias("slots"))
    return cut(rows.where(F.col("slots")[0]["n"] > 0).select("w", "phrase", F.size("slots").alias("size"), "slots"), "lists")


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def _intersect(found: DataFrame, some: DataFrame, known: DataFrame, first: int, last: int, slop: int) -> DataFrame:
    """The starts of found (w, doc_id, h, start) that postings confirm for the slots from first to last (from 0) of their phrase."""
    wanted = small(known.select("w", F.slice("slots", first + 1, last - first).alias("part")), MAX_PHRASES)
    need = found.join(wanted, "w").select("w", *_KEY, "start", F.explode("part").alias("slot"))
    at = F.explode(F.sequence(F.col("start") + F.col("slot.off") - slop, F.col("start") + F.col("slot.off") + slop)) if slop else F.col("start") + F.col("slot.off")
    need = need.select("w", *_KEY, "start", F.col("slot.id").alias("id"), F.col("slot.off").alias("off"), at.alias("pos"))
    met = need.join(some, (need["id"] == some["id"]) & (need["pos"] == some["pos"]) & _same(need, some, *_KEY))
    marks = met.groupBy(need["w"], need["doc_id"], need["h"], need["start"]).agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("marks"))
    enough = known.select("w", F.least(F.col("size"), F.lit(last)).alias("to"))
    return marks.join(small(enough, MAX_PHRASES), "w").where(F.bit_count("marks") == F.col("to") - first).select("w", *_KEY, "start")


def matches(postings: DataFrame, known: DataFrame, slop: int = 0) -> DataFrame:
    """w, doc_id, h, start: where documents hold the phrases of ``lists``.

    With ``slop``, a start (0 or more) counts if every word of the phrase stands at most ``slop`` places beside the place
    that it has in the phrase at that start; one word may stand for two equal ones.
    """
    slot = lambda k: F.col("slots")[k]
    rarest = known.select("w", slot(0)["id"].alias("id"), slot(0)["off"].alias("off"))
    starts = postings.join(small(rarest, MAX_PHRASES), "id").select("w", *_KEY, (F.col("pos") - F.col("off")).alias("start"))
    if slop:
        starts = starts.select("w", *_KEY, F.explode(F.sequence(F.col("start") - slop, F.col("start") + slop)).alias("start"))
    starts = starts.where("start >= 0").distinct()
    alone, several = known.where("size = 1").select("w"), known.where("size > 1")
    second = postings.join(small(several.select(slot(1)["id"].alias("id")).distinct(), MAX_TERMS), "id", "left_semi")
    left = cut(_intersect(starts, second, several, 1, 2, slop), "starts")
    short = known.where("size = 2").select("w")
    long = known.where("size > 2")
    # the rest of the lists is read for the documents that are left
    held = small(left.select(*_KEY).distinct(), MAX_DOCUMENTS)
    rest = postings.join(held, _same(postings, held, *_KEY), "left_semi").where("id >= 0")
    full = _intersect(left, rest, long, 2, 62, slop)
    one = starts.join(small(alone, MAX_PHRASES), "w", "left_semi")
    two = left.join(small(short, MAX_PHRASES), "w", "left_semi")
    return one.union(two).union(full)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit (words in matches), n_items, items (ids as strings, sorted) of every document."""
    found = cut(phrases(items, width), "items")
    terms = vocabulary(found)
    postings = index(docs, terms)
    known = lists(postings, found, terms)
    hits = cut(matches(postings, known, slop), "matches")
    members = found.where("item_id IS NOT NULL").join(known, "phrase").select("w", F.col("item_id").cast("string").alias("item"))
    spans = hits.join(small(known.select("w", "size"), MAX_PHRASES), "w").select(*_KEY, "start", (F.col("start") + F.col("size")).alias("stop")).distinct()
    before = F.max("stop").over(Window.partitionBy(*_KEY).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(0))))
    covered = spans.select(*_KEY, fresh.alias("fresh")).groupBy(*_KEY).agg(F.sum("fresh").alias("n_hit"))
    named = hits.select("w", *_KEY).distinct().join(small(members, MAX_PHRASES), "w").groupBy(*_KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    ends = postings.where("id = -1").select(*_KEY, F.col("pos").cast("long").alias("n_words"))
    out = ends.join(covered, _same(ends, covered, *_KEY), "left").select(ends["doc_id"], ends["h"], "n_words", "n_hit")
    out = out.join(named, _same(out, named, *_KEY), "left").select(out["doc_id"], "n_words", "n_hit", "items")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"))


def digest(rows: DataFrame) -> DataFrame:
    """The rows of ``decontaminate`` with a digest in place of the items."""
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB SQL for ``digest(decontaminate(documents, benchmark))``.
ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(ws), {WIDTH}) AS m, array_to_string(ws[i : i + least(len(ws), {WIDTH}) - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, greatest(len(ws) - {WIDTH - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
g AS (SELECT r, i, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(ws) >= m)),
h AS (SELECT r, i, m, item_id FROM g JOIN p USING (m, phrase)),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM h) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)"""
