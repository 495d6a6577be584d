"""Operators 3, 6 and 7 and the pipeline on small tables."""

import duckdb
import pytest

from probeloom.llm import html, licenses, urls

PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>x</a></li></ul></nav><!-- ad --><div class=\"ad\">buy</div>{}<aside>more</aside><form><input><button>go</button></form><div id='comments'>nice</div><footer>&copy; me</footer></body></html>"


def test_extraction_by_structure():
    article = "<article><h1>A &amp; B</h1><p><b>one\n two<br><p>three&nbsp;&lt;4&gt; five</p><div class='share'>tweet</div><ul><li>six</li></ul></article>"
    kept = [t for t, k in html.lines_of(PAGE.format(article)) if k]
    assert kept == ["A & B", "one two", "three <4> five", "six"]
    assert html.lines_of(None) == [] and html.lines_of("") == []
    assert html.lines_of("just text")[0] == ("just text", html.OPEN)
    assert [t for t, k in html.lines_of("<article><p>a<p>b <!-- c") if k] == ["a", "b"]
    assert [t for t, k in html.lines_of("<main>a <span class=ad>buy <i>now</i></span> b <span>c</span><div class=x>d</main>e") if k] == ["a b c", "d", "e"]


def test_extraction_by_differencing(spark):
    body = lambda k: PAGE.format(f"<div>Site of all</div><p>text {k} alone</p><div>Terms of use</div>")
    pages = [(k, f"http://h.example/a/{k:03}", body(k), "z") for k in range(40)]
    pages += [(100, "http://other.example/a", body(100), "z"), (101, None, body(101), "z"), (102, "http://h.example/a/000", None, "z"), (103, "http://copy.example/1", body(7), "z"), (104, "http://copy.example/2", body(7), "z"), (0, "http://h.example/a/000", body(0), "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert len(got) == len(pages)
    text = {r.page_id: r.text for r in got}
    assert [text[k] for k in range(2, 40)] == [f"text {k} alone" for k in range(2, 40)]
    assert text[100] == "Site of all\ntext 100 alone\nTerms of use" == text[101].replace("101", "100")
    assert text[102] == "" and text[103] == text[104] == "Site of all\ntext 7 alone\nTerms of use"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(df.limit(0)).count() == 0


def test_shared_lines():
    assert html.shared_lines([1, 2, 3, 4, 1], [1, 3, 9, 4]) == {0, 2, 3}
    assert html.shared_lines([], [1]) == set() and len(html.shared_lines([1, 1, 1], [1, 1])) == 2


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return sorted(map(tuple, con.execute(sql).fetchall()), key=str)


def test_urls(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p">x</a>' for h in hosts)
    pages = [
        (1, "http://A.Net/x?q#f", link("b.com")), (2, "https://example.net/en/1", link("c.com", "C.com")), (3, "http://sub.example.net/enx", None), (4, "http://b.com/", link("a.net", "a.net")),
        (5, "http://c.com", link("a.net", "d.com")), (6, "http://d.com/de/", ""), (7, None, link("a.net")), (8, "no scheme", ""), (9, "x://q?y://z", ""), (10, "http://www.example.com/de/u", ""), (11, "http://fr.org/fr/?x", "<a href='/rel'>y</a>"),
        (12, "http://notnet/x", ""), (1, "http://A.Net/x?q#f", link("b.com")), (13, "http://far.com/1", link("b.com")), (14, "http://a.net", ""),
    ]
    df = spark.createDataFrame([(*p, "no") for p in pages], "page_id long, url string, html string, verdict string")
    got = urls.judge(df).collect()
    assert sorted(map(tuple, got), key=str) == [(*t[:5],) for t in oracle(urls.oracle(), pages=df.toPandas())]
    verdict = {r.page_id: r.verdict for r in got}
    assert verdict[1] == "block" and verdict[2] == "allow" and verdict[3] == "block" and verdict[4] == "block" and verdict[8] == "allow" and verdict[10] == "block"
    assert urls.judge(df.limit(0)).count() == 0


def test_licenses(spark):
    mit = dict(licenses.TEXTS)["MIT"]
    docs = [
        (1, "Copyright (c) 2001 Someone\n\n" + mit.upper().replace(" ", "  ").replace(",", ";")), (2, "text\n*  Released under the MIT Licence!\nReleased under the M.I.T."), (3, None), (4, ""), (5, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
        (5, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (6, mit + "x"), (7, "this work is licensed under the gnu general public license, v3"), (8, "é " * 5000),
    ]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license_id string")
    got = licenses.scan(df).select("doc_id", "digest", "license_id", "n_notices", "notices").collect()
    assert sorted(map(tuple, got), key=str) == oracle(licenses.oracle(), documents=df.toPandas())
    by = {r.doc_id: r for r in got}
    assert by[1].license_id == "MIT" and by[2].license_id is None and by[2].notices == "MIT" and by[5].n_notices == 2 and by[6].license_id is None and by[7].license_id == "GPL-3.0" and by[7].notices == "GPL-3.0"
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_from_a_table(spark, monkeypatch):
    text = "The Sample Public Licence\n\nYou may do as you like."
    docs = spark.createDataFrame([(1, "copyright 2020 me\nthe sample public license, you may do as you like"), (2, "other"), (3, text)], "doc_id long, text string")
    table = licenses.digests_of(spark.createDataFrame([("SPL-1.0", text), ("X", "other words")], "license_id string, text string"))
    for limit in (licenses.MAX_KNOWN, 1):  # 1: joined by a shuffle
        monkeypatch.setattr(licenses, "MAX_KNOWN", limit)
        got = licenses.scan(docs, texts=[], lines=[], digests=table).collect()
        assert {r.doc_id: r.license_id for r in got} == {1: "SPL-1.0", 2: None, 3: "SPL-1.0"}


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "byte_bpe"]
    at, seen = docs, []
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, at, d).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        assert at.columns == docs.columns
        seen.append({r.doc_id for r in at.select("doc_id").collect()})
    assert len(seen[0]) > 150 and seen[1] == seen[0] and seen[2] < seen[1] and seen[3] <= seen[2]
    last = pipeline.STAGES[-1][1](spark, at, d).collect()
    import hashlib

    texts = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in at.collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in last) == texts
    assert pipeline.run(spark, d).count() == len(texts)


def test_differencing_is_brute_force(spark, monkeypatch):
    import random

    def common(a, b):  # positions of a in one longest common subsequence, by the plain table
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
        return size[0][0]

    rng = random.Random(5)
    parts = ["Home of the site", "Terms", "Contact us", "All rights", "Share this"]
    pages = []
    for k in range(120):
        host = f"h{k % 4}.example"
        lines = sorted(rng.sample(range(5), rng.randrange(5)))
        own = [f"own line {k} {i}" for i in range(rng.randrange(6))]
        blocks = [parts[i] for i in lines[:2]] + own + [parts[i] for i in lines[2:]]
        article = f"<article>{'teaser' * (k % 3)} {k}</article>" if k % 5 == 0 else ""
        pages.append((k, f"http://{host}/{rng.choice('abc')}/{rng.randrange(40)}/{k}", "<body><nav>menu</nav>" + article + "".join(f"<div>{b}</div>" for b in blocks) + "<footer>foot</footer></body>"))
    monkeypatch.setattr(html, "SAMPLE", 2)
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    place = lambda url: url.split("://")[1].partition("/")
    removed = 0
    for k, url, text in pages:
        lines = html.lines_of(text)
        kept = [t for t, kind in lines if kind]
        host, _, path = place(url)
        same = sorted((place(u)[2], p, t) for p, u, t in pages if place(u)[0] == host)
        at = [p for _, p, _ in same].index(k)
        agree = lambda other: next((i for i, (x, y) in enumerate(zip(path, other)) if x != y), min(len(path), len(other)))  # noqa: E731, B023
        near = [same[i] for i in (at - 1, at + 1) if 0 <= i < len(same)]
        near.sort(key=lambda s: -agree(s[0]))
        free = sum(kind == html.OPEN for _, kind in lines)
        if not free:
            assert got[k].text == "\n".join(kept) and got[k].paired is None
            continue
        assert got[k].paired == near[0][1]
        gone = len(kept) - len(got[k].text.split("\n") if got[k].text else [])
        other = [t for t, _ in html.lines_of(near[0][2])]
        # the subsequence is as long as the longest; what is gone is open and shared, unless the page is a copy
        shared = html.shared_lines([t for t, _ in lines], other)
        assert len(shared) == common([t for t, _ in lines], other)
        want = {i for i in shared if lines[i][1] == html.OPEN}
        want = set() if len(want) >= html.COPY * free else want
        assert got[k].text == "\n".join(t for i, (t, kind) in enumerate(lines) if kind and i not in want)
        removed += gone
    assert removed > 50


def test_articles_repeat_lines_of_each_other(spark):
    """On the given pages structure decides every page, and deleting what neighbours share would take text of articles."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    lines = {r.page_id: html.lines_of(r.html) for r in pages}
    assert all(kind != html.OPEN for some in lines.values() for _, kind in some)
    text = {r.page_id: r.text for r in html.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert all(text[k] == "\n".join(t for t, kind in some if kind == html.MAIN) for k, some in lines.items())


def test_open_lines_are_judged_and_never_dropped(spark):
    words = " ".join(["word"] * 30)
    text = f"<h1>Title</h1><p>intro</p><article>{words}</article><p>end</p>"
    for body in (text, text.replace(words, "short")):
        pages = spark.createDataFrame([(1, "http://a.example/x", body)], "page_id long, url string, html string")
        assert html.extract(pages).first().text.split("\n") == ["Title", "intro", words if words in body else "short", "end"]
    rows = [(k, f"http://a.example/{k}", f"<p>menu</p><p>own {k}</p><p>mine {k}</p><article>{words} {k}</article>") for k in (1, 2)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"own {k}\nmine {k}\n{words} {k}" for k in (1, 2)}


def test_differencing_meets_every_page(spark):
    """Pages that structure decides are paired and aligned like all others."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, *r.url.split("://")[1].partition("/")[::2], [t for t, _ in html.lines_of(r.html)]) for r in pages.collect()]
    rows = sorted((host.lower(), "/" + path.split("?")[0].split("#")[0], k, lines) for k, host, path, lines in rows)
    want = {}
    for at, (host, path, k, lines) in enumerate(rows):
        near = [rows[j] for j in (at - 1, at + 1) if 0 <= j < len(rows) and rows[j][0] == host]
        near.sort(key=lambda other: -next((i for i, (x, y) in enumerate(zip(path, other[1])) if x != y), min(len(path), len(other[1]))))  # noqa: B023
        want[k] = len(html.shared_lines(lines, near[0][3])) if near else None
    got = {r.page_id: r.n_shared for r in html.extract(pages).collect()}
    assert got == want and sum(n or 0 for n in got.values()) > 0


def test_lines_beside_an_article_are_judged(spark):
    page = lambda k: f"<main><h1>News of the site</h1><p>dateline {k}</p><article><p>text {k}</p><p>said by all</p></article><p>Subscribe to us</p></main>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in (1, 2)] + [(k, f"http://copy.example/{k}", page(3)) for k in (3, 4)] + [(5, "http://alone.example/", page(5))]
    rows += [(k, f"http://main.example/{k}", f"<main><h1>Title</h1><p>text {k}</p></main>") for k in (6, 7)]
    got = {r.page_id: (r.text.split("\n"), r.n_shared) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in (1, 2)] == [([f"dateline {k}", f"text {k}", "said by all"], 3) for k in (1, 2)]
    whole = lambda k: ["News of the site", f"dateline {k}", f"text {k}", "said by all", "Subscribe to us"]
    assert got[3] == got[4] == (whole(3), 5) and got[5] == (whole(5), None)
    assert [got[k] for k in (6, 7)] == [(["Title", f"text {k}"], 1) for k in (6, 7)]


def test_a_row_repeated_over_and_over_is_dealt(spark):
    from pyspark.sql import functions as F

    body = lambda k: f"<p>site</p><p>terms</p><p>own {k}</p><article>text {k}</article>"
    rows = [(k, f"http://a.example/{k:04}", body(k)) for k in range(600) if k != 300] + [(300, "http://a.example/0300", body(300))] * 1600
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = html.extract(df).withColumn("p", F.spark_partition_id()).collect()
    assert len(got) == len(rows)
    for r in got:
        k = r.page_id
        assert (r.text, r.n_shared) == ((f"site\nterms\nown {k}\ntext {k}", 4) if k == 300 else (f"own {k}\ntext {k}", 2))
        assert r.paired in ((300,) if k == 300 else (k - 1, k + 1))
    assert max(sum(r.p == p for r in got) for p in {r.p for r in got}) < 0.5 * len(rows)


def test_alignments_of_many_equal_lines(monkeypatch):
    import random
    import time

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        return row[-1]

    rng = random.Random(8)
    began = time.process_time()
    a, b = ([rng.randrange(4) for _ in range(n)] for n in (20_000, 21_000))
    shared = sorted(html.shared_lines(a, b))
    assert time.process_time() - began < 20
    rest = iter(b)
    assert len(shared) > 10_000 and all(any(a[i] == y for y in rest) for i in shared)
    for most in (html.MATCHES, 0, 5):
        monkeypatch.setattr(html, "MATCHES", most)
        for _ in range(300):
            a, b = ([rng.randrange(rng.choice((2, 3, 9))) for _ in range(rng.randrange(14))] for _ in range(2))
            shared = sorted(html.shared_lines(a, b))
            rest = iter(b)
            assert len(shared) == length(a, b) and all(any(a[i] == y for y in rest) for i in shared)


def test_marks_of_elements():
    kept = lambda text: [t for t, k in html.lines_of(text) if k]
    assert kept('<article>a</article><article class="comment">b</article><article id="comment-12">c</article>') == ["a"]
    assert kept('<div class="social-science">a</div><div class="site-footer">b</div><div class="main Sidebar">c</div><div class="x social">d</div>') == ["a"]
    assert kept('<p>a < b and <b>c</b></p><a href="x>y">d</a>') == ["a < b and c", "d"]
    assert kept("<p>a<b title='x") == ["a"] and kept('<p>a<i b=">c</p><p>d') == ["ac", "d"]


def test_pages_take_linear_time():
    import time

    for part in ("<a ", "<a '", '<a "', "<!", "<div>", "</ul><div>", "<a '\"", "<p><b class='x y", "&amp"):
        began = time.process_time()
        html.lines_of(part * (1_000_000 // len(part)))
        assert time.process_time() - began < 8, part
    began = time.process_time()
    html.lines_of("<div class=x>" * 100_000 + "</ul>" * 100_000)
    assert time.process_time() - began < 8


def test_scores_on_a_large_graph(spark):
    """2,000 hosts in cycles and chains around a hub, trusted and blocked seeds: verdicts as dense linear algebra gives them."""
    import random

    import numpy as np

    rng, n = random.Random(3), 2000
    names = [f"h{k}.{'net' if k % 97 == 0 else 'org' if k % 41 == 0 else 'com'}" for k in range(n)]
    links = {k: [(k + 1) % n if k % 7 else 0, *rng.choices(range(n), k=rng.randrange(3))] for k in range(n)}
    rows = [(k, f"http://{names[k]}/{'fr/' if k % 41 == 0 else ''}x", "".join(f"<a href='http://{names[j]}/'>y</a>" for j in links[k])) for k in range(n)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    share = np.zeros((n, n))
    for k, to in links.items():
        for j in to:
            share[k, j] += j != k
    share /= np.maximum(share.sum(1, keepdims=True), 1)
    block = np.array([k % 97 == 0 for k in range(n)], float)
    allow = np.array([k % 97 != 0 and k % 41 == 0 for k in range(n)], float)
    trust = np.linalg.solve(np.eye(n) - 0.85 * share.T, 0.15 * allow)
    distrust = np.linalg.solve(np.eye(n) - 0.85 * share, 0.15 * block)
    bad = (distrust >= 0.075) & (distrust > trust)
    want = {k: "block" if block[k] else "allow" if allow[k] else "block" if bad[k] else "allow" for k in range(n)}
    assert got == want and sum(bad) > block.sum() > 10
