"""Operator 3: URL filters by rules, and by trust and distrust propagated over the graph of host links.

A page that fits a rule has that rule's verdict (the longest that fits). For the others the host decides:
personalised PageRank carries trust from hosts with allowed pages along links, its reverse carries
distrust from hosts with blocked pages against the links; a host whose distrust reaches half of what a
wholly blocked host has by itself, and exceeds its trust, is blocked.

Only urls and aggregated host edges are shuffled; edges are counted map-side before the shuffle. Each
round of the propagation is written to the shared folder, so a lost executor costs one round. Scores only grow
from round to round, and what the rounds left can add is bounded: trust by the sum, distrust by the largest of
the last changes, times damping / (1 - damping). The rounds end as soon as that cannot alter any verdict.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is allowed;
null html has no links; repeated rows are judged alike and each counts for its host; of rules of equal
length the first in the list wins; links within a host are left out; an empty table gives an empty result;
extra columns are ignored. What is undecided when the bounds fall under ``TOLERANCE`` is a tie; the scores so far
decide it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeloom.llm.scratch import cut

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Rules at most: each is tried on each url.
MAX_RULES = 1000
DAMPING = 0.85
#: Bound of what is left of the scores at which the rounds end, and rounds after which they must have (an error else).
TOLERANCE, ROUNDS = 1e-9, 1000
#: Share of a wholly blocked host's own distrust from which a host is blocked.
THRESHOLD = 0.5
LINK = r"""(?i)<a\s[^>]*href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _rule(rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits host and path, as a struct; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ranked]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def parsed(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict of each url."""
    host, path = host_and_path("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    return rows.select("*", _rule(rules).alias("r")).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and share: of the links from pages of src to other hosts, the share that goes to dst."""
    host, _ = host_and_path("url")
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' AND src <> dst")
    counts = links.groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = counts.groupBy("src").agg(F.sum("n").alias("total"))
    return counts.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from seeds (host, allowed, blocked as shares of the host's pages) over edges.

    Linked hosts without pages of their own take part. The scores are exact enough to tell every host with a
    distrust of ``threshold`` times (1 - damping) or more that exceeds its trust.
    """
    edges = cut(edges, "edges")
    every = seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    seeds = cut(every.join(seeds, "host", "left").na.fill(0.0, ["allowed", "blocked"]), "seeds")
    own = seeds.select("host", ((1 - damping) * F.col("allowed")).alias("trust"), ((1 - damping) * F.col("blocked")).alias("distrust"))
    state, least, left = own, threshold * (1 - damping), damping / (1 - damping)
    for _ in range(ROUNDS):
        forth = edges.join(state, edges["src"] == state["host"]).select(F.col("dst").alias("host"), (damping * F.col("share") * F.col("trust")).alias("trust"), F.lit(0.0).alias("distrust"))
        back = edges.join(state, edges["dst"] == state["host"]).select(F.col("src").alias("host"), F.lit(0.0).alias("trust"), (damping * F.col("share") * F.col("distrust")).alias("distrust"))
        sent = own.union(forth).union(back).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        after = cut(sent, "scores")
        change = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))
        moved = after.alias("a").join(state.alias("b"), "host").agg(F.sum(change("trust")), F.max(change("distrust"))).first()
        state = after
        more_trust, more_distrust = (left * (m or 0.0) for m in moved)
        if max(more_trust, more_distrust) < tolerance:
            return state
        bad = (F.col("distrust") >= least) & (F.col("distrust") > F.col("trust") + more_trust)
        fine = (F.col("distrust") + more_distrust < least) | (F.col("distrust") + more_distrust <= F.col("trust"))
        if state.where(~bad & ~fine).isEmpty():
            return state
    raise ValueError(f"no convergence in {ROUNDS} rounds")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rows = parsed(pages, rules)
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = rows.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    scores = propagate(seeds, host_edges(pages), damping, threshold)
    bad = scores.where((F.col("distrust") >= threshold * (1 - damping)) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("scored"))
    return rows.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "scored", F.lit("allow")).alias("verdict"))


def oracle(rules: tuple[tuple[str, str, str], ...] = RULES, damping: float = DAMPING, rounds: int = 130, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``judge``, with as many rounds as leave less than 1e-9 of a score."""
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fit = lambda r: f"(host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}')"
    case = lambda f: "CASE " + " ".join(f"WHEN {fit(r)} THEN '{f(r)}'" for r in ranked) + " END"
    link = LINK.replace("'", "''")
    out = f"""WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS (SELECT page_id, html, host, path, {case(lambda r: r[0] + r[1])} AS rule, {case(lambda r: r[2])} AS ruled FROM h),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM p WHERE host <> ''),
c AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst GROUP BY ALL),
e AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM c),
s AS (SELECT host, sum(a) AS a, sum(b) AS b FROM (
  SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS b FROM p WHERE host <> '' GROUP BY host
  UNION ALL SELECT src, 0.0, 0.0 FROM e UNION ALL SELECT dst, 0.0, 0.0 FROM e) GROUP BY host),
own AS MATERIALIZED (SELECT host, {1 - damping} * a AS t, {1 - damping} * b AS d FROM s), l2 AS MATERIALIZED (SELECT * FROM e),
r(k, host, t, d) AS (SELECT 0, host, t, d FROM own UNION ALL SELECT k + 1, host, sum(t) AS t, sum(d) AS d FROM (
  SELECT z.k, own.host, own.t, own.d FROM own, (SELECT max(k) AS k FROM r WHERE k < {rounds}) z WHERE z.k IS NOT NULL
  UNION ALL SELECT k, dst, {damping} * share * t, 0.0 FROM l2 JOIN r ON src = host WHERE k < {rounds}
  UNION ALL SELECT k, src, 0.0, {damping} * share * d FROM l2 JOIN r ON dst = host WHERE k < {rounds}) GROUP BY k, host)"""
    return out + f"""
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN d >= {threshold * (1 - damping)} AND d > t THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN (SELECT host, t, d FROM r WHERE k = {rounds}) USING (host)"""
