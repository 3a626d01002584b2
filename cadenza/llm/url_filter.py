"""URL filters: rules by host and path, and trust that spreads over the link graph of hosts.

Personalised PageRank runs from trusted hosts along the links, and distrust from
blocked hosts against them, until neither changes. A host is as much of a seed as its
share of pages that rules allow or block. Links are summed to weighted host edges
before anything is joined; both walks are one set of DataFrame joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import ascii_lower, checkpointed, few

# Fixed values of the contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Share of a walk that follows links; both walks go on until what still moves is this share of what the seeds sent out.
DAMPING, TOLERANCE = 0.85, 1e-8

#: Steps between two looks at what still moves.
_STEPS = 5

#: Host tables up to this many rows are broadcast to the pages; larger ones are joined by a shuffle.
MAX_BROADCAST_HOSTS = 200_000

#: A host is blocked if its distrust exceeds its trust by more than this, in units of what a wholly blocked, or wholly trusted, host has by itself.
MARGIN = 0.5

_LINK = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules that fit each distinct host, longest first; rules are (verdict, r_host, r_path)."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = hosts.select("host", F.explode(suffixes).alias("r_host")).join(rules, "r_host")
    ranked = F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.concat("r_host", "r_path").alias("rule"), F.col("r_path").alias("path"), F.col("verdict").alias("verdict"))
    return fitting.groupBy("host").agg(F.sort_array(F.collect_set(ranked), asc=False).alias("rules"))


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, n): how many links lead from one host to another; links within a host don't count."""
    return (
        pages.select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_LINK), F.lit(1))).alias("dst"))
        .select("src", ascii_lower("dst").alias("dst"))
        .filter("src <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict[str, float]]:
    """(host, trust, distrust): both walks' personalised PageRank, and by walk what a seed of weight 1 has by itself.

    ``seeds`` has (host, trust, distrust) weights, and each walk's scores sum to those of
    its seeds, so that many seeds weigh more than one. Trust follows the edges by their
    share of what leaves a host, distrust goes back by their share of what enters one.
    Where a walk cannot go on it returns to the seeds: that is the walk without returns,
    scaled up, so every step only moves what has not come to rest.
    """
    edges = checkpointed(edges)
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col("host"), F.col(c).cast("double").alias("score")) for k, c in (("t", "trust"), ("d", "distrust")))))
    start = checkpointed(seeds.select(kinds.alias("s")).select("s.*").filter("score > 0"))
    sent = {r["kind"]: r["s"] for r in start.groupBy("kind").agg(F.sum("score").alias("s")).collect()}
    scores = start.withColumn("score", F.col("score") * (1 - damping)).withColumn("moving", F.col("score"))
    if not edges.isEmpty() and sent:
        out_n = edges.groupBy("src").agg(F.sum("n").alias("total"))
        in_n = edges.groupBy("dst").agg(F.sum("n").alias("total"))
        along = edges.join(out_n, "src").select(F.lit("t").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("w"))
        back = edges.join(in_n, "dst").select(F.lit("d").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), (F.col("n") / F.col("total")).alias("w"))
        moves = checkpointed(along.unionByName(back))
        while True:
            for _ in range(_STEPS):
                moved = scores.filter("moving > 0").withColumnRenamed("host", "at").join(moves, ["kind", "at"]).select("kind", F.col("to").alias("host"), (F.col("moving") * F.col("w") * damping).alias("score"))
                scores = scores.select("kind", "host", "score", F.lit(0.0).alias("moving")).unionByName(moved.withColumn("moving", F.col("score"))).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("moving").alias("moving"))
            scores = checkpointed(scores)
            left = {r["kind"]: r["s"] for r in scores.groupBy("kind").agg(F.sum("moving").alias("s")).collect()}
            if all(left[k] <= tolerance * (1 - damping) * sent[k] for k in left):
                break
    rest = {r["kind"]: r["s"] for r in scores.groupBy("kind").agg(F.sum("score").alias("s")).collect()}
    scale = {k: sent[k] / rest[k] for k in sent}
    one = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score") * scale.get(kind, 1.0)).otherwise(0.0))
    return scores.groupBy("host").agg(one("t").alias("trust"), one("d").alias("distrust")), {k: (1 - damping) * scale.get(k, 1.0) for k in "td"}


def _small(hosts: DataFrame) -> DataFrame:
    return F.broadcast(hosts) if few(hosts, MAX_BROADCAST_HOSTS) else hosts


def judge_urls(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row.

    The longest rule that fits decides. Without one, a host whose distrust exceeds its
    trust by more than MARGIN, in units of a seed's own, is blocked, any other allowed.
    A null url, or one without ``://``, has empty host and path, fits no rule and is
    allowed; null html has no links; the path of a rule has to be literally at the start
    of the url's; very long urls and pages are read whole; repeated rows get the same
    verdict; an empty table gives no rows.
    """
    spark = pages.sparkSession
    told = spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, r_host string, r_path string") if not isinstance(rules, DataFrame) else rules
    at = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    by_host = checkpointed(host_rules(at.select("host").distinct(), told))
    ruled = at.join(_small(by_host), "host", "left").withColumn("fit", F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), F.lit(0))).drop("rules")
    ruled = checkpointed(ruled.select("page_id", "host", "path", "fit.rule", "fit.verdict"))
    share = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)) / F.count("*")
    seeds = ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    links = host_edges(pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")), "host", "html")
    scores, own = propagated(seeds, links)
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    verdict = F.coalesce(F.col("verdict"), F.when(distrust / own["d"] - trust / own["t"] > MARGIN, "block").otherwise("allow"))
    return ruled.join(_small(checkpointed(scores)), "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Contract query 3: host, path, rule and verdict of every page."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def op3_sql() -> str:
    """DuckDB's form: both walks as one recursion over what still moves."""
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    url = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    link = r"""(?is)<a\s[^>]*?href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)"""
    return rf"""
WITH RECURSIVE r(verdict, r_host, r_path) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS k, page_id, {lower(f"regexp_extract(coalesce(url, ''), '{url}', 1)")} AS host, regexp_extract(coalesce(url, ''), '{url}', 2) AS path, coalesce(html, '') AS html FROM pages),
f AS (SELECT k, max_by(r_host || r_path, (length(r_host || r_path), r_host || r_path)) AS rule, max_by(verdict, (length(r_host || r_path), r_host || r_path)) AS verdict
  FROM p JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY k),
q AS (SELECT p.k, page_id, host, path, html, rule, verdict FROM p LEFT JOIN f ON p.k = f.k),
g AS (SELECT host, avg((verdict IS NOT DISTINCT FROM 'allow')::INT) AS a, avg((verdict IS NOT DISTINCT FROM 'block')::INT) AS b FROM q WHERE host <> '' GROUP BY host),
e AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {lower("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM q) WHERE src <> '' AND src <> dst GROUP BY src, dst),
m AS (SELECT 't' AS kind, src AS origin, dst AS dest, n / sum(n) OVER (PARTITION BY src) AS w FROM e UNION ALL SELECT 'd', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM e),
s0 AS (SELECT 't' AS kind, host, a::DOUBLE AS score FROM g WHERE a > 0 UNION ALL SELECT 'd', host, b::DOUBLE FROM g WHERE b > 0),
s AS (SELECT kind, host, score, 0 AS step FROM s0 UNION ALL
  SELECT s.kind, m.dest, sum(s.score * m.w * {DAMPING}), any_value(s.step) + 1 FROM s JOIN m ON s.kind = m.kind AND s.host = m.origin WHERE s.step < 150 GROUP BY s.kind, m.dest),
z AS (SELECT host, sum(CASE kind WHEN 't' THEN score ELSE 0 END) AS trust, sum(CASE kind WHEN 'd' THEN score ELSE 0 END) AS distrust FROM s GROUP BY host)
SELECT page_id, q.host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > {MARGIN} THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN z ON q.host = z.host
"""
