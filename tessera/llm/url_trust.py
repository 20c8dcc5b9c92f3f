"""URL filters by link-graph propagation, in DataFrame functions alone.

Listed rules (host, path) decide the urls that they fit; the longest wins. All other urls are judged by
their host: trust spreads along links from the hosts most of whose urls are allowed by rules (personalised
PageRank), distrust against the links' direction from the hosts most of whose urls are blocked by rules,
and a host is blocked whose distrust exceeds ``RATIO`` times its trust, and ``LEAST_OF_MEAN`` of the mean
distrust of the hosts that have any. Both are relative, so a verdict doesn't turn with the size of the graph.

Links are the ``href`` values of the html: absolute (``scheme://host``) or ``//host`` name another host,
all others their own page's, and links within a host carry nothing. Edges are summed per pair of hosts
before any join, and both directions run in one frame, so an iteration is one join and one aggregation (a host's own score
travels along a link to itself).
Iterations go on until what is still to come can't move any score by ``ACCURACY`` of the least distrust;
scores nearer than that count as equal.
Mass of hosts without links isn't dealt again; instead each direction's scores are divided by their sum at the end, so that
a direction that loses more of it isn't at a disadvantage. Hosts of very many links are joined by salts.

Defined results: a null url, or one without ``://``, has empty host and path and is judged by its host,
the empty one; null html has no links; repeated rows are judged each; an empty table gives no rows;
extra columns are ignored. A host that no seed reaches is allowed.

``oracle_sql`` follows the same definition, with ``ROUNDS`` rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, join_facts

#: Verdict, host, start of the path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DAMPING = 0.85
RATIO = 1.0
#: Distrust that is needed at least, as a share of the mean distrust of hosts that have any.
LEAST_OF_MEAN = 0.006
#: Error that a score may have, as a share of the least distrust.
ACCURACY = 0.01
#: Rounds between two writings of the scores, and rounds of the SQL.
WRITE_EVERY = 6
ROUNDS = 120
#: Blocked hosts that are broadcast to the pages; more are joined by host and one of SALTS salts.
BROADCAST_HOSTS = 100_000
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"(?i)href\s*=\s*[\"']?([a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]*)"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """page_id, html, host, path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER)
    return pages.select("page_id", "html", host.alias("host"), F.regexp_extract(url, _URL, 2).alias("path"))


def rule_columns(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule as text (host and path), and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, from page_id, html, host."""
    target = F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(2)))
    links = pages.where(F.col("html").isNotNull()).select(F.col("host").alias("src"), target.alias("dst"))
    links = links.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).where("src != '' AND dst != '' AND src != dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))


def host_scores(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, accuracy: float = ACCURACY * LEAST_OF_MEAN) -> tuple[DataFrame, float]:
    """host, trust, distrust, and the mean distrust of the hosts that have any; seeds: host, allowed, blocked (numbers of urls).

    Trust and distrust sum to 1 over all hosts. No score is further than about accuracy times that mean from its limit.
    """
    both = links.select(F.lit(0).alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    out = cut(both.groupBy("kind", "src").agg(F.sum("n").alias("out"), F.count(F.lit(1)).alias("links")))
    hot = cut(hot_keys(out, "links", int(out.agg(F.coalesce(F.sum("links"), F.lit(0))).first()[0])).select("kind", "src"))
    hubs = not hot.isEmpty()
    shares = join_facts(both, out, ["kind", "src"], hot, ["dst"]).select("kind", "src", "dst", (F.col("n") / F.col("out")).alias("share"))
    known = both.select("kind", "src").unionByName(both.select("kind", F.col("dst").alias("src"))).unionByName(
        seeds.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"), F.col("host").alias("src"))
    ).distinct()
    edges = cut(shares.unionByName(known.select("kind", "src", F.col("src").alias("dst"), F.lit(None).cast("double").alias("share"))))
    start = seeds.select(F.lit(0).alias("kind"), "host", F.col("allowed").alias("mass")).unionByName(
        seeds.select(F.lit(1).alias("kind"), "host", F.col("blocked").alias("mass"))
    ).where("mass > 0")
    totals = start.groupBy("kind").agg(F.sum("mass").alias("total"))
    given = ((1 - damping) * F.col("mass") / F.col("total")).alias("score")
    # delta is what the last round added: passed on alone, it sums to all that a round changes
    rank = cut(start.join(F.broadcast(totals), "kind").select("kind", "host", given).withColumn("delta", F.col("score")))
    while True:
        moving, trusted, total, reached = rank.agg(
            F.coalesce(F.greatest(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("delta"))), F.lit(0.0)) for k in (0, 1)]), F.lit(0.0)),
            *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)) for k in (0, 1)],
            F.count_if((F.col("kind") == 1) & (F.col("score") > 0)),
        ).first()
        mean = 1 / max(1, reached)
        # without distrust nothing can be blocked; a total falls short of its limit by moving at most
        if not reached or moving * damping / (1 - damping) <= accuracy * mean * (1 - damping):
            break
        gain = damping * F.col("share") * F.col("delta")
        for _ in range(WRITE_EVERY):
            rank = rank.withColumnRenamed("host", "src")
            met = join_facts(edges, rank, ["kind", "src"], hot, ["dst"]) if hubs else edges.join(rank, ["kind", "src"])
            rank = met.groupBy("kind", F.col("dst").alias("host")).agg(
                F.sum(F.coalesce(gain, "score")).alias("score"), F.sum(F.coalesce(gain, F.lit(0.0))).alias("delta")
            )
        rank = cut(rank)
    by = lambda kind, whole: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)) / F.lit(whole or 1.0)
    return rank.groupBy("host").agg(by(0, trusted).alias("trust"), by(1, total).alias("distrust")), mean


def judge(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    damping: float = DAMPING,
    ratio: float = RATIO,
    least: float = LEAST_OF_MEAN,
    accuracy: float = ACCURACY,
    broadcast_hosts: int = BROADCAST_HOSTS,
) -> DataFrame:
    """page_id, host, path, rule, verdict of every url."""
    name, verdict = rule_columns(rules)
    parsed = with_host_and_path(pages.select("page_id", "url", "html"))
    ruled = parsed.drop("html").withColumn("rule", name).withColumn("by_rule", verdict)
    seeds = cut(
        ruled.where("host != ''").groupBy("host").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("by_rule") == "allow").alias("allowed"),
            F.count_if(F.col("by_rule") == "block").alias("blocked"),
        ).select(
            "host",
            F.when(2 * F.col("allowed") > F.col("n"), F.col("allowed")).otherwise(0).alias("allowed"),
            F.when(2 * F.col("blocked") > F.col("n"), F.col("blocked")).otherwise(0).alias("blocked"),
        )
    )
    scores, mean = host_scores(host_links(parsed), seeds, damping, accuracy * least)
    bad = (F.col("distrust") > ratio * F.col("trust") + accuracy * least * mean) & (F.col("distrust") > least * mean)
    blocked = cut(scores.where(bad).select("host", F.lit("block").alias("by_host")))
    if blocked.count() <= broadcast_hosts:
        joined = ruled.join(F.broadcast(blocked), "host", "left")
    else:  # a host of many pages is dealt to several tasks
        salted = blocked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = ruled.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict")
    )


def oracle_sql(
    rounds: int = ROUNDS, damping: float = DAMPING, ratio: float = RATIO, least: float = LEAST_OF_MEAN, accuracy: float = ACCURACY
) -> str:
    """The rows of judge() with its defaults in DuckDB's SQL: what each round passes on, summed over all rounds."""
    name, verdict = "NULL", "NULL"
    for kind, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"((host = '{host}' OR host LIKE '%.{host}') AND path LIKE '{path}%')"
        name, verdict = f"CASE WHEN {fits} THEN '{host}{path}' ELSE {name} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    href = _HREF.replace("'", "''")
    return f"""WITH RECURSIVE parsed AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{_UPPER}', '{_LOWER}') AS host,
          regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages),
        ruled AS (SELECT page_id, host, path, {name} AS rule, {verdict} AS by_rule FROM parsed),
        linked AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{href}', 2)), '{_UPPER}', '{_LOWER}') AS dst FROM parsed),
        links AS (SELECT src, dst, count(*) AS n FROM linked WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
        both_ways AS (SELECT 0 AS kind, src, dst, n FROM links UNION ALL SELECT 1, dst, src, n FROM links),
        edges AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways),
        hosts AS (SELECT host, count(*) AS n, count(*) FILTER (by_rule = 'allow') AS allowed, count(*) FILTER (by_rule = 'block') AS blocked
          FROM ruled WHERE host <> '' GROUP BY 1),
        masses AS (SELECT 0 AS kind, host, allowed AS mass FROM hosts WHERE 2 * allowed > n
          UNION ALL SELECT 1, host, blocked FROM hosts WHERE 2 * blocked > n),
        walk(round, kind, host, score) AS (SELECT 0, kind, host, CAST({1 - damping} * mass / sum(mass) OVER (PARTITION BY kind) AS DOUBLE) FROM masses
          UNION ALL SELECT w.round + 1, e.kind, e.dst, sum({damping} * share * score)
          FROM walk w JOIN edges e ON e.kind = w.kind AND e.src = w.host WHERE w.round < {rounds} GROUP BY w.round, e.kind, e.dst),
        scores AS (SELECT host, coalesce(sum(score) FILTER (kind = 0), 0) AS trust, coalesce(sum(score) FILTER (kind = 1), 0) AS distrust FROM walk GROUP BY host),
        whole AS (SELECT coalesce(nullif(sum(trust), 0), 1) AS t, coalesce(nullif(sum(distrust), 0), 1) AS d, 1.0 / greatest(1, count(*) FILTER (distrust > 0)) AS mean FROM scores),
        bad AS (SELECT host FROM scores, whole WHERE distrust / d > {ratio} * trust / t + {accuracy * least} * mean AND distrust / d > {least} * mean)
        SELECT page_id, ruled.host, path, rule, coalesce(by_rule, CASE WHEN bad.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
        FROM ruled LEFT JOIN bad ON ruled.host = bad.host"""
