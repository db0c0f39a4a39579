"""URL filters: rules by host and path, and trust spread over the links between hosts.

A rule decides a url outright. For the rest a host is judged: pages that rules allow seed
trust at their hosts, pages that they block seed distrust; each seeding sums to 1, so it
does not count how many pages either has. Trust follows the links from host to host
(personalised PageRank), distrust follows them backwards; a host is blocked if its distrust
exceeds ``ratio`` times its trust by more than a thousandth. Hosts that nothing reaches are
allowed. Rounds go on until the last one added to no host more than ``tolerance`` of its
score; there is no limit on them.

Links are the absolute and protocol-relative href and src values of the pages; several
from one page to one host count once, links inside a host do not count. What a host
without links would pass on goes back to the seeds: that is the same as losing it and
scaling the scores to sum 1 in the end, which is done here.

Defined results: a null url, or one without ``://``, has an empty host and path, which no
rule fits; null html has no links; repeated rows count as often as they are there; of two
rules of one length the blocking one wins; equal scores allow; an empty table gives an empty table; columns
other than page_id, url and html are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.durable import written

# Host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
DAMPING, RATIO, TOLERANCE, MARGIN = 0.85, 1.0, 1e-5, 1e-3
AT_ONCE = 4  # rounds between two written states


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of its text and verdict, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): on how many pages of a host there is a link to another host."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda x: F.translate(F.regexp_extract(x, "//([^/?#]*)", 1), UPPER, LOWER)))
    out = pages.select("host", F.explode(targets).alias("dst")).filter("host <> '' AND dst <> '' AND dst <> host")
    return out.groupBy(F.col("host").alias("src"), "dst").agg(F.count("*").alias("n"))


def _by_kind(df: DataFrame, of: str) -> tuple[float, float]:
    """The sums of trust (kind 0) and distrust (kind 1)."""
    found = {r["kind"]: r["x"] for r in df.groupBy("kind").agg(F.sum(of).alias("x")).collect()}  # two rows
    return tuple(found.get(k) or 0.0 for k in (0, 1))


def _share(x: Column, sums: tuple[float, float]) -> Column:
    return F.try_divide(x, F.when(F.col("kind") == 0, F.lit(sums[0])).otherwise(F.lit(sums[1])))


def spread(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust), each summing to 1, from (host, trust, distrust) seeds and (src, dst, n) links.

    Both scores move in one round: kind 0 is trust along the links, kind 1 distrust against them.
    A round passes on only what the one before added.
    """
    both = links.select(F.lit(0).alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "n").unionByName(
        links.select(F.lit(1).alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "n")
    )
    hosts = seeds.select("host").union(links.select("src")).union(links.select("dst")).distinct()
    nodes = hosts.join(seeds, "host", "left").select(
        "host", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("seed")) for k, c in enumerate(("trust", "distrust"))]))
    )
    nodes = written(nodes, "url-nodes")
    totals = both.groupBy("kind", "from").agg(F.sum("n").alias("total"))
    edges = written(both.join(totals, ["kind", "from"]).select(F.col("kind").alias("e_kind"), "from", "to", (F.col("n") / F.col("total")).alias("share")), "url-edges")
    seed = F.coalesce(_share(F.col("seed"), _by_kind(nodes, "seed")), F.lit(0.0))
    state = nodes.select("kind", "host", seed.alias("score"), seed.alias("added"))
    while True:
        for _ in range(AT_ONCE):
            sent = state.filter("added > 0").join(edges, (F.col("host") == F.col("from")) & (F.col("kind") == F.col("e_kind")))
            got = sent.groupBy(F.col("e_kind").alias("g_kind"), F.col("to").alias("g_host")).agg((damping * F.sum(F.col("added") * F.col("share"))).alias("got"))
            new = F.coalesce("got", F.lit(0.0))
            state = state.join(got, (F.col("kind") == F.col("g_kind")) & (F.col("host") == F.col("g_host")), "left").select(
                "kind", "host", (F.col("score") + new).alias("score"), new.alias("added")
            )
        state = written(state, "url-state")
        if state.filter(F.col("added") > tolerance * F.col("score")).isEmpty():
            break
    state = state.withColumn("score", _share(F.col("score"), _by_kind(state, "score")))
    pick = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    return state.groupBy("host").agg(pick(0).alias("trust"), pick(1).alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's trust and distrust for every row of ``pages``."""
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = read.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    count = lambda v: F.count(F.when(F.col("found.verdict") == v, 1))
    seeds = ruled.filter("host <> ''").groupBy("host").agg(count("allow").alias("trust"), count("block").alias("distrust"))
    scores = written(spread(written(seeds, "url-seeds"), written(host_links(read), "url-links")).withColumnRenamed("host", "s_host"), "url-scores")
    judged = ruled.drop("html").join(scores, F.col("host") == F.col("s_host"), "left")
    by_host = F.when(F.col("distrust") > (1 + MARGIN) * ratio * F.col("trust"), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    rule = "CASE " + " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[2] != "block"))
    )
    verdict = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)
    link = LINK.replace("'", "''")
    return rf"""
WITH RECURSIVE p AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), u AS (SELECT *, {rule} END AS rule FROM p
), w AS (SELECT *, {verdict} END AS by_rule FROM u
), seeds AS (
  SELECT host, count(*) FILTER (by_rule = 'allow') AS trust, count(*) FILTER (by_rule = 'block') AS distrust FROM w WHERE host <> '' GROUP BY host
), t AS (
  SELECT host, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1),
         lambda x: translate(regexp_extract(x, '//([^/?#]*)', 1), '{UPPER}', '{LOWER}')))) AS dst FROM p
), links AS (SELECT host AS src, dst, count(*) AS n FROM t WHERE host <> '' AND dst <> '' AND dst <> host GROUP BY ALL
), e AS (SELECT 0 AS kind, src AS f, dst AS t, n FROM links UNION ALL SELECT 1, dst, src, n FROM links
), shares AS (SELECT kind, f, t, n / sum(n) OVER (PARTITION BY kind, f) AS share FROM e
), r AS (
  SELECT 0 AS step, kind, host, seed / sum(seed) OVER (PARTITION BY kind) AS added FROM (
    SELECT 0 AS kind, host, trust AS seed FROM seeds UNION ALL SELECT 1, host, distrust FROM seeds) WHERE seed > 0
  UNION ALL
  SELECT step + 1, e.kind, e.t, {DAMPING} * sum(added * share) FROM r JOIN shares e ON e.kind = r.kind AND e.f = r.host WHERE step < 160 GROUP BY step, e.kind, e.t
), s AS (SELECT kind, host, sum(added) AS x FROM r GROUP BY kind, host
), n AS (SELECT kind, host, x / sum(x) OVER (PARTITION BY kind) AS x FROM s
), scores AS (SELECT host, coalesce(max(x) FILTER (kind = 0), 0) AS trust, coalesce(max(x) FILTER (kind = 1), 0) AS distrust FROM n GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN distrust > {(1 + MARGIN) * RATIO} * trust THEN 'block' ELSE 'allow' END) AS verdict
FROM w LEFT JOIN scores USING (host)
"""


OP7_SQL = _sql()
