"""URL filters: rules first, then trust and distrust propagated over the graph of hosts.

Edges: hosts of the links in a page, from the page's host, with the number of linking
pages as weight. Trust: personalised PageRank along the edges, started at hosts by their
number of pages that an allow rule judges. Distrust: the same along reversed edges from
pages that a block rule judges, so hosts that link to blocked ones inherit it. A host is
blocked where the distrust it receives exceeds both the trust it receives and `LEAST`; its
own start mass does not count, so a host without links is allowed.

All masses are whole numbers (a total of `MASS`), each message is rounded down, so sums do
not depend on their order. Columns and SQL functions only.

Null urls and urls without "://" have an empty host and path and match no rule; null html
has no links. Repeated rows are judged alike and count as pages of their host each. A host
whose distrust equals its trust is allowed. Very long urls and pages are read whole. Other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
MASS = 1e15
LEAST = 1e6
DAMPING = 0.85
STEPS = 10
_BIG, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = "[hH][rR][eE][fF] *= *[\"']?(?:[hH][tT][tT][pP][sS]?:)?//([^/?#\"' >\t\n]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or has no "://"."""
    part = lambda g: F.coalesce(F.regexp_extract(url, _URL, g), F.lit(""))
    return F.translate(part(1), _BIG, _LOW), part(2)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, w: how many pages of src link to dst. Repeats are summed before the shuffle."""
    to = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_HREF), 1), lambda x: F.translate(x, _BIG, _LOW)))
    return (
        pages.select(F.col("host").alias("src"), F.explode(to).alias("dst"))
        .where((F.col("src") != "") & (F.col("dst") != F.col("src")))
        .groupBy("src", "dst").agg(F.count("*").alias("w"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = STEPS) -> DataFrame:
    """host, kind, received. seeds: host, kind (trust or distrust), pages."""
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "w").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "w")
    )
    out = both.groupBy("kind", "host").agg(F.sum("w").alias("all"))
    shares = Stored(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("w").cast("double") / F.col("all").cast("double")).alias("share")))
    totals = seeds.groupBy("kind").agg(F.sum("pages").alias("all"))
    start = Stored(
        seeds.join(F.broadcast(totals), "kind")  # two rows
        .select("kind", "host", F.floor(F.lit(MASS) * (F.col("pages").cast("double") / F.col("all").cast("double"))).alias("mass"))
    )
    home = start.df.select("kind", "host", F.floor((1 - DAMPING) * F.col("mass").cast("double")).alias("mass"))
    at, kept = start.df, None
    for step in range(1, steps + 1):
        sent = (
            at.join(shares.df, ["kind", "host"])
            .groupBy("kind", "to").agg(F.sum(F.floor(F.lit(DAMPING) * F.col("mass").cast("double") * F.col("share"))).alias("mass"))
            .withColumnRenamed("to", "host")
        )
        if step == steps:
            return sent.withColumnRenamed("mass", "received")
        at = sent.unionByName(home).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if step % 3 == 0:
            last, kept = kept, Stored(at)
            at = kept.df
            if last:
                last.drop()
    raise ValueError("at least one step")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url, html)."""
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    ruled = named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    kind = F.when(F.col("ruled") == "allow", "trust").otherwise("distrust")
    seeds = ruled.where(F.col("rule").isNotNull()).groupBy("host", kind.alias("kind")).agg(F.count("*").alias("pages"))
    received = propagate(host_edges(named), seeds)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("received")).otherwise(0))
    blocked = (
        received.groupBy("host").agg(of("trust").alias("t"), of("distrust").alias("d"))
        .where((F.col("d") > F.col("t")) & (F.col("d") > int(LEAST))).select("host", F.lit("block").alias("by_links"))
    )
    return ruled.join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "by_links", F.lit("allow")).alias("verdict")
    )


def oracle_sql(rules: list[tuple[str, str, str]] = RULES, steps: int = STEPS) -> str:
    """The same in DuckDB, step by step."""
    low = lambda x: f"translate({x}, '{_BIG}', '{_LOW}')"
    url, href = _URL.replace("'", "''"), _HREF.replace("'", "''").replace("\t", "\\t").replace("\n", "\\n")
    case = {i: " ".join(f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{x}'" for r in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])) for x in [r[2] if i else r[0] + r[1]]) for i in (0, 1)}
    sql = f"""WITH named AS MATERIALIZED (SELECT page_id, html, {low(f"coalesce(regexp_extract(url, '{url}', 1), '')")} AS host, coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages),
ruled AS MATERIALIZED (SELECT page_id, host, path, CASE {case[0]} END AS rule, CASE {case[1]} END AS ruled FROM named),
links AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{href}', 1), lambda x: {low("x")}))) AS dst FROM named),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM links WHERE src <> '' AND src <> dst GROUP BY ALL),
twoway AS (SELECT 'trust' AS kind, src AS host, dst AS "to", w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges),
shares AS MATERIALIZED (SELECT kind, host, "to", CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY kind, host) AS DOUBLE) AS share FROM twoway),
seeds AS (SELECT host, CASE WHEN ruled = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, count(*) AS pages FROM ruled WHERE rule IS NOT NULL GROUP BY ALL),
at0 AS MATERIALIZED (SELECT kind, host, CAST(floor(1e15 * (CAST(pages AS DOUBLE) / CAST(sum(pages) OVER (PARTITION BY kind) AS DOUBLE))) AS BIGINT) AS mass FROM seeds)"""
    for s in range(1, steps + 1):
        sql += f""",
sent{s} AS MATERIALIZED (SELECT kind, "to" AS host, CAST(sum(CAST(floor({DAMPING}::DOUBLE * CAST(mass AS DOUBLE) * share) AS BIGINT)) AS BIGINT) AS mass FROM at{s - 1} JOIN shares USING (kind, host) GROUP BY ALL),
at{s} AS MATERIALIZED (SELECT kind, host, CAST(sum(mass) AS BIGINT) AS mass FROM (SELECT kind, host, mass FROM sent{s} UNION ALL SELECT kind, host, CAST(floor({1 - DAMPING!r}::DOUBLE * CAST(mass AS DOUBLE)) AS BIGINT) FROM at0) GROUP BY ALL)"""
    return sql + f""",
blocked AS (SELECT host FROM sent{steps} GROUP BY host HAVING coalesce(sum(mass) FILTER (kind = 'distrust'), 0) > coalesce(sum(mass) FILTER (kind = 'trust'), 0) AND coalesce(sum(mass) FILTER (kind = 'distrust'), 0) > {int(LEAST)})
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' END, 'allow') AS verdict FROM ruled"""
