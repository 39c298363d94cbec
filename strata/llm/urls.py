"""URL filters: rules by host and path, and for all other hosts trust and distrust that spread over the graph of hosts.

``judged`` splits urls and applies the rules. What they allow and block are the seeds of two personalised PageRanks over host edges
(distinct links between different hosts, and an edge both ways between a host and its parent domain where both have pages): trust
begins with the hosts of allowed pages and goes along links, distrust with those of blocked pages and goes against them,
as who links to a bad host is suspect. Each page that a rule fits gives its host a million units, the unit in which both ranks are
kept: whole numbers, rounded down at each step, so that neither the order of sums nor the number of tasks matters. A host is blocked if its distrust
exceeds its trust and what it had if a ``SHARE`` of its own pages were blocked.

DataFrame expressions only. Pages are shuffled without their html and aggregated to hosts at once; a host with many
edges is dealt to parts of ``PART_EDGES`` or fewer, each with its copy of the host's rank, in either direction. Rounds are one plan, cut by a
written table every ``CUT`` of them.

A null url, or one without ``://``, has an empty host and path, which no rule fits and no edge reaches: it is allowed.
Rows that repeat count as often as they come; null ids and null or empty html are no obstacle (no links); an empty table gives no rows. Very long
texts are searched whole. Among rules of equal length the one with the longer host wins, then a blocking one. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import discard, table, written

#: (verdict, host, path prefix), in the order of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ROUNDS, CUT, KEEP_PCT, UNIT = 8, 4, 85, 1_000_000
#: A host's own distrust at which it is blocked: as if so many per cent of its pages were.
SHARE = 50
#: Edges of one host that one task joins.
PART_EDGES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: The host of an absolute link.
LINK = r"(?i)<a[\t\n\f\r ][^>]*href[\t\n\f\r ]*=[\t\n\f\r ]*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'>\t\n\f\r ]+)"


def lowered(host: Column) -> Column:
    return F.translate(host, UPPER, LOWER)


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both are empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return lowered(F.regexp_extract(url, HOST, 1)), F.regexp_extract(url, PATH, 1)


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); null where none does."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict, the last two null where no rule fits. pages: url and others."""
    host, path = parts_of(F.col("url"))
    x = pages.withColumns({"host": host, "path": path})
    x = x.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    return x.withColumns({"rule": F.col("r.rule"), "verdict": F.col("r.verdict")}).drop("r")


def hosts_of(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Each non-empty host's pages, and those of them that rules allow and block."""
    x = judged(pages.select("url"), rules).where("host <> ''")
    count = lambda v: F.count_if(F.col("verdict") == v)
    return x.groupBy("host").agg(F.count("*").alias("pages"), count("allow").alias("allowed"), count("block").alias("blocked"))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct (src, dst) between different hosts: links, and both ways between a host and its parent domain if both have pages."""
    links = pages.select(parts_of(F.col("url"))[0].alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))).alias("dst"))
    links = links.select("src", lowered(F.col("dst")).alias("dst"))
    up = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]*\.(.+)$", 1).alias("dst")).where("dst <> ''")
    up = up.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst")
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.where("src <> '' AND dst <> '' AND src <> dst").unionByName(both).distinct()


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, keep: int = KEEP_PCT, part_edges: int = PART_EDGES, cut: int = CUT) -> DataFrame:
    """Personalised PageRank in whole units for every kind of seed: (kind, host, mass). seeds: kind, host, mass; edges: kind, src, dst.

    In a round a host keeps ``100 - keep`` per cent of its seed and passes ``keep`` per cent of its mass on, in equal
    parts; what a host without edges holds is not passed on.
    """
    fan = written(edges.groupBy("kind", "src").agg(F.count("*").alias("out")).withColumn("parts", F.ceil(F.col("out") / part_edges).cast("int")), "url-fan")
    dealt = edges.join(fan, ["kind", "src"]).select("kind", "src", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part"), "dst")
    dealt = written(dealt, "url-edges")
    places = fan.select("kind", F.col("src").alias("host"), "out", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = seeds.select("kind", "host", F.expr(f"(mass DIV 100) * {100 - keep}").alias("mass"))
    rank = seeds.select("kind", "host", "mass")
    held = None
    for i in range(rounds):
        share = rank.join(places, ["kind", "host"]).select("kind", F.col("host").alias("src"), "part", F.expr(f"(mass DIV out) * {keep} DIV 100").alias("mass")).where("mass > 0")
        came = share.join(dealt, ["kind", "src", "part"]).select("kind", F.col("dst").alias("host"), "mass")
        rank = own.unionByName(came).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if (i + 1) % cut == 0 or i + 1 == rounds:
            rank = written(rank, "url-rank")
            if held is not None:
                discard(held)
            held = rank
    discard(fan, dealt)
    return rank


def host_verdicts(pages: DataFrame, rules: tuple = RULES, share: int = SHARE) -> DataFrame:
    """(host, trust, distrust, blocked) of every host with pages. pages: url and html."""
    hosts = written(hosts_of(pages, rules), "url-hosts")
    links = written(host_edges(pages, hosts), "url-links")
    seed = lambda kind, c: hosts.where(F.col(c) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(c) * UNIT).alias("mass"))
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    rank = spread(seed("trust", "allowed").unionByName(seed("distrust", "blocked")), edges)
    mass = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0)).alias(kind)
    x = hosts.select("host", "pages").join(rank.groupBy("host").agg(mass("trust"), mass("distrust")), "host", "left").na.fill(0, ["trust", "distrust"])
    own = F.expr(f"pages * {UNIT // 100 * (100 - KEEP_PCT)} * {share} DIV 100")
    out = written(x.select("host", "trust", "distrust", ((F.col("distrust") > F.col("trust")) & (F.col("distrust") > own)).alias("blocked")), "url-verdicts")
    discard(hosts, links, rank)
    return out


def filter_urls(pages: DataFrame, rules: tuple = RULES, share: int = SHARE, html: DataFrame | None = None) -> DataFrame:
    """``pages`` (url and any others) with host, path, rule and verdict: the rule's, else its host's."""
    bad = host_verdicts(pages if html is None else html, rules, share).where("blocked").select("host", "blocked")
    x = judged(pages, rules).join(bad, "host", "left")
    return x.withColumn("verdict", F.coalesce("verdict", F.when(F.col("blocked"), "block").otherwise("allow"))).drop("blocked")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages.select("page_id", "url"), html=pages.select("url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rules_sql(value, rules: tuple = RULES) -> str:
    order = sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block"), reverse=True)
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'" for v, h, p in order) + " END"


def _rank_sql(i: int) -> str:
    return f"""rank{i} AS MATERIALIZED (SELECT kind, host, sum(mass)::BIGINT AS mass FROM (
  SELECT kind, host, (mass // 100) * {100 - KEEP_PCT} AS mass FROM rank0
  UNION ALL SELECT r.kind, e.dst, ((r.mass // f.n) * {KEEP_PCT}) // 100 FROM rank{i - 1} r JOIN fan f ON f.kind = r.kind AND f.src = r.host JOIN e ON e.kind = r.kind AND e.src = r.host) GROUP BY kind, host)"""


OP12_SQL = f"""WITH s AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{HOST}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path FROM pages),
p AS (SELECT *, {_rules_sql(lambda v, h, p: h + p)} AS rule, {_rules_sql(lambda v, h, p: v)} AS ruled FROM s),
hosts AS (SELECT host, count(*) AS pages, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked FROM p WHERE host <> '' GROUP BY host),
up AS (SELECT host AS src, regexp_extract(host, '^[^.]*\\.(.+)$', 1) AS dst FROM hosts WHERE regexp_extract(host, '^[^.]*\\.(.+)$', 1) IN (SELECT host FROM hosts)),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), {_sql_text(LINK)}, 1)), '{UPPER}', '{LOWER}') AS dst FROM s),
g AS (SELECT src, dst FROM links WHERE src <> '' AND dst <> '' AND src <> dst UNION SELECT src, dst FROM up UNION SELECT dst, src FROM up),
e AS MATERIALIZED (SELECT 'trust' AS kind, src, dst FROM g UNION ALL SELECT 'distrust', dst, src FROM g),
fan AS (SELECT kind, src, count(*) AS n FROM e GROUP BY kind, src),
rank0 AS (SELECT 'trust' AS kind, host, allowed * {UNIT} AS mass FROM hosts WHERE allowed > 0 UNION ALL SELECT 'distrust', host, blocked * {UNIT} FROM hosts WHERE blocked > 0),
{", ".join(_rank_sql(i + 1) for i in range(ROUNDS))},
t AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM rank{ROUNDS} GROUP BY host)
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN distrust > trust AND distrust > hosts.pages * {UNIT // 100 * (100 - KEEP_PCT)} * {SHARE} // 100 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hosts USING (host) LEFT JOIN t USING (host)"""
