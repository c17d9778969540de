"""URL filtering by rules and by propagation over the graph of hosts.

A rule names a host with its subdomains and the start of a path; the longest fitting rule decides.
Pages without a rule are judged by their host. Hosts are seeds to the share of their pages that a
rule allows (trusted) or blocks (distrusted); a host that is only linked to is a seed if a rule
covers its whole site. Trust flows along links, divided among a host's links (personalised
PageRank); distrust flows against them, from a host to those that link to it, divided among the
linking hosts. A host's pages are blocked when its distrust exceeds its trust by more than half the
mass of one wholly blocked host.

Only DataFrame functions run here. Links are reduced to distinct pairs of hosts before the rounds,
with partial aggregation, so a hot host costs one row per neighbour. Every round is a join and a
sum over those pairs, staged in the shared folder. The verdict reaches pages through the list of
blocked hosts; a host with a third of all pages is split by the skew join.

Defined cases: null urls and urls without ``://`` have empty host and path, fit no rule and are
allowed; relative links and links inside one host are no edges; null html has no links; repeated
pages are judged alike and count as often as they stand; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, staged, table

#: fixed values: (verdict, rule)
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
DAMPING = 0.85
ROUNDS = 20
#: net distrust, in units of one wholly blocked host, above which a host is blocked
THRESHOLD = 0.5
#: below any real difference, above what the order of a sum changes
SLACK = 1e-9

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def parsed(url):
    """Columns (host, path) of a url column."""
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def longest_rule(host, path, rules):
    """The rule that fits, longest first, or null; ties go to the rule listed first."""
    found = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def rule_verdict(rule, rules):
    return F.coalesce(*[F.when(rule == r, F.lit(v)) for v, r in rules])


def judged_by_rules(pages, rules):
    host, path = parsed(F.col("url"))
    return (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
        .withColumn("ruled", rule_verdict(F.col("rule"), rules))
    )


def host_edges(pages):
    """Distinct pairs (src, dst) of different hosts, from the links in ``html``."""
    host, _ = parsed(F.col("url"))
    return (
        pages.where(F.col("html").contains("//"))
        .select(
            host.alias("src"),
            F.explode(
                F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))
            ).alias("dst"),
        )
        .select("src", lower_ascii(F.col("dst")).alias("dst"))
        .where("src <> '' AND src <> dst")
        .distinct()
    )


def host_seeds(ruled, edges, rules):
    """host, trusted, blocked: shares of the host's pages that a rule allows or blocks."""
    own = ruled.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("trusted"),
        F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("blocked"),
    )
    linked = edges.select(F.col("dst").alias("host")).distinct().join(own, "host", "left_anti")
    site = rule_verdict(longest_rule(F.col("host"), F.lit("/"), rules), rules)
    return own.unionByName(
        linked.select(
            "host",
            F.when(site == "allow", 1.0).otherwise(0.0).alias("trusted"),
            F.when(site == "block", 1.0).otherwise(0.0).alias("blocked"),
        )
    )


def propagated(seeds, edges, rounds=ROUNDS, damping=DAMPING):
    """host, trust, distrust after ``rounds`` rounds."""
    if edges.isEmpty():
        return seeds.select(
            "host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust")
        )
    out = edges.groupBy(F.col("src")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy(F.col("dst")).agg(F.count(F.lit(1)).alias("n_in"))
    forward = edges.join(out, "src").select(
        F.col("src").alias("host"), F.col("dst").alias("to"),
        (1.0 / F.col("n_out")).alias("carries_trust"), F.lit(0.0).alias("carries_distrust"),
    )
    backward = edges.join(into, "dst").select(
        F.col("dst").alias("host"), F.col("src").alias("to"),
        F.lit(0.0).alias("carries_trust"), (1.0 / F.col("n_in")).alias("carries_distrust"),
    )
    flows = staged(forward.unionByName(backward), "url-flows")
    scores = seeds.select(
        "host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust")
    )
    for _ in range(rounds):
        arriving = (
            flows.join(scores, "host")
            .groupBy(F.col("to").alias("host"))
            .agg(
                F.sum(F.col("trust") * F.col("carries_trust")).alias("t"),
                F.sum(F.col("distrust") * F.col("carries_distrust")).alias("d"),
            )
        )
        scores = staged(
            seeds.join(arriving, "host", "left").select(
                "host",
                (F.col("trusted") + F.coalesce(damping * F.col("t"), F.lit(0.0))).alias("trust"),
                (F.col("blocked") + F.coalesce(damping * F.col("d"), F.lit(0.0))).alias("distrust"),
            ),
            "url-scores",
        )
    return scores


def judged(pages, rules=RULES, rounds=ROUNDS, damping=DAMPING, threshold=THRESHOLD):
    """page_id, host, path, rule, verdict of every page."""
    ruled = judged_by_rules(pages, rules)
    edges = staged(host_edges(pages), "url-edges")
    seeds = staged(host_seeds(ruled, edges, rules), "url-seeds")
    blocked = (
        propagated(seeds, edges, rounds, damping)
        .where(F.col("distrust") - F.col("trust") > threshold + SLACK)
        .select("host", F.lit(True).alias("host_blocked"))
    )
    by_host = F.when(F.col("host_blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict")
    )


def op2_url_verdicts(spark, sf_dir):
    """The verdict on every page's url."""
    return judged(table(spark, sf_dir, "pages"))


def op2_sql(rules=RULES):
    def host_of(url):
        return f"translate(regexp_extract({url}, '{URL}', 1), '{UPPER}', '{LOWER}')"

    def rule_of(host, path):
        whens = []
        for _, rule in sorted(rules, key=lambda r: -len(r[1])):
            name, _, rest = rule.partition("/")
            whens.append(
                f"WHEN ({host} = '{name}' OR ends_with({host}, '.{name}')) "
                f"AND starts_with({path}, '/{rest}') THEN '{rule}'"
            )
        return f"CASE {' '.join(whens)} END"

    def verdict_of(rule):
        return f"CASE {rule} " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in rules) + " END"

    link = LINK.replace("'", "''")
    return f"""
WITH RECURSIVE ruled AS (
  SELECT *, {verdict_of('rule')} AS ruled FROM (
    SELECT *, {rule_of('host', 'path')} AS rule FROM (
      SELECT page_id, html, {host_of("coalesce(url, '')")} AS host,
             regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages))),
edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst
    FROM ruled) WHERE src <> '' AND src <> dst),
own AS (
  SELECT host, avg(CASE ruled WHEN 'allow' THEN 1 ELSE 0 END) AS trusted,
         avg(CASE ruled WHEN 'block' THEN 1 ELSE 0 END) AS blocked FROM ruled WHERE host <> '' GROUP BY host),
linked AS (
  SELECT host, {verdict_of(rule_of('host', "'/'"))} AS site FROM (
    SELECT DISTINCT dst AS host FROM edges WHERE dst NOT IN (SELECT host FROM own))),
seeds AS (
  SELECT * FROM own UNION ALL
  SELECT host, CASE site WHEN 'allow' THEN 1 ELSE 0 END, CASE site WHEN 'block' THEN 1 ELSE 0 END FROM linked),
flows AS (
  SELECT src AS host, dst AS target, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS ct, 0::DOUBLE AS cd FROM edges
  UNION ALL
  SELECT dst, src, 0, 1.0::DOUBLE / count(*) OVER (PARTITION BY dst) FROM edges),
rounds AS (
  SELECT 0 AS k, host, trusted::DOUBLE AS trust, blocked::DOUBLE AS distrust FROM seeds
  UNION ALL
  SELECT s.k, s.host, s.trusted + {DAMPING} * coalesce(a.t, 0), s.blocked + {DAMPING} * coalesce(a.d, 0)
  FROM (SELECT n.k, seeds.* FROM seeds, (SELECT max(k) + 1 AS k FROM rounds) n WHERE n.k <= {ROUNDS}) s
  LEFT JOIN (SELECT target, sum(trust * ct) AS t, sum(distrust * cd) AS d
             FROM flows JOIN rounds USING (host) GROUP BY target) a ON a.target = s.host),
blocked_hosts AS (
  SELECT host FROM rounds WHERE k = {ROUNDS} AND distrust - trust > {THRESHOLD + SLACK!r})
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN host IN (SELECT host FROM blocked_hosts) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""
