"""Empirical-Bayes host reputation for URL filtering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, salted_join, sized_broadcast, table

#: (verdict, host and path); a rule covers its host and all subdomains, paths by prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@dataclass(frozen=True)
class Reputation:
    """``z`` standard deviations below the posterior mean must reach ``floor`` for a page to be allowed."""

    z: float = 1.0
    floor: float = 0.4
    least_strength: float = 1.0
    most_strength: float = 1000.0


def _folded(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _folded(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as ``struct(verdict, rule)``; null where none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def reputation(outcomes: DataFrame, params: Reputation = Reputation()) -> DataFrame:
    """(host, pages, n_good, n_all, mean, bound) from labelled outcomes ``(host, good 0/1 or null)`` of pages.

    Hosts shrink to their registered domain (last two labels), domains to their suffix (last label),
    suffixes to the overall rate, each as a beta-binomial: the prior's mean is the parent's posterior
    mean, its strength comes from the moments of the children's rates at that level. Outcomes are summed
    by host before anything is joined; a host without labelled pages gets its parent's mean.
    """
    p = params
    scratch = Scratch(outcomes.sparkSession, "hosts")
    host = outcomes.groupBy("host").agg(F.sum(F.coalesce(F.col("good"), F.lit(0))).cast("double").alias("g"), F.count("good").cast("double").alias("n"), F.count(F.lit(1)).alias("pages"))
    host = scratch.pin(host).withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})

    def up(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("n").alias("n"))

    def strength(df: DataFrame) -> DataFrame:
        """One row: the moments' estimate of a + b at this level, clamped."""
        rows = df.where("n > 0")
        m = rows.agg(
            F.count(F.lit(1)).alias("k"), F.sum("n").alias("sn"), F.sum("g").alias("sg"),
            F.sum(F.col("n") * F.col("n")).alias("sn2"), F.sum(F.col("g") * F.col("g") / F.col("n")).alias("sg2"),
        )
        mu = F.col("sg") / F.col("sn")
        within = mu * (1 - mu)
        spread = F.col("sg2") - F.col("sn") * mu * mu  # sum of n (rate - mu)^2
        rho = (spread - within * (F.col("k") - 1)) / (within * (F.col("sn") - F.col("sn2") / F.col("sn") - F.col("k") + 1))
        usable = (F.col("k") > 1) & (within > 0) & (F.col("sn") - F.col("sn2") / F.col("sn") - F.col("k") + 1 > 0)
        s = F.when(usable, F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(p.most_strength))).otherwise(F.lit(p.least_strength))
        return m.select(F.least(F.greatest(s, F.lit(p.least_strength)), F.lit(p.most_strength)).alias("strength"))

    domain, suffix = up(host, "domain", "suffix"), up(host, "suffix")
    hosts = host.groupBy("domain").agg(F.count(F.lit(1)).alias("hosts"))
    overall = suffix.agg(((F.coalesce(F.sum("g"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("mean"))

    def shrink(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
        s = F.broadcast(strength(child))  # one row
        if on == ["domain"]:  # a domain may have very many hosts
            got = salted_join(child, parent, on, "hosts", ["host"])
        else:  # suffixes are few
            got = child.join(sized_broadcast(parent, 100_000), on) if on else child.join(F.broadcast(parent))
        got = got.join(s)
        a = F.col("g") + F.col("strength") * F.col("mean")
        n = F.col("n") + F.col("strength")
        return got.withColumns({"a": a, "ab": n}).withColumn("mean", F.col("a") / F.col("ab"))

    at_suffix = scratch.pin(shrink(suffix, overall, []).select("suffix", "mean"))
    at_domain = scratch.pin(shrink(domain, at_suffix, ["suffix"]).select("domain", "mean").join(hosts, "domain"))
    at_host = shrink(host, at_domain, ["domain"])
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("ab") + 1))
    return at_host.select("host", "pages", F.col("g").cast("long").alias("n_good"), F.col("n").cast("long").alias("n_all"), "mean", (F.col("mean") - F.lit(p.z) * sd).alias("bound"))


def judge(pages: DataFrame, rules=RULES, params: Reputation = Reputation()) -> DataFrame:
    """Every page with ``host, path, rule, verdict, mean, bound``.

    A rule's verdict stands; a page that no rule fits is allowed if its host's posterior lower bound
    reaches the floor. The labelled outcomes are the rules' own verdicts. A null url, or one without
    ``://``, has an empty host and path and is judged by the overall rate. Columns of ``pages`` other
    than ``page_id`` and ``url`` are not read; repeated rows are judged each; an empty table gives none.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    p = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    p = p.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    seen = reputation(p.select("host", (F.col("_rule.verdict") == "allow").cast("int").alias("good")), params)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("bound") >= params.floor, F.lit("allow")).otherwise(F.lit("block")))
    seen = Scratch(pages.sparkSession, "seen").pin(seen.select("host", "pages", "mean", "bound"))
    return salted_join(p, seen, ["host"], "pages", ["page_id", "url"]).select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.round("mean", 6).alias("mean"), F.round("bound", 6).alias("bound"))


def op3_url_filter(spark, sf_dir):
    """Judges every page; repeated rows are judged each."""
    return judge(table(spark, sf_dir, "pages"))


SQL = r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
rules(verdict, rhost, rpath, rule) AS (VALUES ('allow','org','/','org/'), ('block','example.org','/es/','example.org/es/'), ('block','example.org','/en/1','example.org/en/1'), ('allow','com','/fr/','com/fr/'), ('block','com','/de/','com/de/')),
p AS (SELECT u.*, (SELECT arg_max(rule, length(rule)) FROM rules WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)) AS rule FROM u),
q AS (SELECT p.*, r.verdict rv FROM p LEFT JOIN rules r ON r.rule = p.rule),
h AS (SELECT host, string_split(host, '.')[-1] suffix, CASE WHEN len(string_split(host, '.')) < 2 THEN host ELSE string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] END AS domain,
  CAST(sum(CASE WHEN rv = 'allow' THEN 1 ELSE 0 END) AS DOUBLE) g, CAST(count(rv) AS DOUBLE) n FROM q GROUP BY host),
d AS (SELECT domain, suffix, sum(g) g, sum(n) n FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(g) g, sum(n) n FROM h GROUP BY ALL),
lv AS (SELECT 'h' lv, g, n FROM h WHERE n > 0 UNION ALL SELECT 'd', g, n FROM d WHERE n > 0 UNION ALL SELECT 's', g, n FROM s WHERE n > 0),
m AS (SELECT lv, count(*) k, sum(n) sn, sum(g)/sum(n) mu, sum(n*n)/sum(n) nn, sum(g*g/n) sg2 FROM lv GROUP BY lv),
w AS (SELECT lv, least(greatest(CASE WHEN k > 1 AND mu*(1-mu) > 0 AND sn - nn - k + 1 > 0 THEN
  CASE WHEN sg2 - sn*mu*mu - mu*(1-mu)*(k-1) > 0 THEN mu*(1-mu)*(sn-nn-k+1)/(sg2 - sn*mu*mu - mu*(1-mu)*(k-1)) - 1 ELSE 1000.0 END ELSE 1.0 END, 1.0), 1000.0) st FROM m),
t AS (SELECT lv, coalesce((SELECT st FROM w WHERE w.lv = l.lv), 1.0) st FROM (VALUES ('h'), ('d'), ('s')) l(lv)),
o AS (SELECT (coalesce(sum(g), 0) + 1) / (coalesce(sum(n), 0) + 2) mean FROM s),
s2 AS (SELECT suffix, (g + st*o.mean)/(n + st) mean FROM s, t, o WHERE t.lv = 's'),
d2 AS (SELECT domain, (g + st*s2.mean)/(n + st) mean FROM d JOIN s2 USING (suffix), t WHERE t.lv = 'd'),
h2 AS (SELECT host, (g + st*d2.mean)/(n + st) mean, n + st ab FROM h JOIN d2 USING (domain), t WHERE t.lv = 'h'),
h3 AS (SELECT host, mean, mean - 1.0 * sqrt(mean*(1-mean)/(ab+1)) bound FROM h2)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN bound >= 0.4 THEN 'allow' ELSE 'block' END) AS verdict, round(mean, 6) AS mean, round(bound, 6) AS bound FROM q JOIN h3 USING (host)
"""
