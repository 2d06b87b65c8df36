"""URL filter with redirect equivalence, in DataFrame operations only.

A rule (verdict, host, path) fits a URL whose host is the rule's or one of its
subdomains and whose path starts with the rule's; the longest rule wins. URLs
that redirects (meta refresh) or canonical links join are aliases: a block of
one blocks every alias that no rule judges, unless a rule explicitly allows one
of the aliases. What nothing judges is allowed.

Edge cases: a null URL, or one without "://", has an empty host and path, no
rule and no alias; a null html has no links; links to pages outside the table
join aliases and are judged by the rules as well; loops, repeated rows and
repeated links change nothing; every row of a repeated page is returned; a page of
any length is searched whole; an empty table gives an empty table. Columns of
the input other than page_id, url and html are neither read nor returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Production rules: verdict, and host and path as one string.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits; null if none does."""

    def fits(rule: str) -> Column:
        h, slash, p = rule.partition("/")
        return ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)

    by_length = sorted({r for _, r in rules}, key=lambda r: (-len(r), r))
    return F.coalesce(*(F.when(fits(r), r) for r in by_length)) if by_length else F.lit(None).cast("string")


def verdict_of(rule: Column, rules=RULES) -> Column:
    return F.coalesce(*(F.when(rule == r, v) for v, r in rules)) if rules else F.lit(None).cast("string")


def _without_dots(path: Column) -> Column:
    """The path with its segments `.` and `..` resolved; one `..` too many stays at the root."""
    parts = F.split(F.regexp_replace(path, r"/\.\.?\z", "$0/"), "/")
    up = lambda out: F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), lambda out, s: F.when(s == "..", up(out)).when(s == ".", out).otherwise(F.concat(out, F.array(s))))
    return F.when(path.rlike(r"/\.\.?(?:/|\z)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def node_of(url: Column) -> Column:
    """The URL without fragment and dot segments, its scheme and host in lower case; null where there is no host."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), _without_dots(path_of(url)), query))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once; also keeps the generated code short."""
    return F.transform(F.array(value), use)[0]


def _absolute(url: Column, to: Column) -> Column:
    """Where a link `to` of the page `url` leads; null if it stays on the page."""
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*/)?", 1)
    return (
        F.when(to.rlike(r"^(?:$|#)"), None)
        .when(to.startswith("?"), F.concat(site, path_of(url), to))
        .when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), to))
        .when(to.startswith("/"), F.concat(site, to))
        .otherwise(F.concat(site, F.regexp_replace(folder, "^$", "/"), to))
    )


#: A comment, a script or a link or meta tag; each alternative ends at its end or the page's, so that no byte is searched twice.
_PIECES = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*+>|\z)|<(?:link|meta)\b[^>]*+(?:>|\z)"


def links(pages: DataFrame) -> DataFrame:
    """`a, b`: nodes that a canonical link or a meta refresh of a page joins. What a comment or script has is none, and one that isn't closed goes on to the page's end."""
    found = pages.where("lower(html) LIKE '%canonical%' OR lower(html) LIKE '%refresh%'")
    tags = F.filter(F.regexp_extract_all("html", F.lit(_PIECES), F.lit(0)), lambda t: t.rlike("(?i)^<[lm]") & t.endswith(">"))
    found = found.select("url", F.explode(tags).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?is)^<link\b.*\srel\s*+=\s*+[\"']?canonical\b"), F.regexp_extract("tag", r"(?is)\shref\s*+=\s*+(?:\"([^\"]*)\"|'[^']*'|[^\s>\"']+)", 0))
    canonical = F.regexp_replace(canonical, r"(?is)^\shref\s*+=\s*+|[\"']", "")
    refresh = F.when(F.col("tag").rlike(r"(?is)^<meta\b.*\shttp-equiv\s*+=\s*+[\"']?refresh\b"), F.regexp_extract("tag", r"(?is)[;,\s\"']url\s*+=\s*+[\"']?([^\"'>\s]+)", 1))
    to = F.regexp_replace(F.coalesce(canonical, refresh), r"(?i)&#(?:47|x2f);|&sol;", "/")
    to = F.trim(F.regexp_replace(F.regexp_replace(to, r"(?i)&#(?:58|x3a);|&colon;", ":"), r"(?i)&(?:amp|#38|#x26);", "&"))
    return found.select(node_of(F.col("url")).alias("a"), _let(_let(to, lambda t: _absolute(F.col("url"), t)), node_of).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def judge(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """`page_id, host, path, rule, verdict, alias_of` of each page; `edges` (a, b) are more equivalent URLs, such as a redirect log's."""
    pages = pages.select("page_id", "url", "html")
    joined = links(pages)
    if edges is not None:
        more = edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        joined = reduce(DataFrame.union, (joined, more)).distinct()
    alias = components(joined)
    own = verdict_of(rule_of(host_of(F.col("node")), path_of(F.col("node")), rules), rules)
    ruled = alias.select("label", own.alias("own")).groupBy("label").agg(F.bool_or(F.col("own") == "allow").alias("allowed"), F.bool_or(F.col("own") == "block").alias("blocked"))
    passed = F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block")
    alias = alias.join(ruled, "label").select("node", "label", passed.alias("passed"))

    url = F.col("url")
    page = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    page = page.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).join(alias, "node", "left")
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), "passed", F.lit("allow"))
    return page.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("label").alias("alias_of"))


ORACLE = r"""
WITH RECURSIVE page AS (
  SELECT page_id, url, html,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
edge AS (
  SELECT url AS a, regexp_extract(html, '(?is)<link\b[^>]*\srel="canonical"[^>]*\shref="([^"]*)"', 1) AS b FROM pages
  UNION SELECT url, regexp_extract(html, '(?is)<meta\b[^>]*\shttp-equiv="refresh"[^>]*url=([^"]*)"', 1) FROM pages),
node AS (SELECT regexp_replace(a, '#.*', '') AS a, regexp_replace(b, '#.*', '') AS b FROM edge WHERE b LIKE '%://%'),
pair AS (SELECT a, b FROM node UNION SELECT b, a FROM node),
reach(a, b) AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a),
rules(verdict, rule, h, p) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
url AS (SELECT DISTINCT b AS url,
          lower(regexp_extract(b, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)) AS host, regexp_extract(b, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM reach),
judged AS (SELECT url, arg_max(verdict, length(rule)) AS verdict FROM url JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY url),
passed AS (SELECT r.a AS url, CASE WHEN bool_or(j.verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM reach r JOIN judged j ON r.b = j.url GROUP BY r.a),
alias AS (SELECT a AS url, min(b) AS alias_of FROM (SELECT a, b FROM reach UNION SELECT a, a FROM reach) GROUP BY a),
own AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM page JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT page.page_id, host, path, own.rule, coalesce(own.verdict, passed.verdict, 'allow') AS verdict, alias_of
FROM page LEFT JOIN own ON own.page_id = page.page_id
LEFT JOIN passed ON passed.url = regexp_replace(page.url, '#.*', '')
LEFT JOIN alias ON alias.url = regexp_replace(page.url, '#.*', '')
"""
