"""URL filters over redirect equivalence, in DataFrame functions only.

Redirects and canonical links join URLs into components (distributed, any shape of graph).  A URL that a rule fits
has that rule's verdict.  Any other URL takes its component's: allow if any member is explicitly allowed, else
block if any is blocked, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, connected_components

INLINE_RULES = 500
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to / ? # or the end, A-Z lower-cased; else ''."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """What names a resource: the URL without its fragment, scheme and host lower-cased; null without ``://``."""
    u = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    head = F.regexp_extract(u, r"^(?s:.*?)://[^/?#]*", 0)
    return F.when(head != "", F.concat(F.translate(head, UPPER, UPPER.lower()), F.substring(u, F.length(head) + 1, F.length(u))))


def rule_parts(rule: Column) -> tuple[Column, Column]:
    """(host, path) of a rule: the path is what stands after the host, '' without a slash."""
    host = F.substring_index(rule, "/", 1)
    return F.lower(host), F.substring(rule, F.length(host) + 1, F.length(rule))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<size, rule, verdict> of the longest of some literal rules that fits, or null."""
    parts = [(r, v, *rule_parts(F.lit(r))) for r, v in rules]
    table = F.array(*[F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), on.alias("host"), at.alias("path")) for r, v, on, at in parts])
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"], r["rule"], r["verdict"])))
    return best


def judge_nodes(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with host, path) and ``_rule``: struct of the longest rule that fits.

    Up to ``INLINE_RULES`` rules become literals.  Beyond that each host's suffixes are joined with the rules' hosts;
    rows of the same host and path are judged once.
    """
    some = rules.where("rule is not null and verdict is not null").select("rule", "verdict").distinct()
    listed = some.limit(INLINE_RULES + 1).collect()
    if not listed:
        return urls.withColumn("_rule", F.expr("cast(null as struct<size: int, rule: string, verdict: string>)"))
    if len(listed) <= INLINE_RULES:
        return urls.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), sorted((r.rule, r.verdict) for r in listed)))
    on, at = rule_parts(F.col("rule"))
    table = some.select("rule", "verdict", on.alias("_on"), at.alias("_path"))
    pairs = urls.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    hit = pairs.withColumn("_on", F.explode(suffixes)).join(table, "_on").where(F.startswith("path", F.col("_path")))
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("_rule"))
    return urls.join(best, ["host", "path"], "left")


def _no_dots(path: Column) -> Column:
    """``path`` (empty, or from a slash on) without its dot segments."""
    parts = F.split(F.regexp_replace(path, r"(/\.{1,2})$", "$1/"), "/")
    up = lambda s: F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(1)))
    kept = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda s, x: F.when(x == "..", up(s)).when(x == ".", s).otherwise(F.concat(s, F.array(x))))
    return F.array_join(kept, "/")


def resolve(base: Column, target: Column) -> Column:
    """The URL that ``target`` names on a page of URL ``base``.  A target with a scheme stays as it stands; null if
    ``base`` has no ``://``."""
    t = F.regexp_replace(F.trim(target), r"(?s)#.*$", "")
    head = F.regexp_extract(base, r"^(?s:.*?)://[^/?#]*", 0)
    scheme = F.regexp_extract(base, r"^(?s:.*?):", 0)
    way = F.regexp_replace(F.regexp_extract(t, r"^[^?]*", 0), r"^//[^/]*", "")
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(base), r"^/((?s:.*)/)?", 1))
    path = F.when(t.rlike(r"^/"), way).otherwise(F.concat(folder, way))
    site = F.when(t.rlike(r"^//"), F.concat(scheme, F.regexp_extract(t, r"^//[^/?]*", 0))).otherwise(head)
    joined = F.concat(site, _no_dots(path), F.regexp_extract(t, r"(?s)\?.*$", 0))
    same = F.concat(head, path_of(base), t)
    return F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), t).when(head == "", F.lit(None)).when(t == "", base).when(t.rlike(r"^\?"), same).otherwise(joined)


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of a page's URL and of its canonical link or refresh target, where different.  Relative targets
    are resolved against the page's first base element with an href, else its URL."""
    html = F.coalesce(F.col("html"), F.lit(""))
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?is)\srel\s*=\s*[\"']?canonical\b"))
    canonical = F.transform(links, lambda t: F.regexp_extract(t, r"(?is)\shref\s*=\s*[\"']?([^\"'>\s]+)", 1))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?is)\shttp-equiv\s*=\s*[\"']?refresh\b"))
    refresh = F.transform(metas, lambda t: F.regexp_extract(t, r"(?is)url\s*=\s*[\"']?([^\"'>\s]+)", 1))
    plain = lambda c: F.regexp_replace(c, "&amp;", "&")
    named = plain(F.regexp_extract(html, r"(?is)<base\b[^>]*\shref\s*=\s*[\"']?([^\"'>\s]+)", 1))
    found = pages.select(F.trim("url").alias("url"), named.alias("named"), F.explode(F.concat(canonical, refresh)).alias("t")).where("t <> ''")
    found = found.select("url", "t", resolve(F.col("url"), F.col("named")).alias("base"))
    pairs = found.select(node_of(F.col("url")).alias("a"), node_of(resolve(F.col("base"), plain(F.col("t")))).alias("b"))
    return pairs.where("a is not null and b is not null and a <> b").distinct()


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` (url, html) with host, path, rule, verdict, group (smallest URL of the component, null if alone).

    Null url, or one without ``://``: empty host and path, no rule, allowed.  ``redirects`` (source, target) adds
    edges.  Of rules of equal length the greater text wins, a rule listed with both verdicts
    blocks.  Repeated rows are each judged; columns of the result's names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "group")
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")).where("a is not null and b is not null and a <> b")).distinct()
    part = connected_components(edges, "aliases")
    of_node = lambda c: [host_of(F.col(c)).alias("host"), path_of(F.col(c)).alias("path")]
    ruled = judge_nodes(part.select("node", "component", *of_node("node")), rules)
    decided = ruled.groupBy("component").agg(F.max((F.col("_rule.verdict") == "allow").cast("int")).alias("ok"), F.max((F.col("_rule.verdict") == "block").cast("int")).alias("bad"))
    passed = part.join(decided, "component").select(F.col("node").alias("_node"), F.col("component").alias("group"), F.when(F.col("ok") == 1, "allow").when(F.col("bad") == 1, "block").otherwise("allow").alias("_passed"))
    out = judge_nodes(pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))), rules)
    out = out.withColumn("_node", node_of(F.col("url"))).join(passed, "_node", "left")
    return out.withColumn("rule", F.col("_rule.rule")).withColumn("verdict", F.coalesce("_rule.verdict", "_passed", F.lit("allow"))).drop("_rule", "_passed", "_node")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(list(RULES), "rule string, verdict string")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH RECURSIVE rules(rule, verdict, rhost, rpath) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
     p AS (SELECT row_number() OVER () AS r, page_id, url, html,
                  translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
                  regexp_replace(trim(url, ' '), '#(?s:.*)$', '') AS node FROM pages),
     t AS (SELECT node AS a, unnest(list_concat(regexp_extract_all(html, '(?is)<link\b[^>]*\srel\s*=\s*["'']?canonical\b[^>]*\shref\s*=\s*["'']?([^"''>\s]+)', 1),
                                                regexp_extract_all(html, '(?is)<meta\b[^>]*\shttp-equiv\s*=\s*["'']?refresh\b[^>]*url\s*=\s*["'']?([^"''>\s]+)', 1))) AS x FROM p),
     e1 AS (SELECT DISTINCT a, regexp_replace(x, '#(?s:.*)$', '') AS b FROM t WHERE contains(a, '://') AND contains(x, '://')),
     e AS (SELECT a, b FROM e1 UNION SELECT b, a FROM e1),
     reach AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node WHERE reach.root <= e.b),
     comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
     nodes AS (SELECT node, root, translate(regexp_extract(node, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(node, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM comp),
     nr AS (SELECT n.node, n.root, arg_max(verdict, length(rule)) AS verdict FROM nodes n LEFT JOIN rules ON (n.host = rhost OR ends_with(n.host, '.' || rhost)) AND starts_with(n.path, rpath) GROUP BY n.node, n.root),
     dec AS (SELECT root, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' ELSE 'allow' END AS verdict FROM nr GROUP BY root),
     pr AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath) GROUP BY r)
SELECT p.page_id, p.host, p.path, pr.rule, coalesce(pr.verdict, dec.verdict, 'allow') AS verdict
FROM p LEFT JOIN pr USING (r) LEFT JOIN comp ON comp.node = p.node LEFT JOIN dec ON dec.root = comp.root
"""
