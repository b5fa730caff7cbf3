"""URL filters: host and path rules, and block decisions that spread over redirects and canonical links."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, free_name
from quillstone.llm.components import connected_components

#: (verdict, host and path): the rules of the registered query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rules that are literals of a plan; longer lists are joined.
MOST_LITERALS = 200

# Patterns of the links that make two pages one; attributes come in either order.
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
CANONICAL_REVERSED = r"""(?is)<link\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)["']?[^>]*\brel\s*=\s*["']?canonical"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh["']?[^>]*\burl\s*=\s*["']?([^"'\s>;]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_of(url: Column) -> Column:
    """What names a page whatever the scheme and fragment: host, path and query; null without a host."""
    named = F.concat(host_of(url), F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1), F.lit("")))
    return F.when(host_of(url) != "", named)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host the url's host is or ends in, and whose path its path begins with.

    Of equally long rules an allow comes first. Both are null if none fits. For short lists, which become part of the plan.
    """
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[0] != "allow", x[1])):  # the first that fits wins
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule = F.when(fits, F.lit(r)) if rule is None else rule.when(fits, F.lit(r))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def with_rules(rows: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """rows with rule and verdict as rule_for() gives them, from a table (verdict, rule) of any length.

    Each distinct host and path is joined by equality: the host and its parent domains with the rules' hosts, and the path's
    prefixes, of the lengths that rules have, with the rules' paths. A row of rows is joined with one row.
    """
    r = rules.where("rule is not null").select(F.col("verdict").alias("v_"), F.col("rule").alias("r_"), F.substring_index("rule", "/", 1).alias("h_"))
    r = r.withColumn("p_", F.expr("substring(r_, length(h_) + 1)")).withColumn("p_", F.when(F.col("p_") == "", "/").otherwise(F.col("p_")))
    r = r.groupBy("h_", "p_").agg(F.max(F.struct((F.col("v_") == "allow").alias("allow"), F.col("r_"))).alias("best"))
    lengths = sorted(x["n"] for x in r.select(F.length("p_").alias("n")).distinct().collect())  # a number for each length of a path
    seen = rows.select(F.col(host).alias("sh_"), F.col(path).alias("sp_")).distinct()
    labels = F.split("sh_", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("sp_")), lambda n: F.expr("sp_").substr(F.lit(1), n))
    tried = seen.select("sh_", "sp_", F.explode(parents).alias("h_"), prefixes.alias("ps_")).select("sh_", "sp_", "h_", F.explode("ps_").alias("p_"))
    found = tried.join(r, ["h_", "p_"]).groupBy("sh_", "sp_").agg(F.max(F.struct(F.length("best.r_").alias("n"), F.col("best.allow").alias("allow"), F.col("best.r_").alias("rule"))).alias("b_"))
    found = found.select("sh_", "sp_", F.col("b_.rule").alias("rule"), F.when(F.col("b_.allow"), "allow").otherwise("block").alias("verdict"))
    return rows.drop("rule", "verdict").join(found, (F.col(host) == F.col("sh_")) & (F.col(path) == F.col("sp_")), "left").drop("sh_", "sp_")


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target) urls of canonical links and of refreshes to another url; relative targets are resolved."""
    rows = pages.where("url is not null and html is not null").where(F.col("html").rlike("(?i)canonical|refresh"))
    pick = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    rows = rows.select(F.col("url").alias("source"), F.explode(F.array(F.coalesce(pick(CANONICAL), pick(CANONICAL_REVERSED)), pick(REFRESH))).alias("href")).where("href is not null")
    scheme, origin = F.regexp_extract("source", r"^([^:/?#]+:)", 1), F.regexp_extract("source", r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract("source", r"^([^:/?#]+://[^/?#]*(?:[^?#]*/)?)", 1)
    href = F.regexp_replace("href", "&amp;", "&")
    target = F.when(href.contains("://"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, href))
    return rows.select("source", target.alias("target"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] | DataFrame = RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """pages with host, path, rule, verdict, component; without html.

    A rule that fits a page's own url decides. Otherwise the page takes the decision of its component over canonical
    links, refreshes and `redirects` (source, target urls): allow if a rule allows any url of it, else block if one
    blocks any, else `default`. Urls are nodes by a 64-bit hash of host, path and query. Pages without a url, or with one
    that has no ://, have an empty host and path, no rule and no aliases. Repeated pages are judged each; columns named like
    an output are replaced. Rules are a short list, or a table (verdict, rule) of any length.
    """
    if not isinstance(rules, DataFrame) and len(rules) > MOST_LITERALS:
        rules = pages.sparkSession.createDataFrame(list(rules), "verdict string, rule string")

    def ruled(rows: DataFrame, host: str, path: str) -> DataFrame:
        if isinstance(rules, DataFrame):
            return with_rules(rows, rules, host, path)
        rule, verdict = rule_for(F.col(host), F.col(path), rules)
        return rows.withColumns({"rule": rule, "verdict": verdict})

    pages = pages.drop("host", "path", "rule", "verdict", "component")
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    node = lambda c: F.xxhash64(alias_of(F.col(c)))
    links = cut(links.where(alias_of(F.col("source")).isNotNull() & alias_of(F.col("target")).isNotNull()), "url-links")
    member = connected_components(links.select(node("source").alias("a"), node("target").alias("b")))
    urls = links.select(F.explode(F.array("source", "target")).alias("url")).distinct()
    urls = ruled(urls.select(node("url").alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "host", "path")
    said = urls.join(member, "node").groupBy("component")
    decided = said.agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
    spread = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise(default)
    key, other, given = (free_name(pages, x) for x in ("node_of_page", "node_", "spread_"))
    decided = member.join(decided, "component").select(F.col("node").alias(other), F.col("component"), spread.alias(given))
    keep = [c for c in pages.columns if c != "html"]
    rows = pages.select(*keep, F.when(alias_of(F.col("url")).isNotNull(), node("url")).alias(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = ruled(rows, "host", "path").join(decided, F.col(key) == F.col(other), "left")
    return rows.withColumn("verdict", F.coalesce("verdict", given, F.lit(default))).drop(key, other, given)


def op9(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    return judge(pages.select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _sql_rule(host: str, path: str) -> tuple[str, str]:
    rules = sorted(RULES, key=lambda x: -len(x[1]))
    when = lambda r, out: f"WHEN ({host} = '{r.partition('/')[0]}' OR suffix({host}, '.{r.partition('/')[0]}')) AND starts_with({path}, '/{r.partition('/')[2]}') THEN '{out}'"
    return tuple("CASE " + " ".join(when(r, (v, r)[i]) for v, r in rules) + " END" for i in (1, 0))


def _sql_host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '://([^/?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _sql_alias(url: str) -> str:
    return f"nullif({_sql_host(url)}, '') || coalesce(regexp_extract({url}, '://[^/?#]*([^#]*)', 1), '')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def oracle_sql() -> str:
    own, said = _sql_rule("host", "path"), _sql_rule(_sql_host("alias"), "alias_path")
    return f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, {_sql_host("url")} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), href AS (
  SELECT url AS source, unnest([coalesce(nullif(regexp_extract(html, {_quoted(CANONICAL)}, 1), ''), nullif(regexp_extract(html, {_quoted(CANONICAL_REVERSED)}, 1), '')),
    nullif(regexp_extract(html, {_quoted(REFRESH)}, 1), '')]) AS href FROM p WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')
), link AS (
  SELECT source, CASE WHEN contains(h, '://') THEN h WHEN starts_with(h, '//') THEN regexp_extract(source, '^([^:/?#]+:)', 1) || h
    WHEN starts_with(h, '/') THEN regexp_extract(source, '^([^:/?#]+://[^/?#]*)', 1) || h
    ELSE regexp_extract(source, '^([^:/?#]+://[^/?#]*(?:[^?#]*/)?)', 1) || h END AS target
  FROM (SELECT source, replace(href, '&amp;', '&') AS h FROM href WHERE href IS NOT NULL)
), edge AS (
  SELECT {_sql_alias("source")} AS a, {_sql_alias("target")} AS b FROM link WHERE {_sql_alias("source")} IS NOT NULL AND {_sql_alias("target")} IS NOT NULL
), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge
), reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), said AS (
  SELECT a, {said[1]} AS v FROM (SELECT a, 'x://' || b AS alias, regexp_extract('x://' || b, '://[^/?#]*([^?#]*)', 1) AS alias_path FROM reach)
), spread AS (SELECT a, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v FROM said GROUP BY a)
SELECT p.page_id, p.host, p.path, {own[0]} AS rule, coalesce({own[1]}, spread.v, 'allow') AS verdict
FROM p LEFT JOIN spread ON spread.a = {_sql_alias("p.url")}
"""
