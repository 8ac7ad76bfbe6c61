"""URL filter: block decisions spread over redirect and canonical-link equivalence.

A node is a url in normal form: host in lower case, path and query as they are, without scheme and
fragment, and without slashes at the end of the path.  Edges tie it to the canonical link of its page and to
the target of a refresh redirect.  Connected components over these edges are the aliases of one
page.  Link targets are aliases whether they are rows of the table or not, and may be relative to the
scheme, the host or the path of their page.  The longest rule that fits a url decides it; other urls
are blocked if an alias is blocked by a rule and no alias is allowed by one (an explicit allow wins).

Defined results: a null url, or one without `://`, has empty host and path, fits no
rule, has no alias and is allowed.  Null html has no links.  Repeated pages are judged one by one
and get equal verdicts.  Columns besides page_id, url and html play no part.  An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import table
from flowloom.llm.components import components
from flowloom.operators.skew import lookup_join
from flowloom.session import cut_lineage

# Rules as (verdict, host, path); an empty path fits every path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Patterns of the links in a page.
CANONICAL_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
LINK_TARGET = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
REFRESH_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """`?` and what follows it up to `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def normal_form(url: Column) -> Column:
    """Host, path without slashes at its end, and query; null without a host."""
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(host_of(url) != "", F.concat(host_of(url), path, query_of(url)))


def with_rule(df: DataFrame, host: str, path: str, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds `rule` (host and path of the longest fitting rule) and `by_rule` (its verdict)."""
    # Longest first; of equal length an allow comes first.
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1], r[2]))
    rule = verdict = F.lit(None).cast("string")
    for name, h, p in reversed(ordered):
        fits = ((F.col(host) == h) | F.col(host).endswith(f".{h}")) & F.col(path).startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(name)).otherwise(verdict)
    return df.withColumns({"rule": rule, "by_rule": verdict})


def resolve(link: Column, url: Column) -> Column:
    """`link` in the page `url` without its fragment as RFC 3986 resolves it; null if it leads to no page."""
    own_scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    scheme = F.when(own_scheme.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*$"), own_scheme).otherwise(F.lit("http"))
    origin = F.concat(scheme, F.lit("://"), host_of(url))
    bare, asked = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(\?[^#]*)", 1)
    # Up to the last slash of the page's path.
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"(?s)^/?(.*/)?[^/]*$", 1))
    path = F.when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))
    parts = F.split(path, "/")
    # Dot segments: "." is dropped, ".." drops the segment before; the first part is what is before the first slash.
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    # A dot segment at the end leaves a folder.
    end = F.when(path.rlike(r"(^|/)\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    tidy = F.concat(F.lit("/"), F.array_join(kept, "/"), end)
    return (
        F.when(link.rlike(r"^[^/?#]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        # Other schemes (mailto:, javascript:) are no pages.
        .when((link == "") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        # A query alone replaces the page's; a fragment alone leads to the page itself.
        .when(bare == "", F.concat(origin, path_of(url), F.when(asked != "", asked).otherwise(query_of(url))))
        .otherwise(F.concat(origin, tidy, asked))
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """(own, host, path, form): a url's normal form, and host, path and normal form of an equivalent one, for
    urls with a host."""
    canonical = F.regexp_extract(F.regexp_extract("html", CANONICAL_TAG, 0), LINK_TARGET, 1)
    refresh = F.regexp_extract(F.regexp_extract("html", REFRESH_TAG, 0), REFRESH_TARGET, 1)
    targets = F.array_distinct(F.filter(F.array(canonical, refresh), lambda link: link != ""))
    linked = pages.where(host_of(F.col("url")) != "").select("url", F.explode(targets).alias("link"))
    linked = linked.select(normal_form(F.col("url")).alias("own"), resolve(F.col("link"), F.col("url")).alias("to"))
    ends = linked.select("own", host_of(F.col("to")).alias("host"), path_of(F.col("to")).alias("path"), normal_form(F.col("to")).alias("form"))
    return ends.where(F.col("form").isNotNull()).distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_group) of every page.

    Urls of one normal form are one node from the start, so edges are only the links between normal forms.
    A link's target is ruled like a page, so it counts for its group without being one.
    """
    known = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64(normal_form(F.col("url"))).alias("form"))
    ruled = with_rule(known, "host", "path", rules).withColumn("form", F.when(F.col("host") != "", F.col("form")))
    links = cut_lineage(alias_links(pages))
    edges = links.select(F.xxhash64("own").alias("a"), F.xxhash64("form").alias("b")).where("a <> b").distinct()
    roots = components(edges, "a", "b")
    # One row per normal form: how its urls were ruled.  Aggregated before the shuffle.
    blocked = F.max(F.when(F.col("by_rule") == "block", 1).otherwise(0))
    allowed = F.max(F.when(F.col("by_rule") == "allow", 1).otherwise(0))
    targets = with_rule(links.select("host", "path", F.xxhash64("form").alias("form")), "host", "path", rules)
    nodes = ruled.where(F.col("form").isNotNull()).select("form", "by_rule").union(targets.select("form", "by_rule"))
    forms = nodes.groupBy("form").agg(blocked.alias("blocked"), allowed.alias("allowed"))
    forms = forms.join(roots, F.col("form") == F.col("node"), "left").select("form", "blocked", "allowed", F.coalesce("root", "form").alias("group"))
    forms = cut_lineage(forms)
    groups = forms.groupBy("group").agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed"))
    spread = groups.where("blocked = 1 AND allowed = 0").select("group", F.lit("block").alias("by_alias"))
    verdicts = lookup_join(forms, spread, ["group"], ["form"]).select("form", "group", "by_alias")
    # A url may be that of a large part of all pages, or they may have none.
    named = lookup_join(ruled.where(F.col("form").isNotNull()), verdicts, ["form"], ["page_id", "url"])
    nameless = ruled.where(F.col("form").isNull()).withColumns({"group": F.lit(None).cast("long"), "by_alias": F.lit(None).cast("string")})
    return named.unionByName(nameless).select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", "by_alias", F.lit("allow")).alias("verdict"), F.col("group").alias("alias_group")
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _sql_rule(host: str, path: str) -> str:
    return f"""CASE WHEN ({host} = 'www.example.com' OR {host} LIKE '%.www.example.com') AND starts_with({path}, '/en/') THEN 'www.example.com/en/'
         WHEN ({host} = 'example.com' OR {host} LIKE '%.example.com') AND starts_with({path}, '/en/') THEN 'example.com/en/'
         WHEN ({host} = 'net' OR {host} LIKE '%.net') AND starts_with({path}, '/es/') THEN 'net/es/'
         WHEN ({host} = 'net' OR {host} LIKE '%.net') AND starts_with({path}, '/fr/') THEN 'net/fr/'
         WHEN ({host} = 'com' OR {host} LIKE '%.com') AND starts_with({path}, '/') THEN 'com/' END"""


def _sql_parts(url: str) -> str:
    """Host, path and query of a url."""
    return f"""CASE WHEN contains({url}, '://') THEN translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
    CASE WHEN contains({url}, '://') THEN regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN contains({url}, '://') THEN regexp_extract({url}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1) ELSE '' END AS query"""


_SQL_FORM = "CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') || query END"
_SQL_BY_RULE = "CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END"

# The recursive part walks the links.
ORACLE = f"""
WITH RECURSIVE base AS (SELECT page_id, url, html, {_sql_parts('url')} FROM pages),
judged AS (SELECT *, {_SQL_FORM} AS form, {_sql_rule('host', 'path')} AS rule FROM base),
links AS (
  SELECT DISTINCT form AS own, path, query, link,
    CASE WHEN regexp_matches(regexp_extract(url, '(?s)^(.*?)://', 1), '^[A-Za-z][A-Za-z0-9+.-]*$') THEN regexp_extract(url, '(?s)^(.*?)://', 1) ELSE 'http' END AS scheme, host,
    regexp_extract(link, '(?s)^([^?#]*)', 1) AS bare, regexp_extract(link, '(?s)^[^?#]*(\\?[^#]*)', 1) AS asked
  FROM (SELECT *, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0), '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)]) AS link
    FROM judged WHERE form IS NOT NULL) WHERE link <> ''),
joined AS (SELECT *, CASE WHEN starts_with(bare, '/') THEN bare ELSE '/' || regexp_extract(path, '(?s)^/?(.*/)?[^/]*$', 1) || bare END AS whole FROM links),
walked AS (
  SELECT *, list_reduce(list_concat([[]::VARCHAR[]], list_transform(string_split(whole, '/')[2:], lambda x: [x])),
    lambda done, x: CASE WHEN x[1] = '.' THEN done WHEN x[1] = '..' THEN done[1:len(done) - 1] ELSE list_concat(done, x) END) AS kept FROM joined),
resolved AS (
  SELECT own, CASE WHEN regexp_matches(link, '^[^/?#]*://') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN bare = '' THEN scheme || '://' || host || path || CASE WHEN asked <> '' THEN asked ELSE query END
    ELSE scheme || '://' || host || '/' || array_to_string(kept, '/')
      || CASE WHEN regexp_matches(whole, '(^|/)\\.\\.?$') AND len(kept) > 0 THEN '/' ELSE '' END || asked END AS url FROM walked),
targets AS (SELECT own, {_SQL_FORM} AS form, {_sql_rule('host', 'path')} AS rule FROM (SELECT own, {_sql_parts('url')} FROM resolved WHERE url IS NOT NULL)),
nodes AS (
  SELECT form, {_SQL_BY_RULE} AS by_rule FROM judged WHERE form IS NOT NULL
  UNION SELECT form, {_SQL_BY_RULE} FROM targets WHERE form IS NOT NULL),
both_ways AS (SELECT own AS a, form AS b FROM targets WHERE form IS NOT NULL UNION SELECT form, own FROM targets WHERE form IS NOT NULL),
reach AS (
  SELECT DISTINCT form AS node, form AS seen FROM nodes
  UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.seen = both_ways.a),
spread AS (
  SELECT reach.node, coalesce(bool_or(n.by_rule = 'block'), FALSE) AND NOT coalesce(bool_or(n.by_rule = 'allow'), FALSE) AS blocked
  FROM reach JOIN nodes n ON n.form = reach.seen GROUP BY reach.node)
SELECT page_id, host, path, rule, coalesce({_SQL_BY_RULE}, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN spread ON spread.node = judged.form
"""
