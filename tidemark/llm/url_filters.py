"""URL rules whose decisions follow redirects and canonical links.

Every url is brought to a normal form (no scheme, default port, fragment, dot segment, tracking
parameter or closing slash). Normal forms are nodes; canonical links and refresh redirects of the
pages are edges, all of a page's that stand outside comments, with the character references of
urls decoded; they are resolved as the URL standard says, and those of other schemes than http
and https name no page. A component with an explicitly allowed url allows, else one with a blocked url blocks,
all urls of it that no rule fits; a url with a rule keeps that rule's decision.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule
and is allowed; of rules of equal length allow wins; repeated urls are judged once and told for
every row; null html has no links; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: So many rules at most are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000
#: Tags that name another url: what they must hold, and where the url stands.
_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
_LINK = (r"(?is)^<link\b.*[\s\"'/]rel\s*=\s*[\"']?canonical\b", r"(?is)[\s\"'/]href\s*=\s*[\"']?([^\"'\s>]+)")
_REFRESH = (r"(?is)^<meta\b.*[\s\"'/]http-equiv\s*=\s*[\"']?refresh\b", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")
#: Comments, up to the end of the page where one is not closed.
_COMMENT = r"(?s)<!--.*?(?:-->|--!>|\z)"
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
#: Character references that urls in attributes hold, by what they name; the ampersand comes last, so that nothing is decoded twice.
_REFERENCES = (("/", "(?i)&(?:sol|#0*47|#x0*2f);"), (":", "(?i)&(?:colon|#0*58|#x0*3a);"), ("?", "(?i)&(?:quest|#0*63|#x0*3f);"), ("=", "(?i)&(?:equals|#0*61|#x0*3d);"), ("&", "(?i)&(?:amp|#0*38|#x0*26);"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """``path`` with its dot segments resolved."""
    plain = lambda x: F.regexp_replace(x, "(?i)%2e", ".")
    above = lambda held: F.when(F.size(held) > 1, F.slice(held, 1, F.size(held) - 1)).otherwise(held)
    step = lambda held, x: F.when(plain(x) == ".", held).when(plain(x) == "..", above(held)).otherwise(F.concat(held, F.array(x)))
    parts = F.split(path, "/")
    walked = F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step), "/")
    return F.when(path.rlike("(?i)/(?:[.]|%2e)"), walked).otherwise(path)


def normal_form(url: Column) -> Column:
    """Host without default port, path without dot segments and closing slash, query without tracking parameters; null without ``://``."""
    host = F.regexp_replace(host_of(url), ":(80|443)\\z", "")
    path = F.regexp_replace(without_dots(path_of(url)), "/+\\z", "")
    asked = F.split(F.regexp_extract(url, "://[^?#]*\\?([^#]*)", 1), "&")
    kept = F.array_join(F.filter(asked, lambda p: (p != "") & ~p.rlike("(?i)^(utm_[a-z]*|gclid|fbclid)(=|\\z)")), "&")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def resolved(url: Column, link: Column) -> Column:
    """``link`` as an absolute url on the page ``url``; null for other schemes than http and https."""
    start = F.regexp_extract(url, "^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, "^(.*?:)//", 1)
    folder = F.regexp_replace(path_of(url), "[^/]*\\z", "")
    return (
        F.when(link.rlike("(?i)^https?://"), link)
        .when(link.rlike(_SCHEME), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(start, link))
        .when(link.startswith("?"), F.concat(start, path_of(url), link))
        .when(link.startswith("#"), url)
        .otherwise(F.concat(start, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def decoded(link: Column) -> Column:
    """``link`` without character references."""
    for char, reference in _REFERENCES:
        link = F.regexp_replace(link, reference, char)
    return link


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """u, v: normal forms of pages and of what their canonical links and refresh redirects name."""
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    tags = F.regexp_extract_all(F.regexp_replace("html", _COMMENT, " "), F.lit(_TAGS), 0)
    told = lambda asked, wanted: F.transform(F.filter("tags", lambda t: t.rlike(asked)), lambda t: F.regexp_extract(t, wanted, 1))
    rows = rows.where(F.lower("html").rlike("canonical|refresh")).select("url", tags.alias("tags"))
    named = F.array_distinct(F.concat(told(*_LINK), told(*_REFRESH)))
    links = rows.select("url", F.explode(named).alias("link")).select("url", decoded(F.col("link")).alias("link")).where("link <> ''")
    return links.select(normal_form(F.col("url")).alias("u"), normal_form(resolved(F.col("url"), F.col("link"))).alias("v")).where("u is not null and v is not null and u <> v")


def ruled(urls: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """``urls`` (url) with host, path, rule and ruled: each host suffix meets the rules of that host by an equal join."""
    table = urls.sparkSession.createDataFrame([(v, h, p, len(h) + len(p)) for v, h, p in rules], "ruled string, r_host string, r_path string, size int")
    table = F.broadcast(table) if len(rules) <= BROADCAST_RULES else table
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = parts.select("url", "path", F.explode(F.array_distinct(suffixes)).alias("r_host")).join(table, "r_host").where(F.startswith("path", F.col("r_path")))
    best = met.groupBy("url").agg(F.max(F.struct("size", (F.col("ruled") == "allow").alias("first"), "r_host", "r_path", "ruled")).alias("b"))
    return parts.join(best, "url", "left").select("url", "host", "path", F.concat("b.r_host", "b.r_path").alias("rule"), F.col("b.ruled").alias("ruled"))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, host, path, rule, verdict and alias_of (the least normal form of the url's component) of every row."""
    urls = pages.select(F.col(url_col).alias("url")).where("url is not null").distinct()
    known = written(ruled(urls, rules).withColumn("node", normal_form(F.col("url"))), "urls")
    roots = components(link_edges(pages, url_col, html_col))
    tied = known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tied = written(tied.select("url", "host", "path", "rule", "ruled", "root"), "tied")
    decided = tied.where("ruled is not null and root is not null").groupBy("root").agg(F.min("ruled").alias("spread"))  # "allow" comes before "block"
    judged = tied.join(decided, "root", "left").select("url", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"), F.col("root").alias("alias_of"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).join(judged, "url", "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(F.col("id").alias(id_col), empty("host"), empty("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "alias_of")


def filter_urls_sql(rules: tuple[tuple[str, str, str], ...] = RULES) -> str:
    """DuckDB SQL over ``pages`` for the rows of ``filter_urls``; components by reachability."""
    host = lambda x: f"translate(coalesce(regexp_extract({x}, '://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}')"
    path = lambda x: f"coalesce(regexp_extract({x}, '://[^/?#]*([^?#]*)', 1), '')"

    plain = "regexp_replace(b[1], '(?i)%2e', '.', 'g')"
    step = f"lambda a, b: CASE WHEN {plain} = '.' THEN a WHEN {plain} = '..' THEN CASE WHEN len(a) > 1 THEN a[1:len(a) - 1] ELSE a END ELSE list_concat(a, b) END"
    undotted = lambda x: f"array_to_string(list_reduce(list_transform(string_split({path(x)}, '/'), lambda q: [q]), {step}), '/')"

    def normal(x: str) -> str:
        kept = f"array_to_string(list_filter(string_split(regexp_extract({x}, '://[^?#]*\\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '(?i)^(utm_[a-z]*|gclid|fbclid)(=|$)')), '&')"
        return f"CASE WHEN contains({x}, '://') THEN regexp_replace({host(x)}, ':(80|443)$', '') || regexp_replace({undotted(x)}, '/+$', '') || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"

    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    told = lambda asked, wanted: f"list_transform(list_filter(tags, lambda t: regexp_matches(t, {quoted(asked)})), lambda t: regexp_extract(t, {quoted(wanted)}, 1))"
    plain_link = "link"
    for char, reference in _REFERENCES:
        plain_link = f"regexp_replace({plain_link}, {quoted(reference)}, '{char}', 'g')"
    start, folder = "regexp_extract(url, '^((?s:.)*?://[^/?#]*)', 1)", f"regexp_replace({path('url')}, '[^/]*$', '')"
    resolved_sql = (
        f"CASE WHEN regexp_matches(link, '(?i)^https?://') THEN link WHEN regexp_matches(link, '{_SCHEME}') THEN NULL WHEN starts_with(link, '//') THEN regexp_extract(url, '^((?s:.)*?:)//', 1) || link"
        f" WHEN starts_with(link, '/') THEN {start} || link WHEN starts_with(link, '?') THEN {start} || {path('url')} || link WHEN starts_with(link, '#') THEN url"
        f" ELSE {start} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || link END"
    )
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""WITH RECURSIVE rules(ruled, h, p) AS (VALUES {values}),
    urls AS (SELECT DISTINCT url, {host('url')} AS host, {path('url')} AS path, {normal('url')} AS node FROM pages WHERE url IS NOT NULL),
    best AS (SELECT url, arg_max(h || p, row(length(h) + length(p), (ruled = 'allow')::INT, h, p)) AS rule, arg_max(ruled, row(length(h) + length(p), (ruled = 'allow')::INT, h, p)) AS ruled
      FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1),
    tagged AS (SELECT url, regexp_extract_all(regexp_replace(html, {quoted(_COMMENT)}, ' ', 'g'), {quoted(_TAGS)}) AS tags FROM pages WHERE url IS NOT NULL),
    links AS (SELECT url, unnest(list_concat({told(*_LINK)}, {told(*_REFRESH)})) AS link FROM tagged),
    named AS (SELECT url, {resolved_sql} AS link FROM (SELECT url, {plain_link} AS link FROM links) WHERE link <> ''),
    pairs AS (SELECT DISTINCT {normal('url')} AS u, {normal('link')} AS v FROM named),
    edges AS (SELECT u, v FROM pairs WHERE u <> v UNION SELECT v, u FROM pairs WHERE u <> v),
    reach AS (SELECT u AS node, u AS seen FROM edges UNION SELECT r.node, e.v FROM reach r JOIN edges e ON r.seen = e.u),
    roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY 1),
    tied AS (SELECT url, host, path, rule, ruled, coalesce(root, node) AS root FROM urls LEFT JOIN best USING (url) LEFT JOIN roots USING (node)),
    decided AS (SELECT root, min(ruled) AS spread FROM tied WHERE ruled IS NOT NULL AND root IS NOT NULL GROUP BY 1)
    SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(ruled, spread, 'allow') AS verdict, root AS alias_of
    FROM pages LEFT JOIN tied USING (url) LEFT JOIN decided USING (root)"""
