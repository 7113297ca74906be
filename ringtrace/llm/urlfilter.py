"""URL filter rules with redirect equivalence; DataFrame functions only.

A page's own address, its canonical link and its meta refresh target name the same content, and
so do both ends of a redirect in an optional log.  Connected components over those edges give
the alias groups.  The longest rule that fits a url decides it; a url without a rule is blocked if an
alias is blocked by a rule.  An explicit allow always wins for its own url, and it never lets
an alias through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut, fresh

#: (action, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null.  Equal lengths: allow first."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1]))
    fits = [((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2]) for r in order]
    made = [F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict")) for r in order]
    return reduce(lambda out, k: out.when(fits[k], made[k]), range(1, len(order)), F.when(fits[0], made[0]))


def node_of(url: Column) -> Column:
    """A url as a graph node: http and https alike, host in lower case, no fragment; null if no host."""
    host = host_of(url)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def absolute(target: Column, base: Column) -> Column:
    """A link target on a page resolved against the page's url."""
    target = F.regexp_replace(F.trim(target), "&amp;", "&")
    scheme, host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), host_of(base)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)[^/]*$", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(scheme, F.lit("://"), host, target))
        .when(
            target != "",
            F.concat(scheme, F.lit("://"), host, F.when(folder == "", F.lit("/")).otherwise(folder), target),
        )
    )


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    return F.regexp_replace(F.regexp_replace(quoted, r"(?is)^[a-z-]+\s*=\s*", ""), r"""^["']|["']$""", "")


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): alias edges between nodes, from canonical links and meta refreshes of the html."""
    html, url = F.col(html_col), F.col(url_col)
    link = F.when(
        html.rlike("(?i)canonical"),
        F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?\s*canonical\b)[^>]*>""", 0),
    )
    meta = F.when(
        html.rlike("(?i)http-equiv"),
        F.regexp_extract(html, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b)[^>]*>""", 0),
    )
    refresh = F.regexp_extract(_attribute(meta, "content"), r"""(?is)\burl\s*=\s*["']?([^"'>\s]+)""", 1)
    found = F.filter(F.array(_attribute(link, "href"), refresh), lambda t: t.isNotNull() & (t != ""))
    each = pages.select(url.alias("u"), F.explode(found).alias("t"))
    return each.select(node_of(F.col("u")).alias("a"), node_of(absolute(F.col("t"), F.col("u"))).alias("b"))


def judge(
    pages: DataFrame,
    redirects: DataFrame | None = None,
    rules=RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, via), one row for each row of ``pages``.

    ``redirects`` is an optional log (from_url, to_url).  ``via`` is the smallest node of the alias group
    whose block reached the page, else null.  Null urls and urls without ``://`` have empty
    host and path, fit no rule and are allowed.
    """
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))))
    # written before it is looked at: the html is scanned once
    edges = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b"), "alias-edges")
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    judged = pages.select(F.col(id_col).alias("page_id"), url.alias("__url"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("__r", rule_for(F.col("host"), F.col("path"), rules))
    cols = ["page_id", "host", "path", F.col("__r.rule").alias("rule")]
    if edges.isEmpty():
        return judged.select(
            *cols, F.coalesce("__r.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("via")
        )
    groups = cut(connected_components(edges), "alias-groups")
    # a rule needs the address only, so the nodes that no page has are judged as well
    where = F.concat(F.lit("x://"), F.col("node"))
    hit = rule_for(host_of(where), path_of(where), rules)
    blocked = groups.where(hit["verdict"] == "block").select("root").distinct()
    aliases = groups.join(blocked, "root").select(F.col("node").alias("__node"), F.col("root").alias("via"))
    open_ = F.when(F.col("__r").isNull(), node_of(F.col("__url")))
    out = judged.join(aliases, open_ == F.col("__node"), "left")
    verdict = F.coalesce(F.col("__r.verdict"), F.when(F.col("via").isNotNull(), "block"), F.lit("allow"))
    return out.select(*cols, verdict.alias("verdict"), "via")


def drop_blocked(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without the rows judged ``block``, all columns unchanged.

    The verdict belongs to the url, whatever the id: rows of one url go or stay together, null urls stay.
    """
    own = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    urls = judge(own.withColumn("page_id", F.col("url")), redirects, rules).where("verdict = 'block'").select("page_id").distinct()
    gone, = fresh(pages.columns, "gone")
    return pages.join(urls.withColumnRenamed("page_id", gone), pages[url_col] == F.col(gone), "left_anti")


def _case(column: int) -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0], r[1]))
    arms = [
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, a)[column]}'"
        for a, h, p in order
    ]
    return "CASE " + " ".join(arms) + " END"


def _host(url: str) -> str:
    return f"coalesce(translate(regexp_extract({url}, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"


def _node(url: str) -> str:
    rest = f"regexp_extract({url}, '^(?s:.*?)://[^/?#]*([^#]*)', 1)"
    return f"CASE WHEN {_host(url)} <> '' THEN {_host(url)} || CASE WHEN starts_with({rest}, '/') THEN {rest} ELSE '/' || {rest} END END"


def _value(tag: str, name: str) -> str:
    quoted = f"""regexp_extract({tag}, '(?is)\\b{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1)"""
    return f"""regexp_replace({quoted}, '^["'']|["'']$', '', 'g')"""


def _tag(tag: str, mark: str) -> str:
    return f"list_filter(regexp_extract_all(html, '(?is)<{tag}\\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\\b{mark}\\b'))[1]"


#: Alias edges from the html, their components by recursion, and the verdicts.
ORACLE = f"""
WITH RECURSIVE tags AS (SELECT url, {_tag("link", "rel[ ]*=[ ]*[''" + '"' + "]?[ ]*canonical")} AS link,
    {_tag("meta", "http-equiv[ ]*=[ ]*[''" + '"' + "]?[ ]*refresh")} AS meta FROM pages),
aims AS (SELECT url, trim(replace(unnest([{_value("link", "href")},
    regexp_extract({_value("meta", "content")}, '(?is)\\burl\\s*=\\s*["'']?([^"''>\\s]+)', 1)]), '&amp;', '&'), ' ') AS t FROM tags),
base AS (SELECT url, t, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, {_host("url")} AS host,
    regexp_extract({_path("url")}, '^((?s:.*)/)[^/]*$', 1) AS folder FROM aims WHERE t <> ''),
full_ AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t
    WHEN starts_with(t, '/') THEN scheme || '://' || host || t
    ELSE scheme || '://' || host || CASE WHEN folder = '' THEN '/' ELSE folder END || t END AS t FROM base),
ends AS (SELECT {_node("url")} AS a, {_node("t")} AS b FROM full_),
edges AS (SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b),
reach AS (SELECT a AS node, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
groups AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
hit AS (SELECT root, {_host("'x://' || node")} AS host, {_path("'x://' || node")} AS path FROM groups),
blocked AS (SELECT DISTINCT root FROM hit WHERE {_case(1)} = 'block'),
alias AS (SELECT node, root FROM groups WHERE root IN (SELECT root FROM blocked)),
u AS (SELECT page_id, url, {_host("url")} AS host, {_path("url")} AS path FROM pages),
j AS (SELECT *, {_case(0)} AS rule, {_case(1)} AS own FROM u)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN root IS NOT NULL THEN 'block' END, 'allow') AS verdict, root AS via
FROM j LEFT JOIN alias ON j.own IS NULL AND {_node("url")} = alias.node
"""
