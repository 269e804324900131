"""URL filters with redirect equivalence: block decisions spread over redirect and canonical links; allow goes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, written
from .components import components

#: (action, host and path) of the rules that the query applies.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Up to so many rules are one expression; more are joined.
MANY_RULES = 200


def _rest(url: Column) -> Column:
    """What follows the first ://, or empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _plain(p: Column) -> Column:
    """A path without the segments . and .. (RFC 3986, 5.2.4)."""
    kept = F.aggregate(
        F.split(p, "/"), F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))),
    )
    return F.when(p.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), F.when(p.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(p)


def node(url: Column) -> Column:
    """A url without its fragment, which no server sees, and dot segments; scheme and host in lower case. Null without a ://."""
    scheme = ascii_lower(F.substring_index(url, "://", 1))
    query_ = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host(url), let(path(url), _plain), query_))


def resolved(base: Column, ref: Column) -> Column:
    """The url that a reference on a page with the url `base` leads to (RFC 3986, 5.2.2, but for dot segments)."""
    scheme = F.substring_index(base, "://", 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(base), r"^([^/?#]*)", 1))
    folder = F.regexp_extract(path(base), r"(?s)^(.*/)", 1)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme, F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(origin, ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(origin, path(base), ref))
        .when((ref == "") | F.startswith(ref, F.lit("#")), base)
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), ref))
    )


def _matched(pages: DataFrame, rules) -> DataFrame:
    """pages (with host and path) and the longest rule that fits, with its action; null if none does."""
    parts = sorted(((len(r), action, r) for action, r in rules), key=lambda x: (-x[0], x[1] != "allow", x[2]))
    if not parts:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    if len(parts) <= MANY_RULES:
        rule = action = None
        for _, what, r in parts:
            h, slash, p = r.partition("/")
            fits = ((F.col("host") == h.lower()) | F.col("host").endswith("." + h.lower())) & F.col("path").startswith(slash + p)
            rule = F.when(fits, F.lit(r)) if rule is None else rule.when(fits, F.lit(r))
            action = F.when(fits, F.lit(what)) if action is None else action.when(fits, F.lit(what))
        return pages.withColumns({"rule": rule, "action": action})
    table = pages.sparkSession.createDataFrame([(r.partition("/")[0].lower(), r[len(r.partition("/")[0]) :], r, a) for _, a, r in parts], "h string, p string, rule string, action string")
    labels = F.split("host", "\\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = pages.select("host", "path").distinct()
    found = (
        places.withColumn("h", F.explode(ends)).join(table, "h").where(F.startswith("path", "p"))
        .groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), F.col("action") == "allow", "rule")).alias("best"))
    )
    return pages.join(found, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "action": F.col("best.action")}).drop("best")


#: An attribute of a tag: its name, and its value in quotes, which may hold a >, or without.
_ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+"""
#: What holds no tags: comments, and elements whose content is text.
_TEXT = r"(?is)<!--.*?-->|<(script|style|textarea|title|noscript|xmp|iframe)\b[^>]*+>.*?</\1\s*+>"


def _tags(html: Column, name: str) -> Column:
    """The attributes of each tag of that name, as maps of lower-case names to values with &amp; decoded; the first of a
    name counts."""

    def pair(a: Column) -> Column:
        value = F.btrim(F.regexp_extract(a, r"(?s)^[^=]+=\s*+(.*)$", 1))
        value = F.when(value.rlike(r"""^["']"""), F.substring(value, 2, F.length(value) - 2)).otherwise(value)
        return F.struct(ascii_lower(F.regexp_extract(a, r"^[^\s=]+", 0)).alias("k"), F.regexp_replace(F.btrim(value), r"(?i)&(amp|#0*38|#x0*26);", "&").alias("v"))

    bodies = F.regexp_extract_all(html, F.lit(rf"(?i)<{name}(?=[\s/])((?:[\s/]++|{_ATTRIBUTE})*+)>"), F.lit(1))
    return F.transform(bodies, lambda body: F.transform(F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(0)), pair))


def _value(attributes: Column, name: str) -> Column:
    """Of the first attribute of that name; empty without one."""
    return F.coalesce(F.get(F.filter(attributes, lambda a: a["k"] == name), F.lit(0))["v"], F.lit(""))


def _targets(html: Column) -> Column:
    """Canonical urls and refreshes' urls of a page."""
    canonical = F.filter(_tags(html, "link"), lambda t: ascii_lower(_value(t, "rel")).rlike(r"(^|\s)canonical(\s|$)"))
    refresh = F.filter(_tags(html, "meta"), lambda t: ascii_lower(_value(t, "http-equiv")) == "refresh")
    to = lambda t: F.btrim(F.regexp_extract(_value(t, "content"), r"""(?is)^\s*+[0-9.]*+\s*+[;,]?\s*+(?:url\s*+=\s*+)?["']?([^"']+)""", 1))
    return F.filter(F.concat(F.transform(canonical, lambda t: _value(t, "href")), F.transform(refresh, to)), lambda x: x != "")


def links(pages: DataFrame) -> DataFrame:
    """Edges (u, v) from a page to its canonical urls and to where it refreshes, as absolute urls' nodes. Relative ones
    start from the page's <base>, or from its url. Tags in comments, scripts and the like are none."""
    url = F.col("url")
    held = pages.where(F.col("html").rlike(r"(?i)\b(?:canonical|refresh)\b") & node(url).isNotNull()).select("url", F.regexp_replace("html", _TEXT, " ").alias("html"))
    bases = F.filter(F.transform(_tags(F.col("html"), "base"), lambda t: _value(t, "href")), lambda x: x != "")
    return (
        held.select("url", F.get(bases, F.lit(0)).alias("base"), F.explode(_targets(F.col("html"))).alias("to"))
        .select("url", let(F.coalesce(let(resolved(url, F.col("base")), lambda x: F.when(F.instr(x, "://") > 0, x)), url), lambda x: let(resolved(x, F.col("to")), node)).alias("v"))
        .select(node(url).alias("u"), "v")
        .where("u is not null and v is not null and u != v")
    )


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Judges every page. Returns page_id, url, host, path, rule, verdict, component (null if no link touches the url).

    A rule fits its host and the host's subdomains if the path starts with the rule's; the longest wins (allow at a tie).
    Its action is the verdict. A page that no rule fits is blocked if its redirect-equivalent urls hold a blocked one and
    no explicitly allowed one, else allowed; so an explicit allow goes before what spreads. redirects may add edges
    (columns u, v: urls) to those found in html; urls that only occur there count with their own rules.
    Null url or one without ://: empty host and path, no links, allowed. Null html: no links. Repeated rows are judged
    alike. Other columns are left out. No pages give no rows. A very long html is searched whole, in one task.

    The links are found in one scan and written to the shared folder; without any, no join is made. Otherwise only linked
    urls are shuffled for the components, and the result of each component is an aggregate.
    """
    judged = _matched(pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), rules)
    # an empty url gets an empty host
    judged = judged.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("u")).alias("u"), node(F.col("v")).alias("v")))
    edges = written(edges)
    out = ("page_id", "url", "host", "path", "rule")
    if edges.isEmpty():
        return judged.select(*out, F.coalesce("action", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    member = written(components(edges))
    urls = _matched(member.select("node", "component", host(F.col("node")).alias("host"), path(F.col("node")).alias("path")), rules)
    spread = urls.groupBy("component").agg(
        F.when(F.coalesce(F.max(F.col("action") == "block"), F.lit(False)) & ~F.coalesce(F.max(F.col("action") == "allow"), F.lit(False)), "block").otherwise("allow").alias("spread")
    )
    verdicts = member.join(spread, "component")
    return judged.withColumn("node", node(F.col("url"))).join(verdicts, "node", "left").select(*out, F.coalesce("action", "spread", F.lit("allow")).alias("verdict"), "component")


def query(pages: DataFrame) -> DataFrame:
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


#: For pages without redirect or canonical links, as in the given tables; links are tested apart, against brute force.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, '.' || host AS h FROM b)
SELECT page_id, host, path,
  CASE WHEN ends_with(h, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN ends_with(h, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN ends_with(h, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN ends_with(h, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE WHEN ends_with(h, '.example.net') AND starts_with(path, '/en/') THEN 'allow' WHEN ends_with(h, '.example.com') AND starts_with(path, '/de/') THEN 'block'
       WHEN ends_with(h, '.org') AND starts_with(path, '/fr/') THEN 'allow' WHEN ends_with(h, '.net') AND starts_with(path, '/') THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
