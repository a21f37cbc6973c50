"""URL filters with redirect equivalence: block and allow rules by host and path, and their decisions carried over to aliases.

Two urls are aliases if redirects or canonical links join them, over any number of steps.  Edges come from a page's html (rel=canonical, a refresh), from
urls that carry their target in a parameter, and from the normal form of a url itself: scheme, default port, fragment, tracking parameters,
escapes of plain characters, dot segments and repeated or last slashes don't tell pages apart.  Normal forms are the nodes of the graph, so that the many
spellings of one url are one node before components are sought.  All steps are DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .simhash import components

#: (verdict, host, path prefix).  Fixed values of the op13 contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Parameters that name a redirect's target, and those that only track.
TARGETS = "url|u|to|target|dest|destination|redirect|redirect_uri|redirect_url|goto|next|continue"
TRACKING = r"utm_\w+|gclid|fbclid|msclkid"
_CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?\s*canonical\b[^>]*>"
_REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b[^>]*>"
_HREF = r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_TO = r"(?i)\burl\s*=\s*[\"']?([^\"'>\s]+)"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^" + pattern, 1), F.lit(""))


def host_of(url: Column) -> Column:
    """What stands behind the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    return F.translate(_part(url, r".*?://([^/?#]*)"), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return _part(url, r".*?://[^/?#]*([^?#]*)")


def query_of(url: Column) -> Column:
    return _part(url, r".*?://[^/?#]*[^?#]*\?([^#]*)")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its host and path as one text) and its verdict, or nulls.  A few rules are a chain of conditions."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda value: F.coalesce(*(F.when(fits(r[1], r[2]), F.lit(value(r))) for r in longest), F.lit(None).cast("string"))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def normal_form(url: Column) -> Column:
    """host/path?query of a url, equal for urls that differ in spelling only; null without ://.  A path keeps its case, its parameters and their order."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^[^@]*@", ""), r"\.?(?::(?:80|443)?)?$", "")
    path = path_of(url)
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    plain = F.when(path.contains("%") & ~F.coalesce(decoded.rlike(r"[%?#\x00-\x20]"), F.lit(True)), decoded).otherwise(path)
    plain = F.regexp_replace(F.regexp_replace(plain, r"/(?:\.?/)+", "/"), r"/\.$", "/")
    for _ in range(4):  # deeper ones stay as they are
        plain = F.regexp_replace(plain, r"/(?!\.\./)[^/]+/\.\.(?=/|$)", "")
    plain = F.regexp_replace(plain, r"/+$", "")
    kept = F.filter(F.split(query_of(url), "&"), lambda p: (p != "") & ~p.rlike(rf"^(?:{TRACKING})(?:=|$)"))
    query = F.array_join(kept, "&")
    return F.when(url.contains("://"), F.concat(host, plain, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def absolute(link: Column, base: Column) -> Column:
    """A link as a page at `base` means it."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme, root = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.concat(F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    known = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(root, link))
    return F.when(base.contains("://") & (link != "") & ~link.rlike(r"^(?:#|[A-Za-z][A-Za-z0-9+.-]*:(?!//))"), known.otherwise(F.concat(root, folder, link)))


def links_of(url: Column, html: Column) -> Column:
    """The urls that a page names as its canonical form or sends its readers to: an array without nulls."""
    has = lambda word, out: F.when(F.lower(html).contains(word), out).otherwise(F.array().cast("array<string>"))
    tags = lambda pattern: F.regexp_extract_all(html, F.lit(f"({pattern})"), F.lit(1))
    href = lambda t: F.coalesce(*(F.nullif(F.regexp_extract(t, _HREF, i), F.lit("")) for i in (1, 2, 3)))
    named = has("canonical", F.transform(tags(_CANONICAL), href))
    sent = has("refresh", F.transform(tags(_REFRESH), lambda t: F.nullif(F.regexp_extract(t, _TO, 1), F.lit(""))))
    carried = F.transform(F.regexp_extract_all(query_of(url), F.lit(rf"(?i)(?:^|&)(?:{TARGETS})=(https?(?::|%3A)[^&]*)"), F.lit(1)), F.try_url_decode)
    every = F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in (named, sent, carried)))
    return F.filter(F.transform(every, lambda x: absolute(x, url)), lambda x: x.isNotNull())


def _decision(allow: Column, block: Column) -> Column:
    """An explicit allow goes before any block."""
    return F.when(F.max(allow.cast("int")) == 1, F.lit("allow")).when(F.max(block.cast("int")) == 1, F.lit("block"))


def url_filters(df: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """One row per row of df (page_id, url, html): page_id, host, path, rule, verdict, and source (rule, alias or default).

    Host and path are empty for a url that is null or has no ://.  The longest rule that fits decides; a rule fits its host and all subdomains, if the
    path starts with its path.  A page without a rule takes the decision of its component: allow if a rule allows any url in it, else block
    if a rule blocks one, else `default`.  Urls that pages only name count as members with rules of their own.
    A null html has no links.  Equal rows each get a row; an empty table gives an empty one; other columns are ignored.
    """
    C.prepare(df.sparkSession)
    html = F.col("html").cast("string") if "html" in df.columns else F.lit(None).cast("string")
    pages = df.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    node = lambda c: F.md5(normal_form(c))
    pages = pages.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("own"), node(F.col("url")).alias("node"), links_of(F.col("url"), F.col("html")).alias("links"))
    pages = pages.drop("url").checkpoint()  # small beside the html, and read three times
    linked = pages.select("node", F.explode(F.array_distinct("links")).alias("link"))
    edges = linked.select(F.col("node").alias("u"), node(F.col("link")).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    named_rule = rule_of(host_of(F.col("link")), path_of(F.col("link")), rules)[1]
    told = pages.select("node", "own").unionByName(linked.select(node(F.col("link")).alias("node"), named_rule.alias("own"))).where("node IS NOT NULL AND own IS NOT NULL")
    nodes = told.groupBy("node").agg((F.max(F.when(F.col("own") == "allow", 1).otherwise(0)) == 1).alias("allow"), (F.max(F.when(F.col("own") == "block", 1).otherwise(0)) == 1).alias("block"))
    member = components(edges)  # without the least node of each component
    classes = nodes.join(member, "node", "left").groupBy(F.coalesce("least", "node").alias("class")).agg(_decision(F.col("allow"), F.col("block")).alias("alias"))
    known = classes.withColumnRenamed("class", "node").unionByName(member.join(classes, member["least"] == classes["class"]).select("node", "alias"))
    known = known.select(C.dealt_anew("node"), "alias")  # many pages may have one url
    open_pages = pages.where("own IS NULL AND node IS NOT NULL").join(known, "node", "left")
    closed = pages.where("own IS NOT NULL OR node IS NULL").withColumn("alias", F.lit(None).cast("string"))
    out = open_pages.select(*closed.columns).unionByName(closed)
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("own", "alias", F.lit(default)).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default").alias("source"),
    )


def keep_allowed(df: DataFrame, rules=RULES) -> DataFrame:
    """The rows of df (with its columns) whose url isn't blocked.  A null url stays."""
    blocked = url_filters(df.select(F.col("url").alias("page_id"), "url", *(["html"] if "html" in df.columns else [])), rules).where("verdict = 'block'").select(F.col("page_id").alias("url")).distinct().select(C.dealt_anew("url"))
    return df.join(blocked, "url", "left_anti").select(*df.columns)
