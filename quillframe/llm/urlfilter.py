"""Block and allow rules for URLs, carried over redirects and canonical links.

Pages that redirect to one another, or name one another as canonical, are one
resource under several addresses. The links are edges, their connected
components are classes, and what a rule says of one address holds for all of its
class that no rule names: an allowed address lets a class through, whatever else is in it;
else a blocked one blocks it. All of it is DataFrame expressions and joins.

Addresses are compared without scheme and fragment, hosts in lower case. A page
links by its first ``<link rel=canonical>`` and its first ``<meta http-equiv=refresh>``,
outside comments, scripts, styles and the like; a table of redirects may add to them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, keep


@dataclass(frozen=True)
class Rule:
    """A verdict (allow or block) for addresses on a host or its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query. Fixed values.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Each alternative takes what it opens to its end or to the end of the text, so the whole is linear.
_HIDDEN = "".join(rf"|<{t}\b(?:.*?</{t}|.*)" for t in ("script", "style", "title", "textarea", "template", "noscript"))
_TAGS = rf"(?is)(<!--(?:.*?-->|.*){_HIDDEN}|<(?:link|meta)\b[^>]*+)"


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(F.coalesce(url, F.lit(""))), "^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(F.coalesce(url, F.lit(""))), "^[^/?#]*([^?#]*)", 1)


def _ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name, r.verdict))
    fits = lambda r: ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
    return F.coalesce(*(F.when(fits(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered), F.lit(None).cast("struct<rule:string,verdict:string>"))


def address(url: Column) -> Column:
    """What tells addresses apart: host, path (``/`` if empty) and query; null where there is no host."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(_after(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))"""
    return F.replace(F.trim(F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))), F.lit("&amp;"), F.lit("&"))


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def _undotted(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    none = F.expr("cast(array() as array<string>)")
    parts = F.split(path, "/", -1)
    join = lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(p == ".", done).otherwise(F.concat(done, F.array(p)))
    ends = F.when(path.rlike(r"/\.{1,2}\z"), "/").otherwise("")
    return F.when(path.rlike(r"/\.{1,2}(?:/|\z)"), F.concat(F.array_join(F.aggregate(parts, none, join), "/"), ends)).otherwise(path)


def resolved(href: Column, url: Column) -> Column:
    """The address that a link on a page leads to; null for empty ones, fragments and other schemes than http and https."""
    bare = F.regexp_extract(href, "^([^#]*)", 1)
    host, path = host_of(url), path_of(url)
    path = F.when(path == "", "/").otherwise(path)
    own, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"^[^?]*(\?.*)", 1)
    absolute = bare.rlike("(?i)^https?://")
    return (
        F.when(bare == "", F.lit(None))
        .when(absolute, address(bare))
        .when(bare.startswith("//"), address(F.concat(F.lit("http:"), bare)))
        .when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(host == "", F.lit(None))
        .when(bare.startswith("/"), F.concat(host, _undotted(own), query))
        .when(own == "", F.concat(host, path, query))
        .otherwise(F.concat(host, _undotted(F.concat(_folder(path), own)), query))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target): addresses of pages, and of what they name as canonical or refresh to."""
    # both words stand in any tag that counts, and few pages have them
    some = pages.where(F.col(f"`{html}`").rlike("(?i)canonical|refresh")).select(F.col(f"`{url}`").alias("url"), F.regexp_extract_all(F.col(f"`{html}`"), F.lit(_TAGS), F.lit(1)).alias("tags"))
    first = lambda test: F.get(F.filter("tags", test), 0)
    link = first(lambda t: t.rlike(r"(?i)^<link\b") & F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    meta = first(lambda t: t.rlike(r"(?i)^<meta\b") & (F.lower(_attribute(t, "http-equiv")) == "refresh"))
    to = F.trim(F.regexp_replace(F.regexp_extract(_attribute(F.col("meta"), "content"), r"(?is)^[\s0-9.]*[;,]?\s*url\s*=\s*(.*)", 1), "[\"']", ""))
    both = some.select("url", link.alias("link"), meta.alias("meta")).select("url", F.explode(F.array(_attribute(F.col("link"), "href"), to)).alias("href"))
    return both.select(address(F.col("url")).alias("source"), resolved(F.col("href"), F.col("url")).alias("target"))


def _number(node: str) -> Column:
    return F.sha2(F.col(node), 256)


def class_verdicts(links: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(node, class_verdict): the hash of each address of a class that some rule speaks on, and what the rules come to for the class."""
    edges = keep(links.where("source <> target").distinct(), "links")
    numbered = edges.select(_number("source").alias("a"), _number("target").alias("b"))
    nodes = edges.select(F.col("source").alias("address")).union(edges.select("target")).distinct()
    host, path = F.substring_index("address", "/", 1), F.regexp_extract("address", r"^[^/]*([^?]*)", 1)
    ruled = nodes.select(_number("address").alias("node"), _ruled(host, path, rules)["verdict"].alias("own"))
    member = ruled.join(components(numbered), "node")
    each = member.groupBy("comp").agg(F.bool_or(F.col("own") == "allow").alias("allow"), F.bool_or(F.col("own") == "block").alias("block"))
    told = each.select("comp", F.when(F.col("allow"), "allow").when(F.col("block"), "block").alias("class_verdict")).where("class_verdict is not null")
    return member.join(told, "comp").select("node", "class_verdict")


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule and verdict.

    ``redirects`` holds absolute URLs (source, target). A rule that fits a page decides it; else its class does, where an
    allowed address goes before a blocked one; else, and for null URLs and those without ``://``, it is allowed.
    Rows that repeat are judged alike. Null pages of HTML have no links. Empty tables stay empty; other columns are not read.
    """
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.union(redirects.select(address(F.col("source")), address(F.col("target"))))
    own = F.col(f"`{url}`")
    rows = pages.select(F.col(f"`{id_col}`").alias(id_col), own.alias("_url"), host_of(own).alias("host"), path_of(own).alias("path"))
    found = _ruled(F.col("host"), F.col("path"), rules)
    at = address(F.col("_url"))
    alone = _ruled(F.col("host"), F.when(F.col("path") == "", "/").otherwise(F.col("path")), rules)["verdict"]
    rows = rows.select(id_col, "host", "path", found.alias("found"), F.when(at.isNotNull(), alone).alias("alone"), F.sha2(at, 256).alias("node"))
    whole = rows.join(class_verdicts(links, rules), "node", "left")
    return whole.select(id_col, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "class_verdict", "alone", F.lit("allow")).alias("verdict"))
