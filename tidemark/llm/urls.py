"""URL rules with redirect equivalence: block decisions spread to all addresses of the same page."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import unescape

from .common import components, cut


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains if the path starts with `path`."""

    host: str
    path: str
    block: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (Rule("net", "/", True), Rule("example.net", "/en/", False), Rule("example.com", "/de/", True), Rule("org", "/fr/", False))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if url is NULL or has no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def node(url: Column) -> Column:
    """The address as a node of the graph: without scheme and fragment, host lower-cased."""
    rest = F.regexp_extract(url, r"^[^:/?#]*://([^#]*)", 1)
    host = F.regexp_extract(rest, r"^([^/?]*)", 1)
    whole = F.concat(F.translate(host, _UPPER, _LOWER), F.substring(rest, F.length(host) + 1, F.length(rest)))
    return F.when(F.length(host) > 0, whole)


def judge(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(name, block) of the longest rule that fits, NULL if none does. Longest: host and path together;
    at a tie allow comes first, then the name."""
    order = sorted(rules, key=lambda r: (-len(r.name), r.block, r.name))
    name, block = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in reversed(order):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, block = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.block)).otherwise(block)
    return name, block


#: What is no markup of the page, the elements that name addresses, and their attributes: a name, and a value
#: that may be quoted. Each pattern stops at the next "<" outside of quotes, so time grows with the page.
NO_MARKUP = r"""(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript)(?=[\s/>])[^<>]*+>.*?(?:</\1(?=[\s/>])|\z)"""
ELEMENT = r"""(?is)<(?:link|meta|base)(?=[\s/>])(?:[^<>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+>"""
ATTRIBUTE = r"""(?s)[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?"""


def _attributes(tag: Column) -> Column:
    """The attributes of a tag in order as (name, value); the first is the element's name."""
    value = lambda a: F.regexp_replace(F.regexp_extract(a, r"(?s)^[^=]*+=\s*+(.*)$", 1), r"""(?s)^(["'])(.*)\1$""", "$2")
    return F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.struct(F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1)).alias("name"), value(a).alias("value")))


def _said(attributes: Column, name: str) -> Column:
    """Value of the first attribute of that name, without blanks around it; NULL if there is none."""
    return F.btrim(F.get(F.filter(attributes, lambda a: a["name"] == name), F.lit(0))["value"], F.lit(" \t\n\r\f"))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) between a page's address and those that it names as its canonical address or
    sends the reader on to; of each kind the first counts. Comments, scripts and styles are no markup; a rel
    attribute may list several names; character references in addresses are decoded; relative addresses are
    taken from the base element, if it has an absolute one or a path, else from the page's."""
    page = F.col(f"`{html}`")
    found = pages.where(page.rlike("(?i)canonical|refresh")).select(F.col(f"`{url}`").alias("u"), F.regexp_extract_all(F.regexp_replace(page, NO_MARKUP, " "), F.lit(ELEMENT), F.lit(0)).alias("tags"))
    found = found.select("u", F.transform("tags", _attributes).alias("tags"))
    canonical = lambda t: F.array_contains(F.split(F.lower(F.coalesce(_said(t, "rel"), F.lit(""))), r"\s+"), "canonical")
    refresh = lambda t: F.lower(F.coalesce(_said(t, "http-equiv"), F.lit(""))) == "refresh"
    first = lambda name, fits, attribute: _said(F.get(F.filter("tags", lambda t: (t[0]["name"] == name) & fits(t) & _said(t, attribute).isNotNull()), F.lit(0)), attribute)
    target = F.regexp_extract(first("meta", refresh, "content"), r"""(?is)(?:^|[\s;,])url\s*+=\s*+["']?([^"'\s>]+)""", 1)
    found = found.select("u", first("base", lambda _: F.lit(True), "href").alias("base"), F.explode(F.array(first("link", canonical, "href"), target)).alias("v")).where("v <> ''")
    plain = lambda x: F.when(F.col(x).contains("&"), unescape(x)).otherwise(F.col(x))
    found = found.select("u", F.coalesce(plain("base"), F.lit("")).alias("base"), plain("v").alias("v"))
    origin = lambda x: F.regexp_extract(x, r"^([^:/?#]*://[^/?#]*)", 1)
    v, u, base = F.col("v"), F.col("u"), F.col("base")
    start = F.when(base.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), base).when(base.startswith("/") & ~base.startswith("//"), F.concat(origin(u), base)).otherwise(u)
    whole = F.when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), v).when(v.startswith("//"), F.concat(F.lit("http:"), v)).when(v.startswith("/"), F.concat(origin(start), v)).otherwise(F.concat(F.regexp_extract(start, r"^([^?#]*/)", 1), v))
    return found.select(node(u).alias("a"), node(whole).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: Sequence[Rule] = RULES, url: str = "url", html: str | None = "html", key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, via (rule or alias or none) for each row of pages.

    A page that a rule fits has that rule's verdict. Any other has the verdict of its aliases: addresses
    joined to its own by canonical links of pages and by redirects (two columns of addresses), at any
    distance. If a rule allows one of them it is allowed, else if one is blocked it is blocked; with no
    rule among them it is allowed. Addresses count without scheme and fragment. A NULL url and one
    without :// has no alias and is allowed; a NULL or empty page names nothing; very long ones are searched whole,
    in time that grows with them. Repeated rows are judged each for itself; at a tie of rules allow goes first.
    Other columns are not read, whatever their names; an empty table gives an empty result."""
    host, path = host_path(F.col("u"))
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("u")).select("page_id", node(F.col("u")).alias("node"), host.alias("host"), path.alias("path"))
    name, block = judge(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), block.alias("block"))

    edges = []
    if html is not None:
        edges.append(page_links(pages, url, html))
    if redirects is not None:
        a, b = redirects.columns[:2]
        edges.append(redirects.select(node(F.col(a)).alias("a"), node(F.col(b)).alias("b")))
    if not edges:
        return rows.select("page_id", "host", "path", "rule", F.when(F.coalesce("block", F.lit(False)), "block").otherwise("allow").alias("verdict"), F.when(F.col("rule").isNotNull(), "rule").otherwise("none").alias("via"))
    links = edges[0]
    for e in edges[1:]:
        links = links.unionAll(e)
    joined = cut(components(cut(links.distinct())))
    # The rules speak for every address of a component, whether or not it is a page of the table.
    h, p = host_path(F.concat(F.lit("x://"), F.col("node")))
    _, spoken = judge(h, p, rules)
    said = joined.select("node", "component", spoken.alias("b"))
    groups = said.groupBy("component").agg(F.max(~F.col("b")).alias("allowed"), F.max("b").alias("blocked"))
    alias = cut(joined.join(groups, "component").select(F.col("node").alias("alias"), F.when(F.col("allowed"), False).when(F.col("blocked"), True).alias("alias_block")).where("alias_block IS NOT NULL"))
    out = rows.join(alias, F.col("node") == F.col("alias"), "left")
    decided = F.coalesce("block", "alias_block", F.lit(False))
    via = F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias_block").isNotNull(), "alias").otherwise("none")
    return out.select("page_id", "host", "path", "rule", F.when(decided, "block").otherwise("allow").alias("verdict"), via.alias("via"))
