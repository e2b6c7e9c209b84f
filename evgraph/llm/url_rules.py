"""URL filter with redirect equivalence.

A url is judged by the longest rule that fits it.  Urls joined by a redirect or by a
canonical link are one resource: a block of any of them reaches all that no rule
judges.  A rule that allows a url always wins for that url.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule
and takes no part in links; urls that repeat get the same verdict; links to a url
that is no page count too; an empty table gives an empty result; extra columns of the
input, whatever their names, are not carried.  Without links the verdict of a page
without a rule is allow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.operators.components import components
from evgraph.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tags that name another address of the page; attribute order is free.
_CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_TARGET = r"""(?i)\burl\s*=\s*["']?([^"'>\s]+)"""


def host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Index of the longest rule that fits, or null; at equal length the first given."""
    found = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i].name), -i)):
        r = rules[i]
        inside = (host == r.host) | host.endswith(f".{r.host}")
        found = F.when(inside & path.startswith(r.path), F.lit(i)).otherwise(found)
    return found


def _pick(index: Column, values: list[str]) -> Column:
    picked = F.lit(None).cast("string")
    for i, v in enumerate(values):
        picked = F.when(index == i, F.lit(v)).otherwise(picked)
    return picked


def node(url: Column) -> Column:
    """Name of a resource: the url with scheme and host in lower case, without fragment."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    tail = bare.substr(F.length(head) + 1, F.length(bare))
    return F.when(F.instr(url, "://") > 0, F.concat(F.translate(head, _UPPER, _LOWER), tail))


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) from each page to the canonical or refresh address in its html."""
    tags = pages.select(
        F.col("url").alias("a"),
        F.concat(
            F.transform(F.expr(f"regexp_extract_all(html, {_sql(_CANONICAL)}, 0)"),
                        lambda t: F.concat(*[F.regexp_extract(t, _HREF, k) for k in (1, 2, 3)])),
            F.transform(F.expr(f"regexp_extract_all(html, {_sql(_REFRESH)}, 0)"),
                        lambda t: F.regexp_extract(t, _TARGET, 1)),
        ).alias("targets"),
    )
    b = F.replace(F.trim("b"), F.lit("&amp;"), F.lit("&"))
    root = F.regexp_extract("a", r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract("a", r"(?s)^(.*?:)//", 1)
    whole = (
        F.when(b.startswith("//"), F.concat(scheme, b))
        .when(b.startswith("/"), F.concat(root, b))
        .otherwise(b)
    )
    return tags.filter("size(targets) > 0").select("a", F.explode("targets").alias("b")).select("a", whole.alias("b"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def judge(pages: DataFrame, links: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url, html).

    ``links`` (a, b) are further redirects, for example from a crawl log.  Components
    are found on linked urls only; one flag per component is joined back by url, so a
    component of any size moves one narrow row per url.
    """
    urls = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    index = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = urls.select("page_id", "url", "host", "path", index.alias("__i"))

    edges = page_links(pages)
    if links is not None:
        edges = edges.unionByName(links.select("a", "b"))
    edges = edges.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")).filter("a <> b").distinct()
    edges = cut_lineage(edges)
    by_rule = _pick(F.col("__i"), [r.verdict for r in rules])
    if edges.isEmpty():
        spread_block = F.lit(False)
        judged = urls
    else:
        roots = components(edges)
        member = roots.select("node", "root", fitting_rule(host(F.col("node")), path(F.col("node")), rules).alias("i"))
        blocked = member.filter(_pick(F.col("i"), [r.verdict for r in rules]) == "block").select("root").distinct()
        reached = roots.join(blocked, "root", "left_semi").select(F.col("node").alias("__node"), F.lit(True).alias("__hit"))
        judged = urls.withColumn("__node", node(F.col("url"))).join(reached, "__node", "left")
        spread_block = F.coalesce("__hit", F.lit(False))
    return judged.select(
        "page_id", "host", "path",
        _pick(F.col("__i"), [r.name for r in rules]).alias("rule"),
        F.coalesce(by_rule, F.when(spread_block, F.lit("block")), F.lit("allow")).alias("verdict"),
    )
