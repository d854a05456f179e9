"""URL rules whose block decisions reach every alias of a page, by redirect and canonical-link equivalence."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from html.entities import html5
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.urls import base_parts, normalize_url
from gleanery.llm.components import connected_components
from gleanery.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What stands for a character in an attribute: a number or a name; without ``;`` a name ends before what is no letter, digit or ``=``.
_PIECES = r"(?s)&#[xX][0-9A-Fa-f]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9]))|[^&]+|&"
#: All names of HTML 5, and the numbers that are read as Windows-1252.
_REFERENCES = {f"&{name}": text for name, text in html5.items()} | {
    f"&#{n}": text for n in range(0x80, 0xA0) if (text := bytes([n]).decode("cp1252", "ignore"))}
#: ASCII characters that stay in a normalized path.
_SAFE = "".join(c for c in map(chr, range(0x21, 0x7F)) if c not in '"<>`{}')


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What names a resource here: host, path and query. Scheme and fragment do not count."""
    rest = F.regexp_extract(_after_scheme(url), "^[^/?#]*([^#]*)", 1)
    return F.nullif(F.concat(host_of(url), rest), F.lit(""))


def decoded(text: Column) -> Column:
    """The text of an HTML attribute with its character references read."""
    known = F.from_json(F.lit(json.dumps(_REFERENCES)), "map<string, string>")

    def read(piece: Column) -> Column:
        code = F.coalesce(
            F.conv(F.nullif(F.regexp_extract(piece, "^&#[xX]0*([0-9A-Fa-f]{1,6});?$", 1), F.lit("")), 16, 10),
            F.nullif(F.regexp_extract(piece, "^&#0*([0-9]{1,7});?$", 1), F.lit(""))).cast("int")
        sign = F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(
            F.coalesce(F.try_element_at(known, F.concat(F.lit("&#"), code.cast("string"))), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        return F.when(F.startswith(piece, F.lit("&#")) & (piece != "&#"), sign).when(
            F.startswith(piece, F.lit("&")), F.coalesce(F.try_element_at(known, piece), piece)).otherwise(piece)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), read), "")).otherwise(text)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def resource_of(url: Column, base: Column | None = None) -> Column:
    """The node of a page's url, a redirect's end or a link target (against ``base``), all normalized alike: empty path as ``/``,
    no default port, resolved, percent-encoded in capitals. Other schemes than http(s) stay as they are."""

    def capitals(node: Column) -> Column:
        signs = F.regexp_extract_all(node, F.lit("(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))
        encoded = F.array_join(F.transform(signs, lambda x: F.when(F.length(x) == 3, F.upper(x)).otherwise(x)), "")
        return F.when(node.rlike("%(?:[a-f]|[0-9A-F][a-f])"), encoded).otherwise(node)

    full = _once(base_parts(url) if base is None else base, lambda b: normalize_url(url, b))
    other = F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), url)
    return _once(_once(F.coalesce(full, other), node_of), capitals)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]], encoded: bool = False) -> Column:
    """The longest of ``rules`` (verdict, host with path) that covers a URL, as a struct; null if none does.

    A rule covers its host and all subdomains where the path starts with the rule's. Of rules equally long
    an allow wins. The rules are a parameter list and stand in the expression. With ``encoded`` the path is
    one of :func:`resource_of`, and the rules' paths are encoded likewise.
    """
    def path_text(text: str) -> str:
        return "/" + (quote(text.partition("/")[2], safe=_SAFE) if encoded else text.partition("/")[2])

    table = F.array(*(
        F.struct(F.lit(len(text)).alias("size"), F.lit(verdict).alias("verdict"), F.lit(text).alias("rule"),
                 F.lit(text.partition("/")[0]).alias("host"), F.lit(path_text(text)).alias("path"),
                 F.lit("." + text.partition("/")[0]).alias("parent"))
        for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))
    ))
    covering = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, r["parent"])) & F.startswith(path, r["path"]))
    return F.get(covering, F.lit(0))


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Pairs of nodes that name the same page: canonical links and refresh redirects in ``html``, and the rows
    of ``redirects`` (``from_url``, ``to_url``) if given."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    wanted = F.filter(tags, lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?[^"'>]*\bcanonical\b""") | t.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""))
    target = F.regexp_extract(F.col("tag"), r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)|\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    other = F.regexp_extract(F.col("tag"), r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)|\burl\s*=\s*["']?([^"'\s>]+)""", 2)
    found = (
        pages.select("url", F.explode(wanted).alias("tag"))
        .select("url", F.when(target != "", target).otherwise(F.nullif(other, F.lit(""))).alias("href"))
        .filter("href is not null")
        .select(resource_of(F.col("url")).alias("a"), _once(decoded(F.col("href")), lambda h: resource_of(h, base_parts(F.col("url")))).alias("b"))
    )
    if redirects is not None:
        found = found.union(redirects.select(resource_of(F.col("from_url")), resource_of(F.col("to_url"))))
    return found.filter("a is not null and b is not null and a <> b").distinct()


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``via_alias`` of every row of ``pages``.

    A page with a rule of its own follows it: an explicit allow stands whatever its aliases are. Any other
    page is blocked if a page or link target in its component is blocked by a rule, else allowed.

    Null urls and such without ``://`` have an empty host and path and are allowed. Null html has no links.
    Repeated rows are judged each; an empty table gives an empty result; further columns are ignored.
    """
    edges = materialize(alias_edges(pages, redirects), "alias-edges")
    members = connected_components(edges)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), resource_of(F.col("url")).alias("node"))
    rows = rows.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    address = F.concat(F.lit("x://"), F.col("node"))
    judged = members.filter(rule_for(host_of(address), path_of(address), rules, encoded=True)["verdict"] == "block").select("component")
    # pages are judged by their urls as they stand, which their nodes need not show
    by_page = rows.filter(F.col("own.verdict") == "block").select("node").join(members, "node").select("component")
    blocked = judged.union(by_page).distinct()
    aliases = members.join(blocked, "component").select(F.col("node").alias("alias_node"), F.lit(True).alias("alias_blocked"))
    found = rows.join(aliases, F.col("node") == F.col("alias_node"), "left")
    via = F.col("own").isNull() & F.coalesce("alias_blocked", F.lit(False))
    return found.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.when(via, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        via.alias("via_alias"),
    )
