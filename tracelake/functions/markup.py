"""Tags of HTML text as arrays of tokens, for texts that one pattern per element cannot read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOSED_ROW = r"(?is)<tr\b[^>]*>.*?</tr>"
_TOKEN = r"""(?s)<!--.*?-->|</?[a-zA-Z](?:"[^"]*"|'[^']*'|[^>"'])*>|[^<]+|<"""
_START, _END, _ALONE = r"(?is)^<tr(?:[\s/].*)?>$", r"(?is)^</tr\s*>$", r"(?s)^<[a-zA-Z].*/>$"
_ATTRIBUTE = r"""(?s)([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?"""
# Characters that are written by name.
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often the result's lambdas read it."""
    return F.get(F.transform(F.array(c), use), 0)


def tokens(html: Column) -> Column:
    """Comments, tags and the text between them, in order."""
    return F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))


def unescape(c: Column) -> Column:
    """Text with its common named and its numeric characters resolved; other names stay."""
    parts = F.regexp_extract_all(c, F.lit(r"&#[xX][0-9a-fA-F]{1,6};|&#[0-9]{1,7};|&[a-z]{2,4};|[^&]+|&"), F.lit(0))

    def resolve(x: Column) -> Column:
        code = F.when(F.rlike(x, F.lit("^&#[xX]")), F.conv(F.regexp_extract(x, "[0-9a-fA-F]+", 0), 16, 16)).when(
            F.rlike(x, F.lit("^&#[0-9]")), F.conv(F.regexp_extract(x, "[0-9]+", 0), 10, 16)
        )
        usable = F.conv(code, 16, 10).cast("long").between(1, 0x10FFFF) & ~F.conv(code, 16, 10).cast("long").between(0xD800, 0xDFFF)
        char = F.when(usable, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))
        named = F.try_element_at(F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair]), x)
        return F.coalesce(char, named, x)

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, resolve), "")).otherwise(c)


def _attributes(tag: Column) -> Column:
    """Attributes of a start tag, each as `` name='value'``; one without a value has ``None``."""
    inside = F.regexp_replace(tag, r"(?s)^<[a-zA-Z][^\s/>]*|/?>$", "")

    def shown(x: Column) -> Column:
        value = F.regexp_extract(x, _ATTRIBUTE, 2)
        bare = F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")
        return F.concat(
            F.lit(" "), F.lower(F.regexp_extract(x, _ATTRIBUTE, 1)), F.lit("='"), F.when(value == "", F.lit("None")).otherwise(unescape(bare)), F.lit("'")
        )

    return F.array_join(F.transform(F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), F.lit(0)), shown), "")


def _loose_rows(html: Column) -> Column:
    """Rows between a ``<tr>`` and the next end tag, whatever its spelling: text and empty elements stay, other tags go. A ``<tr>``
    before the end of a row begins it anew, as rows do not nest."""
    def body(t: Column) -> Column:
        tag = F.rlike(t, F.lit(r"(?s)^<(?:[a-zA-Z/!]).*>$"))
        alone = F.concat(F.lit("<"), F.lower(F.regexp_extract(t, r"^<([a-zA-Z][^\s/>]*)", 1)), _attributes(t), F.lit("/>"))
        return F.when(F.rlike(t, F.lit(_ALONE)), alone).when(tag, F.lit("")).otherwise(unescape(t))

    def kinds(all_tokens: Column) -> Column:
        kind = lambda t: F.when(F.rlike(t, F.lit(_START)) & ~F.rlike(t, F.lit(_ALONE)), 1).when(F.rlike(t, F.lit(_END)), 2)
        return F.filter(F.transform(all_tokens, lambda t, i: F.struct(i.alias("at"), kind(t).alias("kind"))), lambda e: e["kind"].isNotNull())

    def spans(found: Column) -> Column:
        following = F.slice(F.concat(found, F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("kind")))), 2, F.size(found))
        pairs = F.arrays_zip(found.alias("a"), following.alias("b"))
        return F.filter(pairs, lambda p: (p["a"]["kind"] == 1) & (p["b"]["kind"] == 2))

    def rows(all_tokens: Column) -> Column:
        return F.transform(
            once(kinds(all_tokens), spans),
            lambda s: F.concat(
                F.lit("<tr"), _attributes(F.get(all_tokens, s["a"]["at"])), F.lit(">"),
                F.array_join(F.transform(F.slice(all_tokens, s["a"]["at"] + 2, s["b"]["at"] - s["a"]["at"] - 1), body), ""), F.lit("</tr>"),
            ),
        )

    return once(tokens(html), rows)


def html_rows(html: Column) -> Column:
    """Rows of an HTML table: the closed ones as they stand or, where there is none, those read tag by tag."""
    # nothing after the last end tag can be a closed row; searching there would take quadratic time
    ended = F.regexp_extract(html, r"(?is)^.*</tr>", 0)
    closed = F.regexp_extract_all(ended, F.lit(CLOSED_ROW), F.lit(0))
    return F.when((F.size(closed) == 0) & F.contains(F.lower(html), F.lit("<tr")), _loose_rows(html)).otherwise(closed)
