"""RSS and Atom payloads to items."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import dates
from tidewell.operators import common

_LINKS = "array<struct<_VALUE:string,_href:string,_rel:string>>"
_TEXTS = "array<struct<_VALUE:string,_type:string>>"
ENTRY = (
    f"title {_TEXTS}, link {_LINKS}, guid array<struct<_VALUE:string,_isPermaLink:string>>, id string, pubDate string, published string, "
    f"description {_TEXTS}, summary {_TEXTS}, content {_TEXTS}, `content:encoded` {_TEXTS}, _corrupt_record string"
)
_OPTIONS = {"mode": "PERMISSIVE", "valueTag": "_VALUE", "attributePrefix": "_", "columnNameOfCorruptRecord": "_corrupt_record"}
#: An ampersand that starts no XML entity, and a reference to a name that XML itself does not know.
_BARE = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)"
_NAMED = r"&(?!(?:amp|lt|gt|quot|apos);)[A-Za-z][A-Za-z0-9]*;"
#: Parts of a feed in which markup is only text.
_VERBATIM = r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->"
#: What stands for such a part while entries are cut: its number between characters that XML does not hold.
_HOLE = "\x00"


def _between(text: Column, form: str, change: Callable[[Column], Column], also: Callable[[Column], Column] = lambda x: x) -> Column:
    """``text`` with ``change`` applied to what lies between the matches of ``form``, and ``also`` to these."""
    plain, held = F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0))
    return F.array_join(F.flatten(F.zip_with(F.transform(plain, change), F.transform(held, also), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def entries(sources: DataFrame) -> DataFrame:
    """Feeds to one row per entry element, in order. Cutting first keeps a broken entry from its neighbours.

    CDATA sections and comments are taken out before, so markup in them cuts nothing; the sections are put back into the entries after.
    """
    payload = F.replace(F.coalesce("payload", F.lit("")), F.lit(_HOLE), F.lit(""))
    numbered = F.transform(F.split(payload, _VERBATIM, -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(_HOLE), i.cast("string"), F.lit(_HOLE), x)))
    cut = F.regexp_extract_all(F.array_join(numbered, ""), F.lit(r"(?s)<(item|entry)[\s>].*?</\1\s*>"), F.lit(0))
    rows = sources.select(*common.SOURCE_COLUMNS, cut.alias("cut"), F.regexp_extract_all(payload, F.lit(_VERBATIM), F.lit(0)).alias("held"))
    hole = f"{_HOLE}[0-9]+{_HOLE}"

    def back(number: Column) -> Column:
        part = F.get("held", F.replace(number, F.lit(_HOLE), F.lit("")).cast("int") - 1)
        return F.when(F.startswith(part, F.lit("<!--")), "").otherwise(part)

    whole = F.transform("cut", lambda x: _between(x, hole, lambda plain: plain, back))
    rows = rows.select(*common.SOURCE_COLUMNS, F.posexplode(whole).alias("entry_ord", "xml"))
    return rows.withColumnRenamed("id", "source_id").drop("url")


def n_entries(payload: Column) -> Column:
    """Entry elements that a feed opens; markup in CDATA sections and comments opens none."""
    return F.regexp_count(F.regexp_replace(payload, _VERBATIM, ""), F.lit("<(item|entry)>")).cast("bigint")


@cache
def _names() -> str:
    """The named characters of HTML 4 as a JSON object."""
    return json.dumps({name: chr(point) for name, point in name2codepoint.items()})


def _escaped(xml: Column) -> Column:
    """Outside CDATA sections, names that HTML gives to characters become these, and other bare ampersands are escaped."""
    known = F.from_json(F.lit(_names()), "map<string,string>")

    def character(reference: Column) -> Column:
        return F.coalesce(F.try_element_at(known, F.substr(reference, F.lit(2), F.length(reference) - 2)), F.concat(F.lit("&amp;"), F.substr(reference, F.lit(2))))

    return _between(xml, _VERBATIM, lambda text: _between(text, _NAMED, lambda plain: F.regexp_replace(plain, _BARE, "&amp;"), character))


def parsed(rows: DataFrame) -> DataFrame:
    """Add ``e`` (the entry's fields); entries that are no XML are tried again with HTML's names resolved and bare ampersands escaped."""
    once = rows.withColumn("e", F.from_xml("xml", ENTRY, _OPTIONS))
    repaired = F.from_xml(_escaped(F.col("xml")), ENTRY, _OPTIONS)
    return once.withColumn("e", F.when(F.col("e._corrupt_record").isNull(), F.col("e")).otherwise(repaired))


def _first(values: str) -> Column:
    return F.trim(common.text(F.get(f"e.{values}", F.lit(0))["_VALUE"]))


def link() -> Column:
    """The text of an RSS link, the target of an Atom link (alternate or without relation first), or a guid that is a permalink."""
    links = F.coalesce("e.link", F.array().cast(_LINKS))
    direct = F.filter(links, lambda x: common.text(x["_href"]) != "")
    best = F.filter(direct, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    plain = F.filter(links, lambda x: F.trim(common.text(x["_VALUE"])) != "")
    guids = F.filter(F.coalesce("e.guid", F.array().cast("array<struct<_VALUE:string,_isPermaLink:string>>")), lambda g: F.lower(F.coalesce(g["_isPermaLink"], F.lit("true"))) == "true")
    permalink = F.nullif(F.trim(F.get(guids, F.lit(0))["_VALUE"]), F.lit(""))
    return F.coalesce(F.trim(F.get(plain, F.lit(0))["_VALUE"]), F.get(best, F.lit(0))["_href"], F.get(direct, F.lit(0))["_href"], permalink, F.lit(""))


def xhtml(element: str) -> Column:
    """The markup inside an Atom element of type ``xhtml``, without its outer ``div``; null if there is none."""
    whole = F.regexp_extract("xml", rf"""(?s)<{element}\b[^>]*\btype\s*=\s*["'](?:xhtml|application/xhtml\+xml)["'][^>]*>(.*?)</{element}\s*>""", 1)
    inner = F.regexp_replace(whole, r"(?s)^\s*<(?:\w+:)?div\b[^>]*>(.*)</(?:\w+:)?div\s*>\s*$", "$1")
    return F.nullif(F.trim(inner), F.lit(""))


def guid(source_id: Column, native: Column, url: Column, title: Column) -> Column:
    """Native identifier, else the link, else a hash of source and title."""
    return F.coalesce(F.nullif(native, F.lit("")), F.nullif(url, F.lit("")), F.sha2(F.concat(source_id, title), 256))


def content() -> Column:
    """Summary (an RSS description), else content, else empty; empty ones fall through."""
    def filled(name: str) -> Column:
        return F.nullif(_first(name), F.lit(""))

    return F.coalesce(xhtml("summary"), filled("summary"), filled("description"), xhtml("content"), filled("content"), filled("`content:encoded`"), F.lit(""))


def instant(run_ts: Column) -> Column:
    return F.coalesce(dates.iso(F.trim("e.published")), dates.rfc822(F.col("e.pubDate")), dates.iso(F.trim("e.pubDate")), run_ts)


def project(rows: DataFrame, run_ts: Column) -> DataFrame:
    """Item columns of each entry, and why it is rejected."""
    title, url = _first("title"), link()
    native = F.coalesce(F.nullif(F.trim("e.id"), F.lit("")), F.trim(F.get("e.guid", F.lit(0))["_VALUE"]), F.lit(""))
    flat = rows.select("source_id", "source_ord", "entry_ord", "lang", "section", title.alias("title"), url.alias("url"), native.alias("native"), content().alias("content"), instant(run_ts).alias("published_at"), F.col("e._corrupt_record").alias("broken"))
    return flat.withColumn("guid", guid(F.col("source_id"), F.col("native"), F.col("url"), F.col("title"))).withColumn("reject", F.when(F.col("broken").isNotNull(), "entry is not XML"))


def judged(sources: DataFrame, run_ts: Column) -> DataFrame:
    """Every entry of the feeds, accepted or with its ``reject``."""
    return project(parsed(entries(sources)), run_ts)


def items(sources: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    return common.split(judged(sources, run_ts))
