"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track visits (fixed values).
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader",
    "utm_brand", "utm_social", "fbclid", "gclid", "dclid", "msclkid", "twclid", "igshid", "mc_cid", "mc_eid",
    "_hsenc", "_hsmi", "vero_id", "yclid",
)
#: Scheme, authority, path, query of a URI reference (RFC 3986, appendix B, without the fragment).
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, number: int) -> Column:
    return F.regexp_extract(url, _PARTS, number)


def authority(url: Column) -> Column:
    """Host and port as written; empty for relative URLs."""
    return part(url, 2)


def percent_decode(text: Column) -> Column:
    """Percent-decoding that leaves ``+`` and malformed escapes alone."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), text)


def percent_encode(text: Column) -> Column:
    """Percent-encoding without safe characters but letters, digits and ``_.-~``."""
    return F.replace(form_encode(text), F.lit("+"), F.lit("%20"))


def form_encode(text: Column) -> Column:
    """Percent-encoding for queries: a space becomes ``+``."""
    coded = F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))
    return F.replace(coded, F.lit("%7E"), F.lit("~"))


def _pairs(query: Column) -> Column:
    """Decoded ``struct<k, v>`` of a query, blank values kept and empty pairs dropped."""

    def decoded(half: Column) -> Column:
        return percent_decode(F.replace(half, F.lit("+"), F.lit(" ")))

    def pair(text: Column) -> Column:
        at = F.instr(text, "=")
        key = F.when(at > 0, F.left(text, at - 1)).otherwise(text)
        value = F.when(at > 0, F.substr(text, at + 1)).otherwise("")
        return F.struct(decoded(key).alias("k"), decoded(value).alias("v"))

    return F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), pair)


def normalise(url: Column) -> Column:
    """Canonical form of a URL: one string for the variants that name the same article.

    Ignores scheme, ``www.``, the scheme's default port, user info, fragment, percent-encoding,
    final slashes, tracking parameters and the order of parameters. Null, malformed and
    host-less URLs give the empty string; nothing raises.
    """
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\x00-\x20\s]+|[\x00-\x20\s]+$", ""), r"[\t\r\n]", "")
    scheme, place, path, query = F.lower(part(clean, 1)), F.regexp_replace(part(clean, 2), "^.*@", ""), part(clean, 3), part(clean, 4)
    bracketed = F.contains(place, F.lit("[")) | F.contains(place, F.lit("]"))
    well_formed = F.when(bracketed, F.regexp_like(place, F.lit(r"^\[[0-9A-Fa-f:.]+\](:[0-9]*)?$"))).otherwise(F.regexp_like(place, F.lit(r"^[^:]*(:[0-9]*)?$")))
    host = F.lower(F.when(bracketed, F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(place, "^([^:]*)", 1)))
    port = F.regexp_replace(F.regexp_extract(place, r"(?::([0-9]*))$", 1), "^0+(?=[0-9])", "")
    in_range = (F.length(port) <= 5) & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535)
    bare = F.regexp_replace(host, r"^(www\.)+", "")
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    named = F.concat(bare, F.when(default, "").otherwise(F.concat(F.lit(":"), port)))
    kept = F.array_sort(F.filter(_pairs(query), lambda p: ~F.lower(p["k"]).isin(*TRACKING)))
    text = F.array_join(F.transform(kept, lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"]))), "&")
    tail = F.when(query == "", "").otherwise(text)
    whole = F.concat(named, F.regexp_replace(percent_decode(path), "/+$", ""), F.when(tail == "", "").otherwise(F.concat(F.lit("?"), tail)))
    return F.when(well_formed & in_range & (bare != ""), whole).otherwise("")


def defragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def _without_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments from an absolute path."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        F.filter(segments, lambda s: s != "."),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolve(base: Column, link: Column) -> Column:
    """The absolute URL of ``link`` on a page at ``base`` (RFC 3986, section 5)."""
    scheme, host, path = part(base, 1), part(base, 2), part(base, 3)
    root = F.concat(scheme, F.lit("://"), host)
    link_path, rest = part(link, 3), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    base_query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1)
    return (
        F.when(link == "", defragment(base))
        .when(F.regexp_like(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), link)
        .when(base == "", link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("#")), F.concat(root, path, base_query, link))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path, link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, _without_dots(link_path), rest))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, link_path)), rest))
    )
