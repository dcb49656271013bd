"""Row types of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "timestamp": T.TimestampType(), "map": T.MapType(T.StringType(), T.StringType())}


def _row(fields: str) -> T.StructType:
    """``name type, ...``; needs no session, so that workers can import this module."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


#: Canonical item. Missing text is the empty string; ``published_at`` is an instant (session zone UTC).
ITEM = _row("source_id string, guid string, title string, published_at timestamp, lang string, section string, url string, content string")
#: Items carry their place: the source's in the registry, the entry's in the source, and both as one number.
ORDER = _row("source_ord int, entry_ord bigint, item_ord bigint")
ORDERED_ITEM = T.StructType([*ITEM.fields, *ORDER.fields])
SOURCE = _row(
    "source_ord int, id string, type string, url string, lang string, section string, priority int, "
    "root_path string, mapping map, url_template string, selector string, base_url string"
)
SOURCE_REPORT = _row("source_ord int, source_id string, type string, n_collected bigint, n_retained bigint, n_approximate bigint, reason string, state string")
DEDUP_REPORT = _row("source_id string, losers bigint, winners bigint")
