"""URL and date functions on single values."""

import _pydatetime
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import dates, urls

URLS = {
    "https://www.site.example/a/": "site.example/a",
    "http://site.example/a": "site.example/a",
    "https://SITE.example/a#part": "site.example/a",
    "https://site.example/a?utm_source=x&UTM_Medium=y": "site.example/a",
    "https://site.example/a?id=42&utm_id=1": "site.example/a?id=42",
    "https://site.example/a?b=2&a=1": "site.example/a?a=1&b=2",
    "https://site.example/a?source=x": "site.example/a?source=x",
    "https://site.example:443/a": "site.example/a",
    "https://site.example:80/a": "site.example:80/a",
    "http://site.example:8080/a": "site.example:8080/a",
    "https://site.example/caf%C3%A9": "site.example/café",
    "https://site.example/a+b": "site.example/a+b",
    "https://site.example/100%": "site.example/100%",
    "https://site.example/a?q=x+y~*": "site.example/a?q=x+y~%2A",
    "https://user:pw@site.example/a": "site.example/a",
    "https://www.www.site.example": "site.example",
    "https://site.example/a?b=&": "site.example/a?b=",
    "https://[::1]:8080/a": "::1:8080/a",
    "https://[::1/a": "",
    "https://site.example:port/a": "",
    "https://site.example:99999/a": "",
    "/only/path": "",
    "": "",
    None: "",
    "  https://site.example/a \n": "site.example/a",
    "https://www./x": "",
}
LINKS = {
    ("https://a.example/x/y?q#f", "z"): "https://a.example/x/z",
    ("https://a.example/x/y", "../z?p#g"): "https://a.example/z?p#g",
    ("https://a.example/x/y", "/z"): "https://a.example/z",
    ("https://a.example/x/y", "//b.example/z"): "https://b.example/z",
    ("https://a.example/x/y", "?k=1"): "https://a.example/x/y?k=1",
    ("https://a.example/x/y?q", "#g"): "https://a.example/x/y?q#g",
    ("https://a.example/x/y", "mailto:a@b.example"): "mailto:a@b.example",
    ("https://a.example", "z"): "https://a.example/z",
    ("https://a.example/x/y", ""): "https://a.example/x/y",
}
SHOWN = {
    "2026-07-24": (2026, 7, 24),
    "2026-07-24T10:00:00Z": (2026, 7, 24, 10),
    "2026-07-24T10:00:00+02:00": (2026, 7, 24, 8),
    "2026-07-24 10:30": (2026, 7, 24, 10, 30),
    "20260724": (2026, 7, 24),
    "24/07/2026": (2026, 7, 24),
    "2026/07/24": (2026, 7, 24),
    "Jul 24, 2026": (2026, 7, 24),
    "24 July 2026": (2026, 7, 24),
    "posted Sept. 3rd, 2025": (2025, 9, 3),
    "(Jul 24, 2026)": (2026, 7, 24),
    "24 Decade 2026": (2026, 12, 24),
    "by May Smith, 3 June 2025": (2025, 6, 3),
    "3 Mar 2024, updated May 5 2024": (2024, 5, 5),
    "3 Mar 2024, updated Foo 5 2024": (2024, 3, 3),
    "on Feb 30, 2024, no: 1 Mar 2024": (2024, 3, 1),
    "Jul\xa024,\u20032026": (2026, 7, 24),
    "July 24 (2026)": None,
    "2026-W30-5": (2026, 7, 24),
    "2026W305": (2026, 7, 24),
    "2020-W53-7T10:00:00+02:00": (2021, 1, 3, 8),
    "2021-W53-1": None,
    "2026-W00-1": None,
    "24 Foo 2026": None,
    "31/02/2026": None,
    "Feb 30, 2026": None,
    "12:30:00": None,
    "2026": None,
    "soon": None,
    "": None,
}


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_normalise(spark):
    assert dict(zip(URLS, column(spark, URLS, urls.normalise))) == URLS


def test_resolve(spark):
    rows = spark.createDataFrame([(*k, v) for k, v in LINKS.items()], "base string, link string, want string")
    assert rows.select("base", "link", "want", urls.resolve(F.col("base"), F.col("link")).alias("got")).where("want <> got").collect() == []


def test_displayed_dates(spark):
    got = column(spark, SHOWN, lambda c: dates.displayed(c).cast("timestamp_ntz"))
    assert dict(zip(SHOWN, got)) == {k: v and dt.datetime(*v) for k, v in SHOWN.items()}


def iso_forms():
    """Dates, separators, times and offsets in all their spellings, and texts near to them."""
    days = ["2024-07-24", "20240724", "2024-W30-3", "2024-W30", "2024W303", "2024W30", "2020-W53-7", "2021-W53-1", "2024-02-30", "0000-01-01", "2024-7-24", "2024-W00-1", "2024-W30-8", "9999-12-31", "0001-01-01", "2024-0724"]
    times = ["", "T", "T10", " 1015", "T10:15", "t101500", "T10:15:00", "x10:15:00.5", "T101500,1234567", "T10:15:60", "T24:00", "T10:60", "T1", "T101", "T10:1500", "T10:15.5", "T23:59:59.999999", "😀10:15", "1015", "110", "1101500", "-10:00"]
    offsets = ["", "Z", "z", "+02", "-0530", "+05:30", "+05:30:15", "-053015", "-23:59:59.5", "+24:00", "+5", "+05:3", "Z+01", "+05:99", "+00:00", "+0530:15", "-"]
    rng = random.Random(9)
    made = {d + t + o for d in days for t in times for o in offsets}
    made |= {x[:i] + rng.choice("0123456789-:TWZ+., ") + x[i + rng.randint(0, 1) :] for x in rng.choices(sorted(made), k=6000) for i in [rng.randint(0, len(x))]}
    return sorted(made)


def read_iso(text, library=dt):
    """By the standard library, in microseconds of UTC; None where it reads nothing."""
    try:
        read = library.datetime.fromisoformat(text.removesuffix("Z") + "+00:00" if text.endswith("Z") else text)
        read = read if read.tzinfo is None else read.astimezone(library.timezone.utc).replace(tzinfo=None)
        return (read - library.datetime(1970, 1, 1)) // library.timedelta(microseconds=1)
    except (ValueError, OverflowError, AssertionError, IndexError):
        return None


def test_iso_forms_equal_the_standard_library(spark):
    texts = iso_forms()
    want = {t: read_iso(t) for t in texts}
    agreed = [t for t in texts if want[t] == read_iso(t, _pydatetime)]  # its two readers differ on stray characters before offsets
    assert len(agreed) > 9000 and sum(want[t] is not None for t in agreed) > 1000
    rows = spark.createDataFrame([(t,) for t in agreed], "t string")
    got = {r.t: r.m for r in rows.select("t", F.unix_micros(dates.iso(F.col("t"))).alias("m")).collect()}
    assert {t: (want[t], got[t]) for t in agreed if want[t] != got[t]} == {}


@pytest.mark.parametrize("text", ["Fri, 24 Jul 2026 10:00:00 GMT", "24 Jul 2026 12:00:00 +0200", "24 Jul 26 10:00:00 GMT", "24 Jul 2026 05:00:00 EST", "24 Jul 2026 06:00:00 edt", "Fri, 24 Jul 26 03:00 PDT", "24 Jul 2026 10:00:00 Z"])
def test_rfc822(spark, text):
    assert column(spark, [text], lambda c: dates.rfc822(c).cast("timestamp_ntz")) == [dt.datetime(2026, 7, 24, 10)]


def test_epoch(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 1784887200.0), (2, 1784887200000.0), (3, 1e18), (4, None)], "i int, v double")
    got = [r[0] for r in rows.orderBy("i").select(dates.epoch(F.col("v")).cast("timestamp_ntz")).collect()]
    assert got == [dt.datetime(1970, 1, 1, 0, 0, 1), dt.datetime(2026, 7, 24, 10), dt.datetime(2026, 7, 24, 10), None, None]


def test_rfc822_else(spark):
    got = column(spark, ["24 Jul 98 10:00:00 GMT", "24 Jul 2026", "soon", "", None, "24 Jul 2026 10:00:00 Mars"], lambda c: dates.rfc822(c).cast("timestamp_ntz"))
    assert got == [dt.datetime(1998, 7, 24, 10)] + [None] * 5
