"""Registry, payload dispatch and the three connectors on literal payloads."""

import datetime as dt
import random
from collections import Counter
from pathlib import Path
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewell import schemas
from tidewell.operators import html_items, json_items, linkage, report
from tidewell.plans import ingest_queries, pipeline
from tidewell.session import shared_dir
from tidewell.sources import payloads, registry

NOW = dt.datetime(2026, 8, 1)
RSS = """<?xml version="1.0"?><rss><channel><title>f</title>
<item><title>One R&D</title><link>https://f.example/1</link><guid isPermaLink="false">g1</guid><pubDate>Fri, 24 Jul 2026 10:00:00 GMT</pubDate><description>First &amp; best</description></item>
<item><title>No ids</title></item><item><title>Broken <b></title></item>
<entry><title>Atom</title><id>a1</id><link rel="self" href="https://f.example/self"/><link href="https://f.example/a"/><published>2026-07-24T12:30:00Z</published><content type="html">body</content></entry></channel></rss>"""
JSON = '{"out": {"list": [{"ref": 0, "t": "Zero", "d": 1784887200}, {"t": "lost"}, {"ref": {"x": 1}}, {"ref": "a/b", "t": null, "d": "2026-07-24T10:00:00+02:00", "c": {"d": "text"}}, {"ref": "", "t": "x"}, 7]}}'
HTML = """<html><body><script>var a = '<a href="/news/no"><h2>no</h2></a>';</script>
<a href="/news/one"><h2>One <b>bold</b></h2><p>Read more »</p><p>An excerpt that is long enough to be one.</p></a>
<a href="/news/two"><div><time datetime="2026-07-24">x</time><span>News</span></div><span>Two</span></a>
<a href="/news/three"><time>Jul 24, 2026</time><span>Three</span></a>
<a href="/news/one/#top"><h3>again</h3></a><a href="/about"><h2>About</h2></a>
<a href="https://else.example/news/x"><h2>Else</h2></a><a href="/news/img"><img src="i"></a></body></html>"""


def source(ord_, id_, type_, payload, **more):
    row = {"source_ord": ord_, "id": id_, "type": type_, "url": "https://s.example/list", "lang": "en", "section": "learn", "priority": 0, "root_path": "", "mapping": {}, "url_template": "", "selector": "", "base_url": ""} | more
    return tuple(row[f.name] for f in schemas.SOURCE.fields) + (payload,)


def typed(spark, rows):
    return spark.createDataFrame(rows, StructType([*schemas.SOURCE.fields, StructField("payload", StringType())]))


@pytest.fixture(scope="module")
def done(spark):
    rows = [
        source(0, "feed", "rss", RSS),
        source(1, "api", "json", JSON, root_path="out.list", mapping={"guid": "ref", "title": "t", "published_at": "d", "content": "c.d"}, url_template="https://p.example/{guid}"),
        source(2, "page", "scrape", HTML, selector="/news/", base_url="https://s.example"),
        source(3, "odd", "gopher", "x"),
        source(4, "none", "json", None),
        source(5, "bad", "json", "{nope"),
        source(6, "nolist", "json", '{"a": 1}', root_path="a", mapping={"guid": "x"}),
        source(7, "silent", "rss", "not a feed"),
    ]
    return pipeline.run(typed(spark, rows), F.lit(NOW).cast("timestamp"))


def test_items(done):
    got = {(r.source_id, r.guid): (r.title, r.url, r.content) for r in done.items.collect()}
    feed = {k[1]: v for k, v in got.items() if k[0] == "feed"}
    assert feed["g1"] == ("One R&D", "https://f.example/1", "First & best")
    assert feed["a1"] == ("Atom", "https://f.example/a", "body")
    assert len(feed) == 3 and [len(k) for k in feed if k not in ("g1", "a1")] == [64]
    assert {k: v for k, v in got.items() if k[0] == "api"} == {("api", "0"): ("Zero", "https://p.example/0", ""), ("api", "a/b"): ("", "https://p.example/a%2Fb", "text")}
    assert {k[1]: v for k, v in got.items() if k[0] == "page"} == {
        "https://s.example/news/one": ("One bold", "https://s.example/news/one", "An excerpt that is long enough to be one."),
        "https://s.example/news/two": ("Two", "https://s.example/news/two", ""),
        "https://s.example/news/three": ("Three", "https://s.example/news/three", ""),
    }


def test_dates(done):
    got = {r.guid: r.p for r in done.items.select("guid", F.col("published_at").cast("timestamp_ntz").alias("p")).collect()}
    assert got["g1"] == dt.datetime(2026, 7, 24, 10) and got["a1"] == dt.datetime(2026, 7, 24, 12, 30)
    assert got["0"] == dt.datetime(2026, 7, 24, 10) and got["a/b"] == dt.datetime(2026, 7, 24, 8)
    assert got["https://s.example/news/two"] == got["https://s.example/news/three"] == dt.datetime(2026, 7, 24)
    assert got["https://s.example/news/one"] == NOW


def test_report(done):
    got = {r.source_id: (r.n_collected, r.state, r.reason) for r in done.source_report.collect()}
    assert got == {
        "feed": (3, "ok", ""), "api": (2, "ok", ""), "page": (3, "ok", ""), "odd": (0, "failed", "unknown source type 'gopher'"),
        "none": (0, "failed", "FileNotFoundError: payload missing"), "bad": (0, "failed", "JSONDecodeError: payload is not JSON"), "nolist": (0, "silent", ""), "silent": (0, "silent", ""),
    }


def test_quarantine(done):
    got = sorted((r.source_id, r.reason) for r in done.quarantine.collect())
    assert got == sorted([("api", "no usable identifier")] * 3 + [("api", "identifier is an object"), ("feed", "entry is not XML"), ("page", "no usable title")])


def test_no_configuration(spark):
    done = pipeline.run(None, F.lit(NOW).cast("timestamp"), spark)
    assert [x.count() for x in done] == [0, 0, 0, 0]


def test_registry(spark):
    good = {"id": "a", "type": "json", "url": "u", "lang": "en", "section": "learn", "priority": "5", "mapping": '{"guid": "x"}'}
    rows = [(0, good), (1, {"id": "b"}), (2, good | {"odd": "x"}), (3, good | {"priority": "high"}), (4, None), (5, good | {"type": "gopher", "section": "?", "priority": "0"})]
    loaded = registry.load(spark.createDataFrame(rows, "source_ord int, entry map<string,string>"))
    assert [(r.source_ord, r.priority, r.mapping, r.selector) for r in loaded.registry.orderBy("source_ord").collect()] == [(0, 5, {"guid": "x"}, ""), (5, 0, {"guid": "x"}, "")]
    assert [r.source_ord for r in loaded.rejects.orderBy("source_ord").collect()] == [1, 2, 3, 4]
    assert sorted((r.source_id, r.rule) for r in registry.check(loaded.registry).collect()) == [("a", "id declared twice"), ("a", "priority not set"), ("a", "type without connector"), ("a", "unknown section")]


def test_json_values(spark):
    rows = spark.createDataFrame([(0, "0"), (1, "false"), (2, '""'), (3, "[]"), (4, "{}"), (5, "null"), (6, "[1]"), (7, "true"), (8, '"x"'), (9, "3")], "i int, j string")
    got = [r[0] for r in rows.orderBy("i").select(json_items.truthy_text(F.try_parse_json("j"))).collect()]
    assert got == ["", "", "", "", "", "", "[1]", "true", "x", "3"]


def test_scan(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    files = payloads.scan(spark, str(tmp_path))
    assert files.first().payload == RSS
    sources = spark.createDataFrame([(f"file://{tmp_path}/a.xml", "a"), (f"{tmp_path}/b.xml", "b")], "url string, id string")
    assert {r.id: r.payload for r in payloads.of_registry(sources, files).collect()} == {"a": RSS, "b": None}


def test_many_payloads_are_landed_as_rows(spark, tmp_path):
    """Only the first chunk's payloads are files; markup in texts is no entry."""
    rows = [(i, f"text {i} <item> </item>", "en", f"source{i // 10 % 2}", 10) for i in range(0, 1000, 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    shared = Path(shared_dir(spark))
    before = set(shared.rglob("*.txt"))
    found = ingest_queries.payload_scan(spark, str(tmp_path))
    want = Counter(f"{r[3]}-{r[0] // 250}" for r in rows)
    assert {r.source_id: r.n_entries for r in found.collect()} == want
    assert len(set(shared.rglob("*.txt")) - before) <= 2


def test_scan_of_a_table_decodes_each_payload(spark):
    landed = [("a", bytearray("<?xml version='1.0' encoding='ISO-8859-1'?><p>\u00e9</p>".encode("latin-1"))), ("b", bytearray("<p>\u00e9</p>".encode("utf-16"))), ("c", bytearray(b""))]
    got = {r.path: r.payload for r in payloads.scan_table(spark.createDataFrame(landed, "path string, content binary")).collect()}
    assert got == {"a": "<?xml version='1.0' encoding='ISO-8859-1'?><p>\u00e9</p>", "b": "<p>\u00e9</p>"}


def test_crawl_permission(spark):
    pages = spark.createDataFrame([("https://h.example/private/x",), ("https://h.example/private/ok",), ("https://h.example/",), ("https://free.example/private/x",), ("file:///x",)], "url string")
    robots = spark.createDataFrame([("h.example", "User-agent: *\nDisallow: /\n\nUser-agent: tidewell\nAllow: /private/ok\nDisallow: /private # no\n")], "host string, body string")
    got = {r.url: r.allowed for r in html_items.crawl_permission(pages, robots, "tidewell/1").collect()}
    assert [got[u] for u in ("https://h.example/private/x", "https://h.example/private/ok", "https://h.example/", "https://free.example/private/x", "file:///x")] == [False, True, True, True, True]
    assert {r.allowed for r in html_items.crawl_permission(pages.where("url like '%h.ex%'"), robots, "else").collect()} == {False}


def test_feed_links_markup_and_zones(spark):
    feed = """<rss><item><title>P</title><guid>https://f.example/p</guid><pubDate>24 Jul 26 10:00:00 EST</pubDate></item>
<item><title>N</title><guid isPermaLink="false">n1</guid></item><item><title>L</title><link>https://f.example/l</link><guid>https://f.example/g</guid></item></rss>
<feed><entry><title>X</title><id>https://f.example/x</id><content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>One <b>two</b></p></div></content></entry></feed>"""
    rows = typed(spark, [source(0, "f", "rss", feed)])
    got = {r.title: (r.guid, r.url, r.content) for r in pipeline.run(rows, F.lit(NOW).cast("timestamp")).items.collect()}
    assert got == {"P": ("https://f.example/p", "https://f.example/p", ""), "N": ("n1", "", ""), "L": ("https://f.example/g", "https://f.example/l", ""), "X": ("https://f.example/x", "", "<p>One <b>two</b></p>")}


def test_repair_leaves_cdata_alone(spark):
    feed = "<rss><item><title>R&D &amp; <![CDATA[a & b]]> & c</title><description><![CDATA[x & <p>y</p> ]]]]><![CDATA[> &z;]]></description></item></rss>"
    row = pipeline.run(typed(spark, [source(0, "f", "rss", feed)]), F.lit(NOW).cast("timestamp")).items.first()
    assert (row.title, row.content) == ("R&D & a & b & c", "x & <p>y</p> ]]> &z;")


def test_entry_ends_in_text_cut_nothing(spark):
    feed = """<rss><!-- <item><title>no</title></item> --><item><title>A&nbsp;b &eacute; R&D &none; <![CDATA[&nbsp; </title></item>]]></title><description><![CDATA[x </item> y <item> <!-- ]]>&hellip;</description></item>
<entry><title>B <!-- </entry> --> &copy;</title><id>2</id><content>a\0b</content></entry><item><title>C</title><description><![CDATA[open</description></item><item><title>D</title></item></rss>"""
    done = pipeline.run(typed(spark, [source(0, "f", "rss", feed), source(1, "none", "rss", "<![CDATA[<item></item>]]>"), source(2, "null", "rss", None)]), F.lit(NOW).cast("timestamp"))
    got = [(r.entry_ord, r.title, r.content) for r in done.items.orderBy("item_ord").collect()]
    assert got == [(0, "A\xa0b é R&D &none; &nbsp; </title></item>", "x </item> y <item> <!-- …"), (1, "B  ©", "ab"), (3, "D", "")]
    assert [(r.entry_ord, r.reason) for r in done.quarantine.collect()] == [(2, "entry is not XML")]


def test_an_id_declared_twice(spark):
    def feed(n):
        return "<rss>" + "".join(f"<item><title>t</title><link>https://t.example/{i}</link></item>" for i in n) + "</rss>"

    rows = typed(spark, [source(0, "a", "rss", feed([1, 2])), source(1, "a", "rss", feed([3])), source(2, "b", "rss", feed([1]))])
    done = pipeline.run(rows, F.lit(NOW).cast("timestamp"))
    assert sorted((r.source_ord, r.n_collected, r.n_retained) for r in done.source_report.collect()) == [(0, 2, 3), (1, 1, 3), (2, 1, 0)]
    check = report.conservation(done.source_report, done.dedup_report).first()
    assert (check.collected, check.retained, check.losers, check.holds) == (4, 3, 1, True)
    head = report.report_lines(done.source_report, linkage.summary(done.dedup_report)).where("part = 0").first().line
    assert head == "Collection: 3 item(s) from 3 source(s) - 4 collected, 1 duplicate(s) removed"


def test_forbidden_pages_are_silent(spark):
    rows = typed(spark, [source(0, "shut", "scrape", HTML, selector="/news/", base_url="https://s.example", url="https://shut.example/list"), source(1, "open", "scrape", HTML, selector="/news/", base_url="https://s.example"), source(2, "feed", "rss", RSS, url="https://shut.example/feed")])
    robots = spark.createDataFrame([("shut.example", "User-agent: *\nDisallow: /")], "host string, body string")
    got = {r.source_id: (r.n_collected, r.state) for r in pipeline.run(rows, F.lit(NOW).cast("timestamp"), robots=robots).source_report.collect()}
    assert got == {"shut": (0, "silent"), "open": (3, "ok"), "feed": (3, "ok")}


def test_no_valid_declaration(spark):
    none = registry.load(spark.createDataFrame([(0, {"id": "x"})], "source_ord int, entry map<string,string>")).registry.withColumn("payload", F.lit(None).cast("string"))
    assert [x.count() for x in pipeline.run(none, F.lit(NOW).cast("timestamp"))] == [0, 0, 0, 0]


def test_scratch_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from tidewell import session

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(far)


def test_a_payload_is_parsed_once(spark):
    mapping = {"guid": "id"}
    rows = typed(spark, [source(0, "a", "json", '[{"id": 1}, {"id": 2}]', mapping=mapping), source(1, "b", "json", "{", mapping=mapping), source(2, "c", "json", "[]", mapping=mapping), source(3, "d", "json", '{"id": [{"id": 1}]}', mapping=mapping), source(4, "e", "json", "7", mapping=mapping)])
    judged = json_items.judged(rows, F.lit(NOW).cast("timestamp"))
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("parseJson(") == 1 and "variant_explode" in plan and "ArrayType" not in plan
    assert sorted((r.source_ord, r.entry_ord, r.guid, r.failure) for r in judged.collect() if r.failure is None) == [(0, 0, "1", None), (0, 1, "2", None)]
    assert [(r.source_ord, r.entry_ord, r.failure) for r in judged.where("failure is not null").collect()] == [(1, None, "JSONDecodeError: payload is not JSON")]


def test_a_large_list(spark):
    n = 400_000
    payload = F.concat(F.lit('{"l": ['), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit('{"id": '), i.cast("string"), F.lit(', "t": "a title of some length"}'))), ", "), F.lit("]}"))
    rows = typed(spark, [source(0, "a", "json", "", root_path="l", mapping={"guid": "id", "title": "t"})]).withColumn("payload", payload)
    got = json_items.items(rows, F.lit(NOW).cast("timestamp"))[0].agg(F.count("*"), F.max("entry_ord"), F.sum(F.col("guid").cast("long")))
    assert tuple(got.first()) == (n, n - 1, n * (n + 1) // 2)


def robots_file(rng):
    """Rules as found in the wild: groups with several agents, blank lines, comments, percent signs, odd fields."""
    paths = ["/", "/a", "/a/b", "/a%2fb", "/a%20b", "/a b", "/\u00e9", "/%C3%A9", "", "*", "/*", "/x?q=1", "/a;p", "a"]
    lines = []
    for _ in range(rng.randint(0, 4)):
        lines += [f"User-Agent: {rng.choice(['*', 'tidewell', 'Tide', 'other', 'well/2'])}" for _ in range(rng.randint(0, 2))]
        lines += [rng.choice(["", "# note", "Sitemap: x", "Crawl-delay: 2", "nonsense", " "]) for _ in range(rng.randint(0, 2))]
        lines += [f"{rng.choice(['Allow', 'Disallow', 'disallow '])}: {rng.choice(paths)}{rng.choice(['', ' # why', ' '])}" for _ in range(rng.randint(0, 4))]
        lines += [""] * rng.randint(0, 1)
    return rng.choice(["\n", "\r\n"]).join(lines)


def test_crawl_rules_equal_the_standard_library(spark):
    rng = random.Random(12)
    files = {f"h{i}.example": robots_file(rng) for i in range(300)}
    tails = ["", "/", "/a", "/a/b", "/a%2Fb", "/a%20b/c", "/a b", "/%c3%a9", "/\u00e9/x", "/x?q=1&r=2", "/x", "?q", "/a;p", "/a;", "/b#f", "/*", "/a?"]
    pages = [(f"https://{h}{t}",) for h in files for t in tails] + [("https://free.example/a",)]
    want = {}
    for (url,) in pages:
        read = RobotFileParser()
        read.parse(files.get(url.split("/")[2].split("?")[0], "").splitlines())
        want[url] = read.can_fetch("tidewell/1.0 (x)", url)
    found = html_items.crawl_permission(spark.createDataFrame(pages, "url string"), spark.createDataFrame(list(files.items()), "host string, body string"), "tidewell/1.0 (x)")
    got = {r.url: r.allowed for r in found.collect()}
    assert {u: (want[u], got[u]) for u in want if want[u] != got[u]} == {} and 500 < sum(want.values()) < len(want) - 500


def test_many_rules_of_one_host(spark):
    body = "User-agent: *\n" + "".join(f"Disallow: /part{i:05}/\nAllow: /part{i:05}\n" for i in range(20_000))
    pages = spark.range(0, 40_000, 7).select(F.concat(F.lit("https://h.example/part"), F.lpad(F.col("id").cast("string"), 5, "0"), F.when(F.col("id") % 2 == 0, "/x").otherwise("")).alias("url"), "id")
    got = html_items.crawl_permission(pages, spark.createDataFrame([("h.example", body)], "host string, body string"), "tidewell")
    blocked = {r.id for r in got.where("not allowed").collect()}
    assert blocked == {i for i in range(0, 40_000, 7) if i % 2 == 0 and i < 20_000}


@pytest.mark.parametrize("encoding, declared", [("iso-8859-1", "ISO-8859-1"), ("cp1252", "windows-1252"), ("utf-16", "utf-16"), ("utf-16-be", "utf-16"), ("utf-8-sig", ""), ("utf-8", ""), ("utf-8", "nonsense"), ("utf-32", "utf-32"), ("koi8-r", "koi8-r")])
def test_encodings(spark, tmp_path, encoding, declared):
    text = ("<?xml version='1.0' encoding='" + declared + "'?>" if declared else "") + "<rss><item><title>" + ("\u043f\u0440\u0438" if encoding == "koi8-r" else "d\u00e9j\u00e0") + "</title></item></rss>"
    (tmp_path / "f.xml").write_bytes(text.encode(encoding))
    assert payloads.scan(spark, str(tmp_path)).first().payload == text


def test_bytes_that_do_not_fit(spark, tmp_path):
    (tmp_path / "f.xml").write_bytes(b"<rss>\xff\xfe ok</rss>")
    (tmp_path / "g.html").write_bytes("<html><meta charset=iso-8859-1><p>\u00e9".encode("latin-1"))
    (tmp_path / "h.xml").write_bytes(b"")
    got = {r.path[-6:]: r.payload for r in payloads.scan(spark, str(tmp_path)).collect()}
    assert got == {"/f.xml": "<rss>\ufffd\ufffd ok</rss>", "g.html": "<html><meta charset=iso-8859-1><p>\u00e9"}
