"""HTML listing pages to items: one per link that has a title."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import quote, unquote, urlparse, urlunparse
from urllib.robotparser import RobotFileParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewell.functions import dates, urls
from tidewell.operators import common
from tidewell.session import materialize

#: Short texts that call to action and are no excerpt (fixed values), and the length from which a text is one.
ACTIONS = ("read more", "lire la suite", "en savoir plus", "learn more", "read", "more")
EXCERPT_LENGTH = 30
#: Characters that may end such a call (fixed values).
LABEL_END = " .›→»"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4"))


class _Page(HTMLParser):
    """One list of a page's texts, and for every element where its texts begin and end and which elements it holds.

    Elements are numbered as they open, so those inside an element are the numbers up to its ``last``. Each tag
    knows the places on the stack where it is open; thus work grows with the page, however deep it nests.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.last: list[int] = []
        self.parent: list[int] = []
        self.stack: list[int] = []
        self.tags: list[str] = []  # of the stack
        self.open: dict[str, list[int]] = {}
        self.found: dict[str, list[int]] = {tag: [] for tag in ("a", "time", "span", "p")}
        self.found["heading"] = []
        self.attrs: dict[int, dict[str, str]] = {}  # of links and times

    def handle_starttag(self, tag: str, attrs: list) -> None:
        number = len(self.begin)
        self.begin.append(len(self.texts))
        self.end.append(len(self.texts))
        self.last.append(number)
        self.parent.append(self.stack[-1] if self.stack else -1)
        kind = "heading" if tag in _HEADINGS else tag
        if tag in ("a", "time"):
            values = {k: v or "" for k, v in attrs}
            kind = kind if tag == "time" or "href" in values else ""
            self.attrs[number] = values
        if kind in self.found:
            self.found[kind].append(number)
        if tag not in _VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append(number)
            self.tags.append(tag)

    def _close(self, depth: int) -> None:
        while len(self.stack) > depth:
            number = self.stack.pop()
            self.open[self.tags.pop()].pop()
            self.end[number], self.last[number] = len(self.texts), len(self.begin) - 1

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            self._close(self.open[tag][-1])

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if piece and not (self.tags and self.tags[-1] in ("script", "style")):
            self.texts.append(piece)

    def close(self) -> None:
        super().close()
        self._close(0)
        self.size = [0, *accumulate(map(len, self.texts))]
        self.worded = [n for n in self.found["span"] if self.begin[n] < self.end[n]]
        self.paragraphs = [n for n in self.found["p"] if self.begin[n] < self.end[n] and not self._is_call(n)]

    def text(self, number: int) -> str:
        return " ".join(self.texts[self.begin[number] : self.end[number]])

    def _length(self, number: int) -> int:
        a, b = self.begin[number], self.end[number]
        return self.size[b] - self.size[a] + max(0, b - a - 1)

    def _is_call(self, number: int) -> bool:
        return self._length(number) < EXCERPT_LENGTH and self.text(number).lower().rstrip(LABEL_END) in ACTIONS

    def _first(self, numbers: list[int], after: int, within: int) -> int | None:
        """The first of ``numbers`` above ``after`` that element ``within`` holds."""
        at = bisect(numbers, after)
        return numbers[at] if at < len(numbers) and numbers[at] <= self.last[within] else None

    def describe(self, link: int) -> tuple[str, str | None, str]:
        """Title, shown date and excerpt of a link.

        The title is the text of the first heading, else of the first span outside the block that holds the date.
        The excerpt is the first paragraph that neither repeats the title nor is a short call to action.
        """
        heading, time = self._first(self.found["heading"], link, link), self._first(self.found["time"], link, link)
        title = "" if heading is None else self.text(heading)
        if not title:
            span = self._first(self.worded, link, link)
            block = -1 if time is None or self.parent[time] == link else self.parent[time]
            if span is not None and block < span <= (self.last[block] if block >= 0 else -1):
                span = self._first(self.worded, self.last[block], link)
            title = "" if span is None else self.text(span)
        paragraph = self._first(self.paragraphs, link, link)
        while paragraph is not None and self._length(paragraph) == len(title) and self.text(paragraph) == title:
            paragraph = self._first(self.paragraphs, paragraph, link)
        shown = None if time is None else (self.attrs[time].get("datetime") or self.text(time)).strip()
        return title, shown, "" if paragraph is None else self.text(paragraph)


_LINK = "source_id string, source_ord int, entry_ord bigint, href string, title string, time string, excerpt string"
_ARROW_LINK = pa.schema([("source_id", pa.string()), ("source_ord", pa.int32()), ("entry_ord", pa.int64()), *((c, pa.string()) for c in ("href", "title", "time", "excerpt"))])
#: Links of a page that are handed on at once.
_LINKS_AT_ONCE = 1024


def links(sources: DataFrame) -> DataFrame:
    """Pages to one row per ``a[href]`` whose raw target holds the source's selector, in document order.

    The selector is applied in the batch, before a link is described, since filters are not
    pushed through Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, source_ord, selector, payload in zip(*(c.to_pylist() for c in batch.columns)):
                page = _Page()
                page.feed(payload or "")
                page.close()
                wanted = [(i, a) for i, a in enumerate(page.found["a"]) if (selector or "") in page.attrs[a]["href"]]
                for at in range(0, len(wanted), _LINKS_AT_ONCE):
                    rows = [(ident, source_ord, i, page.attrs[a]["href"], *page.describe(a)) for i, a in wanted[at : at + _LINKS_AT_ONCE]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ARROW_LINK)], schema=_ARROW_LINK)

    return sources.select("id", "source_ord", "selector", "payload").mapInArrow(run, _LINK)


def raw_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``entry_ord, href`` of every link by pattern alone, in SQL functions (quoted targets only)."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return pages.select("*", F.posexplode(found).alias("entry_ord", "href"))


def same_domain(url: Column, base: Column) -> Column:
    return (urls.authority(base) == "") | (urls.authority(url) == urls.authority(base))


def link_key(url: Column) -> Column:
    return F.regexp_replace(urls.defragment(url), "/+$", "")


def first_of_page(rows: DataFrame, usable: Column | None = None) -> DataFrame:
    """Of (usable) links to the same place on a page, fragment and final slashes aside, the first; unusable ones stay."""
    keep = F.lit(True) if usable is None else usable
    place = W.partitionBy("source_id", link_key(F.col("url")), keep).orderBy("entry_ord")
    return rows.withColumn("_n", F.row_number().over(place)).where((F.col("_n") == 1) | ~keep).drop("_n")


def judged(sources: DataFrame, run_ts: Column) -> DataFrame:
    """Every link of the pages' own domains: the first to each place that has a title, and those rejected for want of one."""
    about = sources.select(F.col("id").alias("source_id"), "source_ord", "lang", "section", F.when(common.text(F.col("base_url")) != "", F.col("base_url")).otherwise(F.col("url")).alias("base"))
    rows = links(sources).join(about, ["source_id", "source_ord"])
    rows = rows.withColumn("url", urls.resolve(F.col("base"), F.col("href"))).where(same_domain(F.col("url"), F.col("base")))
    rows = first_of_page(rows, F.col("title") != "")
    return rows.select(
        "source_id", "source_ord", "entry_ord", F.col("url").alias("guid"), "title", F.coalesce(dates.displayed(F.col("time")), run_ts).alias("published_at"),
        "lang", "section", "url", F.col("excerpt").alias("content"), F.when(F.col("title") == "", "no usable title").alias("reject"),
    )


def items(sources: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Items, and links rejected for want of a title."""
    return common.split(judged(sources, run_ts))


def zero_yield(sources: DataFrame, found: DataFrame) -> DataFrame:
    """Pages that gave no item."""
    return sources.select(F.col("id").alias("source_id")).join(found.select("source_id").distinct(), "source_id", "left_anti")


_RULE = "host string, ord int, prefix string, allow boolean"


def _rules(robots: DataFrame, agent: str) -> DataFrame:
    """``host, ord, prefix, allow``: the rules for an agent in landed files, in order; paths are percent-encoded. Files are read by the standard library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, body in zip(*(c.to_pylist() for c in batch.columns)):
                read = RobotFileParser()
                read.parse((body or "").splitlines())
                group = next((e for e in read.entries if e.applies_to(agent)), read.default_entry)
                rows += [(host, i, r.path, r.allowance) for i, r in enumerate(group.rulelines if group else ())]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], ["host", "ord", "prefix", "allow"])

    return robots.dropDuplicates(["host"]).select("host", "body").mapInArrow(run, _RULE)


@F.pandas_udf(StringType())
def crawl_path(url: pd.Series) -> pd.Series:
    """What rules are held against: path, query and fragment, percent-decoded and encoded again; ``/`` where there is none."""

    def one(text: str | None) -> str:
        try:
            parts = urlparse(unquote(text or ""))
        except ValueError:  # brackets that hold no address
            return "/"
        return quote(urlunparse(("", "", *parts[2:]))) or "/"

    return url.map(one)


def crawl_permission(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Add ``allowed`` to pages (``url``) by landed robots rules (``host, body``; of several rows of a host one counts).

    The first group of rules that names the agent decides, else the one for all; in a group the first
    rule whose path starts the page's path. Without rules, or for other schemes than http and https, a page is
    allowed. A page looks up its path cut to each length that its host's rules have, so the work does not grow with the number of rules.
    """
    rules, _ = materialize(_rules(robots, agent), "rules")
    asked = pages.withColumns({"_host": urls.authority(F.col("url")), "_path": crawl_path(F.col("url"))})
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    places = asked.select("_host", "_path").distinct().join(lengths, F.col("_host") == F.col("host"))
    cuts = places.select("_host", "_path", F.explode(F.filter("lengths", lambda n: n <= F.length("_path"))).alias("n"))
    met = cuts.join(rules, (F.col("_host") == F.col("host")) & (F.left("_path", F.col("n")) == F.col("prefix")))
    decided = met.groupBy("_host", "_path").agg(F.min(F.struct("ord", "allow")).alias("first")).select("_host", "_path", F.col("first.allow").alias("_allow"))
    allowed = F.coalesce("_allow", F.lit(True)) | ~F.rlike("url", F.lit("^https?://"))
    return asked.join(decided, ["_host", "_path"], "left").withColumn("allowed", allowed).select(*pages.columns, "allowed")
