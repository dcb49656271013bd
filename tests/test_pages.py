"""Listing pages: titles, dates and excerpts against a plain tree, and work that grows with the page alone."""

import random
import time
from html.parser import HTMLParser

from tidewell.operators import html_items

VOID = "area base br col embed hr img input link meta param source track wbr".split()


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.inside, self.pieces = tag, attrs, parent, [], []

    def text(self):
        return " ".join(self.pieces)

    def ancestors(self):
        node = self.parent
        while node:
            yield node
            node = node.parent


class Tree(HTMLParser):
    """Every element knows all elements inside it and all its texts: simple, and slow on nested pages."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.stack, self.links = [], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.stack[-1] if self.stack else None)
        for above in self.stack:
            above.inside.append(node)
        if tag == "a" and "href" in node.attrs:
            self.links.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in reversed(range(len(self.stack))):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if data.strip() and not (self.stack and self.stack[-1].tag in ("script", "style")):
            for node in self.stack:
                node.pieces.append(data.strip())


def slow(html):
    out = []
    for link in Tree(html).links:
        heading = next((n for n in link.inside if n.tag in ("h1", "h2", "h3", "h4")), None)
        shown = next((n for n in link.inside if n.tag == "time"), None)
        block = shown.parent if shown and shown.parent is not link else None
        title = heading.text() if heading else ""
        spans = [n.text() for n in link.inside if n.tag == "span" and n.text() and not (block and block in n.ancestors())]
        title = title or (spans[0] if spans else "")
        good = [t for t in (n.text() for n in link.inside if n.tag == "p") if t and t != title and not (len(t) < 30 and t.lower().rstrip(" .›→»") in html_items.ACTIONS)]
        out.append((link.attrs["href"], title, shown and (shown.attrs.get("datetime") or shown.text()).strip(), good[0] if good else ""))
    return out


def fast(html):
    page = html_items._Page()
    page.feed(html)
    page.close()
    return [(page.attrs[a]["href"], *page.describe(a)) for a in page.found["a"]]


PIECES = ['<a href="/{n}">', '<a href="/{n}">', "</a>", "<a name='x'>", "<h2>", "</h2>", "<h3></h3>", "<span>", "<span>", "</span>", "<div>", "</div>", "<time>", '<time datetime=" 2024-0{d}-01 ">', "</time>", "<p>", "<p>", "</p>", "<br>", "<img src=x>",
          "Read more »", "Learn More. ", "title", "title", "x &amp; y", " ", "long text of thirty characters and more", "<script>var a = '<a href=x>';</script>", "<!-- <p>no</p> -->", "</i>", "<b>", "<p/>", "MORE"]


def test_random_pages_equal_the_tree():
    rng, links = random.Random(7), 0
    for _ in range(10_000):
        html = "".join(rng.choice(PIECES).replace("{n}", str(rng.randint(0, 9))).replace("{d}", str(rng.randint(1, 9))) for _ in range(rng.randint(0, 40)))
        want = slow(html)
        assert fast(html) == want, html
        links += len(want)
    assert links > 10_000


def test_work_grows_with_the_page():
    def took(html):
        began = time.perf_counter()
        out = fast(html)
        return time.perf_counter() - began, out

    took("<a href=x>" + "<b>x " * 1000)
    for piece in ("<b>x ", "<b>x</i>", "<div><span>", "<p>Read more</p>", "<h2>", "<a name=x><time>"):
        few, _ = took('<a href="/1">' + piece * 10_000)
        many, out = took('<a href="/1">' + piece * 100_000)
        assert len(out) == 1 and many < 30 * few + 1, (piece, few, many)
    nested, out = took('<a href="/x"><h2>t</h2>' * 20_000)
    assert nested < 10 and len(out) == 20_000 and out[-1][1] == "t"


def test_deep_pages_in_a_job(spark):
    html = '<div><a href="/news/1"><h2>one</h2></a>' + "<i>deep " * 100_000 + '<a href="/news/2"><span>two</span><p>Read more</p><p>' + "an excerpt of a page that never closes anything " + "<b>"
    rows = spark.createDataFrame([("s", 0, "/news/", html), ("t", 1, "", None)], "id string, source_ord int, selector string, payload string")
    got = [(r.entry_ord, r.href, r.title, r.time, r.excerpt) for r in html_items.links(rows).orderBy("entry_ord").collect()]
    assert got == [(0, "/news/1", "one", None, ""), (1, "/news/2", "two", None, "an excerpt of a page that never closes anything")]
