"""Stored pages (page_id, url, html): titles, product listings, candidate images by tiers.

One Arrow pass parses each page once and emits plain facts of the kind asked for: listing nodes by selector, or candidate URLs by tier
and place. Ranking, gating, filtering, resolving and fallbacks are DataFrame expressions on those facts.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.urls import absolute, css_url, first_srcset, resolve
from shelfmark.functions.values import filled, trimmed

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An open element of the key ends where one of these starts.
CLOSES = {"li": {"li"}, "p": {"p", "div", "ul", "ol", "h1", "h2", "h3", "table", "article", "section"}, "td": {"td", "tr"}, "tr": {"tr"}, "option": {"option"}}


class Node:
    """An element: the nodes and texts inside it are those from `at` + 1 and `text_at` up to `end` and `text_end`, in the page's order."""

    __slots__ = ("at", "attrs", "end", "tag", "text_at", "text_end")

    def __init__(self, tag: str, attrs: dict[str, str], at: int, text_at: int):
        self.tag, self.attrs, self.at, self.text_at = tag, attrs, at, text_at
        self.end, self.text_end = at + 1, text_at


STEP = re.compile(r"""([a-z0-9*]+)|\.([\w-]+)|(:not\()?\[([\w:-]+)(?:([*^]?=)"([^"]*)")?\]\)?""")


@functools.cache
def _chain(selector: str) -> list[list[tuple]]:
    """The steps of a selector, each as its tests."""
    return [[m.groups() for m in STEP.finditer(x)] for x in re.findall(r"(?:\"[^\"]*\"|\S)+", selector)]


class Selectors:
    """Selectors of one or two steps, found in one pass: a step is looked up by a class, tag or attribute that it asks for, as an element starts."""

    def __init__(self, selectors):
        self.steps: list[tuple] = []
        self.by: dict[str, dict[str, list[int]]] = {"class": {}, "tag": {}, "attr": {}}
        self.ends: dict[int, list[tuple[str, int | None]]] = {}
        self.around: set[int] = set()
        self.names = frozenset(selectors)
        known: dict[tuple, int] = {}
        for s in sorted(self.names):
            ids = []
            for tests in map(tuple, _chain(s)):
                if tests not in known:
                    known[tests] = len(self.steps)
                    self.steps.append(tests)
                    kind, name = min((0, cls) if cls else (1, tag) if tag else (2, attr) for tag, cls, no, attr, _, _ in tests if not no)
                    self.by[("class", "tag", "attr")[kind]].setdefault(name, []).append(known[tests])
                ids.append(known[tests])
            if len(ids) > 2:
                raise ValueError(f"a selector of more than two steps: {s}")
            self.ends.setdefault(ids[-1], []).append((s, ids[0] if len(ids) > 1 else None))
            self.around.update(ids[:-1])

    def passed(self, tag: str, attrs: dict[str, str]) -> list[int]:
        """The steps that an element passes."""
        found = list(self.by["tag"].get(tag, ()))
        classes = attrs["class"].split() if "class" in attrs else ()
        for c in dict.fromkeys(classes):
            found += self.by["class"].get(c, ())
        for a in attrs:
            found += self.by["attr"].get(a, ())
        return [k for k in found if all(_passes(tag, classes, attrs, t) for t in self.steps[k])]


def _passes(tag: str, classes, attrs: dict[str, str], test) -> bool:
    own, cls, no, attr, how, value = test
    if own:
        return tag == own
    if cls:
        return cls in classes
    held = attrs.get(attr)
    ok = held is not None and (not how or (how == "=" and held == value) or (how == "*=" and value in held) or (how == "^=" and held.startswith(value)))
    return ok != bool(no)


class Page(HTMLParser):
    """The elements of a page in its order, and where selectors find them; tags that are left open end where a browser would end them.

    Elements are a flat list, and what lies inside one is a range of it: however deep a page nests, nothing recurses. As an element starts its
    steps are looked up; a selector of two steps also asks whether an element of its first step is open."""

    def __init__(self, html: str, selectors: Selectors):
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.nodes: list[Node] = []
        self.texts: list[str] = []
        self.open: list[tuple[Node, list[int]]] = []
        self.n_open: dict[str, int] = {}
        self.n_around: dict[int, int] = dict.fromkeys(selectors.around, 0)
        self.selected: dict[str, list[int]] = {}
        self.feed(html)
        self.close()
        while self.open:
            self._shut()

    def _shut(self) -> None:
        node, steps = self.open.pop()
        node.end, node.text_end = len(self.nodes), len(self.texts)
        self.n_open[node.tag] -= 1
        for k in steps:
            self.n_around[k] -= 1

    def handle_starttag(self, tag, attrs):
        while self.open and tag in CLOSES.get(self.open[-1][0].tag, ()):
            self._shut()
        at = len(self.nodes)
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, at, len(self.texts))
        self.nodes.append(node)
        steps = self.selectors.passed(tag, node.attrs)
        for k in steps:
            for name, around in self.selectors.ends.get(k, ()):
                if around is None or self.n_around[around]:
                    self.selected.setdefault(name, []).append(at)
        if tag not in VOID:
            outer = [k for k in steps if k in self.n_around]
            for k in outer:
                self.n_around[k] += 1
            self.open.append((node, outer))
            self.n_open[tag] = self.n_open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.n_open.get(tag):
            while self.open[-1][0].tag != tag:
                self._shut()
            self._shut()

    def handle_data(self, data):
        self.texts.append(data)

    def text(self, node: Node) -> str:
        return "".join(self.texts[node.text_at : node.text_end])

    def select(self, selector: str) -> list[int]:
        """The nodes for one of the page's selectors, `tag.class[a][a="v"][a*="v"][a^="v"]:not([a*="v"])` with a blank for descent, in order."""
        if selector not in self.selectors.names:
            raise KeyError(selector)
        return self.selected.get(selector, [])

    def inside(self, node: Node, places: list[int]) -> list[int]:
        return places[bisect.bisect_right(places, node.at) : bisect.bisect_left(places, node.end)]

    def first_inside(self, node: Node, selector: str) -> Node | None:
        places = self.select(selector)
        i = bisect.bisect_right(places, node.at)
        return self.nodes[places[i]] if i < len(places) and places[i] < node.end else None


# Selectors, attributes and their order.
ITEMS = ["li.item", "[data-product-id]", "div.product-item", "article.product", "div.product"]
ZOOM = ["div.MagicScroll a.mz-thumb[href]", "div.MagicToolboxContainer a.MagicZoom[href]", "a.MagicZoom[href]", 'a[id^="MagicZoomPlusImage"][href]', 'a[href*="/catalog/product/image/"]']
GALLERY = [".gallery img[src]", ".product-gallery img[src]", ".product-images img[src]", ".product-image-container img[src]", ".images img[src]", ".photos img[src]", ".fotorama__img", ".slick-slide img", ".swiper-slide img", ".product-photo img", ".product-pic img"]
PLAIN = ['img:not([src*="logo"]):not([src*="icon"]):not([src*="svg"])']
PLAIN_ATTRS = ["src", "data-src", "data-zoom-image", "data-image", "data-original", "data-large", "data-original-src", "data-img-url", "data-full", "x-src"]
STYLED = ['[style*="background-image"]', '[class*="gallery"]', '[class*="image"]', '[class*="photo"]', '[class*="product"]']
MICRODATA = ['[itemtype*="schema.org/Product"] img[src]', '[itemtype*="schema.org/Product"] [itemprop="image"]']
META = ['meta[property="og:image"]', 'meta[name="twitter:image"]', 'meta[name="thumbnail"]', 'meta[property="og:image:url"]', 'link[rel="image_src"]', 'link[rel="apple-touch-icon"]']
DATA_ATTRS = ["data-image", "data-images", "data-src", "data-zoom-image", "data-product-img", "data-img", "data-image-url"]
VIDEO = ["video", "[data-video]", "[data-video-poster]"]
ANCHORS = ['a[href*=".jpg"]', 'a[href*=".jpeg"]', 'a[href*=".png"]', 'a[href*=".webp"]']
ITEM_NAMES, ITEM_PRICES = ["h2.product-name", "h2", "[data-name]"], ["span.regular-price", ".price", "[data-price]"]
ITEM_IMAGES, ITEM_LINKS = ["img.small-img", "img[data-src]", "img"], ["a.product-image.figure", 'a[href*="/product"]', "a[data-url]"]
#: Tiers that run only while fewer candidates are admitted.
LIMITS = {2: 20, 3: 20, 4: 30, 5: 20, 6: 20, 8: 30, 10: 30}
TIERS = 10
JSON_LD = 'script[type="application/ld+json"]'
FOR_IMAGES = Selectors([*ZOOM, *GALLERY, "picture", "source", "img", *PLAIN, *STYLED, JSON_LD, *MICRODATA, *META, *(f"[{a}]" for a in DATA_ATTRS), *VIDEO, *ANCHORS])
FOR_ITEMS = Selectors([*ITEMS, *ITEM_NAMES, *ITEM_PRICES, *ITEM_IMAGES, *ITEM_LINKS])



def structured(value) -> list[str]:
    """The URLs of a JSON-LD image or offers value. An array under `image` of an object is taken as its comma-joined text."""
    out, left = [], [value]
    while left:
        v = left.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, list):
            left.extend(reversed(v))
        elif isinstance(v, dict):
            plain = [",".join(map(str, x)) if isinstance(x, list) else x for k in ("url", "contentUrl", "image") if (x := v.get(k))]
            out += [x for x in plain if isinstance(x, str)]
            left.append(v.get("images"))
    return out


def candidates(page: Page, url: str) -> list[dict]:
    """(tier, url) in the order in which they are looked for. src and href of images and anchors as properties are resolved; attributes are raw."""
    nodes = page.nodes
    out: list[tuple[int, str]] = []

    def find(selectors, each_in_turn=True):
        if each_in_turn:
            return [nodes[i] for s in selectors for i in page.select(s)]
        return [nodes[i] for i in sorted({i for s in selectors for i in page.select(s)})]

    def first(n: Node, attrs) -> str:
        for a in attrs:
            if v := n.attrs.get(a):
                return resolve(v, url) if a == "src" and n.tag == "img" else v
        return ""

    def srcset(n: Node) -> list[str]:
        return n.attrs.get("srcset", "").split(",")[0].split()[:1]

    out += [(1, n.attrs["href"]) for n in find(ZOOM)]
    out += [(2, first(n, ["src", "data-src", "data-zoom-image", "data-original"])) for n in find(GALLERY)]
    for n in find(["picture"]):
        out += [(3, u) for i in page.inside(n, page.select("source")) for u in srcset(nodes[i])]
        out += [(3, v) for i in page.inside(n, page.select("img"))[:1] for a in ("src", "data-src", "data-zoom-image") if (v := first(nodes[i], [a]))]
    for n in find(PLAIN):
        out += [(4, v) for a in PLAIN_ATTRS if (v := first(n, [a]))]
        out += [(4, u) for u in srcset(n)]
    out += [(5, n.attrs["style"]) for n in find(STYLED, False) if "url(" in n.attrs.get("style", "")]
    for n in find([JSON_LD]):
        try:
            payload = json.loads(page.text(n) or "{}")
        except (ValueError, RecursionError):
            continue
        for top in payload if isinstance(payload, list) else [payload]:
            if isinstance(top, dict):
                out += [(6, u) for k in ("image", "offers") for u in structured(top.get(k))]
    out += [(6, first(n, ["src", "content", "data-src"])) for n in find(MICRODATA, False)]
    for s in META:
        out += [(7, n.attrs.get("content") or n.attrs.get("href") or "") for n in find([s])[:1]]
    out += [(8, n.attrs[a]) for n in find([f"[{a}]" for a in DATA_ATTRS], False) for a in DATA_ATTRS if n.attrs.get(a)]
    out += [(9, n.attrs[a]) for n in find(VIDEO, False) for a in ("poster", "data-video-poster", "data-thumbnail") if n.attrs.get(a)]
    out += [(10, first(n, ["href", "data-src", "data-image"])) for n in find(ANCHORS, False)]
    return [{"tier": t, "seq": i, "url": u} for i, (t, u) in enumerate(out) if u]


def listing(page: Page) -> list[dict]:
    """Nodes of every listing selector, with the facts that the item's columns are chosen from (null: no such node)."""
    out = []
    for rank, s in enumerate(ITEMS):
        for i, at in enumerate(page.select(s)):
            item = page.nodes[at]
            get = lambda selector, item=item: page.first_inside(item, selector)
            texts = lambda selectors, get=get: [page.text(n) if (n := get(x)) else None for x in selectors]
            shown = next((n for x in ITEM_IMAGES if (n := get(x))), None)
            links = [(n.attrs.get("data-url" if k == 2 else "href") if (n := get(x)) else None) for k, x in enumerate(ITEM_LINKS)]
            out.append({"rank": rank, "item": i, "names": texts(ITEM_NAMES), "prices": texts(ITEM_PRICES), "images": [shown.attrs.get(a) if shown else None for a in ("src", "data-src", "srcset", "data-lazy", "data-original")], "links": links})
    return out


#: What a page can be asked for: each kind of fact with its selectors and its type.
FOUND = pa.list_(pa.struct([("tier", pa.int32()), ("seq", pa.int32()), ("url", pa.string())]))
LISTED = pa.list_(pa.struct([("rank", pa.int32()), ("item", pa.int32()), *[(k, pa.list_(pa.string())) for k in ("names", "prices", "images", "links")]]))
KINDS = {
    "candidates": (candidates, FOR_IMAGES, FOUND, "array<struct<tier: int, seq: int, url: string>>"),
    "items": (lambda page, _: listing(page), FOR_ITEMS, LISTED, "array<struct<rank: int, item: int, names: array<string>, prices: array<string>, images: array<string>, links: array<string>>>"),
}


#: Pages whose facts are Python objects at the same time.
PAGES_AT_ONCE = 200


def _parse(kind: str):
    def run(batches):
        facts, selectors, type_, _ = KINDS[kind]
        for batch in (b.slice(i, PAGES_AT_ONCE) for b in batches for i in range(0, b.num_rows, PAGES_AT_ONCE)):
            urls, htmls = (batch.column(c).to_pylist() for c in ("url", "html"))
            found = pa.array([facts(Page(h or "", selectors), u or "") for u, h in zip(urls, htmls, strict=True)], type_)
            names = [c for c in batch.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], found], names=[*names, kind])

    return run


def parse_pages(pages: DataFrame, kind: str) -> DataFrame:
    """pages (url, html, ...) with their candidates or their items instead of html; other columns stay. A null html is an empty page."""
    out = T.StructType([*(f for f in pages.schema.fields if f.name != "html"), T.StructField(kind, T.DataType.fromDDL(KINDS[kind][3]))])
    return pages.mapInArrow(_parse(kind), out)


def title(html: Column) -> Column:
    return F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)


def is_challenge(text: Column) -> Column:
    """Whether a title is that of a page that checks the browser."""
    low = F.lower(text)
    return low.contains("just a moment") | low.contains("attention required") | low.contains("checking your browser")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href): the href of every anchor, in order, from the source text."""
    found = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("position", "href"))


def admitted(url: Column) -> Column:
    """Whether a trimmed candidate is an absolute or rooted URL, and no gif, svg or inline data."""
    return F.coalesce((url != "") & url.rlike(r"\Ahttps?://|\A/") & ~url.rlike(r"(?i)\.(gif|svg)\z") & ~url.startswith("data:"), F.lit(False))


def gate_tiers(found: Column) -> Column:
    """The admitted candidates in order, without repeats. A limited tier counts only if fewer than its limit were admitted before it began."""
    out = F.array().cast("array<string>")
    for tier in range(1, TIERS + 1):
        out = _union(out, _of_tier(found, tier), LIMITS.get(tier))
    return out


def _of_tier(found: Column, tier: int) -> Column:
    own = F.filter(found, lambda c: c["tier"] == tier)
    return F.filter(F.transform(own, lambda c: trimmed(css_url(c["url"]) if tier == 5 else c["url"])), admitted)


def _union(acc: Column, own: Column, limit: int | None) -> Column:
    # a one-step fold, so that what is gathered so far is evaluated once
    step = lambda a, urls: F.when(F.size(a) < limit, F.array_union(a, urls)).otherwise(a) if limit else F.array_union(a, urls)
    return F.aggregate(F.array(own), acc, step)


def scan_catalog_images(html: Column, needle: str = "/catalog/product/image/") -> Column:
    """Every token of the source that holds the needle: tokens end at quotes, white space, angle and round brackets. `&amp;` becomes `&`."""
    edge = r"""[^"' \n\r\t<>()]*"""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(f"{edge}{re.escape(needle)}{edge}"), F.lit(0)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))))


def looks_like_image(url: Column) -> Column:
    """Whether an absolute URL is kept: no thumbnail, gif or svg; catalog path, image extension, image-like query key or path segment."""
    bad = url.contains("/small_image/") | url.contains("/thumbnail/") | url.rlike(r"(?i)\.(gif|svg)\z")
    ext = r"\.(jpg|jpeg|png|webp|bmp|tiff|heic)"
    good = url.contains("/catalog/product/image/") | url.rlike(rf"(?i){ext}\z") | url.rlike(r"(?i)[?&](image|img|photo|picture|src|url|file|content)=") | url.rlike(r"(?i)/(image|img|photo|picture|asset|media|cdn|static|content)/") | url.rlike(rf"(?i)\Ahttps?://.*{ext}")
    return ~bad & good


def filter_image_urls(candidates_: DataFrame, rejected: bool = False) -> DataFrame:
    """(page_id, url, seq, candidate) -> (page_id, position, image_url): resolved, image-like, distinct in order.

    rejected: with n as well, the candidates that a row stands for, and as each page's last row those that are dropped, under a null image_url."""
    own = absolute(F.col("candidate"), F.col("url"))
    judged = candidates_.withColumn("image_url", own).withColumn("image_url", F.when((F.col("image_url") != "") & looks_like_image(F.col("image_url")), F.col("image_url")))
    kept = judged if rejected else judged.filter("image_url IS NOT NULL")
    first = kept.groupBy("page_id", "image_url").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    order = Window.partitionBy("page_id").orderBy(F.col("image_url").isNull(), "seq")
    return first.select("page_id", (F.row_number().over(order) - 1).cast("bigint").alias("position"), "image_url", *(["n"] if rejected else []))


def page_candidates(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html), batch or stream -> (page_id, url, seq, candidate): the gated tiers, or the source scan where they give nothing; none for challenge pages."""
    usable = pages.filter(~is_challenge(title(F.col("html"))))  # before the parse
    facts = parse_pages(usable.select(F.col("page_id").cast("long").alias("page_id"), "url", scan_catalog_images(F.col("html")).alias("scanned"), "html"), "candidates")
    gated = facts.withColumn("found", gate_tiers(F.col("candidates")))
    return gated.select("page_id", "url", F.posexplode(F.when(F.size("found") > 0, F.col("found")).otherwise(F.col("scanned"))).alias("seq", "candidate"))


def extract_images(pages: DataFrame) -> DataFrame:
    """pages -> (page_id, position, image_url), by all of the above."""
    return filter_image_urls(page_candidates(pages))


def image_filter_stats(pages: DataFrame) -> DataFrame:
    """(page_id, candidates, kept): how many candidates filter_image_urls gets of a page, and to how many positions it brings them."""
    found = filter_image_urls(page_candidates(pages), rejected=True)
    return found.groupBy("page_id").agg(F.sum("n").alias("candidates"), F.count(F.when(F.col("image_url").isNotNull(), F.col("position"))).alias("kept"))


def extract_listing(pages: DataFrame) -> DataFrame:
    """pages -> (page_id, url, item, name, price, img, product_url), raw, by the first selector that a page has any node for."""
    own = parse_pages(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), "items")
    best = own.withColumn("best", F.array_min(F.transform("items", lambda i: i["rank"])))
    items = best.select("page_id", "url", "best", F.explode("items").alias("i")).filter(F.col("i.rank") == F.col("best"))
    # the first text that isn't empty, but the first price node that exists
    name = F.coalesce(*[F.nullif(trimmed(F.col("i.names")[k]), F.lit("")) for k in range(3)], F.lit(""))
    price = trimmed(F.coalesce(*[F.col("i.prices")[k] for k in range(3)], F.lit("")))
    img = F.coalesce(*[F.nullif(first_srcset(F.col("i.images")[k]), F.lit("")) for k in range(5)], F.lit(""))
    link = filled(*[F.col("i.links")[k] for k in range(3)], F.lit(""))
    return items.select("page_id", "url", F.col("i.item").cast("bigint").alias("item"), name.alias("name"), price.alias("price"), img.alias("img"), link.alias("product_url"))


def resolve_listing(items: DataFrame) -> DataFrame:
    """Links resolved against the page; an image that can't be resolved keeps its text."""
    return items.withColumns({"product_url": absolute(F.col("product_url"), F.col("url")), "img": filled(absolute(F.col("img"), F.col("url")), F.col("img"))})


def enrich_listing(items: DataFrame, page_images: DataFrame, pages: DataFrame) -> DataFrame:
    """Resolved items with images (array, in order) of the stored page of their product_url; empty where no page is stored.

    Of several stored pages of one URL the one with the largest page_id counts."""
    last = pages.groupBy(F.col("url").alias("product_url")).agg(F.max("page_id").alias("page_id"))
    own = page_images.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("position", "image_url"))).alias("i"))
    images = last.join(own, "page_id").select("product_url", F.transform("i", lambda x: x["image_url"]).alias("source_images"))
    return items.join(images, "product_url", "left").withColumn("source_images", F.coalesce("source_images", F.array().cast("array<string>")))


def missing_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(product_url) of items that no stored page has."""
    return items.select("product_url").filter("product_url <> ''").distinct().join(pages.select(F.col("url").alias("product_url")).distinct(), "product_url", "left_anti")
