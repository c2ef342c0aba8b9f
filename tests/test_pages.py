import pytest
from pyspark.sql import functions as F

from shelfmark.operators import pages as P

BASE = "https://shop.example.com/p/x"


def images(spark, html):
    df = spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string")
    return [r.image_url for r in P.extract_images(df).orderBy("position").collect()]


def gate(spark, found):
    df = spark.createDataFrame([([{"tier": t, "seq": i, "url": u} for i, (t, u) in enumerate(found)],)], "c array<struct<tier: int, seq: int, url: string>>")
    return df.select(P.gate_tiers(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ('<div class="MagicScroll"><a class="mz-thumb" href="/media/a.jpg">', ["https://shop.example.com/media/a.jpg"]),
        ('<div class="gallery"><img src="a.png"></div>', ["https://shop.example.com/p/a.png"]),
        ('<div class="gallery"><img src="" data-src="a.png"></div>', []),
        ('<picture><source srcset="/s.webp 1x, /t.webp 2x"><img data-src="/u.webp"></picture>', ["https://shop.example.com/s.webp", "https://shop.example.com/u.webp"]),
        ('<img src="/logo.png"><img data-large="/b.jpg">', ["https://shop.example.com/b.jpg"]),
        ("""<div class="product" style="background-image:url('/bg.jpg')"></div>""", ["https://shop.example.com/bg.jpg"]),
        ('<script type="application/ld+json">{"image": ["/a.jpg", {"url": "/b.jpg", "images": ["/c.jpg"]}], "offers": {"url": "/buy"}}</script>', ["https://shop.example.com/a.jpg", "https://shop.example.com/b.jpg", "https://shop.example.com/c.jpg"]),
        ('<script type="application/ld+json">{bad</script>', []),
        ('<script type="application/ld+json">{"@graph": [{"image": "/a.jpg"}]}</script>', []),
        ('<div itemtype="https://schema.org/Product"><meta itemprop="image" content="/m.jpg"></div>', ["https://shop.example.com/m.jpg"]),
        ('<meta property="og:image" content="/og.jpg"><meta property="og:image" content="/og2.jpg">', ["https://shop.example.com/og.jpg"]),
        ('<div data-product-img="/d.jpg"></div>', ["https://shop.example.com/d.jpg"]),
        ('<video poster="/v.jpg"></video>', ["https://shop.example.com/v.jpg"]),
        ('<a href="/x/z.jpeg?q=1">z</a>', ["https://shop.example.com/x/z.jpeg?q=1"]),
        ('<p>"/catalog/product/image/1.jpg?a=1&amp;b=2" (https://c.com/catalog/product/image/2.jpg)', ["https://shop.example.com/catalog/product/image/1.jpg?a=1&b=2", "https://c.com/catalog/product/image/2.jpg"]),
        ('<title>Just a moment...</title><meta property="og:image" content="/og.jpg">', []),
        ('<meta property="og:image" content="/thumbnail/og.jpg">', []),
        ("", []),
        (None, []),
        ("<p><b>open<br><p>x</p>", []),
    ],
)
def test_tiers(spark, html, expected):
    assert images(spark, html) == expected


def test_gating(spark):
    ones = [(1, f"/a{i}") for i in range(20)]
    assert len(gate(spark, ones[:19] + [(2, f"/b{i}") for i in range(5)])) == 24  # a tier that has begun may overshoot
    assert len(gate(spark, ones + [(2, "/b")])) == 20
    assert len(gate(spark, ones + [(4, f"/c{i}") for i in range(9)] + [(8, "/d1"), (8, "/d2"), (10, "/e")])) == 31
    assert len(gate(spark, ones + [(4, f"/c{i}") for i in range(10)] + [(8, "/d"), (10, "/e"), (9, "/v"), (7, "/o")])) == 32
    assert gate(spark, [(1, " /a "), (1, "/a"), (1, "b"), (1, "//h/x"), (1, "data:x"), (1, "/x.GIF"), (1, "/x.gif?x=1")]) == ["/a", "//h/x", "/x.gif?x=1"]
    assert gate(spark, []) == []


def test_listing(spark):
    html = '<ul><li class="item"><h2 class="product-name"> </h2><span class="regular-price"></span><i class="price">9</i><img srcset="/i.jpg 1x, /j.jpg"><a data-url="/u">x</a></ul><div class="product">late</div>'
    df = spark.createDataFrame([(1, BASE, html), (2, BASE, "<div class='product-item'><h2>Name</h2><a href='/product/7'>x</a></div>"), (3, BASE, None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in P.resolve_listing(P.extract_listing(df)).collect()}
    assert (rows[1].name, rows[1].price, rows[1].img, rows[1].product_url) == ("", "", "https://shop.example.com/i.jpg", "https://shop.example.com/u")
    assert (rows[2].name, rows[2].product_url) == ("Name", "https://shop.example.com/product/7")
    assert set(rows) == {1, 2}


def test_a_very_deep_page(spark):
    html = "<div class='gallery'>" * 100_000 + "<img src='a.png'>"
    assert images(spark, html) == ["https://shop.example.com/p/a.png"]


def test_one_stored_page_a_url(spark):
    pages = spark.createDataFrame([(1, "u"), (2, "u")], "page_id long, url string")
    own = spark.createDataFrame([(1, 0, "old"), (2, 0, "a"), (2, 1, "b")], "page_id long, position long, image_url string")
    items = spark.createDataFrame([("u",), ("v",)], "product_url string")
    assert {(r.product_url, *r.source_images) for r in P.enrich_listing(items, own, pages).collect()} == {("u", "a", "b"), ("v",)}
