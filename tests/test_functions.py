import pytest
from pyspark.sql import functions as F

from shelfmark.functions import urls as U
from shelfmark.functions import values as V


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://a.com/moto-g06-power-xt2535", "Moto G06 Power XT2535"),
        ("https://a.com/x/lg-thinq_v40.html", "LG ThinQ V40"),
        ("https://a.com", "Category"),
        ("https://a.com/", "Category"),
        ("not a url", "Scrape Job"),
        ("foo", "Scrape Job"),
        (None, "Scrape Job"),
        ("https://a.com/--__", "Scrape Job"),
    ],
)
def test_model_name(spark, url, expected):
    assert one(spark, U.model_name(F.col("u")), u=url) == expected


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://a.com/product/x", True),
        ("https://a.com/p/123", True),
        ("https://a.com/apple/x", True),
        ("https://a.com/x?id=5", True),
        ("https://a.com/x?a=1&id=5", False),
        ("https://a.com/x?a=1&product_id=5", True),
        ("https://a.com/products/12345", True),
        ("https://parts.site.com/replacement-parts/a-b-c", False),
        ("https://a.com/g-series/a-b-c", False),
        ("https://a.com/shop/a-b-c", False),
        ("https://a.com/a-b-c", True),
        ("https://a.com/a-b-c?category=2", False),
        ("https://a.com/plain", False),
        ("a-b-c", False),
        (None, False),
    ],
)
def test_is_product(spark, url, expected):
    assert one(spark, U.is_product(F.col("u"), site="site."), u=url) is expected


@pytest.mark.parametrize(
    ("value", "base", "expected"),
    [
        ("/a.jpg", "https://X.com/b/c", "https://x.com/a.jpg"),
        ("a.jpg", "https://x.com/b/c", "https://x.com/b/a.jpg"),
        ("../a b.jpg", "https://x.com/b/c/d", "https://x.com/b/a%20b.jpg"),
        ("//cdn.com/a", "http://x.com", "http://cdn.com/a"),
        ("HTTP://A.com:80", "", "http://a.com/"),
        ("data:image/png;base64,xx", "https://x.com", "data:image/png;base64,xx"),
        ("a.jpg", "", ""),
        ("", "https://x.com", ""),
        (None, "https://x.com", ""),
        ("http://[bad", "https://x.com", ""),
    ],
)
def test_absolute(spark, value, base, expected):
    assert one(spark, U.absolute(F.col("v"), F.col("b")), v=value, b=base) == expected


def test_normalized_and_displayed(spark):
    base = F.lit("https://x.com/")
    assert [one(spark, U.normalized(F.col("v"), base), v=v) for v in ("null", "undefined", "[object Object]", " ", " a.jpg ")] == ["", "", "", "", "https://x.com/a.jpg"]
    assert [one(spark, U.displayed(F.col("v"), F.lit("https://x.com")), v=v) for v in ("//c.com/a", "/a", "data:x", "http://q/")] == ["https://c.com/a", "https://x.com/a", "data:x", "http://q/"]


def test_names(spark):
    assert one(spark, U.slug(F.col("v")), v="  Ünïcode -- Nâme! ") == "unicode_name"
    assert one(spark, U.slug(F.col("v")), v="!!") == "item"
    assert one(spark, U.safe_id(F.col("v")), v="a/b c_1-2") == "abc_1-2"
    assert one(spark, U.archive_name(F.col("m"), F.col("i")), m="", i="9") == "job_9_9.zip"
    assert one(spark, U.image_filename(F.col("v"), F.lit(3)), v="https://x/a%20b+c.png?w=1") == "a b+c.png"
    assert one(spark, U.image_filename(F.col("v"), F.lit(3)), v="https://x/") == "image_3.jpg"
    assert one(spark, U.jpg_filename(F.col("v"), F.lit(1)), v="https://x/a.png") == "a.jpg"
    assert one(spark, U.jpg_filename(F.col("v"), F.lit(1)), v="https://x/a.JPEG") == "a.JPEG"
    assert one(spark, U.first_srcset(F.col("v")), v=" a.jpg 1x, b.jpg 2x") == "a.jpg"
    assert one(spark, U.css_url(F.col("v")), v="background-image: url('x.png')") == "x.png"


def test_values(spark):
    assert one(spark, V.trimmed(F.col("v")), v="﻿  a　") == "a"
    assert [one(spark, V.finite(F.col("v")), v=v) for v in (None, "", " 7 ", "x", "NaN", "1e400")] == [0, 0, 7, 0, 0, 0]
    assert [one(spark, V.log_level(F.col("v")), v=v) for v in ("WARN", "ok", "debug", None, "Error")] == ["warning", "success", "info", "info", "error"]
    assert one(spark, V.split_image_id(F.col("v")), v="a_b_3_4").asDict() == {"job_id": "a_b", "product_index": 3, "i": 4}
    assert [one(spark, V.error_kind(F.col("v")), v=v) for v in (None, "No such window", "Navigation timeout", "HTTP 429", "Stopped by user", "x")] == [None, "session_lost", "timeout", "blocked", "stopped", "other"]
    assert one(spark, V.percent(F.lit(1), F.lit(8)), v="") == 13
    assert one(spark, V.percent(F.lit(1), F.lit(0)), v="") == 0
