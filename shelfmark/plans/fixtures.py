"""Jobs, products, images, logs, updates, requests, metrics and catalogue pages derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.shared import spread, table

SHOP = "https://shop.example.com"
NOW = "1998-12-01 00:00:00"
LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    third = F.when(key % 3 == 0, "failed").when(key % 3 == 1, "queued").otherwise("paused")
    state = F.when(status == "F", "completed").when(status == "O", "running").otherwise(third)
    total = key % 9
    return o.select(
        key.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("user_id"), F.concat(F.lit(f"{SHOP}/g-series/part-"), (key % 700).cast("string")).alias("url"), state.alias("status"),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("Part "), (key % 700).cast("string"))).alias("model"), (key % 40).alias("images"), total.alias("total_items"), F.when(state == "completed", total).otherwise(F.expr("(o_orderkey % 9) div 2")).alias("processed_items"),
        F.when(state == "failed", "Timed out").otherwise("").alias("error"), F.col("o_orderdate").alias("created_at"), F.timestamp_add("MINUTE", (key % 5000).cast("int"), F.col("o_orderdate")).alias("updated_at"), F.timestamp_add("MINUTE", (key % 90).cast("int"), F.col("o_orderdate")).alias("started_at"),
    )


JOBS = f"""jobs AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id, '{SHOP}/g-series/part-' || (o_orderkey % 700) AS url,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 3 = 1 THEN 'queued' ELSE 'paused' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Part ' || (o_orderkey % 700) END AS model, o_orderkey % 40 AS images, o_orderkey % 9 AS total_items,
  CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 9 ELSE (o_orderkey % 9) // 2 END AS processed_items,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 3 = 0 THEN 'Timed out' ELSE '' END AS error,
  o_orderdate AS created_at, o_orderdate + to_minutes(o_orderkey % 5000) AS updated_at, o_orderdate + to_minutes(o_orderkey % 90) AS started_at FROM orders)"""


def products(spark: SparkSession, sf: str) -> DataFrame:
    """(job_id, product_index, name, price, img, images, shipped, partkey), one for each line of an order.

    Parts are joined before lines are numbered, and lines are dealt by job_id, as most that follows is: a part is a list, so that its lines stay single until they have their numbers."""
    p = table(spark, sf, "part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.collect_list(F.struct(F.col("p_name").alias("name"), "p_retailprice")).alias("part"))
    line = table(spark, sf, "lineitem").select("l_orderkey", *LINE).join(p, "l_partkey", "left").withColumn("job_id", F.col("l_orderkey").cast("string"))
    line = line.withColumn("product_index", (F.row_number().over(Window.partitionBy("job_id").orderBy(*LINE)) - 1).cast("bigint"))
    url = lambda i: F.concat(F.lit("/media/"), F.col("l_partkey").cast("string"), F.lit("_"), (i % 2).cast("string"), F.lit(".jpg"))
    n = (F.col("l_quantity") % 4).cast("int")
    urls = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), url)).otherwise(F.array().cast("array<string>"))
    out = line.select("job_id", "product_index", "l_partkey", "l_quantity", "l_shipdate", F.inline("part"))
    return out.select("job_id", "product_index", "name", F.format_string("$%.2f", "p_retailprice").alias("price"), F.when(F.col("l_partkey") % 2 == 0, url(F.lit(0))).otherwise("").alias("img"), urls.alias("images"), F.col("l_shipdate").alias("shipped"), F.col("l_partkey").alias("partkey"))


PRODUCTS = f"""products AS (SELECT CAST(l_orderkey AS VARCHAR) AS job_id, l_orderkey, product_index, p_name AS name, l_partkey AS partkey, l_shipdate AS shipped,
  CASE WHEN l_partkey % 2 = 0 THEN '/media/' || l_partkey || '_0.jpg' ELSE '' END AS img, CAST(l_quantity AS BIGINT) % 4 AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE)}) - 1 AS product_index FROM lineitem) l JOIN part ON p_partkey = l_partkey)"""


def images(spark: SparkSession, sf: str) -> DataFrame:
    p = products(spark, sf).select("job_id", "product_index", F.col("name").alias("product_name"), "shipped", "partkey", F.posexplode("images").alias("position", "url"))
    ok = (F.col("partkey") + F.col("position")) % 3 != 0
    return p.select(
        "job_id", "product_index", "product_name", F.col("position").cast("bigint").alias("position"), "url", F.concat_ws("_", "job_id", F.col("product_index").cast("string"), F.col("position").cast("string")).alias("id"), ok.alias("converted"), F.when(ok, F.col("partkey") * 10 + F.col("position")).alias("size"), F.when(~ok, "HTTP 403").alias("error"), F.when(F.col("partkey") % 11 != 0, F.col("shipped")).alias("created_at"),
    )


IMAGES = PRODUCTS + """, images AS (SELECT job_id, product_index, name AS product_name, i AS position, '/media/' || partkey || '_' || (i % 2) || '.jpg' AS url,
  job_id || '_' || product_index || '_' || i AS id, (partkey + i) % 3 <> 0 AS converted, CASE WHEN (partkey + i) % 3 <> 0 THEN partkey * 10 + i END AS size,
  CASE WHEN (partkey + i) % 3 = 0 THEN 'HTTP 403' END AS error, CASE WHEN partkey % 11 <> 0 THEN shipped END AS created_at
  FROM (SELECT *, unnest(range(n)) AS i FROM products))"""


def logs(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "info").when(F.col("event_type") == "click", "warn").when(F.col("event_type") == "purchase", "ok").otherwise("debug")
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("time"), level.alias("level"), F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source"), F.col("event_type").alias("message"), F.when(F.col("user_id") % 3 == 0, F.col("user_id").cast("string")).alias("job_id"))


LOGS = """logs AS (SELECT event_id AS seq, ts AS time, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' WHEN 'purchase' THEN 'success' ELSE 'info' END AS level,
  'src' || (user_id % 5) AS source, event_type AS message, CASE WHEN user_id % 3 = 0 THEN CAST(user_id AS VARCHAR) END AS job_id FROM events)"""


def updates(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "running").when(kind == "click", "paused").when(kind == "signup", "queued").when(kind == "purchase", "completed").otherwise("failed")
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), status.alias("status"), F.floor("value").cast("bigint").alias("images"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))


UPDATES = """updates AS (SELECT CAST(user_id AS VARCHAR) AS id, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused' WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
  CAST(floor(value) AS BIGINT) AS images, ts AS updated_at, event_id AS seq FROM events)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    url = F.when(F.col("event_id") % 50 != 0, F.concat(F.lit(f"{SHOP}/g-series/part-"), (F.col("event_id") % 200).cast("string")))
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("user_id"), (F.col("event_id") % 900).cast("string").alias("job_id"), url.alias("url"), F.col("ts").alias("requested_at"))


REQUESTS = f"""requests AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS user_id, CAST(event_id % 900 AS VARCHAR) AS job_id,
  CASE WHEN event_id % 50 <> 0 THEN '{SHOP}/g-series/part-' || (event_id % 200) END AS url, ts AS requested_at FROM events)"""


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("host"), F.col("ts"), F.col("event_id").alias("seq"), F.floor("value").cast("bigint").alias("heap_used_mb"), F.lit(500).cast("bigint").alias("heap_total_mb"))


def category_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A category page for each brand and block of 200 parts, with every part as a listing item."""
    p = table(spark, sf, "part")
    item = F.concat(F.lit('<li class="item"><h2 class="product-name"> '), F.col("p_name"), F.lit(' </h2><span class="regular-price">$'), F.format_string("%.2f", "p_retailprice"), F.lit('</span><a class="product-image figure" href="/parts/'), F.col("p_partkey").cast("string"), F.lit('"><img class="small-img" src="/media/'), F.col("p_partkey").cast("string"), F.lit('.jpg, /big.jpg 2x"></a>'))
    block = p.groupBy("p_brand", F.expr("p_partkey div 200").alias("b")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))).alias("items"))
    html = F.concat(F.lit("<html><title>List</title><body><ul>"), F.array_join(F.transform("items", lambda x: x["item"]), ""), F.lit("</ul></body></html>"))
    return block.select(F.xxhash64("p_brand", "b").alias("page_id"), F.concat(F.lit(f"{SHOP}/c/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), F.col("b").cast("string")).alias("url"), html.alias("html"))


def product_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each part; by p_size % 4: zoom anchors, gallery images, og:image, or links in the source only."""
    p = spread(table(spark, sf, "part"), "p_partkey")
    key = F.col("p_partkey").cast("string")
    body = (
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit('<div class="MagicScroll"><a class="mz-thumb" href="/media/catalog/product/image/'), key, F.lit('_a.jpg">x</a><a class="mz-thumb" href="/media/catalog/product/image/'), key, F.lit('_b.jpg">y</a><a class="mz-thumb" href="/media/'), key, F.lit('.gif">z</a></div>')))
        .when(F.col("p_size") % 4 == 1, F.concat(F.lit('<div class="gallery"><img src="img/'), key, F.lit('.png"><img src="/thumbnail/'), key, F.lit('.png"></div>')))
        .when(F.col("p_size") % 4 == 2, F.concat(F.lit('<meta property="og:image" content="https://cdn.example.com/'), key, F.lit('.webp">')))
        .otherwise(F.concat(F.lit('<script>var a="/media/catalog/product/image/'), key, F.lit('.jpg?w=1&amp;h=2";</script>')))
    )
    return p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit(f"{SHOP}/parts/"), key).alias("url"), F.concat(F.lit("<html><title>"), F.col("p_name"), F.lit("</title><body>"), body, F.lit("</body></html>")).alias("html"))


def held_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The product pages that a store holds: it lacks those of the parts whose key ends with 9."""
    return product_pages(spark, sf).filter("page_id % 10 <> 9")


#: What held_pages hold, computed from part.
PAGE_IMAGES = f"""page_images AS (
  SELECT p_partkey AS page_id, 0 AS position, '{SHOP}/media/catalog/product/image/' || p_partkey || '_a.jpg' AS image_url FROM part WHERE p_partkey % 10 <> 9 AND p_size % 4 = 0
  UNION ALL SELECT p_partkey, 1, '{SHOP}/media/catalog/product/image/' || p_partkey || '_b.jpg' FROM part WHERE p_partkey % 10 <> 9 AND p_size % 4 = 0
  UNION ALL SELECT p_partkey, 0, '{SHOP}/parts/img/' || p_partkey || '.png' FROM part WHERE p_partkey % 10 <> 9 AND p_size % 4 = 1
  UNION ALL SELECT p_partkey, 0, 'https://cdn.example.com/' || p_partkey || '.webp' FROM part WHERE p_partkey % 10 <> 9 AND p_size % 4 = 2
  UNION ALL SELECT p_partkey, 0, '{SHOP}/media/catalog/product/image/' || p_partkey || '.jpg?w=1&h=2' FROM part WHERE p_partkey % 10 <> 9 AND p_size % 4 = 3)"""
#: What product_pages hold.
ALL_PAGE_IMAGES = PAGE_IMAGES.replace("p_partkey % 10 <> 9 AND ", "")


def _cases(test, *cases):
    out = F.when(test == 0, cases[0])
    for i, c in enumerate(cases[1:], 1):
        out = out.when(test == i, c)
    return out


def tier_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each part; by p_partkey % 10 its images are in a picture, attributes, a style, JSON-LD, microdata, data attributes, a video, anchors, all over a tier's limit, or meta tags."""
    p = spread(table(spark, sf, "part"), "p_partkey")
    key = F.col("p_partkey").cast("string")
    html = lambda text: F.replace(F.lit(text), F.lit("KEY"), key)
    body = _cases(
        F.col("p_partkey") % 10,
        html('<picture><source srcset="/p/KEY-a.webp 1x, /p/KEY-b.webp 2x"><img data-src="/p/KEY-c.jpg"></picture>'),
        html('<img data-large="/m/KEY.jpg" srcset="/m/KEY-s.png 2x, /x.png"><img src="/logo-KEY.png">'),
        html("""<div class="product" style="background-image:url('/bg/KEY.jpg')"></div>"""),
        html('<script type="application/ld+json">{"image": ["/j/KEY-1.jpg", {"url": "/j/KEY-2.jpg", "images": ["/j/KEY-3.jpg"]}], "offers": {"url": "/buy/KEY"}}</script>'),
        html('<div itemtype="https://schema.org/Product"><meta itemprop="image" content="/mi/KEY.jpg"></div>'),
        html('<div data-product-img="/d/KEY.jpg" data-img="/thumbnail/KEY.jpg"></div>'),
        html('<video poster="/v/KEY.jpg"></video>'),
        html('<a href="/x/KEY.jpeg?q=1">z</a>'),
        html('<div class="MagicScroll">' + "".join(f'<a class="mz-thumb" href="/z/KEY-{i}.jpg">x</a>' for i in range(20)) + '</div><div class="product" style="background-image:url(/no/KEY.jpg)"></div><img data-large="/c/KEY.jpg"><div data-image="/d/KEY.jpg"></div>'),
        html('<meta property="og:image" content="/og/KEY.jpg"><meta property="og:image" content="/og2/KEY.jpg"><link rel="image_src" href="/ls/KEY.png">'),
    )
    return p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit(f"{SHOP}/parts/"), key).alias("url"), F.concat(F.lit("<html><title>x</title><body>"), body).alias("html"))


_ZOOMED = ", ".join(f"'/z/' || k || '-{i}.jpg'" for i in range(20))
TIER_IMAGES = f"""tier_images AS (SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS position, '{SHOP}' || unnest(l) AS image_url FROM (SELECT p_partkey AS page_id, CASE p_partkey % 10
  WHEN 0 THEN ['/p/' || k || '-a.webp', '/p/' || k || '-c.jpg'] WHEN 1 THEN ['/m/' || k || '.jpg', '/m/' || k || '-s.png'] WHEN 2 THEN ['/bg/' || k || '.jpg']
  WHEN 3 THEN ['/j/' || k || '-1.jpg', '/j/' || k || '-2.jpg', '/j/' || k || '-3.jpg'] WHEN 4 THEN ['/mi/' || k || '.jpg'] WHEN 5 THEN ['/d/' || k || '.jpg'] WHEN 6 THEN ['/v/' || k || '.jpg']
  WHEN 7 THEN ['/x/' || k || '.jpeg?q=1'] WHEN 8 THEN [{_ZOOMED}, '/c/' || k || '.jpg', '/d/' || k || '.jpg'] ELSE ['/og/' || k || '.jpg', '/ls/' || k || '.png'] END AS l
  FROM (SELECT *, CAST(p_partkey AS VARCHAR) AS k FROM part)))"""


def branch_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A listing page for each part; by p_partkey % 5 another selector finds its item, and other nodes hold name, price, image and link."""
    p = spread(table(spark, sf, "part"), "p_partkey")
    key = F.col("p_partkey").cast("string")
    html = lambda text: F.replace(F.replace(F.lit(text), F.lit("KEY"), key), F.lit("NAME"), F.col("p_name"))
    body = _cases(
        F.col("p_partkey") % 5,
        html('<li class="item"><h2>NAME</h2><b class="price"> $KEY </b><img data-src="/i/KEY.jpg"><a href="/product/KEY">x</a></li>'),
        html('<div data-product-id="KEY"><i data-name="1">NAME</i><i data-price="1">KEY</i><img srcset="/i/KEY.jpg 1x, /j.jpg"><a data-url="/u/KEY">x</a></div>'),
        html('<div class="product-item"><h2 class="product-name"> </h2><h2>NAME</h2><img data-original="/o/KEY.png"></div>'),
        html('<article class="product"><h2 class="product-name">NAME</h2><span class="regular-price"></span><i class="price">KEY</i><img src="/no.jpg"><img class="small-img" data-lazy="/l/KEY.jpg"><a class="product-image figure" href="/f/KEY">x</a></article>'),
        html('<div class="product"><h2>late</h2></div><article class="product"><h2>NAME</h2></article>'),
    )
    return p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit(f"{SHOP}/l/"), key).alias("url"), body.alias("html"))


BRANCH_ITEMS = f"""branch_items AS (SELECT p_partkey AS page_id, CASE WHEN p_partkey % 5 = 2 THEN '' ELSE trim(p_name) END AS name, CASE p_partkey % 5 WHEN 0 THEN '$' || p_partkey WHEN 1 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS price,
  CASE p_partkey % 5 WHEN 0 THEN '{SHOP}/i/' || p_partkey || '.jpg' WHEN 1 THEN '{SHOP}/i/' || p_partkey || '.jpg' WHEN 2 THEN '{SHOP}/o/' || p_partkey || '.png' WHEN 3 THEN '{SHOP}/l/' || p_partkey || '.jpg' ELSE '' END AS img,
  CASE p_partkey % 5 WHEN 0 THEN '{SHOP}/product/' || p_partkey WHEN 1 THEN '{SHOP}/u/' || p_partkey WHEN 3 THEN '{SHOP}/f/' || p_partkey ELSE '' END AS product_url FROM part)"""


def image_files(spark: SparkSession, sf: str) -> DataFrame:
    """(s_suppkey, content): the header of a picture for each supplier; by s_suppkey % 7 a PNG, JPEG, GIF, WebP (lossy, lossless, extended), or a PNG cut off in its size."""
    s = spread(table(spark, sf, "supplier"), "s_suppkey")
    w, h = 1 + F.col("s_suppkey") % 5000, 1 + F.col("s_nationkey").cast("long") * 11
    big = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    little = lambda x, n: F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * i) % 256), 2, "0") for i in range(n)])
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), F.lit("0806000000"))
    riff = lambda kind, rest: F.concat(F.lit(f"52494646000000005745425056503{kind}00000000"), rest)
    content = _cases(
        F.col("s_suppkey") % 7,
        png,
        F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFFFDB000500C0C2FFC2000B08"), big(h, 2), big(w, 2), F.lit("01011100FFD9")),
        F.concat(F.lit("474946383961"), little(w, 2), little(h, 2), F.lit("000000")),
        riff("820", F.concat(F.lit("3000009D012A"), little(w, 2), little(h, 2))),
        riff("84C", F.concat(F.lit("2F"), little((w - 1) + (h - 1) * 16384, 4))),
        riff("858", F.concat(F.lit("00000000"), little(w - 1, 3), little(h - 1, 3))),
        F.substring(png, 1, 40),
    )
    return s.select("s_suppkey", F.unhex(content).alias("content"))
