"""Products and images of jobs, flat and nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.urls import absolute, normalized
from shelfmark.functions.values import filled, image_id, trimmed
from shelfmark.shared import written


def flatten_images(jobs: DataFrame) -> DataFrame:
    """jobs (id, products: array of (name, images: array of struct)) -> a row an image with job_id, product_index and position from 0, product_name, and the image's fields."""
    products = jobs.select(F.col("id").alias("job_id"), F.posexplode("products").alias("product_index", "p"))
    images = products.select("job_id", F.col("product_index").cast("bigint").alias("product_index"), F.col("p.name").alias("product_name"), F.posexplode("p.images").alias("position", "image"))
    return images.select("job_id", "product_index", "product_name", F.col("position").cast("bigint").alias("position"), "image.*")


def display_url(image: Column, job_id: Column, api: str, base: Column) -> Column:
    """Where to show an image struct (id, converted, original_url, url): its converted copy, else its first URL."""
    encoded = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    local = F.concat(F.lit(f"{api}/jobs/"), encoded(job_id), F.lit("/images/"), encoded(image["id"]))
    converted = F.coalesce(image["converted"], F.lit(False)) & (F.coalesce(job_id, F.lit("")) != "") & (F.coalesce(image["id"], F.lit("")) != "")
    return normalized(F.when(converted, local).otherwise(filled(image["original_url"], image["url"])), base)


def normalize_products(products: DataFrame, base: Column) -> DataFrame:
    """products (name, title, price, product_url, img, images: array<string>, source_images) with clean texts and distinct URLs in their first order.

    URLs are resolved on exploded rows, so that one Python batch serves all, and put together again by row. Rows are numbered in
    a written table, as a plan that is run again may deal them otherwise."""
    keyed = written(products.withColumn("_row", F.monotonically_increasing_id()), "products")

    def urls(name: str) -> DataFrame:
        flat = keyed.select("_row", F.posexplode(name).alias("_at", "_url")).withColumn("_url", normalized(F.col("_url"), base)).filter("_url <> ''")
        return flat.groupBy("_row").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_url"))), lambda x: x["_url"])).alias(name))

    out = keyed.drop("images", "source_images").join(urls("images"), "_row", "left").join(urls("source_images"), "_row", "left")
    title = F.col("title") if "title" in products.columns else F.lit("")
    none = F.array().cast("array<string>")
    return out.withColumns({"name": trimmed(filled(F.col("name"), title, F.lit(""))), "price": trimmed(F.coalesce("price", F.lit(""))), "product_url": normalized(F.col("product_url"), base), "img": normalized(F.col("img"), base), "images": F.coalesce("images", none), "source_images": F.coalesce("source_images", none)}).drop("_row")


def gallery(products: DataFrame) -> DataFrame:
    """products (job_id, product_index, img, images: array<string>) -> (job_id, position, url): a job's distinct URLs in the order first seen; a product without images gives its img."""
    listed = F.when(F.coalesce(F.size("images"), F.lit(0)) > 0, F.col("images")).when(F.coalesce("img", F.lit("")) != "", F.array("img")).otherwise(F.array().cast("array<string>"))
    flat = products.select("job_id", "product_index", F.posexplode(listed).alias("at", "url")).filter("url <> ''")
    first = flat.groupBy("job_id", "url").agg(F.min(F.struct("product_index", "at")).alias("first"))
    return first.select("job_id", (F.row_number().over(Window.partitionBy("job_id").orderBy("first")) - 1).cast("bigint").alias("position"), "url")


def distinct_sources(products: DataFrame) -> DataFrame:
    """(job_id, product_index, name, sources): the source URLs of each product, without blanks and repeats, in order."""
    return products.select("job_id", "product_index", "name", F.array_distinct(F.filter(F.coalesce("images", F.array().cast("array<string>")), lambda u: F.coalesce(trimmed(u), F.lit("")) != "")).alias("sources"))


def number_images(products: DataFrame) -> DataFrame:
    """A row for each distinct source of a product: job_id, product_index, id {job}_{product}_{i} with i from 0, index from 1, url."""
    flat = distinct_sources(products).select("job_id", "product_index", F.posexplode("sources").alias("i", "url"))
    return flat.select("job_id", "product_index", image_id(F.col("job_id"), F.col("product_index"), F.col("i")).alias("id"), (F.col("i") + 1).cast("bigint").alias("index"), "url")


def images_per_job(products: DataFrame) -> DataFrame:
    return products.groupBy("job_id").agg(F.sum(F.coalesce(F.size("images"), F.lit(0))).cast("bigint").alias("images"))


def progress(products: DataFrame) -> DataFrame:
    """After each product: processed products and images so far of its job."""
    w = Window.partitionBy("job_id").orderBy("product_index").rowsBetween(Window.unboundedPreceding, 0)
    return products.select("job_id", "product_index", F.count("*").over(w).alias("processed"), F.sum(F.coalesce(F.size("images"), F.lit(0))).over(w).cast("bigint").alias("images_so_far"))


def conversion_stats(images: DataFrame) -> DataFrame:
    """(job_id, product_index, converted, failed): per product, and with a null product_index per job."""
    bad = F.coalesce("error", F.lit("")) != ""
    return images.rollup("job_id", "product_index").agg(F.count_if(F.coalesce("converted", F.lit(False))).alias("converted"), F.count_if(bad).alias("failed")).filter("job_id IS NOT NULL")


def attach_conversion(images: DataFrame, results: DataFrame) -> DataFrame:
    """images with the outcome of results (job_id, url, success, size, quality, error): size and quality only where converted, error only where not.

    Of several results of one URL a success counts before a failure, then the largest size, quality and error."""
    r = results.groupBy("job_id", "url").agg(F.max(F.struct("success", "size", "quality", "error")).alias("r"))
    r = r.select("job_id", "url", F.col("r.success").alias("_ok"), F.col("r.size").alias("_size"), F.col("r.quality").alias("_quality"), F.col("r.error").alias("_error"))
    ok = F.coalesce("_ok", F.lit(False))
    out = images.drop("converted", "size", "quality", "error").join(r, ["job_id", "url"], "left")
    return out.withColumns({"converted": ok, "size": F.when(ok, F.col("_size")), "quality": F.when(ok, F.col("_quality")), "error": F.when(~ok, filled(F.col("_error"), F.lit("Conversion failed")))}).drop("_ok", "_size", "_quality", "_error")


def job_images(images: DataFrame, job_id: str, product_index: str | int | None = None) -> DataFrame:
    """A job's images, or those of one product; a product that is no number is ignored."""
    out = images.filter(F.col("job_id") == job_id)
    text = str(product_index).strip() if product_index is not None else ""
    return out.filter(F.col("product_index") == int(text)) if text.lstrip("-").isdigit() else out


def image_by_id(images: DataFrame, job_id: str, wanted: str, payload: bool = False) -> DataFrame:
    """The first image with an id, by product and position; without jpg_data unless payload."""
    out = images.filter((F.col("job_id") == job_id) & (F.col("id") == wanted)).orderBy("product_index", "position").limit(1)
    return out if payload else out.drop("jpg_data")


def search_images(images: DataFrame, query: str) -> DataFrame:
    q = query.strip().lower()
    return images.filter(F.lower("url").contains(q)) if q else images


def fallback_image(products: DataFrame, page_url: Column) -> DataFrame:
    """source_images of products without any: the listing image, resolved, unless it is inline data, a gif or an svg."""
    found = absolute(F.col("img"), filled(F.col("product_url"), page_url))
    usable = (found != "") & ~found.startswith("data:") & ~found.rlike(r"(?i)\.(gif|svg)(\?|\z)")
    none = F.coalesce(F.size("source_images"), F.lit(0)) == 0
    return products.withColumn("source_images", F.when(none & (F.coalesce("img", F.lit("")) != "") & usable, F.array(found)).otherwise(F.coalesce("source_images", F.array().cast("array<string>"))))


def drop_images(images: DataFrame, urls: DataFrame) -> DataFrame:
    return images.join(urls.select("url").distinct(), "url", "left_anti")


def new_images(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """cur (job_id, position, url) without what prev has, in order."""
    return cur.join(prev.select("job_id", "url").distinct(), ["job_id", "url"], "left_anti").select("job_id", "position", "url")


def same_images(a: Column, b: Column) -> Column:
    """Equal lists, in order; null lists are empty."""
    none = F.array().cast("array<string>")
    return F.coalesce(a, none) == F.coalesce(b, none)


def sample_image(images: DataFrame, seed: int = 0) -> DataFrame:
    """One image of each job, by a seeded hash of its URL; a null URL comes first."""
    w = Window.partitionBy("job_id").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "url")), "url", "position")
    return images.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _old(now: Column, hours: float) -> Column:
    age = F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("created_at").cast("timestamp"))
    return F.coalesce(age > int(hours * 3_600_000), F.lit(False))


def expire_images(images: DataFrame, now: Column, hours: float = 24) -> DataFrame:
    """Images of at most `hours`, and those without a time."""
    return images.filter(~_old(now, hours))


def retention_report(images: DataFrame, now: Column, hours: float = 24) -> DataFrame:
    """(job_id, removed, kept)"""
    return images.groupBy("job_id").agg(F.count_if(_old(now, hours)).alias("removed"), F.count_if(~_old(now, hours)).alias("kept"))
