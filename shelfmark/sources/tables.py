"""Readers and writers of pages, jobs, logs, updates, URL lists, exports, and inventories of image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.values import filled, trimmed
from shelfmark.operators.images import gallery
from shelfmark.operators.jobs import newest_finished

IMAGE = "struct<id: string, url: string, original_url: string, index: int, product_index: bigint, product_name: string, created_at: timestamp, jpg_data: string, converted: boolean, size: bigint, quality: bigint, error: string>"
PRODUCT = f"struct<name: string, price: string, product_url: string, img: string, source_images: array<string>, images: array<{IMAGE}>>"
JOB = f"struct<id: string, url: string, status: string, model: string, images: bigint, total_items: bigint, processed_items: bigint, error: string, user_id: string, stop_requested: boolean, pause_requested: boolean, created_at: timestamp, updated_at: timestamp, products: array<{PRODUCT}>>"
PAGES = "page_id bigint, url string, html string"
LOGS = "seq bigint, time timestamp, level string, source string, message string, job_id string"
UPDATES = "seq bigint, id string, url string, status string, model string, images bigint, total_items bigint, processed_items bigint, error string, updated_at timestamp"


def read_pages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(PAGES).parquet(path)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of {updated_at, jobs: [...]} files: without null ids, flags reset, products an array."""
    jobs = spark.read.schema(f"updated_at string, jobs array<{JOB}>").json(path, multiLine=True).select(F.explode("jobs").alias("j")).select("j.*")
    return jobs.filter("id IS NOT NULL").withColumns({"stop_requested": F.lit(False), "pause_requested": F.lit(False), "products": F.coalesce("products", F.array().cast(f"array<{PRODUCT}>"))})


def write_jobs_snapshot(jobs: DataFrame, path: str, n: int = 100) -> None:
    """One {updated_at, jobs} file with the newest n finished jobs, and their products."""
    kept = newest_finished(jobs, n)
    whole = kept.agg(F.sort_array(F.collect_list(F.struct(F.col("updated_at").alias("_at"), F.struct(*kept.columns).alias("job"))), asc=False).alias("x"))  # at most n rows
    whole.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("updated_at"), F.transform("x", lambda r: r["job"]).alias("jobs")).coalesce(1).write.mode("overwrite").json(path)


def write_manifests(jobs: DataFrame, path: str, folders: bool = True) -> None:
    """A JSON record for each job: job_id, url, status, created_at, completed_at, products; each in a folder of its own, or, for very many jobs, as lines of common files."""
    records = jobs.select(F.col("id").alias("job_id"), "url", "status", "created_at", F.col("updated_at").alias("completed_at"), "products")
    if folders:
        records.withColumn("folder", F.col("job_id")).write.mode("overwrite").partitionBy("folder").json(path)
    else:
        records.write.mode("overwrite").json(path)


def export_jobs(jobs: DataFrame, path: str) -> None:
    """Lines of {url, status, images, error}."""
    jobs.select("url", "status", "images", "error").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def import_urls(spark: SparkSession, path: str) -> DataFrame:
    """The urls that aren't blank, trimmed, of {jobs: [{url, …}]} files; an error for a file without a jobs array."""
    found = spark.read.schema("jobs array<struct<url: string, status: string, images: bigint, error: string>>, _corrupt_record string").json(path, multiLine=True)
    jobs = F.when(F.col("jobs").isNull(), F.raise_error(F.lit("not an export: there is no jobs array"))).otherwise(F.col("jobs"))
    return found.select(F.explode(jobs).alias("j")).select(trimmed(F.col("j.url")).alias("url")).filter("url <> ''")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): the lines of text files, trimmed, without empty ones."""
    return spark.read.text(path).select(trimmed(F.col("value")).alias("url")).filter("url <> ''")


def read_logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(LOGS).json(path)


def read_job_updates(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(UPDATES).json(path)


def write_updates(updates: DataFrame, path: str, checkpoint: str | None = None):
    """Updates as JSON lines; a started query for a stream."""
    if updates.isStreaming:
        return updates.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
    updates.write.mode("append").json(path)
    return None


def export_image_urls(products: DataFrame, path: str, folders: bool = True) -> None:
    """The gallery URLs of each job, one a line, in gallery order: in a folder for each job, or, for very many jobs, a JSON line for each with job_id and urls."""
    if not folders:
        listed = gallery(products).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("position", "url"))).alias("x"))
        listed.select("job_id", F.transform("x", lambda r: r["url"]).alias("urls")).write.mode("overwrite").json(path)
        return
    ordered = gallery(products).repartition("job_id").sortWithinPartitions("job_id", "position")
    ordered.select(F.col("url").alias("value"), "job_id").write.mode("overwrite").partitionBy("job_id").text(path)


def decode_images(images: DataFrame) -> DataFrame:
    """images with content: the bytes of jpg_data where converted and valid; jpg_data goes, original_url falls back to url."""
    content = F.when(F.coalesce("converted", F.lit(False)) & (F.coalesce("jpg_data", F.lit("")) != ""), F.try_to_binary(F.col("jpg_data"), F.lit("base64")))
    return images.withColumns({"content": content, "original_url": filled(F.col("original_url"), F.col("url"))}).drop("jpg_data")


def _number(content: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """The unsigned number in `size` bytes of content from byte `at` on (the first is 1); null beyond the end."""
    at = at if isinstance(at, Column) else F.lit(at)
    if little:
        return sum(_number(content, at + i, 1) * (1 << 8 * i) for i in range(size))
    part = F.substring(content, at, F.lit(size))
    return F.when(F.length(part) == size, F.conv(F.hex(part), 16, 10).cast("bigint"))


#: Segments of a JPEG file up to its frame header; files with more are taken for undecodable.
SEGMENTS = 4096


def _jpeg_size(content: Column) -> Column:
    """Walks from segment to segment to the frame header (markers C0 to CF but C4, C8 and CC): {width, height}."""
    none, start = F.lit(None).cast("bigint"), F.lit(3).cast("bigint")

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        marker, size = _number(content, at + 1, 1), _number(content, at + 2, 2)
        frame = marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
        ok = (_number(content, at, 1) == 0xFF) & marker.isNotNull()
        there = lambda offset: F.when(ok & frame, _number(content, at + offset, 2))
        onward = F.when(~ok | frame | marker.isin(0xD9, 0xDA), none).when(marker == 0xFF, at + 1).when((marker == 0x01) | marker.between(0xD0, 0xD8), at + 2).otherwise(at + 2 + size)
        return F.when(at.isNull(), s).otherwise(F.struct(onward.alias("at"), there(7).alias("width"), there(5).alias("height")))

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(SEGMENTS), F.expr("CAST(length(content) DIV 4 AS INT)"))))
    return F.aggregate(steps, F.struct(start.alias("at"), none.alias("width"), none.alias("height")), step)


def image_sizes(files: DataFrame) -> DataFrame:
    """files (content, ...) with format (png, jpeg, gif, webp; else null), width and height, read from the header's bytes; the picture isn't decoded.

    Null, empty, cut off and unknown files have null sizes. Columns of files named format, width or height are replaced."""
    c, plain = F.col("content"), lambda a, n: F.substring(F.col("content"), F.lit(a), F.lit(n))
    is_ = lambda a, h: F.hex(plain(a, len(h) // 2)) == h
    kind = F.when(is_(1, "89504E470D0A1A0A") & is_(13, "49484452"), "png").when(is_(1, "FFD8FF"), "jpeg").when(is_(1, "474946383761") | is_(1, "474946383961"), "gif").when(is_(1, "52494646") & is_(9, "57454250"), "webp")
    chunk, bits = F.hex(plain(13, 4)), _number(c, 22, 4, True)
    lossy, lossless, wide = (chunk == "56503820") & is_(24, "9D012A"), (chunk == "5650384C") & is_(21, "2F"), chunk == "56503858"
    webp = lambda i: F.when(lossy, _number(c, 27 + 2 * i, 2, True).bitwiseAND(0x3FFF)).when(lossless, F.shiftright(bits, 14 * i).bitwiseAND(0x3FFF) + 1).when(wide, _number(c, 25 + 3 * i, 3, True) + 1)
    out = files.withColumn("format", kind).withColumn("_jpeg", F.when(F.col("format") == "jpeg", _jpeg_size(c)))
    size = lambda i, name: F.when(F.col("format") == "png", _number(c, 17 + 4 * i, 4)).when(F.col("format") == "gif", _number(c, 7 + 2 * i, 2, True)).when(F.col("format") == "webp", webp(i)).otherwise(F.col("_jpeg")[name])
    w, h = size(0, "width"), size(1, "height")
    return out.withColumns({"width": F.when(h.isNotNull(), w), "height": F.when(w.isNotNull(), h)}).drop("_jpeg")


def image_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, format, width, height, dimensions, decodable) of the files of a folder and those below; decodable: a header with a size above 0."""
    files = image_sizes(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), "content"))
    ok = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    shown = {"width": F.when(ok, F.col("width")), "height": F.when(ok, F.col("height")), "dimensions": F.when(ok, F.concat(F.col("width").cast("string"), F.lit(" × "), F.col("height").cast("string"))), "decodable": ok}
    return files.select("path", "size", "format", *[c.alias(k) for k, c in shown.items()])


def _folder(path: Column, root: str) -> Column:
    tail = F.substring_index(path, root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return F.when(tail.contains("/"), F.substring_index(tail, "/", 1))


def archive_inventory(spark: SparkSession, folder: str, jobs: DataFrame | None = None) -> DataFrame:
    """(job_id, files, bytes, megabytes, has_files) of each job's folder; with jobs (id), also those without files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    sums = files.withColumn("job_id", _folder(F.col("path"), folder)).filter("job_id IS NOT NULL").groupBy("job_id").agg(F.count("*").alias("files"), F.sum("length").cast("bigint").alias("bytes"))
    if jobs is not None:
        sums = jobs.select(F.col("id").alias("job_id")).distinct().join(sums, "job_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return sums.select("job_id", zero("files"), zero("bytes"), F.round(F.coalesce("bytes", F.lit(0)) / 1048576, 2).alias("megabytes"), (F.coalesce("files", F.lit(0)) > 0).alias("has_files"))


def folder_times(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, modified): when the newest file of each job's folder was written."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    return files.withColumn("job_id", _folder(F.col("path"), folder)).filter("job_id IS NOT NULL").groupBy("job_id").agg(F.max("modificationTime").alias("modified"))


def expired(times: DataFrame, now: Column, hours: float = 24) -> DataFrame:
    """Of folder_times those older than `hours`."""
    return times.filter(F.unix_millis(now.cast("timestamp")) - F.unix_millis("modified") > int(hours * 3_600_000))


def expired_paths(spark: SparkSession, folder: str, now: Column, hours: float = 24) -> DataFrame:
    """(job_id, modified) of job folders whose newest file is older than `hours`. Nothing is deleted."""
    return expired(folder_times(spark, folder), now, hours)
