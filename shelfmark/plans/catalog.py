"""The registered queries of the catalogue library, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import urls as U
from shelfmark.functions import values as V
from shelfmark.operators import images as I
from shelfmark.operators import jobs as J
from shelfmark.operators import logs as L
from shelfmark.operators import pages as P
from shelfmark.operators import requests as R
from shelfmark.operators import seo
from shelfmark.plans import fixtures as X
from shelfmark.shared import scratch, ship, table, written
from shelfmark.sources import tables as S
from shelfmark.streaming import jobs as live
from shelfmark.streaming import keyed, state

QUERIES, SQL = {}, {}
NOW_SQL = f"TIMESTAMP '{X.NOW}'"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


TITLE = r"regexp_extract(html, '<title[^>]*>([\s\S]*?)</title>', 1, 'i')"
PARTS = r"""u AS (SELECT page_id, url, html, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS path0, lower(regexp_extract(url, '^[^?#]*\?([^#]*)', 1)) AS q FROM pages),
v AS (SELECT *, CASE WHEN path0 = '' THEN '/' ELSE path0 END AS path FROM u),
k AS (SELECT *, CASE WHEN contains(path, '/product/') THEN true WHEN regexp_matches(path, '/(p|item|sku|product-|view|details|product-detail|pd)/') THEN true
  WHEN regexp_matches(path, '/(apple|samsung|iphone|galaxy|ipad|airpods|watch)/') THEN true
  WHEN q <> '' AND (contains(q, 'product_id=') OR contains('?' || q, '?id=') OR contains('?' || q, '?sku=') OR contains('?' || q, '?item_id=')) THEN true
  WHEN regexp_matches(path, '/(products?|items?|listings?|offers?|deals?)/[0-9]+') THEN true
  WHEN regexp_matches(path, '(^|/)[a-z0-9-]+-series(/|$)') THEN false
  WHEN regexp_matches(path, '(category|collection|catalog|shop|browse|search|results|list|page)/') THEN false
  WHEN regexp_matches(path, '[a-z0-9]+-[a-z0-9]+-[a-z0-9]+') AND NOT contains(q, 'category') THEN true ELSE false END AS product FROM v)"""


@query(f"WITH {PARTS} SELECT page_id, product FROM k")
def product_url_flags(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.is_product(F.col("url")).alias("product"))


@query(f"WITH {PARTS} SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, product, contains(lower({TITLE}), 'just a moment') AS challenge, count(*) AS n FROM k GROUP BY 1, 2, 3")
def page_kinds(spark, sf):
    pages = table(spark, sf, "pages").select(F.lower(U.part(F.col("url"), "HOST")).alias("host"), U.is_product(F.col("url")).alias("product"), P.is_challenge(P.title(F.col("html"))).alias("challenge"))
    return pages.groupBy("host", "product", "challenge").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, {TITLE} AS title FROM pages")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.title(F.col("html")).alias("title"))


@query(r"""SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS position, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1, 'i') AS l FROM pages)""")
def page_links(spark, sf):
    return P.links(table(spark, sf, "pages"))


@query(r"""WITH s AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS seg FROM pages),
t AS (SELECT page_id, list_filter(regexp_split_to_array(regexp_replace(CASE WHEN len(seg) > 0 THEN seg[-1] ELSE 'category' END, '\.[A-Za-z0-9]+$', ''), '[-_]+'), lambda x: x <> '') AS tok FROM s)
SELECT page_id, CASE WHEN len(tok) = 0 THEN 'Scrape Job' ELSE array_to_string(list_transform(tok, lambda x: CASE WHEN regexp_matches(x, '^([Ll][Gg]|[Hh][Tt][Cc])$') OR regexp_matches(x, '^[A-Za-z]*[0-9]+[A-Za-z0-9]*$') THEN upper(x)
  ELSE upper(substr(x, 1, 1)) || lower(substr(x, 2)) END), ' ') END AS model FROM t""")
def infer_model(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.model_name(F.col("url")).alias("model"))


LAST = r"regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\?.*$', '')"


@query(f"SELECT page_id, CASE WHEN {LAST} = '' THEN 'image_1.jpg' ELSE url_decode({LAST}) END AS name FROM pages")
def image_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.image_filename(F.col("url"), F.lit(1)).alias("name"))


@query("SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '', 'g') AS safe FROM pages")
def safe_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.safe_id(F.col("url")).alias("safe"))


@query(f"WITH {X.JOBS} SELECT id, substr(CASE WHEN model = '' THEN 'job_' || id ELSE lower(replace(model, ' ', '_')) END, 1, 80) || '_' || id || '.zip' AS archive FROM jobs")
def archive_name(spark, sf):
    return X.jobs(spark, sf).select("id", U.archive_name(F.col("model"), F.col("id")).alias("archive"))


@query(f"WITH {X.JOBS} SELECT id, url, status, model, images, total_items, processed_items, nullif(error, '') AS error, created_at, updated_at FROM jobs")
def job_summary(spark, sf):
    return J.summarize_jobs(X.jobs(spark, sf))


MODEL = "CASE WHEN model = '' THEN regexp_replace('Part ' || regexp_extract(url, '([0-9]+)$', 1), ' $', '') ELSE model END"


@query(f"WITH {X.JOBS} SELECT id, url, status, {MODEL} AS model, images, total_items, processed_items, nullif(error, '') AS error FROM jobs")
def ui_jobs(spark, sf):
    return J.ui_jobs(X.jobs(spark, sf))


COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("queued", "running", "paused", "completed", "failed")) + ", CAST(sum(images) AS BIGINT) AS total_images, count(*) AS total"


@query(f"WITH {X.JOBS} SELECT {COUNTS} FROM jobs")
def job_overview(spark, sf):
    return J.overview(X.jobs(spark, sf))


@query(f"WITH {X.JOBS}, o AS (SELECT {COUNTS} FROM jobs) SELECT *, CASE WHEN completed + failed = 0 THEN 0 ELSE CAST(floor(100.0 * completed / (completed + failed) + 0.5) AS BIGINT) END AS success_rate FROM o")
def job_stats(spark, sf):
    return J.job_stats(X.jobs(spark, sf))


@query(f"WITH {X.JOBS} SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('running', 'paused')) AS active, count(*) FILTER (WHERE status = 'queued') AS queued FROM jobs")
def health(spark, sf):
    return J.health(X.jobs(spark, sf))


@query(f"WITH {X.JOBS} SELECT id, status, updated_at FROM jobs WHERE status IN ('completed', 'failed') ORDER BY updated_at DESC, id LIMIT 100")
def list_jobs_top(spark, sf):
    return J.newest_finished(X.jobs(spark, sf)).select("id", "status", "updated_at")


@query(f"WITH {X.JOBS} SELECT id, url FROM jobs WHERE contains(lower(model), 'part-7') OR contains(lower(url), 'part-7')")
def search_jobs(spark, sf):
    return J.search_jobs(X.jobs(spark, sf), " Part-7 ").select("id", "url")


@query(f"WITH {X.JOBS} SELECT id, url FROM jobs WHERE status = 'paused'")
def filter_jobs(spark, sf):
    return J.filter_jobs(X.jobs(spark, sf), "paused").select("id", "url")


@query(f"WITH {X.JOBS} SELECT id, CASE WHEN status = 'running' THEN 'paused' ELSE status END AS status, status = 'running' AS changed FROM jobs")
def pause_all(spark, sf):
    return J.pause_all(X.jobs(spark, sf)).select("id", "status", "changed")


@query(f"WITH {X.JOBS} SELECT id, CASE WHEN status = 'paused' THEN 'running' ELSE status END AS status, status = 'paused' AS changed FROM jobs")
def resume_all(spark, sf):
    return J.resume_all(X.jobs(spark, sf)).select("id", "status", "changed")


@query(f"WITH {X.JOBS}, l AS (SELECT *, status = 'running' AND {NOW_SQL} - started_at > INTERVAL 45 MINUTE AS late FROM jobs) SELECT id, CASE WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN late THEN 'Job timed out after 45 minutes' ELSE error END AS error FROM l")
def expire_overdue(spark, sf):
    return J.expire_overdue(X.jobs(spark, sf), F.to_timestamp(F.lit(X.NOW))).select("id", "status", "error")


@query(f"WITH {X.JOBS} SELECT id, CASE WHEN CAST(user_id AS BIGINT) % 10 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN CAST(user_id AS BIGINT) % 10 = 0 THEN 'Stopped by user' ELSE error END AS error FROM jobs")
def stop_jobs(spark, sf):
    jobs = X.jobs(spark, sf)
    return J.stop_jobs(jobs, jobs.filter(F.col("user_id").cast("bigint") % 10 == 0)).select("id", "status", "error")


@query(f"""WITH {X.JOBS}, {X.PRODUCTS}, n AS (SELECT job_id, count(*) AS n, CAST(sum(n) AS BIGINT) AS images FROM products GROUP BY 1)
SELECT id, CASE WHEN status = 'paused' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN status = 'paused' THEN 'Stopped by user' END AS error, coalesce(n.n, 0) AS total_items, coalesce(n.images, 0) AS images FROM jobs LEFT JOIN n ON n.job_id = id""")
def finalize_jobs(spark, sf):
    jobs = X.jobs(spark, sf).withColumn("stop_requested", F.col("status") == "paused")
    done = X.products(spark, sf).select("job_id", F.size("images").alias("n_images"))
    return J.finalize_jobs(jobs, done).select("id", "status", "error", "total_items", "images")


@query(f"WITH {X.JOBS} SELECT status, count(*) AS n FROM jobs WHERE user_id <> '7' GROUP BY 1")
def reset_user(spark, sf):
    return J.reset_user(X.jobs(spark, sf), "7").groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {X.JOBS} SELECT id, status FROM jobs WHERE CAST(id AS BIGINT) % 4 <> 0")
def delete_jobs(spark, sf):
    jobs = X.jobs(spark, sf)
    return J.delete_jobs(jobs, jobs.filter(F.col("id").cast("bigint") % 4 == 0)).select("id", "status")


@query(f"""WITH {X.JOBS}, s AS (SELECT id, 'completed' AS status, images + 1 AS images, updated_at + INTERVAL 1 HOUR AS updated_at FROM jobs WHERE CAST(id AS BIGINT) % 3 = 0
  UNION ALL SELECT 'new-' || id, status, images, updated_at FROM jobs WHERE CAST(id AS BIGINT) % 50 = 0),
l AS (SELECT id, status, images, updated_at FROM jobs WHERE CAST(id AS BIGINT) % 2 = 0)
SELECT coalesce(s.id, l.id) AS id, coalesce(s.status, l.status) AS status, coalesce(s.images, l.images) AS images, coalesce(s.updated_at, l.updated_at) AS updated_at FROM s FULL JOIN l ON s.id = l.id
WHERE coalesce(s.id, l.id) NOT IN (SELECT id FROM jobs WHERE CAST(id AS BIGINT) % 7 = 0)""")
def merge_jobs(spark, sf):
    jobs = X.jobs(spark, sf).drop("user_id", "started_at")
    key = F.col("id").cast("bigint")
    server = jobs.filter(key % 3 == 0).withColumns({"status": F.lit("completed"), "images": F.col("images") + 1, "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 HOUR")})
    server = server.unionByName(jobs.filter(key % 50 == 0).withColumn("id", F.concat(F.lit("new-"), "id")))
    return J.merge_jobs(server, jobs.filter(key % 2 == 0), jobs.filter(key % 7 == 0)).select("id", "status", "images", "updated_at")


@query(f"""WITH {X.JOBS}, c AS (SELECT id, CASE WHEN status = 'running' AND CAST(id AS BIGINT) % 2 = 0 THEN 'completed' ELSE status END AS status FROM jobs WHERE CAST(id AS BIGINT) % 10 <> 3),
p AS (SELECT id, status FROM jobs WHERE CAST(id AS BIGINT) % 10 <> 4)
SELECT coalesce(p.id, c.id) AS id, CASE WHEN p.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(p.status = 'running' AND c.status = 'completed', false) AS completed_now
FROM p FULL JOIN c ON p.id = c.id WHERE p.id IS NULL OR c.id IS NULL OR p.status <> c.status""")
def diff_jobs(spark, sf):
    jobs, key = X.jobs(spark, sf), F.col("id").cast("bigint")
    now = jobs.filter(key % 10 != 3).withColumn("status", F.when((F.col("status") == "running") & (key % 2 == 0), "completed").otherwise(F.col("status")))
    return J.diff_jobs(jobs.filter(key % 10 != 4), now)


@query(f"WITH {X.JOBS} SELECT id, row_number() OVER (ORDER BY created_at, id) AS position FROM jobs WHERE status = 'queued'")
def queue_positions(spark, sf):
    return J.queue_positions(X.jobs(spark, sf))


@query(f"WITH {X.UPDATES}, t AS (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY updated_at, seq) AS before FROM updates) SELECT id, seq, updated_at, before, status FROM t WHERE before IS NULL OR before <> status")
def transitions(spark, sf):
    return J.transitions(X.updates(spark, sf))


@query(f"""WITH {X.UPDATES}, d AS (SELECT id, max(CASE WHEN status = 'completed' THEN seq END) AS done FROM updates GROUP BY id),
s AS (SELECT u.id, min(updated_at) AS started_at FROM updates u JOIN d USING (id) WHERE status = 'running' AND (done IS NULL OR seq > done) GROUP BY u.id)
SELECT id, started_at, CAST(floor(((epoch_us(TIMESTAMP '2025-01-01') // 1000) - (epoch_us(started_at) // 1000)) / 1000) AS BIGINT) AS seconds FROM s""")
def elapsed(spark, sf):
    return J.elapsed(X.updates(spark, sf), F.to_timestamp(F.lit("2025-01-01")))


@query(f"WITH {X.UPDATES} SELECT id, arg_max(status, seq) AS status, arg_max(images, seq) AS images, max(updated_at) AS updated_at FROM updates GROUP BY id")
def latest_jobs(spark, sf):
    from shelfmark.streaming.jobs import latest

    return latest(X.updates(spark, sf)).select("id", "status", "images", "updated_at")


@query(f"WITH {X.IMAGES} SELECT job_id, product_index, product_name, position, url, converted FROM images")
def flatten_images(spark, sf):
    p = X.products(spark, sf)
    ok = lambda partkey, i: (partkey + i) % 3 != 0
    nested = p.select("job_id", "product_index", F.struct("product_index", "name", F.transform("images", lambda u, i: F.struct(u.alias("url"), ok(F.col("partkey"), i).alias("converted"))).alias("images")).alias("p"))
    jobs = nested.groupBy(F.col("job_id").alias("id")).agg(F.array_sort(F.collect_list("p")).alias("products"))
    return I.flatten_images(jobs)


@query(f"""WITH {X.PRODUCTS}, f AS (SELECT job_id, product_index, i, '/media/' || partkey || '_' || (i % 2) || '.jpg' AS url FROM (SELECT *, unnest(range(n)) AS i FROM products)
  UNION ALL SELECT job_id, product_index, 0, img FROM products WHERE n = 0 AND img <> ''),
m AS (SELECT job_id, url, min(product_index * 10 + i) AS first FROM f GROUP BY 1, 2) SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY first) - 1 AS position, url FROM m""")
def gallery_urls(spark, sf):
    return I.gallery(X.products(spark, sf))


@query(f"""WITH {X.PRODUCTS} SELECT job_id, product_index, job_id || '_' || product_index || '_' || i AS id, i + 1 AS index, '/media/' || partkey || '_' || i || '.jpg' AS url FROM (SELECT *, unnest(range(least(n, 2))) AS i FROM products)""")
def number_images(spark, sf):
    return I.number_images(X.products(spark, sf))


@query(f"WITH {X.PRODUCTS} SELECT job_id, product_index, row_number() OVER w AS processed, CAST(sum(n) OVER w AS BIGINT) AS images_so_far FROM products WINDOW w AS (PARTITION BY job_id ORDER BY product_index ROWS UNBOUNDED PRECEDING)")
def progress_running(spark, sf):
    return I.progress(X.products(spark, sf))


@query(f"WITH {X.PRODUCTS} SELECT job_id, CAST(sum(n) AS BIGINT) AS images FROM products GROUP BY 1")
def images_per_job(spark, sf):
    return I.images_per_job(X.products(spark, sf))


@query(f"WITH {X.IMAGES} SELECT job_id, product_index, count(*) FILTER (WHERE converted) AS converted, count(*) FILTER (WHERE error <> '') AS failed FROM images GROUP BY ROLLUP (job_id, product_index) HAVING job_id IS NOT NULL")
def conversion_stats(spark, sf):
    return I.conversion_stats(X.images(spark, sf))


@query(f"WITH {X.IMAGES} SELECT id, i.converted AND size % 2 = 0 AS converted, CASE WHEN i.converted AND size % 2 = 0 THEN size END AS size, CASE WHEN i.converted AND size % 2 = 0 THEN NULL WHEN i.converted THEN 'Conversion failed' ELSE 'HTTP 403' END AS error FROM (SELECT DISTINCT ON (job_id, url) job_id, url, converted, size, error FROM images ORDER BY job_id, url, product_index, position) i JOIN images j USING (job_id, url)".replace("SELECT id, i.converted", "SELECT j.id, i.converted").replace("size % 2", "i.size % 2").replace("THEN size END", "THEN i.size END"))
def attach_conversion(spark, sf):
    images = X.images(spark, sf)
    first = images.groupBy("job_id", "url").agg(F.min_by(F.struct("converted", "size", "error"), F.struct("product_index", "position")).alias("r"))
    ok = F.coalesce(F.col("r.converted") & (F.col("r.size") % 2 == 0), F.lit(False))
    results = first.select("job_id", "url", ok.alias("success"), F.col("r.size").alias("size"), F.lit(85).alias("quality"), F.when(~F.col("r.converted"), F.col("r.error")).alias("error"))
    return I.attach_conversion(images.drop("size", "error"), results).select("id", "converted", "size", "error")


@query(f"WITH {X.IMAGES} SELECT id, url FROM images WHERE contains(lower(url), '7_1.jpg')")
def search_images(spark, sf):
    return I.search_images(X.images(spark, sf), "7_1.JPG").select("id", "url")


@query(f"WITH {X.IMAGES} SELECT id, position, url FROM images WHERE job_id = '70' AND product_index = 1")
def job_images(spark, sf):
    return I.job_images(X.images(spark, sf), "70", "1").select("id", "position", "url")


@query(f"WITH {X.IMAGES} SELECT job_id, count(*) FILTER (WHERE created_at IS NOT NULL AND {NOW_SQL} - created_at > INTERVAL 24 HOUR) AS removed, count(*) FILTER (WHERE created_at IS NULL OR {NOW_SQL} - created_at <= INTERVAL 24 HOUR) AS kept FROM images GROUP BY 1")
def retention(spark, sf):
    return I.retention_report(X.images(spark, sf), F.to_timestamp(F.lit(X.NOW)))


@query(f"WITH {X.IMAGES} SELECT job_id, position, url FROM images i WHERE NOT EXISTS (SELECT 1 FROM images p WHERE p.product_index = 0 AND p.job_id = i.job_id AND p.url = i.url)")
def new_images(spark, sf):
    images = X.images(spark, sf)
    return I.new_images(images.filter("product_index = 0"), images)


@query(f"""WITH {X.JOBS}, {X.REQUESTS}, r AS (SELECT seq, url, row_number() OVER (PARTITION BY url ORDER BY seq) AS k FROM requests WHERE url IS NOT NULL)
SELECT seq, url, CASE WHEN k > 1 OR url IN (SELECT url FROM jobs WHERE status <> 'failed' AND CAST(id AS BIGINT) % 5 = 0) THEN 'duplicate' ELSE 'started' END AS decision FROM r""")
def admit_urls(spark, sf):
    jobs = X.jobs(spark, sf).filter(F.col("id").cast("bigint") % 5 == 0)
    return R.admit_urls(X.requests(spark, sf).filter("url IS NOT NULL").select("seq", "url"), jobs)


@query(SQL["admit_urls"].replace("SELECT seq, url, CASE", "SELECT decision, count(*) AS n FROM (SELECT CASE") + ") GROUP BY 1")
def admission_counts(spark, sf):
    return R.admission_counts(admit_urls(spark, sf))


@query(f"""WITH {X.JOBS}, {X.REQUESTS}, a AS (SELECT r.seq, r.job_id, r.url, CASE WHEN coalesce(r.url, '') = '' THEN 'missing_url' WHEN j.status IN ('queued', 'running', 'paused') THEN 'duplicate' WHEN j.status = 'completed' AND j.url = r.url THEN 'cached'
  WHEN CAST(r.job_id AS BIGINT) % 13 = 0 THEN 'stopping' ELSE 'accepted' END AS d FROM requests r LEFT JOIN jobs j ON j.id = r.job_id),
b AS (SELECT *, coalesce(sum(CASE WHEN d = 'accepted' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM a)
SELECT seq, job_id, url, CASE WHEN d IN ('accepted', 'cached', 'stopping') AND k > 0 THEN 'duplicate' ELSE d END AS decision FROM b""")
def decide_requests(spark, sf):
    jobs = X.jobs(spark, sf)
    requests = X.requests(spark, sf)
    stopping = requests.filter(F.col("job_id").cast("bigint") % 13 == 0).select(F.col("job_id").alias("id"))
    return R.decide_requests(requests, jobs, stopping)


@query(f"""WITH {X.REQUESTS}, l AS (SELECT user_id, url, max(seq) AS last FROM requests WHERE url IS NOT NULL GROUP BY 1, 2), r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS rank, url FROM l) SELECT * FROM r WHERE rank <= 20""")
def recent_urls(spark, sf):
    return R.recent_urls(X.requests(spark, sf))


@query(f"WITH {X.LOGS} SELECT seq, time, level, source, message, job_id, message || CASE WHEN job_id IS NULL THEN '' ELSE ' (' || job_id || ')' END AS text FROM logs")
def normalize_logs(spark, sf):
    return L.normalize_logs(X.logs(spark, sf))


RUNS = f"""WITH {X.LOGS}, k AS (SELECT *, concat_ws('|', level, source, message, coalesce(job_id, '')) AS key FROM logs),
n AS (SELECT *, CASE WHEN key = lag(key) OVER w THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (ORDER BY time, seq)),
r AS (SELECT *, sum(new) OVER (ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT any_value(source) AS source, min(seq) AS seq, any_value(level) AS level, any_value(message) AS message, any_value(job_id) AS job_id, count(*) AS repeats, max(time) AS time FROM r GROUP BY run"""


@query(RUNS)
def collapse_logs(spark, sf):
    return L.collapse_logs(X.logs(spark, sf))


@query("SELECT event_id AS seq, ts AS time, event_type AS message FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_logs(spark, sf):
    return L.recent_logs(X.logs(spark, sf)).select("seq", "time", "message")


@query(f"WITH {X.LOGS} SELECT level, source, job_id, count(*) AS n FROM logs GROUP BY 1, 2, 3")
def log_counts(spark, sf):
    return L.log_counts(X.logs(spark, sf))


@query("SELECT CAST(user_id AS VARCHAR) AS host, event_id AS seq, CAST(floor(value) AS BIGINT) AS heap_used_mb FROM events WHERE floor(100 * floor(value) / 500 + 0.5) >= 90")
def memory_alerts(spark, sf):
    return L.memory_alerts(X.metrics(spark, sf)).select("host", "seq", "heap_used_mb")


@query(f"SELECT page_id, CASE WHEN length(trim({TITLE})) = 0 THEN 'empty' WHEN length(trim({TITLE})) BETWEEN 45 AND 60 THEN 'good' ELSE 'outside' END AS title_state, regexp_matches(url, '^https?://.+') AS canonical_ok FROM pages")
def seo_audit(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", P.title(F.col("html")).alias("title"), F.col("url").alias("canonical_url"))
    return seo.seo_audit(pages).select("page_id", "title_state", "canonical_ok")


ITEMS = f"""items AS (SELECT p_partkey, p_name AS name, printf('$%.2f', p_retailprice) AS price, '{X.SHOP}/media/' || p_partkey || '.jpg' AS img, '{X.SHOP}/parts/' || p_partkey AS product_url FROM part)"""


@query(f"WITH {ITEMS} SELECT trim(name) AS name, price, img, product_url FROM items")
def listing_items(spark, sf):
    return P.resolve_listing(P.extract_listing(X.category_pages(spark, sf))).select("name", "price", "img", "product_url")


@query(f"WITH {X.ALL_PAGE_IMAGES} SELECT page_id, CAST(position AS BIGINT) AS position, image_url FROM page_images")
def candidate_images(spark, sf):
    return P.extract_images(X.product_pages(spark, sf))


@query(f"SELECT p_partkey AS page_id, '/media/catalog/product/image/' || p_partkey || s AS found FROM part, (VALUES ('_a.jpg', 0), ('_b.jpg', 0), ('.jpg?w=1&h=2', 3)) t(s, k) WHERE p_partkey % 10 <> 9 AND p_size % 4 = k")
def catalog_scan(spark, sf):
    return X.held_pages(spark, sf).select("page_id", F.explode(P.scan_catalog_images(F.col("html"))).alias("found"))


@query(f"WITH {X.PAGE_IMAGES}, c AS (SELECT page_id, count(*) AS kept FROM page_images GROUP BY 1) SELECT page_id, kept + CASE WHEN p_size % 4 = 1 THEN 1 ELSE 0 END AS candidates, kept FROM c JOIN part ON p_partkey = page_id")
def filter_image_urls(spark, sf):
    return P.image_filter_stats(X.held_pages(spark, sf))


@query(f"""WITH {ITEMS}, {X.PAGE_IMAGES}, i AS (SELECT page_id, string_agg(image_url, ' ' ORDER BY position) AS images FROM page_images GROUP BY 1)
SELECT product_url, coalesce(images, img) AS images FROM items LEFT JOIN i ON i.page_id = p_partkey""")
def listing_enriched(spark, sf):
    pages = X.held_pages(spark, sf)
    items = P.resolve_listing(P.extract_listing(X.category_pages(spark, sf)))
    rich = P.enrich_listing(items, P.extract_images(pages), pages)
    return I.fallback_image(rich, F.col("url")).select("product_url", F.array_join("source_images", " ").alias("images"))


@query(f"SELECT '{X.SHOP}/parts/' || p_partkey AS product_url FROM part WHERE p_partkey % 10 = 9")
def missing_pages(spark, sf):
    items = P.resolve_listing(P.extract_listing(X.category_pages(spark, sf)))
    return P.missing_pages(items, X.held_pages(spark, sf))


@query(f"WITH {X.JOBS} SELECT id, url, status FROM jobs WHERE id = '42'")
def get_job(spark, sf):
    jobs = X.jobs(spark, sf)
    return J.get_job(jobs, "42", jobs.filter("status = 'queued' AND id <> '42'")).select("id", "url", "status")


@query(f"WITH {X.JOBS} SELECT status, count(*) AS n FROM jobs WHERE status IN ('queued', 'running', 'paused') GROUP BY 1")
def active_jobs(spark, sf):
    return J.active_jobs(X.jobs(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {X.JOBS} SELECT status, count(*) AS n FROM jobs WHERE status <> 'failed' GROUP BY 1 UNION ALL SELECT 'requested', count(*) FROM jobs WHERE status = 'failed'")
def retry_failed(spark, sf):
    left, again = R.retry_failed(X.jobs(spark, sf))
    return left.groupBy("status").agg(F.count("*").alias("n")).union(again.select(F.lit("requested").alias("status")).groupBy("status").agg(F.count("*").alias("n")))


@query(f"WITH {X.IMAGES} SELECT id, CASE WHEN converted THEN '{X.SHOP}/api/jobs/' || job_id || '/images/' || id ELSE '{X.SHOP}' || url END AS shown FROM images")
def display_urls(spark, sf):
    image = F.struct("id", "converted", F.lit("").alias("original_url"), "url")
    return X.images(spark, sf).select("id", I.display_url(image, F.col("job_id"), "/api", F.lit(f"{X.SHOP}/")).alias("shown"))


@query(f"WITH {X.IMAGES} SELECT id, url FROM images WHERE url NOT LIKE '%0_0.jpg'")
def drop_images(spark, sf):
    images = X.images(spark, sf)
    return I.drop_images(images, images.filter(F.col("url").endswith("0_0.jpg"))).select("id", "url")


@query(f"WITH {X.IMAGES} SELECT job_id, product_index, position, url FROM images WHERE id = '70_1_0'")
def image_by_id(spark, sf):
    return I.image_by_id(X.images(spark, sf).withColumn("jpg_data", F.lit("")), "70", "70_1_0").select("job_id", "product_index", "position", "url")


@query(f"WITH {X.IMAGES} SELECT id, url FROM images WHERE created_at IS NULL OR {NOW_SQL} - created_at <= INTERVAL 24 HOUR")
def kept_images(spark, sf):
    return I.expire_images(X.images(spark, sf), F.to_timestamp(F.lit(X.NOW))).select("id", "url")


@query(f"WITH {X.PRODUCTS} SELECT job_id, product_index, n <= 2 AS same FROM products")
def same_images(spark, sf):
    # a list without repeats is the same as its distinct form
    return X.products(spark, sf).select("job_id", "product_index", I.same_images(F.col("images"), F.array_distinct("images")).alias("same"))


@query("SELECT event_type AS message, CASE event_type WHEN 'error' THEN 'blocked' WHEN 'view' THEN 'timeout' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def error_kinds(spark, sf):
    text = F.when(F.col("message") == "error", "HTTP 403").when(F.col("message") == "view", "Navigation timeout of 30 s").otherwise("odd")
    return X.logs(spark, sf).withColumn("kind", V.error_kind(text)).groupBy("message", "kind").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE h AS (SELECT CAST(user_id AS VARCHAR) AS host, ts, event_id AS seq, (epoch_us(ts) // 1000) AS ms FROM events WHERE floor(100 * floor(value) / 500 + 0.5) >= 60),
f AS (SELECT host, ms, seq FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ms, seq) AS k FROM h) WHERE k = 1
  UNION ALL SELECT n.host, n.ms, n.seq FROM f, LATERAL (SELECT host, ms, seq FROM h WHERE h.host = f.host AND h.ms >= f.ms + 86400000 ORDER BY ms, seq LIMIT 1) n)
SELECT host, seq, ms FROM f""")
def alerts_cooldown(spark, sf):
    high = X.metrics(spark, sf).filter("floor(100 * heap_used_mb / heap_total_mb + 0.5) >= 60").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return state.throttle(high.select("host", "ms", "seq"), 86_400_000, "host")


@query(f"""WITH {X.UPDATES}, r AS (SELECT *, (epoch_us(updated_at) // 1000) AS ms, status = 'running' AS run FROM updates),
n AS (SELECT *, CASE WHEN run IS DISTINCT FROM lag(run) OVER w THEN 1 ELSE 0 END AS new, lead(ms) OVER w AS until FROM r WINDOW w AS (PARTITION BY id ORDER BY ms, seq)),
g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS k FROM n),
s AS (SELECT id, min(ms) AS started_ms, max(coalesce(until, greatest(ms, epoch_us(TIMESTAMP '2024-02-01') // 1000))) AS until FROM g WHERE run GROUP BY id, k)
SELECT id, started_ms, started_ms + 2700000 AS overdue_ms FROM s WHERE until - started_ms > 2700000""")
def overdue_runs(spark, sf):
    updates = X.updates(spark, sf).select("id", "status", F.unix_millis(F.col("updated_at").cast("timestamp")).alias("ms"), "seq")
    return state.overdue_stream(updates, now_ms=F.unix_millis(F.to_timestamp(F.lit("2024-02-01"))))


@query(f"WITH {X.REQUESTS} SELECT job_id, min(seq) AS seq FROM requests GROUP BY 1")
def dedup_requests(spark, sf):
    return keyed.requests_once(X.requests(spark, sf)).select("job_id", "seq")


@query(f"WITH {X.LOGS} SELECT source AS feed, max(time) AS last, (epoch_us(TIMESTAMP '2024-02-01') // 1000) - (epoch_us(max(time)) // 1000) > 7000 AS stale FROM logs GROUP BY 1")
def stale_feeds(spark, sf):
    return state.stale_feeds(X.logs(spark, sf).select(F.col("source").alias("feed"), "time"), F.to_timestamp(F.lit("2024-02-01")))


@query(f"WITH {X.TIER_IMAGES} SELECT page_id, position, image_url FROM tier_images")
def candidate_tiers(spark, sf):
    return P.extract_images(X.tier_pages(spark, sf))


@query(f"WITH {X.BRANCH_ITEMS} SELECT page_id, name, price, img, product_url FROM branch_items")
def listing_branches(spark, sf):
    return P.resolve_listing(P.extract_listing(X.branch_pages(spark, sf))).select("page_id", "name", "price", "img", "product_url")


@query(SQL["alerts_cooldown"].replace(">= 60)", ">= 90)").replace("86400000", "1800000").replace("SELECT host, seq, ms FROM f", "SELECT host, seq FROM f"))
def memory_cooldown(spark, sf):
    return state.alerts(X.metrics(spark, sf)).select("host", "seq")


@query(f"WITH {X.JOBS} SELECT id, updated_at FROM jobs WHERE CAST(id AS BIGINT) % 4 <> 0 ORDER BY updated_at DESC, id LIMIT 200")
def list_jobs(spark, sf):
    jobs = X.jobs(spark, sf)
    return J.list_jobs(jobs, jobs.filter(F.col("id").cast("bigint") % 4 == 0)).limit(200).select("id", "updated_at")


@query(f"WITH {X.JOBS} SELECT id, coalesce(CASE WHEN CAST(id AS BIGINT) % 3 <> 0 THEN updated_at END, created_at) AS shown_at FROM jobs ORDER BY shown_at DESC, id LIMIT 200")
def client_order(spark, sf):
    jobs = X.jobs(spark, sf).withColumn("updated_at", F.when(F.col("id").cast("bigint") % 3 != 0, F.col("updated_at")))
    return J.client_order(jobs).limit(200).select("id", F.coalesce("updated_at", "created_at").alias("shown_at"))


@query(f"""WITH {X.IMAGES} SELECT id, CASE position % 4 WHEN 0 THEN '{X.SHOP}' || url WHEN 1 THEN 'https://cdn.example.com' || url WHEN 2 THEN 'data:,' || url ELSE '{X.SHOP}/i' || url END AS shown FROM images""")
def displayed_urls(spark, sf):
    url, way = F.col("url"), F.col("position") % 4
    value = F.when(way == 0, url).when(way == 1, F.concat(F.lit(" //cdn.example.com"), url)).when(way == 2, F.concat(F.lit("data:,"), url)).otherwise(F.concat(F.lit("i"), url))
    return X.images(spark, sf).select("id", U.displayed(value, F.lit(X.SHOP)).alias("shown"))


@query(f"""WITH {X.IMAGES} SELECT id, replace(url[8:], '.jpg', '') || CASE size % 3 WHEN 0 THEN '.JPEG' ELSE '.jpg' END AS name FROM images WHERE size IS NOT NULL""")
def jpg_filename(spark, sf):
    images = X.images(spark, sf).filter("size IS NOT NULL")
    url = F.replace("url", F.lit(".jpg"), F.when(F.col("size") % 3 == 0, ".JPEG").when(F.col("size") % 3 == 1, ".png?w=2").otherwise(""))
    return images.select("id", U.jpg_filename(url, F.lit(1)).alias("name"))


@query("SELECT p_partkey, '/s/' || p_partkey || '.jpg' AS first, '/c/' || p_partkey || '.png' AS css FROM part")
def attribute_urls(spark, sf):
    key = F.col("p_partkey").cast("string")
    return table(spark, sf, "part").select("p_partkey", U.first_srcset(F.concat(F.lit(" /s/"), key, F.lit(".jpg 1x, /t.jpg 2x"))).alias("first"), U.css_url(F.concat(F.lit("color: red; background-image: url('/c/"), key, F.lit(".png') "))).alias("css"))


@query(f"""WITH {X.PRODUCTS} SELECT job_id, product_index, trim(name) AS name, CASE WHEN img = '' THEN '' ELSE '{X.SHOP}' || img END AS img, CASE WHEN n = 0 THEN '' WHEN n = 1 THEN '{X.SHOP}/media/' || partkey || '_0.jpg' ELSE '{X.SHOP}/media/' || partkey || '_0.jpg {X.SHOP}/media/' || partkey || '_1.jpg' END AS images FROM products""")
def normalize_products(spark, sf):
    p = X.products(spark, sf).withColumns({"title": F.concat(F.lit(" "), "name", F.lit(" ")), "name": F.lit(""), "product_url": F.lit("undefined"), "source_images": F.array(F.lit("null"), F.lit("[object X]"))})
    out = I.normalize_products(p, F.lit(f"{X.SHOP}/"))
    return out.filter("product_url = '' AND size(source_images) = 0").select("job_id", "product_index", "name", "img", F.array_join("images", " ").alias("images"))


@query("SELECT p_partkey, p_name AS og_title, p_name AS twitter_title, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS twitter_description, 'index,follow' AS robots, 'summary_large_image' AS twitter_card FROM part")
def seo_fill(spark, sf):
    none = F.lit(None).cast("string")
    own = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"), none.alias("description"), F.lit("").alias("og_title"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("og_description"), none.alias("og_image"), none.alias("twitter_title"), none.alias("twitter_description"), none.alias("twitter_image"), F.lit("").alias("robots"), none.alias("twitter_card"))
    return seo.seo_fill(own).select("p_partkey", "og_title", "twitter_title", "twitter_description", "robots", "twitter_card")


@query(f"SELECT page_id, CASE WHEN length(trim({TITLE})) BETWEEN 120 AND 160 THEN 'good' WHEN length(trim({TITLE})) = 0 THEN 'empty' ELSE 'outside' END AS description_state, page_id % 3 <> 0 AS robots_ok FROM pages")
def seo_checks(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.lit("x").alias("title"), P.title(F.col("html")).alias("description"), F.when(F.col("page_id") % 3 == 0, "all").otherwise("noindex,follow").alias("robots"))
    return seo.seo_audit(pages).select("page_id", "description_state", "robots_ok")


# files: written below the shared folder and read back


@query("SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_chars FROM pages")
def stored_pages(spark, sf):
    return S.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").alias("n_chars"))


@query(f"WITH {X.JOBS} SELECT id, status, images FROM jobs WHERE status IN ('completed', 'failed') ORDER BY updated_at DESC, id LIMIT 100")
def jobs_snapshot(spark, sf):
    path = scratch(spark, "snapshot")
    S.write_jobs_snapshot(X.jobs(spark, sf), path)
    return S.read_jobs(spark, path).select("id", "status", "images")


@query(f"WITH {X.JOBS} SELECT id AS job_id, url, status FROM jobs WHERE status IN ('completed', 'failed') ORDER BY updated_at DESC, id LIMIT 100")
def manifests(spark, sf):
    path = scratch(spark, "manifests")
    S.write_manifests(J.newest_finished(X.jobs(spark, sf)).withColumn("products", F.array("model")), path)
    return spark.read.schema("job_id string, url string, status string, products array<string>").json(path).select("job_id", "url", "status")


@query(f"WITH {X.JOBS} SELECT url, status, images, error FROM jobs")
def exported_jobs(spark, sf):
    path = scratch(spark, "export")
    S.export_jobs(X.jobs(spark, sf), path)
    return spark.read.schema("url string, status string, images bigint, error string").json(path)


@query(f"WITH {X.JOBS} SELECT url FROM jobs WHERE CAST(id AS BIGINT) % 7 <> 0")
def imported_urls(spark, sf):
    path, key = scratch(spark, "import"), F.col("id").cast("bigint")
    listed = X.jobs(spark, sf).select((key % 64).alias("file"), F.struct(F.when(key % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "url")).alias("url"), "status").alias("job"))
    listed.groupBy("file").agg(F.collect_list("job").alias("jobs")).select("jobs").write.option("maxRecordsPerFile", "1").json(path)
    return S.import_urls(spark, path)


@query("SELECT url FROM pages")
def url_list(spark, sf):
    path = scratch(spark, "urls")
    table(spark, sf, "pages").select(F.concat(F.lit(" "), "url", F.lit(" \n\t\n")).alias("value")).write.text(path)
    return S.read_url_list(spark, path)


@query(f"WITH {X.LOGS} SELECT seq, date_trunc('millisecond', time) AS time, message, job_id FROM logs")  # as JSON files have it
def log_files(spark, sf):
    path = scratch(spark, "logs")
    X.logs(spark, sf).write.json(path)
    return S.read_logs(spark, path).select("seq", "time", "message", "job_id")


@query(f"WITH {X.UPDATES} SELECT seq, id, status, images FROM updates")
def update_files(spark, sf):
    path = scratch(spark, "updates")
    S.write_updates(X.updates(spark, sf), path)
    return S.read_job_updates(spark, path).select("seq", "id", "status", "images")


@query(f"""WITH {X.JOBS}, {X.PRODUCTS}, t AS (SELECT id FROM jobs WHERE status IN ('completed', 'failed') ORDER BY updated_at DESC, id LIMIT 100),
f AS (SELECT job_id, '/media/' || partkey || '_' || (i % 2) || '.jpg' AS url FROM (SELECT *, unnest(range(n)) AS i FROM products) UNION SELECT job_id, img FROM products WHERE n = 0 AND img <> '')
SELECT id AS job_id, CAST(coalesce(sum(length(url) + 1), 0) AS BIGINT) AS bytes, count(url) > 0 AS has_files FROM t LEFT JOIN f ON job_id = id GROUP BY id""")
def url_archives(spark, sf):
    path, jobs = scratch(spark, "archives"), J.newest_finished(X.jobs(spark, sf)).select("id")
    S.export_image_urls(X.products(spark, sf).join(jobs.withColumnRenamed("id", "job_id"), "job_id"), path)
    found = S.archive_inventory(spark, path).select(F.element_at(F.split("job_id", "="), -1).alias("job_id"), "bytes", "has_files")
    return jobs.withColumnRenamed("id", "job_id").join(found, "job_id", "left").select("job_id", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("has_files", F.lit(False)).alias("has_files"))


@query(f"WITH {X.IMAGES} SELECT id, CASE WHEN converted THEN url END AS content, url AS original_url FROM images")
def decoded_images(spark, sf):
    images = X.images(spark, sf).withColumns({"jpg_data": F.when(F.col("position") == 9, "%%").otherwise(F.base64(F.col("url").cast("binary"))), "original_url": F.lit("")})
    return S.decode_images(images).select("id", F.col("content").cast("string").alias("content"), "original_url")


@query(f"WITH {X.JOBS}, {X.PRODUCTS} SELECT id AS job_id, url, status, count(name) AS products, coalesce(string_agg(name || '=' || n, '|' ORDER BY product_index), '') AS listed FROM jobs LEFT JOIN products ON job_id = id GROUP BY id, url, status")
def all_manifests(spark, sf):
    path = scratch(spark, "manifests")
    own = X.products(spark, sf).groupBy(F.col("job_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("product_index", "name", "price", "img", "images"))).alias("products"))
    S.write_manifests(X.jobs(spark, sf).join(own, "id", "left"), path, folders=False)
    read = spark.read.schema("job_id string, url string, status string, products array<struct<name: string, price: string, img: string, images: array<string>>>").json(path)
    listed = F.array_join(F.transform("products", lambda p: F.concat(p["name"], F.lit("="), F.size(p["images"]).cast("string"))), "|")
    return read.select("job_id", "url", "status", F.coalesce(F.size("products"), F.lit(0)).cast("bigint").alias("products"), F.coalesce(listed, F.lit("")).alias("listed"))


@query(SQL["gallery_urls"])
def url_lists(spark, sf):
    path = scratch(spark, "url-lists")
    S.export_image_urls(X.products(spark, sf), path, folders=False)
    return spark.read.schema("job_id string, urls array<string>").json(path).select("job_id", F.posexplode("urls").alias("position", "url")).withColumn("position", F.col("position").cast("bigint"))


@query(f"""WITH {X.JOBS}, s AS (SELECT row_number() OVER (ORDER BY updated_at DESC, id) - 1 AS i, concat_ws(':', id, status, images, processed_items, total_items, model) AS s FROM jobs),
b AS (SELECT i // 1000 AS i, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY i)) AS s FROM s GROUP BY 1),
a AS (SELECT i // 1000 AS i, sum(n) AS n, md5(string_agg(s, chr(10) ORDER BY i)) AS s FROM b GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, md5(string_agg(s, chr(10) ORDER BY i)) AS signature FROM a""")
def list_signature(spark, sf):
    return J.list_signature(X.jobs(spark, sf))


@query(f"WITH {X.IMAGES} SELECT job_id, url, position FROM images QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY md5('5:' || url), url, position) = 1")
def sampled_images(spark, sf):
    return I.sample_image(X.images(spark, sf).select("job_id", "url", "position"), 5)


def _image_folders(spark, sf):
    """A folder for each supplier with a picture's header."""
    path = scratch(spark, "pictures")
    X.image_files(spark, sf).select("s_suppkey", F.col("content").cast("string").alias("value")).write.partitionBy("s_suppkey").text(path)
    return path


@query("""SELECT s_suppkey, ['png', 'jpeg', 'gif', 'webp', 'webp', 'webp', 'png'][s_suppkey % 7 + 1] AS format, CASE WHEN s_suppkey % 7 < 6 THEN (1 + s_suppkey % 5000) || ' × ' || (1 + s_nationkey * 11) END AS dimensions, s_suppkey % 7 < 6 AS decodable FROM supplier""")
def image_dimensions(spark, sf):
    found = S.image_inventory(spark, _image_folders(spark, sf))
    return found.select(F.regexp_extract("path", "s_suppkey=([0-9]+)", 1).cast("bigint").alias("s_suppkey"), "format", "dimensions", "decodable")


@query("SELECT s_suppkey, true AS in_a_day, false AS now FROM supplier")
def expired_folders(spark, sf):
    path, key = _image_folders(spark, sf), F.element_at(F.split("job_id", "="), -1).cast("bigint").alias("s_suppkey")
    times = written(S.folder_times(spark, path), "folder-times")  # the folders are listed once
    later = S.expired(times, F.current_timestamp() + F.expr("INTERVAL 25 HOURS")).select(key, F.lit(True).alias("in_a_day"))
    now = S.expired(times, F.current_timestamp()).select(key, F.lit(True).alias("now"))
    return later.join(now, "s_suppkey", "full_outer").select("s_suppkey", F.coalesce("in_a_day", F.lit(False)).alias("in_a_day"), F.coalesce("now", F.lit(False)).alias("now"))


# streams: over files below the shared folder, until all of them are read


def _stream(spark, df, files: int = 3):
    path = scratch(spark, "stream")
    df.repartitionByRange(files, "seq").sortWithinPartitions("seq").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _in_turn(spark, df, part, files: int):
    """A stream of df in `files` micro-batches, by the value of part from 0."""
    path = scratch(spark, "stream")
    for k in range(files):
        df.filter(part == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _share(df, files: int):
    """Which of `files` equal shares of the numbers seq a row is in."""
    last = df.agg(F.max("seq")).first()[0] or 0
    return F.floor(F.col("seq") * files / F.lit(last + 1))


def _time_share(df, time: str, files: int):
    """Which of `files` equal shares of the time a row is in: a stream with a watermark drops what comes after later rows, and numbers needn't follow the time."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    first, last = df.agg(F.min(us), F.max(us)).first()
    return F.coalesce(F.expr(f"({files}L * (unix_micros(CAST({time} AS TIMESTAMP)) - {first or 0}L)) div {(last or 0) - (first or 0) + 1}L"), F.lit(0))


def _rows_of(stream, spark):
    """What a stream puts out, in append mode."""
    path = scratch(spark, "put-out")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(f"WITH {X.LOGS} SELECT seq, time, message FROM logs ORDER BY time DESC, seq DESC LIMIT 200")
def log_ring(spark, sf):
    path, logs = scratch(spark, "ring"), X.logs(spark, sf)
    state.log_tail(_in_turn(spark, logs, _share(logs, 4), 4), path, f"{path}-checkpoint").awaitTermination()
    return state.read_tail(spark, path).select("seq", F.col("time").cast("timestamp_ntz").alias("time"), "message")


@query(RUNS)
def collapse_stream(spark, sf):
    path, logs = scratch(spark, "runs"), X.logs(spark, sf)
    state.collapse_into(_in_turn(spark, logs, _share(logs, 4), 4), path, f"{path}-checkpoint").awaitTermination()
    return state.read_runs(spark, path)


@query(f"WITH {X.UPDATES}, jobs AS (SELECT id, arg_max(status, (updated_at, seq)) AS status, arg_max(images, (updated_at, seq)) AS images FROM updates GROUP BY id), o AS (SELECT {COUNTS} FROM jobs) SELECT *, CASE WHEN completed + failed = 0 THEN 0 ELSE CAST(floor(100.0 * completed / (completed + failed) + 0.5) AS BIGINT) END AS success_rate FROM o")
def live_overview(spark, sf):
    path = scratch(spark, "latest")
    state.upsert_latest(_stream(spark, X.updates(spark, sf)), path, f"{path}-checkpoint", buckets=4).awaitTermination()
    return live.live_overview(state.read_latest(spark, path))


@query(f"WITH {X.UPDATES}, h AS (SELECT max(seq) // 2 AS half FROM updates) SELECT id, arg_max(status, (updated_at, seq)) AS status, arg_max(CASE WHEN seq > half THEN 1 ELSE 0 END, (updated_at, seq)) AS origin FROM updates, h GROUP BY id")
def snapshot_then(spark, sf):
    updates = X.updates(spark, sf)
    half = F.expr("(SELECT max(event_id) div 2 FROM events_of)")
    table(spark, sf, "events").createOrReplaceTempView("events_of")
    before = live.latest(updates.filter(F.col("seq") <= half))
    return live.snapshot_then(before, updates).select("id", "status", "origin")


LATE = "updated_at - to_hours(CASE WHEN seq % 5 = 0 THEN 30 ELSE 0 END)"


@query(f"""WITH {X.UPDATES}, u AS (SELECT id, status, images, seq, {LATE} AS tm, seq % 3 AS file, max(seq) OVER () // 2 AS half FROM updates),
s AS (SELECT id, max((tm, seq)) AS last FROM u WHERE seq <= half GROUP BY id),
l AS (SELECT u.*, s.last, max((tm, u.seq)) OVER (PARTITION BY u.id ORDER BY file RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u LEFT JOIN s USING (id))
SELECT id, seq, status, images, 0 AS origin FROM u JOIN s USING (id) WHERE (tm, seq) = last
UNION ALL SELECT id, seq, status, images, 1 FROM l WHERE (last IS NULL OR (tm, seq) > last) AND (before IS NULL OR (tm, seq) > before)""")
def snapshot_stream(spark, sf):
    updates, path = X.updates(spark, sf), scratch(spark, "caught-up")
    updates = updates.withColumn("updated_at", F.when(F.col("seq") % 5 == 0, F.timestamp_add("HOUR", F.lit(-30), F.col("updated_at"))).otherwise(F.col("updated_at")))
    half = updates.agg(F.expr("max(seq) div 2")).first()[0]
    live.catch_up(live.latest(updates.filter(F.col("seq") <= F.lit(half))), _in_turn(spark, updates, F.col("seq") % 3, 3), path, f"{path}-checkpoint").awaitTermination()
    return live.caught_up(spark, path, updates.schema).select("id", "seq", "status", "images", "origin")


FIELDS = {"status": "seq % 4 <> 1", "images": "seq % 3 <> 0", "error": "seq % 5 = 0", "products": "seq % 6 = 0 AND seq % 12 <> 0"}
_NEWEST = ", ".join(f"arg_max([{c}], (updated_at, seq)) FILTER (WHERE {has}) AS {c}" for c, has in FIELDS.items())


@query(f"""WITH {X.UPDATES}, u AS (SELECT id, seq, {LATE} AS updated_at, status, images, CASE WHEN seq % 10 <> 0 THEN 'e' || seq END AS error, CASE WHEN seq % 12 <> 0 THEN 'p' || seq || ',q' END AS products FROM updates),
f AS (SELECT id, {_NEWEST} FROM u GROUP BY id HAVING NOT bool_or(seq % 97 = 3 AND CAST(id AS BIGINT) % 3 = 0))
SELECT id, status[1] AS status, images[1] AS images, error[1] AS error, products[1] AS products FROM f""")
def latest_fields(spark, sf):
    u, path = X.updates(spark, sf), scratch(spark, "latest")
    seq = F.col("seq")
    at = F.when(seq % 5 == 0, F.timestamp_add("HOUR", F.lit(-30), F.col("updated_at"))).otherwise(F.col("updated_at"))
    text = seq.cast("string")
    u = u.select("id", "seq", at.alias("updated_at"), "status", "images", F.when(seq % 10 != 0, F.concat(F.lit("e"), text)).alias("error"), F.when(seq % 12 != 0, F.array(F.concat(F.lit("p"), text), F.lit("q"))).alias("products"), ((seq % 97 == 3) & (F.col("id").cast("long") % 3 == 0)).alias("deleted"))
    has = {"status": seq % 4 != 1, "images": seq % 3 != 0, "error": seq % 5 == 0, "products": seq % 6 == 0}
    # lines that lack a field, and lines with a null
    line = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[F.when(has.get(c, F.lit(True)), F.concat(F.lit(f'"{c}":'), F.coalesce(F.to_json(F.struct(c), {"ignoreNullFields": "false"}).substr(F.lit(len(c) + 5), F.length(F.to_json(F.struct(c), {"ignoreNullFields": "false"})) - len(c) - 5), F.lit("null")))) for c in u.columns])), ","), F.lit("}"))
    lines, n = scratch(spark, "lines"), 3
    for k in range(n):
        u.filter(seq % n == k).select(line.alias("value")).write.mode("append").text(lines)
    schema = "id string, seq long, updated_at timestamp_ntz, status string, images long, error string, products array<string>, deleted boolean"
    updates = live.read_partial_updates(spark, f"{lines}", schema, stream=True)
    state.upsert_latest(updates, path, f"{path}-checkpoint").awaitTermination()
    return state.read_latest(spark, path).select("id", "status", "images", "error", F.array_join("products", ",").alias("products"))


_ASKED = f"""{X.UPDATES}, e AS (SELECT id AS job_id, seq, epoch_us(updated_at) // 1000 AS ms, seq % 2 = 0 AS request, status IN ('queued', 'running', 'paused') AS runs FROM updates),
b AS (SELECT *, lag(request OR runs) OVER w AS active, ms - lag(ms) OVER w AS since FROM e WINDOW w AS (PARTITION BY job_id ORDER BY ms, seq))
SELECT job_id, seq FROM b WHERE request AND NOT coalesce(active AND since <= 86400000, false)"""


def _asked(spark, sf):
    """Of the events the even ones as requests, the odd ones as updates of the jobs."""
    u = X.updates(spark, sf)
    return u.filter("seq % 2 = 0").select(F.col("id").alias("job_id"), "seq", F.col("updated_at").alias("requested_at")), u.filter("seq % 2 = 1").select("id", "seq", "updated_at", "status")


@query(f"WITH {_ASKED}")
def admitted_requests(spark, sf):
    return keyed.admitted_requests(*_asked(spark, sf)).select("job_id", "seq")


@query(f"WITH {_ASKED}")
def admitted_stream(spark, sf):
    requests, updates = _asked(spark, sf)
    both = [_in_turn(spark, df, _time_share(df, time, 4), 4) for df, time in ((requests, "requested_at"), (updates, "updated_at"))]
    return _rows_of(keyed.admitted_requests(*both, watermark="2 days"), spark).select("job_id", "seq")


_SILENT = """e AS (SELECT CAST(user_id AS VARCHAR) AS feed, epoch_us(ts) // 1000 AS ms FROM events), m AS (SELECT max(ms) AS last FROM e),
g AS (SELECT feed, ms, coalesce(lead(ms) OVER (PARTITION BY feed ORDER BY ms), last) AS until FROM e, m) SELECT feed, ms AS last_ms, ms + 43200000 AS stale_ms FROM g WHERE until - ms > 43200000"""


def _feeds(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("feed"), F.col("ts").alias("time"), F.col("event_id").alias("seq"))


@query(f"WITH {_SILENT}")
def silent_feeds(spark, sf):
    return keyed.silent_feeds(_feeds(spark, sf), 43_200)


@query(f"WITH {_SILENT}")
def silent_stream(spark, sf):
    feeds = _feeds(spark, sf)
    return _rows_of(keyed.silent_feeds(_in_turn(spark, feeds, _time_share(feeds, "time", 4), 4), 43_200), spark)


@query(f"WITH {X.TIER_IMAGES} SELECT page_id, position, image_url FROM tier_images")
def extract_stream(spark, sf):
    path = scratch(spark, "found")
    pages = _stream(spark, X.tier_pages(spark, sf).withColumn("seq", F.col("page_id")))
    live.extract_stream(pages).writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path).awaitTermination()
    return P.filter_image_urls(spark.read.parquet(path))


def _shipped(run):
    def shipped(spark, sf):
        ship(spark)
        return run(spark, sf)

    return shipped


def queries() -> dict:
    return {name: _shipped(run) for name, run in QUERIES.items()}


def oracle_sql() -> dict:
    return SQL
