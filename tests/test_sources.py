import json

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import images as I
from shelfmark.operators import seo
from shelfmark.sources import tables as S


def test_jobs_round_trip(spark, tmp_path):
    jobs = [{"id": i, "url": f"u{i}", "status": "completed" if i % 2 else "running", "updated_at": f"2024-01-0{i + 1}T00:00:00Z", "stop_requested": True} for i in range(4)] + [{"url": "no id"}]
    (tmp_path / "jobs.json").write_text(json.dumps({"updated_at": "x", "jobs": jobs}))
    df = S.read_jobs(spark, str(tmp_path / "jobs.json"))
    rows = df.collect()
    assert {r.id for r in rows} == {"0", "1", "2", "3"}
    assert all(r.products == [] and r.stop_requested is False for r in rows)
    S.write_jobs_snapshot(df, str(tmp_path / "db"))
    assert [r.id for r in S.read_jobs(spark, str(tmp_path / "db")).collect()] == ["3", "1"]
    S.write_manifests(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 4
    S.export_jobs(df, str(tmp_path / "x"))
    assert set(spark.read.json(str(tmp_path / "x")).columns) == {"url", "status", "images", "error"}


def test_url_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" u1 \n\n\tu2\n")
    assert [r.url for r in S.read_url_list(spark, str(tmp_path / "a.txt")).collect()] == ["u1", "u2"]
    (tmp_path / "e.json").write_text('{"exported": "x", "jobs": [{"url": " u "}, {"url": " "}, {}]}')
    assert [r.url for r in S.import_urls(spark, str(tmp_path / "e.json")).collect()] == ["u"]
    (tmp_path / "bad.json").write_text('{"x": 1}')
    with pytest.raises(Exception, match="jobs array"):
        S.import_urls(spark, str(tmp_path / "bad.json")).collect()


def test_inventories(spark, tmp_path):
    root = tmp_path / "images"
    (root / "j1" / "p").mkdir(parents=True)
    (root / "j1" / "p" / "a.bin").write_bytes(b"x" * 1048576)
    (root / "j1" / "b.jpg").write_bytes(b"not an image")
    got = {r.job_id: r for r in S.archive_inventory(spark, str(root), spark.createDataFrame([("j1",), ("j2",)], "id string")).collect()}
    assert (got["j1"].files, got["j1"].megabytes, got["j2"].files, got["j2"].has_files) == (2, 1.0, 0, False)
    assert {r.decodable for r in S.image_inventory(spark, str(root)).collect()} == {False}
    assert S.expired_paths(spark, str(root), F.current_timestamp()).count() == 0
    assert [r.job_id for r in S.expired_paths(spark, str(root), F.current_timestamp() + F.expr("INTERVAL 25 HOUR")).collect()] == ["j1"]


def test_payloads(spark):
    df = spark.createDataFrame([("a", "u", None, True, "aGk="), ("b", "u", "o", False, "aGk="), ("c", "u", "o", True, "***")], "id string, url string, original_url string, converted boolean, jpg_data string")
    assert {r.id: (r.content, r.original_url) for r in S.decode_images(df).collect()} == {"a": (bytearray(b"hi"), "u"), "b": (None, "o"), "c": (None, "o")}


def test_gallery_and_fallback(spark, tmp_path):
    df = spark.createDataFrame([("j", 0, "n", "", "/i.jpg", "", ["b", "a", "b"]), ("j", 1, "n", "", "/k.gif", "", []), ("j", 2, "n", "", "/l.jpg", "", None)], "job_id string, product_index long, name string, price string, img string, product_url string, images array<string>")
    assert [r.url for r in I.gallery(df).orderBy("position").collect()] == ["b", "a", "/k.gif", "/l.jpg"]
    S.export_image_urls(df, str(tmp_path / "urls"))
    assert [r.value for r in spark.read.text(str(tmp_path / "urls/job_id=j")).collect()] == ["b", "a", "/k.gif", "/l.jpg"]
    out = I.fallback_image(df.withColumn("source_images", F.when(F.col("product_index") == 0, F.array(F.lit("x")))), F.lit("https://x.com/"))
    assert [r.source_images for r in out.orderBy("product_index").collect()] == [["x"], [], ["https://x.com/l.jpg"]]
    norm = I.normalize_products(df.withColumn("source_images", F.col("images")), F.lit("https://x.com/")).orderBy("product_index").collect()
    assert norm[0].images == ["https://x.com/b", "https://x.com/a"] and norm[2].images == []
    assert I.sample_image(df.select("job_id", F.posexplode("images").alias("position", "url"))).count() == 1


def test_seo(spark):
    df = spark.createDataFrame([("t" * 50, "", "https://x", "index,follow", "", "", "", "", "", "", "")], "title string, description string, canonical_url string, robots string, og_title string, og_description string, og_image string, twitter_title string, twitter_description string, twitter_image string, twitter_card string")
    r = seo.seo_audit(seo.seo_fill(df)).first()
    assert (r.title_state, r.description_state, r.canonical_ok, r.robots_ok, r.og_title, r.twitter_card) == ("good", "empty", True, True, "t" * 50, "summary_large_image")


def test_image_sizes(spark):
    h = bytes.fromhex
    app, frame = "FFE1000800000000" + "0000", "FFC0000B080021004301011100"
    files = {
        "many": (h("FFD8" + app * 300 + frame), "jpeg", 67, 33), "fill": (h("FFD8FFFFFF" + frame[2:]), "jpeg", 67, 33), "marks": (h("FFD8FFD0FF01" + frame), "jpeg", 67, 33), "table": (h("FFD8FFC40004FFC0" + frame), "jpeg", 67, 33),
        "scan": (h("FFD8FFDA0004FFC0" + frame), "jpeg", None, None), "cut": (h("FFD8" + frame[:14]), "jpeg", None, None), "lost": (h("FFD8FFE1FFFF00"), "jpeg", None, None), "bad": (h("FFD8FF00"), "jpeg", None, None),
        "gif": (b"GIF87a\x02\x01\x03\x00", "gif", 258, 3), "lossy": (h("524946460000000057454250565038200000000030000 09D012A05C0070 0".replace(" ", "")), "webp", 5, 7), "empty": (b"", None, None, None), "null": (None, None, None, None), "text": (b"PNG", None, None, None), "riff": (b"RIFF0000WAVE", None, None, None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in files.items()], "path string, content binary").withColumn("width", F.lit("x"))
    assert {r.path: (r.format, r.width, r.height) for r in S.image_sizes(df).collect()} == {k: v[1:] for k, v in files.items()}
