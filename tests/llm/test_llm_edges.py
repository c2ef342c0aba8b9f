"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import graph, langid, licenses, mixing, nearcopies, orderhash, pieces, quality, simhash, substrings, tokenstore, toxicity
from shelfmark.shared import scratch

LONG = " ".join(f"w{i}" for i in range(60))
#: Names that operators use inside or put out.
EXTRA = {"size": 1, "taken": 2, "n_words": 3, "kept_text": 4, "n_tokens": 5, "h": 6, "n": 7, "key": 8, "bits": 9, "start": 10, "score": 11, "_spans": 12, "_epoch": 13, "spans": 14, "epoch": 15, "document": 16, "bucket": 17, "before": 18, "budget": 19, "_mix_source": 20, "_mix_budget": 21, "row": 22, "of": 23, "at": 24}
ROWS = [(1, LONG + " tail", "en", "a"), (2, "head " + LONG, "en", "a"), (2, "head " + LONG, "en", "a"), (3, None, None, None), (4, "", "en", ""), (5, " \n\t ", "de", "b"), (None, LONG, None, "a"), (6, "x", "de", "b"), (7, "É́\0 ▁ 🙂 " * 3000, "en", None), (8, "same same same " * 40, "en", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, *columns):
    return sorted(((r.doc_id, *(r[c] for c in columns)) for r in df.collect()), key=str)


def test_substrings(docs, empty):
    out = substrings.dedup_substrings(docs)
    assert out.count() == len(ROWS)
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_text[:5]) for r in out.collect()}
    assert {(1, 61, 0, "w0 w1"), (2, 61, 60, "head"), (3, 0, 0, ""), (4, 0, 0, ""), (None, 60, 0, "w0 w1"), (8, 120, 0, "same ")} <= got
    assert all(r[k] == v for r in out.collect() for k, v in EXTRA.items() if k not in ("n_words", "kept_text"))
    assert substrings.dedup_substrings(empty).count() == 0


def test_substrings_random_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = [" ".join(rng.choice(list("abc"), 30)) for _ in range(6)]
    rows = [(int(i), " ".join(rng.choice(pool, rng.integers(0, 8)))) for i in rng.permutation(60)]
    first, want = {}, {}
    for i, t in sorted(rows):
        w = t.split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in rows:
        w = t.split()
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        want[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.kept_text for r in got.collect()} == want


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0), (2, 1), (8, 1), (8, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels)
    assert out.count() == len(ROWS)
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_block_max_index_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(60, rng.integers(0, 9), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    vectors[100:120] = vectors[80:100]  # ties
    index = toxicity.BlockMaxIndex(*(np.concatenate(x) for x in zip(*vectors, strict=True)), np.cumsum([0, *(len(t) for t, _ in vectors)]), 60, block=16)
    dense = np.zeros((500, 60))
    for row, (t, w) in zip(dense, vectors, strict=True):
        row[t] = w
    for i, (t, w) in enumerate(vectors[:120]):
        for without in (-1, i):
            product = np.round(dense[:, t] @ w if len(t) else np.zeros(500), 9)
            want = [j for j in sorted(range(500), key=lambda j: (-product[j], j)) if product[j] > 0 and j != without][:10]
            ids, found = index.nearest(t, w, 10, without)
            assert np.allclose(found, product[want], atol=1e-8) and ids.tolist() == want


def test_toxicity_scores_against_brute_force(spark):
    """Every step anew: weights, all cosines, votes without themselves, calibration, evidence with ties."""
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    texts = [" ".join([*rng.choice(words, rng.integers(3, 25)), *(["vile"] * (i % 4 == 0))]) for i in range(60)]
    texts[7], texts[9], texts[50] = texts[5], texts[5], texts[5]  # equal examples, and a document equal to them
    label = {i: int(i % 4 == 0) for i in range(40)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, spark.createDataFrame(list(label.items()), "doc_id long, toxic int"), k=5).collect()}
    count = lambda t: {w: t.split().count(w) for w in set(t.split())}
    y = np.array([label[i] for i in range(40)])
    vocabulary = sorted({w for i in range(40) for w in texts[i].split()})
    weight = {}
    for w in vocabulary:
        clean, bad = (sum(w in texts[i].split() for i in range(40) if label[i] == c) for c in (0, 1))
        n0, n1 = (y == 0).sum(), (y == 1).sum()
        chi2 = (bad / n1 - clean / n0) ** 2 * n0 * n1 / (clean + bad) * (n0 + n1) / (n0 + n1 + 1 - clean - bad)
        weight[w] = (np.log(61 / (1 + sum(w in t.split() for t in texts))) + 1) * chi2 / (chi2 + 20)
    def vector(t):
        v = np.array([(1 + np.log(count(t)[w])) * weight[w] if w in count(t) else 0 for w in vocabulary])
        return v / (np.sqrt(v @ v) or 1)
    v = np.array([vector(t) for t in texts])
    prior = y.mean()
    def vote(i, without=-1):
        cosine = np.round(v[:40] @ v[i], 9)
        near = [j for j in sorted(range(40), key=lambda j: (-cosine[j], j)) if cosine[j] > 0 and j != without][:5]
        w = cosine[near] / (0.05 + 1 - np.minimum(cosine[near], 1))
        return ((w * y[near]).sum() + 0.2 * prior) / (w.sum() + 0.2), near
    a, b = toxicity.calibration(np.array([vote(i, i)[0] for i in range(40)]), y.astype(float), np.ones(40))
    for i in range(60):
        raw, near = vote(i)
        odds = np.log(np.clip(raw, 1e-4, 1 - 1e-4) / (1 - np.clip(raw, 1e-4, 1 - 1e-4)))
        assert abs(got[i].score - 1 / (1 + np.exp(-(a * odds + b)))) < 1e-6
        assert [e.doc_id for e in got[i].evidence] == near[:3]
    assert [e.doc_id for e in got[50].evidence] == [5, 7, 9]


def test_token_store(spark, docs, empty):
    path = scratch(spark, "test-store")
    tokenstore.write_store(docs, path, tokenstore.default_tokenizer())
    out = tokenstore.verify_store(spark, path).collect()
    assert len(out) == len(ROWS) and all(r.verified for r in out)
    assert [(r.doc_id, r.n_tokens) for r in out if r.doc_id in (3, 4, 5)] and all(r.n_tokens == 1 for r in out if r.doc_id in (3, 4, 5))
    assert sorted(out, key=lambda r: r.start)[0].doc_id is None
    whole = {(r.start, len(r.ids) // 4) for r in tokenstore.read_store(spark, path).collect()}
    assert whole == {(r.start, r.n_tokens) for r in out}
    assert spark.read.parquet(f"{path}/chunks").groupBy("digest").count().filter("count > 1").count() == 0
    manifest = spark.read.parquet(f"{path}/manifest").agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    assert tuple(manifest) == (len(ROWS), sum(r.n_tokens for r in out))
    none = scratch(spark, "test-store")
    tokenstore.write_store(empty, none, tokenstore.default_tokenizer())
    assert tokenstore.verify_store(spark, none).count() == 0


def test_a_damaged_chunk_shows(spark, docs):
    path = scratch(spark, "test-store")
    tokenstore.write_store(docs, path, tokenstore.default_tokenizer())
    bad = b"\5\0"
    chunks = spark.read.parquet(f"{path}/chunks")
    one = chunks.orderBy("digest").first().digest
    chunks.withColumn("data", F.when(F.col("digest") == bytes(one), F.lit(bytearray(bad))).otherwise(F.col("data"))).write.parquet(f"{path}/again")
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jvm.Path(f"{path}/chunks"), True)
    fs.rename(jvm.Path(f"{path}/again"), jvm.Path(f"{path}/chunks"))
    assert {r.verified for r in tokenstore.verify_store(spark, path).collect()} == {True, False}


@pytest.mark.parametrize("what,gone", [("chunks", "digest"), ("recipes", "root"), ("documents", "doc_id")])
def test_a_lost_row_shows(spark, what, gone):
    path, docs = scratch(spark, "test-store"), spark.createDataFrame([(i, f"{LONG} {i}") for i in range(6)], "doc_id long, text string")
    tokenstore.write_store(docs, path, tokenstore.default_tokenizer())
    rows = spark.read.parquet(f"{path}/{what}").orderBy(gone).collect()
    schema = spark.read.parquet(f"{path}/{what}").schema
    spark.createDataFrame(rows[1:], schema).write.mode("overwrite").parquet(f"{path}/{what}")
    out = tokenstore.verify_store(spark, path).collect()
    assert not all(r.verified for r in out) and (what == "documents" or len(out) == 6)
    if what != "documents":
        with pytest.raises(Exception, match="recipe"):
            tokenstore.read_store(spark, path).collect()


def test_repeated_passages_share_chunks():
    rng = np.random.default_rng(5)
    passages = [rng.integers(0, 49_000, 800) for _ in range(20)]
    total, stored = 0, {}
    for i in range(200):
        ids = np.concatenate((rng.integers(0, 49_000, 300), passages[i % 20], rng.integers(0, 49_000, 300))).astype("<u4")
        for x, y in zip([0, *(ends := tokenstore.cuts(ids).tolist())], ends, strict=False):
            total += y - x
            stored[ids[x:y].tobytes()] = y - x
    assert total - sum(stored.values()) > 0.25 * 180 * 800  # of the ids in second and later copies of a passage


def test_licenses(spark, docs, empty):
    out = licenses.scan_licenses(docs)
    assert out.count() == len(ROWS)
    assert {(r.n_words, r.n_base, r.first_word, r.base_labels, r.labels, r.score) for r in out.filter("doc_id IN (3, 4, 5)").collect()} == {(0, 0, None, "", "", 0.0)}
    assert licenses.scan_licenses(empty).count() == 0
    text = "Licensed under the Apache  License,\nVersion 2.0 (the \"License\"). SPDX-License-Identifier: MIT. CC-BY-SA 4.0; gnu general public license v3"
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.base_labels == "apache,cc-by,gpl" and set(r.labels.split(",")) == {"apache", "apache-2.0", "cc-by", "cc-by-sa-4.0", "gpl", "gpl-3.0", "mit"}
    assert [(d.label, d.first_word, d.n_words) for d in r.detections][0] == ("apache-2.0", 0, 8)


def test_earlier_license_rules_win():
    assert licenses.resolved([(0, 10, 5), (5, 15, 2)]) == [(5, 15, 2)] and licenses.resolved([(0, 10, 200), (2, 8, 0)]) == [(2, 8, 0)]
    assert licenses.resolved([(0, 4, 1), (4, 9, 1), (1, 3, 0), (20, 22, 9)]) == [(1, 3, 0), (4, 9, 1), (20, 22, 9)]
    rng = np.random.default_rng(7)
    for _ in range(50):
        hits = [(int(a), int(a + n), int(r)) for a, n, r in zip(rng.integers(0, 60, 30), rng.integers(1, 12, 30), rng.integers(0, 9, 30), strict=True)]
        kept = []
        for h in sorted(hits, key=lambda h: (h[2], h[0], -h[1])):
            if not any(h[0] < k[1] and k[0] < h[1] for k in kept):
                kept.append(h)
        assert licenses.resolved(hits) == sorted(kept)


def test_many_license_hits_end():
    import time

    began = time.time()
    places, found = licenses.Scanner().scan(b"mit license x " * 100_000)
    assert [x[0] for x in places] == list(range(0, 300_000, 3)) and len(found) == 100_000 and time.time() - began < 20


def test_every_license_rule_compiles_and_has_its_keyword():
    rules = licenses.rules()
    assert len(rules) > 200
    for label, keyword, weight, _ in rules:
        assert label and keyword == keyword.lower() and 0 < weight <= 1


def test_simhash(docs, empty):
    got = by_id(simhash.near_duplicates(docs), "component_id", "bits")
    assert len(got) == len(ROWS)
    assert {c for i, c, b in got if i in (3, 4, 5)} == {3} and {b for i, c, b in got if i in (3, 4, 5)} == {0}
    assert simhash.near_duplicates(empty).count() == 0


def test_near_copies(docs, empty):
    got = by_id(nearcopies.near_copies(docs), "component_id")
    assert len(got) == len(ROWS)
    assert {c for i, c in got if i in (3, 4, 5)} == {3} and {c for i, c in got if i in (1, 2, None)} == {1} and {c for i, c in got if i == 8} == {8}
    assert nearcopies.near_copies(empty).count() == 0


def test_a_large_group_of_near_copies(spark):
    """Against brute force: a group with edits, chains of edits, a common passage in unrelated texts."""
    rng = np.random.default_rng(8)
    words = [f"v{i}" for i in range(3000)]
    base, common, rows = list(rng.choice(words, 60)), list(rng.choice(words, 25)), []
    for i in range(150):
        text = list(base)
        for at in rng.integers(0, 60, 1 + i % 3):
            text[at] = f"edit{i}"
        rows.append(text)
    chain = list(rng.choice(words, 80))
    for i in range(12):
        chain = [*chain[:-1], f"end{i}"] if i % 2 else [f"begin{i}", *chain[1:]]
        rows.append(list(chain))
    rows += [[*rng.choice(words, rng.integers(0, 12)), *common] for _ in range(60)] + [rows[3], rows[3]]
    held = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, x in enumerate(held):
        for j in range(i):
            if len(x & held[j]) / len(x | held[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = nearcopies.near_copies(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: find(i) for i in range(len(rows))}


def test_near_copies_start_from_simhash_links(spark):
    """The facts have op5's fingerprints, and all sets of linked fingerprints hang together before shingles are joined."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 400, 600)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(base) + " " + " ".join(base[:1]), " ".join(f"z{i}" for i in rng.integers(0, 400, 300)), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    schema = "doc_id long, id long, size long, bits long, " + "".join(f"{s} long, " for s in nearcopies.SKETCHES) + "counts array<long>"
    facts = nearcopies.written(docs.mapInArrow(nearcopies._facts(5), schema), "test-facts")
    own = {r.doc_id: r for r in facts.filter("counts IS NULL").collect()}
    links = {r.doc_id: (r.bits, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {i: r.bits for i, r in own.items()} == {i: bits for i, (bits, _) in links.items()}
    part = {r.id: r.id for r in own.values()}
    for a, b in nearcopies._linked(facts).collect():
        part = {k: part[a] if v == part[b] else v for k, v in part.items()}
    assert all((part[own[i].id] == part[own[j].id]) == (links[i][1] == links[j][1]) for i in own for j in own)
    assert len({r.id for r in own.values()}) > len(set(part.values()))


def test_a_pair_that_shares_many_shingles_meets_once(spark):
    rows = [(h, i, i, sorted({5, 7, 9, i})) for i in (1, 2, 3) for h in (5, 7, 9)] + [(40, 1, 1, [5, 7]), (40, 4, 4, [11])]
    parts = spark.createDataFrame(rows, "h long, id long, part long, early array<long>")
    met = [tuple(r) for r in nearcopies._met(parts, F.lit(True)).collect()]
    assert sorted(met) == [(1, 2), (1, 3), (1, 4), (2, 3)]


def test_bitmaps_bound_the_difference():
    """Bitmaps never differ in more bits than their sets in shingles; sets of any size, empty ones too."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for gone in (0, 1, n // 3):
            b = np.unique(np.concatenate((a[gone:], rng.integers(0, 1 << 63, gone).astype(np.uint64))))
            x, y = nearcopies._bitmap(a), nearcopies._bitmap(b)
            assert len(x) == nearcopies.SKETCH
            bits = sum(((int(i) ^ int(j)) & (1 << 64) - 1).bit_count() for i, j in zip(x, y, strict=True))
            assert bits <= len(np.setxor1d(a, b)) and (gone or bits == 0)


@pytest.mark.parametrize("most", [0, 1, 2])
def test_near_prints_against_brute_force(spark, most):
    rng = np.random.default_rng(most)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 20)]
    values = {0, -1, *base}
    for b in base:
        for _ in range(10):
            x = b
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            values.add((x + (1 << 63)) % (1 << 64) - (1 << 63))
    values = sorted(values)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= most}
    got = simhash.near_prints(spark.createDataFrame([(v,) for v in values], "bits long"), most)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hub_is_split(spark):
    """The join of a step, as components() writes it: a node with most of the links is dealt to several tasks."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        links = spark.range(1, 300_000, 1, 8).selectExpr("IF(id % 4 = 0, id, 0L) AS a", "id AS b")
        joined = graph.written(links, "hub").join(graph.written(links.groupBy("a").agg(F.min("b").alias("m")), "hub-least"), "a")
        joined.write.format("noop").mode("overwrite").save()
        assert joined.count() == 299_999 and "skew=true" in _final_plan(joined)
        roots = graph.components(spark.range(1, 20_000).selectExpr("0L AS a", "id AS b"))
        assert roots.count() == 20_000 and roots.filter("root <> 0").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_without_a_doc_id_spread(spark):
    """Many null doc_ids don't share a bucket, and the budget is still met to the word."""
    rows = spark.range(4000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'s' AS source", "1 + id % 7 AS size", "id AS other")
    out = mixing.mix_sources(rows, buckets=40).collect()
    assert sum(r.taken for r in out) == int(out[0].target + 0.5) and {r.other for r in out} == set(range(4000))
    assert sorted(r.taken for r in out) == sorted(r.taken for r in mixing.mix_sources(rows, buckets=1).collect())


def test_pieces(spark, docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    plain = pieces.encode_pieces(docs, pieces.default_model(), rate=0.0).collect()
    assert len(plain) == len(ROWS) and all(r.lossless for r in plain)
    for r in plain:
        if r.text and "▁" not in r.text and "\0" not in r.text:
            assert np.frombuffer(r.ids, "<u4").tolist() == sp.encode(r.text)
    varied = pieces.encode_pieces(docs.withColumn("e", F.lit(1)), pieces.default_model(), epoch="e").collect()
    assert all(r.lossless for r in varied) and [r.ids for r in varied] != [r.ids for r in plain]
    again = pieces.encode_pieces(docs.withColumn("e", F.lit(1)), pieces.default_model(), epoch="e").collect()
    assert [r.ids for r in varied] == [r.ids for r in again]
    assert pieces.encode_pieces(empty, pieces.default_model()).count() == 0


def agenda(codec, segment, rate, keyed):
    """One segment merged with a plain list: of all candidates that weren't skipped the best, leftmost first."""
    mix = lambda x: int(pieces.B.mix(np.array([x], np.uint64))[0])
    parts = [(codec.piece.get({" ": pieces.BLANK, pieces.BLANK: ""}.get(c, c), -1), i, i + 1) for i, c in enumerate(segment)]
    skipped = set()
    while True:
        found = []
        for i, ((a, start, _), (b, _, end)) in enumerate(zip(parts, parts[1:], strict=False)):
            if a >= 0 and b >= 0 and (hit := codec.pairs.get(a * codec.n + b)) and (start, end, a, b) not in skipped:
                found.append((hit[0], start, i, end, a, b, hit[1]))
        if not found:
            return [x for i, start, end in parts for x in ([i] if i >= 0 else [codec.byte[y] for y in segment[start:end].encode()])]
        _, start, i, end, a, b, out = min(found)
        place = ((start << 32 | end) * int(pieces.B.WORD_P) + a * codec.n + b) % (1 << 64)
        if mix(keyed ^ mix(place)) < int(rate * (1 << 64)):
            skipped.add((start, end, a, b))
        else:
            parts[i : i + 2] = [(out, start, end)]


def test_dropout_against_brute_force():
    words = [" recommendation", " the", "  internationalisation", " 🙂é\n", " ▁a", " x", " aaaaaaaaaaaaaaaaaaaa", "   ", " Straßenbahnhaltestelle"]
    c = pieces.codec(pieces.default_model())
    for rate in (0.0, 0.1, 0.5, 0.9):
        trees, heaps = pieces.Encoder(pieces.default_model(), rate), pieces.Encoder(pieces.default_model(), rate, short=-1)
        segments, keyed = words * 30, np.arange(1, 30 * len(words) + 1, dtype=np.uint64)
        want = [agenda(c, s, rate, k) for s, k in zip(segments, keyed.tolist(), strict=True)]
        found, _ = trees._walk(segments, keyed)
        t = trees.trees
        assert [t.ids[t.at[i] : t.at[i + 1]].tolist() for i in found] == want
        assert [c.merge_long(s, trees.limit, k).tolist() for s, k in zip(segments, keyed.tolist(), strict=True)] == want
        text = "".join(segments)[1:]
        assert trees.encode_all([text, text], [0, 1], ["7", "7"]) == heaps.encode_all([text, text], [0, 1], ["7", "7"])
        assert (len(set(trees.encode_all([text] * 3, [0, 1, 2]))) == 3) == (rate > 0)


def test_dropout_differs_by_epoch_document_and_place():
    text = " ".join(f"{w}ation" for w in ("inform", "recommend", "nomin", "vari", "corpor")) * 10
    own = pieces.Encoder(pieces.default_model())
    got = own.encode_all([text] * 201, [*range(200), 0], ["1"] * 200 + ["2"])
    assert len(set(got[:200])) >= 199 and got[200] != got[0]
    assert got == pieces.Encoder(pieces.default_model(), segments=1, nodes=1).encode_all([text] * 201, [*range(200), 0], ["1"] * 200 + ["2"])
    assert {own.codec.sp.decode(np.frombuffer(x, "<u4").tolist()) for x in got} == {text}


def test_a_long_text_without_blanks_ends():
    import time

    text, began = "".join(np.random.default_rng(4).choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000)), time.time()
    own = pieces.Encoder(pieces.default_model())
    ids = np.frombuffer(own.encode_all([text], [0])[0], "<u4").tolist()
    assert own.codec.sp.decode(ids) == text and time.time() - began < 90


def test_mixing(spark, docs, empty):
    sized = docs.withColumn("size", mixing.n_words(F.col("text")))
    out = mixing.mix_sources(sized)
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert all(r[k] == v for r in rows for k, v in EXTRA.items() if k not in ("size", "taken"))
    assert sorted(map(tuple, mixing.mix_sources(sized, buckets=7).collect()), key=str) == sorted(map(tuple, rows), key=str)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target + 0.5) and own[0].source_size == sum(r.size for r in own)
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6
    assert sorted(r.taken for r in out.collect()) == sorted(r.taken for r in rows)
    assert mixing.mix_sources(empty.withColumn("size", F.lit(0))).count() == 0


def test_quality(spark, docs, empty):
    out = quality.quality(docs)
    assert out.count() == len(ROWS)
    assert {tuple(r) for r in out.filter("doc_id IN (3, 4, 5)").drop("doc_id").collect()} == {(0, 0, 0, 0, 0, True, 0, False, True)}
    assert quality.quality(empty).count() == 0
    lines = [(i, "\n".join([f"own {i} " + " ".join(f"u{i}x{j}" for j in range(60)), "Common  LINE here"] + ["also common " * 40] * (i % 2)), "h") for i in range(30)]
    got = {r.doc_id: (r.kept, r.n_common_words) for r in quality.quality(spark.createDataFrame(lines, "doc_id long, text string, source string")).collect()}
    assert got[0] == (True, 3) and got[1] == (False, 83)


def test_a_line_is_common_at_every_host_size(spark):
    rows = [(n * 1000 + i, f"own {n} {i}" + "\nthe same line" * (i < 11) + "\nten only" * (i < 10), f"host {n}") for n in (20, 400) for i in range(n)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("n_common_words > 0").collect()
    assert sorted((r.doc_id, r.n_common_words) for r in got) == sorted((n * 1000 + i, 3) for n in (20, 400) for i in range(11))


def test_common_lines_go(spark, docs, empty):
    own = lambda i, n: f"own {i} " + " ".join(f"u{i}x{j}" for j in range(n))
    rows = [(i, f"{own(i, 60 if i % 2 else 48)}\nA common  LINE\n\nlast {i}", "h") for i in range(30)] + [(99, "a common line", "other")]
    got = {r.doc_id: r for r in quality.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept_text == f"{own(i, 60 if i % 2 else 48)}\n\nlast {i}" for i in range(30)) and got[99].kept_text == "a common line"
    assert {(r.kept, r.left_failed) for r in got.values() if r.doc_id % 2} == {(True, False), (False, True)} and got[99].left_failed
    assert (got[0].kept, got[0].n_words, got[0].left_failed) == (True, 55, False)
    short = quality.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_words=54).filter("doc_id = 0").first()
    assert (short.kept, short.base_failed, short.left_failed) == (False, False, True)  # what is left of it has 52 words
    hot = [(i, f"{own(i, 60)}\nevery host's line", None) for i in range(400)]
    assert {(r.n_common_words, r.kept) for r in quality.quality(spark.createDataFrame(hot, "doc_id long, text string, source string")).collect()} == {(3, True)}
    assert sorted(r.kept_text for r in quality.cleaned(docs).collect()) == sorted(t or "" for _, t, _, _ in ROWS) and quality.cleaned(empty).count() == 0


def test_order_minhash(docs, empty):
    out = orderhash.edit_fingerprints(docs).collect()
    assert len(out) == len(ROWS)
    assert len({r.fingerprint for r in out if r.doc_id == 2}) == 1
    assert {r.fingerprint for r in out if r.doc_id in (3, 4, 5)} == {orderhash.EMPTY * orderhash.SLOTS}
    assert all(0 <= x <= 1 for r in out for x in (r.near_edited, r.near_next))
    assert orderhash.edit_fingerprints(empty).count() == 0
    alone = orderhash.edit_fingerprints(docs.filter("doc_id = 1")).first()
    assert alone.near_next == 1.0


def test_language(spark, docs, empty):
    learn = spark.createDataFrame([(i, "the of and that with" if i % 2 else "der die und nicht ein", "en" if i % 2 else "de") for i in range(10)], "doc_id long, text string, lang string")
    got = by_id(langid.identify(docs, learn), "lang_pred", "score")
    assert len(got) == len(ROWS)
    assert {x[1:] for x in got if x[0] in (3, 4, 5)} == {("und", 0.0)}
    assert langid.identify(empty, learn).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, learn.limit(0)).collect()} == {"und"}


def test_a_document_is_labelled_as_by_plain_loops(spark):
    """One text, a long word in it, through both recurrences position by position."""
    learn = spark.createDataFrame([(i, "the of and that with" if i % 2 else "der die und nicht ein", "en" if i % 2 else "de") for i in range(10)], "doc_id long, text string, lang string")
    net, text = langid.learn(learn), "The, " + "donaudampfschiff" * 12 + " 12 größe?"
    r = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), learn).first()
    total, n = np.zeros(2), 0
    for word in ("the", "donaudampfschiff" * 12, "größe"):
        ids = [256, *word.encode(), 256]
        states = []
        for gru, order in ((net.ahead, ids), (net.back, ids[::-1])):
            h, out, k = np.zeros(gru.h), [], gru.h
            W, U, b = (gru.p[x].astype(float) for x in "WUb")
            for i in order:
                x = net.emb[i] @ W + b
                z, r_ = (1 / (1 + np.exp(-(x[a : a + k] + h @ U[:, a : a + k]))) for a in (0, k))
                h = h + (1 - z) * (np.tanh(x[2 * k :] + (r_ * h) @ U[:, 2 * k :]) - h)
                out.append(h)
            states.append(out)
        for a, b in zip(states[0], states[1][::-1], strict=True):
            e = np.exp(np.concatenate((a, b)) @ net.out + net.bias)
            total, n = total + e / e.sum(), n + 1
    assert r.lang_pred == net.labels[int(total.argmax())] and abs(r.score - total.max() / n) < 1e-4


def test_network_gradients():
    net = langid.Network(["a", "b"], hidden=3, embed=2)
    for g in (net.ahead, net.back):
        g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    net.emb, net.out, net.bias = (x.astype(np.float64) for x in (net.emb, net.out, net.bias))
    words, y = [b"ab", b"xyz", b"q"], np.array([0, 1, 1])
    _, grads = net.gradients(words, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 7)]:
            old, eps = p[at], 1e-5
            p[at] = old + eps
            up = net.gradients(words, y)[0]
            p[at] = old - eps
            down = net.gradients(words, y)[0]
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-4
