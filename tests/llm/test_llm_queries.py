"""The queries with SQL against DuckDB, and the others against brute force or held-out labels, on given tables."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select * from '{SF}/documents.parquet' order by doc_id").df()


def run(spark, name, sf=SF):
    return Q.queries()[name](spark, sf).toPandas()


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = run(spark, name), con.sql(Q.oracle_sql()[name]).df()
    text = lambda x: "" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].map(text).values.tolist()))
    assert rows(got) == rows(want)


def test_op2_finds_toxic_documents(spark):
    sf = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else SF
    got = run(spark, "op2_toxicity", sf)
    labels = duckdb.sql(f"select doc_id, max(toxic) as toxic from '{sf}/labels.parquet' group by 1").df()
    assert len(got) == duckdb.sql(f"select count(*) from '{sf}/documents.parquet'").fetchall()[0][0]
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id)
    assert held[held.toxic == 1].predicted.mean() > 0.8
    assert held[held.toxic == 0].predicted.mean() < 0.05


def test_op3_ids(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = run(spark, "op3_token_store").sort_values("doc_id")
    start = 0
    for r, text in zip(got.itertuples(), docs.text, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32, r.verified) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        start += len(ids)


def test_op4_base(spark, docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r, text in zip(run(spark, "op4_licenses").sort_values("doc_id").itertuples(), docs.text, strict=True):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
        at = sorted((i, label) for p, label in phrases.items() for k in [p.split()] for i in range(len(words)) if words[i : i + len(k)] == k)
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(at), ",".join(sorted({x for _, x in at})))
        assert (pd.isna(r.first_word) if not at else (r.first_word, r.last_word) == (at[0][0], at[-1][0]))
        assert {x for _, x in at} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op5_components(spark, docs):
    prints = []
    for text in docs.text:
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(prints)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = run(spark, "op5_simhash").sort_values("doc_id")
    assert list(got.fingerprint) == [f"{p:016x}" for p in prints]
    assert list(got.component_id) == [docs.doc_id[find(i)] for i in range(len(prints))]


def test_op6_round_trip(spark, docs):
    got = run(spark, "op6_pieces").sort_values("doc_id")
    assert list(got.decoded_sha256) == [hashlib.sha256(t.encode()).hexdigest() for t in docs.text]
    assert got.lossless.all()


def test_op6_dropout_against_brute_force(spark, docs):
    """Every segment of every text through a plain agenda, with the draws of its document and place."""
    from test_llm_edges import agenda

    from shelfmark.llm import pieces

    c, mix = pieces.codec(pieces.default_model()), lambda x: int(pieces.B.mix(np.array([x], np.uint64))[0])
    for r, text in zip(run(spark, "op6_pieces").sort_values("doc_id").itertuples(), docs.text, strict=True):
        if len(text) > 3000:
            continue
        base = int.from_bytes(hashlib.blake2b(f"{pieces.SEED}:0:{r.doc_id}".encode(), digest_size=8).digest(), "little")
        segments = re.findall(" *[^ ]+| +", " " + text) if text else []
        ids = [i for k, x in enumerate(segments, 1) for i in agenda(c, x, pieces.RATE, mix(base ^ mix(k)))]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_op4_labels_against_every_rule(spark, docs):
    """All patterns on all texts, without the keyword filter; overlaps resolved pair by pair."""
    from shelfmark.llm import licenses

    rules = licenses.rules()
    for r, text in zip(run(spark, "op4_licenses").sort_values("doc_id").itertuples(), docs.text, strict=True):
        joined = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)})))
        kept = []
        for i, (label, _, weight, pattern) in enumerate(rules):
            for m in pattern.finditer(joined):
                if not any(m.start() < k[1] and k[0] < m.end() for k in kept):
                    kept.append((m.start(), m.end(), i, label, weight))
        base = set(r.base_labels.split(",")) - {""}
        assert set(r.labels.split(",")) - {""} == base | {k[3] for k in kept}
        assert r.score == max([0.6 * bool(base), *(k[4] for k in kept)])


def order_minhash(text):
    """One text's fingerprint, step by step."""
    from shelfmark.llm import orderhash

    u64 = lambda x: (x & (1 << 64) - 1).to_bytes(8, "little")
    chain = lambda *xs: __import__("functools").reduce(lambda seed, x: xxhash.xxh64_intdigest(x, seed), xs, 42)
    words = text.encode().split()
    grams = [chain(*words[i : i + 2]) for i in range(max(1, len(words) - 1))] if words else []
    seen, held = {}, []
    for i, g in enumerate(grams):
        seen[g] = seen.get(g, 0) + 1
        held.append((chain(u64(g), seen[g].to_bytes(4, "little")), i))
    out = []
    for a, b in orderhash.multipliers():
        own = sorted((((p % (1 << 32) * a ^ (p >> 32) * b) << 30 & (1 << 64) - 1) ^ 1 << 63, i) for p, i in held)  # as signed numbers
        own = {(h ^ 1 << 63, i) for h, i in (own[:1] + own[-1:])}
        out.append(f"{chain(*[u64(h >> 30) for h, _ in sorted(own, key=lambda x: x[1])]):016x}"[-8:] if own else "-" * 8)
    return out


def test_op9_fingerprints(spark, docs):
    got = run(spark, "op9_order_minhash").sort_values("doc_id")
    texts = list(docs.text)
    own = [order_minhash(t) for t in texts]
    for k, (r, text) in enumerate(zip(got.itertuples(), texts, strict=True)):
        half, after = len(text) // 2, (k + 1) % len(texts)
        edited = text[: len(text) - half] + texts[after][:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        other = order_minhash(edited)
        assert r.fingerprint == "".join(own[k]) and r.edited_fingerprint == "".join(other)
        alike = lambda x, y: sum(a == b for a, b in zip(x, y, strict=True)) / 64
        assert (r.near_edited, r.near_next) == (alike(own[k], other), alike(own[k], own[after]))
    assert got.near_edited.mean() > 10 * got.near_next.mean()


def test_op10_accuracy(spark):
    sf = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else SF
    got = run(spark, "op10_language", sf).merge(duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").df(), on="doc_id")
    held = got[got.held_out]
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id)
    assert (held.lang == held.lang_pred).mean() > 0.98


def test_pipeline_near_copies(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    held = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        held.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, x in enumerate(held):
        for j, y in enumerate(held[:i]):
            if x == y or (5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id for r in C.simhash(spark, docs, sf).select("doc_id").collect()}
    assert got == {doc_id for i, (doc_id, _) in enumerate(rows) if find(i) == i}


def cut_passages(rows):
    """rows (doc_id, text) with the words gone that a 50-word window of a smaller doc_id covers."""
    first, out = {}, {}
    for i, t in sorted(rows):
        w = t.split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in rows:
        w = t.split()
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        out[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
    return out


def test_pipeline(spark):
    """Stage by stage, each against what its rule says of its own input."""
    import corpus_pipeline as C

    from shelfmark.llm import mixing as M

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, texts = docs, lambda d: {r.doc_id: r.text for r in d.collect()}
    stages, before = dict(C.STAGES), docs
    for name in ("toxicity", "simhash", "substrings"):
        before, docs = docs, C.written(stages[name](spark, docs, SF), f"test-{name}")
        assert docs.dtypes == first.dtypes
        was, now = texts(before), texts(docs)
        if name == "substrings":
            assert {k: v.split() for k, v in now.items()} == {k: v.split() for k, v in cut_passages(list(was.items())).items()}
        else:
            assert set(now.items()) <= set(was.items()) and len(now) > 0.5 * len(was)  # some rows go, none changes
        if name == "toxicity":
            rejected = run(spark, "op2_toxicity").query("predicted == 1").doc_id
            assert set(was) - set(now) == set(rejected)
    before, docs = docs, C.written(stages["mixing"](spark, docs, SF), "test-mixing")
    sizes = {r.doc_id: r for r in M.mix_sources(before.withColumn("size", M.n_words(F.col("text")))).collect()}
    taken, whole = {}, texts(before)
    for r in docs.collect():
        words = r.text.split()
        assert r.text == whole[r.doc_id] or words == whole[r.doc_id].split()[: len(words)]
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words)
    assert {k: taken.get(k, 0) for k in sizes} == {k: r.taken for k, r in sizes.items()}
    out = C.STAGES[-1][1](spark, docs, SF).toPandas()
    assert len(out) == docs.count() and out.lossless.all()
    assert out.groupby("doc_id").epoch.apply(lambda e: sorted(e) == list(range(len(e)))).all()
