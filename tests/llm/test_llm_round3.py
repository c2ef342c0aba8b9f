"""Search, phrases and line dedup against brute force; nulls, empty texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import bitmaps, linededup, phrases, search
from shelfmark.shared import scratch

TERM = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# search


def best(docs, items, top):
    terms = [Counter(TERM.findall(ascii_lower(t))) for _, t in docs]
    sizes = [sum(c.values()) for c in terms]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in terms for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall(ascii_lower(text)))
        rows = []
        for (doc, _), c, n in zip(docs, terms, sizes, strict=True):
            m = 75 + (25 * n * n_docs) // total if total else 0
            score = sum(k * math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in asked.items() if c[t])
            if score > 0:
                rows.append((-score, doc is None, doc))
        rows.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, doc, -s) for i, (s, _, doc) in enumerate(rows[:top])]
    return sorted(out, key=str)


def texts(seed, n, words=80, length=30):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, words + 1)
    return [" ".join(f"W{i}" if i % 7 else f"é{i}," for i in rng.choice(words, rng.integers(0, length), p=p / p.sum())) for _ in range(n)]


def test_search_equals_scoring_of_all_documents(spark):
    own = texts(1, 150)
    docs = [*enumerate(own), (3, own[3]), (None, own[4]), (500, None), (501, ""), (502, "..."), *((600 + i, own[5]) for i in range(30)), (700, "w1 " * 5000)]
    items = [("a", own[3]), ("b", "W1 w1 W2 é7"), (None, own[9]), ("b", own[5]), ("none", "zzz"), ("null", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({k: F.lit(1) for k in ("q", "key", "score", "rank", "item_id", "n", "qs")}).repartition(3)
    q = spark.createDataFrame(items, "item_id string, text string").withColumn("q", F.lit(1)).coalesce(1)
    got = sorted((tuple(r) for r in search.ranked_search(d, q).collect()), key=str)
    assert got == best(docs, items, 20)
    assert search.ranked_search(d.limit(0), q).count() == search.ranked_search(d, q.limit(0)).count() == 0
    assert search.ranked_search(d.filter("text IS NULL OR text = ''"), q).count() == 0
    index = spark.createDataFrame(search.signature_index(d).collect(), search.INDEX)
    assert sorted((tuple(r) for r in search.ranked_search(d, q, 3, index).collect()), key=str) == best(docs, items, 3)


def test_bounds_are_not_below_scores_and_exclude_documents():
    own, rolling = texts(2, 400, 600, 60), search.B.Rolling(search.B.WORD_P)
    import pyarrow as pa

    batch = pa.record_batch([pa.array(own)], names=["text"])
    terms = search.Terms([own[0], own[1]])
    n, doc, term, tf = terms.found(*search.B.buffers(batch.column("text")), rolling)
    df = Counter(term.tolist())
    terms.weigh(df, int((n > 0).sum()), int(n.sum()))
    rows = [r for b in search._signatures([batch]) for r in b.to_pylist()]
    exact = Counter()
    parts = terms.w[term] * terms.part(tf, n[doc])
    for q in range(2):
        times = dict(zip(terms.t[terms.q == q].tolist(), terms.times[terms.q == q].tolist(), strict=True))
        for d, t, x in zip(doc.tolist(), term.tolist(), parts.tolist(), strict=True):
            exact[q, d] += x * times.get(t, 0)
    bounds = {(q, k): int(b[q]) for r in rows for k, b in zip(r["keys"], terms.bounds(r).T, strict=True) for q in range(2)}
    assert all(bounds[q, search._text_key(own[d].encode())] >= v for (q, d), v in exact.items())
    floor = sorted(v for (q, _), v in exact.items() if q == 0)[-20]
    assert sum(v >= floor for (q, _), v in bounds.items() if q == 0) < 80


def test_bitmap(spark):
    keys = spark.range(-500, 500).select((F.col("id") * 10**15).alias("key"))
    bits = bitmaps.bitmap(keys)
    assert len(bits) == bitmaps.SIZE // 8 and bitmaps.maybe_in(bits, np.arange(-500, 500) * 10**15).all()
    assert bitmaps.maybe_in(bits, np.arange(10**6, 10**6 + 10_000)).sum() < 10
    assert not any(bitmaps.bitmap(keys.limit(0)))


# phrases


def collocated(rows, least, kept, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", ascii_lower(text)):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang or "und", tuple(ws[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for lang in n:
        rows = []
        for (of, p), a in found.items():
            if of != lang or any(100 * b >= kept * a for (o, q), b in found.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(rows[:top])]
    return sorted(out)


def phrase_rows(seed=3, n=120):
    rng = np.random.default_rng(seed)
    words = [*"the of and new york times said at é ß".split(), *(f"x{i}" for i in range(25))]
    p = 1 / np.arange(1, len(words) + 1)
    own = [" ".join(str(w) + rng.choice(["", "", "", ",", ".\n", "\t"]) for w in rng.choice(words, 40, p=p / p.sum())) for _ in range(n)]
    return [(t.replace("new", "New YORK times"), ["en", "de", None, "und"][i % 4]) for i, t in enumerate(own)] + [(None, "en"), ("", "fr"), ("!?", "en"), ("the of " * 3000, "en"), ("a b", "en")] * 2


@pytest.mark.parametrize("least,kept,top", [(3, 80, 2000), (30, 80, 5), (4, 60, 11)])
def test_phrases_equal_counting_of_all(spark, least, kept, top):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({k: F.lit(1) for k in ("p", "h1", "c", "f", "s", "part", "score")}).repartition(3)
    assert sorted(tuple(r) for r in phrases.collocations(df, least, kept, top).collect()) == collocated(rows, least, kept, top)
    assert phrases.collocations(df.limit(0), least).count() == 0


def test_words_that_share_a_hash_get_others(spark):
    df = spark.createDataFrame(phrase_rows(), "text string, lang string")
    spelled = lambda counts, words: sorted((r.lang, tuple(names.get(h) for h in r.p), r.f) for names in [{w.h: w.word for w in words.collect()}] for r in counts.collect())
    counts, words = phrases.phrase_counts(df, 5)
    clash = {r.h % (1 << 64) for r in words.collect() if r.word in ("the", "york")}
    again = phrases.phrase_counts(df, 5, frozenset(clash))
    assert len(clash) >= 4 and not clash & {r.h % (1 << 64) for r in again[1].collect()}
    assert spelled(counts, words) == spelled(*again)


def test_rows_are_shortened_alike_in_chunks_of_any_size(monkeypatch):
    rng = np.random.default_rng(5)
    h = np.array([1, 2, 3, 4, 5, 6, 7], np.int64)[rng.integers(0, 7, (4000, 4))] << 32
    h[:, 0] += rng.integers(0, 2, 4000)
    for k in range(1, 4):
        h[rng.random(4000) < 0.2, k:] = 0
    h[:1500, :2] = [9 << 32, 9 << 32]
    h = h[np.lexsort((h[:, 3], h[:, 2], h[:, 1], h[:, 0], h[:, 1] >> 32, h[:, 0] >> 32))]
    rows = np.column_stack((np.zeros(len(h), np.int64), h, np.ones(len(h), np.int64)))
    whole = Counter(tuple(r[: k + 1]) for r in h.tolist() for k in range(4) if r[k])
    for chunk, size in ((10**6, 4000), (100, 37), (7, 1), (400, 1000)):
        monkeypatch.setattr(phrases, "CHUNK", chunk)
        cut = phrases._stepped(phrases._stepped((rows[i : i + size] for i in range(0, len(rows), size)), 20, 2, range(4, 1, -1)), 20, 1, range(1, 0, -1))
        got = Counter()
        for r in (x for part in cut for x in part.tolist()):
            for k in range(4):
                if r[k + 1]:
                    got[tuple(r[1 : k + 2])] += r[5]
        assert {k: v for k, v in got.items() if v >= 20} == {k: v for k, v in whole.items() if v >= 20}


# lines


def lines_left(rows, least):
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    found = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for doc, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if found[key(x)] < least]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,batches,fanout", [(3, 1, 2), (3, 5, 2), (1, 4, 3), (40, 6, 3)])
def test_lines_equal_counting_of_all(spark, least, batches, fanout):
    rng = np.random.default_rng(7)
    pool = ["Common line", " common LINE\t", "\x85é", "", "  ", *(f"line {i}" for i in range(60))]
    rows = [(i, "\n".join(rng.choice(pool, rng.integers(0, 8)))) for i in range(60)] + [(1, "x\ny"), (1, "x\ny"), (None, "x"), (None, None), (2, ""), (3, "\n\n"), (4, "hot\n" * 5000)] + [(100 + i, f"hot\nown {i}") for i in range(50)]
    names = ("n_lines", "n_dropped", "kept_text", "gone", "h", "_gone", "_key", "text_key", "batch", "n")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(k) for k in names})
    got = linededup.dedup_lines(df, least, batches, fanout).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=str) == lines_left(rows, least)
    assert all(r[k] == k for r in got for k in names[3:])
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_runs_keep_first_lines_and_open_again(spark):
    path = scratch(spark, "test-runs")
    frame = lambda words: spark.createDataFrame([(hashlib.md5(w.encode()).digest() if w else None,) for w in words], "h binary")
    name = {hashlib.md5(w.encode()).digest(): w for w in "abcdefgh"}
    added = []
    for i, batch in enumerate(["aab", "bc", "", "cad", ["e", None, "a"], "fga", "hb"]):
        runs = linededup.LineRuns(spark, path, 1, 2)
        added.append({name[bytes(r.h)]: r.n for r in runs.add(frame(batch)).collect()})
        assert sum(len(x) for x in runs.levels) <= 1 + i.bit_length() and all(len(x) < 2 for x in runs.levels)
    assert added == [{"a": 2, "b": 1}, {"c": 1}, {}, {"d": 1}, {"e": 1}, {"f": 1, "g": 1}, {"h": 1}]
    runs = linededup.LineRuns(spark, path, 1, 2)
    assert {name[bytes(r.h)] for r in runs.reached().collect()} == set("abcdefgh")
    assert len(runs.runs()) == 3
    runs.drop()
