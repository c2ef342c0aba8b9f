"""What Spark may broadcast: tables that it sizes too low stay on executors."""

import re

from pyspark.sql import functions as F

from shelfmark.llm import nearcopies, simhash, substrings


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_fingerprints_are_not_broadcast(spark):
    """33 cells a fingerprint are sized as the fingerprints, small enough for the driver as Spark sees it."""
    pairs = simhash.near_prints(spark.range(1000).select(F.xxhash64("id").alias("bits")))
    assert "BroadcastHashJoin" not in plan(pairs) and "SortMergeJoin" in plan(pairs)
    own = spark.createDataFrame([(b,) for b in (0, 1, 3, 7, 1 << 63 - 1)], "bits long")
    assert {tuple(r) for r in simhash.near_prints(own).collect()} == {(0, 1), (0, 3), (0, 1 << 62), (1, 3), (1, 7), (1, 1 << 62), (3, 7)}


def test_sets_that_meet_are_not_broadcast(spark):
    """Written, bitmaps and early shingles that repeat from row to row are a fraction of their size."""
    rows = spark.range(9).selectExpr("id % 3 + 1 AS h", "10 * (id div 3 + 1) AS id", "10 * (id div 3 + 1) AS part", "array(1L, 2L, 3L) AS early")
    met = nearcopies._met(rows, F.expr("a.id + b.id < 50"))
    assert "BroadcastHashJoin" not in plan(met)
    assert sorted(map(tuple, met.collect())) == [(10, 20), (10, 30)]  # the first common shingle alone


def test_edges_and_spans_are_not_broadcast(spark, monkeypatch):
    plans = {}
    write = substrings.written
    monkeypatch.setattr(substrings, "written", lambda df, name: plans.setdefault(name, plan(df)) and write(df, name))
    same = [f"s{i}" for i in range(120)]
    texts = [(1, " ".join(["a", *same])), (2, " ".join(["b", *same[:80], "c"])), (3, " ".join(["d", *same[40:], "e"])), (4, "f g")]
    out = substrings.dedup_substrings(spark.createDataFrame(texts, "doc_id long, text string"))
    joins = [re.findall(r"BroadcastHashJoin \[([^]]*)\]", x) for x in (plans["walked"], plans["joined"], plans["checked"], plan(out))]
    names = [[re.findall(r"([a-z_]+)#", keys) for keys in found] for found in joins]
    assert ["body"] not in names[0] and ["src_doc", "src_pos", "n"] not in names[1]
    assert ["src_doc", "src_pos", "words"] not in names[2] and ["doc_id"] not in names[3]
    assert {r.doc_id: (r.n_removed, r.kept_text) for r in out.collect()} == {1: (0, texts[0][1]), 2: (80, "b c"), 3: (80, "d e"), 4: (0, "f g")}
