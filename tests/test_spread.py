"""Costly work on small rows is dealt to many tasks, and bounded in each."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import pages as P
from shelfmark.plans import fixtures as X

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@tables
@pytest.mark.parametrize("rows", [X.image_files, X.product_pages, X.tier_pages, X.branch_pages])
def test_small_files_are_dealt_out(spark, rows):
    """Each file of the tables is one small row group, so that without dealing it is one task."""
    assert rows(spark, SF).rdd.getNumPartitions() >= 16


def test_pages_are_parsed_in_bounded_batches():
    n = 2 * P.PAGES_AT_ONCE + 1
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["https://a.example/"] * n, "html": ['<li class="item"><h2>x</h2></li>'] * n})
    out = list(P._parse("items")(iter([batch])))
    assert [b.num_rows for b in out] == [P.PAGES_AT_ONCE, P.PAGES_AT_ONCE, 1]
    assert [x for b in out for x in b.column("page_id").to_pylist()] == list(range(n))
    assert all(len(x) == 1 for b in out for x in b.column("items").to_pylist())


@tables
def test_products_are_dealt_by_their_job_once(spark):
    own = X.products(spark, SF).groupBy("job_id").agg(F.collect_list("name").alias("names"))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(job_id") == 1 and "Exchange hashpartitioning(l_orderkey" not in plan


def test_repeated_parts_leave_the_numbers_of_lines(spark, tmp_path):
    """A part that is there twice gives two rows of one number, and an unknown part uses up a number, as in the SQL."""
    line = [(1, k, part, 0, 2.0, 1.0, 0.0, 0.0, "N", "O", None) for k, part in enumerate((5, 6, 7))]
    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(line, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5, "a", 1.0), (5, "b", 1.0), (7, "c", 1.0)], "p_partkey long, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r.product_index, r.name) for r in X.products(spark, str(tmp_path)).collect())
    assert got == [(0, "a"), (0, "b"), (2, "c")]
