"""Corpora that Spark builds otherwise than their SQL says: the same rows with less work."""

from __future__ import annotations

import re

import pytest

from quire.sources.corpora import BUILT, CORPORA, corpus

ORDERS = "o_orderkey long, o_custkey long"
ITEMS = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity decimal(15,2), l_extendedprice decimal(15,2), l_discount decimal(15,2), l_tax decimal(15,2), l_returnflag string, l_linestatus string"


@pytest.fixture
def tables(spark, tmp_path):
    from decimal import Decimal as D

    # Orders without items, of nobody, of one number twice; items of no order, with nulls, and equal but for one key.
    orders = [(1, 7), (2, 7), (5, 7), (10, 8), (11, None), (12, 9), (12, 9), (13, None), (15, 10), (15, 11), (None, 12), (-3, 12), (27, 12), (27, 12)]
    item = lambda o, n, pk=3, sk=1, q="1", e="2", d="0", t="0", flag="N", status="F": (o, n, pk, sk, *[None if x is None else D(x) for x in (q, e, d, t)], flag, status)
    items = [
        item(1, 2), item(1, 1, pk=22), item(1, 1, pk=22, e="1.5"), item(1, 1, sk=None), item(2, 1, status="O"), item(2, 2, flag="R"), item(2, 3, flag=None, status=None), item(5, None, pk=None),
        item(10, 1, t="0.01"), item(10, 1, t=None), item(11, 1), item(12, 1), item(12, 2, q=None), item(15, 4, d="0.1"), item(99, 1),
    ]
    spark.createDataFrame(orders, ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def _by_sql(spark, folder: str, name: str):
    sql = re.sub(r"\b(FROM|JOIN) (orders|lineitem)\b", rf"\1 parquet.`{folder}/\2.parquet` AS \2", CORPORA[name])
    return spark.sql(sql)


@pytest.mark.parametrize("name", sorted(BUILT))
@pytest.mark.parametrize("folder", ["odd", "/root/testdata/sf0.001"])
def test_built_corpora_are_their_sql(spark, tables, name, folder):
    folder = tables if folder == "odd" else folder
    want, got = _by_sql(spark, folder, name), corpus(spark, folder, name)
    assert got.dtypes == want.dtypes
    assert want.count() > 0 and want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_book_reads_items_once_and_moves_no_finished_lines(spark):
    plan = corpus(spark, "/root/testdata/sf0.001", "book_md")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet .*l_orderkey", plan)) == 1
    made = plan.index("Generate")
    assert "Exchange" not in plan[:made] and "Exchange" in plan[made:]


def test_repeats_sort_orders_not_lines(spark):
    plan = corpus(spark, "/root/testdata/sf0.001", "repeat_md")._jdf.queryExecution().executedPlan().toString()
    made = plan.index("Generate")
    assert "Sort" not in plan[:made] and plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
