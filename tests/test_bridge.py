"""The driver's tables as tasks read them."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tokenloom import bridge
from tokenloom.catalog import load


@pytest.fixture
def small_splits(spark):
    """Splits far smaller than a row group."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "16384")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def _shares(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path, small_splits, monkeypatch):
    ids = [i * 7919 % 104_729 for i in range(40_000)] + [None, None, 5, 5]
    pq.write_table(pa.table({"id": ids}), tmp_path / "t.parquet", row_group_size=len(ids))
    assert bridge.read(spark, str(tmp_path), "t").rdd.getNumPartitions() >= 4
    assert max(_shares(bridge.read(spark, str(tmp_path), "t"))) == len(ids)
    spread = bridge.read_spread(spark, str(tmp_path), "t")
    assert max(_shares(spread)) < len(ids) / 2
    monkeypatch.setattr(bridge, "SPREAD_ROWS", 2_000)
    finer = bridge.read_spread(spark, str(tmp_path), "t")
    assert max(_shares(finer)) <= 4_000
    order = lambda values: sorted(values, key=lambda v: (v is not None, v))
    assert order(r["id"] for r in finer.collect()) == order(ids)


def test_even_splits_stay(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(bridge, "SPREAD_ROWS", 4_000)
    ids = [i * 7919 % 104_729 for i in range(40_000)]
    pq.write_table(pa.table({"id": ids}), tmp_path / "t.parquet", row_group_size=1_000)
    plan = bridge.read_spread(spark, str(tmp_path), "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan


def test_empty_table_is_read(spark, tmp_path):
    pq.write_table(pa.table({"id": pa.array([], pa.int64())}), tmp_path / "t.parquet")
    assert bridge.read_spread(spark, str(tmp_path), "t").count() == 0


def test_headers_are_dealt_out(spark, tmp_path):
    n = 400
    rows = {
        "c_custkey": list(range(n)),
        "c_name": [f"c{i}" for i in range(n)],
        "c_nationkey": [i % 5 for i in range(n)],
        "c_mktsegment": ["x"] * n,
    }
    pq.write_table(pa.table(rows), tmp_path / "customer.parquet")
    assert max(_shares(bridge.linear_headers(spark, str(tmp_path)))) < 3 * n / 2


def test_texts_are_read_behind_the_dealing_out(spark, tmp_path):
    n = 60
    kinds = ["purchase", "signup", "click", "error", "view"]
    rows = {
        "event_id": list(range(n)),
        "ts": [dt.datetime(2024, 1, 1, 0, 0, i) for i in range(n)],
        "user_id": [i % 3 for i in range(n)],
        "event_type": [kinds[i % 5] for i in range(n)],
        "value": [i / 10 for i in range(n)],
        "props": ['{"k": %d}' % i for i in range(n)],
    }
    pq.write_table(pa.table(rows), tmp_path / "events.parquet")
    texts = load().QUERIES["transcript_text_linear"](spark, str(tmp_path))
    assert "Repartition" not in texts._jdf.queryExecution().optimizedPlan().toString()
    found = {r["event_id"]: r["fp"] for r in texts.collect()}
    assert 0 not in found and 1 in found and all(found.values())
