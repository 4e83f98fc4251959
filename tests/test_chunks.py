"""Replay of cached chunks: closed, open, older layout, broken and missing files; filters choose files."""

import json

import pytest
from pyspark.sql import functions as F

from panelforge.plans import collection_queries
from panelforge.sources import chunks as ch

LABELS = ["20230101", "20240101", "20250101"]
DAY = 86_400_000


def payload(first, n, plus=0.0, short=0):
    days = [(first + k) * DAY for k in range(n)]
    return {"prices": [[t, 1.0 + k + plus] for k, t in enumerate(days)], "market_caps": [[t, 10.0 * k] for k, t in enumerate(days)], "total_volumes": [[t, None if k % 2 else 2.0] for k, t in enumerate(days[: n - short])]}


@pytest.fixture
def folder(tmp_path):
    put = lambda name, x: (tmp_path / f"{name}.json").write_text(x if isinstance(x, str) else json.dumps(x))
    put("btc_20230101", payload(19358, 3))
    put("btc_20240101", payload(19360, 3, 100.0, short=2))  # its first day is the last of the chunk before
    put("btc_20250101", payload(20089, 2))  # open: read, and due again
    put("eth_20230101", "{broken")
    put("eth", payload(20089, 4, 7.0))  # the older layout stands in for the last chunk alone
    put("two_words_20230101", payload(19358, 1))
    return str(tmp_path)


def test_plan_tells_files_and_what_is_due():
    files = ["a_20230101", "a_20250101", "b", "c_d_20240101"]
    got = {(n, label): (file, again) for n, label, file, again in ch.plan(files, LABELS)}
    assert got["a", "20230101"] == ("a_20230101", False) and got["a", "20240101"] == (None, True) and got["a", "20250101"] == ("a_20250101", True)
    assert got["b", "20230101"] == (None, True) and got["b", "20250101"] == ("b", True) and got["c_d", "20240101"] == ("c_d_20240101", False)
    assert ch.plan([], LABELS, ["new"]) == [("new", label, None, True) for label in LABELS]


def test_replay_merges_chunks_by_time(spark, folder):
    rows = {(r.name, r.day): r for r in ch.chunks(spark, folder, LABELS).withColumn("day", F.unix_date(F.col("ts").cast("date"))).collect()}
    assert sorted(d for n, d in rows if n == "btc") == [19358, 19359, 19360, 19361, 19362, 20089, 20090]
    assert rows["btc", 19360].price == 101.0 and rows["btc", 19360].mcap == 0.0 and rows["btc", 19360].volume == 2.0 and rows["btc", 19361].volume is None
    assert sorted(d for n, d in rows if n == "eth") == [20089, 20090, 20091, 20092] and rows["eth", 20089].price == 8.0
    assert [d for n, d in rows if n == "two_words"] == [19358]
    want = {("btc", "20250101"), ("eth", "20230101"), ("eth", "20240101"), ("eth", "20250101"), ("two_words", "20240101"), ("two_words", "20250101")}
    assert {tuple(r) for r in ch.due(spark, folder, LABELS).collect()} == want


def test_filters_choose_partitions(spark, folder):
    ch.register(spark)
    found = spark.read.format("chart_chunks").option("path", folder).option("labels", ",".join(LABELS)).load().filter("name = 'btc' and label >= '20240101' and price > 1")
    assert found.rdd.getNumPartitions() == 2 and found.count() == 4


def test_empty_folder(spark, tmp_path):
    assert ch.chunks(spark, str(tmp_path), LABELS).count() == 0 and ch.due(spark, str(tmp_path), LABELS, ["x"]).count() == 3


@pytest.mark.parametrize("points, most", [(50_000, 24), (1, 1)])
def test_busy_days_are_cut_into_hours(spark, sf, monkeypatch, tmp_path, points, most):
    """No chunk spans more hours than its points allow; what is replayed does not depend on it."""
    whole = {tuple(r) for r in collection_queries.chunk_replay(spark, sf).collect()}
    monkeypatch.setattr(collection_queries, "CHUNK_POINTS", points)
    monkeypatch.setattr(collection_queries, "shared_path", lambda *_: str(tmp_path / "chunks"))
    assert {tuple(r) for r in collection_queries.chunk_replay(spark, sf).collect()} == whole
    times = [[p[0] // 3_600_000 for p in json.loads(f.read_text())["prices"]] for f in (tmp_path / "chunks").glob("*.json")]
    assert times and all(max(t) - min(t) < most for t in times)
