from __future__ import annotations

from datetime import datetime, timedelta

from crawlgrain.schemas import EVENTS
from crawlgrain.streaming import events as E

T0 = datetime(2024, 1, 1)


def write(spark, path, rows):
    spark.createDataFrame([(i, T0 + timedelta(seconds=s), 1, kind, float(i), None) for i, s, kind in rows], EVENTS).coalesce(1).write.mode("append").parquet(str(path))


def test_counters_go_on_from_their_checkpoint(spark, tmp_path):
    write(spark, tmp_path / "in", [(1, 0, "fetched"), (2, 1, "fetched"), (3, 2, "skipped")])
    stream = E.counters(E.read_events(spark, str(tmp_path / "in"), 1))
    assert {x.event_type: x.n for x in E.run_once(stream, str(tmp_path / "c"), "counts_a").collect()} == {"fetched": 2, "skipped": 1}
    write(spark, tmp_path / "in", [(4, 3, "skipped")])
    assert {x.event_type: x.n for x in E.run_once(stream, str(tmp_path / "c"), "counts_b").collect()} == {"fetched": 2, "skipped": 2}


def test_rates_match_the_batch(spark, tmp_path):
    write(spark, tmp_path / "in", [(k, 7 * k, "fetched") for k in range(60)])
    stream = E.rates(E.read_events(spark, str(tmp_path / "in")))
    got = {x.start: (x.n, x.per_second) for x in E.run_once(stream, str(tmp_path / "c"), "rates_a").collect()}
    assert got == {x.start: (x.n, x.per_second) for x in E.rates(spark.read.parquet(str(tmp_path / "in"))).collect()} and sum(n for n, _ in got.values()) == 60


def test_deduplication_and_recent(spark, tmp_path):
    write(spark, tmp_path / "in", [(1, 0, "a"), (1, 1, "a"), (2, 2, "a")])
    write(spark, tmp_path / "in", [(2, 3, "a"), (3, 4, "a")])
    stream = E.read_events(spark, str(tmp_path / "in"), 1)
    E.write_stream(E.distinct_events(stream), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert sorted(x.event_id for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
    E.keep_recent(stream, str(tmp_path / "recent"), str(tmp_path / "c2"), 2)
    assert sorted(x.event_id for x in spark.read.parquet(str(tmp_path / "recent" / "1")).collect()) in ([2, 3], [1, 2])
