import threading
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import feed
from palimpsest.streaming.feed import ActivityFeed, Cancelled, DisposedError, ManualClock, WaitTimeoutError, default_timeout, take_per_entity_stream

SCHEMA = "seq long, entity_id string, kind string, ts timestamp"


def events(spark, start, count, entity=lambda n: str(n % 3)):
    return spark.createDataFrame([(n, entity(n), feed.WRITE, None) for n in range(start, start + count)], SCHEMA)


def seqs(df):
    return sorted(r.seq for r in df.select("seq").collect())


def test_history_is_cut_before_filters(spark):
    e = events(spark, 1, 600)
    assert seqs(feed.history(e)) == list(range(345, 601))
    assert len(seqs(feed.history(e).where(F.col("entity_id") == "0"))) in (85, 86)


def test_replay_has_no_gap_and_no_duplicate(spark):
    e = events(spark, 1, 600)
    assert seqs(feed.feed(e, 400, replay=True)) == list(range(145, 601)) and seqs(feed.feed(e, 400)) == list(range(401, 601))


def test_take_and_wait(spark):
    e = events(spark, 1, 30)
    assert seqs(feed.take(e, 5)) == [1, 2, 3, 4, 5]
    assert seqs(feed.take_per_entity(e, 1)) == [1, 2, 3]
    rows = {r.entity_id: (r.seq, r.attempts) for r in feed.first_when(e, F.lit(1), lambda s: s >= 2).collect()}
    assert rows == {"1": (4, 3), "2": (5, 3), "0": (6, 3)}


def test_ingest_and_stores(spark):
    raw = spark.createDataFrame([(1, "write", True, False, "I"), (2, "write", False, False, "I"), (3, "read", True, True, "I"), (4, None, False, False, "I"), (5, None, True, False, "host.X")], "seq int, operation string, ok boolean, hidden boolean, iface string").withColumn("entity_id", F.lit(1))
    out = feed.ingest(raw, interface="iface", system_prefix="host.", succeeded="ok", suppressed="hidden")
    assert [(r.seq, r.kind) for r in out.orderBy("seq").collect()] == [(1, feed.WRITE), (4, feed.CALL)]
    assert feed.stores(("a", raw), ("a", raw)).count() == 5
    with pytest.raises(KeyError):
        feed.stores(("zz", raw), known={"a"})


def test_live_feed_subscribe_wait_and_close(spark, tmp_path):
    clock = ManualClock()
    live = ActivityFeed(spark, str(tmp_path / "f"), SCHEMA, clock=clock.now)
    live.publish(events(spark, 1, 3))
    seen, done = [], threading.Event()
    live.subscribe(lambda rows, _: seen.extend(seqs(rows)))
    again = []
    live.subscribe(lambda rows, _: again.extend(seqs(rows)), replay=True)
    tries = []

    def assertion():
        tries.append(1)
        if len(tries) < 2:
            raise AssertionError("not yet")
        return "value"

    def later():
        done.wait(3)
        live.publish(events(spark, 4, 1, entity=lambda n: "other"))
        live.publish(events(spark, 5, 1, entity=lambda n: "mine"))

    threading.Thread(target=later).start()
    done.set()
    assert live.wait_for(assertion, entity="mine", timeout=60) == "value" and len(tries) == 2
    with pytest.raises(WaitTimeoutError, match="Timed out waiting for") as e:
        live.wait_for(lambda: 1 / 0, timeout=0.3)
    assert isinstance(e.value.__cause__, ZeroDivisionError)
    flag = threading.Event()
    flag.set()
    with pytest.raises(Cancelled):
        live.wait_for(lambda: 1, cancelled=flag)
    for q in live._queries:
        if q.isActive:
            q.processAllAvailable()
    assert sorted(seen) == [4, 5] and sorted(again) == [1, 2, 3, 4, 5]
    live.close()
    live.publish(events(spark, 9, 1))
    with pytest.raises(DisposedError):
        live.table()
    with pytest.raises(ValueError):
        clock.advance(timedelta(seconds=-1))
    assert clock.advance(timedelta(hours=1)).hour == 1 and default_timeout() > 0


def test_stateful_take(spark, tmp_path):
    live = ActivityFeed(spark, str(tmp_path / "g"), SCHEMA)
    live.publish(events(spark, 1, 12))
    q = take_per_entity_stream(live.stream(replay=True), 2).writeStream.format("memory").queryName("taken").outputMode("append").start()
    try:
        q.processAllAvailable()
        live.publish(events(spark, 13, 6))
        q.processAllAvailable()
        assert seqs(spark.table("taken")) == [1, 2, 3, 4, 5, 6]
    finally:
        q.stop()
        live.close()
