import datetime

from terralex.streaming import feed


def rows(spark, values):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    return spark.createDataFrame([(room, key, "n", 1.0, 2.0, by, "#00ff00", at(m)) for room, key, by, m in values], feed.FOUND)


def test_upsert_keeps_the_first_arrival(spark, tmp_path):
    src, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    rows(spark, [("A", "k", "x", 5), ("A", "l", "x", 6), ("A" * 13, "k", "x", 1)]).write.mode("append").parquet(src)
    run = lambda: feed.finish(feed.upsert(feed.valid(feed.feed(spark, src)), out, state), 120)
    assert run()
    rows(spark, [("A", "k", "y", 1), ("B", "k", "y", 2)]).write.mode("append").parquet(src)
    assert run() and run()
    assert sorted((r.room, r.key, r.by) for r in spark.read.parquet(out).collect()) == [("A", "k", "x"), ("A", "l", "x"), ("B", "k", "y")]


def test_live_and_roster(spark, tmp_path):
    src = str(tmp_path / "in")
    rows(spark, [("A", "k", "x", 1), ("B", "k", "y", 2), ("A", "m", "x", 9)]).write.parquet(src)
    seen = []
    query = feed.notify(feed.live(feed.feed(spark, src), "A"), lambda batch, i: seen.extend(batch.collect()), str(tmp_path / "s"))
    assert feed.finish(query, 120) and sorted(r.key for r in seen) == ["k", "m"] and all(r.live for r in seen)
    states = []
    query = feed.notify_updates(feed.roster(feed.feed(spark, src)), lambda batch, i: states.extend(batch.collect()), str(tmp_path / "r"))
    assert feed.finish(query, 120)
    assert {(r.by, r.gone) for r in states} >= {("x", False), ("y", False)}


def test_room_reads_history_after_the_stream(spark, tmp_path):
    from terralex.streaming.room import Room

    src = str(tmp_path / "in")
    rows(spark, [("A", f"k{i:03d}", "x", i % 60) for i in range(25)] + [("B", "k", "y", 1)]).write.mode("append").parquet(src)
    seen = []
    room = Room(spark, src, lambda batch, live: seen.append((live, sorted(r.key for r in batch.collect()), {r.room for r in batch.collect()})), page=10)
    assert not room.join("not a room") and not room.join(None) and room.epoch == 0
    assert room.join(" a ")
    room.query.processAllAvailable()
    pages = [keys for live, keys, _ in seen if not live]
    assert [len(p) for p in pages] == [10, 10, 5] and sorted(sum(pages, [])) == [f"k{i:03d}" for i in range(25)]
    rows(spark, [("A", "new", "x", 1), ("B", "other", "x", 1)]).write.mode("append").parquet(src)
    room.query.processAllAvailable()
    assert "new" in {k for live, keys, _ in seen if live for k in keys} and {r for *_, own in seen for r in own} == {"A"}
    # an older epoch's rows are dropped, and joining anew leaves the old room
    old = room.query
    assert room.join("B") and not old.isActive and room.code == "B"
    room.leave()
    assert room.query is None and room.code is None
    assert Room(spark, str(tmp_path / "none"), lambda *_: None).history("A", lambda: False) is False


def test_room_retries_and_gives_up(spark):
    import pytest

    from terralex.streaming.room import retried

    waits, tries = [], []

    def fails():
        tries.append(1)
        raise OSError("gone")

    with pytest.raises(OSError):
        retried(fails, sleep=waits.append)
    assert len(tries) == 3 and waits == [0.5, 1.0]
    assert retried(fails, wanted=lambda: False, sleep=waits.append) is None and len(tries) == 4
    assert retried(lambda: 7) == 7


def test_history_stays_out_of_the_driver(spark, tmp_path):
    """Pages are staged rows that the driver never holds, few even where there are many, and whole where a key has several rows."""
    from terralex.streaming.room import Room

    src = str(tmp_path / "in")
    rows(spark, [("A", f"k{i // 3:04d}", "x", i % 60) for i in range(3000)]).repartition(7).write.parquet(src)
    pages = []
    assert Room(spark, src, lambda page, live: pages.append(page), page=10).history("A", lambda: True)
    assert all("LocalRelation" not in p._jdf.queryExecution().toString() and "LogicalRDD" not in p._jdf.queryExecution().toString() for p in pages)
    sizes = [p.count() for p in pages]
    assert sizes[:4] == [10, 10, 20, 40] and sum(sizes) == 3000 and len(pages) == 10
    keys = [sorted(r.key for r in p.collect()) for p in pages]
    assert sum(keys, []) == sorted(f"k{i // 3:04d}" for i in range(3000))
    # an epoch that ends in between ends the history
    seen = []
    assert Room(spark, src, lambda page, live: seen.append(1), page=10).history("A", lambda: len(seen) < 2) is False and len(seen) == 2
