"""What the leaderboard's state asks of Spark."""

from __future__ import annotations

import datetime

from promptmatrix.llm import leaderboard


def test_stores_do_not_outlive_their_tasks():
    own = "spark.sql.streaming.stateStore."
    assert leaderboard.SETTINGS[f"{own}unloadOnCommit"] == "true" and leaderboard.SETTINGS[f"{own}rocksdb.boundedMemoryUsage"] == "true"


def test_only_ladders_have_stores(spark, monkeypatch):
    """Each start opens a store for each partition of each stateful step, and Spark never gives back all of its memory."""
    steps = []

    def seen(feed, name, drop=leaderboard.Feed.drop):
        if name == "state":
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(feed.path("state/state"))
            files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            steps.extend(x.getPath().getName() for x in files.listStatus(place))
        drop(feed, name)

    monkeypatch.setattr(leaderboard.Feed, "drop", seen)
    sale = [(1, 1, 1, 1, 2, 3.0, None, datetime.datetime(2024, 1, 5))]
    lines = spark.createDataFrame(sale, "sale_id long, item_id long, vendor_id long, line_no int, quantity int, amount double, flag string, shipped_at timestamp")
    got = leaderboard.run(lines, spark.createDataFrame([(1, 2.0)], "item_id long, price double"), spark.createDataFrame([(1, 7)], "vendor_id long, nation_id int"))
    assert [(r.nation_id, r.item_id, r.change, r.old_rank, r.new_rank, r.revenue) for r in got.collect()] == [(7, 1, "enter", None, 1, 300)]
    assert steps == ["0"]
