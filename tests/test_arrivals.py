from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from quillspark.streaming import arrivals

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("kind", T.StringType())])
DAY = datetime(2024, 1, 1)


def at(hours):
    return DAY + timedelta(hours=hours)


class Feed:
    """Files that a stream reads one by one."""

    def __init__(self, spark, tmp_path):
        self.spark, self.folder, self.root, self.n = spark, str(tmp_path / "in"), str(tmp_path / "out"), 0

    def bring(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{self.folder}/{self.n}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(self.folder)

    def follow(self):
        got = arrivals.followed(self.spark, self.stream(), SCHEMA, "id", "ts", "kind", "1 hour", "2 hours", self.root)
        return Counter({(r.start, r.kind): r.n for r in got.collect()})

    def late(self):
        return sorted(r.id for r in arrivals.late(self.spark, self.root, SCHEMA).collect())


def windows(rows, until):
    """Counts of each hour that ends by until, each id once."""
    once = {i: (ts.replace(minute=0, second=0), kind) for i, ts, kind in rows}
    return Counter(w for w in once.values() if w[0] + timedelta(hours=1) <= until)


def test_late_rows_restart_and_repeated_rows(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    first = [(k, at(k / 4), "ab"[k % 2]) for k in range(20)]  # up to 4:45
    feed.bring(first)
    assert feed.follow() == windows(first, at(2.75)) and feed.late() == []
    second = [(100, at(3.5), "a"), (101, at(2.8), "b"), (19, first[19][1], "b"), (102, at(9), "a")]  # 19 comes twice
    feed.bring([*second, (200, at(1), "a"), (201, None, "a"), (202, at(2.74), "a")])
    assert feed.follow() == windows(first + second, at(7)) and feed.late() == [200, 201, 202]
    third = [(103, at(7.5), "a"), (104, at(20), "b")]
    feed.bring([*third, (203, at(6.9), "a")])
    assert feed.follow() == windows(first + second + third, at(18)) and feed.late() == [200, 201, 202, 203]
    assert feed.follow() == windows(first + second + third, at(18))  # nothing new


def test_a_batch_that_failed_splits_as_the_first_time(spark, tmp_path, monkeypatch):
    feed = Feed(spark, tmp_path)
    rows = [(k, at(k), "a") for k in range(8)]
    feed.bring(rows)
    feed.follow()
    feed.bring([(50, at(30), "a"), (51, at(6), "a"), (52, at(4.9), "a")])
    real = arrivals.MARKS
    monkeypatch.setattr(arrivals, "MARKS", "_marks/batch=0/part")  # the note can't be written: a file can't hold folders
    monkeypatch.setattr(arrivals, "read", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(Exception, match="killed"):
        feed.follow()
    monkeypatch.undo()
    assert arrivals.MARKS == real
    assert feed.follow() == windows([*rows, (50, at(30), "a"), (51, at(6), "a")], at(28)) and feed.late() == [52]


def test_a_batch_that_died_after_its_rows_were_written(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.bring([(k, at(k), "a") for k in range(8)])
    feed.follow()
    feed.bring([(50, at(30), "a"), (51, at(6), "a"), (52, at(4.9), "a")])
    arrivals.sift(spark, feed.stream(), "ts", "2 hours", feed.root, f"{feed.root}/_sifted").awaitTermination()
    commit = tmp_path / "out" / "_sifted" / "commits" / "1"  # as if the driver had died before it said so
    commit.unlink()
    (commit.parent / ".1.crc").unlink(missing_ok=True)
    assert feed.follow() == windows([(k, at(k), "a") for k in range(8)] + [(50, at(30), "a"), (51, at(6), "a")], at(28)) and feed.late() == [52]
