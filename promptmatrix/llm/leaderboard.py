"""A change feed of leaderboards: the ten items of highest running revenue of each nation, after each day of arrival.

A stateful streaming query keeps, for every shard of the pairs of nation and
item, a ladder: MapState maps bands of revenue to the sets of items in them,
each item beside its revenue.  After each arrival day of a batch the highest
occupied bands are scanned until ten items of a nation are collected; if that
board differs from the one before, it is written together with the items that
have left it.  When all batches are in, the boards of at most FAN shards are
merged day by day, and what changed in their own ten is passed on; levels of it
follow each other until one is left per nation, which gives the changes of rank.
No task holds more than a shard of a nation's items or the boards of FAN shards,
whatever the size of the input, and the number of shards follows the number of
items.

Only the ladders are state.  Spark opens a store for each partition of each
stateful step at each start, and of each store that was opened it keeps about
half a megabyte of native memory (its statistics, by core) until the executor
ends; so boards, of which ten items a shard matter, have no stores of their own.

Rows reach the state summed by nation, item and day within each task, so a hot
item gives a task's worth of sums, not of rows.

Defined results: a line without a nation or an items row is ignored, but its
day counts for lateness; repeated lines count each; several rows of an item or
vendor in the side tables read as the least price or nation; null amounts take
quantity times price, then nothing; NaN is nothing; columns of other names
than those read are ignored, so they can not clash; empty tables give an empty
feed.  Ties go to the smaller item.
"""

from __future__ import annotations

import contextlib
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from promptmatrix.llm.session import checkpoint_place, lean

#: Places of a board; shards whose boards one merge holds; items of a shard, about; steps of the ladder in each doubling of revenue.
PLACES, FAN, SHARD_ITEMS, STEPS = 10, 32, 4096, 2
#: Shards at least, for the cores to share.
LEAST_SHARDS = 256
#: Batches, the first arrival day and the number of days they are cut over, and days after which a line is too late.
BATCHES, FIRST_DAY, DAYS, LATE_DAYS = 8, 19723, 180, 15
#: Sums that a task holds before it hands them on.
HELD_SUMS = 1 << 18
_BOARD = "nation_id int, arrival_day long, shard long, items array<long>, cents array<long>, left array<long>, left_cents array<long>"
CHANGES = "nation_id int, arrival_day long, item_id long, change string, old_rank int, new_rank int, revenue long"


def batch_of(day: Any) -> Any:
    return F.least(F.lit(BATCHES), 1 + F.floor((day - FIRST_DAY) * BATCHES / DAYS)).cast("int")


def cut(lines: DataFrame, items: DataFrame, vendors: DataFrame) -> DataFrame:
    """Every line with its days, batch, nation (null if the line is to be ignored) and cents."""
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")))
    h = F.crc32(text.cast("binary"))
    shipped = F.coalesce(F.unix_date(F.to_date("shipped_at")).cast("long"), FIRST_DAY + h % 150)
    rows = lines.select("item_id", "vendor_id", "quantity", "amount", "flag", h.alias("h"), shipped.alias("shipped_day"))
    rows = rows.withColumn("arrival_day", F.col("shipped_day") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)).drop("h")
    prices = items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("price").alias("price")).withColumn("known", F.lit(True))
    nations = vendors.where("vendor_id IS NOT NULL").groupBy("vendor_id").agg(F.min("nation_id").alias("nation"))
    cents = lambda x: F.when(~F.isnan(x), F.floor(100 * x.cast("double") + 0.5))
    joined = rows.join(nations, "vendor_id", "left").join(prices, "item_id", "left")
    worth = F.coalesce(cents(F.col("amount")), F.col("quantity") * cents(F.col("price")), F.lit(0))
    return joined.select(
        F.when(F.col("known"), F.col("nation").cast("int")).alias("nation_id"), "item_id",
        F.when(F.col("flag") == "swapped", -worth).otherwise(worth).cast("long").alias("cents"),
        "shipped_day", "arrival_day", batch_of(F.col("arrival_day")).alias("batch"),
    )


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cents by nation, shard, item and day of what a task reads, as far as HELD_SUMS at a time."""
    keys, held = ["shard", "nation_id", "item_id", "arrival_day"], []

    def merged() -> pa.Table:
        out = pa.Table.from_batches(held) if isinstance(held[0], pa.RecordBatch) else pa.concat_tables(held)
        return out.group_by(keys, use_threads=False).aggregate([("cents", "sum")]).rename_columns([*keys, "cents"]).select([*keys, "cents"])

    rows, whole = 0, None
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= HELD_SUMS:
            part = merged()
            whole = part if whole is None else pa.concat_tables([whole, part])
            if whole.num_rows >= HELD_SUMS:
                held = [whole]
                whole = merged()
                if whole.num_rows >= HELD_SUMS // 2:
                    yield from whole.to_batches(1 << 15)
                    whole = None
            held, rows = [], 0
    if rows:
        part = merged()
        whole = part if whole is None else pa.concat_tables([whole, part])
    if whole is not None:
        held = [whole]
        yield from merged().to_batches(1 << 15)


def band(cents: int) -> int:
    """The step of the ladder of a positive revenue: STEPS of them in each doubling."""
    top = cents.bit_length() - 1
    return top * STEPS + ((cents << 3) // (1 << top) - 8) * STEPS // 8


def _packed(values: Iterable[int]) -> bytes:
    return np.fromiter(values, np.int64).tobytes()


def _unpacked(raw: bytes) -> list[int]:
    return np.frombuffer(bytes(raw), np.int64).tolist()


class Ladder(StatefulProcessor):
    """Revenue bands of one shard of the items of all nations; rows in: nation_id, item_id, arrival_day, cents."""

    OUT = -1  # the band of items without positive revenue: kept, never scanned

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bands = handle.getMapState("bands", "band int", "nations binary, items binary, cents binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.revenue: dict[tuple[int, int], int] = {}
        self.sets: dict[int, dict[int, set[int]]] = defaultdict(dict)  # by nation, then band
        for (b,), packed in self.bands.iterator():
            nations, items, cents = map(_unpacked, packed)
            self.revenue.update(zip(zip(nations, items, strict=True), cents, strict=True))
            for n, x in zip(nations, items, strict=True):
                self.sets[n].setdefault(b, set()).add(x)
        touched: set[int] = set()
        boards = {n: self.board(n) for n in list(self.sets)}
        came = pd.concat(list(rows)).groupby(["arrival_day", "nation_id", "item_id"], sort=True)["cents"].sum()
        out: list[tuple] = []
        for (day, nation), own in groupby(zip(*(came.index.get_level_values(i).tolist() for i in range(3)), came.tolist(), strict=True), itemgetter(0, 1)):
            for _, _, item, cents in own:
                self.add(nation, item, cents, touched)
            was, now = boards.get(nation, []), self.board(nation)
            if now != was:
                held = {x for x, _ in now}
                left = [x for x, _ in was if x not in held]
                out.append((nation, day, key[0], [x for x, _ in now], [c for _, c in now], left, [self.revenue[nation, x] for x in left]))
                boards[nation] = now
        for b in touched:
            own = [(n, x) for n in sorted(self.sets) for x in sorted(self.sets[n].get(b, ()))]
            if own:
                self.bands.updateValue((b,), (_packed(n for n, _ in own), _packed(x for _, x in own), _packed(self.revenue[k] for k in own)))
            else:
                self.bands.removeKey((b,))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _BOARD.split(", ")])

    def add(self, nation: int, item: int, cents: int, touched: set[int]) -> None:
        old = self.revenue.get((nation, item))
        new = self.revenue[nation, item] = (old or 0) + cents
        to = band(new) if new > 0 else self.OUT
        touched.add(to)
        sets = self.sets[nation]
        if old is not None:
            away = band(old) if old > 0 else self.OUT
            if away == to:
                return
            touched.add(away)
            sets[away].discard(item)
        sets.setdefault(to, set()).add(item)

    def board(self, nation: int) -> list[tuple[int, int]]:
        """The nation's items in the highest occupied bands until there are PLACES of them, best first."""
        found: list[tuple[int, int]] = []
        sets = self.sets[nation]
        for b in sorted(sets, reverse=True):
            if len(found) >= PLACES or b == self.OUT:
                break
            found += [(-self.revenue[nation, x], x) for x in sets[b]]
        return [(x, -c) for c, x in sorted(found)[:PLACES]]

    def close(self) -> None:
        pass


def best(boards: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    return [(x, -c) for c, x in sorted((-c, x) for b in boards.values() for x, c in b)[:PLACES]]


def merge(top: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The boards of up to FAN shards of one nation, merged; rows in: boards, rows out: boards, or at the top the changes of rank."""

    def merged(key: tuple, came: pd.DataFrame) -> pd.DataFrame:
        boards: dict[int, list[tuple[int, int]]] = {}
        was: list[tuple[int, int]] = []
        out: list[tuple] = []
        for day, part in came.sort_values(["arrival_day", "shard"], kind="stable").groupby("arrival_day", sort=True):
            gone: dict[int, int] = {}
            for s, items, cents, left, left_cents in zip(part["shard"], part["items"], part["cents"], part["left"], part["left_cents"], strict=True):
                boards[int(s)] = list(zip(map(int, items), map(int, cents), strict=True))
                gone.update(zip(map(int, left), map(int, left_cents), strict=True))
            now = best(boards)
            if now == was:
                continue
            worth = gone | {x: c for b in boards.values() for x, c in b}
            if top:
                old, new = ({x: i for i, (x, _) in enumerate(b, 1)} for b in (was, now))
                for x in sorted(old.keys() | new.keys()):
                    a, b = old.get(x), new.get(x)
                    if a != b:
                        out.append((key[0], int(day), x, "enter" if a is None else "exit" if b is None else "move", a, b, worth[x]))
            else:
                held = {x for x, _ in now}
                left = [x for x, _ in was if x not in held]
                out.append((key[0], int(day), key[1], [x for x, _ in now], [c for _, c in now], left, [worth[x] for x in left]))
            was = now
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in (CHANGES if top else _BOARD).split(", ")])
        return frame.astype({"old_rank": "Int32", "new_rank": "Int32"}) if top else frame

    return merged


def shard_boards(lines: DataFrame, shards: int) -> DataFrame:
    """The boards of ``shards`` ladders after each day that changes them, of a stream of lines (nation_id, item_id, arrival_day, cents).

    Within a micro-batch days are taken in order; the days of a later one must not be earlier.
    """
    known = lines.where(F.col("nation_id").isNotNull()).select(F.pmod(F.xxhash64("nation_id", "item_id"), F.lit(shards)).alias("shard"), "nation_id", "item_id", "arrival_day", "cents")
    sums = known.mapInArrow(lean(summed), "shard long, nation_id int, item_id long, arrival_day long, cents long")
    return sums.groupBy("shard").transformWithStateInPandas(Ladder(), _BOARD, "Append", "None")


def changes(boards: DataFrame, shards: int) -> DataFrame:
    """The changes of rank that follow from all boards of ``shards`` shards, merged FAN at a time."""
    while shards > FAN:
        shards = -(-shards // FAN)
        boards = boards.groupBy("nation_id", F.pmod(F.col("shard"), F.lit(shards)).alias("part")).applyInPandas(merge(False), _BOARD)
    return boards.groupBy("nation_id").applyInPandas(merge(True), CHANGES)


@dataclass
class Feed:
    """A new folder of one run: batches waiting, batches fed, the checkpoint, the boards of the shards and the changes."""

    spark: SparkSession
    place: str

    def path(self, name: str) -> str:
        return f"{self.place}/{name}"

    def hand_over(self, batch: int) -> bool:
        """Moves a batch from those waiting to those fed; false if it has no lines."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        files = jvm.org.apache.hadoop.fs.Path(self.place).getFileSystem(conf)
        files.mkdirs(jvm.org.apache.hadoop.fs.Path(self.path("fed")))
        whence, to = (jvm.org.apache.hadoop.fs.Path(self.path(f"{name}/batch={batch}")) for name in ("waiting", "fed"))
        return files.exists(whence) and files.rename(whence, to)

    def drop(self, name: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.path(name))
        at.getFileSystem(conf).delete(at, True)


@contextlib.contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: What the state needs: a store that knows maps, few old versions, no files made large before they are filled (there are many small stores),
#: stores closed when their task ends (the next start opens its own, so all that stay open are memory lost), and one bound on what the open ones take (each is read once, so there is little to cache).
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def run(lines: DataFrame, items: DataFrame, vendors: DataFrame, shards: int | None = None) -> DataFrame:
    """The change feed of all lines: cut into batches, each fed to a new start of the streaming query on one checkpoint."""
    spark = lines.sparkSession
    feed = Feed(spark, f"{checkpoint_place(spark)}/feed-{uuid.uuid4().hex}")
    cut(lines, items, vendors).write.partitionBy("batch").parquet(feed.path("waiting"))
    waiting = spark.read.schema("nation_id int, item_id long, cents long, shipped_day long, arrival_day long, batch int").parquet(feed.path("waiting"))
    last_days = {b: d for b, d in waiting.groupBy("batch").agg(F.max("shipped_day")).collect()}
    shards = shards or max(LEAST_SHARDS, -(-items.count() // SHARD_ITEMS))
    schema = waiting.schema
    with _settings(spark, SETTINGS):
        for b in sorted(last_days):
            feed.hand_over(b)
            before = max((d for x, d in last_days.items() if x < b), default=None)
            stream = spark.readStream.schema(schema).parquet(feed.path("fed"))
            if before is not None:
                stream = stream.where(F.col("shipped_day") + LATE_DAYS >= before)
            query = shard_boards(stream, shards).writeStream.format("parquet").outputMode("append").option("checkpointLocation", feed.path("state")).trigger(availableNow=True).start(feed.path("boards"))
            query.awaitTermination()
    if last_days:
        changes(spark.read.schema(_BOARD).parquet(feed.path("boards")), shards).write.parquet(feed.path("changes"))
    for name in ("waiting", "fed", "state", "boards"):
        feed.drop(name)
    found = spark.read.schema(CHANGES).parquet(feed.path("changes")) if last_days else spark.createDataFrame([], CHANGES)
    return found.withColumn("batch", batch_of(F.col("arrival_day")))

