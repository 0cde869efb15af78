"""The inbox: files that have stopped growing, as a stream and over a log of polls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.remote import by_value

POLL_SECONDS, STABLE_SECONDS = 2, 3
#: A file that hasn't been seen for so long is gone.
FORGET_SECONDS = 3600
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
READY = "path string, name string, size long, modified timestamp, since timestamp, ready timestamp"
SEEN = "size long, modified timestamp, since timestamp, done boolean"


class Settling(StatefulProcessor):
    """Keeps, for each path, what was last seen of it, and hands it out once size and time have stayed for ``stable`` seconds.

    A file that comes again under a path is another one as soon as its size or time differ, seen gone or not.  Rows in which the
    size is null say that a file is gone.  One that has not been seen for ``forget`` seconds is gone as well: a timer
    drops what is kept.  A path that is ``blocked`` isn't handed out while it is there; that is kept apart, for as long as it is seen.
    """

    def __init__(self, stable: float, forget: float) -> None:
        self.stable, self.forget = stable, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", SEEN)
        self.blocked = handle.getValueState("blocked", "since timestamp", int(self.forget * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        size, modified, since, done = self.seen.get() if self.seen.exists() else (None, None, None, False)
        blocked, out = self.blocked.exists(), []
        for row in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            if pd.isna(row.size_):
                size, blocked = None, False
                continue
            blocked = blocked or row.blocked is True or row.blocked == True  # noqa: E712 - null is no
            at, stamp = row.at.to_pydatetime(), None if pd.isna(row.modified) else row.modified.to_pydatetime()
            if size != row.size_ or modified != stamp:
                size, modified, since, done = int(row.size_), stamp, at, False
            if not (done or blocked) and (at - since).total_seconds() >= self.stable:
                done = True
                out.append((key[0], row.name, size, modified, since, at))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if size is None:
            self.seen.clear()
            self.blocked.clear()
        else:
            self.seen.update((size, modified, since, done))
            if blocked:
                self.blocked.update((since,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.forget * 1000))
        yield pd.DataFrame(out, columns=["path", "name", "size", "modified", "since", "ready"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.blocked.clear()
        yield pd.DataFrame([], columns=["path", "name", "size", "modified", "since", "ready"])

    def close(self) -> None:
        pass


def settled_stream(polls: DataFrame, stable: float = STABLE_SECONDS, forget: float = FORGET_SECONDS) -> DataFrame:
    """Settled files of a stream of polls (path, name, size, modified, at, blocked).  The session keeps state in RocksDB.

    Polls of (name, ts, size), as ``settled`` takes them, will do: a name is its path then, and only sizes tell that a file has changed.
    """
    given = {"path": F.col("name"), "at": F.col("ts") if "ts" in polls.columns else None, "modified": F.lit(None).cast("timestamp"), "blocked": F.lit(None).cast("boolean")}
    polls = polls.withColumns({c: x for c, x in given.items() if c not in polls.columns and x is not None})
    by_value(__name__)
    polls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = polls.withColumnRenamed("size", "size_")
    return rows.groupBy("path").transformWithStateInPandas(Settling(stable, forget), READY, "Append", "ProcessingTime")


def settled(polls: DataFrame, stable: float = STABLE_SECONDS) -> DataFrame:
    """The same over a table of polls: a run of equal sizes is ready at its first poll that is late enough."""
    order = Window.partitionBy("name").orderBy("ts")
    new = (~F.lag("size").over(order).eqNullSafe(F.col("size")) | (F.row_number().over(order) == 1)).cast("int")
    rows = polls.withColumn("run", F.sum(new).over(order)).where("size IS NOT NULL")
    since = F.min("ts").over(Window.partitionBy("name", "run"))
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    late = rows.withColumn("since", since).where(seconds("ts") - seconds("since") >= stable)
    return late.groupBy("name", "run", "size", "since").agg(F.min("ts").alias("ready")).drop("run").select("name", "size", "since", "ready")


def reconciled(before: DataFrame, now: DataFrame) -> DataFrame:
    """name and state of two listings (name, size): new, gone, changed or same."""
    rows = before.select("name", F.col("size").alias("old")).join(now.select("name", F.col("size").alias("new")), "name", "full_outer")
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return rows.select("name", state.alias("state"))


def suffixed(names: DataFrame, by: str = "name", order: str = "arrived") -> DataFrame:
    """Output names that don't collide: a stem that is taken gets _1, _2, .. in order of arrival.

    A name is taken by what came before it, also where an earlier stem already got that number: of
    a, a, a_1 the second is a_1 and the third a_1_1.  Stems that differ once such numbers are cut off can't
    collide, so each family of them is settled apart: by a window where all its stems are equal or none is repeated (as in
    scan_1, scan_2, ..), else in order.
    """
    family, schema = "_family", StructType([*names.schema, StructField("out_name", StringType())])

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        taken, next_, out = set(), {}, []
        for stem in rows[by]:
            name = stem
            if name in taken:
                n = next_.get(stem, 1)
                while f"{stem}_{n}" in taken:
                    n += 1
                next_[stem], name = n + 1, f"{stem}_{n}"
            taken.add(name)
            out.append(name)
        return rows.assign(out_name=out)[[f.name for f in schema]]

    marked = names.withColumn(family, F.regexp_replace(by, r"(_\d+)+$", ""))
    told = marked.groupBy(family, by).agg(F.count("*").alias("_c")).groupBy(family).agg(F.count("*").alias("_stems"), F.max("_c").alias("_most"))
    marked = marked.join(told, family)
    n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    alike = marked.where("_stems = 1 OR _most = 1").withColumn("_n", n)
    alike = alike.withColumn("out_name", F.when(F.col("_n") == 0, F.col(by)).otherwise(F.concat(by, F.lit("_"), F.col("_n").cast("string")))).select(*(f.name for f in schema))
    mixed = marked.where("_stems > 1 AND _most > 1").drop("_stems", "_most").groupBy(family).applyInPandas(lambda rows: settle(rows.sort_values(order, kind="stable")), schema)
    return alike.unionByName(mixed)


def newest(log: DataFrame, limit: int = 300, by: str = "ts") -> DataFrame:
    """The latest entries of a log; of equal times those with the largest other columns."""
    return log.orderBy(F.desc(by), *(F.desc(c) for c in log.columns if c != by)).limit(limit)
