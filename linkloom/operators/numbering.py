"""Numbers and runs over all rows in one order, without a task that sees them all: ranges are counted first, then each range goes on from the sum of those before."""

from __future__ import annotations

import tempfile
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def held(df: DataFrame) -> DataFrame:
    """df as a checkpoint: its rows and their partitions are the same whenever they are read, and survive lost executors. Where no folder is set, a temporary one serves if one machine does all the work."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="linkloom-"))
    return df.checkpoint()


def _ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df in ranges of the order, each in its order, with __at: the range's number times 2^33 and the place in it."""
    return held(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))


def _by_range(spark, rows: list[tuple], schema: str) -> DataFrame:
    # a row for each range, so a few thousand at most
    return F.broadcast(spark.createDataFrame(rows, schema))


def number_rows(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with name: the place of each row in the order, from 0, without gaps. Rows with equal keys stand in any order; nulls come first."""
    own = _ranges(df, order).withColumn("__range", F.shiftright("__at", 33))
    sizes = sorted(map(tuple, own.groupBy("__range").count().collect()))
    starts = list(accumulate((n for _, n in sizes), initial=0))
    first = _by_range(df.sparkSession, [(r, s) for (r, _), s in zip(sizes, starts, strict=False)], "__range long, __start long")
    return own.join(first, "__range").withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__range", "__start", "__at")


def number_runs(df: DataFrame, value: str, order: list[str], name: str = "island") -> DataFrame:
    """df with name (the number of the run of equal values, from 1) and __first (whether the row begins its run), over all rows in the order.

    A range takes the value before its first row from the last range that has rows, so a run may go on over any number
    of ranges. Nulls are equal to nulls.
    """
    w = Window.partitionBy("__range").orderBy("__at")
    own = _ranges(df, order).withColumn("__range", F.shiftright("__at", 33))
    begins = F.when(F.row_number().over(w) == 1, 0).when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    own = own.withColumn("__new", begins)
    ends = own.groupBy("__range").agg(F.min_by(F.struct(value), "__at").alias("first"), F.max_by(F.struct(value), "__at").alias("last"), F.sum("__new").alias("n")).collect()
    rows, before, last = [], 0, None
    for r in sorted(ends, key=lambda r: r["__range"]):
        opens = int(last is None or r["first"][0] != last[0])
        rows.append((r["__range"], before, opens))
        before, last = before + opens + r["n"], r["last"]
    first = _by_range(df.sparkSession, rows, "__range long, __before long, __opens int")
    # the first row of a range begins a run where its value differs from that before the range
    joined = own.join(first, "__range").withColumn("__new", F.when(F.col("__at").bitwiseAND((1 << 33) - 1) == 0, F.col("__opens")).otherwise(F.col("__new")))
    out = joined.withColumn(name, F.col("__before") + F.sum("__new").over(w)).withColumn("__first", F.col("__new") == 1)
    return out.drop("__range", "__at", "__new", "__before", "__opens")
