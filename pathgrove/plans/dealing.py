"""Work on files dealt to tasks by bytes: running sums of sizes as cut points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pathgrove.sources.shared import materialise, release

#: What opening a file costs, in bytes read in the same time, so that empty files are work as well.
OPENING = 64 * 1024
#: Bytes of a task at most, and at least.
TASK_BYTES, LEAST_BYTES = 1 << 30, 1 << 20


def task_size(total: int, parallelism: int, most: int = TASK_BYTES) -> int:
    """Bytes of a task: several tasks for each core where there is work enough, and no task longer than most."""
    return min(most, max(LEAST_BYTES, -(-total // (4 * parallelism))))


def deal(files: DataFrame, most: int = TASK_BYTES, share: int | None = None) -> tuple[DataFrame, int]:
    """files (idx, id, path, size) with a column task, and the number of tasks. share: bytes of a task, instead of what ``task_size`` gives for this session.

    A file as large as a task is a task of its own. The others are cut where the running sum of their costs, in the order of id, passes a
    multiple of the task size, so a task has under twice that. Sums run within ranges of id in parallel; a range adds the sums of those
    before it, of which there is one per shuffle partition, so no task sees all files."""
    spark = files.sparkSession
    cost = F.greatest("size", F.lit(0)) + OPENING
    ranged = materialise(files.withColumn("cost", cost).repartitionByRange("id", "idx").withColumn("range", F.spark_partition_id()), "ranged")
    total = ranged.agg(F.sum("cost")).first()[0] or 0  # one number
    share = share or task_size(int(total), spark.sparkContext.defaultParallelism, most)
    small, large = ranged.where(F.col("cost") < share), ranged.where(F.col("cost") >= share)
    sums = small.groupBy("range").agg(F.sum("cost").alias("own"))
    before = sums.select("range", (F.sum("own").over(Window.orderBy("range")) - F.col("own")).alias("before"))  # a row per partition
    within = F.sum("cost").over(Window.partitionBy("range").orderBy("id", "idx").rowsBetween(Window.unboundedPreceding, 0)) - F.col("cost")
    first = -(-int(small.agg(F.sum("cost")).first()[0] or 0) // share)
    alone = first + F.row_number().over(Window.orderBy("id", "idx")) - 1  # at most total / share rows
    columns = ["idx", "id", "path", "size", "cost", "task"]
    place = F.col("before") + F.col("within")
    dealt = small.withColumn("within", within).join(F.broadcast(before), "range").withColumn("task", F.call_function("div", place, F.lit(share))).select(columns)
    dealt = materialise(dealt.unionByName(large.withColumn("task", alone.cast("long")).select(columns)), "dealt")
    release(ranged)
    last = dealt.agg(F.max("task")).first()[0]
    return dealt, 0 if last is None else last + 1
