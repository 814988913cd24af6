"""Work dealt into tasks by its estimated cost, the dearest first, so that no task ends a stage alone.

Costs fall into classes of nearly equal cost. Classes are dealt one after the other, from the dearest down, round and round over the tasks. Tasks get
equally many rows of each class (one more or less), so a task's cost is at most STEP times the mean plus one row of the dearest class. A row's place in
its class comes from counts of (class, salt), so a class of a third of all rows is numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs within a class differ by this factor at most.
STEP = 2 ** (1 / 8)
SALTS = 64


def packed(work: DataFrame, cost: Column, tasks: int, name: str = "task") -> DataFrame:
    """work with `name`, the task from 0 to tasks - 1 that a row belongs to. Null and negative costs count as 0.

    Equal rows are dealt like any others. The numbering shuffles rows by (class, salt); an empty table gives an empty result.
    """
    value = F.greatest(F.coalesce(cost.cast("double"), F.lit(0.0)), F.lit(0.0))
    kind = F.floor(F.log2(value + 1) * 8).cast("int")
    # A hash orders the rows, so that a task which runs again deals them as before; maps can't be hashed.
    plain = [c for c, t in work.dtypes if "map<" not in t]
    rows = work.withColumns({"_class": kind, "_hash": F.xxhash64(*plain) if plain else F.lit(0)})
    rows = rows.withColumn("_salt", F.pmod("_hash", F.lit(SALTS)).cast("int"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_class", "_salt").orderBy("_hash")) - 1)
    counts = rows.groupBy("_class", "_salt").agg(F.count("*").alias("_n"))  # at most some hundred classes of SALTS salts
    before = Window.orderBy(F.desc("_class"), "_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_class", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    placed = rows.join(F.broadcast(offsets), ["_class", "_salt"])
    return placed.withColumn(name, F.pmod(F.col("_first") + F.col("_nth"), F.lit(tasks)).cast("int")).drop("_class", "_hash", "_salt", "_nth", "_first")


def dealt(work: DataFrame, cost: Column, tasks: int) -> DataFrame:
    """work in `tasks` partitions of nearly equal cost."""
    return packed(work, cost, tasks, "_task").repartitionById(tasks, F.col("_task")).drop("_task")
