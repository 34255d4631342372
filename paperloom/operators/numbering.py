"""Consecutive numbers in a total order without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.shared import discard, written

#: Rows of starts that go to all tasks; more meet the rows that they belong to in a shuffle.
SENT = 100_000


def with_row_numbers(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Numbers from start in the given order, which should be total. Rows are range-partitioned, sorted in their partition
    and written with their place; a number is a place plus the rows of the partitions before: one count a partition,
    which is all that the driver sees and sends out. A frequent first key is spread by the others."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed, "numbered").withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)})
    before, total = [], start
    for part, count in placed.groupBy("__part").count().orderBy("__part").collect():
        before.append((part, total))
        total += count
    offsets = spark.createDataFrame(before, "__part long, __before long")
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def with_starts(df: DataFrame, key: list[str], n: Column, name: str, start: int = 0) -> DataFrame | None:
    """df, each of whose rows stands for n others, with the number of the first of them when all are numbered from start in
    the order of the key. Only keys and counts are moved: they are range-partitioned and summed up partition by partition,
    and the starts come back to the rows, up to SENT of them in every task, more by a join on the key. A key that is null
    comes first, as in a sort. None where rows repeat a key, so that their order isn't told by it."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.select(*key, n.cast("long").alias("__n")).groupBy(*key).agg(F.sum("__n").alias("__n"), F.count("*").alias("__rows"))
    placed = written(counts.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("__at", F.monotonically_increasing_id()), "counts")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    sums = placed.groupBy("__part").agg(F.sum("__n"), F.max("__rows"), F.count("*")).orderBy("__part").collect()  # a row a partition
    before, total = [], start
    for part, count, _, _ in sums:
        before.append((part, total))
        total += count
    if any(most > 1 for _, _, most, _ in sums):
        discard(placed)
        return None
    earlier = F.sum("__n").over(Window.partitionBy("__part").orderBy("__at")) - F.col("__n")
    offsets = spark.createDataFrame(before, "__part long, __before long")
    starts = placed.withColumn("__earlier", earlier).join(F.broadcast(offsets), "__part").select(*[F.col(k).alias(f"__{k}") for k in key], (F.col("__earlier") + F.col("__before")).alias(name))
    rows = sum(s[3] for s in sums)
    starts = written(starts, "starts", rows=rows)
    discard(placed)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return df.join(F.broadcast(starts) if rows <= SENT else starts, same).drop(*[f"__{k}" for k in key])
