"""Consecutive row numbers without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.staging import drop, handed, stage

#: Rows that one task sorts at most, but for uneven ranges.
TASK_ROWS = 500_000
#: Groups whose first numbers are sent to all tasks.
FEW_GROUPS = 100_000
#: Blocks whose first numbers are sent to all tasks; with more, rows are numbered by ranges.
FEW_BLOCKS = 100_000
#: monotonically_increasing_id holds the partition above this bit and the place in it below.
_PLACE_BITS = 33


def positions(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """df with `name`: 0, 1, 2, ... in the given order; staged.

    The rows are staged and counted, dealt by ranges of the order, sorted within each and counted once a range; a number is the rows of the ranges before plus the place in the own range. The
    driver sees one count a range. The number of ranges grows with the rows, so that the memory of one task does not. Rows that tie get any order among them and are dealt over several ranges,
    so that one value that a third of the rows share fills no single task.
    An empty table stays empty; `name` must not be a column of df.
    """
    spark = df.sparkSession
    tie, mark = (f"__{x}_{name}" for x in ("tie", "mark"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = stage(df.withColumn(tie, F.monotonically_increasing_id()), "unordered")
    n = -(-rows.count() // TASK_ROWS)
    # Spark merges small ranges only where it chooses their number itself
    many = [n] if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    dealt = rows.repartitionByRange(*many, *keys, F.col(tie)).sortWithinPartitions(*keys, tie)
    held = stage(dealt.withColumn(mark, F.monotonically_increasing_id()).drop(tie), "positions")
    drop(rows)
    part = F.shiftright(mark, _PLACE_BITS)
    sizes = sorted(tuple(r) for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    first = spark.createDataFrame(starts, "__part long, __first long")
    place = F.col(mark).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return held.join(F.broadcast(first), part == F.col("__part")).withColumn(name, F.col("__first") + place).drop("__part", "__first", mark)


def by_block(df: DataFrame, path: str, block: str, name: str = "pos") -> DataFrame:
    """df, as it comes from files, with `name`: 0, 1, 2, ... by path, block and place in the block; staged once, and the frame may be given to drop().

    A task reads a block in order and alone, so rows are not shuffled: a number is the rows of the blocks before plus the place in the own block. The driver sees one count a block, FEW_BLOCKS at
    most; where files are more, the rows go through positions().
    """
    spark, mark, shift = df.sparkSession, f"__mark_{name}", f"__shift_{name}"
    held = stage(df.withColumn(mark, F.monotonically_increasing_id()), "rows")
    sizes = held.groupBy(path, block).agg(F.min(mark).alias("first"), F.count("*").alias("n"))
    found = sorted(tuple(r) for r in sizes.limit(FEW_BLOCKS + 1).collect())
    if len(found) > FEW_BLOCKS:
        out = positions(held, path, block, mark, name=name).drop(mark)
        drop(held)
        return out
    shifts, total = [], 0
    for p, b, first, n in found:
        shifts.append((p, b, total - first))
        total += n
    known = F.broadcast(spark.createDataFrame(shifts, f"{path} string, {block} long, {shift} long"))
    return handed(held, held.join(known, [path, block]).withColumn(name, F.col(mark) + F.col(shift)).drop(mark, shift))


def places(df: DataFrame, by: str, *order: Column | str, name: str = "place") -> DataFrame:
    """df with `name`: 0, 1, 2, ... within each value of `by`, null among them, in the given order; staged. For values of any number of rows.

    One numbering of all rows, less the first number of the value. The first numbers are broadcast where they are few: dealt by few values, the rows would lie in as few tasks.
    """
    rows = positions(df, by, *order, name=name)
    of, start = f"__of_{name}", f"__start_{name}"
    first = stage(rows.groupBy(F.col(by).alias(of)).agg(F.min(name).alias(start)), "first")
    first = F.broadcast(first) if first.count() <= FEW_GROUPS else first
    return rows.join(first, F.col(by).eqNullSafe(F.col(of))).withColumn(name, F.col(name) - F.col(start)).drop(of, start)
