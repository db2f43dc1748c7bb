"""Shared helpers of the corpus operators: staging, word rules, size checks and connected components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.staging import drop, stage  # noqa: F401  re-exported

#: The six ASCII white-space characters that separate words.
SPACE = " \t\n\x0b\f\r"
SPACE_RE = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, lengthened until none is among the columns (case aside) or given twice."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def release() -> None:
    """Give memory that this Python worker freed back to the system: idle workers are kept for the next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> Iterator[None]:
    """Bound the Arrow batches, which live outside the heap in the JVM and again in the worker, of what is run in this block. The user's settings come back."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        if int(spark.conf.get(keys[0])) > rows:
            spark.conf.set(keys[0], str(rows))
            spark.conf.set(keys[1], size)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that releases its memory at the end of each task."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if limit := getattr(ctypes.CDLL(None), "mallopt", None):
            limit(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays over 1 MB go back at once when freed
        try:
            yield from run(batches)
        finally:
            release()

    return held


def split_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; none for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE, -1))


def met(left: DataFrame, right: DataFrame, on: list[str], most: int, spread: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """left joined with right on equal columns: right is broadcast if it is counted to have `most` rows or fewer. Beyond that both sides are dealt by key and salt, the left side by the hash of its
    columns `spread`, of which each salt gets a copy of right: a key that a third of the left rows share goes to `salts` tasks."""
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), on, how)
    (salt,) = unused([*left.columns, *right.columns], "_salt")
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).join(copies, [*on, salt], how).drop(salt)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, comp) with comp the least node of the component; staged.

    Each round links every neighbour to the least label around it and halves the label paths (hook and jump), so rounds grow
    with the logarithm of a component's diameter; labels only fall, so the rounds end by themselves. Labels live in staged tables, of which the last
    two are kept; the driver only sees one row a round. Nulls in a or b are dropped, loops give a component of their own.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    both = stage(edges.union(edges.select("b", "a")).distinct(), "edges")
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        # hook: the least label among neighbours; jump: the label of the label
        near = (
            both.join(label.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        )
        hooked = label.join(near, "node").select("node", F.least("comp", "c").alias("comp"), F.col("comp").alias("old"))
        # the old label's own node also learns of the smaller label
        told = hooked.groupBy(F.col("old").alias("node")).agg(F.min("comp").alias("t"))
        hooked = stage(hooked.join(told, "node", "left").select("node", F.least("comp", "t").alias("comp"), "old"), "hooked")
        jump = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("j"))
        nxt = stage(hooked.join(jump, "comp", "left").select("node", F.least("comp", "j").alias("comp"), "old"), "labels")
        drop(label, hooked)
        label = nxt
        if label.where(F.col("comp") != F.col("old")).isEmpty():
            drop(both)
            return label
