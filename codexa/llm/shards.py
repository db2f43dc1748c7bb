"""K-d tree sharding by bytes (operator 2).

Method. Each document is a point with a weight (bytes of its text plus 16) and three metadata coordinates: source, language
and log of the size. A node that stands for k shards is split along its widest coordinate at the weighted quantile
floor(k/2)/k, and so on until each leaf is one shard. The quantile is found by distributed histograms: every round sums the
weights of 4096 buckets for each node in one job and narrows the bucket that straddles the target, until it weighs little.
Ties of a coordinate are ordered by a hash of the row, and rows that are equal in all by their place in the staged points, so that a source, a group of copies or
a repeated row with a third of all rows splits as well: equal texts may go to several shards, as balance by bytes asks for. Points are staged again every second level. The driver sees at most shards x 4096 sums a round. Slots are numbered in small sub-buckets with offsets, so no shard meets in
one task.

Law: bytes. Defined cases. Null text: 0 bytes, crc of the empty string. Null language or source: a value of its own. Repeated rows get
slots of their own. An empty table gives no rows. Further columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop, stage, table

DIMS = ("source_dim", "lang_dim", "size_dim")
DIM_BITS, TIE_BITS, STEP = 24, 36, 12
#: Low bits of a tie that tell equal rows apart.
ROW_BITS = 10


def _category(c: str) -> Column:
    return F.when(F.col(c).isNull(), 0).otherwise(F.shiftright(F.crc32(F.col(c)), 8)).cast("long")


def points(docs: DataFrame) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    d = docs.select(
        "doc_id", (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).alias("text_crc32"),
        _category("source").alias("source_dim"), _category("lang").alias("lang_dim"),
    )
    return d.withColumns({
        "size_dim": F.least(F.lit((1 << DIM_BITS) - 1), F.floor(F.log2("size") * (1 << 18))).cast("long"),
        "tie": F.shiftleft(F.xxhash64("doc_id", "text_crc32", "size").bitwiseAND(F.lit((1 << TIE_BITS - ROW_BITS) - 1)), ROW_BITS)
        + F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << ROW_BITS) - 1)),
    })


def _order(dim: Column) -> Column:
    chosen = F.when(dim == DIMS[0], F.col(DIMS[0])).when(dim == DIMS[1], F.col(DIMS[1])).otherwise(F.col(DIMS[2]))
    return F.shiftleft(chosen, TIE_BITS) + F.col("tie")


def _with(pts: DataFrame, rows: list[tuple], schema: str, how: str = "inner") -> DataFrame:
    """pts joined by node with a table of at most one row for each shard."""
    return pts.join(F.broadcast(pts.sparkSession.createDataFrame(rows, f"node long, {schema}")), "node", how)


def split_level(pts: DataFrame, nodes: dict[int, int], width: dict[str, float], close: float) -> dict[int, tuple[str, int]]:
    """For each node of more than one shard: the coordinate and the order value at which its right part begins."""
    todo = {n: k for n, k in nodes.items() if k > 1}
    stats = pts.where(F.col("node").isin(list(todo))).groupBy("node").agg(
        F.sum("size").alias("w"), *[F.min(d).alias(f"lo_{d}") for d in DIMS], *[F.max(d).alias(f"hi_{d}") for d in DIMS]
    ).collect()
    state = {}
    for s in stats:
        dim = max(DIMS, key=lambda d: ((s[f"hi_{d}"] - s[f"lo_{d}"]) / max(width[d], 1), -DIMS.index(d)))
        k = todo[s["node"]]
        state[s["node"]] = {"dim": dim, "target": s["w"] * (k // 2) / k, "below": 0, "prefix": 0, "w": s["w"]}
    cuts = {n: (DIMS[0], 0) for n in todo if n not in state}
    shift = DIM_BITS + TIE_BITS - STEP
    while state:
        at = _with(pts, [(n, s["dim"], s["prefix"]) for n, s in state.items()], "dim string, prefix long")
        rows = at.withColumn("o", _order(F.col("dim"))).where(F.shiftright("o", shift + STEP) == F.col("prefix"))
        got = rows.groupBy("node", F.shiftright("o", shift).alias("b")).agg(F.sum("size").alias("w"), F.count("*").alias("rows")).toPandas()
        for n, g in got.groupby("node"):
            g, s = g.sort_values("b"), state[n]
            upto = s["below"] + np.cumsum(g["w"].to_numpy())
            i = min(int(np.searchsorted(upto, s["target"], "left")), len(g) - 1)
            before = upto[i] - g["w"].iloc[i]
            if g["w"].iloc[i] <= close * s["w"] or g["rows"].iloc[i] == 1 or shift == 0:
                right = i + 1 if upto[i] - s["target"] <= s["target"] - before else i
                b = int(g["b"].iloc[i]) + (right > i)
                cuts[n] = (s["dim"], b << shift)
                del state[n]
            else:
                s |= {"below": int(before), "prefix": int(g["b"].iloc[i])}
        shift -= STEP
    return cuts


def kd_shards(docs: DataFrame, shards: int = 40, close: float = 5e-4, rows_per_bucket: int = 20_000) -> DataFrame:
    """docs(doc_id, text, lang, source) -> doc_id, size, text_crc32, shard, slot."""
    base = stage(points(docs.select("doc_id", "text", "lang", "source")), "points")
    span = base.agg(F.count("*").alias("n"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMS]).first()
    width = {d: float(span[d] or 0) for d in DIMS}
    pts, nodes, level, held = base.withColumn("node", F.lit(1).cast("long")), {1: shards}, 0, base
    while any(k > 1 for k in nodes.values()):
        cuts = split_level(pts, nodes, width, close)
        pts = _with(pts, [(n, d, c) for n, (d, c) in cuts.items()], "dim string, cut long", "left")
        right = (_order(F.col("dim")) >= F.col("cut")).cast("long")
        pts = pts.withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right)).drop("dim", "cut")
        level += 1
        if level % 2 == 0:
            pts = stage(pts, "points")
            drop(held)
            held = pts
        nodes = {m: j for n, k in nodes.items() for m, j in (((2 * n, k // 2), (2 * n + 1, k - k // 2)) if n in cuts else ((n, k),))}
    deep = max(n.bit_length() for n in nodes)
    leaves = sorted(nodes, key=lambda n: n << (deep - n.bit_length()))  # from left to right
    pts = stage(_with(pts, [(n, i) for i, n in enumerate(leaves)], "shard int"), "leaves")
    drop(held)
    parts = max(16, span["n"] // (shards * rows_per_bucket) + 1)
    pts = pts.withColumn("sub", F.pmod(F.xxhash64("tie"), F.lit(parts)))
    counts = pts.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = stage(counts.select("shard", "sub", before.alias("before")), "offsets")
    place = F.row_number().over(W.partitionBy("shard", "sub").orderBy("tie", "doc_id", "text_crc32", "size"))
    out = pts.withColumn("place", place).join(offsets, ["shard", "sub"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
