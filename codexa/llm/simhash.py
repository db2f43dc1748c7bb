"""SimHash near-duplicates by a Gray-order hierarchical index (operator 12).

Method. A fingerprint has a bit for each bit that is set in over half the 64-bit hashes of a text's word shingles, repeats included. Equal fingerprints are one entry. The
entries are sorted by their rank in the reflected Gray order, in which neighbours differ in few bits, and cut into leaf blocks of LEAF; FAN neighbouring blocks have a parent,
and so on up. A node keeps the mask of the bits that all entries below it share, and their pattern. The join goes down the index with pairs of nodes: bits that both masks hold and
that no node above has compared yet are compared, differences add up along the way, and a pair is dropped with everything below it as soon as they exceed the limit. Leaf
pairs that are left meet as tiles, in which sub-blocks of SUB entries are pruned in the same way before entries are compared.

A tile returns a forest that joins its linked entries, not its links, so that a group of close fingerprints is not expanded into pairs; components of the forests are the
components of all links.

Defined cases. Null, empty and blank texts have the fingerprint zero, which links like any other. Texts shorter than a shingle are one shingle. Repeated rows get a row each; null ids
get a fingerprint and the least id of their component, null if all are null. An empty table gives no rows. Very long texts are hashed in portions. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.numbering import positions

from .common import bounded_batches, components, drop, frugal, stage, table

WORDS, BITS, SEED = 3, 2, 42
#: Entries of a leaf block, nodes below a node (a power of two), entries of a sub-block; shingles hashed at once.
LEAF, FAN, SUB, PORTION = 1024, 16, 32, 1 << 17
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of a text, unsigned."""
    import xxhash

    found = (text or "").encode().translate(_LOWER).split()  # splits at the six ASCII white-space characters
    if not found:
        return 0
    joined, sizes = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(len(found) - words + 1, 1)
    last = ends[min(words, len(found)) - 1 :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, PORTION):
        b = min(a + PORTION, n)
        h = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[a:b].tolist(), last[a:b].tolist(), strict=True)), np.uint64, b - a)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Places in the reflected Gray order: each bit is the parity of the bits from the top down to it."""
    rank = fp.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def _rank_column(fp):
    rank = fp
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    return rank.bitwiseXOR(F.lit(-(2**63)).cast("long"))  # unsigned order as that of signed numbers


def _differ(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask)


def _subs(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks and patterns of the sub-blocks of sorted entries."""
    at = np.arange(0, len(fp), SUB)
    both, any_ = np.bitwise_and.reduceat(fp, at), np.bitwise_or.reduceat(fp, at)
    mask = ~(both ^ any_)
    return mask, both & mask


def links_in_tile(a: np.ndarray, b: np.ndarray | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of entries at `bits` differences or fewer; b None: pairs within a. Both sorted by Gray rank."""
    own = b is None
    b = a if own else b
    (ma, pa_), (mb, pb) = _subs(a), _subs(b)
    near = _differ(ma[:, None] & mb[None, :], pa_[:, None], pb[None, :]) <= bits
    si, sj = np.nonzero(np.triu(near) if own else near)
    step = np.arange(SUB)
    for x in range(0, len(si), 256):  # 256 * SUB * SUB comparisons at once
        i, j = si[x : x + 256, None] * SUB + step, sj[x : x + 256, None] * SUB + step
        i, j = np.broadcast_arrays(i[:, :, None], j[:, None, :])
        there = (i < len(a)) & (j < len(b)) & ((i < j) if own else True)
        i, j = i[there], j[there]
        hit = np.bitwise_count(a[i] ^ b[j]) <= bits
        yield i[hit], j[hit]


def forest(a: np.ndarray, b: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (entry, entry) that join exactly what the links of a tile join, fewer than its entries."""
    every = a if b is None else np.concatenate([a, b])
    label, shift = np.arange(len(every)), 0 if b is None else len(a)
    pairs = [(i, j + shift) for i, j in links_in_tile(a, b, bits) if len(i)]
    while pairs:
        before = label.copy()
        for i, j in pairs:
            least = np.minimum(label[i], label[j])
            np.minimum.at(label, i, least)
            np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    joined = np.flatnonzero(label != np.arange(len(every)))
    return every[joined], every[label[joined]]


def near_links(entries: DataFrame, bits: int = BITS) -> DataFrame:
    """entries(fp), distinct -> edges (a, b) whose components are those of all pairs at `bits` differences or fewer; staged."""
    ordered = positions(entries.select("fp", _rank_column(F.col("fp")).alias("rank")), "rank")
    blocks = ordered.groupBy(F.floor(F.col("pos") / LEAF).alias("block")).agg(F.collect_list("fp").alias("fps"), F.bit_and("fp").alias("both"), F.bit_or("fp").alias("any"))  # LEAF entries
    blocks = stage(blocks, "blocks")
    n = blocks.count()
    fan = FAN.bit_length() - 1

    def nodes(level: int) -> DataFrame:
        up = blocks.groupBy(F.shiftright("block", fan * level).alias("id")).agg(F.bit_and("both").alias("both"), F.bit_or("any").alias("any"))
        mask = F.bitwise_not(F.col("both").bitwiseXOR(F.col("any")))
        return up.select("id", mask.alias("mask"), F.col("both").bitwiseAND(mask).alias("pattern"))

    level = 0
    while n > FAN << (fan * level):
        level += 1
    top = -(-n // (1 << (fan * level)))  # FAN nodes at most
    pairs = entries.sparkSession.range(top).select(F.col("id").alias("i"), F.explode(F.sequence("id", F.lit(max(top, 1) - 1).cast("long"))).alias("j"))
    pairs = pairs.withColumns({"known": F.lit(0).cast("long"), "d": F.lit(0)})
    while True:
        at = nodes(level)
        left = at.select(F.col("id").alias("i"), F.col("mask").alias("mi"), F.col("pattern").alias("pi"))
        right = at.select(F.col("id").alias("j"), F.col("mask").alias("mj"), F.col("pattern").alias("pj"))
        common = F.col("mi").bitwiseAND(F.col("mj"))
        fresh = F.col("pi").bitwiseXOR(F.col("pj")).bitwiseAND(common).bitwiseAND(F.bitwise_not(F.col("known")))
        pairs = pairs.join(left, "i").join(right, "j").select("i", "j", common.alias("known"), (F.col("d") + F.bit_count(fresh)).alias("d")).where(F.col("d") <= bits)
        if level == 0:
            break
        level -= 1
        below = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.least(F.col(c) * FAN + FAN, F.lit(-(-n // (1 << (fan * level))))) - 1))  # noqa: B023, E731
        pairs = stage(pairs, "node_pairs").withColumn("i", below("i")).withColumn("j", below("j")).where("i <= j")
    sides = blocks.select(F.col("block").alias("i"), F.col("fps").alias("a")), blocks.select(F.col("block").alias("j"), F.col("fps").alias("b"))
    tiles = pairs.select("i", "j").join(sides[0], "i").join(sides[1], "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries_of(column: pa.Array, k: int) -> np.ndarray:
            fp = column[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
            return fp[np.argsort(gray_rank(fp))]

        for batch in batches:
            for k in range(batch.num_rows):
                a = entries_of(batch.column(2), k)
                b = None if batch.column(0)[k] == batch.column(1)[k] else entries_of(batch.column(3), k)
                x, y = forest(a, b, bits)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    edges = stage(tiles.select("i", "j", "a", "b").mapInArrow(frugal(run), "a long, b long"), "edges")
    drop(blocks)
    return edges


def simhash_groups(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint, component_id."""
    with bounded_batches(docs.sparkSession):
        held = stage(fingerprints(docs, words), "fingerprints")
        least = stage(held.groupBy("fp").agg(F.min("doc_id").alias("least")), "entries")
        label = components(near_links(least.select("fp"), bits))
    named = least.join(label.select(F.col("node").alias("fp"), "comp"), "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    named = named.join(named.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("fp", "component_id")
    return held.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
