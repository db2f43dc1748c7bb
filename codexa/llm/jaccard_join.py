"""N-gram Jaccard join with token-combination prefixes (operator 5).

Method. A document's set holds the hashes of its word shingles. Document frequencies of all shingles are counted by their 32-bit fingerprints; a table of slots
gives each shingle a level: 0 (rare, `frequent` documents at most), or one more for each factor of 16 beyond. A fingerprint that shares a slot with a more frequent
one takes its level; every fixed division into levels keeps the join exact, and frequent shingles are never taken for rare. Sets are ordered by level, then by
hash. With n shingles, threshold t and a = ceil(t n), two linked sets share their first common shingle within the first n-a+1 and their second within n-a+2:

  * if the first n-a+1 shingles are all rare, they are indexed one by one;
  * otherwise all rare ones are indexed one by one, and of the frequent ones in the prefix extended to n-a+2 all combinations of two (sets up to
    `combine` shingles) or, for longer sets, the frequent ones of the prefix one by one. Sets near that size emit both, so no pair falls between.

A rare key has `frequent` documents at most, so its pairs are listed, bounded by positions and verified set by set. Keys of frequent shingles can hold a large
group. Each entry carries how much its set can still share from there (u): a set whose u is too small for the smallest set of a key leaves it. Then every set is
compared with one representative of its keys, and the verified links are joined; keys whose members are in one component are done, so a group of
copies is not expanded into pairs. In the keys that are left, members are compared with a representative of each key, and what is then still apart is
compared in tiles of a bounded number of sets, dealt by hash, in which a pair is only looked at if sizes and u allow it, its components differ, and no earlier common
shingle proves that another key has it. Only verified links are ever joined into components.

Equal sets are one node (128-bit digest). Equality of shingles is equality of 64-bit hashes. Defined cases. Null, empty or blank text: no shingles, component of
its own. Null and repeated ids: rows count by themselves; a component is named by its least id, null if all are. Fewer words than a shingle: the whole sequence is one. Very long texts are handled whole. Repeated rows share a node. Empty table: no rows.
Further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, bounded_batches, components, drop, frugal, stage, table, unused

WORDS, PERCENT = 4, 85
FREQUENT, COMBINE = 16, 256
#: Slots of the level table (a byte each): eight for each frequent fingerprint, between these bounds.
LEAST_BITS, MOST_BITS = 16, 26
#: Bytes of text hashed at once; sets and bytes of a tile's side; pairs that share a copy of a set; rows of a broadcast table of ids (under 100 bytes each).
CHUNK, TILE_ROWS, TILE_BYTES, PORTION, MAX_IDS = 1 << 20, 192, 2 << 20, 500, 200_000

_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts joined in raw with offsets ends, and the offsets of each text's words."""
    raw = _LOWER[raw]
    space = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    before = np.ones(len(raw), bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    solid = np.flatnonzero(~space)
    first = np.searchsorted(solid, starts)
    sizes = np.diff(first, append=len(solid))
    within = np.arange(len(solid)) - np.repeat(first, sizes)
    power = np.full(int(sizes.max()), _STEP, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.add.reduceat(_BYTE[raw[solid]] * power[within], first)
    return _mix(sums + sizes.astype(np.uint64) * _STEP), np.searchsorted(starts, ends)


def shingle_sets(raw: np.ndarray, ends: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(raw, ends)
    m = max(len(words) - k + 1, 0)
    rolled = np.zeros(m, np.uint64)
    for j in range(k):
        rolled += words[j : j + m] * _PLACE[j % 64] * np.uint64(2 * (j // 64) + 1)
    rolled = _mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif b > a:
            short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(_mix(np.array([short], np.uint64) ^ _STEP))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_of(batch: pa.RecordBatch, text: int, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) for chunks of about CHUNK bytes of a batch."""
    column = pa.concat_arrays([batch.column(text).cast(pa.large_string()).fill_null("")])
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(int(np.searchsorted(ends, ends[a] + CHUNK, "right")) - 1, a + 1)
        b = min(b, len(column))
        yield a, shingle_sets(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a], k)
        a = b


def _prints(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(32)).astype(np.uint32)


def _planes(sorted_prints: np.ndarray) -> bytes:
    """Gaps between sorted fingerprints, byte plane by byte plane: the high planes are zeros, which the shuffle's compression removes."""
    gaps = np.diff(sorted_prints, prepend=np.uint32(0))
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)
    return np.cumsum(gaps, dtype=np.uint32)


def level_table(docs: DataFrame, k: int, frequent: int) -> np.ndarray:
    """Levels by slot: 0 where no fingerprint of the slot is in more than `frequent` documents. The driver gets the levels, MOST_BITS of slots at most, not the fingerprints."""
    bits = min(26, max(6, (docs.count() // 1000).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            prints, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            n = np.minimum(n, 255).astype(np.uint8)
            part = prints >> np.uint32(32 - bits)
            cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            rows = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int64)), pa.array([_planes(prints[a:b]) for a, b in rows], pa.binary()), pa.array([n[a:b].tobytes() for a, b in rows], pa.binary())], ["part", "prints", "n"])

        total = 0
        for batch in batches:
            for _, sets in sets_of(batch, 0, k):
                held.extend(_prints(s) for s in sets if len(s))
                total += sum(map(len, sets))
                if total > 2_000_000:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        prints = np.concatenate([_from_planes(x.as_py()) for x in group.column("prints")])
        n = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in group.column("n")]).astype(np.int64)
        order = np.argsort(prints, kind="stable")
        prints, n = prints[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        sums = np.add.reduceat(n, first)
        hot = sums > frequent
        level = 1 + np.minimum(np.log2(sums[hot] / frequent) // 4, 14)
        return pa.table({"print": prints[first][hot].astype(np.int64), "level": level.astype(np.int16)})

    parts = docs.select("text").where("text is not null").mapInArrow(frugal(count), "part long, prints binary, n binary")
    hot = stage(parts.groupBy("part").applyInArrow(merge, "print long, level short"), "frequent")
    slots = min(MOST_BITS, max(LEAST_BITS, (8 * hot.count()).bit_length()))
    slot = F.call_function("shiftright", F.col("print"), F.lit(32 - slots))
    got = hot.groupBy(slot.cast("int").alias("slot")).agg(F.max("level").cast("byte").alias("level")).toArrow()
    drop(hot)
    levels = np.zeros(1 << slots, np.int8)
    levels[got.column("slot").to_numpy()] = got.column("level").to_numpy()
    return levels


def keys_of(s: np.ndarray, level: np.ndarray, percent: int, combine: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(rare keys, (frequent keys, u, first and last skipped shingle)) of a set. A shingle is skipped by a key if it is frequent, stands before the key's last one and is not in it."""
    n = len(s)
    short = n - -(-percent * n // 100) + 1
    rare = s[level == 0]
    if len(rare) >= short:
        return rare[:short], (s[:0], np.zeros(0, np.int64), s[:0], s[:0])
    hot = np.flatnonzero(level)
    often = s[hot[np.argsort(level[hot], kind="stable")]]
    made = []
    if 100 * combine >= percent * n:
        f = often[: short + 1 - len(rare)]
        i, j = np.triu_indices(len(f), 1)
        first = np.where(i > 0, f[0], np.where(j > 1, f[min(1, len(f) - 1)], 0)) if len(i) else s[:0]
        last = np.where(j - 1 != i, f[j - 1], np.where(i > 0, f[i - 1], 0)) if len(i) else s[:0]
        made.append((_mix(f[i] * _PLACE[0] + f[j] * _PLACE[1]), n - len(rare) - j + 1, first, last))
    if n > combine:
        f = often[: short - len(rare)]
        i = np.arange(len(f))
        made.append((_mix(f ^ _STEP), n - len(rare) - i, np.where(i > 0, f[0], 0), np.where(i > 0, f[i - 1], 0)))
    return rare, tuple(np.concatenate(x) for x in zip(*made, strict=True))


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def index(docs: DataFrame, k: int, percent: int, frequent: int, combine: int) -> DataFrame:
    """Rows of kind 0 (doc_id, th, n, d1, d2: a document, the hash of its text and its node), 1 (d1, n, key, pos: rare) and 2 (d1, n, key, pos = u, s1, s2: frequent); staged.

    Keys carry the first half of the digest only: nodes that share it are all compared.
    """
    shared = docs.sparkSession.sparkContext.broadcast(level_table(docs, k, frequent))  # 1 << MOST_BITS bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        shift = np.uint64(64 - (len(levels).bit_length() - 1))
        for batch in batches:
            for at, sets in sets_of(batch, 1, k):
                kinds, n_of, digest, keys, rows, pos, skips = [], [], [], [], [], [], []
                for i, s in enumerate(sets):
                    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""
                    one, two = keys_of(s, levels[s >> shift], percent, combine) if len(s) > 1 else (s[:0], (s[:0], np.zeros(0, np.int64), s[:0], s[:0]))
                    m = 1 + len(one) + len(two[0])
                    kinds.append(np.repeat(np.array([0, 1, 2], np.int8), [1, len(one), len(two[0])]))
                    keys += [np.zeros(1, np.uint64), one, two[0]]
                    n_of.append(np.full(m, len(s), np.int64))
                    digest.append(np.tile(np.frombuffer(d or bytes(16), np.int64), (m, 1)))
                    digest[-1][1:, 1] = 0
                    pos += [np.zeros(1, np.int64), np.arange(len(one)), two[1]]
                    blank = np.zeros((m, 2), np.uint64)
                    blank[1 + len(one) :, 0], blank[1 + len(one) :, 1] = two[2], two[3]
                    skips.append(blank)
                    rows.append(np.full(m, at + i))
                digest, skips = np.concatenate(digest), np.concatenate(skips).view(np.int64)
                kinds = np.concatenate(kinds)
                rows, own = pa.array(np.concatenate(rows)), pa.array(kinds == 0)
                ids, texts = (pa.compute.if_else(own, batch.column(c).take(rows), None) for c in (0, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds), ids, texts, pa.array(np.concatenate(n_of)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(skips[:, 0]), pa.array(skips[:, 1])],
                    ["kind", "doc_id", "th", "n", "d1", "d2", "key", "pos", "s1", "s2"],
                )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(frugal(run), f"kind byte, doc_id {_id_type(docs)}, th long, n long, d1 long, d2 long, key long, pos int, s1 long, s2 long")
    return stage(rows, "index")


def fetch_sets(docs: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """need(node, id, th, d1, d2) -> node, set (bytes), read from the documents of those ids (null is an id) and text hashes; staged."""
    few = need.limit(MAX_IDS + 1).count() <= MAX_IDS
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    found = texts.join(F.broadcast(need) if few else need, (F.col("own") == F.col("th")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text", "d1", "d2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in sets_of(batch, 1, k):
                raw = [s.tobytes() for s in sets]
                own = np.array([np.frombuffer(hashlib.blake2b(r, digest_size=16).digest(), np.int64) for r in raw])
                same = (own[:, 0] == batch.column(2).slice(at, len(sets)).to_numpy()) & (own[:, 1] == batch.column(3).slice(at, len(sets)).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array(raw, pa.binary())], ["node", "set"]).filter(pa.array(same))

    sets = stage(found.mapInArrow(frugal(run), "node long, set binary"), "sets")
    return stage(sets.dropDuplicates(["node"]), "sets") if sets.count() > need.count() else sets  # repeated rows


def candidate_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """rare(key, d1, n, pos) -> (d1, e1) whose sets can still be similar enough.

    The rows are dealt and sorted by key; a key has few rows by its class, which are paired with what follows them. What a pair shares up to its last
    common key is known exactly, as both sets are in the same order, so their overlap is at most that number plus what follows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            end = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last key may go on
            held = [x[end:] for x in now]
            yield from paired(*[x[:end] for x in now])
        if held is not None:
            yield from paired(*held)

    def paired(key: np.ndarray, d1: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (d1[1:] != d1[:-1])  # copies
        key, d1, n, pos = key[new], d1[new], n[new], pos[new]
        lag = 0
        while (lag := lag + 1) < len(key):
            i = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(i):
                break
            j = i + lag
            close = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[close], j[close]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d1[i], d1[j], n[i], n[j], pos[i], pos[j])], ["d1", "e1", "n", "m", "pos", "qos"])

    dealt = rare.select("key", "d1", "n", "pos").repartition("key").sortWithinPartitions("key", "d1")
    pairs = dealt.mapInArrow(frugal(run), "d1 long, e1 long, n long, m long, pos int, qos int")
    pairs = pairs.groupBy("d1", "e1", "n", "m").agg(F.count("*").alias("c"), F.max("pos").alias("i"), F.max("qos").alias("j"))
    most = F.col("c") + F.least(F.col("n") - F.col("i") - 1, F.col("m") - F.col("j") - 1)
    return pairs.where((100 + percent) * most >= percent * (F.col("n") + F.col("m"))).select("d1", "e1")


def _linked(shared, a, b, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Staged pairs(a, b) whose sets are similar enough. A node b that many pairs share is dealt out in portions, each with a copy of its set."""
    of_b = pairs.groupBy("b").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("k"))
    few = pairs.limit(MAX_IDS + 1).count() <= MAX_IDS
    small = F.broadcast if few else lambda x: x
    dealt = pairs.join(of_b, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("k")).cast("int").alias("portion"))
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")).join(small(dealt), "a")
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb")).join(small(of_b), "b")
    right = right.select("b", "sb", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("portion"))
    both = left.join(right, ["b", "portion"]).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(bool(_linked(int((y[at] == x).sum()), len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(frugal(run), "a long, b long")


def apart(tied: DataFrame, label: DataFrame) -> DataFrame:
    """tied with the component of each node, for the keys that hold several components; staged."""
    now = tied.drop("comp").join(label.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return stage(now.join(open_, "key"), "apart")


def _possible(percent: int):
    """Whether the sizes (n, n2) and what they can share (u, u2) allow a link."""
    n, m, u = F.col("n"), F.col("n2"), F.least("u", "u2")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * u >= percent * (n + m))


def star_pairs(tied: DataFrame, percent: int, every: bool) -> DataFrame:
    """(a, b): each node with the representative of its keys, or with the least of those if not `every`."""
    rep = tied.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n", "u", "comp")).alias("r"))
    met = tied.join(rep, "key").withColumns({"n2": F.col("r.n"), "u2": F.col("r.u")}).where((F.col("comp") != F.col("r.comp")) & _possible(percent))
    met = met.select(F.col("node").alias("a"), F.struct("r.h", "r.node").alias("r"))
    met = met.distinct() if every else met.groupBy("a").agg(F.min("r").alias("r"))
    return met.select("a", F.col("r.node").alias("b"))


def tile_links(tied: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a key that are in different components, one at most for two components in a tile."""
    sized = tied.join(sets.select("node", F.octet_length("set").alias("bytes")), "node")
    total = sized.groupBy("key").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes"))
    total = total.select("key", F.greatest(F.ceil(F.col("m") / TILE_ROWS), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int").alias("nb"))
    dealt = tied.join(total, "key").withColumn("b", F.pmod(F.xxhash64("node", "key"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")})
    dealt = dealt.join(sets, "node").select("key", "i", "j", "b", "node", "comp", "n", "u", "s1", "s2", "set")

    def run(group: pa.Table) -> pa.Table:
        own = group.column("b").to_numpy() == group.column("i")[0].as_py()
        left = np.flatnonzero(own)
        right = left if group.column("i")[0].as_py() == group.column("j")[0].as_py() else np.flatnonzero(~own)
        n, u, s1, s2 = (group.column(c).to_numpy() for c in ("n", "u", "s1", "s2"))
        comp = group.column("comp").to_numpy()
        a, b = left[:, None], right[None, :]
        total = n[a] + n[b]
        look = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & ((100 + percent) * np.minimum(u[a], u[b]) >= percent * total)
        look &= ((s1[a] != s1[b]) | (s1[a] == 0)) & ((s2[a] != s2[b]) | (s2[a] == 0))
        look = np.triu(look, 1) if right is left else look
        rows, columns = np.flatnonzero(look.any(1)), np.flatnonzero(look.any(0))
        nodes, out = group.column("node").combine_chunks(), []
        if len(rows):
            every = group.column("set").combine_chunks()
            x, y = ([np.frombuffer(every[int(k)].as_buffer(), np.uint64) for k in side] for side in (left[rows], right[columns]))
            near = _linked(overlaps(x, y), n[left[rows]][:, None], n[right[columns]][None, :], percent) & look[np.ix_(rows, columns)]
            seen = set()
            for r, c in np.argwhere(near):
                p, q = int(left[rows[r]]), int(right[columns[c]])
                pair = (min(comp[p], comp[q]), max(comp[p], comp[q]))
                if pair not in seen:
                    seen.add(pair)
                    out.append((p, q))
        a, b = (pa.array([e[i] for e in out], pa.int64()) for i in range(2))
        return pa.table({"a": nodes.take(a), "b": nodes.take(b)})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The number of common shingles of each of x with each of y, by products of 0/1 matrices over the shingles that both sides hold."""
    common = np.intersect1d(np.concatenate(x), np.concatenate(y))
    shared = np.zeros((len(x), len(y)), np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        held = common[at] == flat
        at, row = at[held], row[held]
        order = np.argsort(at, kind="stable")
        return at[order], row[order]

    if not len(common):
        return shared
    (at, row), (bt, column), width = places(x), places(y), 2048
    for lo in range(0, len(common), width):
        sides = []
        for place, who, m in ((at, row, len(x)), (bt, column, len(y))):
            p, q = np.searchsorted(place, [lo, lo + width])
            part = np.zeros((m, width), np.float32)
            part[who[p:q], place[p:q] - lo] = 1
            sides.append(part)
        shared += sides[0] @ sides[1].T
    return shared


def joined(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """label(node, comp) after links (a, b) between nodes; components are joined through their names only."""
    if label is None:
        return components(links)
    if links.isEmpty():
        return label
    name = lambda c: label.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    edges = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
    step = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    old = label.select("node", "comp").join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    new = step.select(F.col("comp").alias("node"), F.col("to").alias("comp")).join(label.select("node"), "node", "left_anti")
    return stage(old.union(new), "labels")


def frequent_links(tied: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """label after all links that the frequent keys lead to. tied(key, node, n, u, s1, s2); every node in it has a set."""
    left = apart(tied, label)
    for every in (False, True):
        if left.isEmpty():
            return label
        links = stage(verify_pairs(stage(star_pairs(left, percent, every), "stars"), sets, percent), "links")
        label = joined(label, links)
        left, done = apart(left, label), left
        drop(done, links)
    return label if left.isEmpty() else joined(label, stage(tile_links(left, sets, percent), "links"))


def _members(docs: DataFrame, words: int, percent: int, frequent: int = FREQUENT, combine: int = COMBINE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, th, n, comp: a row for each row, with the number of its component; null without shingles."""
    docs = docs.select("doc_id", "text")
    rows = index(docs, words, percent, frequent, combine)
    members = rows.where("kind = 0").select("doc_id", "th", "n", "d1", "d2")
    # ids may be null or repeated, so the digest makes a node, which the staged table numbers; one of its rows lends the text
    own = F.coalesce(F.min_by("th", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))), F.min("th"))
    nodes = members.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), own.alias("th"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    name = nodes.select("d1", F.col("node").alias("a"))
    pairs = candidate_pairs(rows.where("kind = 1").select("key", "d1", "n", "pos"), percent)
    pairs = pairs.join(name, "d1").join(name.select(F.col("d1").alias("e1"), F.col("a").alias("b")), "e1")
    pairs = stage(pairs.select("a", "b"), "pairs")
    # a frequent key keeps the sets that can share enough with its smallest one, if there are two at least
    tied = rows.where("kind = 2").select("key", "d1", "n", F.col("pos").alias("u"), "s1", "s2")
    for _ in range(2):
        least = tied.groupBy("key").agg(F.min("n").alias("least"), F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo <> hi").select("key", "least")
        tied = tied.join(least, "key").where((100 + percent) * F.col("u") >= percent * (F.col("n") + F.col("least"))).drop("least").distinct()
        tied = stage(tied, "tied")
    tied = stage(tied.join(name, "d1").select("key", F.col("a").alias("node"), "n", "u", "s1", "s2"), "tied")
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(tied.select("node")).distinct()
    sets = fetch_sets(docs, stage(need.join(nodes, "node").select("node", "id", "th", "d1", "d2"), "need"), words)
    links = stage(verify_pairs(pairs, sets, percent), "links")
    label = frequent_links(tied, joined(None, links), sets, percent)
    drop(pairs, tied, sets, links)
    named = nodes.join(label.select("node", "comp"), "node", "left").select("d1", "d2", F.coalesce("comp", "node").alias("comp"), "id")
    ids = named.groupBy("comp").agg(F.min("id").alias("least"))
    named = stage(named.drop("id").join(ids, "comp"), "named")
    return members.join(named, ["d1", "d2"], "left").select("doc_id", "th", "n", F.when(F.col("n") > 0, F.col("comp")).alias("comp"), "least")


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, frequent: int = FREQUENT, combine: int = COMBINE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id; documents link when 100 * shared >= percent * union."""
    with bounded_batches(docs.sparkSession):
        out = _members(docs, words, percent, frequent, combine)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, of the least id (null last) and text hash; columns as before. Rows without shingles stay."""
    with bounded_batches(docs.sparkSession):
        rows = stage(_members(docs, words, percent).where("comp is not null").select("doc_id", "th", "comp"), "members")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("f"))
    own, gone_id, gone_th = unused(docs.columns, "_th", "_gone_id", "_gone_th")
    same = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("f.th"))
    rows = stage(rows.join(first, "comp").groupBy(F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th), same.alias("first")).count(), "chosen")
    gone = rows.where("not first").select(gone_id, gone_th)
    gone = F.broadcast(gone) if gone.limit(MAX_IDS + 1).count() <= MAX_IDS else gone
    keyed = docs.withColumn(own, F.xxhash64("text"))
    kept = keyed.join(gone, (F.col(own) == F.col(gone_th)) & F.col("doc_id").eqNullSafe(F.col(gone_id)), "left_anti")
    if not rows.where("first and count > 1").isEmpty():
        blank = F.coalesce(F.length(F.btrim("text", F.lit(SPACE))) == 0, F.lit(True))
        kept = kept.where(~blank).dropDuplicates(["doc_id", own]).union(kept.where(blank))
    return kept.select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {PERCENT} * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from documents left join n using (doc_id) join (select a as doc_id, min(b) as component_id from r group by 1) using (doc_id)
"""
