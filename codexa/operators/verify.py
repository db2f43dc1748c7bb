"""Bibliography verification: resolve each reference in two canonical tables, cross-check identifiers both ways, compare fields, decide a status.

Missing side of a comparison is never a mismatch; a failed lookup is never 'verified'; a conflict needs two identifiers that the user supplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codexa.functions import text as T
from codexa.staging import stage

TITLE_THRESHOLD = 0.55
COMMON = 200_000
FEW = 100_000  # DOIs whose records are broadcast
FEW_SETS = 300_000  # token sets whose numbers are broadcast to fetch them
SIGNATURE = [f"s{i}" for i in range(4)]  # of short titles, 64 bits each
SMALL = 64  # tokens from which titles are compared in tiles
TILE_ROWS, TILE_BYTES = 32_768, 16 << 20  # most of a tile
JOB_PAIRS, SMALL_JOBS, MOST_PARTS = 1_000_000, 200, 10_000  # pairs that one task counts at a time, but for skew
STATUSES = ["verified", "mismatch", "partial", "not_found", "error"]
ISSUE = "struct<field:string,supplied:string,canonical:string,source:string,severity:string>"
FIELDS = ["doi", "pmid", "title", "first_author", "all_authors", "year", "journal", "volume", "issue", "pages", "lookup_error"]


def issue(cond: Column, name: str, supplied: Column, canonical: Column, source: str, severity: str = "mismatch") -> Column:
    return F.when(cond, F.struct(F.lit(name).alias("field"), supplied.alias("supplied"), canonical.alias("canonical"), F.lit(source).alias("source"), F.lit(severity).alias("severity")))


def _issues(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def _some(*found: Column) -> Column:
    """Those that are not null, of cheap columns: most rows have none, for which no list is built and filtered."""
    listed = _issues(*found)
    return F.when(F.coalesce(*found).isNotNull(), listed).otherwise(F.filter(listed, lambda x: F.lit(False)))


def first_author_differs(cited: Column, first: Column, everyone: Column) -> Column:
    """No reading of the cited name fits the first author or any individual author. A person is not compared with an organisation alone."""
    single = F.filter(F.coalesce(everyone, F.array().cast("array<string>")), lambda a: (T.text(a) != "") & ~T.is_collective(a))
    lone = T.is_collective(first) & ~T.is_collective(cited)

    def differs(given: Column) -> Column:
        return T.let(T.surname_readings(first), lambda canon: (F.size(given) > 0) & (F.size(canon) > 0) & ~F.arrays_overlap(given, canon) & T.let(
            F.flatten(F.transform(single, T.surname_readings)), lambda roster: ~F.arrays_overlap(given, roster) & ~((F.size(roster) == 0) & lone)))

    return T.let(T.surname_readings(cited), differs)


def compare_fields(ref: str, meta: str, source: str) -> Column:
    """Issues of seven fields between the structs or prefixes ref.* and meta.*; empty without a record."""
    r, m = (lambda c: T.text(F.col(f"{ref}.{c}"))), (lambda c: T.text(F.col(f"{meta}.{c}")))
    both = lambda c: (r(c) != "") & (m(c) != "") & (r(c) != m(c))  # noqa: E731  equal texts need no further look
    titles = (r("title") != "") & (m("title") != "") & ((r("title") != m("title")) | ~r("title").rlike("[A-Za-z0-9]"))  # a title without tokens resembles nothing
    found = _issues(
        issue(both("first_author") & first_author_differs(r("first_author"), m("first_author"), F.col(f"{meta}.all_authors")), "first_author", r("first_author"), m("first_author"), source),
        issue(both("year") & (F.trim(r("year")) != F.trim(m("year"))), "year", r("year"), m("year"), source),
        issue(both("journal") & ~T.journal_matches(r("journal"), m("journal")), "journal", r("journal"), m("journal"), source),
        issue(both("volume") & (T.norm_text(r("volume")) != T.norm_text(m("volume"))), "volume", r("volume"), m("volume"), source),
        issue(both("issue") & (T.norm_text(r("issue")) != T.norm_text(m("issue"))), "issue", r("issue"), m("issue"), source),
        issue(both("pages") & ~T.pages_match(r("pages"), m("pages")), "pages", r("pages"), m("pages"), source),
        issue(titles & (T.title_similarity(r("title"), m("title")) < TITLE_THRESHOLD), "title", r("title"), m("title"), source),
    )
    usable = F.col(meta).isNotNull() & (T.text(F.col(f"{meta}.lookup_error")) == "")
    # compiled code passes by records that give no field to compare; the list above is interpreted
    some = both("first_author") | both("year") | both("journal") | both("volume") | both("issue") | both("pages") | titles
    return F.when(usable & some, found).otherwise(F.array().cast(f"array<{ISSUE}>"))


def cross_check(doi: Column, pmid: Column, derived_pmid: Column, pubmed_doi: Column) -> Column:
    """Up to two conflicts: the DOI leads to another PMID; the PMID's record has another DOI."""
    doi, pmid, derived, theirs = T.text(doi), T.text(pmid), T.text(derived_pmid), T.text(pubmed_doi)
    back, own = T.normalize_doi(theirs), T.normalize_doi(doi)
    return _some(
        issue((doi != "") & (pmid != "") & (derived != "") & (derived != F.trim(pmid)), "pmid", pmid, derived, "cross-id", "conflict"),
        issue((pmid != "") & (own != "") & (back != "") & (back != own), "doi", doi, theirs, "cross-id", "conflict"),
    )


def decide_status(resolved: Column, issues: Column, errors: Column) -> Column:
    return F.when(~resolved, F.when(F.size(errors) > 0, "error").otherwise("not_found")).when(F.size(issues) > 0, "mismatch").when(F.size(errors) > 0, "partial").otherwise("verified")


def _signatures(flat: np.ndarray, row: np.ndarray, rows: int, bits: int = 1024) -> np.ndarray:
    """So many bits for each set: the parity of its tokens in each bucket. Two sets differ by at least as many tokens as their signatures by bits. Halves of a signature, one upon the other (XOR), are one of half the bits."""
    out = np.zeros((rows, bits // 8), np.uint8)
    step = max(1, (1 << 20) // bits)
    for first in range(0, rows, step):
        there = slice(*np.searchsorted(row, [first, first + step]))
        k = min(step, rows - first)
        odd = np.bincount((row[there] - first) * bits + (flat[there] & (bits - 1)), minlength=k * bits).astype(np.uint8) & 1
        out[first : first + k] = np.packbits(odd.reshape(k, bits), axis=1)
    return out.view(np.int64)


def _overlap_at_most(p: str, q: str) -> Column:
    """Twice the most tokens that two sets of n and m can share, by the signatures p* and q*."""
    differ = F.bit_count(F.col(f"{p}{SIGNATURE[0]}").bitwiseXOR(F.col(f"{q}{SIGNATURE[0]}")))
    for c in SIGNATURE[1:]:
        differ = differ + F.bit_count(F.col(f"{p}{c}").bitwiseXOR(F.col(f"{q}{c}")))
    return F.col("n") + F.col("m") - differ


def _rare_first(sets: DataFrame) -> DataFrame:
    """sets(node, ts) with ts in one order for all: rare tokens by hash, then the COMMON most frequent ones, the most frequent last; and their signatures."""
    seen = sets.select(F.explode("ts").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    top = seen.orderBy(F.desc("n"), "h").limit(COMMON).select("h", "n").toArrow()  # COMMON rows at most
    h, n = top.column("h").to_numpy(), top.column("n").to_numpy()
    at = np.argsort(h)
    order = np.empty(len(h), np.int64)
    order[np.lexsort((h, n))] = np.arange(1, len(h) + 1)
    known = sets.sparkSession.sparkContext.broadcast((h[at], order[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, place = known.value
        for batch in batches:
            ts = batch.column(1)
            flat, sizes = ts.flatten().to_numpy(), ts.value_lengths().to_numpy()
            key = np.zeros(len(flat), np.int64)
            if len(common):
                i = np.minimum(np.searchsorted(common, flat), len(common) - 1)
                key = np.where(common[i] == flat, place[i], 0)
            row = np.repeat(np.arange(len(sizes)), sizes)
            flat = flat[np.lexsort((flat, key, row))]
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            bits = _signatures(flat, row, len(sizes), 64 * len(SIGNATURE))
            parts = [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(SIGNATURE))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *parts], ["node", "ts", *SIGNATURE])

    return sets.select("node", "ts").mapInArrow(run, "node long, ts array<long>, " + ", ".join(f"{c} long" for c in SIGNATURE))


def _pairs_of_small(sets: DataFrame, sought: DataFrame | None, named: DataFrame, least: float) -> DataFrame:
    """sets(node, ts) -> job, a, b: pairs that may be similar, one of them at least of fewer than SMALL tokens, by equi-joins on prefix tokens. sought: the nodes of a; None: any, each pair once."""
    sets = stage(_rare_first(sets), "sets").withColumn("n", F.size("ts"))
    keep = (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int")
    prefix = sets.select("node", "n", *SIGNATURE, F.posexplode(F.slice("ts", F.lit(1), keep)).alias("pos", "t"))
    x = prefix if sought is None else prefix.join(sought, "node", "left_semi")
    y = prefix if sought is None else prefix.join(named, "node", "left_semi")
    x = x.select("t", F.col("node").alias("a"), "n", F.col("pos").alias("i"), *[F.col(c).alias(f"p_{c}") for c in SIGNATURE])
    y = y.select("t", F.col("node").alias("b"), F.col("n").alias("m"), F.col("pos").alias("j"), *[F.col(c).alias(f"q_{c}") for c in SIGNATURE])
    near = (F.least("n", "m") >= F.lit(least) * F.greatest("n", "m") - 1e-9) & (F.least("n", "m") < SMALL) & (F.col("a") < F.col("b") if sought is None else F.col("a") != F.col("b"))
    # the first common token of a pair leaves room for the whole overlap behind it in both sets
    near = near & (F.lit(1 + least) * F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= F.lit(least) * (F.col("n") + F.col("m")) - 1e-9)
    near = near & (F.lit(1 + least) * _overlap_at_most("p_", "q_") >= F.lit(2 * least) * (F.col("n") + F.col("m")) - 1e-9)
    return x.join(y, "t").where(near).select((-1 - F.pmod(F.xxhash64("a"), F.lit(SMALL_JOBS))).alias("job"), "a", "b").distinct()


def _bits_of(size_class: int) -> int:
    return min(max(4 << (size_class // 2), 256), 1 << 16)


def _signed(sets: DataFrame) -> DataFrame:
    """sets(node, ts) -> node, n, class, sig: signatures of so many bits as the class of sizes asks for. Two classes double the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat, sizes = batch.column(2).flatten().to_numpy(), batch.column(2).value_lengths().to_numpy()
            bits = np.array([_bits_of(c) for c in range(200)])[kind]
            for w in np.unique(bits):
                own = bits == w
                k = int(own.sum())
                sig = _signatures(flat[np.repeat(own, sizes)], np.repeat(np.arange(k), sizes[own]), k, int(w))
                ends = (np.arange(k + 1) * (w // 8)).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(sizes[own].astype(np.int32)), pa.array(kind[own]), packed], ["node", "n", "class", "sig"])

    kind = F.floor(2 * F.log2(F.size("ts"))).cast("int")
    return sets.select("node", kind.alias("class"), "ts").mapInArrow(run, "node long, n int, class int, sig binary")


def _compared(least: float, once: bool):
    """Two tiles of signatures -> pairs that may be similar. once: each pair once, where both tiles are one."""

    def tile(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = t.column("n").to_numpy()
        at = np.argsort(n, kind="stable")
        bits = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(len(n), -1)
        return t.column("node").to_numpy()[at], n[at].astype(np.int64), bits[at]

    def folded(bits: np.ndarray, words: int) -> np.ndarray:
        while bits.shape[1] > words:
            bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
        return bits

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found_a, found_b = [], []
        if left.num_rows and right.num_rows:
            (a, n, p), (b, m, q) = tile(left), tile(right)
            words = min(p.shape[1], q.shape[1])
            p, q = folded(p, words), np.ascontiguousarray(folded(q, words).T)
            alike = once and left.column("tile")[0] == right.column("tile")[0]
            for i in range(0, len(a), 32):
                x, size = p[i : i + 32], n[i : i + 32, None]
                lo, hi = np.searchsorted(m, [least * size[0, 0] - 1e-9, size[-1, 0] / least + 1e-6])
                for j in range(lo, hi, 4096):
                    to = min(hi, j + 4096)
                    differ = np.zeros((len(x), to - j), np.int32 if words > 500 else np.uint16)
                    for w in range(words):
                        differ += np.bitwise_count(x[:, w, None] ^ q[w, None, j:to])
                    both = size + m[None, j:to]
                    r, c = np.nonzero(differ <= ((1 - least) * both + 1e-9) / (1 + least))
                    y, z = a[i + r], b[j + c]
                    s, t = n[i + r], m[j + c]
                    ok = (np.minimum(s, t) >= least * np.maximum(s, t) - 1e-9) & (y < z if alike else y != z)
                    found_a.append(y[ok])
                    found_b.append(z[ok])
        y, z = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (found_a, found_b))
        job = left.column("job")[0].as_py() if len(y) else 0
        return pa.table({"job": np.full(len(y), job, np.int64), "a": y, "b": z})

    return run


def _pairs_of_large(signed: DataFrame, sought: DataFrame | None, named: DataFrame, least: float) -> DataFrame:
    """signed() of distinct sets -> job, a, b: pairs that may be similar, by their signatures, tile by tile. A tile has sets of one class of sizes, TILE_ROWS of them and TILE_BYTES
    at most; it meets those of classes that are near enough. Nothing is stored for a pair that the signatures part. sought: as above."""
    spark = signed.sparkSession
    classes, reach, tiles = sorted(tuple(r) for r in signed.groupBy("class").count().collect()), math.ceil(-2 * math.log2(least)), []
    for c, n in classes:
        tiles.append((c, -(-n // max(1, min(TILE_ROWS, TILE_BYTES * 8 // _bits_of(c)))), tiles[-1][2] + tiles[-1][1] if tiles else 0))
    total = sum(t[1] for t in tiles)
    reached = [[f for k, many, first in tiles if abs(k - c) <= reach for f in (first, first + many - 1)] for c, _, _ in tiles]
    plan = spark.createDataFrame([(*t, min(f), max(f)) for t, f in zip(tiles, reached, strict=True)], "class int, many long, first long, low long, high long")
    jobs = sum(many * (max(f) - min(f) + 1) for (_, many, _), f in zip(tiles, reached, strict=True))
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), jobs), MOST_PARTS)
    placed = signed.join(F.broadcast(plan), "class").withColumn("tile", F.col("first") + F.pmod("node", "many"))
    a, b = (placed, placed) if sought is None else (placed.join(sought, "node", "left_semi"), placed.join(named, "node", "left_semi"))
    cols = ["job", "tile", "node", "n", "sig"]
    a = a.withColumn("other", F.explode(F.sequence("tile" if sought is None else "low", "high"))).withColumn("job", F.col("tile") * total + F.col("other")).select(*cols)
    b = b.withColumn("other", F.explode(F.sequence("low", "tile" if sought is None else "high"))).withColumn("job", F.col("other") * total + F.col("tile")).select(*[F.col(c).alias(c) for c in cols])
    dealt = [x.repartition(parts, "job").groupBy("job") for x in (a, b)]  # bytes say little of the work, so the planner is not to merge them
    return dealt[0].cogroup(dealt[1]).applyInArrow(_compared(least, sought is None), "job long, a long, b long")


def _scored(least: float, both_ways: bool):
    """Pairs of a job and its sets, each once -> the best of each a (both_ways: of each b, too), with its DOI."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        out = pa.schema([("node", pa.int64()), ("doi", pa.string()), ("similarity", pa.float64())])
        if not pairs.num_rows or not sets.num_rows:
            return out.empty_table()
        nodes, at = np.unique(sets.column("node").to_numpy(), return_index=True)
        ts, doi = sets.column("ts").combine_chunks(), np.array(sets.column("doi").to_pylist(), object)[at]
        size = ts.value_lengths().to_numpy().astype(np.int64)
        start = (np.cumsum(size) - size)[at]
        vocabulary, flat = np.unique(ts.flatten().to_numpy(), return_inverse=True)
        size = size[at]
        a, b = (np.searchsorted(nodes, pairs.column(c).to_numpy()) for c in "ab")
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        shared, marked = np.zeros(len(a), np.int64), np.zeros(len(vocabulary), bool)
        first = np.concatenate([np.flatnonzero(np.diff(a, prepend=-1)), [len(a)]])
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            own = flat[start[a[lo]] : start[a[lo]] + size[a[lo]]]
            marked[own] = True
            for j in range(lo, hi, 500):
                k = b[j : min(hi, j + 500)]
                ends = np.cumsum(size[k])
                places = np.arange(ends[-1]) + np.repeat(start[k] - ends + size[k], size[k])
                shared[j : j + len(k)] = np.add.reduceat(marked[flat[places]], ends - size[k], dtype=np.int64)
            marked[own] = False
        alike = shared / (size[a] + size[b] - shared)
        ok = alike >= least
        a, b, alike = a[ok], b[ok], alike[ok]
        if both_ways:
            a, b, alike = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([alike, alike])
        rank = np.empty(len(nodes), np.int64)
        rank[sorted(range(len(nodes)), key=lambda i: (doi[i] is None, doi[i] or ""))] = np.arange(len(nodes))
        order = np.lexsort((rank[b], -alike, a))
        best = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
        return pa.table([nodes[a[best]], pa.array(doi[b[best]], pa.string()), alike[best]], schema=out)

    return run


def _best_of(pairs: DataFrame, titles: DataFrame, named: DataFrame, least: float, both_ways: bool) -> DataFrame:
    """pairs(job, a, b) -> node, doi, similarity: the best of each job. A set travels once to each part of a job that has pairs of it, however many they are."""
    sizes = pairs.groupBy("job").count().select("job", F.ceil(F.col("count") / JOB_PAIRS).alias("many"))
    pairs = pairs.join(F.broadcast(sizes), "job").withColumn("part", F.pmod(F.xxhash64("a"), "many")).drop("many")
    wanted = pairs.select("job", "part", F.explode(F.array("a", "b")).alias("node")).distinct()
    some = stage(wanted.select("node").distinct(), "wanted")
    some = F.broadcast(some) if some.count() <= FEW_SETS else some
    fetched = titles.join(some, "node", "left_semi").groupBy("node").agg(F.any_value("ts").alias("ts")).join(named, "node", "left")
    sets = wanted.join(fetched, "node").select(*[F.col(c).alias(c) for c in ("job", "part", "node", "doi", "ts")])  # other columns than those of the pairs
    return pairs.groupBy("job", "part").cogroup(sets.groupBy("job", "part")).applyInArrow(_scored(least, both_ways), "node long, doi string, similarity double")


def title_candidates(refs: DataFrame, crossref: DataFrame, least: float = TITLE_THRESHOLD, same: bool = False) -> DataFrame:
    """key -> the most similar title (Jaccard of tokens, then DOI). Equal titles need no search; each distinct token set is compared once. Short titles meet by equi-joins on prefix
    tokens: a pair of at least `least` shares one of the first n - ceil(least n) + 1 tokens in a fixed order, here rare ones first. Long ones, whose common words would make most
    pairs meet, are compared by signatures in tiles. Pairs that are left are counted token by token, part by part, so no set is stored for each pair that holds it. Tokens and token
    sets are compared by 64-bit hashes. same: keys and DOIs name the same rows, and no row is matched with its own name."""
    words = F.split(T.norm_text(F.col("title")), " ")
    tokens = F.sort_array(F.array_remove(F.array_distinct(F.transform(words, lambda x: F.xxhash64(x))), F.xxhash64(F.lit(""))))

    def hashed(df: DataFrame, name: str) -> DataFrame:  # the empty ones go later: a condition before staging would build the tokens twice
        return stage(df.select(name, tokens.alias("ts")).select(name, F.xxhash64("ts").alias("node"), "ts"), "titles").where("size(ts) > 0")

    refs = hashed(refs, "key")
    canon = refs.withColumnRenamed("key", "doi") if same else hashed(crossref.groupBy("title").agg(F.min("doi").alias("doi")), "doi")  # a title is taken apart once
    named = canon.groupBy("node").agg(F.min("doi").alias("doi"))
    if same:
        rest = canon.select("node", F.col("doi").alias("d")).join(named, "node").where("d <> doi").groupBy("node").agg(F.min("d").alias("next"))
        named = named.join(rest, "node", "left")
    named = stage(named, "named")
    own = F.when(F.col("doi") != F.col("key"), F.col("doi")).otherwise(F.col("next")) if same else F.col("doi")
    exact = refs.select("key", "node").join(named, "node", "left").select("key", "node", own.alias("found_doi"))
    alone = exact.where("found_doi is null").select("key", "node")
    titles = refs.select("node", "ts") if same else refs.select("node", "ts").union(canon.select("node", "ts"))
    sought = None if same else stage(alone.select("node").distinct(), "sought")
    small = titles.where(F.size("ts") * least < SMALL).groupBy("node").agg(F.any_value("ts").alias("ts"))
    large = stage(_signed(titles.where(F.size("ts") >= SMALL)).dropDuplicates(["node"]), "signed")
    pairs = stage(_pairs_of_small(small, sought, named, least).union(_pairs_of_large(large, sought, named, least)), "pairs")
    best = _best_of(pairs, titles, named.select("node", "doi"), least, same).groupBy("node").agg(F.min_by(F.struct("doi", "similarity"), F.struct(-F.col("similarity"), "doi")).alias("x"))
    found = alone.join(best, "node").select("key", F.col("x.doi").alias("found_doi"), F.col("x.similarity").alias("similarity"))
    return exact.where("found_doi is not null").select("key", "found_doi", F.lit(1.0).alias("similarity")).union(found)


def _least(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key in the order given. Rows are dealt and sorted once, and lie as a join by the key needs them."""
    before = F.lag(F.lit(1)).over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_before", before).where("_before is null").drop("_before")


def _records(df: DataFrame, key: str, *order: Column | str, name: str) -> DataFrame:
    """key and the first record of each key as a struct `name`."""
    columns = [c for c in df.columns if c != key]
    return _least(df, key, *order).select(key, F.struct(*columns).alias(name))


def _once(df: DataFrame, keep: list[Column | str], found: dict[str, Column]) -> DataFrame:
    """df with the columns kept and those found, the latter behind a generator, so that what is built on them does not evaluate them again. They are made in a projection before it, which is
    compiled, where a generator's own argument would be interpreted."""
    made = df.select(*keep, F.struct(*[c.alias(k) for k, c in found.items()]).alias("_made"))
    return made.select(*[c for c in made.columns if c != "_made"], F.inline(F.array("_made")))


def _by_doi(doi_pmid: DataFrame) -> DataFrame:
    links = doi_pmid.select(T.normalize_doi(F.col("doi")).alias("_d"), "pmid", "lookup_error").where("_d <> ''")
    return _records(links, "_d", F.asc_nulls_last("pmid"), name="dp")


def _by_pmid(pubmed: DataFrame) -> DataFrame:
    return _records(pubmed.withColumn("_key", F.trim("pmid")).where("_key <> ''"), "_key", "pmid", "title", name="pm")


def _good(c: str) -> Column:
    return F.col(c).isNotNull() & (T.text(F.col(f"{c}.lookup_error")) == "")


def _derived() -> Column:
    return F.when((F.col("_doi") != "") & (T.text(F.col("dp.lookup_error")) == ""), T.text(F.col("dp.pmid"))).otherwise("")


def _conflicts() -> Column:
    return cross_check(F.col("doi"), F.col("pmid"), F.col("derived"), F.when(_good("pm"), F.col("pm.doi")))


def _keyed(refs: DataFrame) -> DataFrame:
    """refs with _doi, _pmid and the join key _d. A row without an identifier finds nothing: its key is its own, behind a space that no trimmed identifier has, so that such rows spread over all tasks."""
    own = F.concat(F.lit(" "), F.xxhash64("key", "title", "first_author", "year").cast("string"))
    return refs.withColumns({"_doi": T.normalize_doi(F.col("doi")), "_pmid": F.trim(T.text(F.col("pmid")))}).withColumn("_d", F.coalesce(F.nullif("_doi", F.lit("")), own))


def _pubmed_key() -> Column:
    return F.coalesce(F.nullif("_pmid", F.lit("")), F.nullif("derived", F.lit("")), F.concat(F.lit(" "), F.col("_d")))


def conflicts(refs: DataFrame, doi_pmid: DataFrame, pubmed: DataFrame) -> DataFrame:
    """refs with the conflicts that verify() finds between their identifiers, as issues. Canonical texts play no part in it, so two equi-joins do."""
    j = _keyed(refs).join(_by_doi(doi_pmid), "_d", "left").withColumn("derived", _derived())
    j = j.withColumn("_key", _pubmed_key()).join(_by_pmid(pubmed.select("pmid", "doi", "title", "lookup_error")), "_key", "left")
    return _once(j, refs.columns, {"issues": _conflicts()})


def verify(refs: DataFrame, crossref: DataFrame, doi_pmid: DataFrame, pubmed: DataFrame) -> DataFrame:
    """refs with derived_pmid, issues, errors, resolved and status, a row for each of refs, whether or not keys repeat; equi-joins, no loop over references. The references with their records are
    staged once, those whose title is to be sought apart from the others, which go through no further join but that by PMID."""
    crossref = stage(crossref, "crossref")  # read three times, and what it is read from may be dear
    canon = crossref.withColumn("_d", T.normalize_doi(F.col("doi"))).where("_d <> ''")
    failed = T.text(F.col("cr.lookup_error")) != ""
    j = _keyed(refs).join(_records(canon, "_d", "doi", "title", name="cr"), "_d", "left").join(_by_doi(doi_pmid), "_d", "left")
    j = j.withColumns({"_failed": failed, "_look": ((F.col("_doi") == "") | failed) & (T.text(F.col("title")) != ""), "derived": _derived(), "_link_failed": T.text(F.col("dp.lookup_error")) != ""})
    # rows are told apart by number, as BibTeX keys may repeat
    j = stage(j.drop("dp").withColumn("_row", F.monotonically_increasing_id()), "references", by="_look")
    look = j.where("_look")
    found = title_candidates(look.select(F.col("_row").alias("key"), "title"), crossref.where("lookup_error is null or lookup_error = ''"))
    found = stage(found.select(F.col("key").alias("_row"), T.normalize_doi(F.col("found_doi")).alias("_d")), "found")
    wanted = stage(found.select("_d").distinct(), "wanted")
    few = wanted.limit(FEW + 1).count() <= FEW
    records = _records(canon.join(F.broadcast(wanted) if few else wanted, "_d", "left_semi"), "_d", "doi", "title", name="cr")
    matched = found.join(F.broadcast(records) if few else records, "_d").drop("_d")
    rest = j.where("not _look").withColumn("cr", F.when(~F.col("_failed"), F.col("cr")))
    j = rest.unionByName(look.drop("cr").join(matched, "_row", "left"))
    j = j.withColumn("_key", _pubmed_key()).join(_by_pmid(pubmed), "_key", "left").withColumn("ref", F.struct(*refs.columns))
    absent_doi = (F.col("_doi") != "") & F.col("cr").isNull() & ~F.col("_failed")
    absent_pmid = (F.col("_pmid") != "") & F.col("pm").isNull()
    errors = _some(F.when(F.col("_failed"), "crossref lookup failed"), F.when(absent_doi, "DOI is not registered"), F.when(F.col("_link_failed"), "DOI to PMID lookup failed"), F.when(T.text(F.col("pm.lookup_error")) != "", "PubMed lookup failed"))
    nothing = F.lit(None).cast("string")
    missing = _some(issue(absent_doi, "doi", F.col("doi"), nothing, "crossref", "missing"), issue(absent_pmid, "pmid", F.col("pmid"), nothing, "pubmed", "missing"))
    issues = F.concat(missing, _conflicts(), compare_fields("ref", "cr", "crossref"), compare_fields("ref", "pm", "pubmed"))
    out = _once(j, [*refs.columns, F.col("derived").alias("derived_pmid")], {"issues": issues, "errors": errors, "resolved": _good("cr") | _good("pm")})
    return out.withColumn("status", decide_status(F.col("resolved"), F.col("issues"), F.col("errors")))


def summarize(results: DataFrame) -> DataFrame:
    """One row: a count for each status, present or not, and the entries with a conflict, an unregistered identifier or a failed lookup."""
    has = lambda s: F.exists("issues", lambda i: i.severity == s)
    return results.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count_if(has("conflict")).alias("conflicts"), F.count_if(has("missing")).alias("unregistered"), F.count_if(F.size("errors") > 0).alias("incomplete"))


def section_rows(results: DataFrame, severity: str) -> DataFrame:
    """Rows of a report section; field mismatches only of entries without a conflict or an unregistered identifier."""
    hard = F.exists("issues", lambda i: i.severity.isin("conflict", "missing"))
    rows = results.where(~hard) if severity == "mismatch" else results
    return rows.select("key", F.explode("issues").alias("i")).where(F.col("i.severity") == severity).select("key", "i.field", F.left("i.supplied", F.lit(60)).alias("supplied"), F.left("i.canonical", F.lit(60)).alias("canonical"), "i.source")


def partial_rows(results: DataFrame) -> DataFrame:
    return results.where("status = 'partial'").select("key", F.left(F.concat_ws("; ", "errors"), F.lit(90)).alias("errors"))


def in_order(results: DataFrame, refs: DataFrame) -> DataFrame:
    """results in the order of refs(key, ord); a key that stands several times takes its last place."""
    place = refs.groupBy("key").agg(F.max("ord").alias("_ord"))
    return results.join(place, "key").orderBy("_ord").drop("_ord")


# title, what it means, columns
SECTIONS = {
    "conflict": ("Conflicting identifiers", "DOI and PMID of these entries belong to different works.", ["key", "field", "supplied", "canonical"]),
    "missing": ("Identifiers that nobody registered", "Nothing stands behind these identifiers.", ["key", "field", "supplied"]),
    "mismatch": ("Differing fields", "", ["key", "field", "supplied", "canonical", "source"]),
    "partial": ("Checked in part", "A lookup failed, so a check may be missing; look these up again.", ["key", "errors"]),
    "unresolved": ("Without a record", "No record was found and no identifier is known to be wrong.", ["key", "status", "errors"]),
}


def sections(results: DataFrame) -> dict[str, DataFrame]:
    """The rows of each report section by its key in SECTIONS."""
    found = {s: section_rows(results, s) for s in ("conflict", "missing", "mismatch")}
    return found | {"partial": partial_rows(results), "unresolved": unresolved_rows(results)}


def render_markdown(results: DataFrame) -> str:
    """The report of one bibliography, which a person reads: counts, then a table for each section that has rows."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    n = summarize(results).first().asDict()
    out = ["# References checked", "", *[f"- {k.replace('_', ' ')}: {v}" for k, v in n.items()], ""]
    for name, df in sections(results).items():
        title, meaning, columns = SECTIONS[name]
        rows = df.select(*columns).orderBy("key").collect()
        if rows:
            out += [f"## {title}", "", *([meaning, ""] if meaning else []), "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""]
    return "\n".join(out)


def exit_code(summary: DataFrame, fail_on_mismatch: bool = False) -> int:
    """1 if asked to fail and anything is wrong or failed, else 0."""
    n = summary.first()
    return int(fail_on_mismatch and n["mismatch"] + n["conflicts"] + n["unregistered"] + n["error"] > 0)


def unresolved_rows(results: DataFrame) -> DataFrame:
    return results.where(F.col("status").isin("not_found", "error") & (F.size("issues") == 0)).select("key", "status", F.when(F.size("errors") > 0, F.left(F.concat_ws("; ", "errors"), F.lit(80))).otherwise("no matching record").alias("errors"))


def has_identifier() -> Column:
    return (F.trim(T.text(F.col("doi"))) != "") | (F.trim(T.text(F.col("pmid"))) != "")


def wanted_ids(refs: DataFrame, doi_pmid: DataFrame) -> DataFrame:
    """PMIDs to look up: supplied ones and those that DOIs lead to."""
    derived = refs.select(T.normalize_doi(F.col("doi")).alias("d")).where("d <> ''").join(doi_pmid.select(T.normalize_doi(F.col("doi")).alias("d"), "pmid"), "d").select("pmid")
    return refs.select("pmid").union(derived).where("pmid <> ''").distinct()
