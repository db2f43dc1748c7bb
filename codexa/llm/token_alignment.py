"""Cross-tokenizer alignment (operator 13).

Method. Tokenizer A (byte-level BPE) and B (SentencePiece) split the same bytes. A packed bitset for each marks the bytes at which a token ends; their AND yields the shared
cuts. The popcount rank of a cut (ones before its word plus ones below it in the word) is the number of tokens up to it, so two neighbouring cuts name the token ranges
of a group. The last tokens of a group end together: they are linked. Links are counted over the corpus by id pair, and each link is held against the best pair of its B id.

Texts are cut into units where both tokenizers provably start anew: before a run of spaces and line feeds that follows a letter, digit or visible ASCII sign (see `Pair`). A unit's end
is a shared cut, so the groups of a text are those of its units, and a unit that is met again is looked up. The bitsets are those of all new units of a batch, laid end
to end: units whose last character is sure are also encoded end to end, and the ends of all units are checked among the token ends. A model pair that the proof does not
cover is applied to whole texts.

Defined cases. Null and empty texts, and texts whose tokens do not give back exactly the bytes of space + text in both (as those that hold the white-space marker itself), have no
tokens: zeros and ''. Repeated rows are rows of their own and count twice; null ids stay. Very long texts are handled whole, long units without a cut too. An empty table gives
no rows. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop, frugal, stage, table
from .token_counts import MARK, Units, groups, loaded, model_path

MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Units kept by a worker, the longest that is kept, units encoded end to end, characters of new units aligned at once, most id pairs that are broadcast (under 40 bytes each).
KNOWN_UNITS, LONG_UNIT, IN_ROW, AT_ONCE, MOST_PAIRS = 400_000, 64, 4000, 1 << 19, 500_000
#: An id pair as one long: a * 2**B_BITS + b.
B_BITS = 31


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: visible Latin-1 characters stand for themselves, the others follow from 256 up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def pack(places: np.ndarray, size: int) -> np.ndarray:
    """A bitset of `size` bits with ones at the places, as 64-bit words."""
    marks = np.zeros(-(-size // 64) * 64, np.uint8)
    marks[places] = 1
    return np.packbits(marks, bitorder="little").view(np.uint64)


def rank(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The number of ones up to each place, itself included."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    upto = words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
    return before[word] + np.bitwise_count(upto)


def select(words: np.ndarray) -> np.ndarray:
    """The places of all ones."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


class Pair:
    """Both tokenizers and the aligned units met so far."""

    def __init__(self, paths: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the work
        from tokenizers import Tokenizer

        a, b = json.loads(paths)
        with open(a, encoding="utf-8") as f:
            spec = json.load(f)
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = Units(b)
        pre = spec.get("pre_tokenizer") or {}
        # the usual byte-level pattern starts a piece before each run of white space; nothing crosses pieces
        self.safe = self.b.safe and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        self.safe = self.safe and all(t.get("special") for t in spec.get("added_tokens") or ())
        alphabet = byte_alphabet()
        self.bytes_a = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x([0-9A-Fa-f]{2})>", p.piece)) else p.piece.replace(MARK, " ").encode() for p in self.b.proto.pieces]
        self.cut = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
        self.doubtful = re.compile(r"[^!-~\w \n][ \n]")  # a character that may be white space to A, before a run
        self.sure = re.compile(r"[!-~\w]\Z")
        self.len_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.len_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        #: An id as it is written inside a side of a group and at its end.
        self.inner_a, self.last_a = ([f"{i}{c}" for i in range(len(self.len_a))] for c in ",|")
        self.inner_b, self.last_b = ([f"{i}{c}" for i in range(len(self.len_b))] for c in ",;")
        self.known: dict[str, int | None] = {}
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        #: By unit: its groups as text, its tokens (a, b), the number of its pairs, its pairs; the arrays of all batches so far.
        self.texts: list[str] = []
        self.n_tokens, self.n_pairs, self.pairs = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def units(self, text: str) -> list[str]:
        """Units of space + text."""
        whole = " " + text
        if not self.safe or MARK in text:
            return [whole]
        parts = self.cut.findall(whole)
        if self.doubtful.search(whole):
            merged: list[str] = []
            for part in parts:
                if merged and not self.sure.search(merged[-1]):
                    merged[-1] += part
                else:
                    merged.append(part)
            return merged
        return parts

    def encode(self, units: list[str], in_row: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, one after the other."""
        given = ["".join(units[i : i + IN_ROW]) for i in range(0, len(units), IN_ROW)] if in_row else units
        ids_a = [i for e in self.a.encode_batch_fast(given, add_special_tokens=False) for i in e.ids]
        each_b = self.b.bare.encode(given, num_threads=1) if self.safe else self.b.whole.encode([u[1:] for u in given], num_threads=1)
        return np.array(ids_a, np.int64), np.array([i for x in each_b for i in x], np.int64)

    def learn(self, units: list[str]) -> None:
        """Align new units."""
        ends = [bool(self.safe and self.sure.search(u)) for u in units]
        for in_row in (True, False):
            mine = [u for u, e in zip(units, ends, strict=True) if e == in_row]
            start = 0
            while start < len(mine):
                end, size = start, 0
                while end < len(mine) and (end == start or size + len(mine[end]) < AT_ONCE):
                    size += len(mine[end])
                    end += 1
                self._align(mine[start:end], in_row)
                start = end

    def _align(self, units: list[str], in_row: bool) -> None:
        flat_a, flat_b = self.encode(units, in_row)
        raw = [u.encode() for u in units]
        whole, unit_ends = b"".join(raw), np.cumsum([len(r) for r in raw])
        ends_a, ends_b = np.cumsum(self.len_a[flat_a]) - 1, np.cumsum(self.len_b[flat_b]) - 1  # a token's last byte, on the axis of all units
        size = len(whole)
        alike = len(ends_a) and len(ends_b) and ends_a[-1] == ends_b[-1] == size - 1
        alike = alike and b"".join(map(self.bytes_a.__getitem__, flat_a.tolist())) == whole == b"".join(map(self.bytes_b.__getitem__, flat_b.tolist()))
        if alike:
            bits_a, bits_b = pack(ends_a, size), pack(ends_b, size)
            shared = bits_a & bits_b
            at_end = unit_ends - 1
            alike = bool((shared[at_end >> 6] >> (at_end & 63).astype(np.uint64) & np.uint64(1)).all())
        if not alike:  # some text whose tokens do not give it back: find it
            if len(units) == 1:
                self.known[units[0]] = None
                return
            half = len(units) // 2
            self._align(units[:half], in_row)
            self._align(units[half:], in_row)
            return
        cuts = select(shared)
        upto_a, upto_b = rank(bits_a, cuts), rank(bits_b, cuts)
        of_unit = np.searchsorted(cuts, at_end) + 1  # a unit's end is a cut: its rank among the cuts bounds its groups
        starts = np.concatenate([[0], of_unit[:-1]])
        # a group is written as its tokens of A, then those of B: the order of all tokens by (group, side), which is stable
        last_a, last_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
        last_a[upto_a - 1], last_b[upto_b - 1] = True, True
        n_a, n_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        written = np.empty(len(flat_a) + len(flat_b), object)
        shift_a, shift_b = np.repeat(upto_b - n_b, n_a), np.repeat(upto_a, n_b)
        words_a = [y[i] for i, y in zip(flat_a.tolist(), map((self.inner_a, self.last_a).__getitem__, last_a.tolist()), strict=True)]
        words_b = [y[i] for i, y in zip(flat_b.tolist(), map((self.inner_b, self.last_b).__getitem__, last_b.tolist()), strict=True)]
        written[np.arange(len(flat_a)) + shift_a] = words_a
        written[np.arange(len(flat_b)) + shift_b] = words_b
        written = written.tolist()
        bounds = (upto_a + upto_b)[of_unit - 1]
        first = len(self.texts)
        self.texts += ["".join(written[x:y])[:-1] for x, y in zip([0, *bounds[:-1].tolist()], bounds.tolist(), strict=True)]
        self.known.update(zip(units, range(first, len(self.texts)), strict=True))
        self.n_tokens.append(np.diff(np.stack([upto_a, upto_b], 1)[of_unit - 1], axis=0, prepend=0))
        self.n_pairs.append(of_unit - starts)
        self.pairs.append((flat_a[upto_a - 1] << B_BITS) + flat_b[upto_b - 1])

    def align(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """For each text (n_a, n_b, n_links, sha256), and the distinct id pairs of all texts: offsets by text, pairs, times."""
        cut = [self.units(t) if t else [] for t in texts]
        fresh = set().union(*cut).difference(self.known) if cut else set()
        if len(self.known) + len(fresh) > KNOWN_UNITS:
            self.forget()
            fresh = set().union(*cut)
        self.learn(list(fresh))
        counts, sizes_of, flat = (np.concatenate(x) for x in (self.n_tokens, self.n_pairs, self.pairs))
        self.n_tokens, self.n_pairs, self.pairs = [counts], [sizes_of], [flat]
        starts = np.cumsum(sizes_of) - sizes_of
        rows, offsets, all_pairs, all_times = [], [0], [], []
        for units in cut:
            at = [self.known[u] for u in units]
            if not at or None in at:
                rows.append((0, 0, 0, ""))
                offsets.append(offsets[-1])
                continue
            unit = np.array(at, np.int64)
            n_a, n_b = counts[unit].sum(0).tolist()
            digest = hashlib.sha256(";".join(map(self.texts.__getitem__, at)).encode()).hexdigest()
            sizes = sizes_of[unit]
            total = int(sizes.sum())
            within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            pairs = np.sort(flat[np.repeat(starts[unit], sizes) + within])
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            rows.append((n_a, n_b, total, digest))
            offsets.append(offsets[-1] + len(first))
            all_pairs.append(pairs[first])
            all_times.append(np.diff(first, append=total))
        long = [u for u in fresh if len(u) > LONG_UNIT]
        for u in long:  # what they left in the arrays goes with the next forget()
            self.known.pop(u)
        if len(self.texts) > 2 * KNOWN_UNITS or sum(map(len, long)) > AT_ONCE:
            self.forget()
        none = np.zeros(0, np.int64)
        return rows, np.array(offsets, np.int32), np.concatenate([none, *all_pairs]), np.concatenate([none, *all_times])


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times: the distinct id pairs linked in the text (a * 2**B_BITS + b) and how often."""
    paths = json.dumps([path_a, path_b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(Pair, paths)
        for batch in batches:
            for a, b in groups(batch.column(1)):
                rows, offsets, pairs, times = pair.align(batch.column(1).slice(a, b - a).fill_null("").to_pylist())
                n_a, n_b, n, sha = zip(*rows, strict=True)
                links = pa.array(n, pa.int64())  # one of each group: no token is empty, so one token of A and one of B end at a cut
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), links, links, pa.array(sha), pa.ListArray.from_arrays(offsets, pairs), pa.ListArray.from_arrays(offsets, times)],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """aligned(pairs, times) -> pair, count, best: the links of an id pair over the corpus, and whether no pair of the same B id has more; staged."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = stage(each.groupBy("pair").agg(F.sum("times").alias("count")), "pair_counts")
    of_b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    most = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("most"))
    return stage(counts.withColumn("b", of_b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def alignment_report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    with bounded_batches(docs.sparkSession):
        rows = stage(align(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows)
    if counts.limit(MOST_PAIRS + 1).count() <= MOST_PAIRS:  # else both sides are dealt by pair
        counts = F.broadcast(counts)
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = rows.drop("pairs", "times").join(sums, "row", "left")
    some = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", some("n_best"), some("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(table(spark, sf_dir, "documents"), model_path(MODEL_A), model_path(MODEL_B))
