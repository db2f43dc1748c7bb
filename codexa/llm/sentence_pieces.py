"""SentencePiece encoding and decoding (operator 10): unigram Viterbi over a double-array trie.

Method. The pieces of a model go, as UTF-8 bytes, into a double-array trie with piece ids as values. A text is cut into units at
boundaries that no piece crosses (see token_counts), which leaves the best path of the whole text unchanged. The distinct
units of a batch are joined; the trie is walked from all their characters at once in numpy, and one Viterbi run advances all units offset by offset, keeping
the best score at each end; of equal paths the one whose last piece starts first wins. A unit of more than 64 bytes is walked in blocks of start positions
and scored position by position. A character that no piece covers alone costs the least score minus 10 and becomes byte pieces. Decoding joins pieces, turns bytes back into text and markers into
spaces, and drops the marker put in front. Scores are added in double precision.

Defined cases. Null and empty texts: no pieces, round_trip true (both decode to the empty text). A literal marker character decodes as a space (so round_trip is false).
Very long texts and units: besides the text itself, six bytes for each byte of the unit at hand and a block of the walk. Repeated rows alike. Empty table: no
rows. Further columns are kept; made columns whose names are taken get underscores.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import frugal, table, unused
from .token_counts import MARK, Units, groups, loaded, model_path

KNOWN_UNITS, LONG_UNIT = 300_000, 64
UNKNOWN_PENALTY = 10.0
#: Bytes of text in a group; bytes of units in one run; start positions in a block of a long unit.
GROUP_BYTES, RUN_BYTES, BLOCK = 4 << 20, 256 << 10, 1 << 14
_CHAR = np.repeat(np.array([1, 2, 3, 4], np.uint8), [0xC0, 0x20, 0x10, 0x10])  # bytes of a character by its first one


class DoubleArray:
    """A trie over byte strings: child of s by byte b is base[s] + b + 1 if check of it is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        free = 1
        todo = [(0, 0, len(order), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            while lo < hi and len(keys[order[lo]]) == depth:
                self.value[node] = values[order[lo]]
                lo += 1
            if lo == hi:
                continue
            spans, i = [], lo
            while i < hi:
                b, j = keys[order[i]][depth], i
                while j < hi and keys[order[j]][depth] == b:
                    j += 1
                spans.append((b + 1, i, j))
                i = j
            marks = np.array([s[0] for s in spans])
            while used[free]:
                free += 1
            at, span = max(free - int(marks[0]), 0), 512
            while True:
                while at + span + 300 > len(used):
                    self.base, self.check, self.value, used = (np.concatenate([x, np.full(len(x), fill, x.dtype)]) for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1), (used, False)))
                taken = used[at + int(marks[0]) : at + int(marks[0]) + span].copy()
                for m in marks[1:]:
                    taken |= used[at + int(m) : at + int(m) + span]
                fit = int(taken.argmin())
                if not taken[fit]:
                    at += fit
                    break
                at += span
            self.base[node] = at
            used[at + marks] = True
            self.check[at + marks] = node
            todo.extend((at + m, i, j, depth + 1) for m, i, j in spans)

    def get(self, key: bytes) -> int:
        s = 0
        for b in key:
            t = self.base[s] + b + 1
            if t >= len(self.check) or self.check[t] != s:
                return -1
            s = t
        return int(self.value[s])


class Pieces:
    """The vocabulary of a model with its trie; encodes units and decodes ids."""

    def __init__(self, path: str, trie: DoubleArray | None = None):
        self.units = Units(path)
        pieces = self.units.proto.pieces
        normal = [(i, p) for i, p in enumerate(pieces) if p.type in (1, 4)]
        self.trie = trie or DoubleArray([p.piece.encode() for _, p in normal], [i for i, _ in normal])
        self.deepest = max((len(p.piece.encode()) for _, p in normal), default=0)
        self.score = np.array([p.score for p in pieces], np.float64)
        self.unk_score = min((p.score for _, p in normal), default=0.0) - UNKNOWN_PENALTY
        self.unk = next((i for i, p in enumerate(pieces) if p.type == 2), 0)
        self.cost = np.append(self.score, self.unk_score)  # the last one, at -1, is that of an uncovered character
        self.names = list(map(str, range(len(pieces))))
        self.byte_id = np.full(256, -1, np.int64)
        self.bytes_of: list[bytes] = []
        for i, p in enumerate(pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
            self.bytes_of.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.replace(MARK, " ").encode())
        self.fallback = bool((self.byte_id >= 0).all())
        self.known: dict[str, bytes] = {}

    def _walk(self, data: np.ndarray, pos: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, bytes, piece) of every piece that starts at one of pos and stops at its end at the latest, and of uncovered characters (piece -1)."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        first, state, found = pos, np.zeros(len(pos), np.int32), []
        alone = np.zeros(len(data), bool)
        for d in range(self.deepest):
            inside = pos + d < end
            pos, end, state = pos[inside], end[inside], state[inside]
            nxt = base[state] + data[pos + d] + 1
            ok = check[nxt] == state
            pos, end, state = pos[ok], end[ok], nxt[ok]
            if not len(pos):
                break
            v = value[state]
            has = np.flatnonzero(v >= 0)
            p = pos[has]
            found.append((p, np.full(len(p), d + 1, np.uint8), v[has]))
            alone[p[_CHAR[data[p]] == d + 1]] = True
        bare = first[~alone[first]]
        found.append((bare, _CHAR[data[bare]], np.full(len(bare), -1, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def viterbi(self, texts: list[bytes]) -> list[bytes]:
        """The ids (int32, as bytes) of the best path of each byte string."""
        out: list = [b""] * len(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        short = np.flatnonzero((sizes > 0) & (sizes <= LONG_UNIT))
        short = short[np.argsort(sizes[short], kind="stable")]
        runs = np.cumsum(sizes[short]) // RUN_BYTES
        for part in np.split(short, np.flatnonzero(np.diff(runs)) + 1) if len(short) else ():
            for r, ids in zip(part.tolist(), self._paths([texts[r] for r in part], sizes[part]), strict=True):
                out[r] = ids
        for r in np.flatnonzero(sizes > LONG_UNIT):
            out[r] = self._long(texts[r])
        return out

    def _paths(self, texts: list[bytes], size: np.ndarray) -> list[bytes]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        n, stop = len(texts), np.cumsum(size).astype(np.int32)
        unit = np.repeat(np.arange(n, dtype=np.int32), size)
        pos = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        at, length, piece = self._walk(data, pos, stop[unit[pos]])
        offset = (at - (stop - size.astype(np.int32))[unit[at]]).astype(np.uint8)
        order = np.argsort(offset, kind="stable")
        slot, length, piece = (at + unit[at])[order], length[order], piece[order]  # each unit has a slot more than bytes
        cut = np.searchsorted(offset[order], np.arange(int(size.max()) + 1))
        best = np.full(len(data) + n, -np.inf)
        best[stop - size + np.arange(n)] = 0
        back, chosen = np.zeros(len(best), np.uint8), np.zeros(len(best), np.int32)
        gain = self.cost[piece]
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            end = slot[lo:hi] + length[lo:hi]
            score = best[slot[lo:hi]] + gain[lo:hi]
            up = np.flatnonzero(score > best[end])
            end = end[up]
            best[end], back[end], chosen[end] = score[up], length[lo:hi][up], piece[lo:hi][up]
        # back from the last slot of every unit, all at once
        cur, who, steps = stop + np.arange(n), np.arange(n), []
        first = (stop - size + np.arange(n)).astype(np.int64)
        while len(cur):
            steps.append((who, chosen[cur], back[cur], cur))
            cur = cur - back[cur]
            on = cur > first[who]
            cur, who = cur[on], who[on]
        counts = np.bincount(np.concatenate([w for w, *_ in steps]), minlength=n)
        last = np.cumsum(counts) - 1
        ids = np.zeros(int(counts.sum()), np.int32)
        odd = set()
        for k, (who, got, _, _) in enumerate(steps):
            ids[last[who] - k] = got
            odd.update(who[got < 0].tolist())
        raw, ends = ids.tobytes(), (4 * (last + 1)).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for r in odd:  # units with uncovered characters
            lengths = [int(ln[np.searchsorted(w, r)]) for w, _, ln, _ in steps if len(w) and w[min(np.searchsorted(w, r), len(w) - 1)] == r]
            out[r] = self._spelt(texts[r], np.frombuffer(out[r], np.int32).tolist(), lengths[::-1])
        return out

    def _spelt(self, text: bytes, ids: list[int], lengths: list[int]) -> bytes:
        """ids with uncovered characters (-1) written as byte pieces."""
        out, at = array("i"), 0
        for i, m in zip(ids, lengths, strict=True):
            out.extend([i] if i >= 0 else self.byte_id[list(text[at : at + m])].tolist() if self.fallback else [self.unk])
            at += m
        return out.tobytes()

    def _long(self, text: bytes) -> bytes:
        """The best path of one long unit: blocks of start positions are walked, scores live in a window, back pointers take six bytes for each byte."""
        n = len(text)
        data = np.frombuffer(text, np.uint8)
        back, chosen = array("H", bytes(2 * (n + 1))), array("i", bytes(4 * (n + 1)))
        cost, low = self.cost.tolist(), float("-inf")
        reach = self.deepest + 4
        best = [0.0]
        for lo in range(0, n, BLOCK):
            hi = min(lo + BLOCK, n)
            part = data[lo : min(hi + reach, n)]
            pos = np.flatnonzero((part[: hi - lo] & 0xC0) != 0x80).astype(np.int32)
            at, length, piece = self._walk(part, pos, np.full(len(pos), len(part), np.int32))
            order = np.argsort(at, kind="stable")
            best += [low] * (len(part) + reach - len(best))
            for p, m, i in zip(at[order].tolist(), length[order].tolist(), piece[order].tolist(), strict=True):
                score = best[p] + cost[i]
                if score > best[p + m]:
                    best[p + m], back[lo + p + m], chosen[lo + p + m] = score, m, i
            best = best[hi - lo :]
        ids, lengths, end = [], [], n
        while end > 0:
            ids.append(chosen[end])
            lengths.append(back[end])
            end -= back[end]
        return self._spelt(text, ids[::-1], lengths[::-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (int32) of each text."""
        cut = [self.units.cut(t) if self.units.safe else ([" " + t] if t else []) for t in texts]
        new = list(set().union(*cut).difference(self.known)) if cut else []
        if len(self.known) + len(new) > KNOWN_UNITS:
            self.known.clear()
            new = list(set().union(*cut))
        self.known.update(zip(new, self.viterbi([u.replace(" ", MARK).encode() for u in new]), strict=True))
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, u)), np.int32) for u in cut]
        for u in [u for u in new if len(u) > LONG_UNIT]:
            del self.known[u]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """docs with n_pieces, n_byte_pieces, ids_sha256 (of the comma-joined ids), round_trip and, if asked, token_ids."""
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

    names = docs.columns
    trie = docs.sparkSession.sparkContext.broadcast(loaded(Pieces, path).trie)  # as large as the vocabulary, not the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(Pieces, path, trie)
        low, high = pieces.byte_id.min(), pieces.byte_id.max()
        for batch in batches:
            column = batch.column(names.index("text"))
            for a, b in groups(column, GROUP_BYTES):
                part = column.slice(a, b - a).to_pylist()
                ids = pieces.encode([t or "" for t in part])
                cols = [batch.column(k).slice(a, b - a) for k in range(len(names))]
                made = [
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([int(((x >= low) & (x <= high)).sum()) if pieces.fallback else 0 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(pieces.names.__getitem__, x.tolist())).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([pieces.decode(x) == (t or "") for x, t in zip(ids, part, strict=True)], pa.bool_()),
                ]
                if with_ids:
                    ends = np.cumsum([0, *(len(x) for x in ids)])
                    made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if len(ids) else np.zeros(0, np.int32))))
                yield pa.RecordBatch.from_arrays(cols + made, names + added)

    kinds = {"n_pieces": LongType(), "n_byte_pieces": LongType(), "ids_sha256": StringType(), "round_trip": BooleanType()} | ({"token_ids": ArrayType(IntegerType())} if with_ids else {})
    added = unused(names, *kinds)
    fields = [StructField(name, kind) for name, kind in zip(added, kinds.values(), strict=True)]
    return docs.mapInArrow(frugal(run), StructType([*docs.schema.fields, *fields]))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, model_path()).drop("text")
