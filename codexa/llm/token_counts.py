"""Token counts (operator 8): batch encoding in Arrow functions that return lengths only.

Method. Texts arrive in Arrow batches and are handled in groups of about equal bytes. Each text is cut at safe boundaries into units: before a run of
white-space markers, and around line feeds, where the vocabulary has no piece that crosses. Boundaries are proven
from the vocabulary when the model is loaded; a model that allows none is applied to whole texts. The distinct units of
a group that are not yet known are encoded in one library call, and only lengths are kept, in a bounded table.

Defined cases. Null text counts as empty: no bytes, no tokens. A very long text is cut like any other; a unit without a boundary is encoded whole.
Repeated rows are counted alike. Empty table: no rows. Further columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from .common import table

MODEL, LIMIT = "piece_bpe_32k.model", 4096
GROUP_BYTES, KNOWN_UNITS, LONG_UNIT = 4 << 20, 300_000, 64
MARK = "▁"

_loaded: dict[str, object] = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Units:
    """Cuts texts into units that a SentencePiece model encodes one by one as it would encode the whole text."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        normal = [p.piece for p in proto.pieces if p.type in (1, 4)]  # normal and user-defined
        self.safe = plain and norm.add_dummy_prefix and not any(re.search(f"[^{MARK}]{MARK}", p) for p in normal) and not any(p.type == 4 for p in proto.pieces)
        feed = "\n" if not any("\n" in p for p in normal) else ""
        self.pattern = re.compile(f"{feed}| *[^ {feed}]+| +" if feed else " *[^ ]+| +")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        norm.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.proto = proto

    def cut(self, text: str) -> list[str]:
        """Units of a text, the first with the marker that the library puts in front."""
        return self.pattern.findall(" " + text.replace(MARK, " ")) if text else []


class Counter:
    def __init__(self, path: str):
        self.units, self.known = Units(path), {}

    def count(self, texts: list[str]) -> list[int]:
        if not self.units.safe:
            return [len(x) for x in self.units.whole.encode(texts, num_threads=1)]
        cut = [self.units.cut(t) for t in texts]
        new = list(set().union(*cut).difference(self.known)) if cut else []
        if len(self.known) + len(new) > KNOWN_UNITS:
            self.known.clear()
            new = list(set().union(*cut))
        self.known.update(zip(new, map(len, self.units.bare.encode(new, num_threads=1)), strict=True))
        out = [sum(map(self.known.__getitem__, u)) for u in cut]
        for u in [u for u in new if len(u) > LONG_UNIT]:
            del self.known[u]
        return out


def groups(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each, one text at least."""
    start = size = 0
    sizes = pa.compute.binary_length(texts).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if len(sizes) > start:
        yield start, len(sizes)


def loaded(kind, path: str, shared=None):
    """One model for each Python worker; shared: a broadcast part of it."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path, shared.value) if shared else kind(path)
    return _loaded[kind, path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(Counter, path)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, b in groups(column):
                part = column.slice(a, b - a).fill_null("").to_pylist()
                n = counter.count(part)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(t.encode()) for t in part], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), model_path())
