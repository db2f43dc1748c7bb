"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, decontamination, SentencePiece coding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes every stage's rows as Parquet into the folder of spark.checkpoint.dir and reads them
again. All stages but the last return the columns of documents.

Defined cases, of every stage: an empty table gives no rows; rows of null or repeated ids are judged one by one; further columns come through unchanged, also by names that the stages use inside.
Quality rules: null, empty and short texts go, equal rows are judged alike. Line dedup: a text of which all lines go becomes empty, n_chars follows. Jaccard join: ties between copies are
settled by the least id (null last), then the hash of the text; rows without words stay. Decontamination: texts without words stay, no benchmark leaves all. SentencePiece: null gives no
pieces; made columns whose names are taken get underscores. Very long texts are handled whole in all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codexa.llm.common import stage, table
from codexa.llm.decontaminate import drop_contaminated
from codexa.llm.jaccard_join import keep_one
from codexa.llm.line_dedup import line_dedup
from codexa.llm.quality import keep_good
from codexa.llm.sentence_pieces import encode_decode
from codexa.llm.token_counts import model_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the fences of their group; the others go."""
    return keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites."""
    return line_dedup(docs).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group of near duplicates (five words, similarity 0.8)."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their pieces."""
    return encode_decode(docs, model_path(), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentence_pieces", sentence_pieces),
]
#: SQL has no Viterbi search over a vocabulary; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
