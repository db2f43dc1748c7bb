"""Writers: CSV, JSON lists and envelopes, author records, matrices. Files go where the caller's path points, by Spark's writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.numbering import positions


def papers_csv(papers: DataFrame, path: str) -> None:
    """CSV with a header and a byte order mark, so that spreadsheets read it as UTF-8; nested columns become JSON text, none is left out."""
    nested = {c for c, t in papers.dtypes if t.startswith(("array", "struct", "map"))}
    cells = [F.to_json(c) if c in nested else F.col(c) for c in papers.columns]
    names = [f"\ufeff{c}" if not i else c for i, c in enumerate(papers.columns)]
    papers.select(*[x.alias(n) for x, n in zip(cells, names, strict=True)]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def papers_json(papers: DataFrame, path: str) -> None:
    """JSON lines, one paper each: the distributed form of a list."""
    papers.write.mode("overwrite").json(path)


def json_list(papers: DataFrame, path: str, *order, search: dict | None = None, generated_at: str = "", more: dict | None = None) -> None:
    """One JSON document in a folder of its own: a list of the papers in order, or with `search` an envelope {schema_version, generated_at, search, papers}, `more` being further fields of it.

    The document stands in part files, one record on a line; their contents in the order of their names are the document. Each is written by a task of its own.
    """
    head, tail = "[", "]"
    if search is not None:
        head, tail = json.dumps({"schema_version": 1, "generated_at": generated_at, "search": search, **(more or {})}, ensure_ascii=False)[:-1] + ', "papers": [', "]}"
    lines = positions(papers, *order, name="_place").select("_place", F.concat(F.when(F.col("_place") > 0, ",").otherwise(""), F.to_json(F.struct(*papers.columns))).alias("value"))
    frame = papers.sparkSession.createDataFrame([(-1, head), (2**62, tail)], "_place long, value string")
    lines.unionByName(frame).repartitionByRange("_place").sortWithinPartitions("_place").select("value").write.mode("overwrite").text(path)


def verify_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
