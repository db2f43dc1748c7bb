"""JSON documents of one list, laid out with whole records on each line, read by as many tasks as they have blocks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.numbering import positions
from codexa.staging import drop, stage

#: Characters in which the first two lines must end. Where lines are longer, the file is left to Spark's parser, which reads it token by token.
HORIZON = 1 << 22
_PLACE = ["path", "block", "place"]


def _beginnings(spark: SparkSession, path: str, pattern: str, horizon: int = HORIZON) -> Iterator[str]:
    """What the pattern finds at the beginning of each file, in the order of their paths; at most `horizon` characters of a file are looked at."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = []
    for status in fs.globStatus(at) or []:
        files += [s for s in fs.listStatus(status.getPath()) if s.isFile() and s.getPath().getName()[0] not in "_."] if status.isDirectory() else [status]
    for status in sorted(files, key=lambda s: s.getPath().toString()):
        stream = fs.open(status.getPath())
        try:
            yield jvm.java.util.Scanner(stream, "UTF-8").findWithinHorizon(pattern, horizon) or ""
        finally:
            stream.close()


def is_list(spark: SparkSession, path: str) -> bool:
    """Whether a file opens with a bracket."""
    return any(b.endswith("[") for b in _beginnings(spark, path, "\\A\ufeff?\\s*\\S"))


def in_lines(spark: SparkSession, path: str, record: str, boxes: tuple[str, ...] = (), more: str = "", ordered: bool = True) -> tuple[DataFrame, DataFrame | None] | None:
    """(rows of the record's fields with ord, the fields of the envelope) of one document, or None where this cannot read it.

    The document is one list of objects, bare or under the first of `boxes` that an envelope has. Its files, in the order of their paths, are a head up to the opening bracket, lines of whole
    records with a comma between two, and a tail from the closing bracket. All of this is checked: each line must parse as records alone, and head and tail as a document around a
    mark. Any other layout is left to the caller.
    """
    if not next(_beginnings(spark, path, "\\A[^\\r\\n]*\\[[ \\t]*[\\r\\n]+[^\\r\\n]*[\\r\\n]"), ""):
        return None
    end = uuid.uuid4().hex
    fields = [f.strip() for f in _top(record)]
    inner = ", ".join(f.replace(" ", ": ", 1) for f in fields)
    value = F.regexp_replace("value", "^[\\s\ufeff]+|\\s+$", "")
    text = spark.read.text(path).select(value.alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    # within a list of their own, records that close it early or leave it open show up beside the mark
    core = F.regexp_replace("value", "^,\\s*|\\s*,$", "")
    x = F.from_json(F.concat(F.lit("[["), core, F.lit(f'],[{{"_end":"{end}"}}]]')), f"array<array<struct<{inner}, _end: string>>>")
    parsed = text.where("value <> ''").select(*_PLACE, "value", F.startswith("value", F.lit(",")).alias("lead"), F.endswith("value", F.lit(",")).alias("trail"), F.startswith(core, F.lit("{")).alias("opens"), x.alias("x"))
    marked = F.coalesce(F.get(F.get("x", 1), 0)["_end"] == end, F.lit(False))
    whole = F.col("opens") & F.coalesce(F.size("x") == 2, F.lit(False)) & marked & F.forall(F.get("x", 0), lambda r: r.isNotNull() & r["_end"].isNull())
    good = F.coalesce(whole, F.lit(False))
    held = stage(parsed.select(*_PLACE, "lead", "trail", F.when(good, F.get("x", 0)).alias("r"), F.when(~good, F.left("value", F.lit(HORIZON))).alias("other")), "document")
    other = held.where("other is not null").select(*_PLACE, "other").orderBy(*_PLACE).limit(3).collect()  # the head and the tail
    place = F.struct(*_PLACE)
    n = held.where("other is null").agg(
        F.count("*").alias("n"), F.count_if("lead").alias("lead"), F.count_if("trail").alias("trail"), F.coalesce(F.min_by("lead", place), F.lit(False)).alias("first"), F.coalesce(F.max_by("trail", place), F.lit(False)).alias("last"), F.min(place).alias("low"), F.max(place).alias("high"),
    ).first()
    between = max(0, n.n - 1)
    commas = (n.lead, n.trail, n.first) == (between, 0, False) or (n.lead, n.trail, n["last"]) == (0, between, False)
    about = None
    fits = len(other) == 2 and commas and (not n.n or (tuple(other[0][:3]) < tuple(n.low) and tuple(n.high) < tuple(other[1][:3])))
    if fits and (other[0].other, other[1].other) != ("[", "]"):
        fits = bool(boxes) and other[0].other.startswith("{")
        if fits:
            mark = json.dumps({fields[0].split()[0]: end})
            lists = ", ".join(f"{b} array<struct<{inner}>>" for b in boxes)
            about = spark.createDataFrame([(other[0].other + mark + other[1].other,)], "value string").select(F.from_json("value", f"{lists}, {more}, _broken string" if more else f"{lists}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("a")).select("a.*")
            got = about.select(F.coalesce(*boxes).alias("b"), "_broken").first()
            fits = got._broken is None and got.b is not None and len(got.b) == 1 and got.b[0] is not None and got.b[0][0] == end
            about = about.drop(*boxes, "_broken")
    if not fits:
        drop(held)
        return None
    rows = held.where("other is null").select(*_PLACE, F.posexplode("r").alias("at", "r"))
    names = [f.split()[0] for f in fields]
    if not ordered:
        return rows.select(*[F.col(f"r.{f}") for f in names]), about
    numbered = positions(rows, *_PLACE, "at", name="ord")
    return numbered.select("ord", *[F.col(f"r.{f}") for f in names]), about


def _top(ddl: str) -> list[str]:
    """The fields of a schema, cut at the commas outside brackets."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
