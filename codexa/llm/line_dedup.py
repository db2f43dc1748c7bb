"""Cross-site line removal by distinct-site spread (operator 3).

Method. Lines (split at \\n, trimmed, not blank) are hashed; a HyperLogLog sketch of the sites is kept for each hash and
sketches merge by aggregation. A line whose estimate clears `min_sites` by more than the sketch's error is boilerplate, one
below by more is not; for lines within the error band the sites are counted exactly. All occurrences of boilerplate lines leave
the texts; other lines stay as they are, byte by byte.

Defined cases. Null text: stays null, no lines. A null site counts as one site. Empty and very long texts are handled whole. Repeated rows are cleaned
alike. Empty table: no rows. A text of which all lines go becomes empty. Further columns are kept; n_chars, if present, is set anew; a made column whose name is
taken gets underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, stage, table, unused

MIN_SITES, LG_K = 10, 12


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), site and the hash of each distinct line of a text."""
    site = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    hashes = F.array_distinct(F.transform(F.filter(F.transform(F.split("text", "\n", -1), _trim), lambda x: x != ""), lambda x: F.xxhash64(x)))
    return docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), site.alias("site"), F.explode(hashes).alias("lh"))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes lh of the lines that stand on min_sites sites or more; staged."""
    lines = _lines(docs).select("lh", "site")
    est = lines.groupBy("lh").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("s")).select("lh", F.hll_sketch_estimate("s").alias("n"))
    margin = 1 + int(min_sites * 4 * 1.04 / (1 << LG_K) ** 0.5)  # four standard errors
    likely = stage(est.where(F.col("n") >= min_sites - margin), "spread")
    near = likely.where(F.col("n") <= min_sites + margin).select("lh")
    exact = lines.join(near, "lh", "left_semi").groupBy("lh").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites)
    return stage(likely.where(F.col("n") > min_sites + margin).select("lh").union(exact.select("lh")), "boilerplate")


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with cleaned texts: columns as before, then n_lines and n_removed."""
    core = docs.select("doc_id", "text", "source")
    lines, removed, own, hit_id, hit_th, bad, clean = unused(docs.columns, "n_lines", "n_removed", "_th", "_hit_id", "_hit_th", "_bad", "_clean")
    hit = _lines(core).select("doc_id", "th", "lh").join(spread_lines(core, min_sites), "lh", "left_semi")
    hit = stage(hit.groupBy(F.col("doc_id").alias(hit_id), F.col("th").alias(hit_th)).agg(F.collect_set("lh").alias(bad)), "hits")
    # ids are compared null-safe; a merge join at every size, as the documents that hold a common line grow with the corpus
    out = docs.withColumn(own, F.xxhash64("text")).join(hit.hint("merge"), (F.col(own) == F.col(hit_th)) & F.col("doc_id").eqNullSafe(F.col(hit_id)), "left")
    split = F.split("text", "\n", -1)
    kept = F.filter(split, lambda x: ~((_trim(x) != "") & F.array_contains(F.col(bad), F.xxhash64(_trim(x)))))
    out = out.withColumns({
        clean: F.when(F.col(bad).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        lines: F.coalesce(F.size(split), F.lit(0)).cast("long"),
        removed: F.when(F.col(bad).isNull(), 0).otherwise(F.size(split) - F.size(kept)).cast("long"),
    })
    cols = [F.col(clean).alias("text") if c == "text" else F.length(clean).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*cols, lines, removed)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


_TRIMMED = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
ORACLE_SQL = f"""
with l as (select doc_id, coalesce('=' || source, '') as site, unnest(string_split(text, chr(10))) as x from documents),
bad as (select {_TRIMMED} as b from l where {_TRIMMED} <> '' group by 1 having count(distinct site) >= {MIN_SITES}),
o as (select row_number() over () as r, doc_id, text, string_split(text, chr(10)) as ls from documents),
e as (select r, unnest(ls) as x, unnest(range(len(ls))) as i from o),
k as (select r, i, x, {_TRIMMED} in (select b from bad) as gone from e),
a as (select r, coalesce(string_agg(x, chr(10) order by i) filter (where not gone), '') as t, count(*) as n, count(*) filter (where gone) as g from k group by r)
select doc_id, coalesce(n, 0)::bigint as n_lines, coalesce(g, 0)::bigint as n_removed, length(case when text is null then null else t end)::bigint as n_chars_left, md5(case when text is null then null else t end) as text_md5
from o left join a using (r)
"""
