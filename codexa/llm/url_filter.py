"""URL filters (operator 9). DataFrame functions only.

Method. A rule is a host and a path prefix; its expression is hashed with SHA-256, and all rules whose digests begin with the same 32 bits form one row of candidates. A URL is expanded
into its host suffixes of the depths that rules have, combined with its path prefixes of the lengths that rules of that host have. The expressions meet the candidates by an equi-join on
the 32 bits; the full digest then confirms a candidate, and of those left the longest rule wins (of equal length: allow before block, then host, then path).

A page is judged as a row of its own, so a URL that stands on many pages is no key of any shuffle. Lengths and candidates are broadcast if there are few of them; otherwise the
joins are salted, so that the host `com` is not one task.

Defined cases. Null URL or one without '://': empty host and path, verdict `default`. Repeated rows each get the verdict. Rules
with a null field are ignored; equal rules count once. A host of any number of labels is cut only at the depths of rules. Empty tables give no rows. A path never includes '?' or '#'.
Further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import met, stage, table

#: The rules of the query (verdict, host, path).
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
#: Pairs of host and path length, and rows of candidates (under 300 bytes each), are broadcast up to these numbers.
MAX_LENGTHS, MAX_RULES = 100_000, 100_000


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**30))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return _ascii_lower(host), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _prefix(digest: Column) -> Column:
    """The first 32 bits."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def prepare_rules(rules: DataFrame) -> DataFrame:
    """rules(verdict, host, path), each expression once, allow before block: r_host, r_path, rule, verdict, digest."""
    r = rules.where("verdict is not null and host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    return r.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.concat("host", "path").alias("rule"), "verdict", _digest(F.col("host"), F.col("path")).alias("digest"))


def candidates(ready: DataFrame) -> DataFrame:
    """prefix, rules: one row for each 32 bits, with the rules whose digests begin so."""
    rank = F.struct(F.length("rule").alias("length"), (F.col("verdict") == "allow").alias("allow"), "r_host", "r_path").alias("rank")
    return ready.groupBy(_prefix(F.col("digest")).alias("prefix")).agg(F.collect_list(F.struct("digest", rank, "rule", "verdict")).alias("rules"))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict."""
    ready = stage(prepare_rules(rules), "rules")
    labels = lambda h: F.length(h) - F.length(F.replace(h, F.lit("."), F.lit(""))) + 1
    depths = sorted(r.n for r in ready.select(labels(F.col("r_host")).alias("n")).distinct().collect())  # host names have 127 labels at most
    lengths = stage(ready.select(F.col("r_host").alias("h"), F.length("r_path").alias("n")).distinct(), "lengths")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    suffixes = F.filter(F.array(*[F.when(labels(F.col("host")) >= k, F.substring_index("host", ".", -k)) for k in depths]).cast("array<string>"), lambda x: x.isNotNull())
    cut = rows.select("*", F.explode_outer(suffixes).alias("h"))
    cut = met(cut, lengths, ["h"], MAX_LENGTHS, ["row"], "left")
    digest = F.when(F.col("n") <= F.length("path"), _digest(F.col("h"), F.substring(F.col("path"), F.lit(1), F.col("n"))))
    cut = cut.select("page_id", "host", "path", "row", digest.alias("digest")).withColumn("prefix", _prefix(F.col("digest")))
    hits = met(cut, stage(candidates(ready), "candidates"), ["prefix"], MAX_RULES, ["row", "digest"], "left")
    confirmed = F.filter("rules", lambda r: r["digest"] == F.col("digest"))
    best = F.array_max(F.transform(confirmed, lambda r: F.struct(r["rank"].alias("rank"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    out = hits.withColumn("best", best).groupBy("row").agg(*[F.any_value(c).alias(c) for c in ("page_id", "host", "path")], F.max("best").alias("best"))
    return out.select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


ORACLE_SQL = """
with u as (select page_id, url, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(verdict, rh, rp) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best as (select page_id, host, path, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(verdict, length(rh || rp)) as verdict
         from h join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by all)
select h.page_id, h.host, h.path, best.rule, coalesce(best.verdict, 'allow') as verdict
from h left join best on h.page_id = best.page_id and h.host = best.host and h.path = best.path
"""
