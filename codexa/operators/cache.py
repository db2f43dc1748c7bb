"""The download cache as a table keyed by pmid: upsert, lookup, statistics, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILED, DONE = "all_sources_failed", "downloaded"


def upsert(log: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """State after all updates in order: for each column the last value that is not NULL. Aggregates, so map-side combined and safe on hot keys."""
    seq = F.struct(*order)
    return log.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(c) for c in values])


def lookup(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """keys(pmid) with hit: downloaded and with a path; a downloaded entry without a path goes back to pending."""
    hit = (F.col("status") == DONE) & (F.coalesce("pdf_path", F.lit("")) != "")
    j = keys.join(cache, "pmid", "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    return j.withColumn("status", F.when((F.col("status") == DONE) & ~F.col("hit"), "pending").otherwise(F.col("status")))


def lookup_counts(found: DataFrame) -> DataFrame:
    """One row: the hits and misses of a lookup."""
    return found.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def expired(now: Column | float, days: float = 90) -> Column:
    return (F.col("status") == FAILED) & (F.col("updated_at") < F.lit(now) - days * 86400)


def cleanup(cache: DataFrame, now: float, days: float = 90) -> tuple[DataFrame, DataFrame]:
    """Rows that stay and a one-row count of those removed; downloads never expire."""
    gone = F.coalesce(expired(now, days), F.lit(False))
    return cache.where(~gone), cache.agg(F.count_if(gone).alias("removed"))


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("total"), F.count_if(F.col("status") == DONE).alias("downloaded"), F.count_if(F.col("status") == FAILED).alias("failed"))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """candidates(pmid, rank, source, content): the first valid PDF of each paper by source rank."""
    valid = (F.octet_length("content") >= 1000) & (F.substring("content", 1, 5) == F.lit(b"%PDF-"))
    return candidates.where(valid).groupBy("pmid").agg(F.min_by("source", "rank").alias("source"))


def tallies(results: DataFrame) -> DataFrame:
    """results(status, from_cache) of one run -> downloaded, failed, cached, total; what the cache had is not downloaded again."""
    done, cached = F.col("status") == DONE, F.col("from_cache")
    return results.agg(F.count_if(done & ~cached).alias("downloaded"), F.count_if(~done).alias("failed"), F.count_if(done & cached).alias("cached"), F.count("*").alias("total"))
