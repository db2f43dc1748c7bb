"""The thirteen descriptive metrics. Every result carries its denominator; small samples give NULL aggregates, never absent rows; people are never ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.functions.text import percent
from codexa.numbering import places, positions

PCT_FLOOR, AGG_FLOOR, SUBSET_FLOOR = 20, 5, 10


def _floored(agg: Column, n: Column, floor: int) -> Column:
    return F.when(n >= floor, agg)


def median_iqr(df: DataFrame, value: str, floor: int = AGG_FLOOR) -> DataFrame:
    n, q = F.count(value), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(n.alias("denominator"), _floored(q[1], n, floor).alias("median"), _floored(q[0], n, floor).alias("q1"), _floored(q[2], n, floor).alias("q3"), (n < floor).alias("suppressed"))


def strata_counts(people: DataFrame) -> DataFrame:
    return people.agg(F.count("*").alias("denominator"), *[F.count_if(F.col("stratum") == s).alias(f"n_{s.lower()}") for s in "ABCD"])


def first_author_slots(papers: DataFrame, lead: DataFrame) -> DataFrame:
    """papers(pmid) eligible for the count; lead(pmid, stratum). One row of counts and floored percentages."""
    j = papers.join(lead, "pmid", "left").withColumn("stratum", F.coalesce("stratum", F.lit("unclassified")))
    n = F.count("*")
    names = ["A", "B", "C", "D", "unclassified"]
    k = {s: F.count_if(F.col("stratum") == s) for s in names}
    return j.agg(n.alias("denominator"), *[k[s].alias(f"n_{s.lower()}") for s in names], *[percent(k[s], n).alias(f"pct_{s.lower()}") for s in names], (n < AGG_FLOOR).alias("suppressed"))


def lead_slot_partition(people: DataFrame, end: Column, lag: int = 3) -> DataFrame:
    """bucket, n over the people of strata A and B, zero rows included."""
    bucket = F.when(F.col("n_first_slots") >= 1, "holds_lead").when(end - F.col("first_year") >= lag, "observed_without_lead").otherwise("too_recent")
    one = people.where(F.col("stratum").isin("A", "B")).withColumn("bucket", bucket).agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("holds_lead", "observed_without_lead", "too_recent")])
    return one.select(F.inline(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n")) for b in one.columns])))


def time_to_lead(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lag, n) distribution and the one-row summary, over stratum A."""
    lags = people.where("stratum = 'A'").withColumn("lag", F.greatest(F.lit(0), F.col("first_lead_year") - F.col("first_year")))
    n = F.count("*")
    return lags.groupBy("lag").agg(n.alias("n")), lags.agg(n.alias("denominator"), F.count_if(F.col("lag") == 0).alias("at_zero"), _floored(F.percentile("lag", 0.5), n, AGG_FLOOR).alias("median"))


def censor_bucket() -> Column:
    left, right = F.col("left_censored"), F.col("right_censored")
    return F.when(left & right, "both_censored").when(left, "left_censored").when(right, "right_censored").otherwise("complete")


def activity_span(people: DataFrame) -> DataFrame:
    p = people.where(F.col("stratum").isin("A", "B")).withColumn("bucket", censor_bucket())
    whole = F.when(F.col("bucket") == "complete", F.col("span_years"))
    n, q = F.count(whole), F.percentile(whole, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    buckets = ["complete", "left_censored", "right_censored", "both_censored"]
    return p.agg(
        F.count("*").alias("cohort_denominator"), n.alias("denominator"), *[F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in buckets],
        F.count_if((F.col("span_years") == 0) & (F.col("n_appearances") > 1)).alias("same_year"),
        _floored(q[1], n, AGG_FLOOR).alias("median"), _floored(q[0], n, AGG_FLOOR).alias("q1"), _floored(q[2], n, AGG_FLOOR).alias("q3"),
    )


def year_spine(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.sparkSession.range(start, max(start, end) + 1).select(F.col("id").cast("int").alias("year"))


def roster_turnover(people: DataFrame, start: int, end: int) -> DataFrame:
    """year, active, arrivals, departures, departures_right_censored for every year of the window; all strata."""
    kinds = ["active", "arrivals", "departures"]
    mark = lambda year, kind: F.struct(year.cast("int").alias("year"), F.lit(kind).alias("kind"))
    marks = F.concat(F.transform("years", lambda y: mark(y, kinds[0])), F.array(mark(F.col("first_year"), kinds[1]), mark(F.col("last_year"), kinds[2])))
    per = people.select(F.inline(marks)).groupBy("year").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    out = year_spine(people, start, end).join(per, "year", "left").na.fill(0, kinds)
    return out.select("year", *kinds, (F.col("year") >= end - 1).alias("departures_right_censored"))


def pi_byline_positions(papers: DataFrame, filtered: bool = False) -> DataFrame:
    """papers(pmid, pi_person_index, n_persons, any_email, pi_corresponding) -> one row; nothing measured if papers were chosen by position."""
    i, n = F.col("pi_person_index"), F.col("n_persons")
    place = F.when(i.isNull(), "unlocated").when(n == 1, "sole").when(i == 0, "first").when(i == n - 1, "last").otherwise("middle")
    names, total = ["first", "last", "sole", "middle", "unlocated"], F.count("*")
    p = papers.withColumn("place", place)
    k = {s: F.lit(None).cast("long") if filtered else F.count_if(F.col("place") == s) for s in names}
    mail = F.count_if(F.col("any_email"))
    return p.agg(
        total.alias("denominator"), *[k[s].alias(f"n_{s}") for s in names], *[percent(k[s], total).alias(f"pct_{s}") for s in names], mail.alias("email_papers"),
        F.when(mail > 0, F.count_if(F.col("any_email") & F.col("pi_corresponding"))).alias("corresponding"), (total < AGG_FLOOR).alias("suppressed"),
    )


def equal_contrib_occurrences(bylines: DataFrame) -> DataFrame:
    """bylines(pmid, person_idx, n_persons, equal_contrib) -> pmid, group_size, category of the papers with flagged people."""
    g = bylines.where("equal_contrib and person_idx is not null").groupBy("pmid").agg(F.count("*").alias("group_size"), F.bool_or(F.col("person_idx") == 0).alias("f"), F.bool_or(F.col("person_idx") == F.col("n_persons") - 1).alias("l"))
    kind = F.when(F.col("f") & F.col("l"), "shared_first_and_senior").when(F.col("f"), "first").when(F.col("l"), "senior").otherwise("other")
    return g.select("pmid", "group_size", kind.alias("category"))


def records_per_year(records: DataFrame, start: int, end: int) -> DataFrame:
    """records(year): kept and records-only together; dense years, edges partial, the last two years lag the index. denominator counts all records."""
    n = records.groupBy("year").agg(F.count("*").alias("n"))
    total = records.agg(F.count("*").alias("denominator"))
    out = year_spine(records, start, end).join(n, "year", "left").join(F.broadcast(total))  # one row
    return out.select("year", F.coalesce("n", F.lit(0)).alias("n"), F.col("year").isin(start, end).alias("partial"), (F.col("year") >= end - 1).alias("indexing_lag"), "denominator")


def team_size(papers: DataFrame, large: int = 20, floor: int = AGG_FLOOR) -> DataFrame:
    """papers(pmid, n_persons)."""
    n, q, v = F.count("*"), F.percentile("n_persons", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))), F.col("n_persons")
    return papers.agg(n.alias("denominator"), _floored(q[1], n, floor).alias("median"), _floored(q[0], n, floor).alias("q1"), _floored(q[2], n, floor).alias("q3"), F.min(v).alias("least"), F.max(v).alias("most"), F.count_if(v >= large).alias("n_large"))


def large_teams(papers: DataFrame, large: int = 20) -> DataFrame:
    """pmid, n_persons of the papers with `large` people or more."""
    return papers.where(F.col("n_persons") >= large).select("pmid", "n_persons")


def team_size_subset(papers: DataFrame, lead: DataFrame, large: int = 20) -> DataFrame:
    led = papers.join(lead.where(F.col("stratum").isin("A", "B")).select("pmid"), "pmid", "left_semi")
    return team_size(led, large, SUBSET_FLOOR).select("denominator", "median")


def team_size_histogram(papers: DataFrame, lead: DataFrame) -> DataFrame:
    led = lead.where(F.col("stratum").isin("A", "B")).select("pmid").distinct().withColumn("led", F.lit(True))
    return papers.join(led, "pmid", "left").groupBy("n_persons").agg(F.count("*").alias("n"), F.count_if(F.coalesce("led", F.lit(False))).alias("n_subset"))


def venue_repetition(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(journal, n) of repeated venues and the one-row counts of singletons and missing names; exact trimmed strings."""
    v = papers.select(F.trim("journal").alias("journal"))
    g = v.where("journal <> ''").groupBy("journal").agg(F.count("*").alias("n"))
    missing = v.agg(F.count("*").alias("denominator"), F.count_if(F.coalesce(F.col("journal"), F.lit("")) == "").alias("missing"))
    return g.where("n >= 2"), g.agg(F.count_if(F.col("n") == 1).alias("singletons")).join(F.broadcast(missing))


def affiliation_strings(entries: DataFrame, least: int = 3) -> DataFrame:
    """entries(pmid, affiliation) -> affiliation, n_papers of the exact strings on `least` papers or more."""
    e = entries.select("pmid", F.trim("affiliation").alias("affiliation")).where("affiliation <> ''")
    return e.groupBy("affiliation").agg(F.count_distinct("pmid").alias("n_papers")).where(F.col("n_papers") >= least)


def affiliation_coverage(entries: DataFrame, start: int, end: int) -> DataFrame:
    """entries(year, affiliation) -> year, covered, total; dense over the window and any year outside that has entries."""
    g = entries.groupBy("year").agg(F.count_if(F.trim("affiliation") != "").alias("covered"), F.count("*").alias("total"))
    return year_spine(entries, start, end).join(g, "year", "full").select("year", F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("total", F.lit(0)).alias("total"))


def titles_by_year(papers: DataFrame) -> DataFrame:
    """papers(year, pmid, title) -> year, titles sorted by pmid as text."""
    return papers.groupBy("year").agg(F.array_sort(F.collect_list(F.struct(F.col("pmid").cast("string").alias("pmid"), "title"))).alias("titles"))


def titles_in_order(papers: DataFrame) -> DataFrame:
    """papers(year, pmid, title) -> year, place, pmid, title: the titles of a year by pmid as text, place from 0. For years of any size."""
    rows = papers.select("year", F.col("pmid").cast("string").alias("pmid"), "title")
    return places(rows, "year", "pmid", "title").select("year", "place", "pmid", "title")


def tallest_stack(points: DataFrame, value: str) -> DataFrame:
    """One row: the most points that share a value, 0 without points."""
    return points.groupBy(value).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("tallest"))


def stack_positions(points: DataFrame, value: str, name: str) -> DataFrame:
    """Place of each point in the stack of its value, by name. For stacks of any size."""
    return places(points, value, name).withColumn("place", F.col("place").cast("int"))


def lag_rows(people: DataFrame, end: Column, lag: int = 3) -> DataFrame:
    """name, row, value: years from the first record to the first lead slot (lead), or observed so far (waiting, too_recent), of strata A and B; ordered by value and name, never by a count."""
    seen = end - F.col("first_year")
    row = F.when(F.col("n_first_slots") >= 1, "lead").when(seen >= lag, "waiting").otherwise("too_recent")
    value = F.when(F.col("n_first_slots") >= 1, F.greatest(F.lit(0), F.col("first_lead_year") - F.col("first_year"))).otherwise(seen)
    return people.where(F.col("stratum").isin("A", "B")).select("name", row.alias("row"), value.alias("value"))


def span_lanes(people: DataFrame) -> DataFrame:
    """name, lane, span, place in the lane by span and name, of strata A and B."""
    ab = people.where(F.col("stratum").isin("A", "B")).select("name", censor_bucket().alias("lane"), F.col("span_years").alias("span"))
    return stack_positions(ab.withColumn("cell", F.struct("lane", "span")), "cell", "name").drop("cell")


def censor_text(left: Column, right: Column) -> Column:
    """Which edges of the window a span touches, in words."""
    sides = F.array_compact(F.array(F.when(left, "left"), F.when(right, "right")))
    return F.when(F.size(sides) > 0, F.array_join(sides, ", ")).otherwise("none")


def timeline_labels(people: DataFrame) -> DataFrame:
    """place, name, first and last year, censoring in words, of the people of strata A and B, by first record and name."""
    ab = people.where(F.col("stratum").isin("A", "B")).select("first_date", "name", "first_year", "last_year", censor_text(F.col("left_censored"), F.col("right_censored")).alias("censoring"))
    return positions(ab, "first_date", "name", name="place").drop("first_date")


def first_year_strip(people: DataFrame) -> DataFrame:
    """first_year, n of the people of stratum C, who have no row of their own in the timeline."""
    return people.where("stratum = 'C'").groupBy("first_year").agg(F.count("*").alias("n"))


def timeline_rows(people: DataFrame) -> DataFrame:
    """Year marks of the people of strata A and B: lead where they led, plain elsewhere."""
    ab = people.where(F.col("stratum").isin("A", "B"))
    both = F.array_distinct(F.concat("years", "lead_years"))
    return ab.select("first_date", "name", F.explode(both).alias("year"), "lead_years").select("first_date", "name", "year", F.array_contains("lead_years", F.col("year")).alias("lead"))
