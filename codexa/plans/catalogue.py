"""Named queries over the driver tables, each with the SQL that must give the same rows.

The bibliographic view: a paper is an order, a byline entry a line item (position by line number, part, supplier), a person a (supplier, part) pair, a journal an
order priority, an affiliation the supplier's nation. Thresholds that these tables never reach (20, 50) are parameters and smaller here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codexa.functions import text as T
from codexa.operators import analyze, cache, identity, metrics, verify

START, END, LAG, PI_SUPPLIER = 1995, 2001, 3, 7
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("pmid"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_iso"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("journal"), "o_custkey", "o_totalprice", "o_orderstatus")


#: Line items that one task sorts, joins and aggregates at most, but for skew.
TASK_ROWS = 500_000


def tasks(spark, d) -> int:
    """Partitions for the line items: their number grows with the table, so that the memory of one task does not."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read(spark, d, "lineitem").count() // TASK_ROWS))


def lines(spark, d, *more):
    w = W.partitionBy("l_orderkey")
    pos = F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *more).repartition(tasks(spark, d), "l_orderkey")
    return li.select(F.col("l_orderkey").alias("pmid"), pos.alias("idx"), F.count("*").over(w).cast("int").alias("n_persons"), "l_suppkey", "l_partkey", *more)


def apps(spark, d):
    x = lines(spark, d).join(orders(spark, d).select("pmid", "date_iso", "year"), "pmid")
    return x.withColumns({"pid": F.concat_ws("-", "l_suppkey", "l_partkey"), "is_first": F.col("idx") == 0, "is_last": F.col("idx") == F.col("n_persons") - 1})


def roster(spark, d):
    return identity.people(apps(spark, d).repartition(tasks(spark, d), "pid"), "pid", F.lit(START), F.lit(END))


def lead(spark, d):
    a = apps(spark, d)
    return identity.lead_strata(a, roster(spark, d), "pid").repartition(tasks(spark, d), "pmid")


def pi(spark, d):
    tier = F.when(F.col("l_returnflag") == "R", "orcid").when(F.col("l_returnflag") == "A", "email").when(F.col("l_linestatus") == "F", "affiliation").otherwise("name_only")
    return identity.resolve_pi(lines(spark, d, "l_returnflag", "l_linestatus").where(F.col("l_suppkey") == PI_SUPPLIER).select("pmid", "idx", tier.alias("tier")))


_B = """b as (select l_orderkey as pmid, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as idx,
 count(*) over (partition by l_orderkey) as n, * from lineitem)"""
_A = _B + """, a as (select b.*, l_suppkey || '-' || l_partkey as pid, year(o_orderdate) as y, strftime(o_orderdate, '%Y-%m-%d') as d, idx = 0 as f, idx = n - 1 as l from b join orders on o_orderkey = pmid),
p as (select pid, count(*) as n, count(*) filter (where f) as nf, count(*) filter (where l) as nl, min(y) as y0, max(y) as y1, min(d) as d0, min(case when f then y end) as yf, min(case when l then y end) as yl,
 case when count(*) filter (where l) > 0 then 'D' when count(*) filter (where f) > 0 then 'A' when count(*) > 1 then 'B' else 'C' end as s from a group by pid)"""
_FOUND = f"""c as (select pmid, idx, case when l_returnflag = 'R' then 3 when l_returnflag = 'A' then 2 when l_linestatus = 'F' then 1 else 0 end as r from b where l_suppkey = {PI_SUPPLIER}),
m as (select pmid, max(r) as r from c group by 1),
pi as (select pmid, min(idx) as i, r, count(*) as k from c join m using (pmid, r) group by pmid, r)"""
_PI = f"{_B}, {_FOUND}"
_TIER = "case r when 3 then 'orcid' when 2 then 'email' when 1 then 'affiliation' else 'name_only' end"


@query(f"with {_B} select pmid, idx, l_suppkey, l_partkey, idx = 0 as is_first, idx = n - 1 as is_last from b")
def byline_positions(spark, d):
    return lines(spark, d).select("pmid", "idx", "l_suppkey", "l_partkey", (F.col("idx") == 0).alias("is_first"), (F.col("idx") == F.col("n_persons") - 1).alias("is_last"))


@query(f"with {_A} select pid, n as n_appearances, nf as n_first_slots, nl as n_last_slots, y0 as first_year, y1 as last_year, d0 as first_date, y1 - y0 as span_years, y0 <= {START} as left_censored, y1 >= {END - 1} as right_censored, s as stratum from p")
def person_roster(spark, d):
    return roster(spark, d).select("pid", "n_appearances", "n_first_slots", "n_last_slots", "first_year", "last_year", "first_date", "span_years", "left_censored", "right_censored", "stratum")


@query(f"with {_A} select count(*) as denominator, count(*) filter (where s = 'A') as n_a, count(*) filter (where s = 'B') as n_b, count(*) filter (where s = 'C') as n_c, count(*) filter (where s = 'D') as n_d from p")
def strata_counts(spark, d):
    return metrics.strata_counts(roster(spark, d))


_SLOT = ", ".join(f"count(*) filter (where s = '{s}') as n_{s.lower()}, case when count(*) >= 20 then round_even(100.0 * count(*) filter (where s = '{s}') / count(*), 0)::int end as pct_{s.lower()}" for s in ["A", "B", "C", "D", "unclassified"])


@query(f"with {_A}, q as (select o_orderkey, coalesce(s, 'unclassified') as s from orders left join (select pmid, s from a join p using (pid) where f) on pmid = o_orderkey) select count(*) as denominator, {_SLOT}, count(*) < 5 as suppressed from q")
def first_author_slots(spark, d):
    return metrics.first_author_slots(orders(spark, d).select("pmid").repartition(tasks(spark, d), "pmid"), lead(spark, d))


_PART = f"case when nf > 0 then 'holds_lead' when {END} - y0 >= {LAG} then 'observed_without_lead' else 'too_recent' end"


@query(f"with {_A}, q as (select {_PART} as bucket, count(*) as n from p where s in ('A', 'B') group by 1) select bucket, coalesce(n, 0) as n from (values ('holds_lead'), ('observed_without_lead'), ('too_recent')) v(bucket) left join q using (bucket)")
def lead_slot_partition(spark, d):
    return metrics.lead_slot_partition(roster(spark, d), F.lit(END), LAG)


@query(f"with {_A} select greatest(0, yf - y0) as lag, count(*) as n from p where s = 'A' group by 1")
def time_to_lead(spark, d):
    return metrics.time_to_lead(roster(spark, d))[0]


@query(f"with {_A}, q as (select greatest(0, yf - y0) as lag from p where s = 'A') select count(*) as denominator, count(*) filter (where lag = 0) as at_zero, case when count(*) >= 5 then quantile_cont(lag, 0.5) end as median from q")
def time_to_lead_summary(spark, d):
    return metrics.time_to_lead(roster(spark, d))[1]


@query(f"""with {_A}, q as (select *, y1 - y0 as span, y0 <= {START} as lc, y1 >= {END - 1} as rc from p where s in ('A', 'B')), c as (select count(*) as k, quantile_cont(span, 0.25) as q1, quantile_cont(span, 0.5) as q2, quantile_cont(span, 0.75) as q3 from q where not lc and not rc)
select count(*) as cohort_denominator, max(k) as denominator, count(*) filter (where not lc and not rc) as n_complete, count(*) filter (where lc and not rc) as n_left_censored, count(*) filter (where rc and not lc) as n_right_censored, count(*) filter (where lc and rc) as n_both_censored,
count(*) filter (where span = 0 and n > 1) as same_year, max(case when k >= 5 then q2 end) as median, max(case when k >= 5 then q1 end) as q1, max(case when k >= 5 then q3 end) as q3 from q, c""")
def activity_span(spark, d):
    return metrics.activity_span(roster(spark, d))


@query(f"""with {_A}, y as (select unnest(range({START}, {END + 1}))::int as year) select year, (select count(*) from (select distinct pid, y from a) where y = year) as active, (select count(*) from p where y0 = year) as arrivals, (select count(*) from p where y1 = year) as departures, year >= {END - 1} as departures_right_censored from y""")
def roster_turnover(spark, d):
    return metrics.roster_turnover(roster(spark, d), START, END)


@query(f"with y as (select unnest(range({START}, {END + 1}))::int as year), t as (select count(*) as denominator from orders) select year, (select count(*) from orders where year(o_orderdate) = year) as n, year in ({START}, {END}) as partial, year >= {END - 1} as indexing_lag, denominator from y, t")
def records_per_year(spark, d):
    return metrics.records_per_year(orders(spark, d).select("year"), START, END)


@query(f"with {_PI} select pmid, i as pi_index, {_TIER} as pi_evidence, k > 1 as pi_ambiguous, case when r = 0 then 'name_only' else 'verified' end as disposition from pi")
def pi_resolution(spark, d):
    r = pi(spark, d)
    return identity.pi_disposition(r.select("pmid"), r)


_POS = ", ".join(f"count(*) filter (where s = '{s}') as n_{s}, case when count(*) >= 20 then round_even(100.0 * count(*) filter (where s = '{s}') / count(*), 0)::int end as pct_{s}" for s in ["first", "last", "sole", "middle", "unlocated"])


@query(f"""with {_PI}, o as (select o_orderkey as pmid, i, coalesce(n, 0) as n, coalesce(m, false) as m, coalesce(c, false) as c from orders left join pi on pi.pmid = o_orderkey
 left join (select b.pmid, max(b.n) as n, bool_or(l_tax = 0) as m, bool_or(l_tax = 0 and idx = pi.i) as c from b left join pi using (pmid) group by 1) x on x.pmid = o_orderkey),
 q as (select *, case when i is null then 'unlocated' when n = 1 then 'sole' when i = 0 then 'first' when i = n - 1 then 'last' else 'middle' end as s from o)
 select count(*) as denominator, {_POS}, count(*) filter (where m) as email_papers, case when count(*) filter (where m) > 0 then count(*) filter (where m and c) end as corresponding, count(*) < 5 as suppressed from q""")
def pi_byline_positions(spark, d):
    b = lines(spark, d, "l_tax").join(pi(spark, d).select("pmid", "pi_index"), "pmid", "left")
    mail = F.col("l_tax") == 0
    per = b.groupBy("pmid").agg(F.max("pi_index").alias("pi_person_index"), F.max("n_persons").alias("n_persons"), F.bool_or(mail).alias("any_email"), F.bool_or(mail & (F.col("idx") == F.col("pi_index"))).alias("pi_corresponding"))
    p = orders(spark, d).select("pmid").join(per, "pmid", "left").na.fill(False, ["any_email", "pi_corresponding"])
    return metrics.pi_byline_positions(p)


@query(f"with {_B}, q as (select pmid, count(*) as group_size, bool_or(idx = 0) as f, bool_or(idx = n - 1) as l from b where l_discount >= 0.09 group by 1) select pmid, group_size, case when f and l then 'shared_first_and_senior' when f then 'first' when l then 'senior' else 'other' end as category from q")
def equal_contrib(spark, d):
    b = lines(spark, d, "l_discount").withColumnRenamed("idx", "person_idx").withColumn("equal_contrib", F.col("l_discount") >= 0.09)
    return metrics.equal_contrib_occurrences(b)


def team(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("pmid")).repartition(tasks(spark, d), "pmid")
    return li.groupBy("pmid").agg(F.count("*").alias("n_persons"))


_TEAM = "t as (select l_orderkey as pmid, count(*) as k from lineitem group by 1)"


@query(f"with {_TEAM} select count(*) as denominator, quantile_cont(k, 0.5) as median, quantile_cont(k, 0.25) as q1, quantile_cont(k, 0.75) as q3, min(k) as least, max(k) as most, count(*) filter (where k >= 8) as n_large from t")
def team_size(spark, d):
    return metrics.team_size(team(spark, d), 8)


@query(f"with {_A}, {_TEAM} select count(*) as denominator, case when count(*) >= 10 then quantile_cont(k, 0.5) end as median from t where pmid in (select pmid from a join p using (pid) where f and s in ('A', 'B'))")
def team_size_subset(spark, d):
    return metrics.team_size_subset(team(spark, d), lead(spark, d), 8)


@query(f"with {_A}, {_TEAM} select k as n_persons, count(*) as n, count(*) filter (where pmid in (select pmid from a join p using (pid) where f and s in ('A', 'B'))) as n_subset from t group by 1")
def team_size_histogram(spark, d):
    return metrics.team_size_histogram(team(spark, d), lead(spark, d))


@query("select trim(o_orderpriority) as journal, count(*) as n from orders where trim(o_orderpriority) <> '' group by 1 having count(*) >= 2")
def venue_repetition(spark, d):
    return metrics.venue_repetition(orders(spark, d))[0]


def entries(spark, d):
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("affiliation"))
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("pmid"), "l_suppkey")
    return x.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("pmid", "affiliation")


_E = "e as (select l_orderkey as pmid, n_name as affiliation from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"


@query(f"with {_E} select affiliation, count(distinct pmid) as n_papers from e group by 1 having count(distinct pmid) >= 3")
def affiliation_strings(spark, d):
    return metrics.affiliation_strings(entries(spark, d))


@query(f"with {_E}, y as (select unnest(range({START}, {END + 1}))::int as year), g as (select year(o_orderdate) as year, count(*) filter (where affiliation like 'NATION%') as covered, count(*) as total from e join orders on o_orderkey = pmid group by 1) select year, coalesce(covered, 0) as covered, coalesce(total, 0) as total from y full join g using (year)")
def affiliation_coverage(spark, d):
    e = entries(spark, d).join(orders(spark, d).select("pmid", "year"), "pmid")
    return metrics.affiliation_coverage(e.withColumn("affiliation", F.when(F.startswith("affiliation", F.lit("NATION")), F.col("affiliation")).otherwise("")), START, END)


@query("select year(o_orderdate) as year, count(*) as n, md5(string_agg(o_orderkey || ':' || o_orderpriority, ',' order by o_orderkey::varchar, o_orderpriority)) as titles_md5 from orders group by 1")
def titles_by_year(spark, d):
    t = metrics.titles_by_year(orders(spark, d).withColumnRenamed("journal", "title"))
    return t.select("year", F.size("titles").cast("long").alias("n"), F.md5(F.array_join(F.transform("titles", lambda x: F.concat(x.pmid, F.lit(":"), x.title)), ",")).alias("titles_md5"))


@query(f"with {_A} select pid, yf as first_lead_year, yl as first_last_year from p where s = 'D' and nf > 0")
def lead_to_senior_flips(spark, d):
    return identity.flips(roster(spark, d)).select("pid", "first_lead_year", "first_last_year")


def records(spark, d):
    o = orders(spark, d).join(team(spark, d), "pmid", "left")
    doi = F.concat(F.lit("10.1/"), "o_custkey", F.lit("/"), "date_iso")
    return o.select(F.col("pmid").cast("string").alias("pmid"), F.col("pmid").alias("ord"), F.when(F.col("pmid") % 97 == 0, "Correction to: x").otherwise("Corrective x").alias("title"), F.when(F.col("pmid") % 89 == 0, "1900-01-01").otherwise(F.col("date_iso")).alias("date_iso"), doi.alias("doi"), F.coalesce("n_persons", F.lit(0)).alias("n_authors"), F.coalesce("n_persons", F.lit(0)).alias("n_persons"))


_X = f"""{_TEAM}, r as (select o_orderkey as pmid, '10.1/' || o_custkey || '/' || strftime(o_orderdate, '%Y-%m-%d') as doi, coalesce(k, 0) as k,
 case when o_orderkey % 89 = 0 then 'unparseable_date' when o_orderkey % 97 = 0 then 'correction_or_comment' when coalesce(k, 0) = 0 then 'empty_author_list' end as e from orders left join t on pmid = o_orderkey),
 w as (select *, case when e is null then row_number() over (partition by doi, e is null order by pmid) end as rn from r),
 x as (select pmid, coalesce(e, case when rn > 1 then 'duplicate_doi' when k >= 10 then 'hyperauthorship' end) as reason from w)"""


@query(f"with {_X} select pmid::varchar as pmid, reason from x where reason is not null")
def exclusion_waterfall(spark, d):
    return identity.exclusions(records(spark, d), hyper=10).where("reason is not null").select("pmid", "reason")


@query(f"with {_X} select coalesce(reason, 'kept') as disposition, count(*) as n from x group by 1")
def exclusion_counts(spark, d):
    return identity.exclusions(records(spark, d), hyper=10).groupBy(F.coalesce("reason", F.lit("kept")).alias("disposition")).agg(F.count("*").alias("n"))


@query("select o_custkey, strftime(o_orderdate, '%Y-%m-%d') as date_iso, min(o_orderkey) as pmid from orders group by 1, 2")
def dedupe_doi(spark, d):
    o = orders(spark, d).withColumn("doi", F.concat_ws("/", "o_custkey", "date_iso"))
    return identity.first_by_order(o, "doi", *identity.pmid_order(F.col("pmid").cast("string"))).select("o_custkey", "date_iso", "pmid")


@query("select o_custkey as pmid, min(o_orderkey) as ord from orders group by 1")
def dedupe_pmid(spark, d):
    o = orders(spark, d).select(F.col("o_custkey").alias("pmid"), F.col("pmid").alias("ord"))
    return identity.first_by_order(o, "pmid", "ord")


@query("with k as (select doc_id::varchar as pmid, regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]', '', 'g') as title_key from documents) select title_key, string_agg(pmid, ',' order by pmid) as pmids from k where title_key <> '' group by 1 having count(*) > 1")
def title_duplicate_groups(spark, d):
    t = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pmid"), F.col("text").alias("title"))
    return identity.title_duplicates(t).select("title_key", F.array_join("pmids", ",").alias("pmids"))


_MONTH = " ".join(f"when '{m}' then {n}" for m, n in T.MONTHS.items())


@query(f"""with q as (select doc_id, regexp_extract(text, '(\\d{{4}})', 1) as y, lower(left(regexp_extract(text, '\\b([A-Za-z]{{3}})[A-Za-z]*\\b', 1), 3)) as m, regexp_extract_all(text, '\\b(\\d{{1,2}})\\b', 1) as ds from (select doc_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g')  as text from documents))
select doc_id, printf('%s-%02d-%02d', case when y = '' then '1900' else y end, case m {_MONTH} else 1 end, least(31, greatest(1, coalesce(ds[-1]::int, 1)))) as date_iso from q""")
def date_iso(spark, d):
    s = F.regexp_replace("text", "[^\\x00-\\x7F]", "_")
    return read(spark, d, "documents").select("doc_id", T.date_iso(s).alias("date_iso"))


@query("select doc_id, nullif(regexp_extract(text, '(\\d{4})', 1), '')::int as year from documents")
def year_window(spark, d):
    return read(spark, d, "documents").select("doc_id", T.year_in(F.col("text")).alias("year"))


def _sql_fold(c: str) -> str:
    for a, b in {**T.SPECIAL_TWO, **T.SPECIAL_ONE}.items():
        c = f"replace({c}, '{a}', '{b}')"
    return f"strip_accents({c})"


_NORM = f"trim(regexp_replace(lower({_sql_fold('text')}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"select doc_id, md5({_NORM}) as norm from documents")
def norm_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.norm_text(F.col("text"))).alias("norm"))


@query(f"select p_partkey, regexp_replace(lower({_sql_fold('p_name')}), '[^\\p{{L}}]', '', 'g') as norm from part")
def norm_author(spark, d):
    return read(spark, d, "part").select("p_partkey", T.norm_author(F.col("p_name")).alias("norm"))


@query(f"select doc_id, len(list_distinct(list_filter(string_split({_NORM}, ' '), lambda x: x <> '')))::bigint as n_tokens from documents")
def title_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query()  # SQL over all pairs of whole texts is too slow; tests/test_whole_texts.py holds the search to brute force
def title_similarity_pairs(spark, d):
    t = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("title"))
    return verify.title_candidates(t, t.withColumnRenamed("key", "doi"), same=True).select("key", "found_doi", F.round("similarity", 9).alias("similarity"))


_HEAD = "('Introduction\n' || coalesce(text, '') || '\nResults.\n ' || lang || '\n METHODS \n' || source || '\n\nResults\nagain')"
_SEC = "(?im)^\\s*(" + "|".join(analyze.HEADINGS) + ")\\s*\\.?\\s*$"


@query(f"""with s as (select doc_id, {_HEAD} as t from documents),
p as (select doc_id, unnest(regexp_extract_all(t, '{_SEC}', 1)) as name, unnest(list_slice(string_split_regex(t, '{_SEC}'), 2, 1000000)) as body, unnest(range(1, len(regexp_extract_all(t, '{_SEC}', 1)) + 1)) as i from s)
select doc_id, lower(name) as heading, md5(regexp_replace(arg_min(body, i), '^\\s+|\\s+$', '', 'g')) as body from p group by 1, 2""")
def section_split(spark, d):
    t = F.concat(F.lit("Introduction\n"), T.text(F.col("text")), F.lit("\nResults.\n "), F.col("lang"), F.lit("\n METHODS \n"), F.col("source"), F.lit("\n\nResults\nagain"))
    s = read(spark, d, "documents").select("doc_id", F.explode(T.sections(t, analyze.HEADINGS)).alias("heading", "body"))
    return s.select("doc_id", "heading", F.md5("body").alias("body"))


_PG = "(select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey + 100)::varchar || '-' || (l_suppkey % 10)::varchar as s from lineitem)"


@query(f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when length(string_split(s, '-')[2]) < length(string_split(s, '-')[1]) then string_split(s, '-')[1] || '-' || left(string_split(s, '-')[1], length(string_split(s, '-')[1]) - length(string_split(s, '-')[2])) || string_split(s, '-')[2] else s end as pages,
 true as same from {_PG}""")
def page_range_expand(spark, d):
    s = F.concat((F.col("l_partkey") + 100).cast("string"), F.lit("-"), (F.col("l_suppkey") % 10).cast("string"))
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.alias("s"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.expand_pages(F.col("s")).alias("pages"), T.pages_match(F.col("s"), T.expand_pages(F.col("s"))).alias("same"))


@query("select doc_id, regexp_extract(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+', 0) as email from documents where regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+')")
def email_extract(spark, d):
    return read(spark, d, "documents").select("doc_id", T.email_in(F.col("text")).alias("email")).where("email <> ''")


@query("select s_suppkey, case when contains(lower(n_name), 'nation_1') then 'nation_1' when contains(lower(n_name), '3') then '3' end as keyword from supplier join nation on s_nationkey = n_nationkey")
def affiliation_match(spark, d):
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", identity.affiliation_keyword(F.col("n_name"), ["nation_1", "3"]).alias("keyword"))


@query(f"with {_B} select pmid, idx, case when l_returnflag = 'R' then 'orcid' when l_tax = 0 then 'email' when l_linestatus = 'F' then 'affiliation' else 'name_only' end as tier from b")
def evidence_tier(spark, d):
    who = identity.Identity(orcid="R", affiliations=["F"], domains=["0.0"])
    b = lines(spark, d, "l_returnflag", "l_tax", "l_linestatus").withColumns({"orcid": F.col("l_returnflag"), "email": F.when(F.col("l_tax") == 0, "0.0").otherwise("x"), "affiliation": F.col("l_linestatus")})
    return b.select("pmid", "idx", identity.evidence_tier(who).alias("tier"))


@query("select page_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(l), lambda x: lpad(list_position(l, x)::varchar, 9, '0') || x)), lambda x: x[10:]), ' ') as links from (select page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) as l from pages)")
def href_extract(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(T.hrefs(F.col("html")), " ").alias("links"))


_PARA = "list_filter(list_transform(string_split(replace(text, '. ', chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query(f"select doc_id, coalesce(left({_PARA}[1], 1500), '') as first, coalesce(left({_PARA}[-1], 1500), '') as last from documents")
def first_last_paragraph(spark, d):
    s = F.replace("text", F.lit(". "), F.lit("\n\n"))
    return read(spark, d, "documents").select("doc_id", T.first_paragraph(s).alias("first"), T.last_paragraph(s).alias("last"))


def _refs(spark, d, spelt: bool = False):
    """References and lookups. Names are compared by their letters, which all of "Author1", "Author2", ... share; spelt: numbers in letters, so that each customer is an author of its own."""
    o = orders(spark, d)
    k, s = F.col("pmid"), F.col("pmid").cast("string")
    number = F.col("o_custkey").cast("string")
    author = F.concat(F.lit("Author"), F.translate(number, "0123456789", "bcdfghjklm") if spelt else number)
    ref = o.select(
        s.alias("key"), F.col("journal").alias("title"), author.alias("first_author"), F.col("year").cast("string").alias("year"), F.col("journal").alias("journal"),
        (F.col("o_custkey") % 50).cast("string").alias("volume"), F.lit("").alias("issue"), F.lit("").alias("pages"), F.concat(F.lit("10.1/"), s).alias("doi"), F.when(k % 3 == 0, s).otherwise("").alias("pmid"), F.lit("article").alias("entry_type"),
    )
    some = lambda n, c: F.when(k % n == 0, None).otherwise(c)
    none, people = F.lit(None).cast("string"), F.array(author)
    cross = o.where(k % 11 != 0).select(
        F.concat(F.lit("10.1/"), s).alias("doi"), F.col("journal").alias("title"), author.alias("first_author"), people.alias("all_authors"), (F.col("year") + F.when(k % 7 == 0, 1).otherwise(0)).cast("string").alias("year"),
        F.col("journal").alias("journal"), (F.col("o_custkey") % 50).cast("string").alias("volume"), F.lit("").alias("issue"), F.lit("").alias("pages"), F.lit("article").alias("type"), F.when(k % 13 == 0, "timeout").alias("lookup_error"),
    )
    link = o.where(k % 5 != 0).select(F.concat(F.lit("10.1/"), s).alias("doi"), F.when(k % 17 == 0, (k + 1).cast("string")).otherwise(s).alias("pmid"), none.alias("lookup_error"))
    pub = o.where(k % 19 != 0).select(
        s.alias("pmid"), F.concat(F.lit("10.1/"), F.when(k % 23 == 0, F.lit("x")).otherwise(s)).alias("doi"), F.col("journal").alias("title"), author.alias("first_author"), people.alias("all_authors"),
        F.col("year").cast("string").alias("year"), F.col("journal").alias("journal"), ((F.col("o_custkey") + F.when(k % 29 == 0, 1).otherwise(0)) % 50).cast("string").alias("volume"), F.lit("").alias("issue"), F.lit("").alias("pages"), none.alias("lookup_error"),
    )
    return ref, cross, link, pub


_V = """o as (select o_orderkey as k, o_custkey as c, year(o_orderdate) as y, o_orderpriority as j from orders),
r as (select k, c, y, j, k % 3 = 0 as has, k % 11 = 0 as no_cr, k % 11 <> 0 and k % 13 = 0 as failed, case when k % 5 = 0 then null when k % 17 = 0 then k + 1 else k end as der from o),
w as (select r.*, case when has then k else der end as want from r),
v as (select w.*, x.k is not null and x.k % 19 <> 0 as found, case when x.k % 23 = 0 then 'x' else x.k::varchar end as pdoi, x.c as xc, x.y as xy, x.j as xj, (x.c + case when x.k % 29 = 0 then 1 else 0 end) % 50 as xv from w left join o x on x.k = want),
f as (select *, failed and exists (select 1 from o z where z.k % 11 <> 0 and z.k % 13 <> 0 and z.j = v.j) as by_title,
 no_cr::int as miss_doi, (has and not found)::int as miss_pmid, (has and der is not null and der <> k)::int as conf_fwd, (has and found and pdoi <> k::varchar)::int as conf_back from v)"""


@query(f"with {_V} select k::varchar as key, conf_fwd::bigint as forward, conf_back::bigint as reverse from f where conf_fwd + conf_back > 0")
def crosscheck_conflicts(spark, d):
    ref, _, link, pub = _refs(spark, d)
    v = verify.conflicts(ref, link, pub)
    n = lambda f: F.size(F.filter("issues", lambda i: (i.severity == "conflict") & (i.field == f))).cast("long")
    return v.select("key", n("pmid").alias("forward"), n("doi").alias("reverse")).where("forward + reverse > 0")


@query(f"with {_V} select k::varchar as key, 'verified' as kind from f where not no_cr and not failed and k % 7 <> 0 and conf_fwd + conf_back + miss_pmid = 0 and (want is null or not found or (xy = y and xj = j and xc = c and xv = c % 50))")
def verified_entries(spark, d):
    v = verify.verify(*_refs(spark, d, spelt=True))
    return v.where("status = 'verified'").select("key", F.col("status").alias("kind"))


@query("""with m as (select o_orderkey as k, o_custkey as c, year(o_orderdate) as y from orders where o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0) select k::varchar as key, 'year' as field, y::varchar as supplied, (y + 1)::varchar as canonical from m where k % 7 = 0""")
def compare_fields(spark, d):
    ref, cross, _, _ = _refs(spark, d)
    j = ref.select("doi", F.struct("*").alias("ref")).join(cross.where("lookup_error is null").select("doi", F.struct(*cross.columns).alias("meta")), "doi")
    return j.select("ref.key", F.explode(verify.compare_fields("ref", "meta", "crossref")).alias("i")).select("key", "i.field", "i.supplied", "i.canonical")


_S = f"""{_V}, z as (select k, c, y + (k % 7 = 0)::int as cy, c % 50 as cv, j as cj from o where k % 11 <> 0 and k % 13 <> 0),
t as (select cj as tj, arg_min(cy, '10.1/' || k::varchar) as ty, arg_min(cv, '10.1/' || k::varchar) as tv from z group by 1),
g as (select f.*, case when not no_cr and not failed then y + (k % 7 = 0)::int when by_title then ty end as cy, case when not no_cr and not failed then c % 50 when by_title then tv end as cv from f left join t on tj = j),
s as (select k, der, conf_fwd + conf_back as n_conf, miss_doi + miss_pmid as n_miss, failed::int + no_cr::int as n_errors, cy is not null or found as resolved,
 conf_fwd + conf_back + miss_doi + miss_pmid + coalesce((cy <> y)::int + (cv <> c % 50)::int, 0) + case when found then (xy <> y)::int + 2 * (xj <> j)::int + (xv <> c % 50)::int else 0 end as n_issues from g),
e as (select *, case when not resolved then case when n_errors > 0 then 'error' else 'not_found' end when n_issues > 0 then 'mismatch' when n_errors > 0 then 'partial' else 'verified' end as status from s)"""


@query(f"with {_S} select k::varchar as key, status, n_issues::int as n_issues, n_errors::int as n_errors, coalesce(der::varchar, '') as derived_pmid from e")
def verify_status(spark, d):
    return verify.verify(*_refs(spark, d)).select("key", "status", F.size("issues").alias("n_issues"), F.size("errors").alias("n_errors"), "derived_pmid")


@query(f"with {_S} select count(*) as total, {', '.join(f"count(*) filter (where status = '{x}') as {x}" for x in verify.STATUSES)}, count(*) filter (where n_conf > 0) as conflicts, count(*) filter (where n_miss > 0) as unregistered, count(*) filter (where n_errors > 0) as incomplete from e")
def verify_summary(spark, d):
    return verify.summarize(verify.verify(*_refs(spark, d)))


@query(f"with {_V} select distinct pmid from (select k::varchar as pmid from r where has union all select der::varchar from r where der is not null)")
def wanted_ids(spark, d):
    ref, _, link, _ = _refs(spark, d)
    return verify.wanted_ids(ref, link)


_LBL = "coalesce(nullif(array_to_string(list_filter([case when f then 'F' when l_discount >= 0.09 then 'cF' end, case when l then 'L' end, case when l_tax = 0 then 'C' end], lambda x: x is not null), ' / '), ''), '#' || (idx + 1))"


@query(f"with {_A} select pid as name, pmid, arg_max({_LBL}, idx) as label from a group by 1, 2")
def author_paper_matrix(spark, d):
    a = lines(spark, d, "l_discount", "l_tax").select("pmid", F.concat_ws("-", "l_suppkey", "l_partkey").alias("name"), (F.col("idx") + 1).alias("index"), (F.col("idx") == 0).alias("is_first"), (F.col("idx") == F.col("n_persons") - 1).alias("is_last"), (F.col("l_discount") >= 0.09).alias("equal_contrib"), (F.col("l_tax") == 0).alias("is_corresponding"))
    return analyze.matrix_long(a)


@query("select bucket, year, count(*) as n from (select o_orderpriority as bucket, year(o_orderdate) as year from orders union all select o_orderstatus, year(o_orderdate) from orders) group by 1, 2")
def topic_year_matrix(spark, d):
    return analyze.topic_years(orders(spark, d).select("year", F.col("journal").alias("primary_bucket"), F.col("o_orderstatus").alias("secondary_bucket")))


@query("select b as bucket, (select count(*) from orders where o_orderpriority = b) as n from (values ('1-URGENT'), ('5-LOW'), ('none')) v(b)")
def topic_counts(spark, d):
    return analyze.topic_counts(orders(spark, d).select(F.col("journal").alias("primary_bucket")), ["1-URGENT", "5-LOW", "none"])


def _log(spark, d):
    e = read(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", cache.DONE).when(F.col("event_type") == "click", cache.FAILED).otherwise("pending")
    return e.select(F.col("user_id").alias("pmid"), "event_id", status.alias("status"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("source"), F.unix_timestamp("ts").cast("double").alias("updated_at"))


_LOG = "g as (select user_id as pmid, event_id, case event_type when 'purchase' then 'downloaded' when 'click' then 'all_sources_failed' else 'pending' end as status, case when event_type <> 'view' then event_type end as source, epoch(date_trunc('second', ts))::double as updated_at from events), k as (select pmid, arg_max(status, (updated_at, event_id)) as status, arg_max(source, (updated_at, event_id)) filter (where source is not null) as source, arg_max(updated_at, (updated_at, event_id)) as updated_at from g group by 1)"


def _state(spark, d):
    return cache.upsert(_log(spark, d), "pmid", ["updated_at", "event_id"], ["status", "source", "updated_at"])


@query(f"with {_LOG} select * from k")
def cache_upsert(spark, d):
    return _state(spark, d)


_NOW = 1706745600.0


@query(f"with {_LOG} select pmid, status from k where not (status = 'all_sources_failed' and updated_at < {_NOW} - 90 * 86400)")
def cache_cleanup(spark, d):
    return cache.cleanup(_state(spark, d), _NOW)[0].select("pmid", "status")


@query(f"with {_LOG} select count(*) as total, count(*) filter (where status = 'downloaded') as downloaded, count(*) filter (where status = 'all_sources_failed') as failed from k")
def cache_stats(spark, d):
    return cache.stats(_state(spark, d))


@query("select count(*) as matched, least(count(*), 500) as returned, count(*) > 500 as truncated from orders where o_orderpriority = '1-URGENT'")
def truncated_search(spark, d):
    return analyze.truncated_search(orders(spark, d).where("journal = '1-URGENT'"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("select o_orderstatus as status, count(*) as n from (select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'P' union all select o_orderkey, o_orderstatus from orders where o_orderstatus = 'P') group by 1")
def seen_union(spark, d):
    judged = orders(spark, d).select("pmid", "o_orderstatus", F.when(F.col("o_orderstatus") == "P", "hyperauthorship").alias("reason"))
    return identity.kept_and_counted(judged).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("select o_orderkey as pmid from orders where o_orderkey not in (select l_orderkey from lineitem)")
def unmatched_papers(spark, d):
    return identity.skipped(orders(spark, d).select("pmid"), read(spark, d, "lineitem").select(F.col("l_orderkey").alias("pmid")))


@query(f"with {_A} select y0 as first_year, pid, row_number() over (partition by y0 order by pid) - 1 as place from p where s = 'B'")
def stack_positions(spark, d):
    return metrics.stack_positions(roster(spark, d).where("stratum = 'B'").select("first_year", "pid"), "first_year", "pid")


@query(f"with {_A} select pid, string_agg(pmid::varchar, ',' order by d, pmid::varchar) as pmids, coalesce(string_agg(pmid::varchar, ',' order by d, pmid::varchar) filter (where f), '') as first_slot_pmids from a group by 1")
def person_pmids(spark, d):
    return identity.person_papers(apps(spark, d), "pid").select("pid", F.array_join("pmids", ",").alias("pmids"), F.array_join("first_slot_pmids", ",").alias("first_slot_pmids"))


@query(f"with {_A} select pid, d0 as first_date, y as year, bool_or(f) as lead from a join p using (pid) where s in ('A', 'B') group by all")
def timeline_marks(spark, d):
    p = roster(spark, d).withColumn("name", F.col("pid"))
    return metrics.timeline_rows(p).select(F.col("name").alias("pid"), "first_date", "year", "lead")


@query(f"with {_A} select pid as name, case when nf > 0 then 'lead' when {END} - y0 >= {LAG} then 'waiting' else 'too_recent' end as row, case when nf > 0 then greatest(0, yf - y0) else {END} - y0 end as value from p where s in ('A', 'B')")
def lag_rows(spark, d):
    return metrics.lag_rows(roster(spark, d).withColumn("name", F.col("pid")), F.lit(END), LAG)


@query(f"""with {_A}, q as (select pid as name, case when y0 <= {START} and y1 >= {END - 1} then 'both_censored' when y0 <= {START} then 'left_censored' when y1 >= {END - 1} then 'right_censored' else 'complete' end as lane, y1 - y0 as span from p where s in ('A', 'B'))
select *, (row_number() over (partition by lane, span order by name) - 1)::int as place from q""")
def span_lanes(spark, d):
    return metrics.span_lanes(roster(spark, d).withColumn("name", F.col("pid")))


@query(f"with {_A} select y0 as first_year, count(*) as n from p where s = 'C' group by 1")
def first_year_strip(spark, d):
    return metrics.first_year_strip(roster(spark, d))


@query("select l_orderkey as pmid, count(*)::int as n_persons from lineitem group by 1 having count(*) >= 6")
def large_teams(spark, d):
    return metrics.large_teams(lines(spark, d).select("pmid", "n_persons").distinct(), 6)


@query("select o_orderkey as pmid, strftime(o_orderdate, '%Y-%m-%d') as date_iso from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01' and o_orderpriority = '2-HIGH' order by o_orderkey desc limit 100")
def search_page(spark, d):
    return analyze.search_page(orders(spark, d).select("pmid", "date_iso", "journal"), [F.desc("pmid")], 100, ("1996-01-01", "1997-12-31"), F.col("journal") == "2-HIGH").select("pmid", "date_iso")


def _named(spark, d):
    """Bylines with names of every kind: equal surnames, forenames that are prefixes of each other or not, bare initials, none at all, ORCIDs, consortia."""
    x = lines(spark, d)
    fores = ["", "Wei", "Weiwei", "Wenjie", "W", "Anna", "An"]
    fore = F.lit("")
    for i, f in enumerate(fores):
        fore = F.when(F.col("l_partkey") % 7 == i, f).otherwise(fore)
    last = F.concat(F.lit("Li"), (F.col("l_suppkey") % 10).cast("string"))
    orcid = F.when(F.col("pmid") % 50 == 0, F.concat(F.lit("O"), (F.col("l_suppkey") % 30).cast("string"))).otherwise("")
    group = F.col("l_partkey") % 11 == 0
    none = lambda c: F.when(group, "").otherwise(c)
    return x.select(
        "pmid", "idx", F.when(group, "Study Group").otherwise(F.concat_ws(" ", last, fore)).alias("name"), none(last).alias("last"), none(fore).alias("fore"),
        none(F.when((F.col("l_partkey") % 7 == 0) & (F.col("l_suppkey") % 2 == 0), "W").otherwise("")).alias("initials"), none(orcid).alias("orcid"),
    )


_N = _B + """, nm as (select pmid, idx, l_partkey % 11 = 0 as g, case when l_partkey % 11 = 0 then '' else 'li' || (l_suppkey % 10) end as l,
 case when l_partkey % 11 = 0 then '' else ['', 'wei', 'weiwei', 'wenjie', 'w', 'anna', 'an'][l_partkey % 7 + 1] end as f, case when l_partkey % 11 <> 0 and l_partkey % 7 = 0 and l_suppkey % 2 = 0 then 'w' else '' end as i,
 case when l_partkey % 11 <> 0 and l_orderkey % 50 = 0 then 'o' || (l_suppkey % 30) else '' end as o from b),
ap as (select *, row_number() over (partition by pmid order by idx) - 1 as pidx, count(*) over (partition by pmid) as np from nm where not g),
sl as (select pmid, bool_or(idx = 0 and g) as slot0 from nm group by 1)"""


@query(f"with {_N}, {_FOUND} select pmid, idx, pidx = 0 and not slot0 as is_first, pidx = np - 1 as is_last from ap join sl using (pmid) left join (select pmid, i as pi_at from pi) using (pmid) where pi_at is null or idx <> pi_at")
def appearances(spark, d):
    return identity.appearances(_named(spark, d), pi(spark, d)).select("pmid", "idx", "is_first", "is_last")


@query(f"with {_N} select count(distinct (l, f)) as n_strict, count(distinct (l, left(case when f <> '' then f else i end, 1))) as n_loose from nm where not g")
def person_key_counts(spark, d):
    return identity.key_counts(_named(spark, d).where("last <> ''"))


@query(f"""with {_N}, x as (select *, left(case when f <> '' then f else i end, 1) as c from ap), ow as (select l, c, count(distinct o) as k, min(o) as own from x where o <> '' group by 1, 2),
gr as (select x.*, coalesce(k, 0) as k, case when o <> '' then 'o:' || o when c = '' then 'n:' || pmid || ':' || idx when k = 1 then 'o:' || own else 'l:' || l || '|' || c end as gid from x left join ow using (l, c)),
q as (select gid, count(*) as n, list_sort(list_distinct(list(f) filter (where f <> ''))) as fs, bool_or(o = '' and c = '') as bare, bool_or(k > 1) as conf from gr group by 1),
dr as (select *, len(fs) > 1 as many, len(list_filter(range(1, len(fs)), lambda z: not starts_with(fs[z + 1], fs[z]))) = 0 as ok from (select gid, n, coalesce(fs, []) as fs, bare, conf from q))
select gid as group_id, n, array_to_string(list_filter([case when bare then 'incomplete_name' end, case when conf then 'collision_confirmed' end, case when many and ok then 'drift_benign' end, case when many and not ok then 'collision_suspected' end], lambda z: z is not null), ',') as flags from dr""")
def person_groups(spark, d):
    a = _named(spark, d).where("last <> ''")
    return identity.group_people(a).groupBy("group_id").agg(F.count("*").alias("n"), F.array_join(F.any_value("flags"), ",").alias("flags"))


@query(f"""with {_N}, {_FOUND},
pp as (select pmid, max(np) as np, bool_or(pidx = 0 and idx = pi.i) as first from ap left join pi using (pmid) group by 1)
select pmid, coalesce(np = 1 and not coalesce(first, false), false) as sole_author, slot0 from sl left join pp using (pmid) where coalesce(np = 1 and not coalesce(first, false), false) or slot0""")
def slot_lists(spark, d):
    return identity.slot_lists(_named(spark, d), pi(spark, d))
