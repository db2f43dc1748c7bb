"""Named queries for single functions and smaller operators, each with its SQL. Names, identifiers and bylines are spelt from the keys of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexa.functions import text as T
from codexa.operators import analyze, cache, identity, verify
from codexa.plans.catalogue import _B, _S, _named, _refs, lines, orders, query, read

# name as cited, and its single reading, for the rules of order, commas, initials and short surnames in capitals
NAMES = {
    "Bray F": "bray", "Bass AJ": "bass", "Bray, Freddie": "bray", "Freddie Bray": "bray", "Jing WU": "wu", "Yi LI": "li", "O'Brien M": "obrien", "Van Der Berg": "berg", "Nguyễn": "nguyen",
    "MU J": "mu", "李 四": "四", "": "", "Smith MA": "ma", "Smith JA": "smith", "Jürgen Groß": "gross", "Solo": "solo",
}
READINGS = {
    "Bray F": "bray brayf", "Bass AJ": "bass bassaj", "Bray, Freddie": "bray", "Freddie Bray": "bray freddie freddiebray", "Jing WU": "jing jingwu wu", "Yi LI": "li yi yili", "O'Brien M": "obrien obrienm",
    "Van Der Berg": "berg van vanderberg", "Nguyễn": "nguyen", "MU J": "mu muj", "李 四": "四 李 李四", "": "", "Smith MA": "ma smith smithma", "Smith JA": "ja smith smithja", "Jürgen Groß": "gross jurgen jurgengross", "Solo": "solo",
}


def _quoted(*values: str) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _pick(key, values):
    """The value at key modulo their number."""
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def _sql_pick(key: str, values) -> str:
    return f"[{_quoted(*values)}][({key}) % {len(values)} + 1]"


@query(f"select p_partkey, {_sql_pick('p_partkey', NAMES)} as name, {_sql_pick('p_partkey', NAMES.values())} as surname, {_sql_pick('p_partkey', [READINGS[n] for n in NAMES])} as readings from part")
def surname_readings(spark, d):
    name = F.col("name")
    p = read(spark, d, "part").select("p_partkey", _pick(F.col("p_partkey"), list(NAMES)).alias("name"))
    return p.select("p_partkey", "name", T.surname_of(name).alias("surname"), F.array_join(T.surname_readings(name), " ").alias("readings"))


_AGREE = f"""n as (select unnest(range(0, {len(NAMES)})) as i, unnest([{_quoted(*[READINGS[n] for n in NAMES])}]) as r)"""


@query(f"""with {_AGREE} select p_partkey, x.r = '' or y.r = '' or len(list_intersect(string_split(x.r, ' '), string_split(y.r, ' '))) > 0 as agree
from part join n x on x.i = p_partkey % {len(NAMES)} join n y on y.i = (p_partkey // {len(NAMES)}) % {len(NAMES)}""")
def surnames_agree(spark, d):
    k, n = F.col("p_partkey"), len(NAMES)
    return read(spark, d, "part").select("p_partkey", T.surnames_agree(_pick(k, list(NAMES)), _pick(F.floor(k / n), list(NAMES))).alias("agree"))


BODIES = ["Brown Study Group", "Groupe d'étude", "Smith J", "The Trial Investigators", "Teamster A", "ALS Consortium;", "Programme-Nord", ""]


@query(f"""with q as (select p_partkey, {_sql_pick('p_partkey', BODIES)} as s from part)
select p_partkey, len(list_intersect(string_split(trim(regexp_replace(lower(strip_accents(s)), '[^a-z0-9]+', ' ', 'g')), ' '), [{_quoted(*T.COLLECTIVE)}])) > 0 as collective from q""")
def collective_names(spark, d):
    return read(spark, d, "part").select("p_partkey", T.is_collective(_pick(F.col("p_partkey"), BODIES)).alias("collective"))


JOURNALS = ["Nature", "Nature Medicine", "CA: A Cancer Journal", "ca a cancer journal", "", "Revue d'Économie", "revue d economie", "Medicine"]
_JN = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""with q as (select p_partkey, {_JN.format(_sql_pick('p_partkey', JOURNALS))} as a, {_JN.format(_sql_pick('p_partkey // 8', JOURNALS))} as b from part)
select p_partkey, a = '' or b = '' or contains(a, b) or contains(b, a) as same from q""")
def journals_match(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select("p_partkey", T.journal_matches(_pick(k, JOURNALS), _pick(F.floor(k / 8), JOURNALS)).alias("same"))


FORMS = ["{0}", " 10.5/AbC{0} ", "https://doi.org/10.5/AbC{0}", "HTTP://DX.DOI.ORG/10.5/AbC{0}", "doi: 10.5/AbC{0}", "https://doi.org/doi:10.5/{0}", "PMID: {0}", "pubmed {0}", "PMC{0}", "https://pubmed.ncbi.nlm.nih.gov/{0}/", "http://www.ncbi.nlm.nih.gov/pubmed/{0}", "pmid=https://pubmed.ncbi.nlm.nih.gov/{0}", "{0}123456"]
_FORM = f"replace({_sql_pick('o_orderkey', FORMS)}, '{{0}}', o_orderkey::varchar)"
_DOI = "regexp_replace(" * len(T.DOI_PREFIXES) + "trim(s)" + "".join(f", '^{p.replace('.', chr(92) + '.')}', '', 'i')" for p in T.DOI_PREFIXES)
_PM = "regexp_replace(trim(regexp_replace(regexp_replace(trim(s), '^(pmid|pubmed)\\s*[:=]?\\s*', '', 'i'), '^https?://(www\\.)?(pubmed\\.ncbi\\.nlm\\.nih\\.gov|ncbi\\.nlm\\.nih\\.gov/pubmed)/', '', 'i')), '/+$', '')"


@query(f"""with q as (select o_orderkey, {_FORM} as s from orders), p as (select o_orderkey, trim({_DOI}) as doi, {_PM} as pm from q)
select o_orderkey, doi, lower(doi) as normal, case when regexp_full_match(pm, '[0-9]{{1,8}}') then pm else '' end as pmid from p""")
def identifiers(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.replace(_pick(F.col("o_orderkey"), FORMS), F.lit("{0}"), F.col("o_orderkey").cast("string")).alias("s"))
    s = F.col("s")
    return o.select("o_orderkey", T.clean_doi(s).alias("doi"), T.normalize_doi(s).alias("normal"), T.clean_pmid(s).alias("pmid"))


@query("""with q as (select doc_id, trim(coalesce(text, '')) as s from documents)
select doc_id, md5(case when regexp_full_match(s, '(1[6-9]|2[01])[0-9]{2}') then s when regexp_matches(s, '(1[6-9]|2[01])[0-9]{2}') then regexp_extract(s, '((?:1[6-9]|2[01])[0-9]{2})', 1) else s end) as year from q""")
def bib_year(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.bib_year(F.col("text"))).alias("year"))


@query("select doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') as names from documents")
def split_names(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(T.split_authors(F.col("text")), "|").alias("names"))


@query("select doc_id, regexp_replace(left(coalesce(text, ''), 60), '[\\\\/:*?\"<>|]', '_', 'g') as name from documents")
def safe_names(spark, d):
    return read(spark, d, "documents").select("doc_id", T.safe_file_name(F.col("text")).alias("name"))


_PDF = "'<meta name=\"citation_pdf_url\" content=\"/m' || (page_id % 3) || '.pdf\"><link type=\"application/pdf\" href=\"/t.pdf?x=' || page_id || '\"> see https://x.org/' || page_id || '.pdf?v=2, ' || coalesce(html, '') || ' http://y.org/m0.pdf https://x.org/' || page_id || '.pdf?v=2, /none.pdf'"


@query(f"""with q as (select page_id, {_PDF} as s from pages),
l as (select page_id, list_concat(list_concat(regexp_extract_all(s, 'citation_pdf_url["\\s]+content="([^"]+)"', 1), regexp_extract_all(s, 'application/pdf["\\s]+href="([^"]+)"', 1)),
 regexp_extract_all(s, '(https?://[^\\s"''<>]+\\.pdf(?:\\?[^\\s"''<>]*)?)', 1)) as l from q)
select page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') as urls from l""")
def pdf_links(spark, d):
    k, c = F.col("page_id").cast("string"), F.concat
    head = c(F.lit('<meta name="citation_pdf_url" content="/m'), F.col("page_id") % 3, F.lit('.pdf"><link type="application/pdf" href="/t.pdf?x='), k, F.lit('"> see https://x.org/'), k, F.lit(".pdf?v=2, "))
    page = c(head, T.text(F.col("html")), F.lit(" http://y.org/m0.pdf https://x.org/"), k, F.lit(".pdf?v=2, /none.pdf"))
    return read(spark, d, "pages").select("page_id", F.array_join(T.pdf_urls(page), " ").alias("urls"))


def _byline(spark, d):
    """Bylines with names, and evidence from the line's flags."""
    more = lines(spark, d, "l_linenumber", "l_returnflag", "l_linestatus", "l_tax")
    k = F.col("l_suppkey") % 10
    return more.select(
        "pmid", "idx", F.concat(F.lit("Li"), k.cast("string")).alias("last"), _pick(F.col("l_partkey"), ["Wei", "Weiwei", "W", "Anna", ""]).alias("fore"), F.lit("").alias("initials"),
        F.col("l_returnflag").alias("orcid"), F.when(F.col("l_tax") == 0, "a@X.edu").otherwise("").alias("email"), F.concat(F.lit("Univ "), "l_linestatus").alias("affiliation"), (F.col("l_tax") == 0.08).alias("is_corresponding"),
    )


ME = identity.Identity("Li3 Wei", "r", ["univ f"], ["x.EDU"])
_FF = _B + """, e as (select pmid, idx, n, 'li' || (l_suppkey % 10) as l, ['wei', 'weiwei', 'w', 'anna', ''][l_partkey % 5 + 1] as f,
 case when l_returnflag = 'R' then 'orcid' when l_tax = 0 then 'email' when l_linestatus = 'F' then 'affiliation' else 'name_only' end as tier,
 array_to_string(list_filter([case when idx = 0 then 'first' end, case when idx = n - 1 then 'last' end, case when l_tax = 0.08 then 'corresponding' end], lambda x: x is not null), ' / ') as role from b),
h as (select * from e where role <> '' and l = 'li3' and (contains(f, 'wei') or contains('wei', f)))"""


@query(f"""with {_FF} select pmid::bigint as pmid, arg_min(role, idx) filter (where tier <> 'name_only') as role, arg_min(tier, idx) filter (where tier <> 'name_only') as tier, 'strict' as mode from h group by 1 having count(*) filter (where tier <> 'name_only') > 0
union all select pmid, coalesce(arg_min(role, idx) filter (where tier <> 'name_only'), arg_min(role, idx)), coalesce(arg_min(tier, idx) filter (where tier <> 'name_only'), arg_min(tier, idx)), 'lenient' from h group by 1""")
def fetch_filter(spark, d):
    b = _byline(spark, d)
    return identity.fetch_filter(b, ME).withColumn("mode", F.lit("strict")).unionByName(identity.fetch_filter(b, ME, strict=False).withColumn("mode", F.lit("lenient")))


@query(f"""with {_B}, s as (select 'Li' || (l_suppkey % 10) as g, ['Wei', 'W.', 'Weiwei'][(l_partkey * l_suppkey) % 3 + 1] as name, count(*) as n from b group by 1, 2)
select g, arg_max(name, (n, length(name), name)) as name from s group by 1""")
def display_names(spark, d):
    s = lines(spark, d).select(F.concat(F.lit("Li"), (F.col("l_suppkey") % 10).cast("string")).alias("g"), _pick(F.col("l_partkey") * F.col("l_suppkey"), ["Wei", "W.", "Weiwei"]).alias("name"))
    return identity.display_names(s, "g")


@query("""with q as (select l_partkey, case when l_suppkey % 3 = 0 then ' ' when l_returnflag = 'R' and l_partkey % 2 = 0 then 'Nanhai Univ' else 'Other' end as a from lineitem)
select l_partkey, case when bool_or(contains(lower(a), 'nanhai')) then 'internal' when bool_or(trim(a) <> '') then 'external' else 'unknown' end as signal from q group by 1""")
def affiliation_signal(spark, d):
    a = F.when(F.col("l_suppkey") % 3 == 0, " ").when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 2 == 0), "Nanhai Univ").otherwise("Other")
    return read(spark, d, "lineitem").groupBy("l_partkey").agg(identity.affiliation_signal(a, ["NANHAI"]).alias("signal"))


_G = _B + """, e as (select case when l_partkey % 40 = 0 then '' else 'P' || (l_partkey % 400) end as name, pmid, idx = 0 as f, idx = n - 1 as l, l_discount >= 0.09 as q, o_orderkey % 61 = 0 as undated,
 year(o_orderdate) as y, strftime(o_orderdate, '%Y-%m-%d') as d from b join orders on o_orderkey = pmid), w as (select min(y) as w0, max(y) as w1 from e where not undated),
g as (select name, count(*) as n, count(*) filter (where f) as n_first, count(*) filter (where l) as n_last, min(y) as first_year, max(y) as last_year, min(d) as first_date, list_sort(list_distinct(list(y))) as years,
 coalesce(list_sort(list_distinct(list(y) filter (where f))), []) as lead_years, coalesce(list_sort(list_distinct(list(y) filter (where q))), []) as equal_years,
 case when count(*) filter (where l) > 0 then 'D' when count(*) filter (where f) > 0 then 'A' when count(*) > 1 then 'B' else 'C' end as stratum from e where not undated and name not in ('', 'P7') group by 1)"""


def _entries(spark, d):
    x = lines(spark, d, "l_discount").join(orders(spark, d).select("pmid", "date_iso"), "pmid")
    k = F.col("l_partkey")
    return x.select(
        F.when(k % 40 == 0, "  ").otherwise(F.concat(F.lit("P"), (k % 400).cast("string"))).alias("name"), "pmid", (F.col("idx") == 0).alias("is_first"), (F.col("idx") == F.col("n_persons") - 1).alias("is_last"),
        (F.col("l_discount") >= 0.09).alias("equal_contrib"), F.when(F.col("pmid") % 61 == 0, "1900-01-01").otherwise(F.col("date_iso")).alias("date_iso"),
    )


@query(f"""with {_G} select name, n, n_first, n_last, first_year, last_year, first_date, array_to_string(years, ',') as years, array_to_string(lead_years, ',') as lead_years, array_to_string(equal_years, ',') as equal_years,
 stratum, first_year <= w0 as left_censored, last_year >= w1 - 1 as right_censored from g, w""")
def name_roster(spark, d):
    r = analyze.roster_by_name(_entries(spark, d), [" p7"])
    return r.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("years", "lead_years", "equal_years")})


@query(f"with {_G} select count(*) as n_people, count(*) filter (where stratum = 'C') as omitted_c, count(*) filter (where stratum = 'D') as omitted_d, (select count(distinct pmid) from e where undated) as n_undated from g")
def name_roster_counts(spark, d):
    e = _entries(spark, d)
    return analyze.roster_counts(e, analyze.roster_by_name(e, ["P7"]))


@query("""with p as (select o_orderkey as pmid, case when o_orderkey % 3 = 0 then ['A' || o_custkey, 'B'] else list_filter(list_transform(string_split(' C' || o_custkey || ', , D ,E', ','), lambda x: trim(x)), lambda x: x <> '') end as a, o_orderkey % 3 = 0 as detailed from orders),
x as (select pmid, detailed, len(a) as n, unnest(a) as name, unnest(range(1, len(a) + 1)) as i from p)
select pmid, i::int as index, name, i = 1 as is_first, i = n as is_last, detailed and name = 'B' as equal_contrib from x""")
def author_records(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("pmid"), "o_custkey")
    c = F.col("o_custkey").cast("string")
    one = lambda name, flag: F.struct(name.alias("name"), F.lit(flag).alias("equal_contrib"))
    papers = o.select("pmid", F.concat(F.lit(" C"), c, F.lit(", , D ,E")).alias("authors_str"), F.lit("2020").alias("pubdate"))
    full = F.array(one(F.concat(F.lit("A"), c), False), one(F.lit("B"), True))
    detailed = o.where("pmid % 3 = 0").select("pmid", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.slice(full, 1, 1).alias("authors")), F.struct(F.lit(1).alias("ord"), full.alias("authors")))).alias("x")).select("pmid", "x.*")
    return analyze.explode_authors(analyze.author_records(papers, detailed)).select("pmid", "index", "name", "is_first", "is_last", "equal_contrib")


def _files(spark, d):
    e = read(spark, d, "events")
    folder = F.when(F.col("event_type") == "click", "/pdf/suspect/").otherwise("/pdf/")
    return e.select(F.concat(folder, "user_id", F.lit("_"), "event_id", F.lit(".pdf")).alias("path"), F.col("ts").alias("mtime"), F.col("event_id").alias("size"))


_RP = """k as (select o_orderkey as pmid, case o_orderkey % 3 when 0 then 'done(Europe PMC)' when 1 then 'there' end as st from orders),
m as (select user_id::varchar as u, arg_max(event_id, (ts, '/pdf/' || user_id || '_' || event_id || '.pdf')) as e from events where event_type <> 'click' group by 1),
s as (select user_id::varchar as u, arg_max(event_id, (ts, '/pdf/suspect/' || user_id || '_' || event_id || '.pdf')) as e from events where event_type = 'click' group by 1)"""


@query(f"""with {_RP} select k.pmid::varchar as pmid, coalesce(st, '') as pdf_status, case when st like 'done%' then 'Europe PMC' else '' end as pdf_source, coalesce('/pdf/' || m.u || '_' || m.e || '.pdf', '') as pdf_path, m.e as file_size_bytes,
 coalesce('/pdf/suspect/' || s.u || '_' || s.e || '.pdf', '') as suspect_path from k left join m on m.u = k.pmid::varchar left join s on s.u = k.pmid::varchar""")
def pdf_report(spark, d):
    k, none = F.col("pmid"), F.lit("")
    status = F.when(k % 3 == 0, "done(Europe PMC)").when(k % 3 == 1, "there")
    p = orders(spark, d).select(k.cast("string").alias("pmid"), none.alias("title"), none.alias("pub_date"), none.alias("doi"), none.alias("pmc_id"), status.alias("pdf_status"), none.alias("validation_reason"))
    return analyze.pdf_report(p, _files(spark, d)).select("pmid", "pdf_status", "pdf_source", "pdf_path", "file_size_bytes", "suspect_path")


_STOP = _quoted(*analyze.STOP)


@query(f"""with q as (select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) as t from documents)
select doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(t, ' '), lambda x: length(x) >= 4 and x not in ({_STOP})))), ' ') as words from q""")
def title_words(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.significant_tokens(F.col("text"), analyze.STOP)), " ").alias("words"))


_HARD = "n_conf + n_miss > 0"


@query(f"""with {_S} select 'conflict' as section, sum(n_conf)::bigint as n from e union all select 'missing', sum(n_miss)::bigint from e union all select 'mismatch', coalesce(sum(n_issues) filter (where not ({_HARD})), 0)::bigint from e
union all select 'partial', count(*) filter (where status = 'partial') from e union all select 'unresolved', count(*) filter (where status in ('not_found', 'error') and n_issues = 0) from e""")
def verify_sections(spark, d):
    """Rows of each section of the verification report."""
    v = verify.stage(verify.verify(*_refs(spark, d)).select("key", "issues", "errors", "status"), "verified")
    parts = [df.agg(F.lit(name).alias("section"), F.count("*").alias("n")) for name, df in verify.sections(v).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""with {_B}, q as (select pmid, idx, l_partkey % 11 = 0 as g from b)
select pmid, idx, case when not g then (idx - sum(g::int) over (partition by pmid order by idx))::int end as person_idx, (sum((not g)::int) over (partition by pmid))::int as n_persons from q""")
def person_positions(spark, d):
    return identity.person_index(_named(spark, d)).select("pmid", "idx", "person_idx", "n_persons")


KINDS = ["click", "error", "purchase", "signup", "view"]


@query(f"""with c as (select user_id as pmid, event_type as source, max(event_id) as n, min(coalesce(list_position([{_quoted(*KINDS)}], event_type), 0)) as rank from events group by 1, 2)
select pmid, arg_min(source, rank) as source from c where 5 + n % 2000 >= 1000 and n % 5 > 0 group by 1""")
def first_valid_candidate(spark, d):
    kind = F.col("event_type")
    c = read(spark, d, "events").groupBy(F.col("user_id").alias("pmid"), kind.alias("source")).agg(F.max("event_id").alias("n"), F.min(F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)).alias("rank"))
    content = F.concat(F.when(F.col("n") % 5 > 0, "%PDF-").otherwise("<html"), F.repeat(F.lit("x"), (F.col("n") % 2000).cast("int")))
    return cache.best_candidate(c.withColumn("content", F.encode(content, "utf-8"))).select("pmid", "source")


# field, as cited, as found, and whether they differ
PAIRS = [
    ("title", "Growth of small cells", "A history of large ships", True), ("title", "Growth of small cells", "Growth of small cell", False), ("first_author", "Bray AJ", "Bass AJ", True), ("first_author", "Jing WU", "Wu J", False),
    ("year", "1998 ", "1998", False), ("year", "1998", "1999", True), ("journal", "Nature", "Nature Medicine", False), ("journal", "Nature", "Science", True), ("volume", "Suppl. 1", "suppl 1", False), ("volume", "12", "21", True),
    ("issue", "3", "", False), ("issue", "3", "4", True), ("pages", "202-9", "202–209", False), ("pages", "202-9", "302-309", True), ("first_author", "Smith J", "ALS Study Group", False), ("title", "???", "Growth of small cells", True),
]


@query(f"""select o_orderkey::varchar as key, f[i] as field, s[i] as supplied, c[i] as canonical, 'crossref' as source from (select o_orderkey, o_orderkey % {len(PAIRS)} + 1 as i, [{_quoted(*[p[0] for p in PAIRS])}] as f,
 [{_quoted(*[p[1] for p in PAIRS])}] as s, [{_quoted(*[p[2] for p in PAIRS])}] as c, [{", ".join(str(p[3]).lower() for p in PAIRS)}] as w from orders) where w[i]""")
def compare_each_field(spark, d):
    """One of seven fields cited in another way, on every order; all others are alike."""
    k = F.col("o_orderkey")
    names = ["title", "first_author", "year", "journal", "volume", "issue", "pages"]
    same = {"title": "Growth of small cells", "first_author": "Li W", "year": "2000", "journal": "Nature", "volume": "1", "issue": "2", "pages": "3-4"}
    o = read(spark, d, "orders").select(k.cast("string").alias("key"), *[_pick(k, [p[i] for p in PAIRS]).alias(n) for i, n in enumerate(("f", "s", "c"))])
    side = lambda c: [F.when(F.col("f") == n, F.col(c)).otherwise(same[n]).alias(n) for n in names]
    meta = F.struct(*side("c"), F.array(F.when(F.col("f") == "first_author", F.col("c")).otherwise("Li W")).alias("all_authors"), F.lit("").alias("lookup_error"))
    found = F.explode(verify.compare_fields("ref", "meta", "crossref")).alias("i")
    return o.select(F.struct("key", *side("s")).alias("ref"), meta.alias("meta")).select("ref.key", found).select("key", "i.field", "i.supplied", "i.canonical", "i.source")


@query("select o_orderkey, strftime(o_orderdate::date - 1825, '%Y/%m/%d') as mindate, strftime(o_orderdate, '%Y/%m/%d') as maxdate from orders")
def search_window(spark, d):
    return read(spark, d, "orders").select("o_orderkey", analyze.search_window(F.to_date("o_orderdate"), 5).alias("w")).select("o_orderkey", "w.*")


@query("""with q as (select event_type = 'purchase' as done, event_id % 4 = 0 as cached from events)
select count(*) filter (where done and not cached) as downloaded, count(*) filter (where not done) as failed, count(*) filter (where done and cached) as cached, count(*) as total from q""")
def download_tallies(spark, d):
    status = F.when(F.col("event_type") == "purchase", cache.DONE).otherwise(cache.FAILED)
    return cache.tallies(read(spark, d, "events").select(status.alias("status"), (F.col("event_id") % 4 == 0).alias("from_cache")))
