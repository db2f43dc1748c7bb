"""Who is who: name and evidence predicates, the principal investigator of a paper, exclusions, appearances, people and strata.

Tables: papers(pmid, ord, title, journal, pub_date, doi), bylines(pmid, idx, name, last, fore, initials, affiliation, email, orcid, equal_contrib,
is_corresponding) with idx from 0. Missing text is ''. NULL means not measured.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codexa.functions import text as T
from codexa.numbering import positions
from codexa.staging import stage

CORRECTION = "(?i)^\\s*(correction|corrigendum|erratum|author correction|publisher correction|retraction|retracted|comment on|reply to|response to|editorial)\\b"
HYPER, LARGE = 50, 20
TIERS = ["orcid", "email", "affiliation", "name_only"]


@dataclass(frozen=True)
class Identity:
    name: str = ""
    orcid: str = ""
    affiliations: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def name_matches(name: str) -> Column:
    """Surname equal and forenames compatible, in either order of the target's parts."""
    parts = name.lower().split()
    last, fore, initials = (F.lower(F.trim(T.text(F.col(c)))) for c in ("last", "fore", "initials"))
    if not parts:
        return F.lit(False)
    if len(parts) == 1:
        return last == parts[0]

    def order(surname: str, given: str) -> Column:
        near = F.contains(fore, F.lit(given)) | F.contains(F.lit(given), fore) | (F.left(initials, F.lit(1)) == given[:1])
        return (last == surname) & near

    return order(parts[0], parts[1]) | order(parts[-1], parts[0])


def affiliation_keyword(affiliation: Column, keywords: list[str]) -> Column:
    """The first keyword, in list order, that the text contains; NULL if none."""
    return F.get(F.filter(_texts(keywords), lambda k: F.contains(F.lower(T.text(affiliation)), F.lower(k))), 0)


def domain_matches(email: Column, domains: list[str]) -> Column:
    return (T.text(email) != "") & F.exists(_texts(domains), lambda d: F.endswith(F.lower(T.text(email)), F.lower(d)))


def evidence_tier(who: Identity) -> Column:
    own = who.orcid.lower()
    return (
        F.when((F.lit(own) != "") & (F.lower(T.text(F.col("orcid"))) == own), "orcid").when(domain_matches(F.col("email"), who.domains), "email")
        .when(affiliation_keyword(F.col("affiliation"), who.affiliations).isNotNull(), "affiliation").otherwise("name_only")
    )


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "orcid", 3).when(tier == "email", 2).when(tier == "affiliation", 1).otherwise(0)


def is_consortium() -> Column:
    """Only a collective name is set."""
    empty = F.lit(True)
    for c in ("last", "fore", "initials"):
        empty = empty & (F.trim(T.text(F.col(c))) == "")
    return empty & (F.trim(T.text(F.col("name"))) != "")


def resolve_pi(candidates: DataFrame) -> DataFrame:
    """candidates(pmid, idx, tier) -> pmid, pi_index, pi_evidence, pi_ambiguous: best tier, then lowest index; never the byline position."""
    rank = tier_rank(F.col("tier"))
    best = candidates.withColumn("r", rank).groupBy("pmid", "r").agg(F.min_by("tier", "idx").alias("tier"), F.min("idx").alias("idx"), F.count("*").alias("n"))
    top = best.groupBy("pmid").agg(F.max_by(F.struct("idx", "tier", "n"), "r").alias("b"))
    return top.select("pmid", F.col("b.idx").alias("pi_index"), F.col("b.tier").alias("pi_evidence"), (F.col("b.n") > 1).alias("pi_ambiguous"))


def pi_disposition(papers: DataFrame, resolved: DataFrame) -> DataFrame:
    out = papers.join(resolved, "pmid", "left")
    state = F.when(F.col("pi_index").isNull(), "rejected").when(F.col("pi_evidence") == "name_only", "name_only").otherwise("verified")
    return out.withColumn("disposition", state)


def fetch_filter(bylines: DataFrame, who: Identity, strict: bool = True) -> DataFrame:
    """pmid, role, tier of the papers on which a name match with a role has evidence (or, lenient, any name match with a role)."""
    last = F.max("idx").over(W.partitionBy("pmid"))
    role = F.array_join(F.array_compact(F.array(F.when(F.col("idx") == 0, "first"), F.when(F.col("idx") == last, "last"), F.when(F.col("is_corresponding"), "corresponding"))), " / ")
    rows = bylines.withColumn("role", role).where(name_matches(who.name) & (F.col("role") != "")).withColumn("tier", evidence_tier(who))
    proven = F.col("tier") != "name_only"
    hit = rows.groupBy("pmid").agg(F.min_by(F.when(proven, F.struct("role", "tier")), F.when(proven, F.col("idx"))).alias("v"), F.min_by(F.struct("role", "tier"), "idx").alias("c"))
    pick = F.col("v") if strict else F.coalesce("v", "c")
    return hit.select("pmid", pick.alias("x")).where("x is not null").select("pmid", "x.role", "x.tier")


def person_index(bylines: DataFrame) -> DataFrame:
    """bylines with collective, person_idx (NULL for consortia: raw index minus consortia before) and n_persons."""
    one = F.col("collective").cast("int")
    before = F.coalesce(F.sum(one).over(W.partitionBy("pmid").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = bylines.withColumn("collective", is_consortium())
    rows = rows.withColumn("person_idx", F.when(~F.col("collective"), F.col("idx") - before).cast("int"))
    return rows.withColumn("n_persons", F.sum(1 - one).over(W.partitionBy("pmid")).cast("int"))


def first_by_order(df: DataFrame, key: str, *order) -> DataFrame:
    """First row of each key in the order given."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def pmid_order(pmid: Column) -> list[Column]:
    """Numeric ids first, by value, then the others by text."""
    number = F.when(pmid.rlike("^[0-9]{1,38}$"), pmid).cast("decimal(38,0)")
    return [number.isNull().cast("int"), number, pmid]


def exclusions(papers: DataFrame, hyper: int = HYPER) -> DataFrame:
    """papers(pmid, ord, title, date_iso, doi, n_authors, n_persons) with reason, the first that applies, or NULL for kept ones.

    Order: date, correction title, empty byline, repeated id (first seen stays), repeated DOI (lowest id stays), hyperauthorship.
    """
    early = (
        F.when(F.startswith("date_iso", F.lit("1900-")), "unparseable_date").when(F.col("title").rlike(CORRECTION), "correction_or_comment")
        .when(F.col("n_authors") == 0, "empty_author_list")
    )
    p = papers.withColumn("reason", early)
    seen = F.row_number().over(W.partitionBy("pmid", F.col("reason").isNull()).orderBy("ord"))
    p = p.withColumn("reason", F.coalesce("reason", F.when((F.trim("pmid") != "") & (seen > 1), "duplicate_pmid")))
    doi = F.lower(F.trim(T.text(F.col("doi"))))
    # rows without a DOI are not compared: each goes to a partition of its own
    group = F.when(F.col("reason").isNull() & (doi != ""), doi).otherwise(F.concat(F.lit("#"), F.col("ord").cast("string")))
    rank = F.row_number().over(W.partitionBy(group).orderBy(*pmid_order(F.col("pmid"))))
    p = p.withColumn("reason", F.coalesce("reason", F.when((doi != "") & (rank > 1), "duplicate_doi")))
    return p.withColumn("reason", F.coalesce("reason", F.when(F.col("n_persons") >= hyper, "hyperauthorship")))


def title_duplicates(papers: DataFrame) -> DataFrame:
    """title_key, pmids of the titles that stand on several records; flagged, never merged."""
    keyed = papers.withColumn("title_key", T.title_key(F.col("title"))).where("title_key <> ''")
    return keyed.groupBy("title_key").agg(F.array_sort(F.collect_list("pmid")).alias("pmids")).where("size(pmids) > 1")


def appearances(bylines: DataFrame, pi: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """One row for each person on each paper but the investigator: is_first, is_last by person index, none first behind a leading consortium."""
    rows = person_index(bylines)
    lead = F.max(F.when((F.col("idx") == 0) & F.col("collective"), 1).otherwise(0)).over(W.partitionBy("pmid")) == 1
    rows = rows.withColumn("slot0", lead).where(~F.col("collective")).join(pi.select("pmid", "pi_index"), "pmid", "left")
    named = F.trim("name") != ""
    out = rows.where((F.col("pi_index").isNull() | (F.col("idx") != F.col("pi_index"))) & named)
    if exclude:
        out = out.where(~F.lower(F.trim("name")).isin([e.strip().lower() for e in exclude]))
    return out.withColumns({"is_first": (F.col("person_idx") == 0) & ~F.col("slot0"), "is_last": F.col("person_idx") == F.col("n_persons") - 1})


def group_people(apps: DataFrame) -> DataFrame:
    """apps with group_id and flags. ORCID groups never merge; a loose name (surname, initial) joins an ORCID group only if exactly one owns that name;
    several owners: nothing merges and all are collision_confirmed; no forename and no initials: alone, incomplete_name."""
    low = lambda c: F.lower(F.trim(T.text(F.col(c))))
    a = apps.withColumns({"_l": low("last"), "_f": low("fore"), "_o": low("orcid")})
    a = a.withColumn("_g", F.left(F.coalesce(F.nullif("_f", F.lit("")), low("initials")), F.lit(1)))
    owners = a.where("_o <> ''").groupBy("_l", "_g").agg(F.count_distinct("_o").alias("_n"), F.min("_o").alias("_owner"))
    a = a.join(owners, ["_l", "_g"], "left")
    bare = (F.col("_o") == "") & (F.col("_g") == "")
    loose = F.concat(F.lit("l:"), F.col("_l"), F.lit("|"), F.col("_g"))
    single = F.concat(F.lit("n:"), F.col("pmid").cast("string"), F.lit(":"), F.col("idx").cast("string"))
    gid = F.when(F.col("_o") != "", F.concat(F.lit("o:"), F.col("_o"))).when(bare, single).when(F.col("_n") == 1, F.concat(F.lit("o:"), F.col("_owner"))).otherwise(loose)
    a = a.withColumns({"group_id": gid, "_bare": bare})
    fores = F.array_sort(F.array_distinct(F.filter(F.collect_set("_f"), lambda x: x != "")))
    per = a.groupBy("group_id").agg(fores.alias("_fs"), F.bool_or("_bare").alias("_b"), F.bool_or(F.coalesce(F.col("_n"), F.lit(0)) > 1).alias("_c"))
    # sorted forenames: all pairs are prefixes of each other exactly if each is a prefix of the next
    drift = F.forall(F.sequence(F.lit(0), F.greatest(F.size("_fs") - 2, F.lit(0))), lambda i: (F.size("_fs") < 2) | F.startswith(F.get("_fs", i + 1), F.get("_fs", i)))
    flags = F.array_compact(F.array(
        F.when(F.col("_b"), "incomplete_name"), F.when(F.col("_c"), "collision_confirmed"),
        F.when((F.size("_fs") > 1) & drift, "drift_benign"), F.when((F.size("_fs") > 1) & ~drift, "collision_suspected"),
    ))
    return a.join(per.select("group_id", flags.alias("flags")), "group_id").drop("_l", "_f", "_o", "_g", "_n", "_owner", "_bare")


def stratum(n_last: Column, n_first: Column, n: Column) -> Column:
    return F.when(n_last >= 1, "D").when(n_first >= 1, "A").when(n >= 2, "B").otherwise("C")


def affiliation_signal(affiliation: Column, keywords: list[str]) -> Column:
    """Aggregate: internal, external or unknown."""
    inside = F.bool_or((T.text(affiliation) != "") & affiliation_keyword(affiliation, keywords).isNotNull())
    return F.when(inside, "internal").when(F.bool_or(F.trim(T.text(affiliation)) != ""), "external").otherwise("unknown")


def people(apps: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    """apps(key, pmid, date_iso, year, is_first, is_last[, name, equal_contrib]) -> one row for each person with counts, years, censoring and stratum."""
    first, last = F.col("is_first"), F.col("is_last")
    p = apps.groupBy(key).agg(
        F.count("*").alias("n_appearances"), F.count_if(first).alias("n_first_slots"), F.count_if(last).alias("n_last_slots"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min("date_iso").alias("first_date"),
        F.min(F.when(first, F.col("year"))).alias("first_lead_year"), F.min(F.when(last, F.col("year"))).alias("first_last_year"),
        F.array_sort(F.collect_set("year")).alias("years"), F.array_sort(F.collect_set(F.when(first, F.col("year")))).alias("lead_years"),
    )
    return p.withColumns({
        "span_years": F.col("last_year") - F.col("first_year"), "left_censored": F.col("first_year") <= start, "right_censored": F.col("last_year") >= end - 1,
        "stratum": stratum(F.col("n_last_slots"), F.col("n_first_slots"), F.col("n_appearances")),
    })


def person_papers(apps: DataFrame, key: str) -> DataFrame:
    """key, pmids and first_slot_pmids, both by date and then id as text."""
    entry = F.struct("date_iso", F.col("pmid").cast("string").alias("pmid"))
    ids = lambda entries: F.transform(F.array_sort(entries), lambda e: e.pmid)
    return apps.groupBy(key).agg(ids(F.collect_list(entry)).alias("pmids"), ids(F.collect_list(F.when(F.col("is_first"), entry))).alias("first_slot_pmids"))


def key_counts(apps: DataFrame) -> DataFrame:
    """n_strict and n_loose: distinct (surname, forename) and (surname, first letter of the forename or initials), case and outer space aside."""
    low = lambda c: F.lower(F.trim(T.text(F.col(c))))
    given = F.coalesce(F.nullif(low("fore"), F.lit("")), low("initials"))
    return apps.agg(F.count_distinct(F.struct(low("last"), low("fore"))).alias("n_strict"), F.count_distinct(F.struct(low("last"), F.left(given, F.lit(1)))).alias("n_loose"))


def slot_lists(bylines: DataFrame, pi: DataFrame) -> DataFrame:
    """pmid, sole_author, slot0 of the papers with a single person who is not the investigator at its place, or with a consortium in front."""
    rows = person_index(bylines).join(pi.select("pmid", "pi_index"), "pmid", "left")
    at_first = F.bool_or((F.col("idx") == F.col("pi_index")) & (F.col("person_idx") == 0))
    per = rows.groupBy("pmid").agg(F.max("n_persons").alias("n"), F.coalesce(at_first, F.lit(False)).alias("pi_first"), F.bool_or((F.col("idx") == 0) & F.col("collective")).alias("slot0"))
    return per.select("pmid", ((F.col("n") == 1) & ~F.col("pi_first")).alias("sole_author"), "slot0").where("sole_author or slot0")


def display_names(apps: DataFrame, key: str) -> DataFrame:
    """The most frequent spelling; ties by length, then text."""
    n = apps.groupBy(key, "name").agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max_by("name", F.struct("n", F.length("name"), "name")).alias("name"))


def person_ids(people_: DataFrame, key: str) -> DataFrame:
    """person_id from 0 by (first_date, name, key), never by a count."""
    return positions(people_, "first_date", "name", key, name="person_id")


def build_people(apps: DataFrame, start: Column, end: Column, keywords: list[str] = ()) -> DataFrame:
    """apps(pmid, idx, name, last, fore, initials, orcid, affiliation, equal_contrib, date_iso, year, is_first, is_last[, evidence]) -> one row for each person with all that is known: group_id,
    person_id, name, counts, years, censoring, stratum, flags, affiliation signal, records by date, those led, and the evidence its records were chosen by."""
    grouped = stage(group_people(apps), "grouped")
    more = grouped.groupBy("group_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"), F.count_if("equal_contrib").alias("n_equal_contrib"), affiliation_signal(F.col("affiliation"), list(keywords)).alias("affiliation_signal"),
        *([F.array_sort(F.collect_set("evidence")).alias("evidence")] if "evidence" in apps.columns else []),
    )
    out = people(grouped, "group_id", start, end).join(display_names(grouped, "group_id"), "group_id").join(more, "group_id").join(person_papers(grouped, "group_id"), "group_id")
    return person_ids(out, "group_id")


def kept_and_counted(judged: DataFrame) -> DataFrame:
    """Kept records, then those that count in the records of a year only, which are the ones with too many authors: a union of both bags."""
    return judged.where("reason is null").unionByName(judged.where("reason = 'hyperauthorship'"))


def skipped(papers: DataFrame, matched: DataFrame) -> DataFrame:
    """The papers whose id is not among the matched, rows of null or empty id included."""
    return papers.join(matched.select("pmid").where("trim(cast(pmid as string)) <> ''").distinct(), "pmid", "left_anti")


def lead_strata(apps: DataFrame, people_: DataFrame, key: str) -> DataFrame:
    """pmid, stratum of the person in its lead slot."""
    return apps.where("is_first").select("pmid", key).join(people_.select(key, "stratum"), key).select("pmid", "stratum")


def flips(people_: DataFrame) -> DataFrame:
    return people_.where((F.col("stratum") == "D") & (F.col("n_first_slots") >= 1))
