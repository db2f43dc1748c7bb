"""The profile report: gates, preparation, exclusions, people, metrics, Markdown and JSON.

Only small results reach the driver: metric rows of one author's corpus and flags. Records and bylines stay DataFrames.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.functions import text as T
from codexa.operators import identity as I
from codexa.operators import metrics as M
from codexa.sources.readers import bylines
from codexa.staging import drop, stage

GATES = {
    "G1": "the search matched more records than it returned",
    "G2": "the affiliation filter fell back to names",
    "G3": "no ORCID, affiliation keyword or e-mail domain identifies the author",
    "G4": "the source has records without a usable author list",
    "G5": "no record is left after exclusions",
}
# what a reader must know, in the order of the sections; holes are filled when a caveat is asked for
CAVEATS = {
    "scope": "Only published records are described. Whoever left without a record is in no number here, and nothing is said of advice, money, hours, degrees or careers.",
    "unlocated": "{n} records have no located investigator.",
    "unproven": "{n} further records carry the name without evidence and are left out; earlier ones under another institution are lost this way unless its name is given.",
    "names": "People are told apart by name: {n_strict} by surname and forename, {n_loose} by surname and initial. Each count of people is uncertain by the difference.",
    "positions": "Strata follow from places in bylines. They say nothing about anybody's post.",
    "slots": "Slots on records are counted, not people: a few busy people may hold most of them.",
    "own_records": "Records without the investigator are not in the corpus, so work led elsewhere is not seen.",
    "published_only": "People without a record are in none of the buckets; their shares are no odds.",
    "delay": "Dates are those of publication, a year or two after the work.",
    "reached": "Lags are of those who reached a lead slot; those still without one stand beside them.",
    "span": "A span lies between two dates of publication. It is not the time spent in the group.",
    "censored": "Spans that touch an edge of the window are lower bounds; the median is of complete ones only and so leans to short stays (window of {years} years).",
    "either_way": "A short span fits a quick success and an early departure alike.",
    "not_staff": "People with a record in a year are not the staff of that year, and co-authors may work elsewhere.",
    "filtered": "Not measured: the records were chosen by the investigator's place in the byline.",
    "senior_last": "That the last author is the senior one is a custom, which not every department follows.",
    "email": "Corresponding authors are known by an e-mail address in the affiliation, here on {covered} of {total} records.",
    "flags": "Equal contribution is known only where the publisher says so; a zero proves nothing, and no rate is given.",
    "indexing": "The first and last years are partial and the last two of the window are still being indexed.",
    "all_types": "Records of all types are counted: reviews and letters beside research, but for titles that name a correction.",
    "team": "Neither a small nor a large team is better by itself.",
    "venues": "Journal names are compared as written; no measure of journals is used.",
    "affiliations": "Affiliations are texts, not institutions; older records often have only that of the first author, so years do not compare.",
    "titles": "Titles are given as they are and are not sorted by topic.",
    "small": "Fewer than {floor} cases: no aggregate is given, the rows are.",
}
SECTION_CAVEATS = {
    "roster": ["names", "positions"], "first_author_slots": ["slots", "own_records"], "lead_slot_partition": ["published_only"], "time_to_lead": ["delay", "reached"],
    "activity_span": ["span", "censored", "either_way"], "roster_turnover": ["not_staff"], "pi_byline_positions": ["filtered", "senior_last", "email", "unlocated"], "equal_contrib": ["flags"],
    "records_per_year": ["indexing", "all_types"], "team_size": ["team"], "venues": ["venues"], "affiliations": ["affiliations"], "titles": ["titles"], "flips": ["names", "senior_last"],
}
# measure and why the report has none
NOT_REPORTED = {
    "shift of topics": "there are no subject terms, which would lag behind the newest year anyhow, and words of titles follow fashion; the titles stand by year instead",
    "charts of topics": "topics come from a file that is made elsewhere, for the fields of one laboratory",
    "number of partner institutions": "affiliations are free text; their spellings would be counted, and the number would be taken for prestige",
    "share of work with outside partners": "it depends on the years of which addresses are known, and joint posts hide inside one text",
    "share of people who come to lead": "those without a record are not in the denominator, so the share would flatter and be read as odds",
    "rate of shared first places": "publishers deliver the flag or not, by no known rule",
    "records per person as a mean": "one busy person decides it, and it reads as a mark for each",
    "rate of corresponding authors": "it depends on whether journals print addresses, so it stands only beside its coverage",
    "citations and indices": "the records hold none, and people are not ranked",
    "impact factors, quartiles and lists of journals": "a journal says nothing sure about a paper in it",
    "scores, weights and grades": "no data justify the weights",
    "attrition and time to a degree": "nobody knows from records who joined, left or graduated",
    "fairness in credit": "no field tells who did what",
    "trends and percent changes": "a few partial years carry no slope",
    "kinds of posts": "no field tells students, fellows and staff apart",
    "seniority by length of stay": "any limit assumes how long a degree takes and drops those who stayed longest",
    "cohorts by affiliation": "older records have the first author's affiliation only, so people would be lost by the age of a record",
}
LABELS = {"A": "leads", "B": "takes part", "C": "one record", "D": "senior", "unclassified": "not classified"}


@dataclass
class Query:
    esearch_count: int = 0
    pmids_returned: int = 0
    mindate: str = ""
    maxdate: str = ""
    fallback_fired: bool = False
    position_filtered: bool = False


def check_source_path(path: str) -> str | None:
    """Spreadsheets are refused by their suffix: they carry no byline flags."""
    return "G4" if re.search(r"(?i)\.(xlsx|xlsm|xls|csv)$", path) else None


def check_gates(papers: DataFrame, query: Query, who: I.Identity) -> str | None:
    if query.esearch_count > query.pmids_returned:
        return "G1"
    if query.fallback_fired:
        return "G2"
    if not (who.orcid.strip() or who.affiliations or who.domains):
        return "G3"
    bare = papers.where(F.col("authors").isNull() | (F.size("authors") == 0)).limit(1).count()
    return "G4" if bare else None


def caveat(key: str, **fields) -> str:
    """A missing field is an error, not a hole."""
    return CAVEATS[key].format(**fields)


def prepare(papers: DataFrame, who: I.Identity) -> tuple[DataFrame, DataFrame]:
    """(records, entries): papers with dates, counts and the investigator; bylines with person indices."""
    entries = I.person_index(bylines(papers))
    pi = I.resolve_pi(entries.where(I.name_matches(who.name)).select("pmid", "idx", I.evidence_tier(who).alias("tier")))
    per = entries.groupBy("pmid").agg(
        F.count("*").cast("int").alias("n_authors"), F.max("n_persons").alias("n_persons"), F.bool_or((F.col("idx") == 0) & F.col("collective")).alias("slot0"),
        F.bool_or(~F.col("collective") & (F.trim("email") != "")).alias("any_email"),
    )
    place = entries.join(pi.select("pmid", F.col("pi_index").alias("idx")), ["pmid", "idx"]).select("pmid", F.col("person_idx").alias("pi_person_index"), F.col("is_corresponding").alias("pi_corresponding"))
    date = T.date_iso(F.col("pub_date"))
    recs = papers.select("pmid", "ord", "title", "journal", "doi", date.alias("date_iso")).withColumn("year", F.substring("date_iso", 1, 4).cast("int"))
    recs = recs.join(per, "pmid", "left").join(pi, "pmid", "left").join(place, "pmid", "left")
    return recs.na.fill(0, ["n_authors", "n_persons"]).na.fill(False, ["slot0", "any_email"]), entries


def window(query: Query, kept: DataFrame) -> tuple[int, int]:
    """Bounds from the query, else from the data; the end is not before the start."""
    found = [re.search(r"\d{4}", x or "") for x in (query.mindate, query.maxdate)]
    lo, hi = kept.agg(F.min("year"), F.max("year")).first()
    start = int(found[0][0]) if found[0] else lo or 0
    end = int(found[1][0]) if found[1] else hi or start
    return start, max(start, end)


def gather(frames: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, list[dict]]:
    """The rows of several small results, each by its own columns ("-": falling), fetched by one job: as JSON under their names, in one union."""
    parts = [df.select(F.lit(name).alias("name"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")) for name, (df, _) in frames.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    found: dict[str, list[dict]] = {name: [] for name in frames}
    for name, row in whole.collect():
        found[name].append(json.loads(row))
    for name, (_, order) in frames.items():
        for column in reversed(order):
            bare = column.lstrip("-")
            found[name].sort(key=lambda r: (r[bare] is not None, r[bare] if r[bare] is not None else 0), reverse=column != bare)  # noqa: B023
    return found


def build_report(papers: DataFrame, query: Query, who: I.Identity, exclude: list[str] = (), lag: int = 3, generated_at: str = "") -> dict:
    """A dict with refused, gate, provenance and metrics; a refusal carries no metrics."""
    report = {"schema_version": 1, "generated_at": generated_at, "author_name": who.name, "refused": False, "gate": None, "metrics": {}, "caveats": []}
    gate = check_gates(papers, query, who)
    if not gate:
        recs, entries = prepare(papers, who)
        judged = I.exclusions(recs)
        kept = judged.where("reason is null")
        gate = None if kept.limit(1).count() else "G5"
    if gate:
        return report | {"refused": True, "gate": gate, "reason": GATES[gate]}
    judged = stage(judged, "judged")
    kept = judged.where("reason is null")
    start, end = window(query, kept)
    own = stage(entries.join(kept.select("pmid", "date_iso", "year", "pi_index"), "pmid"), "entries")  # all that follows reads this table
    bare = own.drop("pi_index", "collective", "person_idx", "n_persons")
    apps = stage(I.group_people(I.appearances(bare, kept.select("pmid", "pi_index"), list(exclude))), "appearances")
    people = I.people(apps, "group_id", F.lit(start), F.lit(end)).join(I.display_names(apps, "group_id"), "group_id")
    extra = apps.groupBy("group_id").agg(
        F.array_distinct(F.flatten(F.collect_list("flags"))).alias("flags"),
        I.affiliation_signal(F.col("affiliation"), who.affiliations).alias("affiliation_signal"), F.count_if("equal_contrib").alias("n_equal_contrib"),
    )
    people = stage(I.person_ids(people.join(extra, "group_id"), "group_id"), "people")
    lead = I.lead_strata(apps, people, "group_id")
    both = I.kept_and_counted(judged)
    lags, lag_summary = M.time_to_lead(people)
    venues, venue_counts = M.venue_repetition(kept)
    persons = own.where("not collective")
    eligible = kept.where("not slot0 and (pi_index is null or pi_index <> 0)")
    leaders = eligible.select("pmid", "year").join(persons.where("person_idx = 0").select("pmid", F.col("name").alias("lead_name")), "pmid", "left").join(lead, "pmid", "left")
    leaders = leaders.select("pmid", "year", "lead_name", F.coalesce("stratum", F.lit("unclassified")).alias("stratum"))
    held = M.lag_rows(people, F.lit(end), lag)
    single = I.slot_lists(bare, kept.select("pmid", "pi_index"))
    of_stratum = people.where("stratum in ('A', 'B')")
    found = gather({
        "strata": (M.strata_counts(people), []), "keys": (I.key_counts(apps), []), "sole": (single.where("sole_author").select("pmid"), ["pmid"]),
        "roster": (people.select("person_id", "name", "stratum", "n_appearances", "n_first_slots", "n_equal_contrib", "first_year", "last_year", "left_censored", "right_censored", "flags", "affiliation_signal"), ["person_id"]),
        "slots": (M.first_author_slots(eligible.select("pmid"), lead), []), "leaders": (leaders, ["pmid"]), "behind": (kept.where("slot0").select("pmid"), ["pmid"]), "led": (kept.where("not slot0 and pi_index = 0").select("pmid"), ["pmid"]),
        "partition": (M.lead_slot_partition(people, F.lit(end), lag), []), "held": (held, ["row", "name"]), "lag": (lag_summary, []), "lags": (lags, ["lag"]), "span": (M.activity_span(people), []),
        "spans": (of_stratum.select("name", "span_years", "first_year", "last_year", "left_censored", "right_censored"), ["name"]), "turnover": (M.roster_turnover(people, start, end), ["year"]),
        "positions": (M.pi_byline_positions(kept, query.position_filtered), []), "equal": (M.equal_contrib_occurrences(persons), ["pmid"]), "years": (M.records_per_year(both, start, end), ["year"]),
        "team": (M.team_size(kept), []), "large": (M.large_teams(kept).select("pmid"), ["pmid"]), "trainees": (M.team_size_subset(kept, lead), []), "venue": (venue_counts, []), "venues": (venues, ["-n", "journal"]),
        "strings": (M.affiliation_strings(persons), ["-n_papers", "affiliation"]), "coverage": (M.affiliation_coverage(persons, start, end), ["year"]), "titles": (M.titles_by_year(kept), ["year"]),
        "flips": (I.flips(people).select("name", "first_lead_year", "first_last_year"), ["name"]),
        "excluded": (judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("pmid")).alias("pmids")), ["reason"]),
        "evidence": (kept.groupBy(F.coalesce("pi_evidence", F.lit("unlocated")).alias("e")).agg(F.count("*").alias("n")), ["e"]),
        "same_title": (I.title_duplicates(kept), ["title_key"]), "ambiguous": (kept.where("coalesce(pi_ambiguous, false)").select("pmid"), ["pmid"]),
    })
    one, ids = (lambda k: found[k][0]), (lambda k: [r["pmid"] for r in found[k]])
    keys = one("keys")
    report["metrics"] = {
        "roster": {**one("strata"), **keys, "sole_author": ids("sole"), "rows": found["roster"]},
        "first_author_slots": {**one("slots"), "rows": found["leaders"], "behind_consortium": ids("behind"), "led_by_investigator": ids("led")},
        "lead_slot_partition": {"lag_years": lag, "counts": found["partition"], "rows": found["held"]},
        "time_to_lead": {**one("lag"), "distribution": found["lags"], "values": [{"name": r["name"], "years": r["value"]} for r in found["held"] if r["row"] == "lead"], "still_without_lead": [{"name": r["name"], "years": r["value"]} for r in found["held"] if r["row"] == "waiting"]},
        "activity_span": {**one("span"), "single_appearances": sum(r["stratum"] == "C" for r in found["roster"]), "rows": found["spans"]},
        "roster_turnover": found["turnover"],
        "pi_byline_positions": one("positions"),
        "equal_contrib": found["equal"],
        "records_per_year": found["years"],
        "team_size": {**one("team"), "large": ids("large"), "led_by_trainees": one("trainees")},
        "venues": {**one("venue"), "repeated": found["venues"]},
        "affiliations": {"strings": found["strings"], "coverage": found["coverage"]},
        "titles": found["titles"],
        "flips": found["flips"],
    }
    report["provenance"] = {
        "window": [start, end], "matched": query.esearch_count, "returned": query.pmids_returned, "excluded": {r["reason"]: r["n"] for r in found["excluded"]}, "excluded_records": {r["reason"]: r["pmids"] for r in found["excluded"]},
        "evidence": {r["e"]: r["n"] for r in found["evidence"]}, "title_duplicates": found["same_title"], "ambiguous": ids("ambiguous"), "excluded_names": sorted(x for x in exclude if x),
    }
    m = report["metrics"]
    place = m["pi_byline_positions"]
    unproven = report["provenance"]["evidence"].get("name_only", 0)
    fields = {
        "names": keys, "censored": {"years": end - start + 1}, "email": {"covered": place["email_papers"], "total": place["denominator"]}, "unlocated": {"n": place["n_unlocated"]},
        "unproven": {"n": unproven}, "small": {"floor": M.AGG_FLOOR},
    }
    absent = {"filtered": not query.position_filtered, "unlocated": not place["n_unlocated"], "unproven": not unproven}
    say = lambda *names: [caveat(n, **fields.get(n, {})) for n in names if not absent.get(n)]
    small = [name for name, v in m.items() if isinstance(v, dict) and (v.get("suppressed") or 0 < v.get("denominator", M.AGG_FLOOR) < M.AGG_FLOOR)]
    report["section_caveats"] = {name: say(*SECTION_CAVEATS[name], *(["small"] if name in small else [])) for name in m}
    report["caveats"] = list(dict.fromkeys([*say("scope", "unproven"), *(x for found in report["section_caveats"].values() for x in found)]))
    report["not_reported"] = dict(NOT_REPORTED)
    drop(judged, own, apps, people)
    return report


def _cell(v) -> str:
    if v is None:
        return "n/a"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.1f}"
    return ", ".join(map(_cell, v)) if isinstance(v, list) else str(v)


def _table(rows: list[dict]) -> list[str]:
    if not rows:
        return ["No rows.", ""]
    head = list(rows[0])
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(_cell(r[c]) for c in head) + " |" for r in rows), ""]


def _ids(pmids: list) -> str:
    return ", ".join(pmids) or "none"


def _share(n: int, of: int, pct=None) -> str:
    return f"{n} of {of}" + (f" ({pct} %)" if pct is not None else "")


def _spread(m: dict, what: str) -> str:
    """Median with quartiles, or that there are too few cases."""
    if m.get("median") is None:
        return f"{m['denominator']} {what}: too few for a median."
    return f"Median {_cell(m['median'])} over {m['denominator']} {what}" + (f"; middle half {_cell(m['q1'])} to {_cell(m['q3'])}" if m.get("q1") is not None else "") + (f"; from {m['least']} to {m['most']}" if m.get("most") is not None else "") + "."


def _roster(m: dict) -> list[str]:
    edge = lambda r: " and ".join(x for x, hit in (("start", r["left_censored"]), ("end", r["right_censored"])) if hit) or "none"
    rows = [{"person": r["name"], "place": LABELS[r["stratum"]], "affiliation": r["affiliation_signal"], "records": r["n_appearances"], "first places": r["n_first_slots"], "shared": r["n_equal_contrib"], "from": r["first_year"], "to": r["last_year"], "touches": edge(r), "notes": r["flags"]} for r in m["rows"]]
    by = ", ".join(f"{LABELS[x]} {m[f'n_{x.lower()}']}" for x in "ABCD")
    return [f"{m['denominator']} people besides the investigator, groups and names left out on request, by first record and then name, never by a count.", "", *_table(rows), f"- {by}", f"- written by one person alone: {_ids(m['sole_author'])}", ""]


def _slots(m: dict) -> list[str]:
    out = []
    if not m["denominator"]:
        out.append("The investigator leads every record that could count.")
    elif m.get("suppressed"):
        out += ["Too few records for shares; they stand here one by one.", "", *_table([{"record": r["pmid"], "year": r["year"], "first": r["lead_name"], "place": LABELS[r["stratum"]]} for r in m["rows"]])]
    else:
        out += [f"- {LABELS[x]}: {_share(m[f'n_{x.lower()}'], m['denominator'], m.get(f'pct_{x.lower()}'))} records" for x in ("A", "B", "C", "D", "unclassified")]
    return [*out, f"- not counted, as the investigator leads: {_ids(m['led_by_investigator'])}", f"- not counted, as a group stands first: {_ids(m['behind_consortium'])}", ""]


def _partition(m: dict) -> list[str]:
    says = {"holds_lead": "have led a record", "observed_without_lead": f"have not, though seen for {m['lag_years']} years or more", "too_recent": f"came in the last {m['lag_years']} years, too late to tell"}
    total = sum(r["n"] for r in m["counts"])
    return [*[f"- {says[r['bucket']]}: {_share(r['n'], total)}" for r in m["counts"]], "", "These are counts; no rate is made of them.", ""]


def _time(m: dict) -> list[str]:
    if not m["denominator"]:
        out = ["Nobody in this corpus has a first place."]
    else:
        out = ["Years from the first record to the first one led.", "", *[f"- {r['lag']}: {_share(r['n'], m['denominator'])} people" for r in m["distribution"]], f"- of these at once: {m['at_zero']}", "", _spread(m, "people")]
        out += [f"- {r['name']}: {r['years']}" for r in m["values"]] if m.get("median") is None else []
    return [*out, "", "Still without one:", *([f"- {r['name']}: seen for {r['years']} years" for r in m["still_without_lead"]] or ["- none"]), ""]


def _span(m: dict) -> list[str]:
    kind = lambda r: "complete" if not (r["left_censored"] or r["right_censored"]) else "lower bound"
    span = lambda r: "same year" if not r["span_years"] else f"{r['span_years']} years"
    numbers = [f"- {k.replace('_', ' ')}: {_cell(v)}" for k, v in m.items() if not isinstance(v, (list, dict)) and k not in ("median", "q1", "q3")]
    return [*numbers, "", _spread(m, "complete spans") if "denominator" in m else "", "", *[f"- {r['name']}: {span(r)}, {r['first_year']} to {r['last_year']}, {kind(r)}" for r in m["rows"]], ""]


def _turnover(rows: list[dict]) -> list[str]:
    return _table([{k.replace("_", " "): v for k, v in r.items()} for r in rows])


def _places(m: dict) -> list[str]:
    if m.get("n_last") is None:
        return ["Not measured here.", ""]
    total = m["denominator"]
    out = [f"- {k[2:].replace('_', ' ')}: {_share(v, total, m.get('pct_' + k[2:]))} records" for k, v in m.items() if k.startswith("n_") and isinstance(v, int)]
    return [*out, f"- records with any address of electronic mail: {_share(m['email_papers'], total)}", ""]


def _equal(rows: list[dict]) -> list[str]:
    return [f"{len(rows)} records carry the flag.", "", *_table([{k.replace("_", " "): v for k, v in r.items() if not isinstance(v, list)} for r in rows])] if rows else ["No record carries the flag.", ""]


def _years(rows: list[dict]) -> list[str]:
    notes = lambda r: "; ".join(k.replace("_", " ") for k, v in r.items() if v is True)
    return [f"{sum(r['n'] for r in rows)} records.", "", *[f"- {r['year']}: {r['n']}" + (f" ({notes(r)})" if notes(r) else "") for r in rows], ""]


def _team(m: dict) -> list[str]:
    return [_spread(m, "records"), "", f"- large teams: {_ids(m['large'])}", f"- led by those who lead or take part: {_spread(m['led_by_trainees'], 'records')}", ""]


def _venues(m: dict) -> list[str]:
    numbers = [f"- {k.replace('_', ' ')}: {_cell(v)}" for k, v in m.items() if not isinstance(v, list)]
    return ["Journals as they are written.", "", *([f"- {r['journal']}: {r['n']} records" for r in m["repeated"]] or ["- none stands twice"]), *numbers, ""]


def _affiliations(m: dict) -> list[str]:
    cover = lambda r: _share(r["covered"], r["total"]) + " entries" if r["covered"] else "none known"
    return ["Texts that stand on several records, as written:", *([f"- `{r['affiliation']}`: {r['n_papers']}" for r in m["strings"]] or ["- none"]), "", "Entries with any affiliation:", *[f"- {r['year']}: {cover(r)}" for r in m["coverage"]], ""]


def _titles(rows: list[dict]) -> list[str]:
    out = []
    for r in rows:
        out += [f"**{r['year']}**", *[f"- {t['title']} ({t['pmid']})" for t in r["titles"]], ""]
    return out


def _flips(rows: list[dict]) -> list[str]:
    return [*([f"- {r['name']}: first place from {r['first_lead_year']}, last place from {r['first_last_year']}" for r in rows] or ["- nobody in this window"]), ""]


#: Section -> title and body.
SECTIONS = {
    "roster": ("People", _roster), "first_author_slots": ("Who stands first", _slots), "lead_slot_partition": ("Who has ever stood first", _partition), "time_to_lead": ("Years until the first place", _time), "activity_span": ("Spans of records", _span),
    "roster_turnover": ("Arrivals and last records", _turnover), "pi_byline_positions": ("Places of the investigator", _places), "equal_contrib": ("Equal contribution", _equal), "records_per_year": ("Records by year", _years), "team_size": ("Authors of a record", _team),
    "venues": ("Journals", _venues), "affiliations": ("Affiliations", _affiliations), "titles": ("Titles by year", _titles), "flips": ("From first to last place", _flips),
}


def _origin(p: dict) -> list[str]:
    out = [f"- years {p['window'][0]} to {p['window'][1]}", f"- matched {p['matched']}, returned {p['returned']}", "- located by: " + (", ".join(f"{k} {v}" for k, v in p["evidence"].items()) or "nothing")]
    out += [f"- left out, {k.replace('_', ' ')}: {p['excluded'][k]} ({_ids(v)})" for k, v in p["excluded_records"].items()]
    same = "; ".join(str(r.get("pmids") or r) for r in p["title_duplicates"]) or "none"
    return [*out, f"- equal titles, not merged: {same}", f"- several entries fit the investigator: {_ids(p['ambiguous'])}", f"- names left out on request: {_ids(p['excluded_names'])}", ""]


def render_markdown(report: dict) -> str:
    """Provenance, a section for each metric with its caveats, each caveat once, and what is not reported."""
    out = [f"# Profile of {report['author_name']}", ""]
    if report["refused"]:
        return "\n".join([*out, f"Refused ({report['gate']}): {report['reason']}.", ""])
    out += ["## Where the records come from", "", *_origin(report["provenance"])]
    said: set[str] = set()
    for name, metric in report["metrics"].items():
        title, body = SECTIONS[name]
        new = [c for c in report["section_caveats"][name] if c not in said]
        said.update(new)
        out += [f"## {title}", "", *body(metric), *[f"> {c}" for c in new], *([""] if new else [])]
    rest = [c for c in report["caveats"] if c not in said]
    return "\n".join([*out, "## caveats", "", *[f"- {c}" for c in rest], "", "## not reported", "", *[f"- {k}: {v}" for k, v in report["not_reported"].items()], ""])


def render_json(report: dict) -> str:
    return json.dumps(report, indent=1, default=str)
