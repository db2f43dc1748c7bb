from pyspark.sql import functions as F

from codexa.operators import identity as I

BYLINE = "pmid string, idx int, name string, last string, fore string, initials string, affiliation string, email string, orcid string, equal_contrib boolean, is_corresponding boolean"


def person(pmid, idx, last, fore="", orcid="", affiliation="", email=""):
    return (pmid, idx, f"{last} {fore}".strip(), last, fore, fore[:1], affiliation, email, orcid, False, bool(email))


def groups(spark, *rows):
    b = spark.createDataFrame(list(rows), BYLINE)
    return {(r["pmid"], r["idx"]): (r["group_id"], sorted(r["flags"])) for r in I.group_people(b).collect()}


def test_grouping_rules(spark):
    same = groups(spark, person("1", 0, "Li", "Wei"), person("2", 0, "Li", "Weiwei"))
    assert len({g for g, _ in same.values()}) == 1 and same["1", 0][1] == ["drift_benign"]
    assert groups(spark, person("1", 0, "Li", "Wei"), person("2", 0, "Li", "Wenjie"))["1", 0][1] == ["collision_suspected"]
    assert groups(spark, person("1", 0, "Li"), person("2", 0, "Li"))["1", 0][1] == ["incomplete_name"]
    one = groups(spark, person("1", 0, "Li", "Wei", "o1"), person("2", 0, "Li", "W"))
    assert one["1", 0][0] == one["2", 0][0] == "o:o1"
    two = groups(spark, person("1", 0, "Li", "Wei", "o1"), person("2", 0, "Li", "Wen", "o2"), person("3", 0, "Li", "W"))
    assert len({g for g, _ in two.values()}) == 3 and "collision_confirmed" in two["3", 0][1]


def test_pi_by_evidence_then_index(spark):
    c = spark.createDataFrame([("1", 4, "orcid"), ("1", 0, "email"), ("2", 3, "email"), ("2", 1, "email"), ("3", 0, "name_only")], "pmid string, idx int, tier string")
    got = {r["pmid"]: (r["pi_index"], r["pi_evidence"], r["pi_ambiguous"]) for r in I.resolve_pi(c).collect()}
    assert got == {"1": (4, "orcid", False), "2": (1, "email", True), "3": (0, "name_only", False)}


def test_exclusions_take_the_first_reason(spark):
    rows = [
        ("10", 0, "x", "1900-01-01", "", 1, 1), ("11", 1, "Correction to: y", "2020-01-01", "", 1, 1), ("12", 2, "Corrective surgery", "2020-01-01", "10.1/A", 1, 1),
        ("12", 3, "x", "2020-01-01", "", 1, 1), ("9", 4, "x", "2020-01-01", "10.1/a", 1, 1), ("13", 5, "x", "2020-01-01", "", 0, 0), ("14", 6, "x", "2020-01-01", "", 62, 62), ("15", 7, "x", "2020-01-01", "", 22, 22),
    ]
    p = spark.createDataFrame(rows, "pmid string, ord int, title string, date_iso string, doi string, n_authors int, n_persons int")
    got = {r["ord"]: r["reason"] for r in I.exclusions(p).collect()}
    assert got == {0: "unparseable_date", 1: "correction_or_comment", 2: "duplicate_doi", 3: "duplicate_pmid", 4: None, 5: "empty_author_list", 6: "hyperauthorship", 7: None}


def test_leading_consortium_takes_the_lead_slot(spark):
    group = ("1", 0, "The Group", "", "", "", "", "", "", False, False)
    b = spark.createDataFrame([group, person("1", 1, "Li", "A"), person("1", 2, "Bo", "B")], BYLINE)
    pi = spark.createDataFrame([], "pmid string, pi_index int")
    got = {r["idx"]: (r["is_first"], r["is_last"]) for r in I.appearances(b, pi).collect()}
    assert got == {1: (False, False), 2: (False, True)}


def test_strata(spark):
    rows = spark.createDataFrame([(1, 1, 1, "D"), (0, 1, 1, "A"), (0, 0, 2, "B"), (0, 0, 1, "C")], "l int, f int, n int, s string")
    assert rows.where(I.stratum(F.col("l"), F.col("f"), F.col("n")) != F.col("s")).count() == 0
