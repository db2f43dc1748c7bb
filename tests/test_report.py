from codexa.operators.identity import Identity
from codexa.plans import report as R
from codexa.sources.schemas import PAPER

ME = Identity("Chen Xiu", "0000-0002-1825-0097", ["Nanhai"], ["@n.example.edu"])


def author(name, orcid="", email="", flag=False):
    last, _, fore = name.partition(" ")
    return (name, last, fore, fore[:1], "Nanhai Uni", email, orcid, bool(email), flag)


def paper(pmid, year, *authors, title=None, doi=""):
    return (pmid, title or f"Title {pmid}", list(authors), "", "J", f"{year} Jun", str(year), "", "", "", doi, "", "", int(pmid))


def corpus(spark, papers):
    return spark.createDataFrame(papers, PAPER + ", ord int")


def test_gates(spark):
    p = corpus(spark, [paper("1", 2020, author("Chen Xiu"))])
    assert R.check_gates(p, R.Query(900, 500), ME) == "G1" and R.check_gates(p, R.Query(fallback_fired=True), ME) == "G2"
    assert R.check_gates(p, R.Query(), Identity("Chen Xiu")) == "G3" and R.check_gates(corpus(spark, [paper("1", 2020)]), R.Query(), ME) == "G4"
    assert R.check_gates(p, R.Query(), ME) is None and R.check_source_path("a.XLSX") == "G4" and R.check_source_path("a.json") is None
    undated = corpus(spark, [(*paper("1", 2020, author("Chen Xiu"))[:5], "", *paper("1", 2020, author("Chen Xiu"))[6:])])
    assert R.build_report(undated, R.Query(), ME)["gate"] == "G5"


def test_report(spark):
    me, li = author("Chen Xiu", ME.orcid), author("Li Wei")
    rows = [paper("1", 2019, li, author("Bo A"), me), paper("2", 2020, author("Bo A"), li, me), paper("3", 2021, li, me, doi="10.1/x"), paper("4", 2021, li, me, doi="10.1/X"), paper("5", 2021, author("Li Weiwei"), me, title="Correction to: x")]
    out = R.build_report(corpus(spark, rows), R.Query(mindate="2018", maxdate="2022"), ME)
    m = out["metrics"]
    assert out["provenance"]["excluded"] == {"correction_or_comment": 1, "duplicate_doi": 1} and out["provenance"]["window"] == [2018, 2022]
    assert [r["name"] for r in m["roster"]["rows"]] == ["Bo A", "Li Wei"] and m["roster"]["denominator"] == 2
    assert m["pi_byline_positions"]["n_last"] == 3 and m["team_size"]["median"] is None and [r["n"] for r in m["records_per_year"]] == [0, 1, 1, 1, 0]
    assert "Profile of Chen Xiu" in R.render_markdown(out) and R.render_json(out).startswith("{")
    assert m["first_author_slots"]["rows"][0]["lead_name"] == "Li Wei" and m["first_author_slots"]["led_by_investigator"] == [] and m["roster"]["n_strict"] == 2
    assert [r["n"] for r in m["lead_slot_partition"]["counts"]] == [2, 0, 0] and m["time_to_lead"]["still_without_lead"] == [] and m["activity_span"]["single_appearances"] == 0
    text = R.render_markdown(out)
    assert text.count("still being indexed") == 1 and "## not reported" in text and not any("{" in c for c in out["caveats"])


def test_caveats_need_their_fields():
    import pytest

    with pytest.raises(KeyError):
        R.caveat("names", n_strict=1)
    assert {c for found in R.SECTION_CAVEATS.values() for c in found} <= set(R.CAVEATS)


def test_gathered_rows_are_those_of_each_frame(spark):
    from pyspark.sql import functions as F

    a = spark.createDataFrame([(3, None, 2.0), (1, "x", None), (1, "a", 1.5)], "n long, t string, d double")
    b = a.groupBy("n").agg(F.collect_list("t").alias("ts"), F.count("*").alias("k"))
    got = R.gather({"a": (a, ["n", "t"]), "b": (b, ["-k"]), "none": (a.limit(0), [])})
    assert got["a"] == [{"n": 1, "t": "a", "d": 1.5}, {"n": 1, "t": "x", "d": None}, {"n": 3, "t": None, "d": 2.0}] and got["none"] == []
    assert [(r["n"], sorted(r["ts"]), r["k"]) for r in got["b"]] == [(1, ["a", "x"], 2), (3, [], 1)]


def test_sections_have_bodies(spark):
    """A corpus above the floors: every section says its own."""
    me = author("Chen Xiu", ME.orcid)
    people = [author(f"P{i} Name{'abcdefghijkl'[i]}", email=f"p{i}@n.example.edu" if i % 2 else "") for i in range(12)]
    rows = [paper(str(100 + k), 2010 + k % 9, *( [people[k % 7]] if k % 11 else [me]), people[(k * 5 + 1) % 12], author("Flag Ged", flag=True), me, title=f"Work {k % 30}") for k in range(40)]
    out = R.build_report(corpus(spark, rows), R.Query(mindate="2010", maxdate="2018"), ME, exclude=["P11 Namel"])
    text = R.render_markdown(out)
    assert set(R.SECTIONS) == set(out["metrics"]) and all(f"## {title}" in text for title, _ in R.SECTIONS.values())
    m = out["metrics"]
    for line in (
        f"{m['roster']['denominator']} people besides the investigator", "- leads: ", f"Median {R._cell(m['team_size']['median'])} over 40 records", "Years from the first record to the first one led.", "40 records carry the flag.",
        "40 records.", "- J: 40 records", "- `Nanhai Uni`: 40", "**2010**", "- equal titles, not merged: ", "- names left out on request: P11 Namel", "These are counts; no rate is made of them.", "records with any address of electronic mail",
    ):
        assert line in text, line
    assert len(R.NOT_REPORTED) == 17 and "P11 Namel" not in [r["name"] for r in m["roster"]["rows"]]
    assert sum(r["n"] for r in m["lead_slot_partition"]["counts"]) == sum(r["stratum"] in "AB" for r in m["roster"]["rows"])
    assert "{" not in text.split("## caveats")[0].replace("{'", "")
