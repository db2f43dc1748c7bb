from codexa.operators import analyze, cache, metrics, verify
from codexa.sources import readers
from codexa.sources.bibtex import parse_bibtex

BIB = r"""@string{jx = "J. X"}
% a comment
@article{a1, title={A {Nested} T\"{o}st}, author="Li, W and Bo, C", journal=jx # { Sup}, year=2020, pages={12--19}, doi={https://doi.org/10.1/AbC}, note={PMID: 123}}
@book(b2, title = {Broken, year = {1999}
@misc{c3, pmid={12x}, title={ok}}
"""
XML = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>5</PMID><Article><Journal><JournalIssue><Volume>3</Volume><PubDate><Year>2023</Year><Month>Jun</Month></PubDate></JournalIssue><Title>J</Title></Journal>
<ArticleTitle>The <i>X</i> role</ArticleTitle><Abstract><AbstractText Label="AIM">See.</AbstractText><AbstractText>Go.</AbstractText></Abstract><AuthorList><Author EqualContrib="Y"><LastName>Li</LastName><ForeName>Wei</ForeName><Initials>W</Initials>
<Identifier Source="ORCID">0000-0002-1825-0097</Identifier><AffiliationInfo><Affiliation>Uni. w@u.edu.</Affiliation></AffiliationInfo></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList>
<ELocationID EIdType="doi">10.1/z</ELocationID></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_bibtex():
    a, b, c = parse_bibtex(BIB)
    assert (a["title"], a["first_author"], a["journal"], a["pages"], a["doi"], a["pmid"]) == ("A Nested Tost", "Li, W", "J. X Sup", "12-19", "10.1/AbC", "123")
    assert (b["key"], c["key"], c["pmid"]) == ("b2", "c3", "")


def test_article_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    r = readers.parse_articles(readers.articles_xml(spark, str(tmp_path / "a.xml"))).first()
    assert (r["pmid"], r["title"], r["pub_date"], r["doi"], r["abstract"], r["authors_str"]) == ("5", "The X role", "2023 Jun", "10.1/z", "AIM: See. Go.", "Li Wei, Group")
    w = r["authors"][0]
    assert (w["orcid"], w["email"], w["equal_contrib"], w["is_corresponding"]) == ("0000-0002-1825-0097", "w@u.edu", True, True)


def test_refs_and_lookup_json(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"entries": [{"title": "T", "year": 2020, "odd": 1}, {"key": "k"}]}')
    rows = readers.refs_json(spark, str(tmp_path / "r.json")).orderBy("ord").collect()
    assert [(r["key"], r["year"], r["entry_type"]) for r in rows] == [("ref1", "2020", "article"), ("k", "", "article")]
    works = spark.createDataFrame([('{"DOI":"10.1/x","title":["T"],"author":[{"family":"Li","given":"W"}],"issued":{"date-parts":[[2020,1]]}}',)], "value string")
    r = readers.crossref_json(works).first()
    assert (r["doi"], r["first_author"], r["year"], r["journal"]) == ("10.1/x", "Li", "2020", "")


def test_verify_statuses(spark):
    from codexa.sources import schemas as S

    ref = lambda k, doi="", pmid="", year="2020": (k, "A study of things", "Li W", year, "", "", "", "", doi, pmid, "article")
    refs = spark.createDataFrame([ref("ok", "10.1/a", "1"), ref("year", "10.1/a", "1", "1999"), ref("gone", "10.9/none"), ref("conflict", "10.1/a", "2"), ref("slow", "10.1/slow", "1"), ref("late", "10.1/slow"), ref("bare"), ref("none", year="1999")], S.REFERENCE)
    cr = lambda doi, error=None: (doi, "A study of things", "Li", ["Li"], "2020", "", "", "", "", "article", error)
    cross = spark.createDataFrame([cr("10.1/a"), cr("10.1/slow", "timeout")], S.CROSSREF)
    link = spark.createDataFrame([("10.1/a", "1", None)], S.DOI_PMID)
    pub = spark.createDataFrame([(p, d, "A study of things", "Li W", ["Li W"], "2020", "", "", "", "", None) for p, d in (("1", "10.1/a"), ("2", "10.1/b"))], S.PUBMED)
    v = verify.verify(refs, cross, link, pub)
    got = {r["key"]: r for r in v.collect()}
    # an unregistered DOI is an error of the lookup as well; a failed lookup is partial where the title leads to a record
    assert {k: r["status"] for k, r in got.items()} == {"ok": "verified", "year": "mismatch", "gone": "error", "conflict": "mismatch", "slow": "mismatch", "late": "partial", "bare": "verified", "none": "mismatch"}
    assert {i["severity"] for i in got["conflict"]["issues"]} == {"conflict"} and got["slow"]["errors"] == got["late"]["errors"] == ["crossref lookup failed"]
    text = verify.render_markdown(v)
    assert [t for t, _, _ in verify.SECTIONS.values() if f"## {t}" in text] == [verify.SECTIONS[s][0] for s in ("conflict", "missing", "mismatch", "partial")]
    assert "| gone | doi | 10.9/none |" in text and "| late | crossref lookup failed |" in text and "- incomplete: 3" in text
    assert verify.exit_code(verify.summarize(v)) == 0 and verify.exit_code(verify.summarize(v), True) == 1
    order = spark.createDataFrame([("late", 0), ("ok", 1), ("late", 2)], "key string, ord int")
    assert [r["key"] for r in verify.in_order(v, order).collect()] == ["ok", "late"]


def test_cache_and_matrix(spark):
    log = spark.createDataFrame([("1", 1.0, "pending", None), ("1", 2.0, "downloaded", "pmc"), ("1", 3.0, "all_sources_failed", None)], "pmid string, t double, status string, source string")
    assert tuple(cache.upsert(log, "pmid", ["t"], ["status", "source"]).first()) == ("1", "all_sources_failed", "pmc")
    rows = spark.createDataFrame([("a", "1", 1, True, False, False, True), ("a", "2", 3, False, False, False, False)], "name string, pmid string, index int, is_first boolean, is_last boolean, equal_contrib boolean, is_corresponding boolean")
    assert {r["pmid"]: r["label"] for r in analyze.matrix_long(rows).collect()} == {"1": "F / C", "2": "#3"}


def test_floors(spark):
    t = spark.createDataFrame([(str(i), n) for i, n in enumerate([1, 2, 3, 4])], "pmid string, n_persons long")
    assert metrics.team_size(t).first()["median"] is None and metrics.team_size(t).first()["most"] == 4


def test_a_truncated_file_stays_visible(spark, tmp_path):
    whole = "<PubmedArticle><MedlineCitation><PMID>1</PMID></MedlineCitation></PubmedArticle>"
    (tmp_path / "a.xml").write_text(f"<Set>{whole}<PubmedArticle><MedlineCitation><PMID>2</PMID>")
    (tmp_path / "b.xml").write_text("<PubmedArticle><MedlineCitation><PMID>3")
    found = readers.articles_xml(spark, str(tmp_path / "*.xml"))
    assert found.count() == 3
    assert sorted(r["pmid"] for r in readers.parse_articles(found).collect()) == ["", "", "1"]


def test_identifiers_of_references(spark):
    rows = spark.createDataFrame([("", " "), ("10.1/a", ""), (None, "7"), (None, None)], "doi string, pmid string")
    assert [r["h"] for r in rows.select(verify.has_identifier().alias("h")).collect()] == [False, True, True, False]


def test_a_corpus_is_one_object(spark, tmp_path):
    import pytest

    (tmp_path / "list.json").write_text('\n [{"pmid": "1"}]')
    (tmp_path / "corpus.json").write_text('\n {"schema_version": 1, "papers": [{"pmid": "1"}]}')
    with pytest.raises(ValueError, match="object"):
        readers.corpus_json(spark, str(tmp_path / "list.json"))
    papers, meta = readers.corpus_json(spark, str(tmp_path / "corpus.json"))
    assert papers.first()["pmid"] == "1" and meta.first()["schema_version"] == 1
    (tmp_path / "full.json").write_text('[{"pmid": "2", "title": "T", "authors": [{"name": "Li Wei", "last": "Li", "is_corresponding": true}]}, {"pmid": "3"}]')
    papers, found = readers.papers_json(spark, str(tmp_path / "full.json"))
    rows = papers.orderBy("ord").collect()
    assert [r["pmid"] for r in rows] == ["2", "3"] and rows[0]["authors"][0]["is_corresponding"] and rows[1]["title"] == "" and found.count() == 0


def test_papers_and_topics_round_trip(spark, tmp_path):
    from codexa.sources import sinks

    (tmp_path / "f.json").write_text('{"search": {"mindate": "2000", "fetched": 3, "verified": 1}, "papers": [{"pmid": "2", "title": "a \\"q\\", b"}]}')
    papers, search = readers.papers_json(spark, str(tmp_path / "f.json"))
    assert search.first()["rejected"] == 2
    sinks.json_list(papers, str(tmp_path / "out"), "ord", search=search.drop("rejected").first().asDict(), generated_at="now")
    assert [r["pmid"] for r in readers.papers_json(spark, str(tmp_path / "out"))[0].collect()] == ["2"]
    sinks.papers_csv(papers, str(tmp_path / "csv"))
    assert [(r["pmid"], r["title"]) for r in readers.papers_csv(spark, str(tmp_path / "csv")).collect()] == [("2", 'a "q", b')]
    (tmp_path / "t.csv").write_text("pmid,primary_bucket,secondary_bucket,year\n1,a,b,2000\n")
    assert tuple(readers.topics(spark, str(tmp_path / "t.csv")).first()) == ("1", "a", "b", 2000)
    (tmp_path / "list.json").write_text('[\n {"pmid": "1", "year": 2000},\n {"pmid": "2", "year": 2001}\n]')
    (tmp_path / "lines.json").write_text('{"pmid": "1", "year": 2000}\n{"pmid": "2", "year": 2001}\n')
    for name in ("list.json", "lines.json"):
        assert sorted((r["pmid"], r["year"]) for r in readers.topics(spark, str(tmp_path / name)).collect()) == [("1", 2000), ("2", 2001)]
