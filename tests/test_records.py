"""Sources and operators over records: article XML, BibTeX, JSON, character references, folding, stored state, numbers, searches."""

import gzip
import html
import pathlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from codexa import numbering
from codexa.functions import markup
from codexa.functions import text as T
from codexa.functions.arrays import strict_zip
from codexa.numbering import positions
from codexa.operators import analyze, cache, metrics, verify
from codexa.operators.state import StoredState
from codexa.plans import records
from codexa.sources import readers
from codexa.sources import schemas as S
from codexa.sources.bibtex import parse_bibtex


def test_references_decode_as_html_says(spark):
    rng = random.Random(4)
    names = sorted(html.entities.html5)

    def piece():
        name = rng.choice(names)
        number = rng.choice([0, 1, 9, 11, 13, 34, 65, 127, 128, 129, 150, 0xD800, 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**9, 8364, 128512])
        return rng.choice([f"&{name}", f"&{name.rstrip(';')}x", f"&#{number};", f"&#{number}z", f"&#x{number:x};", f"&#X{number:X}g", "&", "&&", "&;", "&#", "&#x", "&#;", " a ", "<b>", "é", "\n", "&amp;lt;", "&notit;"])

    texts = ["".join(piece() for _ in range(rng.randint(0, 6))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.u for r in df.select("i", markup.unescape(F.col("t")).alias("u")).orderBy("i").collect()] == [html.unescape(t) for t in texts]
    assert spark.range(1).select(markup.unescape(F.lit(None).cast("string"))).first()[0] == ""


def test_the_fold_of_every_character(spark):
    """fold_latin gives the compatibility form without marks for every assigned character."""
    special = {**T.SPECIAL_ONE, **T.SPECIAL_TWO}
    codes = [c for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in codes], "i int, t string").repartition(4)
    got = {r.i: r.u for r in rows.select("i", T.fold_latin(F.col("t")).alias("u")).collect()}

    def want(s):
        s = "".join(special.get(x, x) for x in s)
        return "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))

    assert [hex(c) for c in codes if got[c] != want(f"a{chr(c)}b")] == []


ARTICLE = """<PubmedArticle><MedlineCitation><PMID Version="1">{0}</PMID><Article><Journal><JournalIssue><Volume>3</Volume><PubDate><MedlineDate>2019 Nov-Dec</MedlineDate></PubDate></JournalIssue><Title>J</Title></Journal>
<ArticleTitle>The <i>X &lt; 0.05</i> r&#xf4;le, &amp;alpha; <![CDATA[a < b <c> ]]></ArticleTitle><Abstract><AbstractText NlmCategory="AIM">See <b>p &lt; 1</b> now.</AbstractText><AbstractText>Go <!-- no --> on.</AbstractText><AbstractText/></Abstract>
<AuthorList><Author EqualContrib="y"><LastName>M&#xfc;ller</LastName><ForeName>J</ForeName><Initials>J</Initials><Identifier Source="ORCID">https://orcid.org/0000-0002-1825-0097</Identifier><AffiliationInfo><Affiliation>Uni &amp; Co, m&#xfc;@x.org.</Affiliation></AffiliationInfo><AffiliationInfo><Affiliation>Two</Affiliation></AffiliationInfo></Author>
<Author><CollectiveName>The <sup>1</sup> Group</CollectiveName></Author><Author><ForeName>Solo</ForeName></Author></AuthorList><ELocationID EIdType="pii">S1</ELocationID><ELocationID EIdType="doi">10.1/e</ELocationID></Article></MedlineCitation>
<PubmedData><ReferenceList><Reference><ArticleIdList><ArticleId IdType="doi">10.9/cited</ArticleId></ArticleIdList></Reference></ReferenceList><ArticleIdList><ArticleId IdType="PMC">PMC7</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""


def test_article_fields(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?>\n<PubmedArticleSet>\n" + ARTICLE.format(5) + "\n<PubmedArticle><PMID>6</PMID><x></PubmedArticle>" + ARTICLE.format(7) + "</PubmedArticleSet>")
    r, bad, last = readers.parse_articles(readers.articles_xml(spark, str(tmp_path / "a.xml"))).orderBy("ord").collect()
    assert (r.pmid, r.title, r.abstract, r.doi, r.pmc_id, r.pub_year, r.error) == ("5", "The X < 0.05 rôle, α a < b <c>", "AIM: See p < 1 now. Go  on.", "10.1/e", "PMC7", "2019", "")
    assert r.authors_str == "Müller J, The 1 Group, Solo"
    a = r.authors[0]
    assert (a.last, a.affiliation, a.email, a.orcid, a.equal_contrib, a.is_corresponding) == ("Müller", "Uni & Co, mü@x.org. Two", "mü@x.org", "0000-0002-1825-0097", True, True)
    assert (bad.ord, bad.pmid, bad.title, bad.error) == (1, "", "", "the article is not well-formed") and last.pmid == "7"


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<PubmedArticleSet>" + "\n".join(ARTICLE.format(i) for i in range(1500)) + "</PubmedArticleSet>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        raw = spark.read.option("lineSep", "</PubmedArticle>").text(str(tmp_path / "a.xml"))
        assert raw.rdd.getNumPartitions() > 4
        found = readers.parse_articles(readers.articles_xml(spark, str(tmp_path / "a.xml")))
        assert [r.pmid for r in found.select("ord", "pmid").orderBy("ord").collect()] == [str(i) for i in range(1500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("few", [100_000, 2])
def test_articles_of_many_files_are_numbered_where_they_lie(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(numbering, "FEW_BLOCKS", few)
    for i, name in enumerate(["c", "a", "b"]):
        text = "<PubmedArticleSet>" + "\n".join(ARTICLE.format(100 * i + k) for k in range(100)) + "</PubmedArticleSet>"
        (tmp_path / f"{name}.xml").write_text(text) if i else (tmp_path / f"{name}.xml.gz").write_bytes(gzip.compress(text.encode()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        found = readers.articles_xml(spark, str(tmp_path / "*.xml*"))
        assert found.select("block").distinct().count() > 1
        rows = found.select("ord", F.regexp_extract("xml", ">([0-9]+)</PMID>", 1).cast("int").alias("pmid")).orderBy("ord").collect()
        assert [tuple(r) for r in rows] == list(enumerate([*range(100, 300), *range(100)]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_articles_leave_one_table_behind(spark):
    d, shared = "/root/testdata/sf0.001", spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    files = lambda: {p: p.stat().st_size for p in pathlib.Path(shared).rglob("*") if p.is_file() and not p.name.startswith(".")}
    before = set(files())
    assert records.articles(spark, d).count() == spark.read.parquet(f"{d}/orders.parquet").count()
    left = {p: n for p, n in files().items() if p not in before}
    assert not [p for p in left if ".txt" in p.name] and len({p.parent for p in left}) == 1
    assert sum(left.values()) < 2 * sum(pathlib.Path(f"{d}/{t}.parquet").stat().st_size for t in ("orders", "lineitem"))


def test_no_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<PubmedArticleSet></PubmedArticleSet>")
    assert readers.parse_articles(readers.articles_xml(spark, str(tmp_path / "a.xml"))).collect() == []


PMIDS = {
    "pmid = {25079317}": "25079317", "eprint = {7}, eprinttype = {PubMed}": "7", "annote = {PMID 25079317}": "25079317", "note = {PMID:25079317}": "25079317", "note = {pmid = 25079317}": "25079317",
    "note = {Publisher: Nature, PMID: {25079317}. Cited 40}": "25079317", "note = {a\n  PMID:\n  25079317}": "25079317", 'extra = "PMID: 25079317"': "25079317", "pmid = {PMID: https://pubmed.ncbi.nlm.nih.gov/25079317/}": "25079317",
    "note = {PMCID: PMC3388858}": "", "note = {PMID: PMC3388858}": "", "pmid = {PMC3388858}": "", "note = {see page 12345678}": "", "eprint = {25079317}": "", "eprint = {25079317}, archiveprefix = {pubmed}": "", "pmid = {25079317v1}": "",
    "note = {PMID: 250793171}": "", "pmid = {123456789012}": "", "note = {PMCID: PMC3388858. PMID: 25079317}": "25079317", "pmid = {PMC1}, note = {PMID: 5}": "", "eprinttype = {pmid}, eprint = {}, note = {PMID: 5}": "", "note = {PMIDs: 5}": "", "note = {PM: 777}": "",
    "pmid = {}, note = {PMID: 5}": "5", "note = {PMID: 111}, annote = {PMID: 222}": "111", "keywords = {x, PMID: 9}": "9",
}


@pytest.mark.parametrize("fields", PMIDS)
def test_where_a_pmid_is_read(fields):
    assert parse_bibtex(f"@article{{a, doi = {{10.1/x}}, {fields}}}")[0]["pmid"] == PMIDS[fields]


BIB = r"""@string(jx = "J. X")
% @article{off, title={not live}}
@comment{ignored, x}
@article{Müller2020, title={A {Nested} T\"{o}st 100\% \v{c} \textbf{fat}}, author="Li, W and Bo, C", journal=JX # { Sup}, year={in 2020}, month = jan}
@article{a&b, journal=undef, title={Eight (8) things}, title={last counts}} @misc{x:y/z, title={ok}, editor = {Ed One and Two}}
@book(b2, title = {Broken, year = {1999}
@article{b2, title = "say {x "q" y}", year = 2001, pages={12--19}, journaltitle={JT}, number=3}
@inproceedings(p, booktitle = {With ) inside}, year = 1998)
"""


def test_entries_and_findings(spark, tmp_path):
    (tmp_path / "a.bib").write_bytes(b"\xef\xbb\xbf" + BIB.encode())
    (tmp_path / "b.bib").write_bytes("@misc{Ü, title={é}}".encode("latin-1"))
    rows = readers.bibtex(spark, str(tmp_path / "*.bib")).orderBy("path", "ord").collect()
    assert [(r.key, r.title, r.first_author, r.year, r.journal, list(r.findings)) for r in rows] == [
        ("Müller2020", r"A Nested Tost 100% c \textbffat", "Li, W", "2020", "J. X Sup", []), ("a&b", "last counts", "", "", "undef", ["undefined macro undef in journal"]), ("x:y/z", "ok", "Ed One", "", "", []),
        ("b2", "Broken, year = 1999", "", "", "", ["unbalanced entry"]), ("b2", 'say x "q" y', "", "2001", "JT", []), ("p", "", "", "1998", "With ) inside", []), ("Ü", "é", "", "", "", []),
    ]
    assert (rows[4].pages, rows[4].issue, rows[4].ord) == ("12-19", "3", 4)


def test_unbalanced_braces_do_not_swallow_the_next_entry():
    found = parse_bibtex("@article{a, title={x, doi={10.1/a}\n@article{b, title={y}, doi={10.1/b}}")
    assert [(f["key"], f["findings"]) for f in found] == [("a", ["unbalanced entry"]), ("b", [])] and found[1]["doi"] == "10.1/b"
    assert parse_bibtex("") == parse_bibtex("no entries % here") == []


def test_equal_keys_have_results_of_their_own(spark):
    ref = lambda key, doi, year: (key, "A study of things", "Li W", year, "", "", "", "", doi, "", "article")
    refs = spark.createDataFrame([ref("k", "10.1/a", "2020"), ref("k", "10.1/b", "2021"), ref("k", "", "2020"), (None, *ref("", "10.1/a", "1999")[1:])], S.REFERENCE)
    cr = lambda doi, year: (doi, "A study of things", "Li", ["Li"], year, "", "", "", "", "article", None)
    cross = spark.createDataFrame([cr("10.1/a", "2020"), cr("10.1/b", "2021")], S.CROSSREF)
    v = verify.verify(refs, cross, spark.createDataFrame([], S.DOI_PMID), spark.createDataFrame([], S.PUBMED))
    assert sorted((str(r.key), r.doi, r.status) for r in v.collect()) == [("None", "10.1/a", "mismatch"), ("k", "", "verified"), ("k", "10.1/a", "verified"), ("k", "10.1/b", "verified")]


def test_a_malformed_answer_fails_its_entry_only(spark):
    answers = spark.createDataFrame([("10.1/a", '{"DOI": "10.1/a", "title": ["T one"], "issued": {"date-parts": [[2020]]}}'), ("10.1/b", '{"DOI": "10.1/b", "title": ['), ("10.1/c", None), ("10.1/d", "<html>")], "asked string, value string")
    works = readers.crossref_json(answers, key="asked")
    assert {r.doi: r.lookup_error for r in works.collect()} == {"10.1/a": None, "10.1/b": "malformed answer", "10.1/c": "no answer", "10.1/d": "malformed answer"}
    refs = spark.createDataFrame([(k, "T one" if k == "a" else "", "", "2020", "", "", "", "", f"10.1/{k}", "", "article") for k in "abcd"], S.REFERENCE)
    v = verify.verify(refs, works, spark.createDataFrame([], S.DOI_PMID), spark.createDataFrame([], S.PUBMED))
    assert {r.key: r.status for r in v.collect()} == {"a": "verified", "b": "error", "c": "error", "d": "error"}
    papers = readers.summary_json(spark.createDataFrame([("5", '{"uid": "5", "title": "x"}'), ("6", "{")], "asked string, value string"), key="asked")
    assert [(r.pmid, r.lookup_error) for r in papers.orderBy("pmid").collect()] == [("5", None), ("6", "malformed answer")]


def test_papers_in_any_layout(spark, tmp_path):
    layouts = {
        "list": '[{"pmid": "1", "authors": [{"name": "A", "equal_contrib": true}]},\n {"pmid": "2"}\n, {"title": "x"}]', "envelope": '{"search": {"fetched": 5, "verified": 2}, "papers": [\n{"pmid": "1"}, {"pmid": "2"}, {"title": "x"}]}',
        "one": '{"pmid": "1"}', "empty": "[]", "nothing": '{"search": {"fetched": 0, "verified": 0}, "papers": []}',
    }
    got = {}
    for name, text in layouts.items():
        (tmp_path / f"{name}.json").write_text(text)
        papers, found = readers.papers_json(spark, str(tmp_path / f"{name}.json"))
        got[name] = ([(r.ord, r.pmid) for r in papers.orderBy("ord").collect()], [r.rejected for r in found.collect()])
    three = [(0, "1"), (1, "2"), (2, "")]
    assert got == {"list": (three, []), "envelope": (three, [3]), "one": ([(0, "1")], []), "empty": ([], []), "nothing": ([], [0])}


def test_topic_records_fall_back(spark, tmp_path):
    assert readers.topic_records(spark, str(tmp_path)).collect() == []
    (tmp_path / "topic_extraction.csv").write_text("pmid,primary_bucket,secondary_bucket,year\n1,a,b,2000\n")
    assert readers.topic_records(spark, str(tmp_path)).first().pmid == "1"
    (tmp_path / "topic_extraction.json").write_text('[{"pmid": "9", "primary_bucket": "z", "year": 2001}]')
    assert readers.topic_records(spark, str(tmp_path)).first().pmid == "9"


def test_strict_zip(spark):
    df = spark.createDataFrame([("a", [1, 2], ["x", "y"]), ("b", [], []), ("c", None, None)], "k string, m array<int>, n array<string>")
    zipped = strict_zip(F.col("k"), m=F.col("m"), n=F.col("n"))
    assert [r.z and [tuple(e) for e in r.z] for r in df.select("k", zipped.alias("z")).orderBy("k").collect()] == [[(1, "x"), (2, "y")], [], None]
    for n in (["x"], None):
        bad = spark.createDataFrame([("odd", [1, 2], n)], "k string, m array<int>, n array<string>")
        with pytest.raises(Exception, match="unequal length at odd"):
            bad.select(zipped).collect()


def test_positions(spark):
    rows = [(i * 7 % 50, i) for i in range(600)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = positions(df, F.desc("a"), "b", name="n").orderBy("n").collect()
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1])) and [r.n for r in got] == list(range(600))
    assert positions(df.limit(0), "a").collect() == []


def test_one_value_fills_no_task(spark):
    """A million rows of which a third share a value, numbered by that value alone."""
    df = spark.range(1_000_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"), "id")
    got = positions(df, "v")
    assert tuple(got.agg(F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()) == (1_000_000, 0, 999_999)
    assert got.where("v = 0 and pos > 333333").isEmpty()
    sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_search_counts_before_it_fetches(spark):
    found = spark.range(30).select("id", (F.col("id") % 3 == 0).alias("near"))
    for most, narrow, want in ((40, F.col("near"), (30, False, 30, 30, False)), (20, F.col("near"), (30, True, 10, 10, False)), (5, F.col("near"), (30, True, 10, 5, True)), (20, None, (30, False, 30, 20, True))):
        rows, told = analyze.search(found, narrow, ["id"], most)
        ids = [r.id for r in rows.collect()]
        assert tuple(told.first()) == want and len(ids) == want[3] and (not want[1] or all(i % 3 == 0 for i in ids))
    rows, told = analyze.search(found.limit(0), F.col("near"), ["id"])
    assert rows.collect() == [] and tuple(told.first()) == (0, False, 0, 0, False)


def test_stored_state_equals_a_replay(spark, tmp_path):
    rng = random.Random(8)
    log = [(rng.randint(0, 40), float(rng.randint(0, 9)), i, rng.choice(["pending", cache.FAILED, cache.DONE, None]), rng.choice([None, "pmc", ""])) for i in range(400)]
    df = spark.createDataFrame(log, "pmid long, updated_at double, n int, status string, pdf_path string").cache()
    state = StoredState(spark, str(tmp_path / "cache"), "pmid long", "updated_at double, n int", "status string, pdf_path string, updated_at double", 8)
    assert state.read().collect() == [] and state.expire(0) == 0
    for part in (2, 0, 1, 2):
        state.merge(df.where(F.col("n") % 3 == part))
    whole = cache.upsert(df, "pmid", ["updated_at", "n"], ["status", "pdf_path", "updated_at"])
    order = lambda rows: sorted(map(str, rows.collect()))
    assert order(state.read()) == order(whole)
    assert state.merge(df.limit(0)) == []
    keys = spark.createDataFrame([(1,), (2,), (999,)], "pmid long")
    found, counts = state.lookup(keys)
    hits = sum(r.hit for r in found.collect())
    assert tuple(counts.first()) == (hits, 3 - hits)
    failed = whole.where(F.col("status") == cache.FAILED).count()
    assert state.expire(200 * 86400.0) == failed and state.read().where(F.col("status") == cache.FAILED).isEmpty() and state.read().count() == whole.count() - failed
    with pytest.raises(Exception, match="without a key"):
        state.merge(spark.createDataFrame([(None, 1.0, 1, "pending", None)], df.schema))


def test_a_delta_touches_its_buckets_only(spark, tmp_path):
    state = StoredState(spark, str(tmp_path / "cache"), "pmid long", "updated_at double", "status string", 16)
    rows = lambda ids, t, s: spark.createDataFrame([(i, t, s) for i in ids], "pmid long, updated_at double, status string")
    assert len(state.merge(rows(range(200), 1.0, "pending"))) == 16
    names = lambda: {p.parent.name: p.name for p in (tmp_path / "cache").rglob("*.parquet")}
    before = names()
    touched = state.merge(rows([5], 2.0, "done"))
    after = names()
    assert len(touched) == 1 and {k for k in before if before[k] != after[k]} == {f"bucket={touched[0]}"}
    read = state.rows().where(F.col("bucket").isin(touched))
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString()
    assert state.read().count() == 200 and state.read().where("status = 'done'").first().pmid == 5


def test_orders_and_small_rules(spark):
    papers = spark.createDataFrame([(2020, "b", "T"), (2020, "a", "U"), (None, "c", "V"), (2019, "d", "W")], "year int, pmid string, title string")
    assert sorted((str(r.year), r.place, r.pmid) for r in metrics.titles_in_order(papers).collect()) == [("2019", 0, "d"), ("2020", 0, "a"), ("2020", 1, "b"), ("None", 0, "c")]
    assert metrics.tallest_stack(papers, "year").first().tallest == 2 and metrics.tallest_stack(papers.limit(0), "year").first().tallest == 0
    assert analyze.default_exclusions(" Chen X ", ["Li", " ", "Li ", None]) == ["", "Chen X", "Li"]
    page = '<meta name="citation_pdf_url" content="https://x.org/a.pdf"> <link type="application/pdf" href="/b"> see https://y.org/c.pdf?v=1 or "http://z.org/d.pdf" and /e.pdf'
    row = spark.createDataFrame([(page,), (None,)], "h string").select(T.pdf_urls(F.col("h")).alias("u")).collect()
    assert list(row[0].u) == ["https://x.org/a.pdf", "/b", "https://y.org/c.pdf?v=1", "http://z.org/d.pdf"] and list(row[1].u) == []


def test_written_documents(spark, tmp_path):
    import json

    from codexa.sources import sinks

    rows = [(str(i), f'T "{i}", é', [{"name": "Li", "equal_contrib": True}]) for i in range(25)]
    papers = spark.createDataFrame(rows, "pmid string, title string, authors array<struct<name: string, equal_contrib: boolean>>").repartition(5)
    text = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    sinks.json_list(papers, str(tmp_path / "list"), F.col("pmid").cast("int"))
    assert [p["pmid"] for p in json.loads(text("list"))] == [r[0] for r in rows] and json.loads(text("list"))[3]["authors"] == rows[3][2]
    sinks.json_list(papers, str(tmp_path / "box"), F.col("pmid").cast("int"), search={"fetched": 30}, generated_at="now")
    box = json.loads(text("box"))
    assert (box["schema_version"], box["generated_at"], box["search"], len(box["papers"])) == (1, "now", {"fetched": 30}, 25)
    sinks.json_list(papers.limit(0), str(tmp_path / "none"), "pmid")
    assert json.loads(text("none")) == []
    sinks.papers_csv(papers, str(tmp_path / "csv"))
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbfpmid,title,authors") for p in (tmp_path / "csv").glob("part-*"))
    back = {r.pmid: r for r in readers.papers_csv(spark, str(tmp_path / "csv")).collect()}
    assert len(back) == 25 and back["3"].title == 'T "3", é' and json.loads(back["3"].authors) == rows[3][2]


def test_people_with_all_that_is_known(spark):
    from codexa.operators import identity

    schema = "pmid string, idx int, name string, last string, fore string, initials string, orcid string, affiliation string, equal_contrib boolean, date_iso string, year int, is_first boolean, is_last boolean, evidence string"
    a = lambda pmid, idx, name, year, first, last, orcid="", aff="", eq=False: (pmid, idx, name, *name.split(" ", 1), name.split(" ", 1)[1][:1], orcid, aff, eq, f"{year}-06-01", year, first, last, "orcid")
    rows = [a("1", 0, "Li Wei", 2010, True, False, aff="Nanhai"), a("2", 0, "Li Weiwei", 2012, True, False, eq=True), a("1", 1, "Bo A", 2010, False, True, "0000-1", "Else"), a("3", 1, "Bo A", 2015, False, False, "0000-1")]
    got = {r.name: r for r in identity.build_people(spark.createDataFrame(rows, schema), F.lit(2010), F.lit(2018), ["Nanhai"]).collect()}
    li, bo = got["Li Weiwei"], got["Bo A"]
    assert (li.person_id, li.stratum, li.n_first_slots, list(li.flags), li.affiliation_signal, li.n_equal_contrib, list(li.pmids), list(li.first_slot_pmids), list(li.evidence)) == (1, "A", 2, ["drift_benign"], "internal", 1, ["1", "2"], ["1", "2"], ["orcid"])
    assert (bo.person_id, bo.stratum, bo.affiliation_signal, bo.left_censored, bo.right_censored, list(bo.pmids)) == (0, "D", "external", True, False, ["1", "3"])
    assert identity.build_people(spark.createDataFrame([], schema), F.lit(0), F.lit(1)).collect() == []


def test_the_package_reaches_workers(spark):
    import zipfile

    from codexa.packaging import ship

    path = ship(spark)
    with zipfile.ZipFile(path.removeprefix("file:")) as z:
        assert "codexa/operators/verify.py" in z.namelist()
    assert any(p.endswith("codexa.zip") for p in spark.sparkContext._python_includes)
