"""Tests of what the third review found."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from codexa.functions import markup
from codexa.plans import catalogue, fields, records  # noqa: F401


def agrees(spark, folder, name):
    """Rows only in the SQL, and only in the query."""
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    want = con.execute(catalogue.ORACLES[name]).fetchall()
    df = catalogue.QUERIES[name](spark, str(folder))
    columns = [c[0] for c in con.description]
    got = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(set(want) - set(got), key=str), sorted(set(got) - set(want), key=str), len(want) - len(got)


def orders(spark, folder, rows):
    """rows: (key, customer)."""
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long")
    df.select("*", F.lit("O").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), F.lit("1995-02-03").cast("timestamp_ntz").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(str(folder / "orders.parquet"))


def test_a_torn_reference_stays(spark, tmp_path):
    rows = [(1, "a &amp b &amp; c &copy;"), (2, None), (3, "x &ampy; &amp")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert agrees(spark, tmp_path, "char_references") == ([], [], 0)
    texts = ["&notit; &amp &lt;", "&#65 &#65; &#x41;"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(markup.unescape(F.col("t"), closed=True)).collect()
    assert [r[0] for r in got] == ["&notit; &amp <", "&#65 A A"]


def test_other_customers_are_other_authors(spark, tmp_path):
    """The DOI of order 34 leads to 35, whose author is another person while year, journal and volume agree."""
    orders(spark, tmp_path, [(34, 1), (35, 51), (37, 2)])
    assert agrees(spark, tmp_path, "verified_entries") == ([], [], 0)


def test_a_document_is_written_and_read_by_many_tasks(spark, tmp_path):
    import json

    from codexa.sources import readers, sinks

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(3000).select(F.col("id").cast("string").alias("pmid"), F.lit('a "], [{" b').alias("title"))
        sinks.json_list(rows, str(tmp_path / "doc"), F.col("pmid").cast("long"), search={"fetched": 5, "verified": 2})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "doc").glob("part-*"))
    assert len(parts) == 4 and [p["pmid"] for p in json.loads("".join(p.read_text() for p in parts))["papers"]] == [str(i) for i in range(3000)]
    papers, found = readers.papers_json(spark, str(tmp_path / "doc"))
    assert [(r.ord, r.pmid, r.title) for r in papers.orderBy("ord").collect()] == [(i, str(i), 'a "], [{" b') for i in range(3000)] and found.first().rejected == 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        from codexa.sources.documents import in_lines

        assert in_lines(spark, str(tmp_path / "doc"), "pmid string", ("papers",), ordered=False)[0].rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_only_whole_records_on_lines_are_read_by_lines(spark, tmp_path):
    """Layouts that look like records on lines and are not: left to the parser, with its result."""
    from codexa.sources import readers
    from codexa.sources.documents import in_lines

    yes = {"commas behind": '[\n{"key": "a"},\n{"key": "b"}\n]\n', "several on a line": '{"entries": [\n{"key": "a"}, {"key": "b"}\n]}\n', "blank lines": '\ufeff{"x": 1, "references": [\n\n{"key": "a"}\n, {"key": "b"}\n\n], "y": [1]}\n'}
    no = {
        "a list within": '{"entries": [{"key": "a"}, {"key": "b"}], "other": [\n{"key": "c"}\n]}\n', "records over lines": '[\n{"key": "a", "x": [{}\n,{}]}\n,{"key": "b"}\n]\n', "early end": '{"entries": [\n{"key": "a"}, {"key": "b"}], "z": [{"key": "c"}\n]}\n',
        "one line": '[{"key": "a"}, {"key": "b"}]', "first of two boxes": '{"references": [{"key": "a"}, {"key": "b"}], "entries": [\n{"key": "c"}\n]}\n', "head with a record": '[{"key": "a", "x": [\n{}\n]}, {"key": "b"}]\n',
    }
    for i, (name, text) in enumerate([*yes.items(), *no.items()]):
        (at := tmp_path / f"{i}.json").write_text(text)
        lined = in_lines(spark, str(at), "key string", ("references", "entries"))
        assert (lined is not None) == (name in yes), name
        assert [r.key for r in readers.refs_json(spark, str(at)).orderBy("ord").collect()] == ["a", "b"], name


def test_bibtex_is_read_in_pieces(spark, tmp_path):
    """A large file by many tasks, with macros at its end and unbalanced entries; what pieces could read otherwise is parsed whole."""
    from codexa.sources import bibtex, readers

    big = "".join(f"@article{{k{i}, title = {{T\n {i}}}, journal = jx # { '{ Y}' }, year = 20{i % 90 + 10}{'' if i % 50 == 7 else '}'}\n" for i in range(2000)) + "@string{jx = \"J X\"}\n"
    texts = {
        "big": big, "percent": "% @article{no,\n@article{a, title = {5% of}}\n% x\n@misc{b, title={y}} @misc{c, title={z}}\n",
        "open and percent": "@article{a, title = {x\n@misc{b, title={y}}\n% @misc{no, title={n}}\n", "an at in a value": "@article{a, title = {x\n@home}, year=1999}\n", "head over lines": "@article{\n@a, title={x}}",
    }
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        for i, (name, text) in enumerate(texts.items()):
            (at := tmp_path / f"{i}.bib").write_text("﻿" + text)
            got = readers.bibtex(spark, str(at)).orderBy("ord").collect()
            want = bibtex.parse_bibtex(text)
            assert [r.asDict() | {"path": ""} for r in got] == [{"path": "", "ord": n} | e for n, e in enumerate(want)], name
            assert (bibtex._pieces(spark, str(at)) is not None) == (name in ("big", "percent")), name
        assert bibtex._pieces(spark, str(tmp_path / "0.bib")).select("path").distinct().count() == 1
        assert spark.read.option("lineSep", "\n@").text(str(tmp_path / "0.bib")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tasks_grow_with_the_line_items(spark, monkeypatch):
    """A task holds so many line items and people, however large the table."""
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalogue, "TASK_ROWS", 500)
    for df in (catalogue.lines(spark, d), catalogue.roster(spark, d)):
        sizes = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(sizes) >= 10 and max(r["count"] for r in sizes) < 1200


def test_a_stack_is_numbered_by_many_tasks(spark):
    from codexa.operators import metrics

    points = spark.range(4000).select(F.lit(2000).alias("year"), F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name")).unionByName(spark.sql("select 1999 as year, 'x' as name union all select null, 'y'"))
    got = metrics.stack_positions(points, "year", "name")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.year, r["name"], r.place) for r in got.orderBy("year", "place").collect()] == [(None, "y", 0), (1999, "x", 0), *((2000, f"n{i:05d}", i) for i in range(4000))]


def test_articles_are_parsed_once(spark, tmp_path):
    """What is built on the authors evaluates neither the authors nor the parse again."""
    from codexa.sources import readers

    one = "<PubmedArticle><MedlineCitation><PMID>5</PMID><Article><ArticleTitle>A</ArticleTitle><AuthorList><Author><LastName>Li</LastName><AffiliationInfo><Affiliation>U. corresponding</Affiliation><Affiliation>w@u.edu.</Affiliation></AffiliationInfo></Author></AuthorList></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "a.xml").write_text(one)
    found = readers.parse_articles(readers.articles_xml(spark, str(tmp_path / "a.xml")))
    plan = found.select("authors_str", F.col("authors")[0]["email"], "authors")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_xml" not in plan and "LastName" not in plan
    a = found.first().authors[0]
    assert (a.email, a.affiliation, a.is_corresponding) == ("w@u.edu", "U. corresponding w@u.edu.", True)


def test_conflicts_need_no_canonical_texts(spark):
    """The conflicts alone are those of the whole verification, from two joins; repeated keys, rows without identifiers and failed look-ups included."""
    from codexa.operators import verify
    from codexa.sources import schemas as S

    fields = ["title", "first_author", "year", "journal", "volume", "issue", "pages"]
    ref = [("a", "10.1/A", "1"), ("a", "doi:10.1/b", "2"), ("b", "10.1/c", ""), ("c", "", "3"), ("d", None, None), ("d", None, None), ("e", "10.1/e", "9"), ("f", "10.1/f", "")]
    refs = spark.createDataFrame([(k, d, p, *["t"] * 7) for k, d, p in ref], "key string, doi string, pmid string, " + ", ".join(f"{f} string" for f in fields))
    link = spark.createDataFrame([("10.1/a", "7", None), ("10.1/a", "5", None), ("10.1/b", "2", None), ("10.1/c", "3", None), ("10.1/e", "8", "timeout"), ("10.1/f", None, "timeout")], S.DOI_PMID)
    pub = spark.createDataFrame([{"pmid": "1", "doi": "10.1/x", "title": "u"}, {"pmid": "2", "doi": "10.1/B"}, {"pmid": "3", "doi": "10.1/y"}, {"pmid": "9", "doi": "10.1/z", "lookup_error": "timeout"}], S.PUBMED)
    whole = verify.verify(refs, spark.createDataFrame([{"doi": "10.1/f", "title": "t", "first_author": "t"}], S.CROSSREF), link, pub)
    alone = verify.conflicts(refs, link, pub)
    assert alone._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2
    hard = F.filter("issues", lambda i: i.severity == "conflict").cast("string")
    rows = lambda df: sorted((r[0], r[1] or "", r[2] or "", r[3]) for r in df.select("key", "doi", "pmid", hard.alias("c")).collect())
    assert rows(alone) == rows(whole) and len(rows(alone)) == 8 and sum(r[3] != "[]" for r in rows(alone)) == 1
    last = whole.where("key = 'f'").first()  # the look-up failed and has no PMID: the error stays
    assert last.status == "partial" and last.errors == ["DOI to PMID lookup failed"]


def test_tasks_grow_with_the_orders_of_teams_and_lead_slots(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalogue, "TASK_ROWS", 500)
    for df in (catalogue.team(spark, d), catalogue.lead(spark, d)):
        sizes = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(sizes) >= 10 and max(r["count"] for r in sizes) < 400


def test_signatures_bound_the_overlap():
    """Sets differ by as many tokens as their signatures by bits, at least, and small ones by hardly more."""
    import random

    import numpy as np

    from codexa.operators import verify

    r = random.Random(3)
    sets = [sorted(r.sample(range(-5000, 5000), r.choice([1, 5, 80, 3000]))) for _ in range(2200)]
    flat, row = np.array([t for x in sets for t in x]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    bits = verify._signatures(flat, row, len(sets)).view(np.uint64)  # bits of a negative number are counted by its absolute value
    for i in range(0, 2200, 7):
        a, b = set(sets[i]), set(sets[(i * 31 + 5) % 2200])
        differ = int(np.bitwise_count(bits[i] ^ bits[(i * 31 + 5) % 2200]).sum())
        assert differ <= len(a ^ b) and (len(a) + len(b) > 90 or differ >= len(a ^ b) - 20)


def test_pairs_are_the_same_without_a_broadcast(spark, monkeypatch):
    from codexa.operators import verify

    rows = [(f"{i}", " ".join(f"w{(i * 7 + k) % 90}" for k in range(20 + i % 5))) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, title string")
    found = []
    for most in (verify.FEW_SETS, 0):
        monkeypatch.setattr(verify, "FEW_SETS", most)
        found.append(sorted(map(tuple, verify.title_candidates(df, df.withColumnRenamed("key", "doi"), same=True).collect())))
    assert found[0] == found[1] and len(found[0]) > 20


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    """a task sorts so many rows of a numbering, however large the table; few rows stay in few tasks."""
    from codexa import numbering

    rows = spark.range(4000).select(F.col("id"), (F.col("id") % 3).alias("k"))
    sizes = lambda: [r["count"] for r in numbering.positions(rows, "k", F.desc("id")).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes()) <= 4
    monkeypatch.setattr(numbering, "TASK_ROWS", 100)
    found = sizes()
    assert len(found) >= 30 and sum(found) == 4000 and max(found) < 300
    got = [r.id for r in numbering.positions(rows, "k", F.desc("id")).orderBy("pos").collect()]
    assert got == sorted(range(4000), key=lambda i: (i % 3, -i))


def test_places_deal_no_rows_by_value(spark, monkeypatch):
    """points are not shuffled by the few values that they stack on; where values are many, the places are the same."""
    from codexa import numbering
    from codexa.operators import metrics

    points = spark.range(3000).select(F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("year"), F.lpad(F.col("id").cast("string"), 5, "0").alias("name"))
    want = [(y or None, f"{i:05d}", i // 4) for y in range(4) for i in range(y, 3000, 4)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the planner can't tell that the values are few
    try:
        for most in (numbering.FEW_GROUPS, 0):
            monkeypatch.setattr(numbering, "FEW_GROUPS", most)
            got = metrics.stack_positions(points, "year", "name")
            assert ("hashpartitioning" in got._jdf.queryExecution().executedPlan().toString()) == (most == 0)
            assert [(r.year, r["name"], r.place) for r in got.orderBy("year", "place").collect()] == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["lead_to_senior_flips", "lag_rows", "activity_span", "time_to_lead", "first_year_strip", "person_roster"])
def test_roster_queries_deal_by_the_line_items(spark, monkeypatch, name):
    """F12, F13, F15, F16, F18, F23: orders, line items and people go to a task for so many line items, never to a fixed number of tasks or to what Spark merges."""
    monkeypatch.setattr(catalogue, "TASK_ROWS", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the orders are many
    try:
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"hashpartitioning\((l_orderkey|pmid|pid)#\d+L?, (\d+)\), (\w+)", plan)
    assert {k for k, *_ in dealt} == {"l_orderkey", "pmid", "pid"} and all(int(n) == 12 for _, n, _ in dealt)
    assert {how for k, _, how in dealt if k != "pmid"} == {"REPARTITION_BY_NUM"}
