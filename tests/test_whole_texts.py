"""Catalogue queries over documents against brute force on whole texts."""

import random
import re

import pytest

from codexa.operators import verify
from codexa.plans import catalogue

HEAD = "The same opening line stands at the head of every one of these long documents, "


def texts():
    r, out = random.Random(7), []
    for i in range(60):
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(5, 120))]
        near = [w if r.random() > 0.12 else "changed" for w in words]
        out += [HEAD + " ".join(words), HEAD + " ".join(near), " ".join(words)]
        if i % 5 == 0:
            out += [HEAD.upper() + " ".join(words) + "!"] * (1 + i % 3)
    return [*out, "", None, " . ", "one", "One!", "two"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def tokens(t):
    return frozenset(re.findall("[a-z0-9]+", (t or "").lower()))


def brute(refs, canon, same):
    want = {}
    for k, a in refs:
        best = [(-len(a & b) / len(a | b), d) for d, b in canon if a and b and not (same and d == k) and len(a & b) / len(a | b) >= 0.55]
        if best:
            want[k] = (min(best)[1], round(-min(best)[0], 9))
    return want


def test_title_similarity_on_whole_texts(spark, folder):
    sets = [(str(i), tokens(t)) for i, t in enumerate(texts())]
    rows = catalogue.title_similarity_pairs(spark, folder).collect()
    got = {r["key"]: (r["found_doi"], r["similarity"]) for r in rows}
    assert got == brute(sets, sets, True) and len(rows) == len(got)
    assert any(int(k) % 2 == int(d) % 2 for k, (d, _) in got.items()) and any(int(k) % 2 for k in got) and any(s < 1 for _, s in got.values())


@pytest.mark.parametrize("common", [0, 20, 200_000])
def test_title_candidates_between_two_tables(spark, monkeypatch, common):
    monkeypatch.setattr(verify, "COMMON", common)
    a, b = texts()[::2], texts()[1::2]
    refs = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(a)], "key string, title string")
    canon = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(b)], "doi string, title string")
    got = {r["key"]: (r["found_doi"], round(r["similarity"], 9)) for r in verify.title_candidates(refs, canon).collect()}
    assert got == brute([(f"k{i}", tokens(t)) for i, t in enumerate(a)], [(f"d{i}", tokens(t)) for i, t in enumerate(b)], False)


def test_title_duplicates_on_whole_texts(spark, folder):
    want = {}
    for i, t in enumerate(texts()):
        if key := re.sub("[^a-z0-9]", "", (t or "").lower()):
            want.setdefault(key, []).append(str(i))
    got = {r["title_key"]: r["pmids"] for r in catalogue.title_duplicate_groups(spark, folder).collect()}
    assert got == {k: ",".join(sorted(v)) for k, v in want.items() if len(v) > 1}


def test_date_iso_on_whole_texts(spark, tmp_path):
    long = "Étude " + "über alles " * 40
    rows = [(1, f"{long} 1987"), (2, f"June {long} in 2011 and 1999"), (3, long), (4, "2003 May"), (5, ""), (6, f"12 Mar 2004 {long} 7 or 123"), (7, f"{long} 2005 Dec 88")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["date_iso"] for r in catalogue.date_iso(spark, str(tmp_path)).collect()}
    assert got == {1: "1987-01-01", 2: "2011-06-01", 3: "1900-01-01", 4: "2003-05-01", 5: "1900-01-01", 6: "2004-03-07", 7: "2005-01-31"}
