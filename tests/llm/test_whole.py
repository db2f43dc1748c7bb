"""Small cases in which a corpus operator once did less than the whole job."""

import random
import time

import pytest

from codexa.llm import decontaminate, jaccard_join, line_dedup, page_text, quality, sentence_pieces, token_counts, url_filter


def test_short_lines_are_removed_by_spread_alone(spark):
    n = line_dedup.MIN_SITES
    rows = [(i, f"Les.\n\nAnd ornd.\n \tHome \r\nown line number {i}\n{'few' if i else 'rare'}", f"s{i}") for i in range(n)]
    rows += [(n, "few\n\n \t", "s0"), (n + 1, "Les.\nHome", None)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in out.collect()}
    # 'few' stands on ten sites (s1 to s9, and s0 by document n), 'rare' on one; blank lines stay wherever they are
    assert got == {i: (f"\nown line number {i}" + ("" if i else "\nrare"), 3 + (i > 0)) for i in range(n)} | {n: ("\n \t", 1), n + 1: ("", 2)}


def test_short_lines_below_the_threshold_stay(spark):
    rows = [(i, f"few\nown line number {i}", f"s{i % (line_dedup.MIN_SITES - 1)}") for i in range(40)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert all(r["text"].startswith("few\n") and r["n_removed"] == 0 for r in out.collect())


def words(n, a=0):
    return " ".join(f"w{a + i}" for i in range(n))


def test_keep_one_drops_only_within_a_component(spark):
    base = words(100)
    rows = [(1, base), (1, words(60, 500)), (1, base), (None, words(60, 1000)), (None, words(60, 2000)), (None, words(60, 1000)), (None, base + " more"), (2, words(99) + " other"), (3, ""), (3, ""), (None, None), (None, None), (4, words(60, 3000))]
    got = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda r: (str(r[0]), str(r[1]))
    want = [rows[i] for i in (0, 1, 3, 4, 8, 9, 10, 11, 12)]
    assert got.columns == ["doc_id", "text"] and sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    # without a repeated row the null copies go all the same
    few = jaccard_join.keep_one(spark.createDataFrame([rows[i] for i in (3, 4, 5, 12)], "doc_id long, text string"))
    assert sorted(map(tuple, few.collect()), key=key) == sorted([rows[i] for i in (3, 4, 12)], key=key)


def test_rows_of_null_id_are_bridges(spark):
    w = words(200).split()
    ends = [" ".join(w[:180]), " ".join(w), " ".join(w[20:])]
    rows = [(5, ends[0]), (None, ends[1]), (7, ends[2])]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == [("5", 5), ("7", 5), ("None", 5)]


def test_class_words_never_cut_the_article():
    side = "<div class=sidebar>side</div>"
    story = "<article><p>Main text</p><div class='social'>share</div><section id=comments><article class=comment>reply</article></section></article>"
    for page in (
        f"<html class='no-sidebar'><body>{side}{story}</body></html>", f"<body class='no-sidebar has-widget'>{side}{story}</body>",
        f"<body>{side}{story.replace('<article>', '<article class=&quot;x&quot; id=comments>', 1)}</body>".replace("&quot;", "'"),
        f"<body>{side}<div class='header-wrap'><div class='widget-content'><i>x</i>{story}</div></div></body>",
        f"<body>{side}<div id=menu-page><main class='social'>{story}</main></div></body>", f"<body>{side}<main><div class=widget>{story}</div></main></body>",
    ):
        assert page_text.extract(page, set()) == "Main text", page
    assert page_text.extract(f"<body class='has-sidebar'>{side}<p>Plain</p></body>", set()) == "Plain"
    assert page_text.extract(f"<body><nav class=menu>{story}</nav><p>Plain</p></body>", set()) == "Plain"


def test_rules_of_long_paths_fire(spark):
    long = "/" + "a" * 5000
    rules = spark.createDataFrame([("block", "x.org", long), ("block", "x.org", ""), ("allow", "y.org", "/b")], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, f"http://x.org{long}/z"), (2, "http://x.org/aa"), (3, "http://w.y.org/bc"), (4, "http://y.org/c"), (5, f"http://y.org{long}")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, rules, "none").collect()}
    assert got == {1: (f"x.org{long}", "block"), 2: ("x.org", "block"), 3: ("y.org/b", "allow"), 4: (None, "none"), 5: (None, "none")}


def plain_path(p, t):
    """Ids of the best path by a plain dynamic programme over characters."""
    score = {x.piece: x.score for x in p.units.proto.pieces if x.type in (1, 4)}
    s = ("▁" + t.replace(" ", "▁")) if t else ""
    longest = max(map(len, score))
    top = [(0.0, 0)] + [(float("-inf"), 0)] * len(s)
    for a in range(len(s)):
        for b in range(a + 1, min(len(s), a + longest) + 1):
            v = score.get(s[a:b], p.unk_score if b == a + 1 else None)
            if v is not None and top[a][0] + v > top[b][0]:
                top[b] = (top[a][0] + v, a)
    out, b = [], len(s)
    while b:
        out.append(s[top[b][1] : b])
        b = top[b][1]
    ids = [[i] if (i := p.units.whole.piece_to_id(x)) else p.byte_id[list(x.encode())].tolist() for x in reversed(out)]
    return [i for x in ids for i in x]


def test_long_units_take_the_best_path():
    rng = random.Random(5)
    p = sentence_pieces.Pieces(token_counts.model_path())
    alphabets = ["abcdefghij0123456789+/=", "中文字符测试数据集", "aé🙂ßñ\U0001F9E9", "the and ing tion "]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (3, 60, 64, 65, 700)]
    texts += ["x" * (sentence_pieces.BLOCK + 50), "🧩" * 5000, "", " ", "\n\n", "a\nb\n" * 30]
    for t, ids in zip(texts, p.encode(texts), strict=True):
        assert ids.tolist() == plain_path(p, t), t[:40]
        assert p.decode(ids) == t
    began = time.process_time()
    long = "".join(rng.choice(alphabets[0]) for _ in range(300_000))
    assert p.decode(p.encode([long])[0]) == long and time.process_time() - began < 10


def test_made_columns_do_not_clash(spark):
    rows = [(1, "some text here", 7, "k", 9), (None, None, 8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int, ids_sha256 string, token_ids int")
    out = sentence_pieces.encode_decode(docs, token_counts.model_path(), with_ids=True)
    assert out.columns == [*docs.columns, "n_pieces_", "n_byte_pieces", "ids_sha256_", "round_trip", "token_ids_"]
    assert sorted(r["n_pieces"] for r in out.collect()) == [7, 8]


def test_inner_names_do_not_clash(spark):
    """Tables may have columns by the names that the operators use inside."""
    names = ["_th", "_id", "_own", "_key", "_hid", "_hth", "_bad", "_clean", "_f_id", "_f_th", "n_lines", "_gone_id", "_gone_th", "key", "th"]
    line = "Stands everywhere on all sites"
    rows = [(i, f"{words(60, 1000 + 100 * i)}\n{line}", "en", f"s{i}", *names) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines_", "n_removed"]
    for d in (out, quality.keep_good(docs), jaccard_join.keep_one(docs), decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "no such words")], "item_id long, text string"))):
        got = d.collect()
        assert len(got) == 12 and all(r[n] == n for r in got for n in names)
    assert all(line not in r["text"] and r["n_removed"] == 1 for r in out.collect())


def test_null_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, None), (3, "http://com/de/")], "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    got = sorted(map(tuple, url_filter.url_filter(pages, rules).collect()))
    assert got == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "com", "/de/", "com/de/", "block")]


def test_stages_take_empty_tables_and_odd_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, "no such words at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, th string, _id string, n_lines string"
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, " \n\t", "en", None, 3), (3, "one", None, "s", 3), (3, "one", None, "s", 3), (4, words(300), "en", "s", 1), (None, words(300), "en", "s", 1)]
    rows = [(*r, "th", "_id", "n_lines") for r in odd]
    for table in ([], rows):
        for name, step in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(table, schema)
            out = step(spark, docs, str(tmp_path))
            got = out.collect()
            assert name == "sentence_pieces" or out.columns == docs.columns
            assert len(got) == {"quality_rules": 2, "ngram_jaccard_join": 5}.get(name, len(rows)) * bool(table), name
            assert all((r["th"], r["_id"], r["n_lines"]) == ("th", "_id", "n_lines") for r in got)
