"""Alignment of two tokenizers against whole texts, byte by byte."""

import hashlib
import json
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from codexa.llm import token_alignment as T
from codexa.llm.token_counts import model_path

A, B = model_path(T.MODEL_A), model_path(T.MODEL_B)
ODD = [
    None, "", " ", "  \n ", "\n\n\n", "a", "a\n b", "word \n\n  word", "tab\t tab", "nbsp  x", "　 　x", "\x85 x", "\x1c x\x1c y", "x\r\n y\r\n", "a\x00b", "café \U0001f600 你好 �", "mark ▁ here", "▁",
    "<|endoftext|> and </s> <s> <unk> <0x41>", "it's we'll I'd  they've", "1,234.5  x2", "''' 's 'S", "x" * 3000, "क्ष กำ ́ á b", "᠎ x", "​ y   z", "  leading and trailing  ", "ǅ ª Ⅰ ² ok", "_ ‿ x", "؀ a",
]


def brute(texts):
    """Rows as the contract states them, by dictionaries of ends."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    level = T.byte_alphabet()
    vocab = {i: t for t, i in a.get_vocab().items()}

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    linked, out = [], []
    for t in texts:
        whole = (" " + t).encode() if t else b""
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        xb, yb = [bytes(level[c] for c in vocab[i]) for i in x], [bytes_b(i) for i in y]
        if not t or b"".join(xb) != whole or b"".join(yb) != whole:
            linked.append([])
            out.append((0, 0, 0, ""))
            continue
        ends = [np.cumsum([len(v) for v in side]).tolist() for side in (xb, yb)]
        text, links, i, j = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            text.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            links.append((x[p - 1], y[q - 1]))
            i, j = p, q
        linked.append(links)
        out.append((len(x), len(y), len(text), hashlib.sha256(";".join(text).encode()).hexdigest()))
    count = Counter(p for links in linked for p in links)
    most = Counter()
    for (_, q), n in count.items():
        most[q] = max(most[q], n)
    return [(n_a, n_b, n, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), sha) for (n_a, n_b, n, sha), links in zip(out, linked, strict=True)]


def report(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = T.alignment_report(df, A, B).orderBy("doc_id").collect()
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


def test_bitsets():
    rng = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 500):
        places = np.flatnonzero(rng.random(size) < 0.4)
        words = T.pack(places, size)
        assert (T.select(words) == places).all()
        assert (T.rank(words, np.arange(size)) == np.cumsum(np.isin(np.arange(size), places))).all()


def test_odd_and_random_texts(spark):
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", " ", "　", "\x85", "\x1c", "a", "Bc", "12", "'s", "!", "é", "你", "\U0001f600", "́", "_", "<|endoftext|>", "\r"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    assert report(spark, texts) == brute(texts)


@pytest.mark.parametrize("settings", [{}, {"KNOWN_UNITS": 50, "LONG_UNIT": 4, "AT_ONCE": 64, "IN_ROW": 3}, {"MOST_PAIRS": 1}])
def test_documents(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(T, k, v)
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()]
    texts += texts[:3]
    assert report(spark, texts) == brute(texts)


def test_units_equal_whole_texts(monkeypatch):
    """A pair without proven cuts is applied to whole texts and gives the same."""
    texts = [t for t in ODD if t] + ["some words, again some words\nhere"]
    by_units, whole = T.Pair(json.dumps([A, B])), T.Pair(json.dumps([A, B]))
    whole.safe = False
    x, y = by_units.align(texts), whole.align(texts)
    assert x[0] == y[0] and all((p == q).all() for p, q in zip(x[1:], y[1:], strict=True))


def test_no_rows_and_null_ids(spark):
    assert T.alignment_report(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    rows = T.alignment_report(spark.createDataFrame([(None, "a b"), (1, None), (None, "a b")], "doc_id long, text string"), A, B).collect()
    assert sorted((r.n_a, r.n_links, r.count_sum) for r in rows) == [(0, 0, 0), (2, 2, 4), (2, 2, 4)]
