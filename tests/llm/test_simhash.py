"""SimHash groups against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from codexa.llm import simhash as S


def plain_fingerprint(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, bits=2):
    """Component of each fingerprint of a set, as a frozenset."""
    todo, out = set(fps), {}
    while todo:
        group, front = set(), [todo.pop()]
        while front:
            x = front.pop()
            group.add(x)
            near = {y for y in todo if (x ^ y).bit_count() <= bits}
            todo -= near
            front += near
        out |= dict.fromkeys(group, frozenset(group))
    return out


def test_fingerprints():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "É Ä b c d e", "x " * 5000]
    texts += [" ".join(rng.choice("ab cd Ef gh ij kl".split()) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    assert [S.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_long_texts_go_in_portions(monkeypatch):
    monkeypatch.setattr(S, "PORTION", 7)
    text = " ".join(str(i * i % 101) for i in range(500))
    assert S.fingerprint(text) == plain_fingerprint(text)


def test_gray_rank():
    code = np.array([i ^ (i >> 1) for i in range(1000)], np.uint64)
    assert (S.gray_rank(code) == np.arange(1000)).all()


@pytest.mark.parametrize("shape", [(1024, 16), (8, 2), (64, 4)])
def test_links(spark, monkeypatch, shape):
    """Close groups, chains and random entries: the forests have the components of all links, through many levels."""
    monkeypatch.setattr(S, "LEAF", shape[0])
    monkeypatch.setattr(S, "FAN", shape[1])
    rng = random.Random(shape[0])
    fps = {0, 1, 2**63, 2**64 - 1, 2**64 - 2} | {rng.getrandbits(64) for _ in range(300)}
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(2, 8)):
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(x)
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in S.near_links(df).collect()]
    right, parent = plain_components(fps), {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert right[a] == right[b]
        parent[root(a)] = root(b)
    assert len({root(x) for x in fps}) == len(set(right.values()))


def test_documents(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randint(0, 400)}" for _ in range(900))
    texts = [long, long + " end", long.upper(), "other words here now", None, "", "  ", "Other words here now"] + [f"text {i} of {i * 7}" for i in range(30)]
    rows = [(None if i == 4 else i, t, "x") for i, t in enumerate(texts)] + [(0, long, "y")]
    got = S.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    groups = plain_components(set(fps))
    want = sorted((str(i), f"{f:016x}", min(j for (j, _, _), g in zip(rows, fps, strict=True) if j is not None and g in groups[f])) for (i, _, _), f in zip(rows, fps, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert S.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
