import random
from collections import Counter

import numpy as np
import pytest

from strata.llm import minhash

from .helpers import awkward, documents, passage


def bag(text):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute(texts):
    """Class of each text, the smallest index in it."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [bag(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (texts[i] or "") == (texts[j] or "") or either and 5 * both >= 4 * either:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def check(spark, texts):
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_against_brute_force(spark):
    check(spark, awkward())


def test_chains_and_repetition(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(4):  # each close to the next only
        words = passage(rng, 120).split()
        for i in range(12):
            words = words[:]
            words[(37 * i) % 120] = f"y{i}"
            words[(37 * i + 60) % 120] = f"z{i}"
            texts.append(" ".join(words))
    line = passage(rng, 9)
    texts += [" ".join([line] * n) for n in (10, 11, 12, 16, 30)]
    rng.shuffle(texts)
    check(spark, texts)


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    items = rng.integers(1, 1 << 63, 60, dtype=np.uint64)
    errors = []
    for _ in range(20):
        a, b = rng.integers(0, 12, 60), rng.integers(0, 12, 60)
        sign = minhash.signatures([(items[a > 0], a[a > 0]), (items[b > 0], b[b > 0])], 2000)
        errors.append((sign[0] == sign[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.008
    assert max(map(abs, errors)) < 0.05


def test_one_of_each_class_stays_and_empty_table(spark):
    texts = awkward()
    docs = documents(spark, texts)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute(texts)))
    assert minhash.classes(documents(spark, [])).count() == 0
    rows = minhash.keep_one(documents(spark, ["a b", "a b", "c", None], ids=[3, 3, None, None])).collect()
    assert sorted(str(r["text"]) for r in rows) == ["None", "a b", "c"]


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in minhash.components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {x: x for l in links for x in l}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(root[a], root[b])
            moved |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert minhash.components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_near_copies_of_a_template_among_its_variants(spark):
    """No variant is similar enough to another text, and one is the pivot of every bucket of the two that are."""
    rng = random.Random(21)
    template = passage(rng, 200).split()
    texts = []
    for i in range(300):
        words = template[:]
        for k in range(11):
            words[18 * k + rng.randrange(8)] = f"v{i}x{k}"
        texts.append(" ".join(words))
    near = template[:]
    near[100] = "near"
    texts += [" ".join(template), " ".join(near)]
    assert brute(texts) == [*range(301), 300]
    check(spark, texts)


def test_large_buckets_and_stars_in_parts(spark, monkeypatch):
    """Buckets of more nodes than a block has and pivots of more than a star has, with links only between non-pivots."""
    monkeypatch.setattr(minhash, "BLOCK_NODES", 4)
    monkeypatch.setattr(minhash, "STAR", 3)
    rng = random.Random(31)
    base = passage(rng, 200).split()
    texts = []
    for i in range(40):  # pairs of near copies of variants, of which those of different pairs are just too far apart
        words = base[:]
        for k in range(6):
            words[30 * k + rng.randrange(20)] = f"v{i}x{k}"
        near = words[:]
        near[199] = f"n{i}"
        texts += [" ".join(words), " ".join(near)]
    check(spark, texts)
    check(spark, awkward(5))


@pytest.mark.parametrize("slack", [-0.21, 0.05, 0.8])
def test_signatures_decide_no_pair(spark, monkeypatch, slack):
    """Whether no, some or all pairs are compared as stars, the classes are the same."""
    monkeypatch.setattr(minhash, "SLACK", slack)
    check(spark, awkward(7))


def test_equal_bits_of_different_texts(spark):
    rows = [(1, 7, 70), (2, 7, 70), (3, 7, 71), (4, 8, 80)]
    got = {r["doc_id"]: r["node"] for r in minhash._apart(spark.createDataFrame(rows, "doc_id long, node long, check long")).collect()}
    assert got[1] == got[2] == 7 and got[4] == 8 and got[3] not in (7, 8)


def test_recall_on_a_whole_table(spark):
    """All pairs of a table with a common shingle, compared exactly: every class is found."""
    d = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(d)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    bags = {i: bag(t) for i, t in texts.items()}
    size = {i: sum(b.values()) for i, b in bags.items()}
    holders, pairs = {}, set()
    for i, b in bags.items():
        for s in b:
            holders.setdefault(s, []).append(i)
    for ids in holders.values():
        pairs |= {(a, b) for a in ids for b in ids if a < b and 5 * min(size[a], size[b]) >= 4 * max(size[a], size[b])}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for a, b in pairs:
        both = sum((bags[a] & bags[b]).values())
        if 5 * both >= 4 * (size[a] + size[b] - both):
            links += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    blank = [i for i in sorted(texts) if not size[i]]
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    assert links > 50 and got == {i: find(i) for i in texts} or blank and all(got[i] == find(i) for i in texts if size[i])
