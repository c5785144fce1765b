"""Fingerprints, rules and sharding against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strata.llm import fingerprint, queries, rules, sharding

from .helpers import awkward, documents

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("bytes_per_part", [16 << 20, 400])
def test_fingerprints(spark, bytes_per_part):
    texts = awkward()
    got = {r["doc_id"]: r for r in fingerprint.edited_neighbours(documents(spark, texts, ids=[3 * i for i in range(len(texts))]), bytes_per_part=bytes_per_part).collect()}
    prints = {}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[3 * i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        sets = [shingle_set(x) for x in (t, edited, nxt)]
        error = 0 if max(map(len, sets)) <= 256 and len(sets[0] | sets[1] | sets[2]) <= 256 else 0.12
        assert abs(r["near_edited"] - likeness(sets[0], sets[1])) <= error + 1e-12
        assert abs(r["near_next"] - likeness(sets[0], sets[2])) <= error + 1e-12
        assert abs(r["distinct_shingles"] - len(sets[0])) <= 0.25 * len(sets[0]) * (len(sets[0]) >= 256)
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) == len({frozenset(shingle_set(t)) for t in prints})


def test_fingerprints_of_few_rows(spark):
    assert fingerprint.edited_neighbours(documents(spark, [])).count() == 0
    (one,) = fingerprint.edited_neighbours(documents(spark, ["a b c d e f g h"])).collect()
    assert one["edited_sha256"] == hashlib.sha256(("a b c d e f g h"[:12] + "a b").encode()).hexdigest()
    rows = fingerprint.edited_neighbours(documents(spark, ["x y", None, "p q", "p q"], ids=[None, 2, 2, 2])).collect()
    assert len(rows) == 4


def test_sketches_merge(spark):
    texts = [t for t in awkward() if t]
    whole = documents(spark, [" ".join(texts)])
    parts = documents(spark, texts).select(F.lit(1).alias("g"), fingerprint.sketch("text", 64).alias("sketch"))
    merged = set(fingerprint.merged(parts, ["g"], k=64).first()["sketch"])
    smallest = sorted({h for r in parts.collect() for h in r["sketch"]})[:64]
    assert merged == set(smallest)
    assert len(whole.select(fingerprint.sketch("text", 64).alias("s")).first()["s"]) == 64
    both = spark.createDataFrame([([1, 2, 3, 4], [1, 2])], "a array<long>, b array<long>")
    r = both.select(fingerprint.containment("b", "a").alias("c"), fingerprint.resemblance("a", "b").alias("r")).first()
    assert (r["c"], r["r"]) == (1.0, 0.5)


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_rule_statistics(spark):
    words = "la na ba da ga ka ma ra sa ta"
    texts = awkward() + [f"{words} x\n{words} x\n{words}", "#a *b|c <d> 100% $5 &c\n\n#a", "\x0b\x0c a\tb\r\nc é ", (words + " ") * 3 + " ".join(f"u{i}" for i in range(120))]
    got = {r["doc_id"]: r for r in rules.judge(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base(t), i
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["posterior"] <= 1
    assert rules.judge(documents(spark, [])).count() == 0


def test_rules_tell_bad_from_good(spark):
    """The votes of documents with labels: hardly a good one is lost and few bad ones stay."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = rules.judge(docs).join(labels, "doc_id").where("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.2 * n[0, False]
    kept = rules.keep(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rules.judge(docs).where("kept").collect()}


def test_estimate_finds_accuracies():
    """Votes drawn from known shares: what is estimated separates the classes as the truth does."""
    import random

    rng = random.Random(2)
    k = len(rules.RULES)
    caught = [0.3 + 0.06 * i for i in range(k)]
    drawn, truth = Counter(), {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = tuple((-1 if rng.random() < 0.005 else 1) if good else (-1 if rng.random() < caught[i] else 1) for i in range(k))
        drawn[votes] += 1
        truth.setdefault(votes, Counter())[good] += 1
    prior, weights = rules.estimate(sorted(drawn.items()))
    wrong = sum(truth[v][(prior + sum(w[x] for w, x in zip(weights, v))) < 0] for v in drawn)
    assert wrong < 0.02 * 20_000
    assert rules.estimate([])[0] == 0


@pytest.mark.parametrize("rows_per_cell", [7, 50_000])
def test_shards(spark, rows_per_cell):
    texts = awkward() * 8
    source = lambda i: None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}"
    rows = sharding.interleave(documents(spark, texts, source), 16, rows_per_cell=rows_per_cell).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    shards = {}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        shards.setdefault(r["shard"], []).append(r)
    assert set(shards) == set(range(16))
    sizes = [len(s) for s in shards.values()]
    assert max(sizes) - min(sizes) <= 1
    for s in shards.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    total = Counter(r["source"] for r in rows)
    for s in shards.values():
        mix = Counter(r["source"] for r in s)
        assert all(abs(mix[x] - n / 16) <= 2 + len(total) * n / len(rows) for x, n in total.items())
    again = sharding.interleave(documents(spark, texts, source), 16, rows_per_cell=rows_per_cell).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    other = sharding.interleave(documents(spark, texts, source), 16, seed=8).collect()
    assert {(r["doc_id"], r["shard"]) for r in rows} != {(r["doc_id"], r["shard"]) for r in other}


def test_shards_of_many_small_sources(spark):
    """Sources of one row each spread over all shards as evenly as one large source does."""
    n = 640
    source = lambda i: "hot" if i < n else f"s{i}" if i < 2 * n else f"p{i // 2}"
    rows = sharding.interleave(documents(spark, [f"text {i}" for i in range(4 * n)], source), 16, rows_per_cell=100).collect()
    for kind, of in (("h", n), ("s", n), ("p", 2 * n)):
        held = Counter(r["shard"] for r in rows if r["source"][0] == kind)
        assert all(abs(held[s] - of / 16) <= 1 for s in range(16)), (kind, held)
    pairs = Counter(r["source"] for r in rows if r["source"][0] == "p")
    assert set(pairs.values()) == {2}


def test_shards_of_few_rows(spark):
    assert sharding.interleave(documents(spark, [])).count() == 0
    rows = sharding.interleave(documents(spark, ["a", "a", None], ids=[1, 1, None]), 2).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(0, 0), (0, 1), (1, 0)]


def test_all_ten_are_registered():
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))
