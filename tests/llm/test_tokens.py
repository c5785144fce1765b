"""BPE against tiktoken, pieces against tokenizers, packing against its bounds."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from strata.llm import bpe, packing

from .helpers import awkward, documents

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def texts():
    odd = ["<|endoftext|> and <|endoftext|>", "it's they'll I'VE  \n\n\t x", "日本語のテキスト" * 30, "a" * 700, " " * 300 + "x", "   y", "👩‍🔬🏳️‍🌈", "naïve Ünïcödé 12345 ½ ٣٤", "\x00\x01﻿"]
    return awkward() + odd * 2


@pytest.mark.parametrize("words", [0, 5, 200_000])
def test_bpe_like_tiktoken(spark, words):
    ranks = bpe.load_ranks(RANKS)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(documents(spark, texts()), RANKS, P.PATTERN, words), RANKS).collect()
    assert len(rows) == len(texts())
    for r in rows:
        text = texts()[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == other.encode_ordinary(text)
        assert bytes(r["bytes"]) == text.encode()
        assert r["tokens"] == other.encode_ordinary(text)
    assert bpe.encode(documents(spark, []), RANKS, P.PATTERN, words).count() == 0


def test_decoding(spark):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    ranks = bpe.load_ranks(RANKS)
    every = sorted(ranks.values())
    by_id = {v: k for k, v in ranks.items()}
    lists = [every, [], None, every[::-7], every[::-7]]
    rows = spark.createDataFrame(list(enumerate(lists)), "k int, tokens array<int>").withColumn("bytes", F.lit("clashes"))
    got = {r["k"]: r["bytes"] for r in bpe.decode(rows, RANKS).collect()}
    assert got == {k: None if x is None else b"".join(map(by_id.get, x)) for k, x in enumerate(lists)}
    assert bpe.decode(rows.limit(0), RANKS).count() == 0
    for bad in ([len(every) + 5], [-1], [None]):
        with pytest.raises(PySparkException, match="no token"):
            bpe.decode(spark.createDataFrame([(bad,)], "tokens array<int>"), RANKS).collect()


def test_folds_agree(spark):
    import regex
    from pyspark.sql import functions as F

    ranks = bpe.load_ranks(RANKS)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = sorted({w for t in texts() for w in regex.findall(P.PATTERN, t or "")} | {"é" * 100, "abcdefgh" * 20})
    got = spark.createDataFrame([(w,) for w in words], "word string").select("word", bpe.encoded(F.col("word"), bpe._rank_map(ranks)).alias("ids")).collect()
    for r in got:
        assert r["ids"] == bpe.fold_bytes(r["word"].encode(), ranks) == other.encode_ordinary(r["word"]), r["word"]


def want_pieces(text, tokenizer):
    ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
    first = len(ids) % 2048 or 2048
    cuts = [0, *range(first, len(ids) + 1, 2048)]
    return [(i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_packed_documents(spark):
    tokenizer = Tokenizer.from_file(JSON)
    assert tokenizer.encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]
    rows = packing.pack_documents(documents(spark, texts()), JSON, P.PATTERN).collect()
    got, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts()):
        assert sorted(got[i]) == want_pieces(t or "", tokenizer), i
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = np.array([r["length"] for r in rows])
    assert len(bins) == packing.lower_bound(np.bincount(lengths), 2048)
    assert packing.pack_documents(documents(spark, []), JSON, P.PATTERN).count() == 0


def fewest(lengths, capacity):
    """Fewest bins, by trying."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, [r - lengths[i] * (j == k) for j, r in enumerate(rooms)])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_bounds_hold():
    rng = random.Random(6)
    met = 0
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        lengths = np.array([rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))])
        bins, offsets, count = packing.best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths)
        assert fill.max() <= capacity and len(fill) == count
        bound = packing.lower_bound(np.bincount(lengths), capacity)
        assert bound <= fewest(lengths, capacity) <= count
        met += bound == count
    assert met > 120


def test_counts_are_packed_like_items():
    rng = random.Random(9)
    for i in range(300):
        capacity = rng.choice([10, 17, 64, 2048])
        kinds = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 12))]
        lengths = np.array([rng.choice(kinds) if i % 2 else rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 400))])
        count = np.bincount(lengths, minlength=capacity + 1)
        patterns = packing.best_fit_by_count(count, capacity)
        assert sum(b for b, _ in patterns) == packing.best_fit_decreasing(lengths, capacity)[2]
        held = Counter()
        for b, pattern in patterns:
            assert sum(n * each for n, each in pattern) <= capacity
            for n, each in pattern:
                held[n] += b * each
        assert held == Counter(lengths.tolist())


def test_counts_of_a_huge_corpus():
    """Ten thousand million items in a moment: what the driver does depends on the number of lengths."""
    rng = np.random.default_rng(4)
    count = rng.integers(0, 10_000_000, 2049)
    count[0] = count[2048] = 0
    patterns = packing.best_fit_by_count(count, 2048)
    bins, bound = sum(b for b, _ in patterns), packing.lower_bound(count, 2048)
    assert len(patterns) < 20_000 and bound <= bins <= bound * 11 / 9 + 1  # the rule's worst case
    begin, each, first, offset = packing.places(patterns)
    assert len(begin) < 200_000 and (np.diff(begin) > 0).all()


def test_partitions_exchange(spark):
    """Small partitions leave gaps that exchanging closes."""
    rng = random.Random(8)
    rows = [(i, 0, 0, rng.choice([2048, *[rng.randrange(1, 2048)] * 9]), i) for i in range(900)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    lengths = np.array([r[3] for r in rows])
    for dealt in (40, 7, 1, 10_000):
        got = packing.pack(items, dealt=dealt).collect()
        assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((r[0], r[3]) for r in rows)
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 2048
        apart = sum(packing.best_fit_decreasing(lengths[i : i + dealt], 2048)[2] for i in range(0, 900, dealt)) if dealt < 900 else 900
        bound = packing.lower_bound(np.bincount(lengths), 2048)
        assert bound <= len(bins) <= bound + 1 and len(bins) < apart
        assert max(r["part_bins"] - r["part_bound"] for r in got) <= 1
    assert packing.pack(items.where("length = 2048")).count() == (lengths == 2048).sum()


def test_digest_of_ids():
    assert hashlib.sha256(np.array([1, 256], "<u4").tobytes()).hexdigest() == hashlib.sha256(bytes([1, 0, 0, 0, 0, 1, 0, 0])).hexdigest()
