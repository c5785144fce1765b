import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import debruijn, repeats, suffix

from .helpers import awkward, documents


def brute(parts: list, length: int, keep_first: bool):
    """For each text (a list of symbols or bytes), which symbols a repeated window covers."""
    seen, out = Counter(), []
    for p in parts:
        seen.update(tuple(p[i : i + length]) for i in range(len(p) - length + 1))
    before = set()
    for p in parts:
        cover = [False] * len(p)
        for i in range(len(p) - length + 1):
            w = tuple(p[i : i + length])
            if w in before if keep_first else seen[w] > 1:
                cover[i : i + length] = [True] * length
            before.add(w)
        out.append(cover)
    return out


def check_words(spark, texts, length, keep_first=False, most=repeats.MOST):
    got = {r["doc_id"]: r for r in debruijn.remove_repeated_words(documents(spark, texts), length, keep_first, most).collect()}
    assert len(got) == len(texts)
    words = [(t or "").encode().split() for t in texts]
    for i, (w, cover) in enumerate(zip(words, brute(words, length, keep_first))):
        kept = b" ".join(x for x, c in zip(w, cover) if not c)
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), sum(cover)), i
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert got[i]["kept"].encode() == kept


def check_bytes(spark, texts, length, keep_first=False, most=repeats.MOST):
    got = {r["doc_id"]: r for r in suffix.remove_repeated_bytes(documents(spark, texts), length, keep_first, most).collect()}
    assert len(got) == len(texts)
    data = [(t or "").encode() for t in texts]
    for i, (d, cover) in enumerate(zip(data, brute(data, length, keep_first))):
        kept = bytes(x for x, c in zip(d, cover) if not c)
        runs = sum(c and not (j and cover[j - 1]) for j, c in enumerate(cover))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(d), sum(cover), runs), i
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("most", [2, repeats.MOST])
def test_words_against_brute_force(spark, keep_first, most):
    check_words(spark, awkward(), 35, keep_first, most)
    check_words(spark, awkward(3), 8, keep_first, most)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("most", [2, repeats.MOST])
def test_bytes_against_brute_force(spark, keep_first, most):
    texts = [t if t is None or len(t) < 20_000 else t[:3000] + t[-600:] for t in awkward()]
    check_bytes(spark, texts, 400, keep_first, most)


def test_whole_table_of_words(spark):
    import duckdb

    d = "/root/testdata/sf0.001/documents.parquet"
    texts = [x[0] for x in duckdb.sql(f"select text from '{d}' order by doc_id").fetchall()]
    check_words(spark, texts, 35)


def test_empty_table_and_repeated_rows(spark):
    empty = documents(spark, [])
    assert debruijn.remove_repeated_words(empty).count() == 0
    assert suffix.remove_repeated_bytes(empty).count() == 0
    text = " ".join(f"v{i}" for i in range(50))
    rows = debruijn.remove_repeated_words(documents(spark, [text, text, "a b", None], ids=[4, 4, None, None])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 0), (0, 0), (4, 50), (4, 50)]


def test_texts_longer_than_a_block(monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.integers(0, 500, 3000)]
    text = " ".join(words + words[100:200]) + " "
    whole = repeats.word_symbols(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
    assert len(whole) == len(text.split())
    monkeypatch.setattr(repeats, "BLOCK", 700)
    assert (repeats._long_word_symbols(np.frombuffer(text.encode(), np.uint8)) == whole).all()
    texts = pa.array(["short", text, "", "x y z"])
    for unit, length, symbols in (("word", 35, whole), ("byte", 400, np.frombuffer(text.encode(), np.uint8))):
        places = []
        for first, part, cuts, base in repeats.blocks(texts, unit):
            got = repeats.runs(part, cuts, length, 6, 700 if len(cuts) == 2 and (base or len(part) > 700) else None)
            if got:
                assert first == 1
                places += [base + a + i for a, n in zip(got[1], got[2]) for i in range(n)]
        assert sorted(places) == list(range(len(symbols) - length + 1))


def test_ranks_are_suffix_order():
    data = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    for length in (3, 5, 11):
        rank = repeats.ranks(data, length)
        keys = [bytes(data[i : i + length]) for i in range(len(data) - length)]
        order = sorted(set(keys))
        assert [order.index(k) for k in keys] == [sorted(set(rank[: len(keys)])).index(r) for r in rank[: len(keys)]]
        previous, following = repeats.factors(rank, np.arange(len(keys)))
        assert list(previous) == [k in keys[:i] for i, k in enumerate(keys)]
        assert list(following) == [k in keys[i + 1 :] for i, k in enumerate(keys)]


def test_a_passage_of_many_texts_gives_few_rows(spark):
    """Runs at the edges of a common passage are cut where they differ and not into windows, which gave 989 rows here."""
    rng = np.random.default_rng(8)

    def made(n):
        return "".join(chr(c) for c in rng.integers(97, 123, n))

    passage = made(700)
    texts = [made(int(rng.integers(250, 450))) + passage + made(int(rng.integers(250, 450))) for _ in range(30)]
    texts += [texts[0][:500] + made(300), texts[1]]
    _, spans = repeats.repeated_spans(documents(spark, texts), "byte", 400, suffix.GRAM, most=5)
    assert spans.count() <= 25 * len(texts)
    for keep_first in (False, True):
        check_bytes(spark, texts, 400, keep_first, most=5)


@pytest.mark.parametrize("unit", ["byte", "word"])
def test_texts_without_hot_minimisers_are_not_shuffled_for_them(spark, unit):
    """Runs of hot minimisers are cut out of few texts; where these runs don't fit a broadcast, all texts were shuffled for them."""
    rng = np.random.default_rng(11)

    def made(n):
        return " ".join("".join(chr(c) for c in rng.integers(97, 123, 9)) for _ in range(n))

    passage = made(70)
    hot = [made(int(rng.integers(25, 45))) + " " + passage + " " + made(int(rng.integers(25, 45))) for _ in range(30)]
    texts = [made(500) for _ in range(400)] + hot
    check, length, gram = (check_bytes, 400, suffix.GRAM) if unit == "byte" else (check_words, 35, debruijn.GRAM)
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(60_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs, before = documents(spark, texts), written()
        repeats.repeated_spans(docs, unit, length, gram, most=5)  # what was hot is cut out by now, the rest isn't begun
        assert written() - before < 0.4 * sum(map(len, texts))
        check(spark, texts[-60:], length, most=5)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_minimisers_are_solved_together_or_alone():
    """However rows come in batches and however many minimisers are compared at once, the spans are the same."""
    rng = np.random.default_rng(3)
    shared = [rng.integers(0, 256, 90, dtype=np.uint8) for _ in range(12)]
    rows = []
    for mini, core in enumerate(shared):
        for i in range(1 + mini % 5 * 3):
            content = np.concatenate([rng.integers(0, 256, 7 * (i % 4), dtype=np.uint8), core, rng.integers(0, 256, 5, dtype=np.uint8)])
            rows.append((mini, 1, i, 100 + i, 1000 * mini, len(content) - 39, content.tobytes()))
    names = ["mini", "copies", "id", "key", "at", "n", "symbols"]
    types = [pa.int64()] * 5 + [pa.int32(), pa.binary()]

    def spans(together, batch):
        parts = [rows[i : i + batch] for i in range(0, len(rows), batch)]
        given = (pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*p), types)], names) for p in parts)
        return sorted(tuple(r.values()) for b in repeats._resolve("byte", 40, False, together)(given) for r in b.to_pylist())

    whole = spans(1 << 30, len(rows))
    assert len(whole) >= 50 and all(r[3] >= 90 for r in whole)
    for together, batch in ((1, 1), (1, 7), (500, 5), (500, len(rows)), (3000, 2)):
        assert spans(together, batch) == whole
