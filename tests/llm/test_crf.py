import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strata.llm import crf

from .helpers import awkward, documents


def random_lines(rng, counts):
    counts = np.array(counts)
    x = rng.normal(size=(counts.sum(), crf.N_FEATURES))
    return crf.Lines(np.cumsum(counts) - counts, counts, rng.integers(1, 9, counts.sum()).astype(float), x)


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(2)
    lines = random_lines(rng, [1, 4, 2, 6])
    model = crf.Model(rng.normal(size=3 * crf.N_FEATURES) * 0.3, rng.normal(size=(2, 2)))
    x = crf.neighbours(lines)
    got = model.raw(lines, x)
    for d, (first, count) in enumerate(zip(lines.first, lines.count)):
        e = x[first : first + count] @ model.weights
        weight, good = 0.0, np.zeros(count)
        for y in itertools.product((0, 1), repeat=count):
            p = np.exp(sum(e[t] * y[t] for t in range(count)) + sum(model.moves[a, b] for a, b in zip(y, y[1:])))
            weight += p
            good += p * np.array(y)
        length = lines.length[first : first + count]
        mean = (good / weight * length).sum() / length.sum()
        assert abs(np.log(mean / (1 - mean)) - got[d]) < 1e-9


def test_features_look_at_lines_of_their_own_text():
    alone = list(crf.features(pa.array(["Ab cd.\n\nxx xx XX!! #", "", "Ab cd."])))
    together = list(crf.features(pa.array(["Ab cd."])))
    assert np.allclose(alone[0].x[-1], together[0].x[0])
    assert list(alone[0].count) == [2, 1, 1]


def test_long_texts_are_cut(monkeypatch):
    text = "\n".join(f"Line {i} of the text, quite plain." for i in range(400))
    (whole,) = crf.features(pa.array([text]))
    monkeypatch.setattr(crf, "BLOCK", 1000)
    (pieces,) = crf.features(pa.array([text]))
    assert np.allclose(whole.length, pieces.length) and np.allclose(whole.x, pieces.x)
    got = list(crf.features(pa.array(["a b", text, "x" * 5000, "c"])))
    assert sum(len(b.count) for b in got) == 4


def test_held_out_quality(spark):
    """On rows whose labels were never seen: the score orders them and the threshold parts them."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = crf.quality(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    rows = [r for r in got if r["held_out"]]
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([[(a > b) + (a == b) / 2 for b in bad] for a in good]) > 0.97
    assert np.mean([a >= 0.7 for a in good]) > 0.97 and np.mean([b < 0.7 for b in bad]) > 0.85


def test_awkward_rows_and_labels(spark):
    texts = awkward()
    docs = documents(spark, texts)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = crf.quality(docs, none).collect()
    assert len(rows) == len(texts) and len({r["score"] for r in rows}) == 1
    assert crf.quality(documents(spark, []), none).count() == 0
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(len(texts))] + [(None, 1), (1, None), (1, 7), (2, 0), (2, 1)], "doc_id long, quality int")
    rows = crf.quality(docs, labels).collect()
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r["doc_id"]] or "", r["score"]) == r["score"]
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(crf.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r["doc_id"], r["score"]) for r in crf.quality(docs, flipped).collect()} == {(r["doc_id"], r["score"]) for r in rows}
    kept = crf.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_lines_repeat_over_the_pieces_of_a_long_text():
    once = [" ".join(f"w{i}x{k}" for k in range(6)) for i in range(60_000)]
    lines = once[:30_000] + ["a line that comes again"] + once[30_000:] + ["a line that comes again"]
    text = "\n".join(lines)
    assert len(text) > 4 * crf.BLOCK
    (got,) = crf.features(pa.array([text]))
    assert np.flatnonzero(got.x[:, crf.REPEATED]).tolist() == [30_000, 60_001]


def test_a_long_line_is_cut_between_words():
    word = "abcdefg"
    (got,) = crf.features(pa.array([" ".join([word] * 400_000)]))
    assert len(got.length) > 1
    assert np.rint(np.expm1(4 * got.x[:, 0])).sum() == 400_000
