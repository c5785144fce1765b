"""The pipeline's stages against plain versions of each, on whole tables."""

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strata.llm import crf, rules

from .helpers import awkward, documents
from .test_minhash import brute as classes_of
from .test_repeats import brute as covered_by

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r.asDict() for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, spark.createDataFrame([tuple(r[c] for c in columns) for r in before.values()], docs.schema), D)
        rows = out.collect()
        if i == 4:
            break
        assert out.columns == columns and len({r["doc_id"] for r in rows}) == len(rows)
        after = {r["doc_id"]: r.asDict() for r in rows}
        given = spark.createDataFrame([tuple(r[c] for c in columns) for r in before.values()], docs.schema)
        if i == 0:
            scores = {r["doc_id"]: r["score"] for r in crf.quality(given, spark.read.parquet(f"{D}/labels.parquet")).collect()}
            assert set(after) == {k for k, v in scores.items() if v >= 0.7}
        if i == 1:
            assert set(after) == {r["doc_id"] for r in rules.judge(given).where("kept").collect()}
        if i == 2:
            ids = sorted(before)
            roots = classes_of([before[k]["text"] for k in ids])
            assert set(after) == {ids[r] for r in roots}
        if i == 3:
            ids = sorted(before)
            words = [before[k]["text"].encode().split() for k in ids]
            for k, w, cover in zip(ids, words, covered_by(words, 35, False)):
                text = b" ".join(x for x, c in zip(w, cover) if not c).decode() if any(cover) else before[k]["text"]
                assert (after[k]["text"], after[k]["n_chars"]) == (text, len(text))
        else:
            assert all(after[k] == before[k] for k in after)
        assert after, name
        before = after
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {k: len(tokenizer.encode(v["text"], add_special_tokens=False).ids) + 1 for k, v in before.items()}
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == tokens


def test_run_and_registration(spark):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    out = corpus_pipeline.run(spark, D)
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.where("n > 2048").count() == 0 and out.count() > 100


def test_stages_stand_awkward_rows(spark):
    texts = awkward()
    docs = documents(spark, texts + ["one more", None, None], ids=[*range(len(texts)), None, None, 5])
    given = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, none = stage(spark, docs, D), stage(spark, documents(spark, []), D)
        assert none.count() == 0, name
        rows = out.collect()
        if i == 4:
            assert len({r["doc_id"] for r in rows}) == len({d for d, _ in given})
            continue
        assert out.columns == none.columns == docs.columns
        if i == 3:
            assert len(rows) == docs.count()
        else:
            assert {(r["doc_id"], r["text"]) for r in rows} <= given
