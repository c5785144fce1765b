"""Registered queries as the driver runs them."""

import glob
import hashlib
import os

import duckdb
import pytest

from strata.llm import queries

D = "/root/testdata/sf0.001"
DOCUMENTS = {"op1", "op3", "op4", "op5", "op6", "op8", "op9", "op10"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    want = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, D)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_whole_tables(spark, duck, name):
    rows = queries.queries()[name](spark, D).collect()
    if name.split("_")[0] in DOCUMENTS:
        assert sorted(r["doc_id"] for r in rows) == [x[0] for x in duck.sql("select doc_id from documents order by 1").fetchall()]
    elif name.startswith("op7"):
        assert {r["doc_id"] for r in rows} == {x[0] for x in duck.sql("select doc_id from documents").fetchall()}
    else:
        assert {r["conv_id"] for r in rows} == {x[0] for x in duck.sql("select conv_id from conversations").fetchall()} | {-1}
        (extra,) = [r for r in rows if r["conv_id"] == -1]
        text = "<|im_end|><|im_start|>assistant ok"
        assert extra["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
        assert (extra["n_turns"], extra["loss_chars"], extra["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
