"""The registered queries against SQL, and the pipeline against a brute-force run."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_resemblance import brute_components
from test_training_operators import brute_measures

import __spark_entry__ as entry
import corpus_pipeline
from check import rows_of
from tripweave.llm import queries, toxicity
from tripweave.llm.common import table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, key):
    con = duckdb.connect()
    for name in ("pages", "conversations", "documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    frame = entry.queries()[key](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(names, result.fetchall())


def test_all_queries_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_pipeline_by_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    quality, toxic, copies, packing = (f for _, f in corpus_pipeline.STAGES)

    kept = quality(spark, docs, FOLDER)
    # two hundred documents certify no cutoff, so the base rules alone decide
    measured = {i: brute_measures(t) for i, t in rows}
    want = {i for i, m in measured.items() if m[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want

    clean = toxic(spark, kept, FOLDER)
    model = toxicity.fit(kept, table(spark, FOLDER, "labels"), ~toxicity.held_out(F.col("doc_id")))
    want = {i for i, t in rows if i in want and toxicity.score_text(t, model, model.memo())[0] < 0.5}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == want

    single = copies(spark, clean, FOLDER)
    left = sorted((i, t) for i, t in rows if i in want)
    want = {left[k][0] for k in set(brute_components([t for _, t in left]))}
    assert single.columns == docs.columns and Counter(r.doc_id for r in single.collect()) == Counter(want)

    pieces = packing(spark, single, FOLDER).collect()
    tokens = {p.doc_id: p.doc_tokens for p in pieces}
    assert set(tokens) == want and sum(p.length for p in pieces) == sum(tokens.values())
    assert {p.doc_id: p.doc_tokens for p in corpus_pipeline.run(spark, FOLDER).collect()} == tokens


def test_pipeline_takes_awkward_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, 0, "x"), (1, None, None, None, 0, "x"), (None, "word " * 3 + " ".join(f"w{i}" for i in range(80)), "en", "s", 9, "y")] * 2,
        "doc_id long, text string, lang string, source string, n_chars long, row string",
    )
    for frame, empty in ((docs, False), (docs.limit(0), True)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, FOLDER)
            assert name == "packing" or out.columns == docs.columns
            frame = out
        # rows without words fall to the base rules; of the repeated long row one copy stays, whole
        pieces = frame.collect()
        assert {p.doc_id for p in pieces} == (set() if empty else {None})
        assert sum(p.length for p in pieces) == sum({p.doc_tokens for p in pieces})
