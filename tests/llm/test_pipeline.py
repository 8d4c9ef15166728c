"""The pipeline stage by stage against brute force, and as a whole."""

from ast import literal_eval

import pytest
from pyspark.sql import functions as F
from test_operators import brute_join, brute_runs

import corpus_pipeline
from mailsieve.llm import mixing, sentencepiece_codec
from mailsieve.llm.common import stage

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(-1, "12 34 -- 5", "en", "src0", 9), (-2, None, "en", "src0", 0), (-3, "", None, None, 0)], docs.schema
    )
    found = [stage(docs.unionByName(odd), "test")]
    for _, step in corpus_pipeline.STAGES:
        found.append(stage(step(spark, found[-1], FOLDER), "test"))
    return found


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_language_keeps_all_but_unreadable_texts(stages):
    before, after = {r[0] for r in rows(stages[0])}, {r[0] for r in rows(stages[1])}
    assert before - after == {-1, -2, -3}


def test_lines(stages):
    given = rows(stages[1])
    want = brute_runs(given)
    kept = {i: text for i, (text, gone) in want.items() if not gone or text}
    assert dict(rows(stages[2])) == kept
    assert stages[2].filter("n_chars <> char_length(text)").count() == 0


def test_near_duplicates(stages):
    given = rows(stages[2])
    components = [literal_eval(row) for row in brute_join(given)]
    keep = {i for i, _, component in components if component == i}
    assert {i for i, _ in rows(stages[3])} == keep and len(keep) < len(given)


def test_mixing_repeats_rows(stages):
    want = {r.doc_id: r.taken // r["size"] for r in mixing.apply_mix(stages[3]).collect() if r["size"]}
    got = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_ids(stages):
    library = sentencepiece_codec.pieces_of(sentencepiece_codec.MODEL).library
    given = sorted((i, library.encode(t)) for i, t in rows(stages[4]))
    got = sorted((r.doc_id, list(r.token_ids)) for r in stages[5].collect())
    assert got == given and stages[5].filter("not round_trip").count() == 0


def test_columns_and_run(spark, stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])
    without = stages[5].filter("doc_id >= 0")
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.columns == without.columns and whole.count() > 0


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(F.lit(False))
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, FOLDER), "test")
    assert docs.count() == 0
