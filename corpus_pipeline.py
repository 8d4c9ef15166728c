"""The training-data pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; between stages the rows are written as Parquet and read again. All stages
but the last return the columns of ``documents``.

1. language: documents without a letter, and long ones that are near to no learned
   language, go.
2. line_dedup: runs of two or more lines that stand earlier too are cut out; documents
   of which nothing is left go.
3. ngram_join: of each group of near duplicates the document with the smallest id
   stays.
4. mixing: each source is taken up to its target; a document that is taken several
   times becomes as many rows, one that isn't taken goes.
5. sentencepiece: the texts become ids.

Rows without an id pass stages 2 and 3 unchanged. Rows that repeat an id and its
text are one document to stage 2; rows that share an id stay or go together in
stage 3.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.llm.common import stage
from mailsieve.llm.language_id import UNKNOWN, held_out, learn, predict
from mailsieve.llm.line_dedup import run_dedup
from mailsieve.llm.mixing import mixed
from mailsieve.llm.ngram_join import ngram_join
from mailsieve.llm.sentencepiece_codec import encode
from mailsieve.session import ship

#: A text of at least so many characters with a lower score is in no learned language.
JUDGED_CHARS = 400
MIN_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = learn(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text"))
    known = predict(docs, model).filter(
        (F.col("lang_pred") != UNKNOWN) & ((F.char_length("text") < JUDGED_CHARS) | (F.col("score") >= MIN_SCORE))
    )
    return known.select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    kept = run_dedup(docs).filter((F.col("n_removed") == 0) | (F.col("text") != ""))
    return _measured(kept.select(docs.columns))


def _measured(docs: DataFrame) -> DataFrame:
    """With the length of the text as it is now, where the table holds lengths."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    others = ngram_join(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return encode(docs)


STAGES = [
    ("language", language),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("mixing", mix),
    ("sentencepiece", tokens),
]
#: Profiles, rolling hashes and merges are beyond SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
