"""The trigram index gives the rows of the plain scan and reads candidates only."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailsieve.operators import filters, postings

WORDS = ["alpha", "alphabet", "beta", "gamma", "delta", "Großes", "naïve", "日本語", "a", "of", "100%", "x_y", "back\\slash", "𝒳𝒴𝒵"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    random.seed(3)
    rows = [(str(n), " ".join(random.choices(WORDS, k=2)), "\n".join(random.choices(WORDS, k=random.randint(0, 5)))) for n in range(400)]
    rows += [("null", None, None), ("empty", "", ""), ("long", "s", "filler " * 60_000 + "needle"), ("UP", "ALPHA", "BETA")]
    mail = spark.createDataFrame(rows, "uid string, subject string, body string").repartition(3)
    return postings.build_index(mail, str(tmp_path_factory.mktemp("index") / "postings"), buckets=8)


@pytest.mark.parametrize(
    "query",
    ["alpha", "ALPHA beta", "alph_bet", "%lta gam%ma", "großes", "naïve 日本語", "日本", "a of", "", "100%", "needle", "absent word",
     "back\\slash", "x_y", "𝒳𝒴𝒵", "lphabe alpha alpha", "al%bet"],
)
def test_same_rows_as_the_scan(spark, index, query):
    got = sorted(r.uid for r in postings.keyword_rows(spark, index, query).select("uid").collect())
    scan = index.mail(spark).where(filters.keyword_match(filters.keywords(query)))
    assert got == sorted(r.uid for r in scan.select("uid").collect())


def test_many_candidates_are_joined(spark, index, monkeypatch):
    monkeypatch.setattr(postings, "PUSHED", 2)
    test_same_rows_as_the_scan(spark, index, "alpha")


def test_only_candidates_are_read(spark, index):
    df = postings.keyword_rows(spark, index, "needle")
    plan = df._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(bucket" in plan.toString() and "EqualTo(uid,long)" in plan.toString()
    assert plan.collectLeaves().head().selectedPartitions().partitionCount() == 1
    assert [tuple(r) for r in postings.candidates(spark, index, ["needle"]).collect()] == [("long",)]


def test_sizes_name_the_rarest(spark, index):
    (gram, size), *_ = postings.rarest(spark, index, {"fil", "alp"})
    assert (gram, size) == ("fil", 1)
    sizes = index.sizes(spark)
    assert sizes.agg(F.sum("messages")).first()[0] == index.postings(spark).count()


def test_postings_are_stored_as_lists(spark, index):
    lists = spark.read.parquet(f"{index.path}/postings").agg(F.count("*").alias("rows"), F.sum(F.size("uids")).alias("uids")).first()
    assert lists["uids"] == index.postings(spark).count() > 4 * lists["rows"]


def test_lists_by_pieces_and_rows(monkeypatch):
    """Trigrams across the pieces of a text are found once, and lists of some messages hold all."""
    monkeypatch.setattr(postings, "PIECE", 4)
    monkeypatch.setattr(postings, "HELD", 5)
    rows = [("1", "abcdefgh", "abcabcabc"), ("2", "", ""), ("3", "𝒳𝒴𝒵ab", "x"), (None, "abc", "ab"), ("1", "abc", ""), ("5", "", "")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["uid", "subject", "body"])
    want, got = defaultdict(list), defaultdict(list)
    for uid, *texts in rows:
        for gram in {t[i : i + 3] for t in texts for i in range(len(t) - 2)}:
            want[gram].append(uid)
    for part in postings._postings(iter([batch, batch.slice(1, 1), batch.slice(0, 0)])):
        for gram, uids in zip(part.column("gram").to_pylist(), part.column("uids").to_pylist()):
            got[gram] += uids
    assert got == want
