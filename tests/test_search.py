"""Vector and keyword search."""

import tracemalloc
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailsieve.operators import cells, codes, filters, keyword, vectors
from mailsieve.plans import catalog
from mailsieve.plans import search as searches
from mailsieve.sources import views

MAIL = "uid string, subject string, sender string, date timestamp_ntz, body string"


@pytest.fixture(scope="module")
def emails(spark):
    rows = [
        ("uid1", "Code", "Ann@example.com", datetime(2025, 7, 13), "a body with code 123456"),
        ("uid2", "Plan", "bob@example.com", datetime(2025, 7, 12, 9), "a body without code, 100% sure"),
        ("uid3", "code plan", "cat@example.com", datetime(2025, 7, 11), "x" * 199 + "ab 654321"),
        ("uid4", "No date", "dan@example.com", None, None),
    ]
    return spark.createDataFrame(rows, MAIL)


@pytest.fixture(scope="module")
def index(spark):
    rows = [("uid1", [1.0, 0.0]), ("uid2", [0.8, 0.6]), ("uid3", [0.0, 1.0]), ("lost", [0.99, 0.141])]
    return spark.createDataFrame(rows, "uid string, embedding array<float>")


def ids(df):
    return [r["uid"] for r in df.collect()]


def brute_force(queries, points, k):
    """(query, uid, distance) by plain loops; ties by uid."""
    out = []
    for name, q in queries:
        near = sorted((float(((np.float32(p).astype(float) - np.float32(q).astype(float)) ** 2).sum()), uid) for uid, p in points)
        out += [(name, rank + 1, uid, round(d, 9)) for rank, (d, uid) in enumerate(near[:k])]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["uid"], round(r["distance"], 9)) for r in df.collect())


def test_knn(spark, index):
    hits = vectors.knn(index, [1.0, 0.0], k=2).collect()
    assert [h["uid"] for h in hits] == ["uid1", "lost"]
    assert hits[0]["similarity_score"] == 1.0
    assert vectors.knn(index.where("false"), [1.0, 0.0]).count() == 0


def test_search_filters_after_the_nearest(emails, index):
    run = lambda **kw: ids(searches.search(emails, index, [1.0, 0.0], **kw))
    assert run() == ["uid1", "uid2", "uid3"]
    assert run(date_after="2025-07-12") == ["uid1", "uid2"]
    assert run(date_before="2025-07-12") == ["uid3"]
    assert run(sender="ANN") == ["uid1"]
    assert run(regex=r"\d{6}") == ["uid1"]
    assert run(regex=r"\d{6}", regex_on="body") == ["uid1", "uid3"]
    assert run(limit=1, sender="cat") == []
    assert run(limit=1, sender="cat", filter_mode="pre") == ["uid3"]
    assert ids(searches.search_basic(emails, index, [1.0, 0.0], "2025-07-13")) == ["uid1"]
    with pytest.raises(ValueError):
        run(filter_mode="both")


def test_pre_holds_whatever_post_finds(emails, index):
    for k in (1, 2, 3, 4):
        post = ids(searches.search(emails, index, [0.5, 0.5], sender="b", limit=k))
        assert set(post) <= set(ids(searches.search(emails, index, [0.5, 0.5], sender="b", limit=k, filter_mode="pre")))


def test_keyword_search(emails):
    run = lambda q, **kw: [(r["uid"], r["similarity_score"]) for r in keyword.keyword_search(emails, q, **kw).collect()]
    assert run("code") == [("uid1", 3.0), ("uid3", 2.0), ("uid2", 1.0)]
    assert run("code", limit=1) == [("uid1", 3.0)]
    assert run("CODE plan") == [("uid3", 2.0), ("uid2", 1.5)]
    assert run("code code") == run("code")
    assert run("100%") == [("uid2", 1.0)]
    assert run("b_dy") == [("uid1", 0.0), ("uid2", 0.0)]
    assert run("") == [("uid1", 0.0), ("uid2", 0.0), ("uid3", 0.0), ("uid4", 0.0)]
    assert run("code", date_after="2025-07-12", regex=r"\d{6}") == [("uid1", 3.0)]
    assert run("back\\slash") == []


def test_hybrid(emails, index):
    run = lambda **kw: [(r["uid"], r["source"]) for r in searches.hybrid_search(emails, index, [1.0, 0.0], "code", **kw).collect()]
    assert run(limit=2) == [("uid1", "semantic")]
    assert run(sender="nobody") == [("uid1", "keyword"), ("uid3", "keyword"), ("uid2", "keyword")]
    assert run(sender="nobody", fallback_filters=True) == []


def test_uid_membership_with_repeats(spark, emails):
    uids = spark.createDataFrame([("uid1",)] * 5 + [("x",)], "uid string")
    assert ids(filters.uid_in(emails, uids)) == ["uid1"]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    rows = [(f"u{i:04d}", rng.normal(size=6).tolist()) for i in range(900)]
    # a third of all rows are copies of one vector
    return rows + [(f"c{i:04d}", rows[0][1]) for i in range(450)]


@pytest.fixture(scope="module")
def table(spark, points):
    return spark.createDataFrame(points, "uid string, embedding array<float>").repartition(5).cache()


@pytest.fixture(scope="module")
def queries(points):
    return [(f"q{i}", v) for i, (_, v) in enumerate(points[:120] + points[-3:])]


@pytest.fixture(scope="module")
def query_table(spark, queries):
    return spark.createDataFrame(queries, "query_id string, embedding array<float>")


def test_broadcast_join_is_exact(table, query_table, points, queries):
    assert found(cells.knn_join(query_table, table, k=7)) == brute_force(queries, points, 7)


@pytest.mark.parametrize("blocks", [{}, {"block_vectors": 50, "block_queries": 10}])
def test_cell_join_is_exact(table, query_table, points, queries, blocks):
    at = cells.sampled_cells(table, 12)
    got = cells.cell_join(query_table, cells.assign(table, at), at, 7, **blocks)
    assert found(got) == brute_force(queries, points, 7)


def test_large_query_table_takes_the_cells(table, query_table, points, queries):
    assert found(cells.knn_join(query_table, table, k=3, n_cells=8, method="cells")) == brute_force(queries, points, 3)


def test_an_index_knows_how_many_neighbours_it_was_built_for(table, query_table, points, queries):
    at = cells.sampled_cells(table, 6)
    index = cells.build_index(table, at, 3)
    assert found(cells.cell_join(query_table, index, at, 2, pruned=True)) == brute_force(queries, points, 2)
    with pytest.raises(ValueError):
        cells.cell_join(query_table, index, at, 4, pruned=True)


def test_long_vectors_lose_no_neighbour(spark):
    """Distances are small beside the lengths here."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=8) * 1e6
    rows = [(f"u{i:03d}", np.float32(base + rng.normal(size=8)).tolist()) for i in range(300)]
    asked = [(f"q{i}", v) for i, (_, v) in enumerate(rows[:40])]
    vectors = spark.createDataFrame(rows, "uid string, embedding array<float>")
    queries = spark.createDataFrame(asked, "query_id string, embedding array<float>")
    want = brute_force(asked, rows, 5)
    assert found(cells.knn_join(queries, vectors, k=5)) == want
    assert found(cells.knn_join(queries, vectors, k=5, n_cells=6, method="cells")) == want


def test_queries_too_large_to_send_are_refused(query_table, table, monkeypatch):
    monkeypatch.setattr(cells, "MAX_SENT_BYTES", 100)
    with pytest.raises(ValueError):
        cells.knn_join(query_table, table, k=3, method="sent")


@pytest.mark.parametrize("scans", [100, 1])
def test_queries_go_in_batches_or_by_cells(query_table, table, points, queries, monkeypatch, scans):
    monkeypatch.setattr(cells, "MAX_SENT_BYTES", 500)
    monkeypatch.setattr(cells, "MAX_SCANS", scans)
    assert found(cells.knn_join(query_table, table, k=3, n_cells=8)) == brute_force(queries, points, 3)


def test_vectors_of_other_widths_are_an_error(spark):
    mixed = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [1.0])], "uid string, embedding array<float>")
    for table, query in ((mixed, [1.0, 0.0]), (mixed.limit(1), [1.0, 0.0, 0.0])):
        with pytest.raises(Exception, match="width"):
            vectors.knn(table.coalesce(1), query).collect()


def test_query_tables_of_any_size_are_answered(spark, emails, index, monkeypatch):
    monkeypatch.setattr(cells, "MAX_SENT_BYTES", 100)
    asked = spark.createDataFrame([(f"q{i}", [1.0, i / 50]) for i in range(50)], "query_id string, embedding array<float>")
    assert searches.search_many(emails, index, asked, k=4).count() == 150  # one vector has no mail
    assert searches.search_many(emails, index.limit(0), asked, k=1).count() == 0
    assert catalog.v7_knn_join(spark, "/root/testdata/sf0.001").count() == 500 * catalog.NEIGHBOURS


def test_fewer_vectors_than_k(spark, query_table, points):
    few = spark.createDataFrame(points[:4], "uid string, embedding array<float>")
    at = cells.sampled_cells(few, 3)
    want = brute_force([(r["query_id"], r["embedding"]) for r in query_table.collect()], points[:4], 9)
    assert found(cells.cell_join(query_table, cells.assign(few, at), at, 9)) == want
    assert found(cells.broadcast_join(query_table, few, 9)) == want


def test_exact_routing_skips_cells(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), (rng.normal(size=4) * 0.01 + (i % 8) * 10).tolist()) for i in range(800)]
    table = spark.createDataFrame(rows, "uid string, embedding array<float>")
    at = cells.sampled_cells(table, 30)
    index = cells.assign(table, at)
    routed = cells.route(table.withColumnRenamed("uid", "query_id"), at, cells.summarize(index, at, 3), 3, None)
    assert routed.count() < 800 * 30 / 4


def test_approximate_search(table, query_table):
    at = cells.kmeans_cells(table, 10)
    report = cells.recall_report(query_table, table, at, 5, 3).first()
    assert 0.5 < report["recall"] <= 1 and 0 < report["candidate_fraction"] < 1
    full = cells.recall_report(query_table, table, at, 5, 10).first()
    assert full["recall"] == 1
    assert ids(cells.lsh_knn(table, [0.0] * 6, 3, bucket_length=5.0))
    with pytest.raises(ValueError):
        cells.sampled_cells(table, 0)


def test_recall_of_the_index_that_is_searched(spark):
    """Against all pairs, for what the query returns and for its report."""
    folder = "/root/testdata/sf0.01"
    got = found(catalog.v8_ann_cells(spark, folder).select("query_id", "rank", "uid", "distance"))
    rows = [(r["uid"], r["embedding"]) for r in views.vectors_view(spark, folder).collect()]
    want = brute_force(rows, rows, catalog.NEIGHBOURS)
    pairs = lambda hits: {(h[0], h[2]) for h in hits}
    assert len(pairs(got) & pairs(want)) >= 0.9 * len(pairs(want))
    assert catalog.v8_recall_report(spark, folder).first()["recall"] >= 0.9
    assert catalog.v8_lsh_recall_check(spark, folder).first()["recalls"]


def test_a_query_visits_many_cells_in_one_group(table, query_table, points, queries, monkeypatch):
    monkeypatch.setattr(cells, "CELL_GROUPS", 3)
    at = cells.sampled_cells(table, 40)
    got = cells.cell_join(query_table, cells.assign(table, at), at, 7, block_vectors=90, block_queries=20)
    assert found(got) == brute_force(queries, points, 7)


def test_embedding(spark):
    mail = spark.createDataFrame([("1", "a a b"), ("1", "a a b"), ("2", ""), ("3", None)], "uid string, body string")
    old = spark.createDataFrame([("3", [1.0])], "uid string, embedding array<float>")
    got = {r["uid"]: r["embedding"] for r in vectors.embed_new(mail, old, vectors.hashing_embedder(16)).collect()}
    assert set(got) == {"1", "2"} and got["2"] == [0.0] * 16
    assert sum(x * x for x in got["1"]) == pytest.approx(1, abs=1e-6)
    assert sorted(x for x in got["1"] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])


def test_model_embedder(spark):
    def make_predict():
        import numpy as np

        return lambda texts: np.array([[len(t), 3.0] for t in texts], dtype="float32")

    df = spark.createDataFrame([("abcd",), (None,)], "t string")
    rows = [r[0] for r in df.select(vectors.model_embedder(make_predict)(F.col("t"))).collect()]
    assert rows[0] == pytest.approx([0.8, 0.6]) and rows[1] == pytest.approx([0, 1])


def test_normalize(apply):
    assert apply(vectors.l2_normalize, [[3.0, 4.0], [0.0, 0.0]], "array<float>") == [
        pytest.approx([0.6, 0.8]), [0.0, 0.0],
    ]


def test_codes_find_nine_of_ten_with_little_work(spark, tmp_path):
    """Ids divisible by 50 against all rows; all work counts."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = rows.select(F.col("vec_id").cast("string").alias("uid"), "embedding")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    built = codes.build_codes(table, str(tmp_path / "codes"), 10)
    stored = codes.read_codes(spark, str(tmp_path / "codes"))
    assert stored.rerank == built.rerank and (stored.book.centres == built.book.centres).all()
    report = codes.recall_report(asked, table, stored, 10).first()
    assert report.queries == 40 and report.expected == 400
    assert report.recall >= 0.9 and report.work_share < 0.3
    with pytest.raises(ValueError):
        codes.code_join(asked, table, stored, 11)


def test_codes_in_batches_of_queries(spark, table, query_table, points, queries, tmp_path):
    width = len(points[0][1])
    book = codes.fit_codebook(table, parts=1 if width % 2 else 2, levels=8)
    index = codes.build_codes(table, str(tmp_path / "codes"), 5, book)
    one = found(codes.code_join(query_table, table, index, 5))
    assert found(codes.code_join(query_table, table, index, 5, batch=3)) == one
    everything = codes.CodeIndex(index.path, index.book, 5, len(points))
    assert found(codes.code_join(query_table, table, everything, 5)) == brute_force(queries, points, 5)
    assert codes.code_join(query_table.limit(0), table, index, 5).count() == 0


def test_the_sample_for_centres_is_narrowed_before_it_is_sent(spark, monkeypatch):
    rows = [(str(i), [float(i), 1.0]) for i in range(4000)] + [(None, [-1.0, 1.0])]
    table, sent = spark.createDataFrame(rows, "uid string, embedding array<float>").repartition(4), []
    order_by = type(table).orderBy

    def counted(self, *columns):
        sent.append(self.count())
        return order_by(self, *columns)

    place = F.md5(F.col("uid").cast("binary"))
    want = [list(r.embedding) for r in table.orderBy(place, "uid").limit(50).collect()]
    monkeypatch.setattr(type(table), "orderBy", counted)
    assert codes._sampled(table, 50).tolist() == want
    assert sent[0] < 400
    assert len(codes._sampled(table, 9999)) == 4001


def test_what_a_task_holds_does_not_grow_with_the_codes_to_rank_again(monkeypatch):
    monkeypatch.setattr(codes, "HELD_DISTANCES", 1 << 16, raising=False)
    rng = np.random.default_rng(3)
    book = codes.Codebook(rng.normal(size=(2, 16, 3)))
    asked, points = rng.normal(size=(200, 6)), rng.normal(size=(20_000, 6))
    code = book.encode(points)
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array([str(n) for n in range(at, at + 5000)]), pa.array([c.tobytes() for c in code[at : at + 5000]], pa.binary())],
            ["uid", "code"],
        )
        for at in range(0, 20_000, 5000)
    ]
    run = codes._best_codes([str(n) for n in range(200)], asked, book, 8000)
    rough, seen = codes._rough(book.tables(asked), code), {}
    tracemalloc.start()
    for hit in run(iter(batches)):
        for query in set(hit.column("query_id").to_pylist()):
            seen[query] = seen.get(query, 0) + hit.num_rows
            assert max(hit.column("rough").to_pylist()) <= np.sort(rough[int(query)])[7999]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == {str(n): 8000 for n in range(200)} and peak < 12 << 20


def test_parts_of_bounded_size_are_compared(monkeypatch):
    rng, sizes, nearest = np.random.default_rng(4), [], cells._nearest_in_block

    def sized(queries, vectors, *rest):
        sizes.append(len(queries) * len(vectors))
        return nearest(queries, vectors, *rest)

    monkeypatch.setattr(cells, "_nearest_in_block", sized)
    asked, points = rng.normal(size=(600, 4)), rng.normal(size=(5000, 4))
    table = pa.table({"uid": [str(n) for n in range(5000)], "embedding": points.tolist(), "cell": [0] * 5000})
    queries = pa.table({
        "query_id": [str(n) for n in range(600)], "embedding": asked.tolist(), "cells": pa.array([[0]] * 600, pa.list_(pa.int32())),
    })
    joined = cells._block_hits(3)(table, queries)
    scanned = pa.Table.from_batches(cells._scan_with([str(n) for n in range(600)], asked, 3)(iter(table.to_batches())))
    want = np.sort(((asked[:, None] - points) ** 2).sum(2), axis=1)[:, :3]
    for got in (joined, scanned):
        assert np.allclose(got.column("distance").to_numpy().reshape(600, 3), want)
    assert max(sizes) <= 256 * 4096


def test_recall_is_measured_on_ids_divisible_by_50(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(cells, "recall_report", lambda queries, *rest: asked.append(queries.count()))
    catalog.v8_recall_report(spark, "/root/testdata/sf0.01")
    assert asked == [10]


def test_tokens_are_hashed_once(spark):
    """Hash buckets are the first 28 bits of MD5; no token is hashed by an expression of its own."""
    texts = [None, "", "...", "a A b-a_1", "Ünï cödé—dash\xa0nbsp İstanbul ΣΑΣ ΟΔΟΣ. x²½ ٣٤", "日本、語 áb 𝒳𝒴-𝒵 _under_", "only ascii, twice: ascii"]
    split = F.filter(F.split(F.lower(F.coalesce("t", F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")
    bucket = lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 7), 16, 10).cast("int") % 64
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    new = df.select(vectors.hashing_embedder(64)(F.col("t")).alias("v"), F.transform(split, bucket).alias("b"))
    for r in new.collect():
        counts = np.bincount(r["b"], minlength=64)
        assert np.allclose(r["v"], counts / (np.linalg.norm(counts) or 1), atol=1e-7)
    plan = df.select(vectors.hashing_embedder(64)(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan
