"""The persistent indexes against scans of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provisio.operators import indexing, lexical_index, pipeline, retrieval, vector_index


def zipf(rng, n):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(n))


def documents(rng):
    rows = [(i, zipf(rng, rng.choice([3, 10, 40, 40, 300]))) for i in range(400)]
    rows += [(400, None), (401, ""), (None, "w1 w2"), (402, "rare w1 Rare"), (403, "Żółty rare"), (404, "rare"), (405, "w1 " * 900 + "w2"), (406, rows[0][1]), (2, "w1 w2 w3")]
    return rows


QUERIES = [(1, "w1 w2 w3"), (2, "w7"), (3, "zolty rare"), (4, "nowhere"), (5, ""), (6, "w1 w1 w5 w250 w90"), (7, "rare nowhere w333"), (8, None), (9, "w1 " + " ".join(f"w{i}" for i in range(2, 60)))]


def best(rows, limit):
    found = {}
    for q, i, n, r in sorted(rows, key=lambda x: (x[0], -x[3], x[1])):
        found.setdefault(q, []).append((i, n, r))
    return {q: v[:limit] for q, v in found.items()}


@pytest.mark.parametrize(("block", "held", "seeds", "asked", "limit"), [(64, 2_000_000, 3, 2000, 5), (4, 700, 1, 2, 3), (8, 3000, 2, 1, 500)])
def test_lexical_index_finds_what_a_scan_finds(spark, block, held, seeds, asked, limit):
    docs = spark.createDataFrame(documents(random.Random(5)), "id long, text string").repartition(3)
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    index = lexical_index.built(docs, block=block, held=held)
    got = best(map(tuple, lexical_index.hits(index, queries, limit, seeds=seeds, most_asked=asked)[0].collect()), limit)
    assert got == best(map(tuple, retrieval.lexical_hits(docs, queries).collect()), limit) and set(got) == {1, 2, 3, 6, 9}
    places = lambda df: {tuple(r) for r in df.collect()}
    assert places(lexical_index.search(index, queries, limit).select("query_id", "id", "lexical_rank")) == places(retrieval.lexical_search(docs, queries, limit=limit).select("query_id", "id", "lexical_rank"))


def test_a_search_touches_few_documents(spark, tmp_path):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, zipf(rng, 10 + i * i // 1500) + (" odd even" if i % 300 == 0 else "")) for i in range(1500)], "id long, text string").repartition(2)
    path = f"{tmp_path}/index"
    lexical_index.built(docs, block=16, path=path)
    index = spark.read.parquet(path)
    queries = spark.createDataFrame([(1, "odd even"), (2, "odd w399"), (3, "w1 w2 w3 w4")], "query_id long, query string")
    found, read = lexical_index.hits(index, queries, 5)
    n = {r.query_id: r.n for r in lexical_index.touched(index, queries, read).collect()}
    assert n[1] == 5 and n[2] < 150 and n[3] < 750
    assert best(map(tuple, found.collect()), 5) == best(map(tuple, retrieval.lexical_hits(docs, queries).collect()), 5)


def test_lexical_index_is_updated(spark):
    rng = random.Random(8)
    old = {i: zipf(rng, 20) for i in range(60)}
    new = {i: t if i % 3 else zipf(rng, 25) for i, t in old.items() if i % 7} | {i: zipf(rng, 30) for i in range(60, 75)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, text string")
    changes = indexing.difference(*(frame(d).selectExpr("id", "sha2(text, 256) as content_hash") for d in (old, new)))
    index = lexical_index.updated(lexical_index.built(frame(old)), frame(new), changes, generation=1)
    again = lexical_index.updated(index, frame(new), changes.where("id >= 60").selectExpr("id", "'removed' as action"), generation=2)
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w4"), (3, "w1 w30")], "query_id long, query string")
    for own, docs in ((index, new), (again, {i: t for i, t in new.items() if i < 60})):
        assert best(map(tuple, lexical_index.hits(own, queries, 4)[0].collect()), 4) == best(map(tuple, retrieval.lexical_hits(frame(docs), queries).collect()), 4)


def vectors(n, size, centres, noise, seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    c = rng.normal(size=(centres, size))
    return (c[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, size))).tolist()


@pytest.mark.parametrize(("piece", "rounds", "limit", "asked"), [(1024, (4, 24), 10, 4000), (7, (1, 2), 3, 2), (50, (1,), 700, 4000)])
def test_vector_index_finds_what_a_scan_finds(spark, piece, rounds, limit, asked):
    rows = list(enumerate(vectors(500, 6, 9, 0.3, 1)))
    rows += [(500 + i, rows[0][1]) for i in range(40)] + [(600, None), (601, [0.0] * 6), (602, [float("nan")] * 6), (603, [1.0]), (None, rows[1][1]), (604, [-x for x in rows[0][1]]), (605, [1e-3 * x for x in rows[7][1]])]
    docs = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    asked_rows = [(i, rows[i * 20][1]) for i in range(12)] + [(90, None), (91, [0.0] * 6), (92, [float("inf")] * 6), (93, [1.0, 2.0])]
    queries = spark.createDataFrame(asked_rows, "query_id long, vector array<double>")
    index = vector_index.built(docs, piece=piece)
    found = vector_index.hits(index, queries, limit, rounds=rounds, most_asked=asked)[0]
    got = {(r.query_id, r.vector_rank): (r.id, round(r.similarity, 9)) for r in retrieval.top(found, F.desc(F.round("similarity", 12)), limit, "vector_rank").collect()}
    want = {(r.query_id, r.vector_rank): (r.id, round(r.similarity, 9)) for r in retrieval.vector_search(docs, dict(asked_rows[:12]), limit=limit).collect()}
    assert got == want and len(got) == 12 * min(limit, 542)


def test_vector_index_leaves_balls_out(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(vectors(3000, 16, 40, 0.05, 2))), "id long, embedding array<double>")
    vector_index.built(docs).save(f"{tmp_path}/index")
    index = vector_index.VectorIndex.load(spark, f"{tmp_path}/index")
    queries = docs.where("id % 100 = 0").selectExpr("id as query_id", "embedding as vector")
    found, read = vector_index.hits(index, queries, 10)
    assert read.agg({"n": "sum"}).first()[0] < 0.2 * 30 * 3000 and found.count() >= 300
    assert read.count() == read.select("query_id", "ball", "ring", "piece").distinct().count()


def test_empty_indexes(spark):
    docs = spark.createDataFrame([], "id long, text string, embedding array<double>")
    queries = spark.createDataFrame([(1, "a b", [1.0])], "query_id long, query string, vector array<double>")
    assert lexical_index.search(lexical_index.built(docs), queries).collect() == []
    assert vector_index.search(vector_index.built(docs), queries).collect() == []


def test_hybrid_search_by_indexes(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, zipf(rng, 12), v) for i, v in enumerate(vectors(200, 4, 5, 0.4, 3))], "id long, text string, embedding array<double>")
    queries = spark.createDataFrame([(i, f"w1 w2 w{i}") for i in range(6)], "query_id long, query string")
    asked = {r.id: r.embedding for r in docs.where("id % 40 = 0").collect()}
    places = lambda df: {(r.query_id, r.id, r.lexical_rank, r.vector_rank, r.score, r.final_rank, r.vector_skipped) for r in df.collect()}
    by_index = pipeline.hybrid_search(docs, queries, asked, lexical=lexical_index.built(docs), near=vector_index.built(docs))
    assert places(by_index) == places(pipeline.hybrid_search(docs, queries, asked))
