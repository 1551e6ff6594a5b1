"""The vector index against the exact search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import ranking, retrieval, search


def _recall(found, exact):
    got, want = {(r.query_id, r.vec_id) for r in found.collect()}, {(r.query_id, r.vec_id) for r in exact.collect()}
    return len(got & want) / max(len(want), 1)


def _both(v, **options):
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    centres = retrieval.fitted_centres(v, "vec_id")
    index = retrieval.indexed_vectors(v, "vec_id", centres)
    return index, retrieval.nearest_in_cells(index, q, "vec_id", centres, **options), retrieval.nearest_vectors(v, q, "vec_id")


def test_recall_on_the_tables(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    index, found, exact = _both(spark.read.parquet(path))
    assert _recall(found, exact) >= 0.9 and index.count() == spark.read.parquet(path).count()


def test_all_cells_miss_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(500, [0.0] * 8), (520, None), (501, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("cell", "unit", "c")})
    index, found, exact = _both(v, asked=retrieval.CELLS, block=50)
    same = exact.filter("vec_id < 500")
    assert index.count() == 400 and _recall(found, same) == 1.0 and found.count() == same.count()


def test_empty_tables(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index, found, _ = _both(v)
    assert index.count() == 0 and found.count() == 0


def test_search_of_many_queries_is_each_query_by_itself(spark):
    texts = ["باب أحكام الصلاة", "أحكام الصلاة في السفر", "الطهارة وأحكام الماء", "كتاب الصلاة", "سألته عن الصلاة فقال نعم", "باب الماء", "report of the market", "the market and the judge"]
    rows = [(i, i % 3, 1, 1, i + 1, "matn", t, t.replace("أ", "ا").replace("ة", "ه")) for i, t in enumerate(texts * 3)] + [(99, 1, 1, 1, 1, None, None, None)]
    e = spark.createDataFrame(rows, "element_id long, page_id long, book_id long, volume_number int, page_number int, element_type string, text_raw string, text_normalized string")
    asked = [(1, "أحكام الصلاة"), (2, "the market"), (3, ""), (4, None), (5, "nothing like it")]
    schema = "query_id long, query string"
    got = {}
    for r in search.search(e, spark.createDataFrame(asked, schema), 6).collect():
        got.setdefault(r.query_id, []).append((r.place, r.element_id, r.reranked, r.deferred))
    assert set(got) == {1, 2} and all([p for p, *_ in sorted(v)] == list(range(1, 7)) for v in got.values())
    for i, q in asked[:2]:
        alone = search.search(e, spark.createDataFrame([(i, q)], schema), 6).collect()
        assert sorted(got[i]) == sorted((r.place, r.element_id, r.reranked, r.deferred) for r in alone)
    later = search.search(e, spark.createDataFrame(asked[:1], schema), 3, 3).collect()
    assert sorted((r.place, r.element_id) for r in later) == sorted(x[:2] for x in got[1])[3:]
    stages = search.answered(e, spark.createDataFrame([(1, "كتاب")], "book_id long, title string"), spark.createDataFrame(asked, schema))
    told = {r.query_id: r for r in stages["answers"].collect()}
    assert set(told) == {1, 2} and all(r.answered == (r.citations > 0) and (r.answered or r.refusal) for r in told.values())
