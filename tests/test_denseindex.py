"""The index of vectors against products of everything."""

import numpy as np
import pytest

from paperloom.operators import dense, denseindex


def top(df):
    return sorted((r.query_id, r.rank0, r.chunk_id, round(r.score, 8)) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 12))
    x = centres[rng.integers(0, 30, 3000)] + 0.15 * rng.normal(size=(3000, 12))
    x[1000:1900] = x[3]  # a third are one vector
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000, None), (5001, [1.0] * 11), (5002, [None] + [1.0] * 11), (5003, [0.0] * 12)]
    asked = [(i, [float(c) for c in v]) for i, v in enumerate(centres[:25] + 0.1)] + [(90, None), (91, [1.0]), (92, rows[3][1])]
    return [spark.createDataFrame(r, f"{name} long, embedding array<double>").repartition(6) for r, name in ((rows, "chunk_id"), (asked, "query_id"))]


def test_index_gives_what_products_of_all_give(spark, tables):
    vectors, asked = tables
    index = denseindex.build(vectors, 12)
    assert index.blocks.selectExpr("sum(size(ids))").first()[0] == 3001
    for n in (1, 9):
        want = top(dense.dense_topk(vectors, asked.filter("query_id not in (90, 91)"), n))
        assert want and top(denseindex.topk(index, asked, n)) == want
    work = denseindex.searched(index, asked, 9).work.first()
    assert work["all"] == 26 * 3001 and work["products"] < 0.5 * work["all"]


def test_passes_and_few_vectors(spark, tables, monkeypatch):
    vectors, asked = tables
    index = denseindex.build(vectors, 12, groups=5)
    assert top(denseindex.topk(index, asked, 4)) == top(dense.dense_topk(vectors, asked.filter("query_id not in (90, 91)"), 4))
    some = denseindex.searched(index, asked, 4, at_once=9)
    assert top(dense.ranked(some.scores, 4, least=0.25)) == top(denseindex.topk(index, asked, 4)) and some.work.first()["all"] == 26 * 3001
    few = vectors.filter("chunk_id < 3")
    assert top(denseindex.topk(denseindex.build(few, 12), asked, 10, floor=-1.0)) == top(dense.dense_topk(few, asked.filter("query_id not in (90, 91)"), 10, floor=-1.0))
    none = denseindex.build(vectors.limit(0), 12)
    assert denseindex.topk(none, asked, 3).count() == 0 and denseindex.topk(index, asked.limit(0), 3).count() == 0
