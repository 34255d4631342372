"""Connected components of links, all on the executors.

Union-find within each partition first turns its links into stars, so what is shuffled is at most a row a node and
partition. Then large-star and small-star steps (each: the least neighbour by a pre-aggregated minimum, and a join
back, which adaptive execution splits where a node is hot) run until nothing changes. Each round is one plan and one
written table; the table before it is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, prepare, written

#: Links that a task's union-find holds at once; beyond them it gives what it has and begins anew.
HELD = 200_000


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union-find: each node of the pairs but the roots, with its root, the least of its set."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        if (a := root(a)) != (b := root(b)):
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def stars(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*pairs) if pairs else ([], []))], ["a", "b"])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as stars, contracted batch by batch; memory holds HELD of them and a batch."""
    found: list[tuple[int, int]] = []
    for b in batches:
        found = forest(found + list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
        if len(found) > HELD:
            yield stars(found)
            found = []
    yield stars(found)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b. Large: a node's larger neighbours go to its least; small: its smaller ones and itself do."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # coalesce makes its partitioning unknown, so that both sides of the join are plain shuffles, of which a hot
    # node's can be split
    least = least.coalesce(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    joined = around.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: two columns of longs. Returns node, root for every node that isn't its component's least, as a written
    table."""
    prepare(links.sparkSession)
    a, b = links.columns
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b")
    edges = written(links.mapInArrow(_local, "a long, b long"), "stars")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out.written_path = edges.written_path
            return out
        before, last = now, edges
        # a step never has more edges than the one before has nodes and edges
        edges = written(_star(_star(edges, True), False), "stars", rows=2 * now[0])
        discard(last)
