"""Connected components of a link table: one union-find task for small graphs, alternating star rounds for others."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.llm._common import discard, join_groups, materialize

#: Links that one task settles by itself (16 bytes each); more are settled in distributed rounds.
TASK_LINKS = 1_000_000


def _settled(edges: DataFrame) -> DataFrame:
    """Components of few links in one executor task, by union-find with the smallest node as root."""
    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])

    def run(batches):
        root: dict = {}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = None
        for batch in batches:
            out = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(root.setdefault(a, a)), find(root.setdefault(b, b))
                if x != y:
                    root[max(x, y)] = min(x, y)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(root), out), pa.array([find(x) for x in root], out)], names=["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, schema)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node hands its smallest neighbour (or itself) to its larger neighbours. Small star: to its smaller ones and itself."""
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = join_groups(sides, least, ["u"], "n", int(sides.count()), F.col("v"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, *, task_links: int = TASK_LINKS) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) of every node in rows (``a``, ``b``).

    More than ``task_links`` links are settled in rounds, each written to the shared folder. They end when one changes nothing: all edges then
    lead from a node to the smallest of its component. Loops, repeated edges and either direction
    are fine; a node in loops only is no node of the result."""
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "links")
    if edges.count() <= task_links:
        return _settled(edges)
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        larger = materialize(_star(edges, True), "links")
        smaller = materialize(_star(larger, False), "links")
        discard(edges)
        discard(larger)
        edges = smaller
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
