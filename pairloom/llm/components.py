"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component_id) of every id in ``links`` (a, b): component_id is the smallest id reachable.

    Each step sends every neighbour of a node to the smallest one; minima are combined on the map side. They
    are joined back by a plain equi-join on the node: a hub's links are one key there, whose rows AQE splits
    over tasks against the hub's single minimum. After the first round a component's links lead to few
    nodes. Every round is written to the shared folder; the number of rounds grows with the logarithm of a
    component's size. Links of an id with itself and repeated links change nothing; an empty table gives no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = scratch.write(edges, "edges")
    edges = scratch.spark.read.schema(edges.schema).parquet(path)
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.write(out, "edges")
        scratch.drop(path)
        path, edges = new, scratch.spark.read.schema(out.schema).parquet(new)
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
