"""Connected components of a link table, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._store import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of links (a, b); label is the smallest node of its component.

    Large-star and small-star steps: each node's neighbours are hung on the smallest one, until nothing changes.
    A step is an aggregate with partial sums and a join of many rows to one, each round a written table.
    """
    start = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = _kept(start, scratch)
    while before[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
        # large star: the larger neighbours of u go to u's smallest
        large = (
            both.join(least, both.a == least.u)
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        # small star: u and its smaller neighbours go to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(down, large.a == down.u).select("a", "b", "m")
        both = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))
        out = small.select(both.alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        new, told = _kept(out, scratch)
        scratch.drop(edges)
        edges, last, before = new, before, told
        if before == last:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b")).distinct())


def _kept(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    """The written edges, their number and two sums over them, taken as they are written; equal ones mean an unchanged
    table."""
    h, seen = F.xxhash64("a", "b"), Observation()
    sums = F.sum(F.pmod(h, F.lit(1 << 40))).alias("x"), F.sum(F.shiftrightunsigned(h, 24)).alias("y")
    out = scratch.keep(edges.observe(seen, F.count(F.lit(1)).alias("n"), *sums), "edges")
    return out, tuple(seen.get[k] for k in ("n", "x", "y"))
