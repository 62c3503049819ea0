"""Connected components of a graph too large for the driver: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import save, temporary


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of ``edges`` (columns a, b, bigint), with the smallest node it reaches.

    A large-star step links each node's larger neighbours to its smallest; a small-star step
    links its smaller ones.  Both keep components and need only a minimum per node and one
    join.  Each round is written to the shared folder; rounds stop when edges no longer change.
    """
    with temporary(edges.sparkSession):
        now = save(_stars(edges), "components", keep=True)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _stars(edges: DataFrame) -> DataFrame:
    """(hi, lo): every node but the smallest of its component, and that one."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = save(pairs, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # stored, so that the join may deal the edges of one hub over several tasks
        least = save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(lowest.select("hi", F.col("m").alias("lo")))
        now = save(small.distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x"), F.bit_xor(F.xxhash64("lo", "hi")).alias("y")).first()
    return r["n"], r["x"], r["y"]
