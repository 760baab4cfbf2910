"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlytics.session import Written


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of u with the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect u and its smaller neighbours with the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, class_id) for every node of ``edges`` (u, v), class_id the least node of the component.

    Nodes without an edge do not appear; loops and repeated edges are allowed, NULL ends are left out. The
    number of rounds grows with the logarithm of the component size; each round is a map-side combined
    minimum and a join, so a node with very many neighbours is never gathered in one task. The edges of each
    round are written to the shared folder; the driver sees one count and one checksum a round.
    """
    clean = edges.select("u", "v").filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    now = Written(clean.distinct(), "edges")
    seen = None
    while True:
        step = Written(_small_star(_large_star(now.read()).distinct()).distinct(), "edges")
        mark = (
            step.read().agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 65521))
        ).first()
        now.drop()
        now = step
        if mark == seen:
            break
        seen = mark
    tree = now.read()
    roots = tree.select(F.col("v").alias("node"), F.col("v").alias("class_id"))
    return tree.select(F.col("u").alias("node"), F.col("v").alias("class_id")).union(roots).distinct()
