"""Connected components by alternating large-star and small-star steps.

Nodes are longs.  Each step is a minimum per node (partial aggregates, so a
hub with a third of all edges is collapsed before the shuffle) and an
equi-join that adaptive execution may split; no neighbour list is ever
collected.  Every round is cut with ``checkpoint()`` in the shared folder, so
a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import checkpoint_dir


#: Spark's own setting that deletes an execution's shuffle files when it ends
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and drop the lineage.  The
    shuffle files of the steps before are deleted once the checkpoint is
    written, so a long job holds those of one step only."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        # a plan of its own takes the setting up; df itself stays usable
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``u > v`` (each stored once)."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m"))
    j = both.join(least, "u")
    if large:
        # neighbours above u point to the smallest around u
        out = j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        # u and its smaller neighbours point to the smallest of them
        out = (j.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(least.select("u", F.col("m").alias("v"))))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """``(node, component)`` for every node of an edge: the smallest node it
    reaches.  Null ends and loops are dropped; nodes without an edge to another
    node are absent (they are their own component).  An empty input gives an
    empty result.  Repeated and reversed edges change nothing.
    """
    e = (edges.select(F.col(u).cast("long").alias("a"), F.col(v).cast("long").alias("b"))
         .filter("a is not null and b is not null and a != b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = cut(e)
    state = None
    while True:
        e = cut(_star(_star(e, large=True), large=False))
        # order-free digest of the edge set: equal when a round changes nothing
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                    F.sum(F.xxhash64("u", "v").bitwiseAND(0x7FFFFFFF))).first()
        if tuple(now) == state or now[0] == 0:
            break
        state = tuple(now)
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
