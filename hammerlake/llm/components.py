"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges`` (src, dst: long); component is the smallest node reachable.

    Each round has a large-star and a small-star step (Kiveris et al., "Connected Components in MapReduce and
    Beyond"): both attach neighbours to the smallest one with a grouped minimum, combined before the shuffle,
    and a join whose hot keys adaptive execution splits. Rounds grow with the logarithm of the longest path. The
    driver sees one count and one checksum a round. Edges with a null end are ignored; an empty table gives none.
    """

    def stars(e: DataFrame, both: bool) -> DataFrame:
        # (u, v): v is a neighbour of u; the large star links the larger neighbours, the small star the others
        near = e.select(F.col("src").alias("u"), F.col("dst").alias("v"))
        if both:
            near = near.unionByName(e.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = near.join(least, "u")
        if both:
            out = joined.where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        else:
            out = joined.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionByName(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))
        return out.where("src != dst").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    now = cut(edges.select(F.greatest("src", "dst").cast("long").alias("src"), F.least("src", "dst").cast("long").alias("dst")).where("src is not null and dst is not null and src != dst").distinct())
    before = state(now)
    while before[0]:
        now = cut(stars(stars(now, True), False))
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
