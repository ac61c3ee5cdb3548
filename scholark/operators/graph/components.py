"""Connected components and pair expansion for edge lists of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholark.session import cut_lineage, release

#: Members that one task pairs with a class at most before the class is split.
CLASS_BLOCK = 2000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``id``, ``component`` (the smallest id reachable) of every vertex with an edge to another vertex.

    Alternating large-star and small-star rounds: edges are rewired to the smallest known neighbour until a round
    changes nothing, in O(log^2) rounds. Only a count and a checksum per round reach the driver. Each round is written
    to the shared folder. Self loops, repeated edges and nulls are ignored; an empty edge list gives no rows. Ids must
    be of one orderable type.
    """
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col("u") > F.col("v")).dropna().distinct()
    now = cut_lineage(now)
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, cut_lineage(small)
        release(before)
        said = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if said == mark:
            break
        mark = said
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def pairs_within(classes: DataFrame, member: str, label: str, first: str, second: str) -> DataFrame:
    """Each unordered pair of different members of one class, the smaller as ``first``; repeated rows count once.

    Classes over CLASS_BLOCK members are cut into blocks so that no task pairs a whole large class by itself.
    """
    rows = classes.select(F.col(label).alias("c"), F.col(member).alias("a")).dropna().distinct()
    sizes = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c", F.ceil(F.col("n") / CLASS_BLOCK).cast("int").alias("k"))
    sized = rows.join(sizes, "c")
    left = sized.withColumn("b", F.pmod(F.xxhash64("a"), F.col("k")).cast("int"))
    right = sized.withColumnRenamed("a", "z").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return left.join(right, ["c", "b"]).where("a < z").select(F.col("a").alias(first), F.col("z").alias(second))


def with_components(vertices: DataFrame, vertex: str, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``vertices`` with ``component``: the smallest id of their component, their own id where they have no edge."""
    found = connected_components(edges, src, dst).withColumnRenamed("id", vertex)
    return vertices.join(found, vertex, "left").withColumn("component", F.coalesce("component", F.col(vertex)))


def largest_component(components: DataFrame) -> DataFrame:
    """Members of the component with most members, the smallest label winning a tie."""
    best = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return components.join(F.broadcast(best.select("component")), "component", "left_semi")


__all__ = ["connected_components", "largest_component", "pairs_within", "with_components"]
