"""The N best items of every group by two-stage salted ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Subgroups into which every group is hashed in the first stage.
SALTS = 64


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, tie: Sequence[str], n: int, salts: int = SALTS) -> DataFrame:
    """For every ``group`` the ``n`` items of highest ``score``, ties by ``tie`` ascending and then by ``item``.

    Stage one hashes each group by item into ``salts`` subgroups, keeps the best row of every item and the ``n`` best
    items of every subgroup; stage two ranks the at most ``n * salts`` survivors of a group. Rows of one item meet in
    one subgroup, so an item scored repeatedly counts once, with its highest score (ties by ``tie``). One exchange by
    (group, subgroup) serves both the choice of an item's best row and the first ranking.

    Rows with a null group, item, score or tie value or a NaN score don't count. -0.0 equals 0.0. Repeated rows count
    once. Groups with fewer than ``n`` items give all of them; an empty table gives no rows. Strings compare by code
    point. Extra columns are ignored, whatever their names.
    """
    kept = df.select(F.col(group).alias("g"), F.col(item).alias("i"), (F.lit(0.0) - F.col(score).cast("double")).alias("s"), *[F.col(t).alias(f"t{k}") for k, t in enumerate(tie)])
    kept = kept.where(~F.isnan("s")).dropna()
    ties = [f"t{k}" for k in range(len(tie))]
    spread = kept.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(salts))).repartition("g", "salt")
    best = spread.groupBy("g", "i", "salt").agg(F.min(F.struct("s", *ties)).alias("b")).select("g", "salt", "i", "b.*")
    order = [F.col("s"), *[F.col(t) for t in ties], F.col("i")]
    first = best.withColumn("r", F.row_number().over(Window.partitionBy("g", "salt").orderBy(*order))).where(F.col("r") <= n)
    second = first.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("r") <= n)
    return second.select(F.col("g").alias(group), F.col("i").alias(item), (F.lit(0.0) - F.col("s")).alias(score), *[F.col(f"t{k}").alias(t) for k, t in enumerate(tie)], F.col("r").alias("rank"))
