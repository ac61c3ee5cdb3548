"""Per-key work on tables in which a few keys hold most rows.

The heavy keys are found with a mergeable frequent-items sketch and counted exactly. Their rows are joined by broadcast
(of the few other-side rows that carry a heavy key, after a check of their number) and aggregated over salted subkeys;
all other rows take an ordinary shuffle; the two results are united. No row is dropped or sampled.

Defined results for odd input: a null key is no key (its rows still count in the total of ``heavy_keys``, never match in
``skew_join`` and form no group in ``skew_aggregate``); an empty table gives an empty result; full copies of rows count
as rows; extra columns are carried or ignored and may bear any name but those in ``RESERVED``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholark.session import parallelism

#: Items a sketch keeps; its count error is below 3.5 / SKETCH_ITEMS of the rows.
SKETCH_ITEMS = 8192
#: The most other-side rows that ``skew_join`` broadcasts; beyond it the heavy rows take a salted shuffle.
BROADCAST_ROWS = 10_000
#: Subkeys over which the rows of one heavy key are spread, at least; as many as the session has shuffle partitions, if more.
SALTS = 32
RESERVED = ("__salt", "__heavy")


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows: ``key_field`` string, ``key_id`` (type of the keys), ``n_rows``, ``n_all``.

    ``keys`` must be of one type. One pass with a sketch per field proposes at most 2 / share candidates a field, a
    superset of the answer whatever the order of rows; a second pass counts only these, exactly.
    """
    if share < 14 / SKETCH_ITEMS:
        raise ValueError(f"a share under {14 / SKETCH_ITEMS} needs more than {SKETCH_ITEMS} sketch items")
    most = max(1, int(2 / share))
    sketches = df.agg(*[F.expr(f"approx_top_k(`{k}`, {most}, {SKETCH_ITEMS}) FILTER (WHERE `{k}` IS NOT NULL)").alias(f"s{i}") for i, k in enumerate(keys)], F.count(F.lit(1)).alias("n_all"))
    found = [sketches.select(F.lit(k).alias("key_field"), F.explode(f"s{i}.item").alias("key_id"), "n_all") for i, k in enumerate(keys)]
    candidates = reduce(DataFrame.unionByName, found)
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key_field"), F.col(k).alias("key_id")) for k in keys])))
    counted = rows.join(F.broadcast(candidates), ["key_field", "key_id"]).groupBy("key_field", "key_id").agg(F.count(F.lit(1)).alias("n_rows"), F.first("n_all").alias("n_all"))
    return counted.where(F.col("n_rows") >= F.col("n_all") * F.lit(share))


def _values(heavy: DataFrame) -> list:
    """The heavy keys themselves: at most 1 / share values a field, a bound that does not grow with the data."""
    return [r[0] for r in heavy.select("key_id").distinct().collect()]


def skew_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.01, how: str = "inner", heavy: list | None = None, right_heavy: list | None = None) -> DataFrame:
    """``left`` joined to ``right`` on ``key`` (``inner`` or ``left``) without one task getting a heavy key's rows.

    Both sides may hold several rows a key (bag semantics), and either may have heavy keys. Columns of ``right`` other than
    the key must not clash with those of ``left``. ``heavy`` and ``right_heavy`` spare the detection where they are known: a
    ``right`` with one row a key has none.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    if clash := (set(left.columns) & set(right.columns)) - {key}:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    keys = _values(heavy_keys(left, [key], share)) if heavy is None else heavy
    others = [k for k in (_values(heavy_keys(right, [key], share)) if right_heavy is None else right_heavy) if k not in keys]
    if not keys and not others:
        return left.join(right, key, how)
    among = lambda ks: F.coalesce(F.col(key).isin(ks), F.lit(False))
    light = ~among([*keys, *others])
    result = left.where(light).join(right.where(light), key, how)
    if keys:
        result = result.unionByName(_spread_join(left.where(among(keys)), right.where(among(keys)), key, how))
    if others:  # a key that is heavy on the right has matches there, so this part is an inner join in any case
        turned = _spread_join(right.where(among(others)), left.where(among(others)), key, "inner")
        result = result.unionByName(turned.select(*result.columns))
    return result


def _spread_join(many: DataFrame, few: DataFrame, key: str, how: str) -> DataFrame:
    """``many`` joined to ``few`` on ``key``: by broadcast after a check of its rows, beyond it over salted subkeys."""
    if len(few.limit(BROADCAST_ROWS + 1).select(key).collect()) <= BROADCAST_ROWS:
        return many.join(F.broadcast(few), key, how)
    salts = max(SALTS, parallelism(many.sparkSession))
    salted = many.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in many.columns]), F.lit(salts)))
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def skew_aggregate(df: DataFrame, key: str, sums: dict[str, Column] | None = None, mins: dict[str, Column] | None = None, maxs: dict[str, Column] | None = None, distinct: dict[str, Column] | None = None, share: float = 0.01, heavy: list | None = None) -> DataFrame:
    """One row per non-null ``key``: ``n_rows`` and the named sums, minima, maxima and exact distinct counts.

    Rows of heavy keys are pre-aggregated per (key, salt), the salt being taken from the distinct value where distinct
    values are counted, so equal values meet and no set of values has to fit one task; the rest takes one shuffle.
    """
    sums, mins, maxs, distinct = sums or {}, mins or {}, maxs or {}, distinct or {}
    keys = _values(heavy_keys(df, [key], share)) if heavy is None else heavy
    df = df.where(F.col(key).isNotNull())
    plain = [F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(n) for n, c in sums.items()], *[F.min(c).alias(n) for n, c in mins.items()], *[F.max(c).alias(n) for n, c in maxs.items()]]
    once = [F.countDistinct(c).alias(n) for n, c in distinct.items()]
    if not keys:
        return df.groupBy(key).agg(*plain, *once)
    is_heavy = F.col(key).isin(keys)
    rest = df.where(~is_heavy).groupBy(key).agg(*plain, *once)
    hot = df.where(is_heavy)
    salts = max(SALTS, parallelism(df.sparkSession))
    spread = hot.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
    merged = [F.sum("n_rows").alias("n_rows"), *[F.sum(n).alias(n) for n in sums], *[F.min(n).alias(n) for n in mins], *[F.max(n).alias(n) for n in maxs]]
    result = spread.groupBy(key, "__salt").agg(*plain).groupBy(key).agg(*merged)
    for name, column in distinct.items():
        parts = hot.select(key, column.alias("__v"), F.pmod(F.xxhash64(column), F.lit(salts)).alias("__salt")).groupBy(key, "__salt").agg(F.countDistinct("__v").alias(name))
        result = result.join(F.broadcast(parts.groupBy(key).agg(F.sum(name).alias(name))), key)
    return result.unionByName(rest)
