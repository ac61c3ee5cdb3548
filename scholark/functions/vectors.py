"""Vector expressions and aggregates on array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, within [0, 2]; 1 where either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(1.0)).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.lit(1.0) - dot(a, b) / scale)))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double")), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(a: Column) -> Column:
    """The vector made one long; a zero vector stays zero."""
    length = norm(a)
    return F.when(length == 0, as_double(a)).otherwise(F.transform(a, lambda x: x / length))


#: Keys whose partial sums a worker holds before it hands them on.
PARTIAL_KEYS = 50_000


def mean_vectors(df: DataFrame, keys: list[str], vector: str, weight: str | None = None, alias: str = "embedding") -> DataFrame:
    """``keys``, ``alias``: element-wise mean of (weighted) vectors, divided by the number of rows, not by the weights' sum.

    Each worker sums its rows' vectors per key before the shuffle, so one partial sum a key and partition travels, as one
    array, and a heavy key is no task's burden; sums of a key then follow each other and are added up. Null keys and null
    vectors form no group.
    """
    kinds = [df.schema[k] for k in keys]
    out = T.StructType([*kinds, T.StructField("__sum", T.ArrayType(T.DoubleType())), T.StructField("__n", T.LongType())])
    columns = [*keys, F.col(vector).cast("array<double>").alias("__v"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("__w")]
    rows = df.select(*columns).dropna()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def flush() -> pd.DataFrame:
            return pd.DataFrame([(*k, s, n) for k, (s, n) in held.items()], columns=[*keys, "__sum", "__n"])

        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["__v"].to_list()) * batch["__w"].to_numpy()[:, None]
            code = batch.groupby(keys, sort=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            begin = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
            sums, counts = np.add.reduceat(x[order], begin, axis=0), np.diff(np.r_[begin, len(order)])
            names = batch[keys].iloc[order[begin]].itertuples(index=False, name=None)
            for name, s, n in zip(names, sums, counts):
                if name in held:
                    held[name][0] = held[name][0] + s
                    held[name][1] += int(n)
                else:
                    held[name] = [s, int(n)]
            if len(held) > PARTIAL_KEYS:
                yield flush()
                held.clear()
        yield flush()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, total, n = None, None, 0
        for batch in batches:
            done = []
            for *key, s, count in batch[[*keys, "__sum", "__n"]].itertuples(index=False, name=None):
                if key == name:
                    total, n = total + s, n + count
                else:
                    if name is not None:
                        done.append((*name, total / n))
                    name, total, n = key, np.array(s), count
            yield pd.DataFrame(done, columns=[*keys, alias])
        if name is not None:
            yield pd.DataFrame([(*name, total / n)], columns=[*keys, alias])

    sums = rows.mapInPandas(partial, out).repartition(*keys).sortWithinPartitions(*keys)
    return sums.mapInPandas(merge, T.StructType([*kinds, T.StructField(alias, T.ArrayType(T.DoubleType()))]))
