"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

How often each document is used follows from its source's quota; the copies of a source are cut into blocks by a hash.
A tree over the output shards splits the exact block counts again and again: each half gets a hypergeometric draw of
what is left of every source, so every shard ends with its exact quota of each source while no shard sees another's
documents. Within a block documents take disjoint places of one permutation, and each shard orders its rows locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholark.llm.encoding import VOCABULARIES, token_counts
from scholark.session import cut_lineage

#: Rows of a block of a source, and rows of an output shard; of both there are as many as the data need.
BLOCK_ROWS, SHARD_ROWS = 100_000, 250_000
#: Shards at least; the most sources and the most (source, shard) quotas that one plan may have.
LEAST_SHARDS, MOST_SOURCES, MOST_QUOTAS = 16, 100_000, 20_000_000


def mix_plan(sizes: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, dict]:
    """Token quota, full passes and rest of each source.

    Without ``total`` the mix is the largest in which every source reaches its share; with it, a source too small even
    with all its repeats gives what it has. Sources without tokens, without a target or with a share of 0 take no part.
    """
    listed = {s: (share, max(0, repeats[s])) for s, share in shares.items() if s is not None and share and share > 0}
    have = {s: v for s, v in listed.items() if sizes.get(s, 0) > 0 and v[1] > 0}
    if total is None:
        total = min((sizes[s] * cap / share for s, (share, cap) in have.items()), default=0.0)
    plan = {}
    for source, (share, cap) in listed.items():
        size = sizes.get(source, 0)
        quota = min(math.floor(total * share), size * cap)
        passes = quota // size if size else 0
        plan[source] = {"quota": int(quota), "passes": int(passes), "rest": int(quota - passes * size), "size": int(size), "target": float(share), "cap": int(cap)}
    return plan


def split_counts(counts: dict[str, int], shards: int, seed: int) -> dict[str, list[int]]:
    """How many of each source's copies every shard gets: exact, drawn by a tree of hypergeometric splits.

    All sources' copies lie in one urn a node; the left half of its shards draws its share of the urn. Counts add up to
    ``counts``, and shard sizes differ by one at most.
    """
    names = sorted(counts)
    result = {n: [0] * shards for n in names}
    rng = np.random.default_rng(seed)
    total = sum(counts.values())
    ends = [total * i // shards for i in range(shards + 1)]
    todo = [(0, shards, np.array([counts[n] for n in names], dtype=np.int64))]
    while todo:
        low, high, urn = todo.pop()
        if high - low == 1:
            for n, c in zip(names, urn):
                result[n][low] = int(c)
            continue
        middle = (low + high) // 2
        want, drawn, left = ends[middle] - ends[low], [], int(urn.sum())
        for c in urn:  # a multivariate draw, one source after another
            got = _hypergeometric(rng, int(c), left - int(c), want)
            drawn.append(got)
            want, left = want - got, left - int(c)
        half = np.array(drawn, dtype=np.int64)
        todo += [(low, middle, half), (middle, high, urn - half)]
    return result


#: Urns from which the generator draws itself.
GENERATOR_URN = 1_000_000_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if n <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return n
    if good + bad < GENERATOR_URN:
        return int(rng.hypergeometric(good, bad, n))
    return _inverted(rng.random(), good, bad, n)


def _log_factorial(n: int) -> Decimal:
    """ln n! by Stirling's series, in the current decimal precision; its error is far below that of a double."""
    if n < 2000:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    half_log_two_pi = Decimal("0.918938533204672741780329736405617639861397473637783412817")
    return x * x.ln() - x + x.ln() / 2 + half_log_two_pi + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def _inverted(u: float, good: int, bad: int, n: int) -> int:
    """The same law by inversion for urns of any size: terms are summed from the mode outwards until they exceed ``u``.

    The mode's term comes from exact logarithms, each further one from its neighbour, so the number of steps is a few
    standard deviations, the square root of what is drawn.
    """
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    with localcontext() as context:
        context.prec = 60
        choose = lambda a, b: _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)
        term = float((choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n)).exp())
    up, down, at_up, at_down, left = term, term, mode, mode, u - term
    while left > 0:
        more = up * ((good - at_up) * (n - at_up) / ((at_up + 1) * (bad - n + at_up + 1))) if at_up < high else 0.0
        less = down * (at_down * (bad - n + at_down) / ((good - at_down + 1) * (n - at_down + 1))) if at_down > low else 0.0
        if more <= 0 and less <= 0:
            return mode  # what rounding left over
        if more >= less:
            up, at_up, left = more, at_up + 1, left - more
            if left <= 0:
                return at_up
        else:
            down, at_down, left = less, at_down - 1, left - less
            if left <= 0:
                return at_down
    return mode


def _running(rows: DataFrame, block: str, total: DataFrame, alias: str) -> DataFrame:
    """``rows`` with ``alias``: what lies in their source's blocks before theirs; a window over blocks, not over rows."""
    before = F.sum("t").over(Window.partitionBy("source").orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(total.select("source", block, F.coalesce(before, F.lit(0)).alias(alias)), ["source", block])


def mix_sources(documents: DataFrame, targets: DataFrame, key: str, text: str, source: str, total: float | None = None, shards: int | None = None, seed: int = 7, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``key``, ``source``, ``n_tokens``, ``copy`` (from 1), ``shard``, ``position``: the documents of the mix, in order.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats`` (a small table: more than MOST_SOURCES sources are
    refused). A source's documents are all used ``passes`` times; the last, partial pass takes documents in the order
    of a hash as long as they fit its quota, so a source misses its quota by less than one document. No document is
    used more than ``max_repeats`` times. Sources are cut into blocks of about ``block_rows`` and the mix into shards of about
    ``shard_rows`` (or the given number), so no task holds more of a source, or of the mix, than that. Only one row a source
    reaches the driver. Documents without tokens (null and empty texts), of a null or unlisted source take no part. An
    empty table gives no rows; extra columns are ignored.
    """
    spark = documents.sparkSession
    listed = targets.select("source", "target_share", "max_repeats").dropna().limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    shares, repeats = {r[0]: r[1] for r in listed}, {r[0]: r[2] for r in listed}
    wanted = F.broadcast(spark.createDataFrame([(s,) for s in shares], "source string"))  # at most MOST_SOURCES rows
    kept = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source")).where(F.length("text") > 0).join(wanted, "source", "left_semi")
    sized = token_counts(kept, ["key", "source"], "text", name, folder).where("n_tokens > 0").groupBy("key", "source").agg(F.min("n_tokens").alias("n_tokens"))
    sized = cut_lineage(sized.withColumn("h", F.xxhash64("key", F.lit(seed))))

    sums = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}  # a row a source
    plan = mix_plan({s: t for s, (t, _) in sums.items()}, shares, repeats, total)
    todo = [(s, plan[s]["rest"], plan[s]["passes"], -(-n // block_rows)) for s, (_, n) in sums.items()]
    quotas = F.broadcast(spark.createDataFrame(todo, "source string, rest bigint, passes int, blocks bigint"))
    # Hashes fall into as many equal ranges as the source has blocks, so blocks follow each other in the order of the hash.
    block = F.floor((F.shiftright(F.col("h"), 33) + F.lit(1 << 30)) * F.col("blocks") / F.lit(1 << 31)).cast("bigint")
    blocked = sized.join(quotas, "source").withColumn("block", block)
    running = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0))
    placed = _running(blocked, "block", blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("t")), "before").withColumn("end", F.col("before") + running)
    uses = F.col("passes") + F.when(F.col("end") <= F.col("rest"), 1).otherwise(0)
    copies = placed.withColumn("uses", uses).where("uses > 0").select("key", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy"))
    mixed = cut_lineage(copies.withColumn("g", F.xxhash64("key", "copy", F.lit(seed + 1))))

    # Each copy gets a number within its source: numbers of its lot, in an order of its own for every copy.
    counts = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a source
    n_shards = shards or max(LEAST_SHARDS, -(-sum(counts.values()) // shard_rows))
    if n_shards * max(1, len(counts)) > MOST_QUOTAS:
        raise ValueError(f"{n_shards} shards of {len(counts)} sources are more than {MOST_QUOTAS} quotas; ask for fewer, larger shards")
    lots = F.broadcast(spark.createDataFrame([(s, -(-n // block_rows)) for s, n in counts.items()], "source string, lots bigint"))
    lotted = mixed.join(lots, "source").withColumn("lot", F.pmod(F.shiftright("g", 16), F.col("lots")))
    place = F.row_number().over(Window.partitionBy("source", "lot").orderBy("g", "key", "copy")) - 1
    numbered = _running(lotted, "lot", lotted.groupBy("source", "lot").agg(F.count(F.lit(1)).alias("t")), "offset").withColumn("number", F.col("offset") + place)
    ends = {s: np.cumsum(parts) for s, parts in split_counts(counts, n_shards, seed).items()}
    shared = spark.sparkContext.broadcast(ends)  # at most MOST_QUOTAS numbers

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shard = np.zeros(len(batch), dtype=np.int32)
            for s, at in batch.groupby("source", sort=False).indices.items():
                shard[at] = np.searchsorted(shared.value[s], batch["number"].to_numpy()[at], side="right")
            yield batch.drop(columns="number").assign(shard=shard)

    fields = [numbered.schema[c] for c in ("key", "source", "n_tokens", "copy", "g")]
    dealt = numbered.select("key", "source", "n_tokens", "copy", "g", "number").mapInPandas(deal, T.StructType([*fields, T.StructField("shard", T.IntegerType())]))
    shuffled = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("g", F.lit(seed + 2)), "key", "copy"))
    return dealt.withColumn("position", shuffled).select(F.col("key").alias(key), "source", "n_tokens", "copy", "shard", "position")


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``, ``target_share``, ``actual_share``, ``n_tokens``, ``n_rows``, ``most_repeats``: what each source reached."""
    reached = mix.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"), F.max("copy").alias("most_repeats"))
    all_tokens = mix.agg(F.sum("n_tokens").alias("all_tokens"))
    wanted = targets.select("source", "target_share").where("source is not null").distinct()
    joined = F.broadcast(wanted).join(reached, "source", "left").crossJoin(F.broadcast(all_tokens))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("source", "target_share", (zero("n_tokens") / F.greatest("all_tokens", F.lit(1))).alias("actual_share"), zero("n_tokens").cast("bigint").alias("n_tokens"), zero("n_rows").cast("bigint").alias("n_rows"), zero("most_repeats").cast("int").alias("most_repeats"))
