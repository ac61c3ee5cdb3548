"""Token ids of whole texts by overlapping chunk encoding.

Texts longer than a chunk are cut into overlapping chunks that any task can pre-tokenise by itself. Two neighbouring
chunks are stitched at the first place of their overlap where both start a pre-token: from such a place on, the scan
depends only on what follows, so both give the same pre-tokens. The pieces between stitches are then encoded; their ids
in order are those of the whole text. A text with an overlap that holds no common start (one word longer than it) is
encoded in one piece, so none is cut wrongly.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholark.session import cut_lineage, parallelism

#: Where the vocabulary files lie on the driver, which sends them to the workers; every function takes another folder.
VOCABULARIES = "/opt/tokenizers"
#: Characters of a chunk, and of the overlap between chunks.
CHUNK, OVERLAP = 16_384, 512
# Fixed value: how the byte-level vocabulary cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SCAN = regex.compile(PATTERN)


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> tiktoken.Encoding:
    """The public vocabulary ``name`` without special tokens, so their strings are ordinary text."""
    return _encoding(name, _vocabulary(name, folder))


def _vocabulary(name: str, folder: str) -> bytes:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        return lines.read()


@lru_cache(maxsize=4)
def _encoding(name: str, lines: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def starts(text: str, begin: int = 0) -> list[int]:
    """Places at which a pre-token starts when ``text`` is scanned from ``begin``."""
    return [m.start() for m in _SCAN.finditer(text, begin)]


def head_and_tail(window: str, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Starts in the first and in the last ``overlap`` characters of a chunk with its overlap, both from the chunk's edge.

    A start right after white space doesn't count: how white space is cut depends on what follows it, and a piece that
    ended there would be cut otherwise than the whole text.
    """
    found = [p for p in starts(window) if p and not window[p - 1].isspace()]
    return [p for p in found if p < overlap], [p - chunk for p in found if chunk <= p < chunk + overlap]


def stitch(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int] | None:
    """Where the pieces of ``text`` start, chunk by chunk; None where an overlap has no common start."""
    cuts, before = [0], None
    for begin in range(0, len(text), chunk):
        head, tail = head_and_tail(text[begin : begin + chunk + overlap], chunk, overlap)
        if before is not None:
            meet = sorted(set(head) & set(before))
            if not meet:
                return None
            cuts.append(begin + meet[0])
        before = tail
    return cuts


def encode_text(text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of one text, piece by piece; in one piece where its chunks can't be stitched."""
    model = encoder(name, folder)
    cuts = stitch(text, chunk, overlap) if len(text) > chunk else None
    if cuts is None:
        return model.encode_ordinary(text)
    return [i for a, b in zip(cuts, [*cuts[1:], len(text)]) for i in model.encode_ordinary(text[a:b])]


def decode_ids(ids: list[int], name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> str:
    """The text of ``ids``: the raw bytes of all tokens, put together before they are read as UTF-8."""
    return encoder(name, folder).decode_bytes(list(ids)).decode("utf-8")


def _encode_batches(keys: list[str], name: str, vocabulary, counts: bool = False) -> Callable:
    """Batches of ``keys`` and ``text`` to ``keys`` and ``ids``, or to ``n_tokens`` alone; ``vocabulary`` is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoding(name, vocabulary.value)
        for batch in batches:
            offsets, ids = [0], []
            for text in batch.column("text").to_pylist():
                if text:
                    ids.extend(model.encode_ordinary(text))
                offsets.append(len(ids))
            if counts:
                found = pa.array([b - a for a, b in zip(offsets, offsets[1:])], pa.int64())
            else:
                found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], found], names=[*keys, "n_tokens" if counts else "ids"])

    return run


def _encoded(df: DataFrame, keys: Sequence[str], text: str, name: str, folder: str, chunk: int, overlap: int, counts: bool) -> DataFrame:
    spark = df.sparkSession
    vocabulary = spark.sparkContext.broadcast(_vocabulary(name, folder))
    fields = [T.StructField(f"key{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    keyed = [f.name for f in fields]
    rows = df.select(*[F.col(k).alias(f) for k, f in zip(keys, keyed)], F.col(text).alias("text"))
    numbers = T.ArrayType(T.IntegerType())
    value = T.StructField("n_tokens", T.LongType()) if counts else T.StructField("ids", numbers)
    result = T.StructType([*fields, value])
    code = lambda names: _encode_batches(names, name, vocabulary, counts)
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(code(keyed), result)

    # Long texts are written once, with a number of their own, and read from there by the steps that follow.
    long = cut_lineage(rows.where(F.length("text") > chunk).withColumn("n", F.monotonically_increasing_id()))
    if not long.head(1):
        return short.toDF(*keys, value.name)
    count = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    windows = long.select("n", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("k")).select("n", "k", F.expr(f"substring(text, k * {chunk} + 1, {chunk + overlap})").alias("text"))
    windows = windows.repartition(parallelism(spark), "n", "k")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [head_and_tail(w, chunk, overlap) for w in batch.column("text").to_pylist()]
            arrays = [pa.array([e[i] for e in ends], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("k"), *arrays], names=["n", "k", "head", "tail"])

    place = [T.StructField("n", T.LongType()), T.StructField("k", T.IntegerType())]
    scanned = windows.mapInArrow(scan, T.StructType([*place, T.StructField("head", numbers), T.StructField("tail", numbers)]))
    order = Window.partitionBy("n").orderBy("k")
    meet = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    met = scanned.select("n", "k", meet.alias("start")).withColumn("next", F.lead("start").over(order)).withColumn("torn", F.max(F.col("start").isNull()).over(Window.partitionBy("n")))
    met = cut_lineage(met)
    pieces = windows.join(met.where("not torn").drop("torn"), ["n", "k"]).select("n", "k", F.expr(f"CASE WHEN next IS NULL THEN substring(text, start + 1) ELSE substring(text, start + 1, next + {chunk} - start) END").alias("text"))
    whole = long.join(met.where("torn").select("n").distinct(), "n", "left_semi").select("n", F.lit(0).alias("k"), "text")
    coded = pieces.unionByName(whole).mapInArrow(code(["n", "k"]), T.StructType([*place, value]))
    if counts:
        joined = coded.groupBy("n").agg(F.sum("n_tokens").alias("n_tokens"))
    else:
        joined = coded.groupBy("n").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(long.drop("text").join(joined, "n").drop("n")).toDF(*keys, value.name)


def encode_corpus(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key``, ``ids`` (array<int>): the ids of every whole text without special tokens.

    Null and empty texts give an empty list; blank texts are encoded as they are. Rows are encoded one by one, keys may
    repeat or be null. Extra columns are ignored. An empty table gives no rows. Texts within a chunk are encoded where they
    lie, without a shuffle; longer ones are written once, and only their chunks are moved.
    """
    return _encoded(df, [key], text, name, folder, chunk, overlap, False)


def token_counts(df: DataFrame, keys: str | Sequence[str], text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``keys``, ``n_tokens`` bigint: the number of ids of every whole text."""
    return _encoded(df, [keys] if isinstance(keys, str) else list(keys), text, name, folder, CHUNK, OVERLAP, True)
