"""Frequency of every distinct value by burst-trie counting over adaptively routed prefixes.

Values are routed by prefixes that a sample of the table chooses, so that every route gets about as many rows; each
worker counts the rows of its route in one compact trie, occurrences and different records at once; values that a
border between routes cuts apart, as it does with a value too frequent for one route, are merged from all workers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholark.session import cut_lineage, parallelism

# The white space of Unicode.
WHITE_SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
#: Rows that a route should hold; there are as many routes as the table needs, and one a shuffle partition at least.
ROUTE_ROWS = 1_000_000
#: Characters by which routes are told apart before the record decides.
PREFIX = 64
#: Entries at which a container bursts.
CONTAINER = 1024

_SUBTREES = "prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>, cut boolean"


def folded(column: Column) -> Column:
    """Lower case, white space of any kind trimmed and each run taken as one space; blank becomes null."""
    text = F.trim(F.regexp_replace(F.lower(column), WHITE_SPACE, " "))
    return F.when(text != "", text)


class BurstTrie:
    """Occurrence and record counters by string: inner nodes by character over dictionaries of suffixes that burst.

    ``see`` counts rows that come record by record; ``add`` adds counters of another trie.
    """

    def __init__(self, container: int = CONTAINER) -> None:
        self.container, self.root, self.entries = container, ({}, None), 0
        self.record, self.seen = None, set()

    def see(self, key: str, record: object) -> None:
        """One row; the rows of a record must follow each other."""
        if record != self.record:
            self.record = record
            self.seen.clear()
        self.add(key, 1, int(key not in self.seen))
        self.seen.add(key)

    def add(self, key: str, occurrences: int, records: int) -> None:
        node, depth = self.root, 0
        while node[1] is not None:
            if depth == len(key):
                counters = node[1].setdefault("", [0, 0])
                self.entries += counters == [0, 0]
                counters[0] += occurrences
                counters[1] += records
                return
            node = node[1].setdefault(key[depth], ({}, None))
            depth += 1
        held = node[0]
        counters = held.get(key[depth:])
        if counters is None:
            held[key[depth:]] = [occurrences, records]
            self.entries += 1
            if len(held) > self.container:
                self._burst(key[:depth])
        else:
            counters[0] += occurrences
            counters[1] += records

    def _burst(self, prefix: str) -> None:
        parent, node = None, self.root
        for sign in prefix:
            parent, node = node, node[1][sign]
        children: dict = {}
        for suffix, counters in node[0].items():
            if suffix:
                children.setdefault(suffix[0], ({}, None))[0][suffix[1:]] = counters
            else:
                children[""] = counters
        if parent is None:
            self.root = ({}, children)
        else:
            parent[1][prefix[-1]] = ({}, children)

    def subtrees(self) -> Iterator[tuple[str, dict]]:
        """Each container with the prefix under which it hangs."""
        stack = [("", self.root)]
        while stack:
            prefix, (held, children) = stack.pop()
            if children is None:
                if held:
                    yield prefix, held
                continue
            for sign, child in children.items():
                if sign == "":
                    yield prefix, {"": child}
                else:
                    stack.append((prefix + sign, child))


def _batch(found: list[tuple[str, list[str], list[int], list[int], bool]]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [[], [], [], [], []]
    kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["prefix", "suffixes", "occurrences", "records", "cut"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the rows of one route and hands on its subtrees; its first and last prefix may go on in other routes."""
    trie, low, high = BurstTrie(), None, None
    for batch in batches:
        values = batch.column("value").to_pylist()
        for value, record in zip(values, batch.column("record").to_pylist()):
            trie.see(value, (record,))
        for value in values:
            head = value[:PREFIX]
            low, high = head if low is None or head < low else low, head if high is None or head > high else high
    found = []
    for prefix, held in trie.subtrees():
        inner, border = [], []
        for suffix, (occurrences, records) in held.items():
            (border if (prefix + suffix)[:PREFIX] in (low, high) else inner).append((suffix, occurrences, records))
        found += [(prefix, *map(list, zip(*part)), cut) for part, cut in ((inner, False), (border, True)) if part]
        if len(found) >= 1000:
            yield _batch(found)
            found = []
    yield _batch(found)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges subtrees value by value; equal ones follow each other, so one trie holds one value's prefix at a time."""
    trie, at = BurstTrie(), None

    def rows() -> Iterator[pa.RecordBatch]:
        yield _batch([(p, list(h), [c[0] for c in h.values()], [c[1] for c in h.values()], False) for p, h in trie.subtrees()])

    for batch in batches:
        for value, occurrences, records in zip(*(batch.column(c).to_pylist() for c in ("value", "occurrences", "records"))):
            if at is not None and value != at and trie.entries >= CONTAINER:
                yield from rows()
                trie = BurstTrie()
            at = value
            trie.add(value, occurrences, records)
    yield from rows()


def value_frequencies(df: DataFrame, group: str, value: Column, record: str, route_rows: int = ROUTE_ROWS) -> DataFrame:
    """``group``, ``value``, ``occurrences``, ``records``: how often each value occurs, and in how many records.

    Routes are ranges of prefixes and, within a prefix, of the records' hash: a value with a third of all rows is spread
    over a third of the routes, while all rows of one value and record meet. The borders come from a sample (of the
    engine's range partitioning, whose size grows with the number of routes only), so they move the work, not the result.
    Within a route the rows come record by record into one trie; no worker holds more than its route's values.

    Rows with a null group or value are no values; a null record counts as one record. An empty table gives no rows.
    ``group`` must not hold the character U+0001. Extra columns are ignored.
    """
    rows = df.select(F.concat(F.col(group).cast("string"), F.lit("\u0001"), value).alias("value"), F.col(record).alias("record")).where("value is not null")
    routes = max(parallelism(df.sparkSession), -(-df.count() // route_rows))
    hashed = rows.withColumn("h", F.xxhash64("record"))
    routed = hashed.repartitionByRange(routes, F.substring("value", 1, PREFIX), "h").sortWithinPartitions("h", "record")
    subtrees = routed.select("value", "record").mapInArrow(_count, _SUBTREES)

    def flat(trees: DataFrame) -> DataFrame:
        zipped = F.arrays_zip("suffixes", "occurrences", "records")
        return trees.select("prefix", "cut", F.explode(zipped).alias("x")).select(F.concat("prefix", "x.suffixes").alias("value"), "x.occurrences", "x.records", "cut")

    counted = cut_lineage(subtrees)
    border = flat(counted.where("cut")).drop("cut")
    merged = border.repartition("value").sortWithinPartitions("value").mapInArrow(_merge, _SUBTREES)
    both = flat(counted.where("not cut")).drop("cut").unionByName(flat(merged).drop("cut"))
    at = F.instr("value", "\u0001")
    return both.select(F.substring("value", F.lit(1), at - 1).alias(group), F.substring("value", at + 1, F.length("value")).alias("value"), "occurrences", "records")


def banded(frequencies: DataFrame, n_records: DataFrame, rare_below: int, common_share: float) -> DataFrame:
    """``frequencies`` with ``band``: ``rare`` under ``rare_below`` records, ``common`` over ``common_share`` of the records
    that ``n_records`` (one row, one column) gives, else null. A value that is both is ``rare``."""
    total = n_records.toDF("n_all")
    band = F.when(F.col("records") < rare_below, F.lit("rare")).when(F.col("records") > F.col("n_all") * F.lit(common_share), F.lit("common"))
    return frequencies.crossJoin(F.broadcast(total)).withColumn("band", band).drop("n_all")
