"""Occurrences and records of every distinct term, counted in burst tries.

A burst trie holds terms in containers (here dicts from the rest of the term to its counters) under a trie of leading
characters. A container that grows past its limit bursts into one container per next character, so prefixes are as
long as the terms below them are many. Each task counts its records in such a trie; the terms then go, by common routing
prefixes, to the tasks that merge matching subtrees. The routing prefixes are the containers of a trie over a bounded
sample of the terms counted: they decide only where a term is merged, never whether or how.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import inkwell.functions.arrow  # noqa: F401  lets the functions below travel with the plan
from inkwell.llm.words import words_of
from inkwell.session import written

#: Terms a container holds before it bursts.
CONTAINER = 512
#: Terms a task holds before it sends what it has counted so far and starts anew.
HELD = 500_000
#: Terms sampled for the routing prefixes, characters read of each, and terms a routing container holds before it bursts.
SAMPLE, LONGEST, ROUTE = 10_000, 64, 32


class BurstTrie:
    """Terms with two counters each."""

    def __init__(self, limit: int = CONTAINER) -> None:
        self.limit, self.size = limit, 0
        self.root: list = [{}, {}, None]  # children by character, container, counters of the prefix itself

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at, end = self.root, 0, len(term)
        while node[0] and at < end:
            below = node[0].get(term[at])
            if below is None:
                below = node[0][term[at]] = [{}, {}, None]
            node, at = below, at + 1
        if at == end:
            if node[2] is None:
                node[2] = [0, 0]
                self.size += 1
            counters = node[2]
        else:
            rest = term[at:]
            counters = node[1].get(rest)
            if counters is None:
                counters = node[1][rest] = [0, 0]
                self.size += 1
                if len(node[1]) > self.limit:
                    self.burst(node)
        counters[0] += occurrences
        counters[1] += records

    @staticmethod
    def burst(node: list) -> None:
        for rest, counters in node[1].items():
            below = node[0].setdefault(rest[0], [{}, {}, None])
            if len(rest) == 1:
                below[2] = counters
            else:
                below[1][rest[1:]] = counters
        node[1] = {}

    def containers(self) -> Iterator[tuple[str, dict, list | None]]:
        """(prefix, container, counters of the prefix itself), in the order of the prefixes."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if node[1] or node[2]:
                yield prefix, node[1], node[2]
            stack.extend((prefix + c, node[0][c]) for c in sorted(node[0], reverse=True))

    def terms(self) -> Iterator[tuple[str, int, int]]:
        for prefix, container, own in self.containers():
            if own:
                yield prefix, own[0], own[1]
            for rest, (occurrences, records) in container.items():
                yield prefix + rest, occurrences, records


def routing_prefixes(counted: DataFrame) -> frozenset[str]:
    """The prefixes at which a trie over about SAMPLE of the terms counted(term, occurrences, records) splits.

    The terms are picked by a hash, from all tasks that counted alike, and cut to LONGEST characters, so what comes to
    the driver is bounded.
    """
    trie, share = BurstTrie(ROUTE), SAMPLE / max(SAMPLE, counted.count())
    place = F.pmod(F.xxhash64("term", "occurrences", "records"), F.lit(2**31))
    for row in counted.where(place < int(share * 2**31)).select(F.substring("term", 1, LONGEST).alias("term")).limit(2 * SAMPLE).collect():
        trie.add(row.term, 1, 1)
    inner: set[str] = set()
    for prefix, _, _ in trie.containers():
        inner.update(prefix[:n] for n in range(len(prefix)))
    return frozenset(inner)


def route_of(term: str, inner: frozenset[str]) -> str:
    """The shortest prefix of term at which the routing trie doesn't split."""
    at = 0
    while at < len(term) and term[:at] in inner:
        at += 1
    return term[:at]


COUNTED = StructType([StructField("term", StringType()), StructField("occurrences", LongType()), StructField("records", LongType())])
SENT = StructType([StructField("route", StringType()), *COUNTED])


def _batches(rows: Iterator[tuple], schema: StructType) -> Iterator[pa.RecordBatch]:
    types = [pa.string() if isinstance(f.dataType, StringType) else pa.int64() for f in schema]
    block: list[tuple] = []

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*block), types)], names=schema.names)

    for row in rows:
        block.append(row)
        if len(block) >= 65_536:
            yield pack()
            block = []
    if block:
        yield pack()


def count_terms(records: DataFrame) -> DataFrame:
    """term, occurrences, records of every distinct word of records(text).

    Null and empty texts count as records without words; a text of any length is read whole; repeated rows count each.
    An empty table gives an empty result; other columns are ignored.

    Each task counts its records in a burst trie and writes it; the tries' terms are then routed by adaptive prefixes,
    taken from a sample of what was counted, and merged. Terms arrive in order, so a merging task hands over its trie
    whenever it holds HELD terms, and no vocabulary is too large for it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            trie = BurstTrie()
            for batch in batches:
                occurrences: Counter = Counter()
                number: Counter = Counter()
                for text in batch.column(0).to_pylist():
                    words = words_of(text) if text else []
                    occurrences.update(words)
                    number.update(set(words))
                for term, n in occurrences.items():
                    trie.add(term, n, number[term])
                if trie.size > HELD:
                    yield from trie.terms()
                    trie = BurstTrie()
            yield from trie.terms()

        return _batches(rows(), COUNTED)

    counted = written(records.select("text").mapInArrow(count, COUNTED))
    inner = routing_prefixes(counted)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            routes = pa.array([route_of(term, inner) for term in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([routes, *batch.columns], names=SENT.names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            trie, last = BurstTrie(), None
            for batch in batches:
                for term, n, number in zip(*(c.to_pylist() for c in batch.columns)):
                    if trie.size >= HELD and term != last:  # all terms before this one are complete
                        yield from trie.terms()
                        trie = BurstTrie()
                    trie.add(term, n, number)
                    last = term
            yield from trie.terms()

        return _batches(rows(), COUNTED)

    sent = counted.mapInArrow(route, SENT).repartition("route").sortWithinPartitions("term")
    return sent.select("term", "occurrences", "records").mapInArrow(merge, COUNTED)


def mark_terms(words: DataFrame, counts: DataFrame, total: DataFrame, rare: int = 3, common: float = 0.5) -> DataFrame:
    """word, occurrences, records, mark of each word: 'rare' in at most rare records, 'common' in at least that share.

    total has one row with the number of records (n). A word that is both, which needs a tiny collection, is rare.
    """
    known = words.join(counts.withColumnRenamed("term", "word"), "word", "left").crossJoin(F.broadcast(total))
    number = F.coalesce("records", F.lit(0))
    mark = F.when(number <= rare, "rare").when(number >= common * F.col("n"), "common")
    return known.select("word", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), number.alias("records"), mark.alias("mark"))
