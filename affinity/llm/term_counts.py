"""How often every distinct term occurs, and in how many records.

Each task counts into a burst trie: terms lie in small containers by prefix, and a container
that grows too large bursts into one for each next character. The containers of all tasks are
then routed whole by adaptive prefixes, which are longer where there are more terms, and those that meet
under a prefix are merged into one trie, container by container.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.session import cut, partitions

#: Terms of a container beyond which it bursts.
BURST = 1024
#: Terms at one routed prefix, about; a prefix with more of them is made longer.
ROUTE_TERMS = 50_000
#: Distinct terms of a task's trie, about, before it is handed on; and of a task that merges.
TRIE_TERMS = 2_000_000
PARTITION_TERMS = 2_000_000
#: Terms of an Arrow batch.
BATCH_TERMS = 20_000
#: Ids on several rows are broadcast up to this number.
BROADCAST_IDS = 200_000
PART = "prefix string, terms bigint, suffixes array<string>, occurrences array<bigint>, records array<bigint>"


class _Node:
    """A container of counters by suffix, or, once burst, an inner node.

    An inner node stands for ``path``, which all terms below it share, and has a child for each
    character that follows; ``held`` then has only the counter of the term that ends here.
    """

    __slots__ = ("path", "children", "held")

    def __init__(self, path: str = "", children: dict[str, _Node] | None = None, held: dict[str, list[int]] | None = None):
        self.path, self.children, self.held = path, children, {} if held is None else held


class BurstTrie:
    """Term counters below prefixes, in containers of up to ``limit`` terms; chains of single characters are one path."""

    def __init__(self, limit: int = BURST):
        self.limit = limit
        self.root = _Node()

    def _find(self, term: str) -> tuple[_Node, int]:
        """The container for the term, or the inner node at which it ends, and the place up to which it leads."""
        node, at = self.root, 0
        while node.children is not None:
            if not term.startswith(node.path, at):
                self._split(node, len(commonprefix([node.path, term[at : at + len(node.path)]])))
            at += len(node.path)
            if at == len(term):
                break
            child = node.children.get(term[at])
            if child is None:
                child = node.children[term[at]] = _Node()
            node, at = child, at + 1
        return node, at

    @staticmethod
    def _split(node: _Node, at: int) -> None:
        """Cut an inner node's path in two at a place where terms part."""
        below = _Node(node.path[at + 1 :], node.children, node.held)
        node.path, node.children, node.held = node.path[:at], {node.path[at]: below}, {}

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at = self._find(term)
        self._put(node, term[at:], occurrences, records)

    def _put(self, node: _Node, suffix: str, occurrences: int, records: int) -> None:
        counter = node.held.get(suffix)
        if counter:
            counter[0] += occurrences
            counter[1] += records
            return
        node.held[suffix] = [occurrences, records]
        if node.children is None and len(node.held) > self.limit:
            self._burst(node)

    def _burst(self, node: _Node) -> None:
        full = [node]
        while full:
            node = full.pop()
            held = node.held
            node.path = commonprefix([min(held), max(held)])
            node.children, node.held = {}, {}
            at = len(node.path)
            for suffix, counter in held.items():
                if len(suffix) == at:
                    node.held[""] = counter
                    continue
                child = node.children.get(suffix[at])
                if child is None:
                    child = node.children[suffix[at]] = _Node()
                child.held[suffix[at + 1 :]] = counter
            full += [c for c in node.children.values() if len(c.held) > self.limit]

    def merge(self, prefix: str, suffixes: list[str], occurrences: list[int], records: list[int]) -> None:
        """Take in a container of another trie: as a whole where one lies at or above its prefix here, else term by term."""
        node, at = self._find(prefix)
        rest = prefix[at:]
        for suffix, o, r in zip(suffixes, occurrences, records):
            if node.children is None:
                self._put(node, rest + suffix, o, r)
            else:  # it was burst here
                self.add(prefix + suffix, o, r)

    def subtrees(self) -> Iterator[tuple[str, list[str], list[int], list[int]]]:
        """(prefix, suffixes, occurrences, records) of every container."""
        waiting = [("", self.root)]
        while waiting:
            prefix, node = waiting.pop()
            prefix += node.path
            if node.held:
                yield prefix, list(node.held), [c[0] for c in node.held.values()], [c[1] for c in node.held.values()]
            waiting += [(prefix + c, child) for c, child in (node.children or {}).items()]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


NAMES = ["prefix", "suffixes", "occurrences", "records"]


def _containers(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for prefix, suffixes, occurrences, records in trie.subtrees():
        out.append((prefix, len(suffixes), suffixes, occurrences, records))
        size += len(suffixes)
        if size > BATCH_TERMS:
            yield _batch(out, ["prefix", "terms", *NAMES[1:]])
            out, size = [], 0
    if out:
        yield _batch(out, ["prefix", "terms", *NAMES[1:]])


def _count(limit: int, most: int) -> Callable:
    """Counts the terms of lists; a trie with ``most`` terms is handed on and a new one begun."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held = BurstTrie(limit), 0
        for batch in batches:
            lists = batch.column(0)
            terms = lists.flatten()
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            rows = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
            codes = np.asarray(coded.indices).astype(np.int64)
            distinct = coded.dictionary.to_pylist()
            occurrences = np.bincount(codes, minlength=len(distinct)).tolist()
            once = np.unique(rows * len(distinct) + codes) % len(distinct)
            records = np.bincount(once, minlength=len(distinct)).tolist()
            for term, o, r in zip(distinct, occurrences, records):
                trie.add(term, o, r)
            held += len(distinct)
            if held > most:
                yield from _containers(trie)
                trie, held = BurstTrie(limit), 0
        yield from _containers(trie)

    return run


def _count_again(limit: int) -> Callable:
    """Puts terms that are counted already into containers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trie = BurstTrie(limit)
            for term, o, r in zip(*(c.to_pylist() for c in batch.columns)):
                trie.add(term, o, r)
            yield from _containers(trie)

    return run


def adaptive_prefixes(weights: list[tuple[str, int]], target: int) -> list[str]:
    """The prefixes at which terms part with more than ``target`` terms at or below them, from the containers' sizes; sorted."""
    total: dict[str, int] = {}
    for prefix, terms in weights:
        total[prefix] = total.get(prefix, 0) + terms
    names = sorted(total)
    upto = [0, *accumulate(total[n] for n in names)]
    nodes = {"", *names, *(commonprefix([a, b]) for a, b in zip(names, names[1:]))}
    below = ((n, upto[bisect_left(names, n + chr(0x10FFFF))] - upto[bisect_left(names, n)]) for n in nodes)
    return sorted(n for n, terms in below if terms > target)


class Routes:
    """Where containers are merged: under the longest of the ``long`` prefixes that leads to them, and its next character."""

    def __init__(self, long: list[str]):
        self.long, self.known = long, set(long)
        self.lengths = sorted({len(p) for p in long}, reverse=True)

    def key(self, text: str) -> str:
        for n in self.lengths:
            if n <= len(text) and text[:n] in self.known:
                return text[: n + 1]
        return ""

    def parts(self, prefix: str) -> bool:
        """Whether terms below ``prefix`` go different ways."""
        at = bisect_left(self.long, prefix)
        return at < len(self.long) and self.long[at].startswith(prefix)


def _route(long: list[str]) -> Callable:
    """Gives every container its key; one whose terms go different ways is taken apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes = Routes(long)
        for batch in batches:
            prefixes = batch.column("prefix").to_pylist()
            whole = [i for i, p in enumerate(prefixes) if not routes.parts(p)]
            keys = pa.array([routes.key(prefixes[i]) for i in whole], pa.string())
            kept = batch.select(NAMES).take(pa.array(whole, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *kept.columns], ["key", *NAMES])
            out: dict[tuple[str, str], tuple[list, list, list]] = {}
            apart = batch.take(pa.array([i for i, p in enumerate(prefixes) if routes.parts(p)], pa.int64()))
            for prefix, suffixes, occurrences, records in zip(*(apart.column(n).to_pylist() for n in NAMES)):
                for suffix, o, r in zip(suffixes, occurrences, records):
                    mine = out.setdefault((routes.key(prefix + suffix), prefix), ([], [], []))
                    mine[0].append(suffix)
                    mine[1].append(o)
                    mine[2].append(r)
            if out:
                yield _batch([(*k, *x) for k, x in out.items()], ["key", *NAMES])

    return run


def _merge(limit: int) -> Callable:
    """Merges the containers of each key, which come one key after another."""

    def told(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
        terms, occurrences, records = [], [], []
        for prefix, suffixes, o, r in trie.subtrees():
            terms += [prefix + s for s in suffixes]
            occurrences += o
            records += r
            if len(terms) > BATCH_TERMS:
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(occurrences), pa.array(records)], ["term", *NAMES[2:]])
                terms, occurrences, records = [], [], []
        if terms:
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(occurrences), pa.array(records)], ["term", *NAMES[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, at = BurstTrie(limit), None
        for batch in batches:
            for key, *container in zip(*(batch.column(n).to_pylist() for n in ("key", *NAMES))):
                if key != at:
                    yield from told(trie)
                    trie, at = BurstTrie(limit), key
                trie.merge(*container)
        yield from told(trie)

    return run


def term_counts(
    df: DataFrame,
    id_col: str,
    terms_col: str,
    normalize: Callable[[Column], Column] | None = None,
    *,
    burst: int = BURST,
    route_terms: int = ROUTE_TERMS,
    trie_terms: int = TRIE_TERMS,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """(term, occurrences, records): how often every term occurs, and in how many records.

    ``occurrences`` counts each element of each distinct row, ``records`` the distinct ids that
    hold the term. Rows repeated in full count once; an id with several lists is one record;
    null ids, lists and elements count for nothing. A very frequent term is counted within each
    task before the shuffle. Lists of ids that stand on one row are counted where they lie.
    """
    spark = df.sparkSession
    fold = normalize or (lambda x: x.cast("string"))
    values = F.filter(F.col(terms_col), lambda x: x.isNotNull())
    rows = df.where(F.col(id_col).isNotNull() & F.col(terms_col).isNotNull()).select(F.col(id_col).alias("id"), values.alias("raw"))
    # ids on several rows, by repetition or with several lists; broadcast only where they are few
    several = cut(rows.groupBy("id").count().where(F.col("count") > 1).select("id"))
    if several.count() <= broadcast_ids:
        several = F.broadcast(several)
    lists = rows.join(several, "id", "left_anti").select(F.transform("raw", fold).alias("terms"))
    held = rows.join(several, "id", "left_semi").distinct().select("id", F.explode(F.transform("raw", fold)).alias("term"))
    counted = (
        held.groupBy("id", "term").agg(F.count("*").alias("occurrences"))
        .groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("records"))
    )
    parts = cut(lists.mapInArrow(_count(burst, trie_terms), PART).unionByName(counted.mapInArrow(_count_again(burst), PART)))

    heavy = parts.groupBy("prefix").agg(F.sum("terms").alias("terms"))
    total = parts.agg(F.sum("terms")).first()[0] or 0
    count = max(partitions(spark), -(-total // PARTITION_TERMS))
    # Only containers that could make a prefix heavy matter; there are at most total / floor of them.
    target = max(route_terms, total // (64 * count))
    weights = [(r.prefix, r.terms) for r in heavy.where(F.col("terms") > max(0, target // 256)).collect()]
    routed = parts.mapInArrow(_route(adaptive_prefixes(weights, target)), f"key string, {PART.replace('terms bigint, ', '')}")
    return (
        routed.repartition(count, "key").sortWithinPartitions("key")
        .mapInArrow(_merge(burst), "term string, occurrences bigint, records bigint")
    )


def marked_terms(counts: DataFrame, records: int, common: float, *, rare_below: int = 3, blank: str = r"\s") -> DataFrame:
    """``counts`` with ``mark``: ``common`` from a share of ``common`` of all ``records`` on, ``rare`` for
    single words in fewer than ``rare_below`` records, else null."""
    share = F.col("records") / F.lit(float(max(records, 1)))
    mark = F.when(share >= F.lit(common), "common").when((F.col("records") < rare_below) & ~F.col("term").rlike(blank), "rare")
    return counts.withColumn("mark", mark)
