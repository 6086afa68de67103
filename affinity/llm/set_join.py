"""All pairs of records whose value sets overlap strongly.

The join merges inverted lists and keeps the records that occur on at least T of them
(divide-skip merging). To spread it, each record goes only to the buckets of its rarest
values: two sets that reach the threshold share one of these.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import islice
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.pairs import EXPAND_LIMIT, class_members, copy_pairs, cross_pairs, own_rep
from affinity.session import cut, partitions

BLANKS = " \t\n\r\x0b\x0c 　"
#: Records of one bucket, and of one block of a frequent value.
BUCKET_ROWS = 20_000
#: A value is frequent if it holds this share of all values. There are at most 1 / share of them.
FREQUENT_SHARE = 1 / 2000
FREQUENT_LEAST = 1000
#: Values that one task orders, and sets that one task merges, about.
PARTITION_VALUES = 5_000_000
PARTITION_SETS = 400_000
#: Pairs of an Arrow batch.
BATCH_PAIRS = 100_000
#: Weight of the list length in the number of lists that are left to binary search.
MU = 0.05


def folded(value: Column) -> Column:
    """A term without outer blanks and case."""
    return F.lower(F.btrim(value, F.lit(BLANKS)))


def divide_skip(lists: list[list[int]], starts: list[int], least: int) -> Iterator[tuple[int, int]]:
    """The ordinals on at least ``least`` of the ascending ``lists``, with their number of lists.

    ``starts`` has the first position of each list that counts. The longest lists are not
    merged but searched. The others are merged with a heap; where the smallest ordinal
    can't reach the number, its lists and further ones skip to the next that might.
    """
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]) - starts[i])
    longest = len(lists[order[-1]]) - starts[order[-1]]
    apart = min(least - 1, int(least / (MU * log2(longest + 1) + 1)))
    short, long = order[: len(order) - apart], order[len(order) - apart :]
    need = least - apart
    at = {i: starts[i] for i in short}
    heap = [(lists[i][at[i]], i) for i in short if at[i] < len(lists[i])]
    heapq.heapify(heap)
    while len(heap) >= need:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            count = len(popped)
            for left, i in zip(range(len(long), 0, -1), long):
                if count + left < least:
                    break
                j = bisect_left(lists[i], top, starts[i])
                count += j < len(lists[i]) and lists[i][j] == top
            if count >= least:
                yield top, count
            bound = top + 1
        else:
            while len(popped) < need - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            bound = heap[0][0]
        for i in popped:
            at[i] = bisect_left(lists[i], bound, at[i])
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    return np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(lengths)])


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    rows = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(rows) if rows else None


def _shared_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (token, key) rows, those whose token stands in several sets, with the number of sets.

    All rows of a token are in this partition.
    """
    table = _table(batches)
    if table is None:
        return
    token, key = (np.asarray(table[c].combine_chunks()) for c in ("token", "key"))
    order = np.lexsort((key, token))
    token, key = token[order], key[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
    token, key = token[new], key[new]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    df = np.diff(np.concatenate([first, [len(token)]]))
    df = np.repeat(df, df)
    keep = df > 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(key[keep]), pa.array(token[keep]), pa.array(df[keep].astype(np.int32))], ["key", "token", "df"]
    )


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _ordered_sets(ratio: Fraction, frequent: np.ndarray, heavy: int) -> Callable:
    """Makes each set's array of shareable tokens, rarest first, the length of its prefix, and the tokens of
    its prefix that more than ``heavy`` sets have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(batches)
        if table is None:
            return
        key, token, df = (np.asarray(table[c].combine_chunks()) for c in ("key", "token", "df"))
        hot, offsets = _flat(table["hot"])
        head = df == 0
        # the frequent tokens of a head row, by their place in the list, follow all others
        lengths = np.diff(offsets)
        key = np.concatenate([key, np.repeat(key, lengths)])
        rank = np.concatenate([df.astype(np.int64), hot.astype(np.int64) + 2**40])
        token = np.concatenate([token, frequent[hot] if len(hot) else hot.astype(np.int64)])
        order = np.lexsort((token, rank, key))
        key, rank, token = key[order], rank[order], token[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.concatenate([starts[1:], [len(key)]])
        assert head.sum() == len(starts)
        sizes = token[starts]  # the head row has the size in place of a token
        held = ends - starts - 1
        least = -(-sizes * ratio.numerator // ratio.denominator)
        prefix = np.minimum(held, sizes - least + 1 - (sizes - held))
        keep = (prefix > 0) & (held >= least)
        body = np.ones(len(key), bool)
        body[starts] = False
        body &= np.repeat(keep, ends - starts)
        place = np.arange(len(key)) - np.repeat(starts, ends - starts)  # 0 is the head row
        crowded = body & (place <= np.repeat(prefix, ends - starts)) & (rank > heavy)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key[starts][keep]),
                pa.array(sizes[keep].astype(np.int32)),
                pa.array(prefix[keep].astype(np.int32)),
                _lists(token[body], held[keep]),
                _lists(token[crowded], np.add.reduceat(crowded, starts, dtype=np.int64)[keep]),
            ],
            ["key", "n", "prefix", "tokens", "heavy"],
        )

    return run


class Buckets:
    """Where the sets with a token in their prefix go.

    Tokens share ``count`` buckets by hash. A token in ``blocks`` has cells of its own, one
    for each pair of its blocks of sets, so that none of them grows with the token.
    """

    def __init__(self, count: int, blocks: dict[int, int]):
        self.count, self.blocks, self.offset = count, blocks, {}
        for token, g in sorted(blocks.items()):
            self.offset[token] = count
            count += g * g

    def of_record(self, token: int, key: int) -> list[int]:
        g = self.blocks.get(token)
        if g is None:
            return [(token & 0xFFFFFFFF) * 2654435761 % 2**32 % self.count]
        b = key % g
        return [self.offset[token] + min(b, j) * g + max(b, j) for j in range(g)]

    def of_pair(self, token: int, a: int, b: int) -> int:
        g = self.blocks.get(token)
        if g is None:
            return self.of_record(token, a)[0]
        a, b = sorted((a % g, b % g))
        return self.offset[token] + a * g + b


def _route(buckets: Buckets) -> Callable:
    """Sends each set once to each bucket of its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            tokens, offsets = _flat(table["tokens"])
            keys, prefix = np.asarray(batch["key"]).tolist(), np.asarray(batch["prefix"]).tolist()
            tokens, offsets = tokens.tolist(), offsets.tolist()
            bucket, row = [], []
            for i, key in enumerate(keys):
                found = {b for t in tokens[offsets[i] : offsets[i] + prefix[i]] for b in buckets.of_record(t, key)}
                bucket += found
                row += [i] * len(found)
            picked = batch.select(["key", "n", "tokens"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *picked.columns], ["bucket", *picked.schema.names])

    return run


def _merge_bucket(
    bucket: int, keys: list[int], sizes: list[int], sets: list[list[int]], ratio: Fraction, buckets: Buckets
) -> Iterator[tuple[int, int]]:
    """The pairs of one bucket. Sets are probed and then indexed, smallest first.

    ``sets`` has only the values that several sets of the bucket hold. Sets that agree in these and
    in size are probed once, however many there are.
    """
    p, q = ratio.numerator, ratio.denominator
    alike: dict[tuple[int, tuple[int, ...]], list[int]] = {}
    for i, key in enumerate(keys):
        alike.setdefault((sizes[i], tuple(sets[i])), []).append(key)
    groups = sorted(alike)
    ordered_sizes = [n for n, _ in groups]
    lists: dict[int, list[int]] = {}
    for place, (n, own) in enumerate(groups):
        mine = alike[n, own]
        if len(mine) > 1 and len(own) * (p + q) >= 2 * p * n:
            for i, key in enumerate(mine):
                yield from ((key, other) for other in mine[:i] if buckets.of_pair(own[0], key, other) == bucket)
        least = -(-n * p // q)
        first = bisect_left(ordered_sizes, least)  # smaller sets can't reach it
        probed, starts = [], []
        if first < place:
            for t in own:
                found = lists.get(t)
                if found and found[-1] >= first:
                    probed.append(found)
                    starts.append(bisect_left(found, first))
            if len(probed) >= least:
                for j, overlap in divide_skip(probed, starts, least):
                    m, theirs = groups[j]
                    if overlap * (p + q) >= p * (n + m):
                        held = set(theirs)
                        token = next(t for t in own if t in held)
                        others = alike[m, theirs]
                        yield from ((key, other) for key in mine for other in others if buckets.of_pair(token, key, other) == bucket)
        for t in own:
            lists.setdefault(t, []).append(place)


def _merge(ratio: Fraction, buckets: Buckets) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(batches)
        if table is None:
            return
        table = table.sort_by("bucket")
        bucket, key, n = (np.asarray(table[c].combine_chunks()) for c in ("bucket", "key", "n"))
        tokens, offsets = _flat(table["tokens"])
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for s, e in zip(starts, [*starts[1:], len(bucket)]):
            if e - s < 2:
                continue
            # a token of one set here is on no list of another
            part = tokens[offsets[s] : offsets[e]]
            _, inverse, counts = np.unique(part, return_inverse=True, return_counts=True)
            shared = counts[inverse] > 1
            bounds = np.concatenate([[0], np.cumsum(shared)])[offsets[s : e + 1] - offsets[s]]
            rest = part[shared].tolist()
            enough = np.diff(bounds) >= -(-n[s:e].astype(np.int64) * ratio.numerator // ratio.denominator)
            rows = np.flatnonzero(enough).tolist()
            bounds = bounds.tolist()
            keys, sizes = key[s:e].tolist(), n[s:e].tolist()
            pairs = _merge_bucket(
                int(bucket[s]),
                [keys[i] for i in rows],
                [sizes[i] for i in rows],
                [rest[bounds[i] : bounds[i + 1]] for i in rows],
                ratio,
                buckets,
            )
            while part := list(islice(pairs, BATCH_PAIRS)):
                a, b = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key_a", "key_b"])

    return run


def value_sets(df: DataFrame, id_col: str, values_col: str, side: int, normalize: Callable[[Column], Column] | None) -> DataFrame:
    """(side, id, tokens, key): each record's distinct non-null values as sorted 64-bit tokens.

    Whole numbers are their own tokens, other values are hashed. ``key`` is the hash of the set.
    """
    whole = dict(df.dtypes)[values_col] in ("array<bigint>", "array<int>", "array<smallint>", "array<tinyint>")

    def token(x: Column) -> Column:
        x = normalize(x) if normalize else x
        return x.cast("bigint") if whole else F.xxhash64(x)

    values = F.filter(F.col(values_col), lambda x: x.isNotNull())
    return (
        df.select(F.lit(side).cast("tinyint").alias("side"), F.col(id_col).alias("id"), values.alias("values"))
        .where(F.col("values").isNotNull())
        .select("side", "id", F.array_sort(F.array_distinct(F.transform("values", token))).alias("tokens"))
        .withColumn("key", F.xxhash64("tokens"))
    )


def frequent_tokens(sets: DataFrame, share: float = FREQUENT_SHARE, least: int = FREQUENT_LEAST) -> tuple[list[int], int]:
    """The tokens that hold at least ``share`` of all, rarest first, at most 1 / ``share`` of them; and the number of all."""
    tracked = min(1_000_000, max(10_000, 50 * partitions(sets.sparkSession)))
    counted = sets.select(F.explode("tokens").alias("token")).agg(
        F.count("*").alias("total"), F.expr(f"approx_top_k(token, {ceil(1 / share / 2)}, {tracked})").alias("top")
    )
    row = counted.first()
    if not row["total"]:
        return [], 0
    bound = max(least, row["total"] * share)
    return [x["item"] for x in reversed(row["top"]) if x["count"] >= bound], row["total"]


def set_links(sets: DataFrame, threshold: float, *, bucket_rows: int = BUCKET_ROWS, frequent_least: int = FREQUENT_LEAST) -> DataFrame:
    """(key_a, key_b): pairs of different sets with a Jaccard similarity of at least ``threshold``."""
    spark = sets.sparkSession
    ratio = Fraction(str(threshold))
    if not 0 < ratio <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    frequent, values = frequent_tokens(sets, least=frequent_least)
    count = max(partitions(spark), -(-values // PARTITION_VALUES))
    places = {t: i for i, t in enumerate(frequent)}
    hot = F.lit(False) if not frequent else F.col("token").isin(frequent)

    heads = (
        sets.select("key", F.size("tokens").alias("n"), (F.filter("tokens", lambda x: x.isin(frequent)) if frequent else F.array().cast("array<bigint>")).alias("hot"))
        .groupBy("key")
        .agg(F.first("n").alias("n"), F.first("hot").alias("hot"))
    )
    if frequent:
        where = F.create_map(*[F.lit(x) for t in places.items() for x in t])
        heads = heads.withColumn("hot", F.transform("hot", lambda x: where[x].cast("int")))
    else:
        heads = heads.withColumn("hot", F.array().cast("array<int>"))
    shared = (
        sets.select(F.explode("tokens").alias("token"), "key")
        .where(~hot)
        .repartition(count, "token")
        .mapInArrow(_shared_values, "key bigint, token bigint, df int")
    )
    # empty, not null: null lists are slow to hand to Python
    both = shared.withColumn("hot", F.array().cast("array<int>")).unionByName(
        heads.select("key", F.col("n").cast("bigint").alias("token"), F.lit(0).alias("df"), "hot")
    )
    ordered = cut(
        both.repartition(count, "key").mapInArrow(
            _ordered_sets(ratio, np.array(frequent, np.int64), bucket_rows),
            "key bigint, n int, prefix int, tokens array<bigint>, heavy array<bigint>",
        )
    )
    # the tokens whose sets are too many for a bucket; each has more than bucket_rows of all prefixes
    rows = ordered.agg(F.sum("prefix")).first()[0] or 0
    crowds = ordered.select(F.explode("heavy").alias("token")).groupBy("token").count().where(F.col("count") > bucket_rows).collect()
    blocks = {r["token"]: ceil(r["count"] / bucket_rows) for r in crowds}
    buckets = Buckets(max(1, ceil(rows / bucket_rows)), blocks)
    total = buckets.count + sum(g * g for g in blocks.values())
    routed = rows + sum(r["count"] * (blocks[r["token"]] - 1) for r in crowds)
    tasks = max(min(total, partitions(spark, 4)), -(-routed // PARTITION_SETS))
    return (
        ordered.mapInArrow(_route(buckets), "bucket bigint, key bigint, n int, tokens array<bigint>")
        .repartition(tasks, "bucket")
        .mapInArrow(_merge(ratio, buckets), "key_a bigint, key_b bigint")
    )


def _both_sets(
    left: DataFrame, id_col: str, values_col: str, right: DataFrame | None, min_values: int, normalize: Callable[[Column], Column] | None
) -> DataFrame:
    sets = value_sets(left.where(F.col(id_col).isNotNull()), id_col, values_col, 0, normalize)
    if right is not None:
        sets = sets.unionByName(value_sets(right.where(F.col(id_col).isNotNull()), id_col, values_col, 1, normalize))
    return sets.where(F.size("tokens") >= max(1, min_values))


def large_classes(
    left: DataFrame,
    id_col: str,
    values_col: str,
    *,
    right: DataFrame | None = None,
    min_values: int = 1,
    normalize: Callable[[Column], Column] | None = None,
    expand_limit: int = EXPAND_LIMIT,
) -> DataFrame:
    """(side, id, rep): the records of classes of more than ``expand_limit`` equal sets, each with its class's representative on its side.

    ``similar_pairs``, called alike, links such a class to others by its representatives; a record has the links of
    its own. ``side`` is 0 for ``left`` and 1 for ``right``.
    """
    members = class_members(_both_sets(left, id_col, values_col, right, min_values, normalize).select("key", "side", "id"))
    return members.where(F.col("c") > expand_limit).select("side", "id", own_rep().alias("rep"))


def similar_pairs(
    left: DataFrame,
    id_col: str,
    values_col: str,
    threshold: float,
    *,
    right: DataFrame | None = None,
    min_values: int = 1,
    normalize: Callable[[Column], Column] | None = None,
    expand_limit: int = EXPAND_LIMIT,
    bucket_rows: int = BUCKET_ROWS,
    frequent_least: int = FREQUENT_LEAST,
) -> DataFrame:
    """(id_a, id_b): all pairs of records whose value sets have a Jaccard similarity of at least ``threshold``.

    Within ``left`` (id_a < id_b), or between ``left`` (id_a) and ``right`` (id_b), which
    has the same column names. ``min_values`` distinct values, at least 1, are needed to form
    a pair. Null records, null elements, repeated elements and repeated rows count for
    nothing; an id with several sets stands for each of them; null ids form no pair; other
    columns are not read. Equal sets pair in full up to ``expand_limit`` records; a larger
    class is given by the pairs of its representative, its smallest id on either side, see ``copy_pairs``;
    ``large_classes`` has its records. Values other than whole numbers, and sets, are compared by 64-bit hash.
    """
    sets, between = _both_sets(left, id_col, values_col, right, min_values, normalize), right is not None
    links = set_links(sets, threshold, bucket_rows=bucket_rows, frequent_least=frequent_least)
    members = class_members(sets.select("key", "side", "id"))
    return (
        cross_pairs(links, members, expand_limit, between)
        .unionByName(copy_pairs(members, expand_limit, between))
        .distinct()
    )
