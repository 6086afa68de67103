"""Mixing sources to target weights.

Each source's documents are laid end to end, in passes, up to its share of the total and
cut into blocks of tokens. The blocks are interleaved by Pfair scheduling: block j of a source
with weight w may start at slot floor(j / w) and must be placed before slot ceil((j + 1) / w).
Placing the earliest deadline first meets all of them, so at no slot is a source off its weight
by a whole block.

Weights are whole numbers of units. After as many slots as there are units every source has exactly
its units, so the schedule repeats: only its first period is made, however large the corpus is, and the
slot of any block is computed from it.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from fractions import Fraction
from math import ceil, floor, gcd, lcm
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary splits a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a block.
BLOCK_TOKENS = 4096
#: Slots of a period, at most; shares that need more are rounded to so many units. The driver makes one period.
MOST_UNITS = 1_000_000
#: Sources with a target, at most.
MOST_SOURCES = 100_000
#: Documents of a source that one task lays out in order, about.
LANE_DOCUMENTS = 100_000


def _count_tokens(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        shipped = Path(SparkFiles.get(Path(path).name))
        with open(shipped if shipped.exists() else path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("mixture", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("source"), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "tokens"])

    return run


def token_counts(df: DataFrame, id_col: str, source_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): each document's size in tokens of the vocabulary file ``tokenizer``, a path on the driver."""
    df.sparkSession.sparkContext.addFile(tokenizer)
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count_tokens(tokenizer), "doc_id bigint, source string, tokens bigint").distinct()


def pfair(weights: dict[str, Fraction], slots: int) -> list[str]:
    """The source of each slot, by earliest deadline among the released blocks."""
    total = sum(weights.values())
    shares = {s: Fraction(w) / total for s, w in weights.items() if w > 0}
    waiting = [(0, s, 0) for s in sorted(shares)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    order = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            p, q = shares[s].numerator, shares[s].denominator
            heapq.heappush(ready, (-(-(j + 1) * q // p), s, j))
        _, s, j = heapq.heappop(ready)
        order.append(s)
        p, q = shares[s].numerator, shares[s].denominator
        heapq.heappush(waiting, ((j + 1) * q // p, s, j + 1))
    return order


def units(shares: dict[str, Fraction], most: int = MOST_UNITS) -> dict[str, int]:
    """``shares`` as whole numbers in proportion: exactly, where their sum is at most ``most``, else rounded to
    parts of ``most``, at least 1 each."""
    if not shares:
        return {}
    common = lcm(*(w.denominator for w in shares.values()))
    exact = {s: int(w * common) for s, w in shares.items()}
    by = gcd(*exact.values())
    if sum(exact.values()) // by <= most:
        return {s: n // by for s, n in exact.items()}
    whole = sum(shares.values())
    return {s: max(1, round(w / whole * most)) for s, w in shares.items()}


class Mixture:
    """A mixture of ``documents`` after ``targets`` (source, target_share, max_repeats).

    Without ``total_tokens`` the mixture is the largest in which each source that has
    documents can reach its share with no document used more than its ``max_repeats`` times;
    a larger total is brought down to that. Shares of sources without any tokens, and with a null or
    non-positive share or number of repeats, are spread over the others in proportion. Documents
    without tokens, with a null id or with a source that has no target are not used; rows
    repeated in full count once; a source with several target rows has the greatest share of them.
    Shares with a common denominator above ``MOST_UNITS`` are rounded to it.
    """

    def __init__(
        self,
        documents: DataFrame,
        targets: DataFrame,
        *,
        id_col: str = "doc_id",
        source_col: str = "source",
        text_col: str = "text",
        tokenizer: str = TOKENIZER,
        total_tokens: int | None = None,
        block_tokens: int = BLOCK_TOKENS,
        lane_documents: int = LANE_DOCUMENTS,
        seed: int = 0,
    ):
        self.spark, self.seed, self.block, self.lane_documents = documents.sparkSession, seed, block_tokens, lane_documents
        wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
            F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("repeats"))).alias("t")
        ).select("source", "t.share", "t.repeats")
        rows = wanted.limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources have targets")
        self.targets = {r.source: (Fraction(str(r.share)), r.repeats) for r in rows}
        counted = token_counts(documents, id_col, source_col, text_col, tokenizer)
        counted = counted.where((F.col("tokens") > 0) & F.col("doc_id").isNotNull())
        self.sizes = cut(counted.join(F.broadcast(wanted.select("source")), "source", "left_semi"))
        held = self.sizes.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("documents")).collect()
        self.plan({r.source: r.n for r in held}, {r.source: r.documents for r in held}, total_tokens)

    def plan(self, held: dict[str, int], documents: dict[str, int], total_tokens: int | None) -> None:
        """Weights, total and budgets from what each source holds: tokens and documents."""
        self.held, self.documents = held, documents
        self.units = units({s: w for s, (w, r) in self.targets.items() if w > 0 and r > 0 and held.get(s)})
        self.period = sum(self.units.values())
        self.weights = {s: Fraction(n, self.period) for s, n in self.units.items()}
        most = min((Fraction(held[s] * self.targets[s][1]) / w for s, w in self.weights.items()), default=Fraction(0))
        self.total = floor(most) if total_tokens is None else min(floor(most), total_tokens)
        self.budget = {s: floor(w * self.total) for s, w in self.weights.items()}

    def schedule(self) -> list[tuple[str, int, int]]:
        """(source, phase, slot) of the first period, or of as much of it as the budgets reach.

        Block j of a source with n units has the slot of its phase j mod n, j div n periods later.
        """
        last = max((ceil(ceil(Fraction(n, self.block)) / self.weights[s]) for s, n in self.budget.items()), default=0)
        placed: dict[str, int] = {}
        rows = []
        for slot, source in enumerate(pfair(self.weights, min(self.period, last))):
            rows.append((source, placed.get(source, 0), slot))
            placed[source] = placed.get(source, 0) + 1
        return rows

    def rows(self) -> DataFrame:
        """(doc_id, source, copy, tokens, slot, start): the uses of documents, to be read by ``slot`` and ``start``.

        ``copy`` counts a document's uses from 0, ``start`` is its place in the source's own sequence. A use
        lies in the slot of the block in which it starts.
        """
        plan = self.spark.createDataFrame(
            [
                (s, self.held[s], self.budget[s], self.targets[s][1], ceil(self.documents[s] / self.lane_documents), self.units[s])
                for s in self.weights
            ],
            "source string, held bigint, budget bigint, repeats int, lanes bigint, units bigint",
        )  # at most MOST_SOURCES rows
        docs = self.sizes.join(F.broadcast(plan), "source").withColumn("hash", F.xxhash64(F.lit(self.seed), "doc_id"))
        docs = docs.withColumn("lane", F.pmod("hash", "lanes"))
        before = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)  # over the lanes of a source
        lanes = docs.groupBy("source", "lane").agg(F.sum("tokens").alias("lane_tokens"))
        lanes = lanes.select("source", "lane", F.coalesce(F.sum("lane_tokens").over(before), F.lit(0)).alias("base"))
        within = Window.partitionBy("source", "lane").orderBy("hash", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
        docs = docs.withColumn("offset", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(lanes, ["source", "lane"])
        first = F.col("base") + F.col("offset")
        # a use counts if at least half of it lies within the budget
        uses = F.floor((F.col("budget") - first - F.col("tokens") / 2) / F.col("held")) + 1
        docs = docs.withColumn("first", first).withColumn("uses", F.least(uses, F.col("repeats").cast("bigint"))).where(F.col("uses") > 0)
        used = docs.select(
            "doc_id", "source", "tokens", "units", "held", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("uses") - 1)).alias("copy")
        ).withColumn("start", F.col("first") + F.col("copy") * F.col("held"))
        block = F.floor(F.col("start") / self.block)
        used = used.withColumn("phase", F.pmod(block, "units")).withColumn("turn", F.floor(block / F.col("units")))
        schedule = pd.DataFrame(self.schedule(), columns=["source", "phase", "slot"])
        schedule = schedule.astype({"source": "object", "phase": "int64", "slot": "int64"})
        slots = self.spark.createDataFrame(schedule, "source string, phase bigint, slot bigint")  # at most MOST_UNITS rows
        slot = F.coalesce(F.col("slot"), F.raise_error(F.lit("a block without a slot")).cast("bigint"))
        return used.join(F.broadcast(slots), ["source", "phase"], "left").select(
            "doc_id", "source", "copy", "tokens", (slot + F.col("turn") * self.period).alias("slot"), "start"
        )

    def shares(self) -> DataFrame:
        """(source, target_share, actual_share, tokens, documents, most_uses): what each source reached, by target row."""
        used = self.rows().groupBy("source").agg(
            F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.max("copy").alias("last")
        )
        targets = self.spark.createDataFrame(
            [(s, float(w)) for s, (w, _) in self.targets.items()], "source string, target_share double"
        )
        found = targets.join(used, "source", "left").fillna(0, ["tokens", "documents"])
        whole = F.sum("tokens").over(Window.partitionBy())  # over one row a source
        return found.select(
            "source", "target_share", (F.col("tokens") / F.greatest(whole, F.lit(1))).alias("actual_share"),
            "tokens", "documents", F.coalesce(F.col("last") + 1, F.lit(0)).alias("most_uses"),
        )
