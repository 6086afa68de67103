"""Keeping an index up to date from a stream of changes.

Each micro-batch writes one segment with the new filters of added and edited documents and a mark for
deleted ones. Reading takes the last segment that has a document. A batch that is tried again writes
over its own segment, so each change counts once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from affinity.config import DEFAULT, EngineConfig
from affinity.operators.bitmap import build_filters
from affinity.operators.terms import bounded, document_terms, preprocessed, tokenized
from affinity.sources.files import Files

CHANGES = "doc_id bigint, op string, text string, ts timestamp"
SEGMENT = "doc_id bigint, deleted boolean, m int, k int, words array<bigint>, popcount int, n_items int"


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each document; of equal times a deletion, then the greater text."""
    rank = F.struct("ts", (F.col("op") == "delete").alias("gone"), "text")
    return changes.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max_by(F.struct("op", "text"), rank).alias("c")).select("doc_id", "c.op", "c.text")


class LiveIndex:
    """An index in segments below a folder. ``documents`` is the size of the corpus, where texts are cut by it."""

    def __init__(self, spark: SparkSession, folder: str, bits: int, config: EngineConfig = DEFAULT, common: list[str] | None = None, *, documents: int = 0):
        self.spark, self.files = spark, Files(spark, folder)
        self.bits, self.config, self.common = bits, config, common
        self.limit = config.text_bound(documents)

    def filters_of(self, texts: DataFrame) -> DataFrame:
        """Filters of (doc_id, text), by the same steps as a full build; the stopwords stay as they were learned."""
        tokens = tokenized(bounded(texts, self.config, self.limit))
        return build_filters(document_terms(preprocessed(tokens, self.config, self.common), self.config.capped_pairs), self.bits, self.config.hashes)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Write the segment of one batch of ``changes`` (doc_id, op, text, ts)."""
        changes = last_changes(changes.select("doc_id", "op", "text", "ts"))
        new = self.filters_of(changes.where(F.col("op") != "delete")).withColumn("deleted", F.lit(False))
        gone = changes.where(F.col("op") == "delete").select("doc_id", F.lit(True).alias("deleted"))
        rows = new.unionByName(gone, allowMissingColumns=True)
        rows.select([c.split()[0] for c in SEGMENT.split(", ")]).write.mode("overwrite").parquet(self.files.at(f"segment={batch}"))

    def _state(self) -> tuple[str | None, list[int]]:
        """The folder of the last compaction, and the segments after it."""
        numbers = sorted(int(n.partition("=")[2]) for n in self.files.names() if n.startswith("segment="))
        if not self.files.exists("compacted.json"):
            return None, numbers
        state = json.loads(self.files.read("compacted.json"))
        return state["folder"], [n for n in numbers if n > state["upto"]]

    def current(self) -> DataFrame:
        """The filters of all documents that are not deleted."""
        base, numbers = self._state()
        parts = [self.spark.read.schema(SEGMENT).parquet(self.files.at(base)).withColumn("segment", F.lit(-1))] if base else []
        if numbers:
            rows = self.spark.read.schema(f"{SEGMENT}, segment bigint").option("basePath", self.files.folder)
            parts.append(rows.parquet(*[self.files.at(f"segment={n}") for n in numbers]))
        if not parts:
            return self.spark.createDataFrame([], SEGMENT).drop("deleted")
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        last = rows.groupBy("doc_id").agg(F.max("segment").alias("segment"))
        return rows.join(last, ["doc_id", "segment"]).where(~F.col("deleted")).drop("deleted", "segment")

    def compact(self) -> None:
        """Bring all segments so far into one folder, which counts once it is written whole.

        Until then readers take the segments; the segments of the compaction before are removed only now, so
        that who began to read them can end.
        """
        base, numbers = self._state()
        if not numbers:
            return
        upto, folder = numbers[-1], f"compacted-{numbers[-1]:012d}"
        self.current().withColumn("deleted", F.lit(False)).write.mode("overwrite").parquet(self.files.at(folder))
        old = [n for n in self.files.names() if n.startswith("segment=") and int(n.partition("=")[2]) not in numbers]
        old += [n for n in self.files.names() if n.startswith("compacted-") and n not in (base, folder)]
        self.files.write("compacted.json", json.dumps({"folder": folder, "upto": upto}))
        for n in old:
            self.files.delete(n)

    def follow(self, folder: str, checkpoint: str, *, files_per_batch: int = 5, every: str | None = None) -> StreamingQuery:
        """Apply the Parquet files of changes that come into ``folder``; with ``every``, for good, else those there now."""
        stream = self.spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
