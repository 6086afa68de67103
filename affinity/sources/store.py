"""The saved index: filters and stopwords in Parquet, by version, and a manifest that names the current one."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from affinity.operators.bitmap import SCHEMA
from affinity.sources.files import Files

FORMAT_VERSION = 2
OLDEST_DAYS = 30
WORDS = ("doc_id", "pos", "word")
KEYS = ("version", "timestamp", "params", "stats", "current")


@dataclass(frozen=True)
class SavedIndex:
    filters: DataFrame
    stopwords: list[str]
    manifest: dict[str, Any]
    words: DataFrame | None = None  # the word index, where it was saved

    @property
    def since(self) -> int | None:
        """The id from which documents are filtered by the stopwords; null for all."""
        return self.manifest["params"].get("since")


def validate_manifest(manifest: Any, now: datetime | None = None) -> tuple[bool, str]:
    """Whether a manifest can be used, and if not, why."""
    if not isinstance(manifest, dict):
        return False, "not an object"
    if not isinstance(manifest.get("version"), int) or manifest["version"] != FORMAT_VERSION:
        return False, "another version"
    if missing := [k for k in KEYS if k not in manifest]:
        return False, f"missing {', '.join(missing)}"
    params, stats = manifest["params"], manifest["stats"]
    if not isinstance(params, dict) or not {"bits", "hashes"} <= set(params):
        return False, "no parameters"
    if not isinstance(stats, dict) or "documents" not in stats:
        return False, "no statistics"
    try:
        saved = datetime.fromisoformat(manifest["timestamp"])
    except (TypeError, ValueError):
        return False, "no time"
    if (now or datetime.now(timezone.utc)) - saved > timedelta(days=OLDEST_DAYS):
        return False, "too old"
    return True, ""


class IndexStore:
    """Saves and loads an index in a folder.

    A save writes a new version, reads it back and only then changes the manifest, so a failed save
    leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, Files(spark, folder)

    def _versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self.files.names() if n.startswith("v=") and n[2:].isdigit())

    def save(
        self, filters: DataFrame, stopwords: list[str], *, bits: int, hashes: int, threshold: float | None = None,
        since: int | None = None, words: DataFrame | None = None, keep: int = 2,
    ) -> dict[str, Any]:
        version = max(self._versions(), default=0) + 1
        place = self.files.at(f"v={version}")
        written = Observation("index")
        filters.observe(written, F.count(F.lit(1)).alias("n")).write.parquet(f"{place}/filters")
        common = self.spark.createDataFrame([(w,) for w in stopwords], "word string")
        common.coalesce(1).write.parquet(f"{place}/stopwords")
        if words is not None:
            words.select(*WORDS).write.parquet(f"{place}/words")
        count = self.spark.read.schema(SCHEMA).parquet(f"{place}/filters").count()
        if count != written.get["n"]:
            raise OSError("the filters were not written whole")
        if self.spark.read.parquet(f"{place}/stopwords").count() != len(stopwords):
            raise OSError("the stopwords were not written whole")
        manifest = {
            "version": FORMAT_VERSION,
            "timestamp": datetime.now(timezone.utc).isoformat(),
            "params": {"bits": bits, "hashes": hashes, "similarity_threshold": threshold, "since": since},
            "stats": {"documents": count, "stopwords": len(stopwords)},
            "current": version,
        }
        self.files.write("manifest.json", json.dumps(manifest))
        for old in self._versions()[:-keep]:
            self.files.delete(f"v={old}")
        return manifest

    def manifest(self) -> Any:
        if not self.files.exists("manifest.json"):
            return None
        try:
            return json.loads(self.files.read("manifest.json"))
        except ValueError:
            return None

    def load(self, *, bits: int, hashes: int, now: datetime | None = None) -> SavedIndex | None:
        """The saved index, or null if there is none that fits, so that it must be built.

        Filters whose number of words is wrong are left out. Another threshold is no obstacle.
        """
        manifest = self.manifest()
        if not validate_manifest(manifest, now)[0]:
            return None
        if (manifest["params"]["bits"], manifest["params"]["hashes"]) != (bits, hashes):
            return None
        place = self.files.at(f"v={manifest['current']}")
        filters = self.spark.read.schema(SCHEMA).parquet(f"{place}/filters")
        filters = filters.where((F.col("m") == bits) & (F.size("words") == bits // 64))
        if filters.isEmpty():
            return None
        common = [r.word for r in self.spark.read.schema("word string").parquet(f"{place}/stopwords").collect()]
        known = self.files.exists(f"v={manifest['current']}/words")
        words = self.spark.read.schema("doc_id bigint, pos int, word string").parquet(f"{place}/words") if known else None
        return SavedIndex(filters, common, manifest, words)

    def delete(self) -> bool:
        """Remove the saved index; whether there was one."""
        return self.files.delete() if self.files.exists() else False


def words32(words: Column) -> Column:
    """The unsigned 32-bit words of a filter's 64-bit words."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    return F.flatten(F.transform(words, lambda w: F.array(w.bitwiseAND(mask), F.shiftrightunsigned(w, 32))))


def words64(words: Column) -> Column:
    """The 64-bit words of a filter's unsigned 32-bit words; an odd last one is filled with zeros."""
    low = F.filter(words, lambda w, i: i % 2 == 0)
    high = F.filter(words, lambda w, i: i % 2 == 1)
    return F.zip_with(low, high, lambda a, b: a.bitwiseOR(F.shiftleft(F.coalesce(b, F.lit(0).cast("bigint")), 32)))


def to_json(filters: DataFrame) -> DataFrame:
    """(doc_id, json): each filter as an object with size, hashFunctions and bitArray."""
    body = F.struct(F.col("m").alias("size"), F.col("k").alias("hashFunctions"), words32(F.col("words")).alias("bitArray"))
    return filters.select("doc_id", F.to_json(body).alias("json"))


def from_json(rows: DataFrame, m: int, k: int) -> DataFrame:
    """Filters from ``to_json``; another size or number of hash functions is an error."""
    parsed = F.from_json("json", "size int, hashFunctions int, bitArray array<bigint>")
    ok = (F.col("f.size") == m) & (F.col("f.hashFunctions") == k) & (F.size("f.bitArray") == m // 32)
    words = F.when(ok, words64(F.col("f.bitArray"))).otherwise(F.raise_error(F.lit("the filter has another shape")).cast("array<bigint>"))
    out = rows.select("doc_id", parsed.alias("f")).select("doc_id", F.lit(m).alias("m"), F.lit(k).alias("k"), words.alias("words"))
    return out.withColumn("popcount", F.aggregate("words", F.lit(0), lambda s, w: s + F.bit_count(w)))
