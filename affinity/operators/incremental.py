"""Processing only new or changed records.

A run rereads the source from the oldest transaction that was open when the last successful
run began, since what was open then may have come in behind it. What was processed before is
removed by an anti-join of key and version against the ledger of processed versions.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinity.sources.files import Files

#: Runs are held by the driver when they are replayed together.
MOST_RUNS = 1_000_000
#: Runs up to which a sighting's run is found by a tree of comparisons.
TREE_RUNS = 256


def _same(a: str, b: str, columns: list[str]) -> Column:
    match = F.lit(True)
    for c in columns:
        match = match & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return match


def _latest(rows: DataFrame, keys: list[str], version: list[str], order: list[str]) -> DataFrame:
    """The version of the last row, by ``order``, of each of ``keys``; partial before the shuffle."""
    last = F.max_by(F.struct(*version), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in version])


def _place(starts: list[datetime], seen: str) -> Column:
    """How many of the ascending ``starts`` lie before the time ``seen``: a tree of comparisons, or a search in Arrow batches."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        half = (low + high) // 2
        return F.when(F.col(seen) > F.lit(starts[half]), tree(half + 1, high)).otherwise(tree(low, half))

    if len(starts) <= TREE_RUNS:
        return tree(0, len(starts))
    ordered = np.array([int(s.replace(tzinfo=s.tzinfo or timezone.utc).timestamp() * 1_000_000 + 0.5) for s in starts], np.int64)

    @F.pandas_udf("int")
    def search(micros: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ordered, micros.to_numpy(np.int64), "left").astype(np.int32))

    return search(F.unix_micros(F.col(seen).cast("timestamp")))


def changes_by_run(
    sightings: DataFrame,
    runs: DataFrame,
    *,
    key: str,
    version: list[str],
    seen: str,
    tie: str,
    run: str = "run_id",
    started: str = "started_at",
    status: str = "status",
) -> DataFrame:
    """(run, key): for each run with status ``ok``, the keys that are new or changed since the ``ok`` run before.

    A key's state at a run is the version of its last sighting not after the run's start
    (equal times: the greater ``tie``). Null is a version value like others; sightings
    without a key or time, and runs without a start, count for nothing. Runs that failed leave
    no trace in the ledger, so the next good run covers their window too.

    All runs are replayed in one pass. A run that did not succeed is an open transaction until the next
    good run has begun. Every good run rereads the sightings from the start of the oldest transaction
    that was open at the good run before, and takes the last version of each key among them; those in the
    ledger, which has each key's version as the good runs before left it, are removed by an anti-join of
    key and version.
    """
    held = (
        runs.where(F.col(started).isNotNull()).select(started, run, F.coalesce(F.col(status) == "ok", F.lit(False)).alias("_ok")).distinct()
        .orderBy(started, run).limit(MOST_RUNS + 1).collect()
    )
    if len(held) > MOST_RUNS:
        raise ValueError(f"more than {MOST_RUNS} runs; replay them in parts")
    done = [r for r in held if r["_ok"]]
    starts = [r[0] for r in done]
    # the oldest transaction open at each good run: the first bad run since the good run before it, else the run itself
    open_since, oldest = [], None
    for r in held:
        if r["_ok"]:
            open_since.append(oldest or r[0])
            oldest = None
        else:
            oldest = oldest or r[0]
    schema = f"_run int, {run} {runs.schema[run].dataType.simpleString()}"
    ids = runs.sparkSession.createDataFrame([(i, r[1]) for i, r in enumerate(done)], schema)
    rows = (
        sightings.where(F.col(key).isNotNull() & F.col(seen).isNotNull())
        .withColumn("_first", _place(starts, seen))
        .where(F.col("_first") < len(done))
    )
    since = F.array(*[F.lit(t) for t in open_since]) if done else F.array().cast("array<timestamp>")
    again = (F.col("_first") + 1 < len(done)) & (F.col(seen) >= F.try_element_at(since, F.col("_first") + 1))
    windows = F.when(again, F.array("_first", F.col("_first") + 1)).otherwise(F.array("_first"))
    reread = rows.select(key, seen, tie, *[c for c in version if c not in (key, seen, tie)], F.explode(windows).alias("_run"))
    candidates = _latest(reread, [key, "_run"], version, [seen, tie])
    until = F.lead("_run").over(Window.partitionBy(key).orderBy("_run"))
    ledger = candidates.withColumn("_run", until).where(F.col("_run").isNotNull())
    fresh = candidates.alias("c").join(ledger.alias("l"), _same("c", "l", [key, "_run", *version]), "left_anti")
    return fresh.join(F.broadcast(ids), "_run").select(run, key)


class ChangeLedger:
    """The processed versions of a source's records, in a folder all executors share.

    ``arrived`` is the column with the time at which a row came into the source, by its transaction; rows are
    read by it, since a row may come in long after the time ``seen`` that it tells of. A record's state
    is its last row by ``seen`` and ``tie``.

    Each run has a folder of the (key, version) rows it processed and, once it succeeded, a
    marker. A folder without a marker counts for nothing and is written over when the run is
    tried again, so a failure neither skips nor repeats records. ``compact`` brings the runs so far
    into one base, which counts from its own marker on.
    """

    def __init__(self, spark: SparkSession, folder: str, *, key: str, version: list[str], seen: str, tie: str, arrived: str):
        self.spark, self.files = spark, Files(spark, folder)
        self.key, self.version, self.seen, self.tie, self.arrived = key, version, seen, tie, arrived
        self.order = [c for c in (seen, tie) if c not in version]

    def _markers(self, kind: str) -> list[dict[str, Any]]:
        names = [n for n in self.files.names(kind) if n.endswith(".json")]
        return sorted((json.loads(self.files.read(f"{kind}/{n}")) for n in names), key=lambda m: (m["upto"], m["run"]))

    def committed(self) -> list[dict[str, Any]]:
        """The markers of the runs that succeeded, oldest first."""
        return self._markers("committed")

    def _folders(self) -> list[str]:
        """What the ledger consists of: the last base and the runs that it doesn't hold."""
        bases = self._markers("bases")
        held = set(bases[-1]["holds"]) if bases else set()
        own = [f"bases/{bases[-1]['run']}"] if bases else []
        return own + [f"runs/{m['run']}" for m in self.committed() if m["run"] not in held]

    def processed(self) -> DataFrame | None:
        """The last processed version of each key, with its place in the order."""
        folders = self._folders()
        if not folders:
            return None
        rows = self.spark.read.parquet(*[self.files.at(f) for f in folders])
        return _latest(rows, [self.key], [*self.version, *self.order], [self.seen, self.tie])

    def pending(self, source: DataFrame, upto: datetime) -> DataFrame:
        """The latest rows, arrived not after ``upto``, of the keys that are new or changed: (key, version, seen, tie).

        Only rows that arrived from the oldest transaction open at the last successful run on are read. A
        row that comes in late and is older than what was processed of its key is no change.
        """
        rows = source.where((F.col(self.arrived) <= F.lit(upto)) & F.col(self.key).isNotNull() & F.col(self.seen).isNotNull())
        done = self.committed()
        if done:
            rows = rows.where(F.col(self.arrived) >= F.lit(datetime.fromisoformat(done[-1]["open_since"])))
        current = _latest(rows, [self.key], [*self.version, *self.order], [self.seen, self.tie])
        known = self.processed()
        if known is None:
            return current
        same = _same("c", "l", self.version)
        newer = F.struct(f"l.{self.seen}", f"l.{self.tie}") >= F.struct(f"c.{self.seen}", f"c.{self.tie}")
        return current.alias("c").join(known.alias("l"), _same("c", "l", [self.key]) & (same | newer), "left_anti")

    def commit(self, run: str, changes: DataFrame, upto: datetime, *, open_since: datetime | None) -> None:
        """Record ``changes`` as processed by ``run``.

        ``open_since`` is the start of the oldest transaction that was open at ``upto``; null says that
        none was. The same run can be committed again with the same result.
        """
        if self._held(run):
            return
        changes.write.mode("overwrite").parquet(self.files.at(f"runs/{run}"))
        marker = {"run": run, "upto": upto.isoformat(), "open_since": (open_since or upto).isoformat()}
        self.files.write(f"committed/{run}.json", json.dumps(marker))

    def _held(self, run: str) -> bool:
        return self.files.exists(f"committed/{run}.json")

    def compact(self) -> None:
        """Bring all runs so far into one base. The runs' rows are removed once the base counts; their markers stay."""
        done, known = self.committed(), self.processed()
        if known is None:
            return
        before = self._markers("bases")
        last = done[-1]
        name = f"{len(before):08d}"
        known.write.mode("overwrite").parquet(self.files.at(f"bases/{name}"))
        marker = {"run": name, "upto": last["upto"], "holds": [m["run"] for m in done]}
        self.files.write(f"bases/{name}.json", json.dumps(marker))
        for m in done:
            self.files.delete(f"runs/{m['run']}")
        for m in before:
            self.files.delete(f"bases/{m['run']}")
