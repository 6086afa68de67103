import random
from datetime import datetime, timedelta

import pytest

from affinity.operators.incremental import TREE_RUNS, ChangeLedger, changes_by_run
from affinity.sources.files import Files

T = datetime(2024, 1, 1)
SIGHT = "meta_id bigint, file_id bigint, mtime timestamp, size bigint, seen_at timestamp, run_id string"
RUNS = "run_id bigint, started_at timestamp, status string"
ARGS = {"key": "file_id", "version": ["mtime", "size"], "seen": "seen_at", "tie": "meta_id"}


def at(hours):
    return None if hours is None else T + timedelta(hours=hours)


def sightings(spark, rows):
    """(meta_id, file_id, mtime hour, size, seen hour); the run_id column only clashes."""
    return spark.createDataFrame([(m, f, at(a), s, at(b), "x") for m, f, a, s, b in rows], SIGHT)


def runs(spark, rows):
    return spark.createDataFrame([(i, at(h), s) for i, h, s in rows], RUNS)


def replay(spark, rows, run_rows):
    out = changes_by_run(sightings(spark, rows), runs(spark, run_rows), **ARGS)
    return sorted(tuple(r) for r in out.collect())


def brute(rows, run_rows):
    found, before = [], {}
    for h, i in sorted((h, i) for i, h, s in run_rows if s == "ok" and h is not None):
        state = {}
        for m, f, a, s, b in sorted((r for r in rows if r[4] is not None and r[1] is not None), key=lambda r: (r[4], r[0])):
            if b <= h:
                state[f] = (a, s)
        found += [(i, f) for f, v in state.items() if f not in before or before[f] != v]
        before = state
    return sorted(found)


CASES = [
    (1, 1, 0, 10, 1), (2, 1, 0, 10, 3),  # seen again without change
    (3, 2, 0, 5, 1), (4, 2, 2, 6, 4), (5, 2, 0, 5, 8),  # changed and changed back
    (6, 3, None, None, 2), (7, 3, None, 7, 6),  # null is a value
    (8, 4, 9, 1, 5), (9, 4, 3, 1, 5),  # equal times: the greater meta_id
    (10, 5, 1, 1, None), (11, None, 1, 1, 1), (12, 6, 1, 1, 99),
    (12, 6, 1, 1, 99), (3, 2, 0, 5, 1),  # repeated rows
]
RUN_CASES = [(1, 2, "ok"), (2, 3, "failed"), (3, 5, "ok"), (4, 5, "ok"), (5, None, "ok"), (6, 7, "aborted"), (7, 9, "ok")]


def test_replay_is_the_brute_force(spark):
    assert replay(spark, CASES, RUN_CASES) == brute(CASES, RUN_CASES)


def test_replay_of_nothing(spark):
    assert replay(spark, [], RUN_CASES) == []
    assert replay(spark, CASES, []) == []
    assert replay(spark, CASES, [(1, 2, "failed")]) == []


def test_replay_with_many_runs_and_random_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(12), rng.choice([None, 1, 2]), rng.choice([None, 5, 6]), rng.randrange(400)) for i in range(600)]
    for count in (60, TREE_RUNS + 40):
        run_rows = [(i, rng.randrange(420), rng.choice(["ok", "ok", "failed", "aborted", None])) for i in range(count)]
        assert replay(spark, rows, run_rows) == brute(rows, run_rows)


def arrivals(spark, rows):
    """(meta_id, file_id, mtime hour, size, seen hour, arrived hour)."""
    rows = [(m, f, at(a), s, at(b), at(c)) for m, f, a, s, b, c in rows]
    return spark.createDataFrame(rows, "meta_id bigint, file_id bigint, mtime timestamp, size bigint, seen_at timestamp, came timestamp")


LEDGER = ARGS | {"arrived": "came"}


def test_ledger_survives_failures_and_rereads_the_open_transactions(spark, tmp_path):
    first = arrivals(spark, [(1, 1, 0, 10, 1, 1), (2, 2, 0, 20, 2, 2)])
    ledger = ChangeLedger(spark, str(tmp_path / "ledger"), **LEDGER)
    new = ledger.pending(first, at(2))
    assert {r.file_id for r in new.collect()} == {1, 2}
    # a run that wrote its rows and failed before its marker leaves all of them pending
    new.write.parquet(str(tmp_path / "ledger/runs/r1"))
    assert {r.file_id for r in ledger.pending(first, at(2)).collect()} == {1, 2}
    ledger.commit("r1", new, at(2), open_since=at(1))
    assert ledger.pending(first, at(2)).isEmpty()
    # rows that come in after the first run, of a transaction open then, whenever they were seen
    late = first.unionByName(arrivals(spark, [(3, 3, 0, 30, 0.5, 1.5), (4, 2, 1, 21, 3, 3), (5, 1, 0, 10, 3, 3), (6, 4, 0, 40, 0.1, 3.5), (0, 1, 9, 99, 0.5, 3)]))
    pending = ledger.pending(late, at(4))
    assert {r.file_id for r in pending.collect()} == {2, 3, 4}
    ledger.commit("r2", pending, at(4), open_since=None)
    assert ledger.pending(late, at(4)).isEmpty()
    ledger.commit("r2", pending, at(4), open_since=None)
    assert len(ledger.committed()) == 2
    assert {r.file_id: r.size for r in ledger.processed().collect()} == {1: 10, 2: 21, 3: 30, 4: 40}


def test_ledger_survives_a_crash_at_any_step(spark, tmp_path, monkeypatch):
    rows = [(1, 1, 0, 10, 1, 1), (2, 2, 0, 20, 2, 2), (3, 1, 1, 11, 5, 5), (4, 3, 0, 30, 4, 4), (5, 2, 0, 20, 6, 6)]
    source = arrivals(spark, rows)
    want = [{1: 10, 2: 20}, {1: 11, 3: 30}]
    for crash in range(8):
        folder, left = str(tmp_path / f"crash{crash}"), [crash]

        def step(real):
            def run(*a, **k):
                left[0] -= 1
                if left[0] == -1:
                    raise OSError("crash")
                return real(*a, **k)

            return run

        with monkeypatch.context() as patch:
            patch.setattr(Files, "write", step(Files.write))
            patch.setattr(Files, "delete", step(Files.delete))
            got = []
            for upto, name in ((at(3), "a"), (at(7), "b")):
                for _ in range(3):  # until it succeeds
                    ledger = ChangeLedger(spark, folder, **LEDGER)
                    try:
                        new = ledger.pending(source, upto)
                        taken = {r.file_id: r.size for r in new.collect()}
                        ledger.commit(name, new, upto, open_since=None)
                        got += [taken] if taken or not got else []
                        ledger.compact()
                        break
                    except OSError:
                        continue
        assert got == want
        assert {r.file_id: r.size for r in ChangeLedger(spark, folder, **LEDGER).processed().collect()} == {1: 11, 2: 20, 3: 30}


def test_p5_over_its_table(spark):
    from affinity.queries.changes import SQL, p5_found

    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("file_metadata", "cache_runs"):
        con.sql(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    assert sorted(con.sql(SQL["p5_found"]).fetchall()) == sorted(tuple(r) for r in p5_found(spark, folder).collect())
