import random

from affinity.llm.top_n import best_scores, top_n, top_n_without

SCHEMA = "q bigint, file string, s double, score string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(q, f, s, "x", 1) for q, f, s in rows], SCHEMA)


def brute(rows, n, own=()):
    best = {}
    for q, f, s in rows:
        if q is not None and f is not None and s is not None and 0 < s <= 1 and (q, f) not in own:
            best[q, f] = max(s, best.get((q, f), 0))
    out = []
    for g in {q for q, _ in best}:
        out += sorted(((g, f, s) for (q, f), s in best.items() if q == g), key=lambda r: (-r[2], r[1]))[:n]
    return sorted(out)


def test_ties_duplicates_and_invalid_scores(spark):
    rng = random.Random(3)
    scores = [None, float("nan"), float("inf"), 0.0, -0.0, -1.0, 1.5, 1.0, 0.25, 0.25, 0.5]
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["ä", "Z", "z", "a", "日", "😀", None]), rng.choice(scores)) for _ in range(400)]
    best = best_scores(frame(spark, rows), "q", "file", "s")
    for n in (1, 3, 50):
        got = sorted((r.group, r.item, r.score) for r in top_n(best, n).collect())
        assert got == brute(rows, n)
    assert top_n(best, 0).collect() == []
    own = {(1, "z"), (2, "a"), (9, "x")}
    excluded = spark.createDataFrame([*own, *own, (None, "a"), (1, None)], "group bigint, item string")
    got = sorted((r.group, r.item, r.score) for r in top_n_without(best, 3, excluded).collect())
    assert got == brute(rows, 3, own)
    assert top_n_without(best.limit(0), 3, excluded.limit(0)).collect() == []


def test_each_row_has_its_own_limit(spark):
    df = spark.createDataFrame([(g, f"f{i}", i / 10, n) for g, n in ((1, 2), (2, 0), (3, None)) for i in range(1, 6)], "group int, item string, score double, n int")
    assert sorted((r.group, r.item) for r in top_n(df, 5, limit="n").collect()) == [(1, "f4"), (1, "f5")]


def test_groups_are_cut_before_the_shuffle(spark):
    df = frame(spark, [(1, "a", 0.5)])
    plan = top_n(best_scores(df, "q", "file", "s"), 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
