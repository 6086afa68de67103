import random
from fractions import Fraction
from itertools import combinations

from affinity.llm.set_join import divide_skip, folded, large_classes, similar_pairs

SCHEMA = "id bigint, vals array<string>, key string, tokens string, side int"


def frame(spark, rows):
    """The columns after the second have names that the operator uses itself."""
    return spark.createDataFrame([(i, v, "k", "t", 7) for i, v in rows], SCHEMA)


def clean(values):
    return {v.strip().lower() for v in values or () if v is not None}


def brute(rows, threshold, least=1):
    found, ratio = set(), Fraction(str(threshold))
    sets = {(i, frozenset(clean(v))) for i, v in rows if i is not None}
    for (i, a), (j, b) in combinations(sets, 2):
        if i != j and min(len(a), len(b)) >= least and a and len(a & b) >= ratio * len(a | b):
            found.add((min(i, j), max(i, j)))
    return found


def run(spark, rows, threshold, **kw):
    out = similar_pairs(frame(spark, rows), "id", "vals", threshold, normalize=folded, **kw)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def families(seed, n, common=6):
    """Records of near copies, with a few terms in very many of them."""
    rng = random.Random(seed)
    rows, i = [], 0
    while len(rows) < n:
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 25))]
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            i += 1
            own = [w if rng.random() > 0.12 else f"x{rng.randrange(10**6)}" for w in base]
            own += rng.sample([f"c{k}" for k in range(common)], rng.randrange(common))
            rng.shuffle(own)
            rows.append((i, [rng.choice([w, w.upper(), f" {w} "]) for w in own] + rng.choice([[], [None], own[:2]])))
    return rows


def test_divide_skip_counts_lists():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randrange(1, 50))) for _ in range(rng.randrange(1, 12))]
        least = rng.randrange(1, len(lists) + 1)
        expected = {x: c for x in range(60) if (c := sum(x in y for y in lists)) >= least}
        assert dict(divide_skip(lists, [0] * len(lists), least)) == expected


def test_all_pairs_are_found(spark):
    for seed, threshold in ((1, 0.6), (2, 0.5), (3, 0.85), (4, 1)):
        rows = families(seed, 250)
        assert run(spark, rows, threshold) == brute(rows, threshold)
        assert run(spark, rows, threshold, min_values=5) == brute(rows, threshold, 5)


def test_frequent_values_are_split_into_blocks(spark):
    rows = families(5, 300, common=8)
    assert run(spark, rows, 0.5, bucket_rows=7, frequent_least=20) == brute(rows, 0.5)


def test_sets_of_frequent_values_alone(spark):
    rng = random.Random(6)
    words = [f"c{i}" for i in range(12)]
    rows = [(i, rng.sample(words, 6) + [f"u{i}", f"z{i}"][: i % 3]) for i in range(1, 400)]
    assert run(spark, rows, 0.6, bucket_rows=30, frequent_least=40) == brute(rows, 0.6)


def test_odd_records(spark):
    rows = [
        (1, None), (2, []), (3, [None]), (4, ["a"]), (5, ["a", "a", None]), (6, ["A "]), (6, ["A "]),
        (7, [""]), (8, [" "]), (None, ["a"]), (9, [f"t{i}" for i in range(5000)]), (10, [f"t{i}" for i in range(4000)]),
    ]
    assert run(spark, rows, 0.6) == {(4, 5), (4, 6), (5, 6), (7, 8), (9, 10)}
    assert run(spark, [], 0.6) == set()


def test_a_large_class_is_given_by_its_representative(spark):
    rows = [(i, ["a", "b", "c"]) for i in range(1, 31)] + [(40, ["a", "b", "c", "d"])]
    assert run(spark, rows, 0.7, expand_limit=10) == {(1, i) for i in range(2, 31)} | {(1, 40)}
    assert len(run(spark, rows, 0.7)) == 30 * 29 // 2 + 30


def test_between_two_tables(spark):
    left = [(1, ["a", "b", "c"]), (2, ["a", "b", "c"]), (3, ["x"])]
    right = [(1, ["a", "b", "c"]), (9, ["a", "b", "c", "d"]), (3, ["y"])]
    out = similar_pairs(frame(spark, left), "id", "vals", 0.7, right=frame(spark, right))
    assert {tuple(r) for r in out.collect()} == {(1, 1), (2, 1), (1, 9), (2, 9)}


def covered(spark, left, right, threshold, limit):
    """All pairs that follow from the pairs given and the classes above the limit."""
    kw = {"right": None if right is None else frame(spark, right), "normalize": folded, "expand_limit": limit}
    given = {tuple(r) for r in similar_pairs(frame(spark, left), "id", "vals", threshold, **kw).collect()}
    reps = {(r.side, r.id): r.rep for r in large_classes(frame(spark, left), "id", "vals", **kw).collect()}
    sets = {(s, i): frozenset(clean(v)) for s, rows in enumerate((left, right or [])) for i, v in rows}
    out = set()
    for a, b in combinations(sorted(sets), 2):
        if right is not None and a[0] == b[0] or not sets[a]:
            continue
        if sets[a] == sets[b] and a in reps:  # both have the class's representatives
            ra, rb = (reps[a], reps[b]) if right is not None else (reps[a],) * 2
            if ra != a[1] or rb != b[1] or right is not None:
                assert right is not None and {(a[1], rb), (ra, b[1])} <= given or right is None and {tuple(sorted((x[1], ra))) for x in (a, b) if x[1] != ra} <= given
            out.add((a[1], b[1]))
        elif tuple(sorted(p) if right is None else p) in given if (p := (reps.get(a, a[1]), reps.get(b, b[1]))) else False:
            out.add((a[1], b[1]))
    return out


def test_no_link_is_lost_to_large_classes(spark):
    rng = random.Random(8)
    bases = [[f"w{rng.randrange(40)}" for _ in range(8)] for _ in range(6)]
    for seed in range(2):
        rng = random.Random(seed)
        sides = []
        for side in (0, 1):
            rows = []
            for i in range(60):
                own = list(rng.choice(bases))
                if rng.random() < 0.3:
                    own[rng.randrange(8)] = f"x{rng.randrange(5)}"
                rows.append((100 * side + i, own))
            sides.append(rows)
        sides[0] += [(70 + i, ["l", "m", "n", "o"]) for i in range(5)]  # a class on one side only
        sides[1] += [(170 + i, ["l", "m", "n", "o", "p"]) for i in range(5)]
        want = {(i, j) for i, a in sides[0] for j, b in sides[1] if len(clean(a) & clean(b)) >= 0.6 * len(clean(a) | clean(b))}
        assert covered(spark, *sides, 0.6, 3) == want
        assert covered(spark, sides[0], None, 0.6, 3) == brute(sides[0], 0.6)


def test_values_below_the_frequent_share_are_split_too(spark):
    rows = families(9, 300, common=8)
    assert run(spark, rows, 0.5, bucket_rows=7, frequent_least=10**9) == brute(rows, 0.5)
    rng = random.Random(10)
    half = [(i, [f"v{i}", f"w{i}", "half", f"r{rng.randrange(30)}"][: 3 + i % 2] if i % 2 else [f"a{i}", f"b{rng.randrange(9)}", "z"]) for i in range(200)]
    assert run(spark, half, 0.3, bucket_rows=10, frequent_least=10**9) == brute(half, 0.3)


def test_whole_numbers_are_their_own_tokens(spark):
    rows = [(1, [0, 4294967295, 5]), (2, [0, 4294967295, 5, 5]), (3, [0, 4294967295, 6]), (4, None)]
    df = spark.createDataFrame(rows, "id bigint, vals array<bigint>")
    assert {tuple(r) for r in similar_pairs(df, "id", "vals", 0.5).collect()} == {(1, 2), (1, 3), (2, 3)}
