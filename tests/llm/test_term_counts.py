import random
from collections import Counter

from affinity.llm.set_join import folded
from affinity.llm.term_counts import BurstTrie, Routes, adaptive_prefixes, marked_terms, term_counts

SCHEMA = "id bigint, terms array<string>, term string, prefix string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def brute(rows):
    rows = {(i, None if t is None else tuple(t)) for i, t in rows if i is not None}
    seen = Counter(x.strip().lower() for _, t in rows for x in t or () if x is not None)
    held = Counter(x for _, x in {(i, x.strip().lower()) for i, t in rows for x in t or () if x is not None})
    return {(t, n, held[t]) for t, n in seen.items()}


def run(spark, rows, **kw):
    return {tuple(r) for r in term_counts(frame(spark, rows), "id", "terms", folded, **kw).collect()}


def test_trie_bursts_and_keeps_all():
    rng = random.Random(1)
    trie, expected = BurstTrie(limit=8), Counter()
    for _ in range(5000):
        term = "".join(rng.choice("abÄ日") for _ in range(rng.randrange(0, 6)))
        trie.add(term, 2, 1)
        expected[term] += 1
    got = {p + s: (o, r) for p, suffixes, occ, rec in trie.subtrees() for s, o, r in zip(suffixes, occ, rec)}
    assert got == {t: (2 * n, n) for t, n in expected.items()} and len(list(trie.subtrees())) > 5


def test_trie_of_terms_behind_a_long_common_prefix():
    terms = ["a" * 1200 + f"{i:04}" for i in range(1100)] + ["a" * n for n in (0, 7, 1200, 1300)] + ["a" * 600 + "b" + "c" * 3000]
    trie, other = BurstTrie(limit=8), BurstTrie(limit=1024)
    for t in terms:
        trie.add(t, 1, 1)
        other.add(t, 2, 1)
    for part in other.subtrees():
        trie.merge(*part)
    got = {p + s: (o, r) for p, suffixes, occ, rec in trie.subtrees() for s, o, r in zip(suffixes, occ, rec)}
    assert got == {t: (3, 2) for t in terms}


def test_tries_of_different_shape_merge():
    rng = random.Random(5)
    for limits in ((2, 50), (50, 2), (3, 3)):
        merged, expected = BurstTrie(limits[0]), Counter()
        for _ in range(4):
            trie = BurstTrie(limits[1])
            for _ in range(400):
                term = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 9)))
                trie.add(term, 1, 1)
                expected[term] += 1
            for part in trie.subtrees():
                merged.merge(*part)
        got = [(p + s, o) for p, suffixes, occ, _ in merged.subtrees() for s, o in zip(suffixes, occ)]
        assert len(got) == len(expected) and dict(got) == expected


def test_prefixes_grow_where_terms_are():
    assert adaptive_prefixes([("ab", 10), ("ac", 3), ("b", 2)], 9) == ["", "a", "ab"]
    long = "x" * 100_000
    assert adaptive_prefixes([(long + "a", 6), (long + "b", 6), (long + "b", 6)], 9) == ["", long, long + "b"]
    routes = Routes(["", "a", "axx"])
    assert [routes.key(t) for t in ("", "b", "abc", "axy", "axxyz", "axx")] == ["", "b", "ab", "ax", "axxy", "axx"]
    assert [p for p in ("", "b", "a", "ax", "axx", "axxy", "ay") if routes.parts(p)] == ["", "a", "ax", "axx"]


def test_counts(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("note", "ri", "日本", "") for b in range(60)] + ["note", "note page", " Note "]
    rows = [(i, rng.choices(words, k=rng.randrange(0, 30)) + rng.choice([[], [None], ["NOTE"]])) for i in range(300)]
    rows += rows[:40] + [(5, ["note", "other"]), (5, ["note"]), (7, None), (8, []), (None, ["a"]), (900, ["x" * 20_000])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, burst=4, route_terms=10) == brute(rows)
    assert run(spark, rows, burst=4, route_terms=3, trie_terms=5, broadcast_ids=0) == brute(rows)
    behind = rows + [(1000 + i, ["y" * 1200 + str(i % 1100)]) for i in range(1500)]
    assert run(spark, behind, route_terms=10) == brute(behind)
    assert run(spark, []) == set()
    assert run(spark, [(1, None), (2, [])]) == set()


def test_marks(spark):
    df = spark.createDataFrame([("a", 9, 4), ("b", 2, 2), ("c d", 1, 1), ("e", 3, 3)], "term string, occurrences bigint, records bigint")
    assert {r.term: r.mark for r in marked_terms(df, 10, 0.4).collect()} == {"a": "common", "b": "rare", "c d": None, "e": None}
    assert {r.mark for r in marked_terms(df.limit(0), 0, 0.4).collect()} == set()
