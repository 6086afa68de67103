import random
from fractions import Fraction
from math import ceil, floor

import pytest

from affinity.llm.mixture import Mixture, pfair, token_counts, units

PLAIN = "source string, target_share double, max_repeats int"


def documents(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, "x") for i, s, t in rows], "doc_id bigint, source string, text string, copy int, slot string")


def test_pfair_is_never_a_block_off():
    weights = {"a": Fraction(1, 2), "b": Fraction(1, 3), "c": Fraction(1, 7), "d": Fraction(1, 42)}
    placed = dict.fromkeys(weights, 0)
    for t, s in enumerate(pfair(weights, 500), 1):
        j = placed[s]
        assert floor(j / weights[s]) < t <= ceil((j + 1) / weights[s])
        placed[s] += 1
        assert all(abs(placed[x] - weights[x] * t) < 1 for x in weights)


def test_tokens_are_those_of_the_vocabulary(spark):
    df = documents(spark, [(1, "a", "the cat"), (2, "a", ""), (3, None, None), (1, "a", "the cat")])
    assert {(r.doc_id, r.tokens) for r in token_counts(df, "doc_id", "source", "text").collect()} == {(1, 2), (2, 0), (3, 0)}


@pytest.fixture
def corpus(spark):
    rows = [(i, "big", "the cat sat on the mat " * (i % 9 + 1)) for i in range(600)]
    rows += [(1000 + i, "mid", "a dog ran away " * (i % 5 + 1)) for i in range(60)]
    rows += [(2000 + i, "small", "one two three " * 4) for i in range(12)]
    rows += [(3000, "other", "not asked for"), (3001, None, "no source"), (None, "big", "no id"), (3002, "big", None), (3003, "big", "")]
    return documents(spark, rows + rows[:5])


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.1, 4), ("none", 0.1, 9), ("off", 0.0, 2), (None, 0.4, 1), ("nil", None, None)]


def test_shares_repeats_and_order(spark, corpus):
    mix = Mixture(corpus, spark.createDataFrame(TARGETS, PLAIN), block_tokens=16)
    rows = mix.rows().collect()
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and all(r.doc_id is not None for r in rows)
    total = sum(r.tokens for r in rows)
    for source, share, repeats in (("big", 5 / 9, 1), ("mid", 3 / 9, 3), ("small", 1 / 9, 4)):
        own = [r for r in rows if r.source == source]
        longest = max(r.tokens for r in own)
        assert abs(sum(r.tokens for r in own) - share * total) <= 2 * longest
        assert max(r.copy for r in own) < repeats
        starts = sorted((r.start, r.tokens) for r in own)
        assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    # at any place in the order, each source is at its weight but for a block and a document
    done = dict.fromkeys(mix.weights, 0)
    for r in sorted(rows, key=lambda r: (r.slot, r.start)):
        done[r.source] += r.tokens
        sofar = sum(done.values())
        assert all(abs(done[s] - float(w) * sofar) < 3 * (16 + 70) for s, w in mix.weights.items())
    assert rows == mix.rows().collect() or sorted(rows) == sorted(mix.rows().collect())
    shares = {r.source: r for r in mix.shares().collect()}
    assert set(shares) == {"big", "mid", "small", "none", "off", "nil"}
    assert shares["none"].actual_share == 0 and abs(shares["small"].actual_share - 1 / 9) < 0.02
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1)


def test_a_requested_total_and_empty_tables(spark, corpus):
    targets = spark.createDataFrame(TARGETS, PLAIN)
    small = Mixture(corpus, targets, total_tokens=400, block_tokens=16)
    assert abs(sum(r.tokens for r in small.rows().collect()) - 400) < 150
    assert Mixture(corpus.limit(0), targets).rows().collect() == []
    assert Mixture(corpus.limit(0), targets).shares().count() == 6
    assert Mixture(corpus, targets.limit(0)).rows().collect() == []


def test_every_block_has_a_slot_of_its_own_and_no_source_is_a_block_off():
    shares = {"a": Fraction(61, 100), "b": Fraction(30, 100), "c": Fraction(7, 100), "d": Fraction(2, 100)}
    for total in [*range(1, 4000, 97), 16 * 75, 16 * 3540 + 3]:
        mix = Mixture.__new__(Mixture)
        mix.targets, mix.block = {s: (w, 1) for s, w in shares.items()}, 16
        mix.plan(dict.fromkeys(shares, total), dict.fromkeys(shares, 1), total)
        slots = {(s, phase): slot for s, phase, slot in mix.schedule()}
        placed = {
            (s, j): slots[s, j % mix.units[s]] + j // mix.units[s] * mix.period for s, n in mix.budget.items() for j in range(ceil(n / 16))
        }
        assert len(set(placed.values())) == len(placed)
        for (s, j), slot in placed.items():
            assert floor(j / shares[s]) <= slot < ceil((j + 1) / shares[s])


def test_units_are_exact_or_rounded_to_the_most():
    assert units({"a": Fraction("0.18"), "b": Fraction("0.12")}) == {"a": 3, "b": 2}
    assert units({"a": Fraction(1, 3), "b": Fraction(2, 3), "c": Fraction(1, 10**12)}, 1000) == {"a": 333, "b": 667, "c": 1}
    assert units({}) == {}


def test_random_weights_reach_their_budgets(spark):
    rng = random.Random(3)
    for lane in (7, 1000):
        names = [f"s{i}" for i in range(9)]
        rows = [(i, rng.choice(names), "the " * rng.randrange(1, 40)) for i in range(900)]
        targets = [(s, rng.random(), rng.randrange(1, 5)) for s in names]
        mix = Mixture(documents(spark, rows), spark.createDataFrame(targets, PLAIN), block_tokens=16, lane_documents=lane)
        reached = {r.source: r.tokens for r in mix.shares().collect()}
        assert all(abs(reached[s] - mix.budget[s]) <= 40 for s in names) and mix.total > 1000


def test_no_use_is_lost_between_uses_and_slots(spark):
    rows = [(i, "big", "the") for i in range(2000)] + [(5000 + i, "small", "the") for i in range(60)]
    targets = spark.createDataFrame([("big", 0.98, 1), ("small", 0.02, 1)], PLAIN)
    for total in (75, 1200, 1000):
        mix = Mixture(documents(spark, rows), targets, total_tokens=total, block_tokens=16)
        reached = {r.source: r.tokens for r in mix.shares().collect()}
        assert reached == mix.budget and sum(mix.budget.values()) >= total - 1
