import random

import numpy as np

from affinity.llm.leakage import CHUNK, Prints, WindowSums, leaked_items, window_sizes, word_bits, words

RNG = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(300)]


def text(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def brute(docs, items, window=13):
    def grams(t):
        w = words(t or "")
        return {tuple(w[i : i + window]) for i in range(len(w) - window + 1)}

    owned = [(i, grams(t)) for i, t in items if i is not None]
    return {(d, i) for d, t in docs if d is not None for own in [grams(t)] for i, g in owned if own & g}


def rows(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, item_id int")
    e = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    return {(r.doc_id, r.item_id): r for r in leaked_items(d, e, **kw).collect()}


def run(spark, docs, items, **kw):
    return {k for k, r in rows(spark, docs, items, **kw).items() if r.run >= kw.get("passage", 13)}


def test_form_makes_no_difference():
    plain = "neither rimorvape nor the clerk of café could date it"
    assert words(plain) == words("> Neither  RIMORVAPE nor _the_\n**clerk** of Café <em>could</em> da­te it!")
    assert words(plain) == words("Ｎｅｉｔｈｅｒ rimorvаpe nor the clerk of café could<br>date it")


def test_fingerprint_is_the_majority_of_its_words():
    codes = np.random.default_rng(2).integers(0, 2**63, 700).astype(np.uint64)
    bits, sums = word_bits(codes), WindowSums(codes)
    for window in (5, 13, 14, 40, 255, 256, 600, 700):
        slow = [np.packbits(bits[i : i + window].astype(int).sum(0) > window // 2).view(np.uint64)[0] for i in range(700 - window + 1)]
        assert sums.fingerprints(window).tolist() == slow
        assert sums.fingerprints(window, 3).tolist() == slow[::3]
    assert len(WindowSums(codes[:4]).fingerprints(5)) == 0


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    held = rng.integers(0, 2**63, 900).astype(np.uint64)
    for radius in (0, 2, 4):
        probes = held[rng.integers(0, len(held), 400)].copy()
        for i in range(len(probes)):
            for bit in rng.choice(64, i % 7, replace=False):
                probes[i] ^= np.uint64(1) << np.uint64(bit)
        expected = {(i, j) for i, p in enumerate(probes) for j, q in enumerate(held) if int(p ^ q).bit_count() <= radius}
        assert set(zip(*(x.tolist() for x in Prints(held, radius).near(probes)))) == expected


def test_a_copy_of_an_item_holds_a_window_at_every_place():
    for window, step in window_sizes(13, 200):
        for length in (window + step - 1, window + step + 9):
            for at in range(40):
                assert any(p % step == 0 and p + window <= at + length for p in range(at, at + length))


def test_changed_copies_are_found(spark):
    """Near copies, those of a weighted similarity of 0.8 of five-word shingles: recall at least 0.9."""
    items = [(i, text(n)) for i, n in enumerate([50, 60, 80, 100, 140] * 8)]
    docs = []
    for i, t in items:
        own = t.split()
        for at in RNG.sample(range(len(own)), max(1, len(own) // 70)):
            own[at] = "changed"
        docs.append((i, f"{text(30)} {' '.join(own)} {text(5)}"))
    found = rows(spark, docs, items)
    assert sum((i, i) in found for i, _ in items) >= 0.9 * len(items)
    whole = rows(spark, [(0, items[3][1]), (1, text(300))], items)
    assert set(whole) == {(0, 3)} and whole[0, 3].run == 100 and whole[0, 3].similarity == 1 and whole[0, 3].first_word == 0


def test_changes_at_every_few_words_leave_no_run_but_a_near_window(spark):
    """Found by windows of the item's size alone."""
    items = [(i, text(48)) for i in range(30)]
    docs = []
    for i, t in items:
        own = t.split()
        for at in (10, 20, 30, 40):
            own[at] = "changed"
        docs.append((i, " ".join(own)))
    found = rows(spark, docs, items, least=0.3, radius=12)
    assert sum((i, i) in found for i, _ in items) >= 27 and all(r.run == 0 for r in found.values())
    assert all(i == j for i, j in found)


def test_runs_across_pieces(spark):
    items = [(1, text(60))]
    for lead in (CHUNK - 70, CHUNK - 30, CHUNK, 2 * CHUNK - 5):
        found = rows(spark, [(5, text(lead) + " " + items[0][1] + " " + text(40))], items)
        assert found[5, 1].run >= 60 and found[5, 1].first_word in (lead, lead - 1) and found[5, 1].similarity > 0.9


def test_leaks_equal_the_brute_force(spark):
    items = [(i, text(RNG.randrange(5, 60))) for i in range(40)] + [(99, None), (98, ""), (None, text(30)), (0, text(50))]
    docs = [(i, text(RNG.randrange(0, 80))) for i in range(150)]
    for d in range(200, 320):
        own = RNG.choice([t for i, t in items if t and i is not None]).split()
        cut = RNG.randrange(8, 20)
        at = RNG.randrange(0, max(1, len(own) - cut))
        docs.append((d, f"{text(20)}. {' '.join(own[at : at + cut]).upper()} {text(9)}"))
    docs += [(400, None), (401, ""), (None, items[0][1]), docs[-1], (402, text(90_000) + " " + items[1][1])]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, block_words=200) == brute(docs, items)
    assert run(spark, [], items) == set() and run(spark, docs, []) == set()
