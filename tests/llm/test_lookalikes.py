import unicodedata

from affinity.llm.lookalikes import UnionFind, both_letters, consistent_text, look_alike_pairs, rewriter, rewriting, rewriting_tables, string_rewriting

SCHEMA = "note_id bigint, text string, id string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA)


def pairs(spark, rows, **kw):
    return sorted(tuple(r) for r in look_alike_pairs(frame(spark, rows), "note_id", "text", **kw).collect())


def test_union_find_is_transitive():
    u = UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("fi", "ﬁ")):
        u.union(a, b)
    assert u.find("a") == u.find("d") != u.find("fi") == u.find("ﬁ")


def test_what_looks_the_same_becomes_one():
    same = ["Café fine", "Café fine", "Ｃａｆé ﬁne", "Саfé fine", "Ca​fé fi­ne", "Cafе́ fіne"]
    rewrite = rewriter(rewriting({c: same[0].count(c) + 1 for t in same for c in t}))
    assert {rewrite(t) for t in same} == {"Café fine"}


def test_representative_is_the_most_frequent():
    table = rewriting({"а": 9, "a": 1})
    assert table["a"] == "а" and "а" not in table


def test_visible_differences_stay():
    texts = ["Cafe", "Café", "cafe", "Cafe!", "Cafe.", "Cafe1", "Cafel", "CafeI", "Ca fe", "Ca  fe", "Ca\nfe", "Cafè"]
    rewrite = rewriter(rewriting({c: 1 for t in texts for c in t}))
    assert len({rewrite(t) for t in texts}) == len(texts)


def test_half_width_and_voiced_kana():
    rewrite = rewriter(rewriting({c: 1 for c in "ガｶﾞガ"}))
    assert {rewrite("ガ"), rewrite("ｶﾞ"), rewrite("ガ")} == {"ガ"}


def test_pairs(spark):
    rows = [(1, "abc"), (2, "аbc"), (3, "abc"), (3, "abc"), (4, "ABC"), (5, None), (6, ""), (7, "​"), (8, "﻿"), (None, "abｃ"), (9, "x" * 100_000), (10, "х" + "x" * 99_999)]
    assert pairs(spark, rows) == [(1, 2), (2, 3), (9, 10)]
    assert pairs(spark, []) == []


def test_a_large_group_gives_each_record_a_pair(spark):
    rows = [(i, "abc") for i in range(1, 21)] + [(i, "аbc") for i in range(21, 31)]
    found = pairs(spark, rows, expand_limit=5)
    assert {x for p in found for x in p} == set(range(1, 31)) and len(found) <= 30
    assert len(pairs(spark, rows)) == 200


def test_consistent_text_keeps_nulls_and_all_rows(spark):
    got = {r.id: r.text for r in consistent_text(frame(spark, [(1, None), (2, ""), (3, "ａ b"), (4, "a b")]), "note_id", "text").collect()}
    assert got == {1: None, 2: "", 3: "a b", 4: "a b"}
    assert all(t is None or unicodedata.is_normalized("NFC", t) for t in got.values())


def test_a_large_group_gives_all_pairs_of_different_texts(spark):
    strings = ["abc", "аbc", "abс"]
    rows = [(i, strings[i % 3]) for i in range(1200)]
    wanted = {(a, b) for a, s in rows for b, t in rows if a < b and s != t}
    found = pairs(spark, rows)
    assert len(found) == len(wanted) == 480_000 and set(found) == wanted
    assert set(pairs(spark, rows[:60], block=7)) == {(a, b) for a, b in wanted if b < 60}


def test_letters_that_are_two_meet_the_string_of_both(spark):
    assert ("ꝏ", "oo") in both_letters() and "æ" not in dict(both_letters())
    assert pairs(spark, [(1, "book"), (2, "bꝏk"), (3, "bооk"), (4, "bok")]) == [(1, 2), (1, 3), (2, 3)]
    # where the letter is more frequent, the string of two characters is what the automaton rewrites
    rows = [(i, "ꝏ " * 9) for i in range(5)] + [(9, "book"), (10, "ооk")]
    step = rewriting_tables(frame(spark, rows), "text")[1]
    assert step == {"oo": "ꝏ"} and rewriter(step)("book") == "bꝏk"
    assert (9, 11) in pairs(spark, [*rows, (11, "bꝏk")])


def test_near_shapes_only_where_asked_for(spark):
    rows = [(1, "the market"), (2, "the rnarket"), (3, "the mαrкet"), (4, "the mаrket"), (5, "ın vvar"), (6, "in war"), (7, "the narket")]
    assert pairs(spark, rows) == [(1, 4)]
    assert pairs(spark, rows, near=True) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 6)]


def test_classes_of_strings_are_transitive():
    assert string_rewriting([("m", "rn"), ("rn", "гn")], {}, {"m": 5, "rn": 2}) == {"rn": "m", "гn": "m"}
