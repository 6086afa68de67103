import random

from pyspark.sql import functions as F

from affinity.llm.language import held_languages, label_code, labelled_sample, languages, train

# Enough plain sentences of each language to make small dictionaries.
PARTS = {
    "en": (["the weekly review", "the old archive", "this draft", "the reading list"], ["repeats", "explains", "hides"], ["the reason for the delay", "the water readings", "three open questions"], ["at the end of the quarter", "in the evening", "near the top of the page"]),
    "de": (["der Entwurf", "das alte Archiv", "die Leseliste", "der Reiseplan"], ["ergänzt", "verbirgt", "wiederholt"], ["den Grund der Verspätung", "drei offene Fragen", "die Kosten für neue Regale"], ["am Ende des Quartals", "oben auf der Seite", "am Abend"]),
    "fr": (["le brouillon", "la note du jour", "le vieux dossier", "la liste de lecture"], ["cache", "explique", "répète"], ["la raison du retard", "trois questions ouvertes", "le chemin du col"], ["à la fin du trimestre", "en haut de la page", "le soir"]),
    "ja": (["古いアーカイブは", "会議のまとめは", "研究の問いは"], ["実験の結果を", "章の順番を", "三つの疑問を"], ["カレンダーの横で", "ページの上の方で"], ["くり返している", "補っている", "比べている"]),
}


def sentence(rng, lang):
    parts = [rng.choice(p) for p in PARTS[lang]]
    return "".join(parts) + "。" if lang == "ja" else " ".join(parts).capitalize() + "."


def text(rng, lang, n):
    return " ".join(sentence(rng, lang) for _ in range(n))


def labelled(seed, docs=40, wrong=0.08):
    rng = random.Random(seed)
    rows = []
    for lang in PARTS:
        for _ in range(docs):
            label = rng.choice(list(PARTS)) if rng.random() < wrong else lang
            rows.append((label, text(rng, lang, rng.randrange(1, 12))))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, n, 1) for i, t, n in rows], "doc_id bigint, text string, lang string, id int")


def test_held_out_accuracy_with_wrong_labels():
    judge = train(labelled(1))
    rng = random.Random(2)
    lines = [(lang, sentence(rng, lang)) for lang in PARTS for _ in range(150)]
    from affinity.llm.language import plain

    right = sum(judge.line(plain(s))[0] == lang for lang, s in lines)
    assert right / len(lines) > 0.97
    assert judge.line(plain("Vazoke ludeka mofitru nabesa zolune"))[0] is None


def test_labels(spark):
    known = ["en", "EN", "en-US", "en_GB", "eng", "English", " german ", "pt-BR", "日本語", "und", "??", "", "n/a", None]
    rows = spark.createDataFrame([(x,) for x in known], "label string").select(label_code(F.col("label"))).collect()
    assert [r[0] for r in rows] == ["en"] * 6 + ["de", "pt", "ja"] + [None] * 5


def test_documents_and_segments(spark):
    rng = random.Random(3)
    judge = train(labelled(4))
    mixed = text(rng, "en", 6) + "\n---\n" + text(rng, "ja", 6) + " / " + text(rng, "de", 4)
    rows = [
        (1, text(rng, "de", 3).upper(), None), (2, mixed, "en"), (3, text(rng, "en", 5) + " « le chemin du col »", "en"), (4, None, "en"), (5, "", "en"),
        (6, '{"bekellu": 96, "vemani": []}', "en"), (7, "36;2358\n62;2918", "en"), (8, "---\nid: 4\n---\n" + text(rng, "fr", 3), "fr"),
        (9, "```\nthe weekly review repeats the reason for the delay\n```", "en"), (10, text(rng, "fr", 3000), "fr"),
        (8, "---\nid: 4\n---\n" + text(random.Random(9), "fr", 3), "fr"),
    ]
    judged = languages(frame(spark, rows), "doc_id", "text", judge, keep=["lang"])
    held = {r.id: [h.lang for h in r.held] for r in held_languages(judged).collect()}
    assert held == {1: ["de"], 2: held[2], 3: ["en"], 4: [], 5: [], 6: [], 7: [], 8: ["fr"], 9: [], 10: ["fr"]}
    assert set(held[2]) == {"en", "ja", "de"}
    segments = next(r.segments for r in judged.collect() if r.id == 2)
    assert [s.lang for s in segments] == ["en", "ja", "de"] and all(0 < s.confidence <= 1 for s in segments)
    assert "アーカイブ" not in mixed[segments[0].start : segments[0].end] and segments[2].end == len(mixed)
    assert languages(frame(spark, []), "doc_id", "text", judge).collect() == []


def test_the_sample_is_bounded_and_deterministic(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(labelled(5, docs=10))] + [(900, None, "en"), (901, "", "en"), (902, "text", "und")]
    df = frame(spark, rows)
    taken = labelled_sample(df, "text", "lang", docs=4)
    assert len(taken) == 16 and taken == labelled_sample(df.repartition(3), "text", "lang", docs=4)
    assert train([]).texts == {} and train([]).line("some text here") == (None, 0.0)


def test_the_neighbours_dictionary_is_enough_only_where_it_does_better_than_on_other_languages():
    judge = train(labelled(6))
    rng = random.Random(7)
    assert set(judge.floors) == set(PARTS) and judge.floors["ja"] == 1.0
    from affinity.llm.language import plain

    for lang in PARTS:
        for guess in (*PARTS, None, "xx"):
            lines = [plain(sentence(rng, lang)) for _ in range(40)]
            assert sum(judge.line(x, guess)[0] == lang for x in lines) >= 39
            assert all(0 <= judge.line(x, guess)[1] <= 1 for x in lines)


def test_noise_inside_words_makes_no_difference():
    from affinity.llm.language import plain, sentences

    assert plain("**The**  week\xadly\t_review_ a12b 77 – É") == "the weekly review – e"
    assert [(x[2], x[3]) for x in sentences("3) the weekly 2024 review / der alte Entwurf! x1 y2. ok")] == [("the weekly review", 3), ("der alte entwurf!", 3)]


def test_sifting_leaves_out_what_speaks_for_another_label():
    from affinity.llm.language import sifted

    docs = [("a", ["one two", "one three"])] * 5 + [("b", ["four five", "four six"])] * 5 + [("a", ["four five", ""]), ("c", [])]
    assert sifted(docs)[-2:] == [("a", []), ("c", [])] and sifted(docs)[0] == docs[0] and sifted([]) == []
