import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinity.config import COMPAT, DEFAULT, EngineConfig
from affinity.functions import bloom
from affinity.functions.hashing import hash_matrix, hashes
from affinity.operators import links, postings, similarity
from affinity.operators.bitmap import bit_words, build_filters, term_bits
from affinity.operators.order import running_averages, with_sequence
from affinity.plans.related import RelatedEngine
from affinity.sources import store
from affinity.sources.corpus import folder_corpus
from affinity.streaming.updates import LiveIndex

CORPUS = "doc_id bigint, path string, title string, text string, mtime timestamp"
PLAIN = EngineConfig(adaptive_stopwords=False)
TEXTS = {
    1: "artificial intelligence machine learning neural networks deep learning models",
    2: "machine learning algorithms neural networks training data models",
    3: "natural language processing machine learning text analysis",
    4: "database systems transactions storage engine indexes queries",
    5: "", 6: None, 7: "ab", 8: "artificial intelligence machine learning neural networks deep learning models",
}


def corpus(spark, texts=TEXTS):
    rows = [(i, f"v/n{i}.md", f"n{i}", t, datetime(2024, 10, 1) + timedelta(days=i)) for i, t in texts.items()]
    return spark.createDataFrame(rows, CORPUS)


def terms(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "doc_id bigint, terms array<string>")


def test_hashes_in_both_forms(spark):
    words = ["", "test", "machine learn", "日本", "😀", "a😀b", "x" * 500, "é"]
    known = {"test": [2949673445, 2090756197, 1195757874], "😀": [3409036472, 7743522, 3631420675], "": [2166136261, 5381, 0]}
    got = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", hashes(F.col("w"), 5).alias("h")).collect()}
    whole = hash_matrix(words, 5)
    for i, w in enumerate(words):
        assert got[w] == whole[i].tolist()
        assert w not in known or got[w][:3] == known[w]
    assert hash_matrix([], 3).shape == (0, 3)


def test_filters_equal_the_row_form_and_have_no_false_negatives(spark):
    rng = random.Random(1)
    lists = [[f"item{rng.randrange(500)}" for _ in range(n)] for n in (0, 1, 5, 40, 300)] + [None]
    df = terms(spark, lists)
    built = build_filters(df, 1024, 3)
    slow = {(r.doc_id, r.word_idx): r.word for r in bit_words(term_bits(df, 1024, 3)).collect()}
    for r in built.collect():
        assert {(r.doc_id, i): w for i, w in enumerate(r.words) if w} == {k: v for k, v in slow.items() if k[0] == r.doc_id}
        assert r.popcount == sum(bin(w & (2**64 - 1)).count("1") for w in r.words)
    own = df.select("doc_id", F.explode("terms").alias("t")).join(built, "doc_id")
    hit = bloom.contains(F.col("words"), F.transform(hashes(F.col("t"), 3), lambda h: h % 1024))
    assert own.where(~hit).count() == 0
    assert sorted(built.collect()) == sorted(build_filters(df.repartition(5), 1024, 3).collect())
    with pytest.raises(ValueError):
        build_filters(df, 100, 3)


def test_scores_are_sound(spark):
    lists = [[f"w{i}" for i in range(n)] for n in (100, 400, 800, 1600, 3200)]
    lists += [[f"w{i}" for i in range(n)] for n in (100, 400, 800, 1600, 3200)]
    lists += [[f"z{i}" for i in range(12)], ["a"], []]
    lists += ["flour butter sugar oven dough bread yeast knead salt bake water crust loaf proof".split()]
    filters = build_filters(terms(spark, lists), 4096, 3)
    pairs = spark.createDataFrame([(i, i + 5) for i in range(5)] + [(13, 10), (0, 11), (0, 12), (0, 99)], "id_a bigint, id_b bigint")
    got = {(r.id_a, r.id_b): r.similarity for r in similarity.pair_scores(filters, pairs).collect()}
    assert all(got[i, i + 5] > 0.95 for i in range(4)) and all(0 <= s <= 1 for s in got.values())
    assert got[10, 13] < 0.1 and got[0, 11] == got[0, 12] == got[0, 99] == 0
    full = build_filters(terms(spark, [[f"w{i}" for i in range(5000)]] * 2), 64, 3)
    both = similarity.pair_scores(full, spark.createDataFrame([(0, 1)], "id_a bigint, id_b bigint"))
    assert both.first().similarity == 0
    mixed = filters.unionByName(build_filters(terms(spark, lists[:1]).select((F.col("doc_id") + 50).alias("doc_id"), "terms"), 2048, 3))
    assert similarity.pair_scores(mixed, spark.createDataFrame([(0, 50)], "id_a bigint, id_b bigint")).first().similarity == 0


def test_array_estimates_equal_the_column(spark):
    a, b = np.array([3.0, 30, 200, 256, 90]), np.array([30.0, 30, 200, 256, 80])
    both = np.array([1.0, 30, 190, 256, 0])
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), both.tolist())), "a double, b double, c double")
    got = [r[0] for r in df.select(bloom.jaccard(F.col("a"), F.col("b"), F.col("c"), F.lit(256), F.lit(3))).collect()]
    assert np.allclose(got, similarity.estimates(a, b, both, 256, 3))


def test_engine(spark):
    own = RelatedEngine(corpus(spark), PLAIN, now=datetime(2024, 10, 20))
    found = [(r.doc_id, r.path) for r in own.related(1).collect()]
    assert found[0] == (8, "v/n8.md") and [d for d, _ in found[1:3]] == [2, 3] and 1 not in dict(found)
    assert own.similarity(1, 8) == 1.0 and own.similarity(1, 99) == 0.0 and own.similarity(2, 1) == own.similarity(1, 2) > own.similarity(1, 3)
    assert own.similarity(1, 4) < 0.1
    assert own.is_indexed(5) and not own.is_indexed(99) and own.related(99).collect() == []
    many = {(r.query_id, r.doc_id): r.similarity for r in own.related_to_all(own.corpus.select("doc_id")).collect()}
    assert {d: s for (q, d), s in many.items() if q == 1} == {r.doc_id: r.similarity for r in own.related(1).collect()}
    blocks = similarity.similar_to_many(own.filters, own.filters, 5, block=1)
    assert {(r.query_id, r.doc_id, r.rank) for r in blocks.collect()} == {(r.query_id, r.doc_id, r.rank) for r in own.related_to_all(own.corpus.select("doc_id")).collect()}
    again = RelatedEngine(corpus(spark).repartition(7), PLAIN).filters
    assert sorted(again.collect()) == sorted(own.filters.collect())
    assert own.stats().first().documents == 8


def test_engine_with_sampling_and_empty_corpus(spark):
    config = EngineConfig(adaptive_stopwords=False, sample_size_threshold=3, word_index_threshold=3, max_sample_size=40)
    by_word = RelatedEngine(corpus(spark), config, now=datetime(2024, 10, 20))
    assert by_word.related(1).first().doc_id == 8
    by_bits = RelatedEngine(corpus(spark), EngineConfig(adaptive_stopwords=False, sample_size_threshold=3, max_sample_size=40), now=datetime(2024, 10, 20))
    assert by_bits.related(1).first().doc_id == 8
    assert by_bits.candidates(99).collect() == []
    empty = RelatedEngine(corpus(spark, {}), DEFAULT)
    assert empty.related(1).collect() == [] and empty.stats().first().documents == 0


def test_related_compares_all_documents_above_the_sampling_threshold(spark):
    texts = {i: f"filler{i} words{i} of{i} no{i} interest{i} here{i}" for i in range(1, 40)}
    query = " ".join(f"topic{i}" for i in range(40))
    # the query's best match shares few of its words and comes last, behind documents with one word each
    texts |= {50: query, 51: " ".join(f"topic{i}" for i in range(39)), **{i: f"topic{i % 40} plus some words{i}" for i in range(10, 40)}}
    config = EngineConfig(adaptive_stopwords=False, sample_size_threshold=3, word_index_threshold=3, max_sample_size=5)
    for sampled in (config, config.with_overrides({"word_index_threshold": 750})):
        found = RelatedEngine(corpus(spark, texts), sampled, now=datetime(2026, 1, 1)).related(50).collect()
        assert found == RelatedEngine(corpus(spark, texts), PLAIN).related(50).collect() and found[0].doc_id == 51 and len(found) == 5


def test_texts_are_whole_unless_asked_for(spark, tmp_path):
    texts = {i: "one two three " * 2000 + f"last{i}" for i in range(1, 4)}
    plain = {"adaptive_stopwords": False, "large_corpus": 2}
    for config, held in ((DEFAULT.with_overrides(plain), True), (COMPAT.with_overrides(plain), False), (DEFAULT.with_overrides({**plain, "char_limit": 50}), False)):
        own = RelatedEngine(corpus(spark, texts), config)
        assert {r.doc_id for r in own.tokens.where(F.array_contains("tokens", F.concat(F.lit("last"), "doc_id"))).collect()} == (set(texts) if held else set())
        live = LiveIndex(spark, str(tmp_path / f"live{held}{config.char_limit}"), own.bits, config, documents=own.documents)
        assert sorted(live.filters_of(own.corpus).collect()) == sorted(own.filters.collect())


def test_a_live_index_cuts_texts_like_the_full_build(spark, tmp_path):
    texts = {i: " ".join(f"w{j}x{i}" for j in range(1200)) for i in range(1, 4)}
    config = COMPAT.with_overrides({"adaptive_stopwords": False, "large_corpus": 2})
    own = RelatedEngine(corpus(spark, texts), config)
    live = LiveIndex(spark, str(tmp_path / "live"), own.bits, config, documents=own.documents)
    assert sorted(live.filters_of(own.corpus).collect()) == sorted(own.filters.collect())


def test_stopwords_are_learned_from_all_documents(spark):
    texts = {i: ("aurora" if i < 30 else "bridge") + f" comet own{i}" for i in range(90)}
    config = DEFAULT.with_overrides({"max_stopwords": 1, "common_words_threshold": 0.6})
    own = RelatedEngine(corpus(spark, texts), config)
    assert set(own.common[0]) == {"comet", "bridge"} and own.common[1] is None
    assert {r.doc_id: r.text for r in own.filtered.collect()} == {i: f"aurora own{i}" if i < 30 else f"own{i}" for i in texts}
    assert set(RelatedEngine(corpus(spark, texts), config.with_overrides({"stopword_mode": "first"})).common[0]) == {"aurora", "comet"}


def test_settings():
    assert DEFAULT.filter_bits(10) == DEFAULT.filter_bits(5001) == COMPAT.filter_bits(10) == 8192 and COMPAT.filter_bits(5001) == 4096 and DEFAULT.text_limit(5001) == 5000
    assert EngineConfig(bits=100).filter_bits(1) == 128
    assert DEFAULT.with_overrides({"max_suggestions": 7, "custom_title": ""}).custom_title == "Related Notes"
    for bad in ({"max_suggestions": 0}, {"max_suggestions": 21}, {"bits": 0}, {"stopword_mode": "x"}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)


def test_parameters():
    sizes = [bloom.optimal_size(n) for n in (1, 100, 1000, 10_000, 1_000_000)]
    assert sizes == sorted(sizes) and all(s % 32 == 0 for s in sizes) and bloom.optimal_size(1000, 0.001) > bloom.optimal_size(1000, 0.1)
    assert bloom.optimal_hashes(1000, 100) == 7 and bloom.optimal_hashes(10, 1000) == 1 and bloom.rounded_size(100) == 128


def test_postings(spark):
    own = spark.createDataFrame([(1, ["Learn", "code", "x" * 21, "--a", "12", "1234"]), (2, ["learn"]), (3, ["learn", "code", "ab1"]), (4, [""])], "doc_id bigint, tokens array<string>")
    index = postings.word_index(postings.document_words(own), 4)
    assert {(r.doc_id, r.word) for r in index.collect()} == {(1, "learn"), (1, "code"), (1, "1234"), (2, "learn"), (3, "learn"), (3, "code"), (3, "ab1")}
    ids = lambda df: [r.doc_id for r in df.collect()]
    assert sorted(ids(postings.documents_with_word(index, "LEARN"))) == [1, 2, 3]
    assert ids(postings.documents_with_any(index, ["ab1", "learn", "none"], 2, 2)) == [3, 1] and ids(postings.documents_with_any(index, [], 2)) == []
    assert [(r.word, r.df) for r in postings.most_common_words(index, 2).collect()] == [("learn", 3), ("code", 2)]
    assert ids(postings.fast_candidates(index, 1, 5, 8)) == [3, 2] and ids(postings.fast_candidates(index, 77, 5)) == []
    assert sorted({r.doc_id for r in postings.remove_documents(index, spark.createDataFrame([(1,)], "doc_id bigint")).collect()}) == [2, 3]
    assert postings.index_stats(index.limit(0), 0).first().documents_per_word == 0


def test_sequential_admission_is_a_fold(spark):
    rng = random.Random(2)
    docs = [[f"w{int(rng.expovariate(0.03))}" for _ in range(30)] + ["always"] for _ in range(140)]
    own = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, tokens array<string>").withColumn("tokens", F.transform("tokens", lambda w: F.concat(w, F.lit("xx"))))
    numbered = with_sequence(own.select("doc_id"), "doc_id")
    held, expected = {}, set()
    for before, words in enumerate(docs):
        for w in dict.fromkeys(f"{x}xx" for x in words):
            n = held.get(w, 0)
            if before < 10 or (n / before <= 0.7 and not (before > 100 and n < 2)):
                held[w] = n + 1
                expected.add((before, w))
    got = {(r.doc_id, r.word) for r in postings.sequential_word_index(postings.document_words(own), numbered).collect()}
    assert got == expected


def test_order(spark):
    df = spark.range(0, 997, 3).selectExpr("id", "id % 7 AS x").repartition(9)
    assert sorted((r.id, r.seq) for r in with_sequence(df, "id").collect()) == [(i * 3, i + 1) for i in range(333)]
    got = {r.id: (r.n, r.avg_x) for r in running_averages(df, "id", ["x"]).collect()}
    assert got[0] == (1, 0.0) and got[6] == (3, pytest.approx((0 + 3 + 6) / 3)) and got[996][0] == 333


def test_links(spark):
    rows = [
        ("see [[Alpha]]", True), ("see [[alpha|x]]", True), ("[t](ALPHA.md)", True), ("[[v/Alpha.md]]", True), ("[[Alphabet]] Alpha", False),
        ("", False), ("a\n## Related Notes\n- [[b]]\n\nz", False),
    ]
    df = spark.createDataFrame(rows, "t string, ok boolean")
    base, path = F.lit("Alpha"), F.lit("v/Alpha.md")
    assert df.where(links.has_link(F.col("t"), base, path) != F.col("ok")).collect() == []
    new = [r[0] for r in df.select(links.with_link(F.col("t"), base, path, "Related Notes")).collect()]
    assert new[0] == rows[0][0] and new[5] == "\n\n## Related Notes\n- [[Alpha]]\n" and new[6] == "a\n## Related Notes\n- [[b]]\n- [[Alpha]]\n\nz"
    plus = spark.createDataFrame([("[[C++]]",)], "t string")
    assert plus.select(links.has_link(F.col("t"), F.lit("C++"), F.lit("v/C++.md"))).first()[0]
    notes = corpus(spark, {1: "[[N2]] and [x](n3.md)", 2: "[[v/n1.md]] [[n2]]", 3: "none"})
    assert {tuple(r) for r in links.link_edges(notes).collect()} == {(1, 2), (1, 3), (2, 1)}


def test_store(spark, tmp_path):
    own = RelatedEngine(corpus(spark), PLAIN)
    place = store.IndexStore(spark, str(tmp_path / "index"))
    assert place.load(bits=8192, hashes=3) is None and place.files.writable()
    first, second = own.save(place), own.save(place)
    assert (first["current"], second["current"]) == (1, 2)
    fresh = RelatedEngine(corpus(spark), PLAIN)
    assert fresh.restore(place) and sorted(fresh.filters.collect()) == sorted(own.filters.collect())
    assert place.load(bits=4096, hashes=3) is None and place.load(bits=8192, hashes=4) is None
    assert place.load(bits=8192, hashes=3, now=datetime.now(timezone.utc) + timedelta(days=31)) is None
    good = place.manifest()
    for bad in (None, [], {}, {**good, "version": 1}, {k: v for k, v in good.items() if k != "params"}, {**good, "params": {}}, {**good, "timestamp": "x"}, {**good, "stats": None}):
        assert not store.validate_manifest(bad)[0]
    assert store.validate_manifest(good) == (True, "")
    place.files.write("manifest.json", "{broken")
    assert place.load(bits=8192, hashes=3) is None
    assert place.delete() and not place.delete()
    for bad in ("", "x", "/tmp/../etc", "/tmp//x"):
        with pytest.raises(ValueError):
            store.IndexStore(spark, bad)


def test_filter_json(spark):
    filters = RelatedEngine(corpus(spark), PLAIN).filters
    again = store.from_json(store.to_json(filters), 8192, 3)
    assert sorted((r.doc_id, r.words, r.popcount) for r in again.collect()) == sorted((r.doc_id, r.words, r.popcount) for r in filters.collect())
    with pytest.raises(Exception, match="another shape"):
        store.from_json(store.to_json(filters), 4096, 3).collect()


def test_live_index(spark, tmp_path):
    changes = "doc_id bigint, op string, text string, ts timestamp"
    t = datetime(2024, 1, 1)
    live = LiveIndex(spark, str(tmp_path / "live"), 8192, PLAIN)
    assert live.current().collect() == []
    live.apply(spark.createDataFrame([(1, "create", "alpha beta gamma", t), (1, "modify", "delta words here", t + timedelta(1)), (2, "create", "other text", t), (None, "create", "x", t)], changes), 0)
    second = spark.createDataFrame([(2, "delete", None, t), (3, "create", None, t), (1, "modify", "final words", t)], changes)
    live.apply(second, 1)
    live.apply(second, 1)
    def state():
        return sorted((r.doc_id, r.popcount) for r in live.current().collect())

    wanted = sorted((r.doc_id, r.popcount) for r in live.filters_of(spark.createDataFrame([(1, "final words"), (3, "")], "doc_id bigint, text string")).collect())
    assert state() == wanted
    live.compact()
    assert state() == wanted
    live.apply(spark.createDataFrame([(3, "delete", None, t)], changes), 2)
    assert [d for d, _ in state()] == [1]
    before = live.files.write
    live.files.write = lambda *a: (_ for _ in ()).throw(OSError("crash"))
    with pytest.raises(OSError):
        live.compact()
    live.files.write = before
    assert [d for d, _ in state()] == [1]
    live.compact()
    assert [d for d, _ in state()] == [1] and live._state() == ("compacted-000000000002", [])


def test_a_stream_goes_on_after_a_failure(spark, tmp_path):
    t = datetime(2024, 1, 1)
    schema = "doc_id bigint, op string, text string, ts timestamp"
    feed, checkpoint = str(tmp_path / "feed"), str(tmp_path / "checkpoint")
    live = LiveIndex(spark, str(tmp_path / "live"), 8192, PLAIN)
    batches = []

    def follow(fail_at=None):
        def apply(changes, batch):
            batches.append(batch)
            real(changes, batch)
            if batch == fail_at:
                raise OSError("crash")

        real, live.apply = LiveIndex.apply.__get__(live), apply
        query = live.follow(feed, checkpoint, files_per_batch=1)
        query.awaitTermination()

    for i in range(3):
        spark.createDataFrame([(i, "create", f"some words{i} of text{i}", t)], schema).coalesce(1).write.mode("append").parquet(feed)
    with pytest.raises(Exception, match="crash"):
        follow(fail_at=1)
    assert batches == [0, 1]
    follow()
    assert batches == [0, 1, 1, 2] and sorted(r.doc_id for r in live.current().collect()) == [0, 1, 2]
    spark.createDataFrame([(1, "delete", None, t)], schema).coalesce(1).write.mode("append").parquet(feed)
    follow()
    assert batches == [0, 1, 1, 2, 3] and sorted(r.doc_id for r in live.current().collect()) == [0, 2]


def test_an_engine_starts_from_its_saved_index_and_takes_changes(spark, tmp_path):
    texts = {i: f"common words{i % 4} topic{i % 4} and own{i} things" for i in range(40)}
    place = store.IndexStore(spark, str(tmp_path / "index"))
    config = DEFAULT.with_overrides({"max_stopwords": 2})
    first = RelatedEngine(corpus(spark, texts), config)
    assert not first.initialize(place)
    again = RelatedEngine(corpus(spark, texts).withColumn("text", F.raise_error(F.lit("read"))), config)
    assert again.initialize(place) and again.common == first.common
    assert sorted(again.words.collect()) == sorted(first.words.collect()) and again.related(3).collect() == first.related(3).collect()
    t = datetime(2024, 1, 1)
    changes = [(3, "delete", None, t), (50, "create", "common words9 newtopic", t), (7, "modify", "entirely newtopic text", t)]
    again.process(spark.createDataFrame(changes, "doc_id bigint, op string, text string, ts timestamp"))
    assert not again.is_indexed(3) and again.is_indexed(50) and again.similarity(7, 50) > 0 and again.similarity(7, 11) == 0
    assert {r.doc_id for r in postings.documents_with_word(again.words, "newtopic").collect()} == {7, 50}
    again.stop()
    assert "filters" not in again.__dict__


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "One.md").write_text("hello wörld")
    (tmp_path / "two.MD").write_text("x")
    (tmp_path / "no.txt").write_text("y")
    assert sorted((r.title, r.text) for r in folder_corpus(spark, str(tmp_path)).collect()) == [("One", "One hello wörld"), ("two", "two x")]
