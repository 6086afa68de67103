import pytest
from pyspark.sql import functions as F

from affinity.functions import text as fn


def tokens(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.tokens for r in fn.with_tokens(df, "text", "tokens").collect()}
    return [got[i] for i in range(len(texts))]


def test_words_stopwords_and_stems(spark):
    got = tokens(
        spark, "The quick brown fox jumps over the lazy dog", "running walked cats", "classes parties boxes meetings kindness quickly",
        "don't stop", "It's John's", "programming language documentation",
    )
    assert got == [
        ["quick", "brown", "fox", "jump", "lazy", "dog"], ["runn", "walk", "cat"], ["classe", "partie", "boxe", "meeting", "kindness", "quick"],
        ["don", "stop"], ["john"], ["programm", "language", "documentation"],
    ]


def test_null_and_empty(spark):
    assert tokens(spark, None, "", " \n ", "a an", "!?") == [[""]] * 5


def test_code_and_addresses_stay(spark):
    got = tokens(
        spark, "Check `function()` and visit https://example.com", "Open config.js file", "foo`bar`baz qux", "`bar`baz qux",
        "```\nlet x = 1\nend\n``` behind", "note.md, other", "(see https://a.b/c).", "x" * 501 + ".md", "a+b+c+d+e+f+g+h+i+j+k+l.md",
    )
    assert got[0] == ["check", "function()", "visit", "https://example.com"]
    assert got[1] == ["open", "config.js", "file"]
    assert got[2] == ["foo__code_block_0__baz", "qux"]
    assert got[3] == ["bar", "qux"]
    assert got[4] == ["let", "x", "=", "1", "end", "behind"]
    assert got[5] == ["note", "other"] and got[6] == ["see", "https://a.b/c)."]  # a comma undoes a file name
    assert got[7] == ["x" * 501] and got[8] == [""]  # too long a run, too many plus signs


def test_han_and_kana(spark):
    got = tokens(spark, "这是中文测试", "これは abc to x", "か゛がガ a `日本` b", "日")
    assert got[0] == list("这是中文测试") + ["这是", "是中", "中文", "文测", "测试"]
    assert got[1] == ["こ", "れ", "は", "abc", "これ", "れは"]
    assert "が" in got[2] and got[3] == ["日"]


def test_other_scripts_are_blank(spark):
    assert tokens(spark, "한국어 привет éaument ñandú") == [["aument"]]  # "and" is left of the last word


def test_urls(spark):
    cases = {"a.md": True, "A.MD": True, ".md": False, "http://": False, "http://a": True, "https://" + "a" * 1500: False, "file://" + "a" * 799: True, "file://" + "a" * 800: False, "abc.exe": False, "#" * 11 + ".md": False, "x" * 497 + ".md": False}
    df = spark.createDataFrame(list(cases.items()), "u string, ok boolean")
    assert df.where(fn.is_url(F.col("u")) != F.col("ok")).collect() == []


def loop(text, most):
    """Cutting as a walk over the text."""
    import re

    if len(text) <= most:
        return len(text)
    end = 0
    for m in re.finditer(r"[.!?]+\s+", text):
        if m.end() > most:
            break
        end = m.end()
    if end > most * 0.8:
        return end
    end = 0
    for m in re.finditer(r"\s+", text):
        if m.start() > most:
            break
        end = m.start()
    if end > most * 0.9:
        return end
    at = most
    while at > most * 0.9 and at < len(text) and not text[at].isspace():
        at -= 1
    return at


def test_cutting(spark):
    texts = ["word " * 50, "A one. Two three! Four? " * 9, "x" * 300, "y" * 95 + " " * 20 + "z" * 100, "a. " + "b" * 200, "short", "", "e " * 200, "q" * 91 + " " + "r" * 200, "s" * 100 + "  t", "日本。" * 60]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (100, 97, 10):
        got = [r[0] for r in df.select(fn.kept_length(F.col("t"), most)).collect()]
        assert got == [loop(t, most) for t in texts]


def test_term_array_caps(spark):
    def count(n, cjk):
        words = F.array(*[F.lit(f"term{i}") for i in range(n)])
        return spark.range(1).select(F.size(fn.term_array(words, F.lit(cjk)))).first()[0] - n

    assert [count(40, False), count(300, False), count(600, False), count(300, True), count(600, True)] == [39, 200, 100, 100, 50]


def test_names_paths_and_ngrams(spark):
    row = spark.range(1).select(
        fn.file_name(F.lit("a/b/c.d.md")), fn.base_name(F.lit("a/b/c.d.md")), fn.normal_path(F.lit("\\a//b\\c/")), fn.char_ngrams(F.lit("Ab  abc"), 3), fn.char_ngrams(F.lit("ab"), 3)
    ).first()
    assert list(row) == ["c.d.md", "c.d", "a/b/c", ["ab ", "b a", " ab", "abc"], []]


@pytest.mark.parametrize("words, most, expected", [(["a", "b", "c"], 5, ["a b", "b c"]), (["a", "b", "c"], 1, ["a b"]), (["a"], 3, []), ([], 3, [])])
def test_word_pairs(spark, words, most, expected):
    df = spark.createDataFrame([(words,)], "w array<string>")
    assert df.select(fn.word_pairs(F.col("w"), most)).first()[0] == expected
