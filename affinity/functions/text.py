"""Tokenization and other text functions.

The steps of the tokenizer are columns of their own rather than one nested expression, so that
what several steps use is computed once. Explode their arrays with the outer variants: of the others
the optimiser infers a filter, which it pushes down by nesting all the steps again.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no topic.
STOPWORDS = """
a an the
in on at with by from to for of about as into over under above below between among through
and but or nor so yet after although because
am is are was were be been being have has had do does did will would shall should can could may might must
i me my mine myself you your yours yourself he him his himself she her hers herself it its itself
we us our ours ourselves they them their theirs themselves this that these those
what which who whom whose when where why how
all any both each few more most some no not only than too very
""".split()
# Endings of file names.
EXTENSIONS = "md txt js ts html css json py java rb c cpp h go rs php".split()

#: Characters that count as white space, and those of the Han and kana scripts.
SPACE = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}]"
BLANKS = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
CODE = r"`[^`]+`|```[\s\S]+?```"
MARKS = r"[\x{0300}-\x{036F}\x{3099}\x{309A}]"
_SUFFIX = rf"(?i)\.(?:{'|'.join(EXTENSIONS)})$"
_SCHEME = "^(?:https?|file)://"
LINKS_SOMEWHERE = rf"(?i)(?:^|{SPACE})(?:https?|file)://|\.(?:{'|'.join(EXTENSIONS)})(?:{SPACE}|$)"


def _several(x: Column, c: str, most: int) -> Column:
    """More than ``most`` of the character ``c``."""
    return F.length(x) - F.length(F.replace(x, F.lit(c), F.lit(""))) > most


def is_url(x: Column) -> Column:
    """An address or a file name that is short and plain enough to be kept whole."""
    n = F.length(x)
    plain = n.between(4, 2000)
    for c, most in (("+", 10), ("*", 10), (".", 50), ("/", 20), ("?", 10), ("#", 10)):
        plain = plain & ~_several(x, c, most)
    web = F.startswith(x, F.lit("http://")) | F.startswith(x, F.lit("https://"))
    rest = n - F.when(F.startswith(x, F.lit("https://")), 8).otherwise(7)
    kind = (
        F.when(web, rest.between(1, 1499))
        .when(F.startswith(x, F.lit("file://")), rest.between(1, 799))
        .otherwise(x.rlike(_SUFFIX) & (n < 500))
    )
    return plain & kind


def kept_whole(x: Column) -> Column:
    """A run without white space that the tokenizer leaves as it is."""
    return (F.length(x) <= 500) & (x.rlike(_SCHEME) | (x.rlike(_SUFFIX) & is_url(x)))


def stem(x: Column) -> Column:
    """A word without its ending; the first rule that fits holds."""
    n = F.length(x)
    return (
        F.when(x.rlike(r"[/._-]"), x)
        .when(F.endswith(x, F.lit("ing")) & (n > 5), F.left(x, n - 3))
        .when(F.endswith(x, F.lit("ed")) & (n > 4), F.left(x, n - 2))
        .when(F.endswith(x, F.lit("s")) & ~F.endswith(x, F.lit("ss")) & (n > 3), F.left(x, n - 1))
        .when(F.endswith(x, F.lit("ly")) & (n > 4), F.left(x, n - 2))
        .otherwise(x)
    )


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def with_tokens(df: DataFrame, text: str, out: str, *, compose: bool = True) -> DataFrame:
    """``df`` with ``out``, the tokens of ``text`` in order, repeats kept.

    Code spans, addresses and file names stay whole but for white space inside; texts with Han
    or kana characters give these one by one, then in adjacent pairs; other texts give stemmed
    words of more than two letters, digits, hyphens or underscores. A null or empty text, and one
    without tokens, gives one empty token. ``compose`` brings texts with Han or kana characters to
    composed form, for which Spark has no function of its own; tokens of such texts are in it already,
    so a second pass over them goes without and stays one plan of built-in functions.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_t", t).withColumn(
        "_codes", F.when(F.instr("_t", "`") > 0, F.regexp_extract_all("_t", F.lit(CODE), F.lit(0)))
    )
    pieces = F.transform(
        F.split("_t", CODE, -1), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("__code_block_"), i - 1, F.lit("__"), p))
    )
    df = df.withColumn("_s", F.when(F.size("_codes") > 0, F.array_join(pieces, "")).otherwise(F.col("_t")))
    df = df.withColumn("_runs", F.when(F.col("_s").rlike(LINKS_SOMEWHERE), F.filter(F.split("_s", f"{SPACE}+", -1), lambda r: r != "")))
    marked = F.transform("_runs", lambda r, i: F.when(kept_whole(r), F.concat(F.lit("__url_"), i, F.lit("__"))).otherwise(r))
    df = df.withColumn("_p", F.when(F.col("_runs").isNull(), F.col("_s")).otherwise(F.array_join(marked, " ")))
    df = df.withColumn("_cjk", F.col("_p").rlike(CJK))
    if compose:
        loose = F.col("_cjk") & F.col("_p").rlike(MARKS)
        df = df.withColumn("_p", F.when(loose, _nfc(F.when(loose, F.col("_p")))).otherwise(F.col("_p")))
    df = df.withColumn("_l", F.lower("_p"))

    words = F.filter(
        F.split("_l", r"[^\w\-]+", -1), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS)
    )
    runs = F.filter(
        F.regexp_extract_all("_l", F.lit(f"{CJK}|[a-z0-9_\\-]+"), F.lit(0)),
        lambda w: w.rlike(CJK) | ((F.length(w) > 2) & ~w.isin(STOPWORDS)),
    )
    signs = F.regexp_extract_all("_l", F.lit(CJK), F.lit(0))
    df = df.withColumn("_signs", F.when(F.col("_cjk"), signs))
    pairs = F.transform(
        F.slice("_signs", 1, F.greatest(F.size("_signs") - 1, F.lit(0))), lambda c, i: F.concat(c, F.get("_signs", i + 1))
    )
    df = df.withColumn("_tokens", F.when(F.col("_cjk"), F.concat(runs, pairs)).otherwise(F.transform(words, stem)))

    def restored(w: Column) -> Column:
        code = F.get("_codes", F.regexp_extract(w, r"^__code_block_(\d+)", 1).try_cast("int"))
        code = F.btrim(F.replace(code, F.lit("`"), F.lit("")), F.lit(BLANKS))
        address = F.get("_runs", F.regexp_extract(w, r"^__url_(\d+)", 1).try_cast("int"))
        return (
            F.when(F.startswith(w, F.lit("__code_block_")), F.coalesce(code, w))
            .when(F.startswith(w, F.lit("__url_")), F.coalesce(address, w))
            .otherwise(w)
        )

    special = F.col("_codes").isNotNull() | F.col("_runs").isNotNull()
    df = df.withColumn("_tokens", F.when(special, F.transform("_tokens", restored)).otherwise(F.col("_tokens")))
    again = F.split(F.array_join("_tokens", " "), f"{SPACE}+", -1)
    df = df.withColumn(
        out, F.when(special, again).when(F.size("_tokens") == 0, F.array(F.lit(""))).otherwise(F.col("_tokens"))
    )
    return df.drop("_t", "_codes", "_s", "_runs", "_p", "_cjk", "_l", "_signs", "_tokens")


def meaningful(tokens: Column, min_length: int = 2, common: list[str] | None = None, keep_cjk: bool = False) -> Column:
    """The lower-case tokens longer than ``min_length`` that are not ``common``; with ``keep_cjk`` also short ones of Han or kana."""
    def wanted(w: Column) -> Column:
        long = F.length(w) > min_length
        if keep_cjk:
            long = long | w.rlike(CJK)
        return long & ~w.isin(common) if common else long

    return F.filter(F.transform(tokens, F.lower), wanted)


def term_array(words: Column, cjk: Column, caps: tuple[int, int, int, int] = (200, 100, 100, 50), many: int = 500) -> Column:
    """The distinct words in order, followed by the first adjacent pairs.

    ``caps`` limits the pairs: of usual texts, of CJK texts, and of either with more than ``many`` distinct words.
    """
    few = F.size(F.array_distinct(words)) <= many
    cap = F.when(few, F.when(cjk, caps[1]).otherwise(caps[0])).otherwise(F.when(cjk, caps[3]).otherwise(caps[2]))
    return F.array_distinct(F.concat(words, word_pairs(words, cap)))


def all_terms(words: Column) -> Column:
    """The distinct words in order, followed by all distinct adjacent pairs."""
    return F.array_distinct(F.concat(words, word_pairs(words, F.size(words))))


def word_pairs(words: Column, most: Column | int) -> Column:
    """The first ``most`` pairs of adjacent words."""
    most = F.lit(most) if isinstance(most, int) else most
    heads = F.slice(words, F.lit(1), F.greatest(F.least(most, F.size(words) - 1), F.lit(0)))
    return F.transform(heads, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def composed(text: Column) -> Column:
    """The text in composed form, for which Spark has no function of its own; not for use inside other functions of arrays."""
    return _nfc(text)


def char_ngrams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of the lower-case text, which is ``composed`` already, with single blanks."""
    plain = F.regexp_replace(F.lower(text), f"{SPACE}+", " ")
    starts = F.when(F.length(plain) >= n, F.sequence(F.lit(1), F.length(plain) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(plain, i, F.lit(n))))


def kept_length(text: Column, most: int) -> Column:
    """How many characters of a text remain when it is cut to about ``most`` at a sentence or word."""
    head = F.left(text, F.lit(most + 1))
    nonspace = "[^" + SPACE[1:]
    sentence = F.length(F.regexp_extract(F.left(head, F.lit(most + 1)), rf"(?s)^(.*[.!?]{SPACE}+){nonspace}", 1))
    word = F.length(F.regexp_extract(head, rf"(?s)^(.*{nonspace}){SPACE}", 1))
    floor = int(most * 0.9)
    # walk back from the limit to white space, but not below nine tenths of it
    back = F.length(F.regexp_extract(head, rf"(?s)^(.*){SPACE}", 1))
    return (
        F.when(F.length(text) <= most, F.length(text))
        .when(sentence > most * 0.8, sentence)
        .when(word > most * 0.9, word)
        .otherwise(F.greatest(F.least(back, F.lit(most)), F.lit(floor)))
    )


def truncated(text: Column, most: int) -> Column:
    """A text cut to about ``most`` characters at a sentence or word."""
    return F.when(F.length(text) > most, F.left(text, kept_length(text, most))).otherwise(text)


def titled(title: Column, text: Column) -> Column:
    """The title, a blank and the text."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def base_name(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def normal_path(path: Column) -> Column:
    """A path with single forward slashes and none at either end."""
    return F.btrim(F.regexp_replace(path, r"[\\/]+", "/"), F.lit("/"))
