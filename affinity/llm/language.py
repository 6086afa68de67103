"""The language of documents and of their segments, by compression.

For each language a zstandard dictionary of raw sentences is made from labelled documents. A
sentence belongs to the language whose dictionary lets it compress best; where the next best is
nearly as good, or where no dictionary helps, it stays without a language. The dictionary of the
sentence before is tried first, and alone where it does better than it ever does on another language.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

# How labels name the languages.
NAMES = """
en eng english anglais englisch
de deu ger german deutsch
fr fra fre french français francais
es spa spanish español espanol castellano
pt por portuguese português portugues
nl nld dut dutch nederlands
ru rus russian русский
ja jpn japanese 日本語
""".strip()
CODES = {name: line.split()[0] for line in NAMES.split("\n") for name in line.split()}
#: Labelled documents that are read for each language, their characters, and bytes of each dictionary, at most.
SAMPLE_DOCS = 600
SAMPLE_CHARACTERS = 20_000
DICTIONARY_BYTES = 1 << 16
#: Words (characters in Japanese) from which a further language is held.
LEAST_WORDS, LEAST_CHARACTERS = 20, 40
#: Shares of the next best size by which the best must be smaller, and of the plain size that it may have.
MARGIN, RATIO = 0.08, 0.75

FRONT = re.compile(r"\A\s*---[ \t]*\n.*?\n---[ \t]*(?=\n|\Z)", re.S)
FENCED = re.compile(r"(`{3,}|~{3,}).*?\1|`[^`\n]+`", re.S)
#: What has no language, each with characters of which the text must have one.
OTHER = [
    (":", re.compile(r"https?://\S+")),
    ("[", re.compile(r"\[\[[^\]\n]*\]\]|\[[^\]\n]*\]\([^)\n]*\)")),
    ("<", re.compile(r"</?[a-zA-Z][^<>\n]*>")),
    ("#@", re.compile(r"[#@]\w[\w/-]*")),
    ("{", re.compile(r"^[^\S\n]*\{.*\}[^\S\n]*$", re.M)),
]
#: Codes and numbers, taken out of single sentences; and marks at the ends of a sentence.
DIGIT, CODE = re.compile(r"\d"), re.compile(r"\b[^\W\d]*\d\w*")
ENDS = " \t-+*>#|:;,'\"()[]/"
SENTENCE = re.compile(r"(?:[^.!?。！？\n ]+| (?!/ ))+[.!?。！？]*")
#: Characters that show nothing or mark emphasis; and accents.
NOISE = re.compile("[\xad\u200b-\u200f\u2060\ufeff*_]+")
ACCENTS = re.compile(r"[\u0300-\u036f\u3099\u309a]+")
WORD = re.compile(r"[^\W\d_]+")
JAPANESE = re.compile(r"[぀-ヿ㐀-鿿々ｦ-ﾟ]")
CYRILLIC = re.compile(r"[Ѐ-ӿ]")
#: Lines of each other language by which a dictionary's bound is found, and the share of them that may lie below it.
BOUND_LINES, BOUND_SHARE = 1500, 0.001


def label_code(label: Column) -> Column:
    """The two-letter code that a label names, in any usual spelling; null if it names none of the known."""
    known = F.create_map(*[F.lit(x) for item in CODES.items() for x in item])
    whole = F.lower(F.btrim(label))
    return F.coalesce(F.try_element_at(known, whole), F.try_element_at(known, F.split(whole, "[-_ (]")[0]))


def plain(text: str) -> str:
    """Lower case without accents, emphasis, numbers, invisible characters and repeated blanks, so that noisy texts compare."""
    if DIGIT.search(text):
        text = CODE.sub(" ", text)
    text = text.strip(ENDS)
    text = " ".join(NOISE.sub("", text).lower().split())
    return text if text.isascii() else ACCENTS.sub("", unicodedata.normalize("NFKD", text))


def masked(text: str) -> str:
    """The text with properties, code, links and tags blanked, places kept."""
    def blank(m: re.Match) -> str:
        return m[0].translate(blanks)

    blanks = _Blanks()
    if text.lstrip().startswith("---"):
        text = FRONT.sub(blank, text)
    if "`" in text or "~~~" in text:
        text = FENCED.sub(blank, text)
    for marks, pattern in OTHER:
        if any(c in text for c in marks):
            text = pattern.sub(blank, text)
    return text


class _Blanks(dict):
    """A blank for every character but the end of a line."""

    def __missing__(self, c: int) -> int:
        return 10 if c == 10 else 32


def script(text: str) -> str:
    if text.isascii():
        return ""
    letters = len(WORD.findall(text))
    japanese = len(JAPANESE.findall(text))
    if japanese > 4 or japanese > letters:
        return "ja"
    return "ru" if len(CYRILLIC.findall(text)) > len(text) // 4 else ""


def sentences(text: str) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, plain text, size) of each sentence; size in words, of Japanese in half characters."""
    for m in SENTENCE.finditer(masked(text)):
        line = m[0]
        if len(line) < 3:
            continue
        line = plain(line)
        japanese = 0 if line.isascii() else len(JAPANESE.findall(line))
        size = japanese // 2 if japanese > 4 else len(WORD.findall(line))
        if size >= 3:
            yield m.start(), m.end(), line, size


def dictionary_text(lines: list[str], most: int) -> bytes:
    """Distinct sentences up to ``most`` bytes, the first of them last, where matches are cheapest."""
    taken, size = [], 0
    for line in dict.fromkeys(lines):
        data = line.encode() + b"\n"
        if size + len(data) > most:
            break
        taken.append(data)
        size += len(data)
    return b"".join(reversed(taken))


@dataclass
class Classifier:
    """Dictionaries of raw content by language.

    ``floors`` has, for each dictionary, the share of their size to which it brings sentences of other languages at
    best. A sentence that its neighbour's dictionary brings below that by the margin needs no other dictionary.
    """

    texts: dict[str, bytes]
    level: int = 3
    margin: float = MARGIN
    ratio: float = RATIO
    floors: dict[str, float] = field(default_factory=dict)
    _ready: dict[str, dict[str, zstandard.ZstdCompressor]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": {}}

    def _compressors(self) -> dict[str, dict[str, zstandard.ZstdCompressor]]:
        if not self._ready:
            made: dict[str, dict] = {"ja": {}, "ru": {}, "": {}}
            for lang, text in self.texts.items():
                if not text:
                    continue
                data = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                data.precompute_compress(level=self.level)
                own = script(text[:4000].decode(errors="ignore"))
                made[own][lang] = zstandard.ZstdCompressor(
                    dict_data=data, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            self._ready = made
        return self._ready

    def sizes(self, line: str) -> dict[str, int]:
        """The compressed size with each dictionary of the line's script."""
        data = line.encode()
        return {lang: len(c.compress(data)) for lang, c in self._compressors()[script(line)].items()}

    def judge(self, sizes: dict[str, int], length: int) -> tuple[str | None, float]:
        """The language with the smallest size and a confidence from 0 to 1; null where the margin is narrow."""
        if not sizes:
            return None, 0.0
        ordered = sorted(sizes.items(), key=lambda x: (x[1], x[0]))
        best = ordered[0][1]
        rival = min(ordered[1][1] if len(ordered) > 1 else length, length)
        margin = (rival - best) / rival if rival else 0.0
        if margin < self.margin or best > self.ratio * length:
            return None, max(0.0, margin)
        return ordered[0][0], margin

    def line(self, line: str, guess: str | None = None) -> tuple[str | None, float]:
        """The language and confidence of a sentence; ``guess``, a neighbour's language, is tried first."""
        floor = self.floors.get(guess)
        if floor:
            own = self._compressors()[script(line)].get(guess)
            if own:
                data = line.encode()
                share = len(own.compress(data)) / len(data)
                if share <= min(floor * (1 - self.margin), self.ratio):
                    return guess, 1 - share / floor
        return self.judge(self.sizes(line), len(line.encode()))

    def calibrated(self, lines: dict[str, list[str]]) -> Classifier:
        """With ``floors`` from sentences by language; that of a dictionary alone in its script is the plain size."""
        floors = {}
        for own in self._compressors().values():
            for lang, compressor in own.items():
                data = [x.encode() for other in own if other != lang for x in lines.get(other, [])[:BOUND_LINES]]
                shares = [len(compressor.compress(d)) / len(d) for d in data]
                floors[lang] = float(np.quantile(shares, BOUND_SHARE)) if shares else 1.0
        return replace(self, floors=floors)


def _marks(line: str) -> set[str]:
    """The words of a sentence, of Japanese its characters."""
    return set(JAPANESE.findall(line)) if script(line) == "ja" else set(WORD.findall(line))


def sifted(docs: list[tuple[str, list[str]]], rounds: int = 3) -> list[tuple[str, list[str]]]:
    """The sentences whose words speak for their label.

    A wrong label puts a language's words at another's name, but far more seldom than at
    its own: a word counts for a language by the share of that label's documents with it.
    Sentences for which another label is likelier are left out, and counting starts again.
    """
    names = sorted({lang for lang, _ in docs})
    places: dict[str, int] = {}
    doc, words, sizes = [], [], []
    for i, (_, lines) in enumerate(docs):
        for line in lines:
            marks = [places.setdefault(w, len(places)) for w in sorted(_marks(line))]
            doc.append(i)
            words += marks
            sizes.append(len(marks))
    if not words:
        return [(lang, []) for lang, _ in docs]
    lang = np.array([names.index(n) for n, _ in docs])
    doc, words, sizes = np.array(doc), np.array(words), np.array(sizes)
    starts, line_of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    kept = sizes > 0
    for _ in range(rounds):
        held = np.bincount(lang[np.unique(doc[kept])], minlength=len(names))
        own = kept[line_of]
        seen = np.unique(doc[line_of[own]] * len(places) + words[own])  # each word once a document
        share = np.bincount(seen % len(places) * len(names) + lang[seen // len(places)], minlength=len(places) * len(names))
        share = share.reshape(-1, len(names)) / np.maximum(held, 1)
        weight = np.log((share + 1e-3) / (share.sum(axis=1, keepdims=True) + 1e-2))
        score = np.stack([np.bincount(line_of, weight[words, k], minlength=len(sizes)) for k in range(len(names))], axis=1)
        kept &= score.argmax(axis=1) == lang[doc]
    keep = iter(kept.tolist())
    return [(name, [x for x in lines if next(keep)]) for name, lines in docs]


def train(labelled: list[tuple[str, str]], *, most: int = DICTIONARY_BYTES) -> Classifier:
    """A classifier from (language, text) pairs, some of which are wrong."""
    lines = defaultdict(list)
    for lang, own in sifted([(lang, [s[2] for s in sentences(text)]) for lang, text in labelled]):
        lines[lang] += own
    return Classifier({lang: dictionary_text(own, most) for lang, own in lines.items()}).calibrated(lines)


def labelled_sample(df: DataFrame, text: str, label: str, docs: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """Up to ``docs`` labelled texts of each language, chosen by a hash of the text among those of a usual length."""
    rows = df.select(label_code(F.col(label)).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.length("text").between(1, SAMPLE_CHARACTERS))
    first = Window.partitionBy("lang").orderBy("h", "text")
    taken = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= docs)
    return [(r.lang, r.text) for r in taken.orderBy("h", "text").collect()]


SEGMENT = StructType([
    StructField("start", LongType()), StructField("end", LongType()), StructField("lang", StringType()),
    StructField("confidence", DoubleType()), StructField("size", LongType()),
])


def segments_of(text: str, judge: Classifier) -> list[tuple]:
    """The document's segments of one language, as (start, end, lang, confidence, size)."""
    found: list[list] = []
    for start, end, line, size in sentences(text):
        last = found[-1] if found else None
        lang, confidence = judge.line(line, last[2] if last else None)
        if lang is None:
            continue
        if last and last[2] == lang:
            last[1], last[3], last[4] = end, last[3] + confidence * size, last[4] + size
        else:
            found.append([start, end, lang, confidence * size, size])
    return [(s, e, lang, c / n, n) for s, e, lang, c, n in found]


def held_languages(judged: DataFrame) -> DataFrame:
    """``judged`` with ``held``: (lang, confidence, size) of the language with most words and of each
    other with enough of them, by falling size."""
    def total(lang: str) -> Column:
        own = F.filter("segments", lambda s: s["lang"] == lang)
        size = F.aggregate(own, F.lit(0).cast("bigint"), lambda a, s: a + s["size"])
        sure = F.aggregate(own, F.lit(0.0), lambda a, s: a + s["size"] * s["confidence"])
        return F.struct(size.alias("size"), F.lit(lang).alias("lang"), (sure / F.greatest(size, F.lit(1))).alias("confidence"))

    codes = sorted(set(CODES.values()))
    sizes = F.sort_array(F.filter(F.array(*[total(c) for c in codes]), lambda x: x["size"] > 0), asc=False)
    enough = F.filter(
        "sizes",
        lambda x, i: (i == 0) | (x["size"] >= F.when(x["lang"] == "ja", LEAST_CHARACTERS // 2).otherwise(LEAST_WORDS)),
    )
    return judged.withColumn("sizes", sizes).withColumn("held", enough).drop("sizes")


def languages(df: DataFrame, id_col: str, text_col: str, judge: Classifier, *, keep: list[str] | None = None) -> DataFrame:
    """(id, segments): each document's segments (start, end, lang, confidence, size).

    Sentences that no language fits stand in no segment; null, empty and other texts without a
    sentence have an empty list. Whole texts are read.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [dict(zip(SEGMENT.names, s)) for s in segments_of(t, judge)] if t else [])

    split = F.pandas_udf(run, ArrayType(SEGMENT))
    return df.select(F.col(id_col).alias("id"), split(F.col(text_col)).alias("segments"), *(keep or []))
