"""One consistent form for texts that look the same and differ in their characters.

Look-alike classes join code points and strings: width forms, ligatures and other compatible
characters with their parts, kinds of blank with the blank, invisible characters with nothing,
letters of one shape with each other, letters that are two in one with the string of both. The
classes are closed by union-find, so that a full-width letter also meets the letters of other scripts.
Each class is written as its member that is most frequent in the collection.

Rewriting has two steps, since a string of several characters can itself be spelled with look-alikes: first
single characters become their class's member, then strings of several characters theirs.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.session import cut

# Letters of one shape in the Latin, Greek, Cyrillic and Armenian scripts.
SHAPES = """
AΑА BΒВ CСϹ EΕЕ GԌ HΗН IΙІӀ JЈͿ KΚК MΜМϺ NΝ OΟОՕ PΡР QԚ SЅՏ TΤТ UՍ VѴ WԜ XΧХ YΥҮ ZΖ ΓГ ΠП ΦФ ÆӔ
aаɑ cсϲ dԁ eе gɡ hһհ iі jјϳ lӏ nո oοоօ pрρ qԛ sѕ uսυ vνѵ wԝ xх yу æӕ əә кκĸ
""".split()
# What is taken for each other at a glance though its shape differs, letters and strings. Only where it is asked for.
NEAR_SHAPES = "aα iıιɩ kк tт yγ nп rг gց".split()
NEAR_STRINGS = [("w", "vv"), ("m", "rn"), ("d", "cl")]
# Two letters that letters are named after without drawing both side by side.
NOT_BOTH = "AE OE OU OI YR HV TZ ET IS UM VY".split()
# Characters that show nothing and are not in the category of format characters.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
#: Records of a group in a block, at most about; a pair of blocks is joined by one task.
GROUP_BLOCK = 1000


def invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or c in UNSEEN or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef"


def blank(c: str) -> bool:
    return c == "\t" or unicodedata.category(c) == "Zs"


def both_letters() -> list[tuple[str, str]]:
    """Letters that draw two letters side by side and have no compatible string, each with that string, by their Unicode names."""
    found = []
    for c in map(chr, (*range(0x180, 0x250), *range(0x250, 0x2B0), *range(0x1D00, 0x1D80), *range(0xA720, 0xA800))):
        m = re.fullmatch(r"LATIN (SMALL|CAPITAL) LETTER ([A-Z]{2})(?: DIGRAPH)?", unicodedata.name(c, ""))
        if m and m[2] not in NOT_BOTH and not unicodedata.decomposition(c):
            found.append((c, m[2].lower() if m[1] == "SMALL" else m[2]))
    return found


class UnionFind:
    """Classes of strings, joined pair by pair."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self, members: Iterable[str]) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for m in members:
            found.setdefault(self.find(m), []).append(m)
        return found


def rewriting(counts: dict[str, int], shapes: Iterable[str] = SHAPES) -> dict[str, str]:
    """What each character, of those counted and the known shapes, is rewritten to, if it isn't kept: the first step.

    A string of several characters stands for its characters' representatives in turn, so
    a ligature and the look-alikes of its letters come together too.
    """
    joined = UnionFind()
    shapes = list(shapes)
    characters = set(counts) | {c for group in shapes for c in group}
    parts: dict[str, str] = {}
    weight: Counter[str] = Counter()
    for c in characters:
        if invisible(c):
            parts[c] = ""
            continue
        if blank(c):
            joined.union(c, " ")
        parts[c] = string = unicodedata.normalize("NFKD", c)
        if len(string) == 1:
            joined.union(c, string)
        for p in string:
            if blank(p):
                joined.union(p, " ")
            weight[p] += counts.get(c, 0)
    for group in shapes:
        for c in group[1:]:
            joined.union(group[0], c)
    members = {p for string in parts.values() for p in string} | {c for group in shapes for c in group} | {" "}
    chosen: dict[str, str] = {}
    for root, same in joined.classes(members).items():
        whole = " " if joined.find(" ") == root else max(same, key=lambda p: (weight[p], -ord(p)))
        chosen |= dict.fromkeys(same, whole)
    table = {}
    for c, string in parts.items():
        new = unicodedata.normalize("NFC", "".join("" if invisible(p) else chosen.get(p, p) for p in string))
        if new != c:
            table[c] = new
    table["\r\n"] = "\n"
    return table


def string_rewriting(groups: Iterable[tuple[str, ...]], table: dict[str, str], counts: dict[str, int]) -> dict[str, str]:
    """What the strings of ``groups`` that look the same are rewritten to, once characters are rewritten by ``table``: the second step.

    ``counts`` has the occurrences of the strings in that form.
    """
    joined, members = UnionFind(), set()
    rewrite = rewriter(table)
    for group in groups:
        forms = [rewrite(x) for x in group]
        members |= set(forms)
        for x in forms[1:]:
            joined.union(forms[0], x)
    new = {}
    for same in joined.classes(sorted(members)).values():
        best = max(same, key=lambda x: (counts.get(x, 0), -len(x), x))
        new |= {x: best for x in same if x != best}
    return new


def rewriter(table: dict[str, str]) -> Callable[[str], str]:
    """Rewrites a text greedily, leftmost and longest first."""
    automaton = ahocorasick.Automaton()
    for key, new in table.items():
        automaton.add_word(key, (len(key), new))
    if table:
        automaton.make_automaton()

    def rewrite(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if not table:
            return text
        out, at = [], 0
        for end, (length, new) in automaton.iter_long(text):
            start = end + 1 - length
            out.append(text[at:start])
            out.append(new)
            at = end + 1
        if not out:
            return text
        out.append(text[at:])
        return unicodedata.normalize("NFC", "".join(out))

    return rewrite


def static_table() -> dict[int, str]:
    """A rewriting that needs no collection: the first letter of each shape, for ``str.translate`` after NFKC."""
    table: dict[int, str] = {ord(c): group[0] for group in SHAPES for c in group[1:]}
    table |= {i: "" for i in range(sys.maxunicode + 1) if invisible(chr(i))}
    return table


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(text)
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["c", "n"])


def character_counts(df: DataFrame, text_col: str) -> dict[str, int]:
    """How often each code point occurs in all texts. Unicode bounds what reaches the driver."""
    counted = df.select(F.col(text_col).cast("string")).mapInArrow(_count, "c string, n bigint")
    return {r.c: r.n for r in counted.groupBy("c").agg(F.sum("n").alias("n")).collect() if r.c}


def _count_strings(strings: list[str], table: dict[str, str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite, counts = rewriter(table), dict.fromkeys(strings, 0)
        for batch in batches:
            for text in filter(None, batch.column(0).to_pylist()):
                text = rewrite(text)
                for x in strings:
                    counts[x] += text.count(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["c", "n"])

    return run


def rewriting_tables(df: DataFrame, text_col: str, *, near: bool = False) -> list[dict[str, str]]:
    """The two steps of the rewriting, from the counts over all rows.

    With ``near``, what differs in shape but is taken for each other at a glance (k and its Cyrillic cousin,
    rn and m) is one too. Groups of strings of which only one occurs need no rewriting.
    """
    counts = character_counts(df, text_col)
    table = rewriting(counts, [*SHAPES, *NEAR_SHAPES] if near else SHAPES)
    single = [g for g in both_letters() if g[0] in counts] + (NEAR_STRINGS if near else [])
    if not single:
        return [table]
    rewrite = rewriter(table)
    strings = sorted({rewrite(x) for g in single for x in g})
    counted = df.select(F.col(text_col).cast("string")).mapInArrow(_count_strings(strings, table), "c string, n bigint")
    found = {r.c: r.n for r in counted.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    return [table, string_rewriting(single, table, found)]


def consistent_text(
    df: DataFrame, id_col: str, text_col: str, *, tables: list[dict[str, str]] | None = None, near: bool = False
) -> DataFrame:
    """(id, original, text): every text in the consistent form. A null text stays null.

    ``tables`` are those of a rewriting made before, so that later rows get the same form; without them, they
    are made from the counts over all rows.
    """
    tables = rewriting_tables(df, text_col, near=near) if tables is None else tables

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        steps = [rewriter(t) for t in tables]

        def rewrite(text: str) -> str:
            for step in steps:
                text = step(text)
            return text

        for texts in batches:
            yield texts.map(lambda t: None if t is None else rewrite(t))

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("original"))
    return rows.withColumn("text", F.pandas_udf(run, "string")("original"))


def look_alike_pairs(
    df: DataFrame, id_col: str, text_col: str, *, near: bool = False, expand_limit: int | None = None, block: int = GROUP_BLOCK
) -> DataFrame:
    """(id_a, id_b; id_a < id_b): records whose texts differ as strings and have one consistent form.

    Null texts, and texts that are empty or show nothing, form no pair; nor do null ids. Rows
    repeated in full count once. Every group gives all its pairs: first its different strings are paired, in
    blocks where they are many, then the records of both strings of a pair meet, in blocks of about ``block``.

    Only where ``expand_limit`` is asked for, a larger group gives one pair a record: with the
    group's first record, or where it has that record's string, with the first record of another string.
    """
    rows = (
        consistent_text(df.where(F.col(id_col).isNotNull()), id_col, text_col, near=near)
        .where(F.col("text") != "")
        .select("id", F.md5(F.encode("text", "utf-8")).alias("key"), F.md5(F.encode("original", "utf-8")).alias("raw"))
        .distinct()
    )
    first = F.min(F.struct("id", "raw"))
    groups = rows.groupBy("key").agg(
        F.count("*").alias("c"), first.alias("first"), F.min("raw").alias("least"), F.max("raw").alias("most")
    )
    rows = cut(rows.join(groups.where(F.col("least") != F.col("most")), "key"))
    small = rows if expand_limit is None else rows.where(F.col("c") <= expand_limit)
    # the different strings of each group, with their number and that of their records
    raws = small.groupBy("key", "raw").agg(F.count("*").alias("records"))
    raws = cut(raws.join(raws.groupBy("key").agg(F.count("*").alias("strings")), "key"))
    many = F.ceil(F.col("strings") / block)
    blocked = raws.withColumn("own", F.pmod(F.xxhash64("raw"), many)).withColumn("others", F.sequence(F.lit(0).cast("bigint"), many - 1))
    a = blocked.select("key", F.col("raw").alias("raw_a"), F.ceil(F.col("records") / block).alias("n_a"), F.col("own").alias("i"), F.explode("others").alias("j"))
    b = blocked.select("key", F.col("raw").alias("raw_b"), F.ceil(F.col("records") / block).alias("n_b"), F.explode("others").alias("i"), F.col("own").alias("j"))
    linked = a.join(b, ["key", "i", "j"]).where(F.col("raw_a") < F.col("raw_b"))
    for side in "ab":
        linked = linked.withColumn(f"part_{side}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n_{side}") - 1)))
    members = small.select("id", "raw").join(raws.select("raw", F.ceil(F.col("records") / block).alias("n")), "raw")
    members = members.select("raw", "id", F.pmod(F.xxhash64("id"), "n").alias("part"))
    for side in "ab":
        linked = linked.join(members.toDF(f"raw_{side}", f"id_{side}", f"part_{side}"), [f"raw_{side}", f"part_{side}"])
    # an id may stand on several texts
    found = linked.where(F.col("id_a") != F.col("id_b"))
    pairs = found.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
    if expand_limit is None:
        return pairs
    large = rows.where(F.col("c") > expand_limit)
    other = (
        large.where(F.col("raw") != F.col("first.raw")).groupBy("key").agg(F.min("id").alias("other"))
    )
    against = F.when(F.col("raw") != F.col("first.raw"), F.col("first.id")).otherwise(F.col("other"))
    spread = large.join(other, "key").withColumn("against", against).where(F.col("id") != F.col("against"))
    return pairs.unionByName(
        spread.select(F.least("id", "against").alias("id_a"), F.greatest("id", "against").alias("id_b"))
    ).distinct()
