"""Passages of held-out items inside a corpus.

Windows of words are given a SimHash fingerprint. Every item has windows of nearly its own size, at all
of its offsets; documents have windows of the same sizes at every step that such a window allows, so that
a copy of an item always holds one of them. Fingerprints are split into one block more than the
Hamming radius, so two within the radius agree in a block, and an index by each block finds all of them.

Of an item that leaked in part, a window of its size differs in most words. So items also have windows of
the words of a passage, the least that counts as a leak; there documents have one at every word, and equal
windows have equal fingerprints. Candidates are verified exactly: the longest run of equal words, and
the weighted similarity of five-word shingles between the item and the place in the document.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.lookalikes import static_table
from affinity.session import cut

#: Words of a passage.
PASSAGE = 13
#: Hamming radius of windows of an item's size. Windows of a passage need none.
RADIUS = 4
#: Words of a shingle, and the weighted similarity from which a changed copy counts.
SHINGLE = 5
LEAST = 0.8
#: Words of items that are held at once; more are taken in blocks, each against all documents.
BLOCK_WORDS = 1_000_000
#: Words whose bits are held at once.
CHUNK = 1 << 15
#: Step from one window size to the next.
GROWTH = 1.25

INLINE_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
BREAK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr)\b[^<>]*>", re.I)
WORD = re.compile(r"[^\W_]+")
BEYOND = re.compile("[\U00010000-\U0010ffff]")
FOUND = "doc_id bigint, item_id bigint, first_word bigint, run bigint, similarity double"


@lru_cache(maxsize=1)
def _table() -> tuple[dict[int, str], re.Pattern]:
    """The rewriting of look-alikes, and a pattern that finds what it rewrites in the first plane."""
    table = static_table()
    return table, re.compile("[" + "".join(f"\\u{c:04x}" for c in table if c < 0x10000) + "]")


def words(text: str) -> list[str]:
    """The runs of letters and digits, in one form of characters, without case, tags and invisible characters."""
    if "<" in text:
        text = INLINE_TAG.sub("", BREAK_TAG.sub(" ", text))
    if not text.isascii():
        table, changed = _table()
        text = unicodedata.normalize("NFKD", text)
        if changed.search(text) or BEYOND.search(text):
            text = text.translate(table)
        text = unicodedata.normalize("NFKC", text)  # only now, since accents of look-alikes may compose
    return WORD.findall(text.casefold())


class Coder:
    """64-bit codes of words."""

    def __init__(self, most: int = 1_000_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, text: str) -> list[int]:
        known, found = self.known, words(text)
        try:
            return [known[w] for w in found]
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return [known[w] for w in found]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(codes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of each ``size`` consecutive words."""
    n = len(codes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = _mixed(total + codes[i : i + n])
    return total


def word_bits(codes: np.ndarray) -> np.ndarray:
    """The 64 bits of each word, a byte each."""
    return np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1)


class WindowSums:
    """Sums of the bits over windows of words, put together from those over 1, 2, 4, ... words, which all sizes share."""

    def __init__(self, codes: np.ndarray):
        self.words = len(codes)
        self.powers = [word_bits(codes)]

    def _power(self, k: int) -> np.ndarray:
        while len(self.powers) <= k:
            last, width = self.powers[-1], 1 << (len(self.powers) - 1)
            if width == 128:
                last = last.astype(np.uint32)
            self.powers.append(last[:-width] + last[width:])
        return self.powers[k]

    def fingerprints(self, window: int, step: int = 1) -> np.ndarray:
        """The SimHash of the windows at every ``step`` words: each bit is that of most of the words."""
        n = self.words - window + 1
        if n < 1:
            return np.empty(0, np.uint64)
        total, at = None, 0
        for k in range(window.bit_length()):
            if window >> k & 1:
                part = self._power(k)[at : at + n : step]
                total = part if total is None else total + part
                at += 1 << k
        return np.packbits(total > window // 2, axis=1).view(np.uint64).ravel()


class Prints:
    """Fingerprints, found by the blocks in which another within the radius must agree."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = [64 * b // (radius + 1) for b in range(radius + 2)]
        self.blocks = []
        for low, high in zip(edges, edges[1:]):
            key = self._block(prints, low, high)
            order = np.argsort(key, kind="stable")
            present = np.zeros(1 << min(high - low, 22), bool)
            present[key & np.uint64(len(present) - 1)] = True
            self.blocks.append((low, high, key[order], order, present))

    @staticmethod
    def _block(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return (prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, place here) for all fingerprints within the radius."""
        found = [np.empty((2, 0), np.int64)]
        for low, high, keys, order, present in self.blocks:
            key = self._block(prints, low, high)
            maybe = np.flatnonzero(present[key & np.uint64(len(present) - 1)])
            left, right = np.searchsorted(keys, key[maybe], "left"), np.searchsorted(keys, key[maybe], "right")
            count = right - left
            place = np.repeat(maybe, count)
            mine = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)]
            close = np.bitwise_count(prints[place] ^ self.prints[mine]) <= self.radius
            found.append(np.stack([place[close], mine[close]]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return both[0], both[1]


def window_sizes(passage: int, longest: int) -> list[tuple[int, int]]:
    """(window, step) of the sizes above a passage, the step being a quarter of the window."""
    sizes, size = [], float(passage)
    while True:
        size *= GROWTH
        window = round(size)
        if window + window // 4 - 1 > longest:
            return sizes
        sizes.append((window, max(1, window // 4)))


class WindowIndex:
    """The items' windows by their fingerprints, and what is needed to verify a candidate."""

    def __init__(self, texts: list[tuple[int, str]], passage: int = PASSAGE, radius: int = RADIUS):
        self.passage = passage
        coder = Coder()
        own = [np.array(coder(text), np.uint64) for _, text in texts]
        self.items = np.array([i for i, _ in texts], np.int64)
        self.base = np.concatenate([[0], np.cumsum([len(c) for c in own])]).astype(np.int64)
        self.codes = np.concatenate([*own, np.empty(0, np.uint64)])
        shingled = [np.unique(shingles(c)) for c in own]
        self.known, held = np.unique(np.concatenate([*shingled, np.empty(0, np.uint64)]), return_counts=True)
        # a shingle counts the more, the fewer items have it
        self.weights = np.log1p(len(texts) / np.maximum(held, 1))
        self.most = np.log1p(len(texts))
        self.total = np.array([self.weights[np.searchsorted(self.known, x)].sum() for x in shingled])
        self.present = np.zeros(1 << 20, bool)
        self.present[self.known & np.uint64(len(self.present) - 1)] = True
        sizes = window_sizes(passage, max((len(c) for c in own), default=0))
        sized: dict[tuple[int, int], list[int]] = {(passage, 1): [i for i, c in enumerate(own) if len(c) >= passage]}
        for i, c in enumerate(own):
            fit = [s for s in sizes if s[0] + s[1] - 1 <= len(c)]
            if fit:
                sized.setdefault(fit[-1], []).append(i)
        #: window, step, fingerprints, and the item and offset of each
        self.levels: list[tuple[int, int, Prints, np.ndarray, np.ndarray]] = []
        for (window, step), members in sorted(sized.items()):
            prints = [WindowSums(own[i]).fingerprints(window) for i in members]
            owner = np.repeat(np.array(members, np.int64), [len(p) for p in prints])
            offset = np.concatenate([*(np.arange(len(p)) for p in prints), np.empty(0, np.int64)])
            merged = np.concatenate([*prints, np.empty(0, np.uint64)])
            self.levels.append((window, step, Prints(merged, 0 if window == passage else radius), owner, offset))
        self.widest = max(window for window, *_ in self.levels)

    def length(self, item: np.ndarray) -> np.ndarray:
        return self.base[item + 1] - self.base[item]

    def upto(self, codes: np.ndarray) -> np.ndarray:
        """The running weight of the shingles at each word that any item has."""
        own = shingles(codes)
        weight = np.zeros(len(codes) + 1)
        maybe = np.flatnonzero(self.present[own & np.uint64(len(self.present) - 1)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, own[maybe]), len(self.known) - 1)
            weight[maybe + 1] = np.where(self.known[at] == own[maybe], self.weights[at], 0.0)
        return np.cumsum(weight)

    def similarity(self, item: int, place: np.ndarray) -> float:
        """The weighted share of five-word shingles that an item and a document's words have in common, of all of both."""
        mine = np.unique(shingles(self.codes[self.base[item] : self.base[item + 1]]))
        theirs = np.unique(shingles(place))
        both = np.union1d(mine, theirs)
        if not len(both):
            return 0.0
        at = np.minimum(np.searchsorted(self.known, both), len(self.known) - 1)
        weight = np.where(self.known[at] == both, self.weights[at], self.most)
        shared = np.isin(both, mine, assume_unique=True) & np.isin(both, theirs, assume_unique=True)
        return float(weight[shared].sum() / weight.sum())


def _search(index: WindowIndex, least: float) -> Callable:
    passage = index.passage
    steps = np.arange(passage)

    def verified(doc: np.ndarray, item: np.ndarray, place: np.ndarray, offset: np.ndarray, exact: np.ndarray, texts: dict) -> Iterator[tuple]:
        """Each candidate (document, item) with its longest run of equal words and its similarity."""
        shift = place - offset
        order = np.lexsort((place, shift, item, doc))
        doc, item, place, shift, exact = (x[order] for x in (doc, item, place, shift, exact))
        pair = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
        for s, e in zip(pair.tolist(), [*pair[1:].tolist(), len(doc)]):
            i, mine, codes = int(doc[s]), int(item[s]), texts[int(doc[s])]
            at, own = place[s:e][exact[s:e]], shift[s:e][exact[s:e]]
            run = first = 0
            if len(at):
                breaks = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] - at[:-1] > 1)]))
                ends = np.concatenate([breaks[1:], [len(at)]]) - 1
                run = int((at[ends] - at[breaks]).max()) + passage
                first = int(at.min())
            shifts, seen = np.unique(shift[s:e], return_counts=True)
            begin = int(shifts[seen.argmax()])
            region = codes[max(0, begin) : max(0, begin + int(index.length(mine)))]
            alike = index.similarity(mine, np.array(region, np.uint64))
            if run or alike >= least:
                yield i, mine, first if run else max(0, begin), run, alike

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            codes: list[int] = []
            bounds: list[tuple[int, int, int]] = []
            hits: list[tuple[np.ndarray, ...]] = []
            kept: dict[int, list[int]] = {}

            def flush() -> None:
                if not bounds:
                    return
                flat = np.array(codes, np.uint64)
                sums, upto = WindowSums(flat), index.upto(flat)
                owner = np.repeat([b[0] for b in bounds], [b[2] for b in bounds])
                offset = np.concatenate([np.arange(b[1], b[1] + b[2]) for b in bounds])
                for window, step, prints, mine, begin in index.levels:
                    place, at = prints.near(sums.fingerprints(window, step))
                    place = place * step
                    # a window lies in one document, and in one piece of it
                    whole = (owner[place] == owner[place + window - 1]) & (offset[place + window - 1] - offset[place] == window - 1) if len(place) else place == 0
                    place, at = place[whole], at[whole]
                    exact = np.zeros(len(place), bool)
                    if window == passage and len(place):
                        theirs = index.codes[(index.base[mine[at]] + begin[at])[:, None] + steps]
                        exact = (flat[place[:, None] + steps] == theirs).all(axis=1)
                        place, at, exact = place[exact], at[exact], exact[exact]
                    elif len(place):
                        # what the place shares with the item is no more than what it shares with all items
                        first = place - begin[at]
                        last = first + index.length(mine[at])
                        inside = (first >= 0) & (last <= len(flat))
                        inside[inside] = owner[first[inside]] == owner[last[inside] - 1]
                        held = upto[np.minimum(last, len(flat))] - upto[np.maximum(first, 0)]
                        able = ~inside | (held >= least * index.total[mine[at]] - 1e-9)
                        place, at, exact = place[able], at[able], exact[able]
                    if len(place):
                        hits.append((owner[place], mine[at], offset[place], begin[at], exact))
                        kept.update(dict.fromkeys(owner[place].tolist()))
                codes.clear()
                bounds.clear()

            texts_of: dict[int, list[int]] = {}
            for i, text in enumerate(texts):
                if not text:
                    continue
                own = coder(text)
                if len(own) < passage:
                    continue
                texts_of[i] = own
                # a long text is taken in pieces that overlap by all but one word of the widest window
                for start in range(0, len(own), CHUNK):
                    piece = own[start : start + CHUNK + index.widest - 1]
                    if len(codes) + len(piece) > CHUNK + index.widest:
                        flush()
                        texts_of = {k: v for k, v in texts_of.items() if k in kept or k == i}
                    bounds.append((i, start, len(piece)))
                    codes += piece
            flush()
            if hits:
                columns = [np.concatenate(c) for c in zip(*hits)]
                # windows in the overlap of two pieces are met twice
                columns = list(np.unique(np.stack([c.astype(np.int64) for c in columns]), axis=1))
                found = list(verified(*columns[:4], columns[4].astype(bool), texts_of))
                if found:
                    doc, item, first, length, alike = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[i] for i in doc], pa.int64()), pa.array(index.items[list(item)]), pa.array(first, pa.int64()),
                            pa.array(length, pa.int64()), pa.array(alike, pa.float64()),
                        ],
                        [c.split()[0] for c in FOUND.split(", ")],
                    )

    return run


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    passage: int = PASSAGE,
    radius: int = RADIUS,
    least: float = LEAST,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, first_word, run, similarity): the documents that hold an item wholly, partly or changed.

    A leak is a run of at least ``passage`` equal words; all of them are found. ``run`` is the longest,
    ``first_word`` the place of the first in the document. A copy of an item whose changes leave
    no such run (``run`` 0) is found where a window of its size is within ``radius``, and counts from a
    weighted similarity of ``least`` on. Null or empty texts, null ids, and items with
    fewer words than a passage match nothing; rows repeated in full count once.
    Items, of which there are few, go to all tasks in blocks of about ``block_words``.
    """
    wanted = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")
    ).distinct()
    # every word has a blank or another mark between it and the next, or is a character of its own
    size = wanted.agg(F.sum(F.ceil((F.length("text") + 1) / 2))).first()[0] or 0
    blocks = max(1, -(-size // block_words))
    corpus = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for b in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        index = WindowIndex([(r.item_id, r.text) for r in part.collect()], passage, radius)
        rows = corpus.mapInArrow(_search(index, least), FOUND)
        if blocks > 1:  # written, so that the driver holds one block's index at a time
            rows = cut(rows)
        found = rows if found is None else found.unionByName(rows)
    ran = F.when(F.col("run") > 0, F.col("first_word"))
    return found.groupBy("doc_id", "item_id").agg(
        F.coalesce(F.min(ran), F.min("first_word")).alias("first_word"), F.max("run").alias("run"), F.max("similarity").alias("similarity")
    )
