"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class EngineConfig:
    """What shapes an index and a search. Nothing here changes with the size of a corpus, unless ``by_size`` asks for it."""

    bits: int | None = None
    by_size: bool = False  # filters half as large for a large corpus, where ``bits`` is null
    hashes: int = 3
    char_limit: int | None = None  # texts are cut to it, if it is given
    whole_texts: bool = True  # false cuts texts by corpus size
    capped_pairs: bool = False  # only the first word pairs of a text enter its terms
    large_corpus: int = 5000  # documents beyond which filters and texts are half as large
    max_text: int | None = None  # longer texts are not indexed
    min_word_length: int = 2
    adaptive_stopwords: bool = True
    stopword_mode: str = "corpus"  # of all documents, or of the "first", as the original learns them
    stopword_documents: int = 30
    stopword_min_df: int = 5
    common_words_threshold: float = 0.5
    max_stopwords: int = 200
    max_suggestions: int = 5
    similarity_threshold: float | None = None
    enable_sampling: bool = True
    sample_size_threshold: int = 5000
    max_sample_size: int = 1000
    word_index_threshold: int = 750
    compat_cjk: bool = False  # drop single CJK characters before the filter
    custom_title: str = "Related Notes"
    seed: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.max_suggestions <= 20:
            raise ValueError("max_suggestions must be from 1 to 20")
        if self.bits is not None and self.bits <= 0 or self.hashes <= 0:
            raise ValueError("bits and hashes must be positive")
        if self.stopword_mode not in ("first", "corpus"):
            raise ValueError("stopword_mode must be 'first' or 'corpus'")

    def with_overrides(self, overrides: dict[str, Any] | None) -> EngineConfig:
        """These settings with ``overrides``; an empty title falls back to the default one."""
        own = dict(overrides or {})
        if not own.get("custom_title", "x"):
            own["custom_title"] = DEFAULT.custom_title
        return replace(self, **own)

    def filter_bits(self, documents: int) -> int:
        """Bits of each filter, a multiple of 64 so that words are whole."""
        bits = self.bits or (4096 if self.by_size and documents > self.large_corpus else 8192)
        return -(-bits // 64) * 64

    def text_limit(self, documents: int) -> int:
        return self.char_limit or (5000 if documents > self.large_corpus else 10_000)

    def text_bound(self, documents: int) -> int | None:
        """Characters that texts are cut to; null leaves them whole."""
        return self.char_limit if self.whole_texts else self.text_limit(documents)


DEFAULT = EngineConfig()
#: The form of the original provider: sizes by corpus size, the first word pairs, stopwords of the first documents.
COMPAT = EngineConfig(by_size=True, whole_texts=False, capped_pairs=True, max_text=10 * 1024 * 1024, stopword_mode="first")
#: The older single-size provider: 256 bits, words of one tokenization and up to 300 word pairs.
LEGACY = EngineConfig(bits=256, similarity_threshold=0.1, max_suggestions=10)
#: The same with stopwords of the first 100 documents.
LEGACY_COMPAT = EngineConfig(bits=256, similarity_threshold=0.1, max_suggestions=10, max_text=10 * 1024 * 1024, stopword_mode="first", stopword_documents=100)
