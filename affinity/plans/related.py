"""The engine: building an index over a corpus and finding related documents."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.config import DEFAULT, EngineConfig
from affinity.operators import candidates as pick
from affinity.operators.bitmap import build_filters
from affinity.operators import postings
from affinity.operators.postings import document_words, word_index
from affinity.operators.similarity import pair_scores, similar_to_many, similar_to_one
from affinity.operators.stats import provider_stats
from affinity.operators.stopwords import learned_stopwords
from affinity.operators.terms import bounded, document_terms, legacy_terms, preprocessed, tokenized
from affinity.session import cut
from affinity.streaming.updates import last_changes
from affinity.sources.store import IndexStore


class SimilarityProvider(Protocol):
    """What a provider of related documents offers."""

    def initialize(self, store: IndexStore | None = None) -> bool: ...
    def reindex(self, store: IndexStore | None = None) -> None: ...
    def process(self, changes: DataFrame) -> None: ...
    def stop(self) -> None: ...
    def is_indexed(self, doc_id: int) -> bool: ...
    def candidates(self, doc_id: int) -> DataFrame: ...
    def similarity(self, a: int, b: int) -> float: ...
    def stats(self) -> DataFrame: ...


@dataclass
class RelatedEngine:
    """An index of ``corpus`` (doc_id, path, title, text, mtime).

    Nothing is computed before it is asked for. Tokens, which several parts read, and filters are written once.
    ``now`` is the time recency counts from, the present by default.
    """

    corpus: DataFrame
    config: EngineConfig = DEFAULT
    legacy: bool = False
    now: datetime | None = None

    @cached_property
    def documents(self) -> int:
        return self.corpus.count()

    @cached_property
    def bits(self) -> int:
        return self.config.filter_bits(self.documents)

    @cached_property
    def texts(self) -> DataFrame:
        return bounded(self.corpus, self.config, None if self.legacy else self.config.text_bound(self.documents))

    @cached_property
    def tokens(self) -> DataFrame:
        return cut(tokenized(self.texts))

    @cached_property
    def common(self) -> tuple[list[str], int | None]:
        """The adaptive stopwords and the id from which documents are filtered by them."""
        return learned_stopwords(self.tokens, self.corpus, self.documents, self.config)

    @cached_property
    def filtered(self) -> DataFrame:
        return preprocessed(self.tokens, self.config, *self.common)

    @cached_property
    def terms(self) -> DataFrame:
        return legacy_terms(self.tokens, self.config, *self.common) if self.legacy else document_terms(self.filtered, self.config.capped_pairs)

    @cached_property
    def filters(self) -> DataFrame:
        return cut(build_filters(self.terms, self.bits, self.config.hashes))

    @cached_property
    def words(self) -> DataFrame:
        return cut(word_index(document_words(self.tokens), self.documents))

    def is_indexed(self, doc_id: int) -> bool:
        return not self.filters.where(F.col("doc_id") == doc_id).isEmpty()

    def similarity(self, a: int, b: int) -> float:
        """The score of two documents, 0 if one is not indexed."""
        pair = self.filters.sparkSession.createDataFrame([(a, b)], "id_a bigint, id_b bigint")
        return pair_scores(self.filters, pair).first().similarity

    def scores(self, pairs: DataFrame) -> DataFrame:
        return pair_scores(self.filters, pairs)

    def candidates(self, doc_id: int) -> DataFrame | None:
        """(doc_id) of a sample to compare; null means all, which a corpus below the sampling threshold gives.

        For callers that ask for a sample; ``related`` compares all documents at every corpus size.
        """
        own = self.config
        if not own.enable_sampling or self.documents <= own.sample_size_threshold:
            return None
        now, most = self.now or datetime.now(), own.max_sample_size
        known = self.documents > own.word_index_threshold and not self.words.where(F.col("doc_id") == doc_id).isEmpty()
        if known:
            return pick.smart_candidates_by_word(self.words, self.corpus, self.filters, doc_id, most, now, own.seed)
        return pick.smart_candidates_by_bitmap(self.corpus, self.filters, doc_id, most, now, own.seed)

    def related(self, doc_id: int, most: int | None = None) -> DataFrame:
        """(doc_id, path, similarity): the documents most related to one, of all; best first, none if it isn't indexed."""
        found = similar_to_one(self.filters, doc_id, most or self.config.max_suggestions, threshold=self.config.similarity_threshold)
        return self.corpus.select("doc_id", "path").join(F.broadcast(found), "doc_id").orderBy(F.desc("similarity"), "doc_id")

    def related_to_all(self, queries: DataFrame, most: int | None = None) -> DataFrame:
        """(query_id, doc_id, similarity, rank) for many documents at once, each held against all."""
        asked = self.filters.join(queries.select("doc_id").distinct(), "doc_id", "left_semi")
        return similar_to_many(self.filters, asked, most or self.config.max_suggestions)

    def stats(self) -> DataFrame:
        return provider_stats(self.filters, len(self.common[0]), self.config)

    def save(self, store: IndexStore) -> dict:
        """Save filters, stopwords and word index, so that a later engine starts without reading a text."""
        common, since = self.common
        return store.save(
            self.filters, common, bits=self.bits, hashes=self.config.hashes, threshold=self.config.similarity_threshold, since=since, words=self.words
        )

    def restore(self, store: IndexStore) -> bool:
        """Take the saved filters, stopwords and word index instead of building them; whether there were any that fit."""
        saved = store.load(bits=self.bits, hashes=self.config.hashes)
        if saved is None:
            return False
        self.__dict__["filters"] = saved.filters
        self.__dict__["common"] = (saved.stopwords, saved.since)
        if saved.words is not None:
            self.__dict__["words"] = saved.words
        return True

    def initialize(self, store: IndexStore | None = None) -> bool:
        """Start from the saved index if there is one that fits, else build it and save it; whether it was there."""
        if store is not None and self.restore(store):
            return True
        self.reindex(store)
        return False

    def reindex(self, store: IndexStore | None = None) -> None:
        """Build everything anew and save it."""
        self.stop()
        self.filters.count()
        if store is not None:
            self.save(store)

    def process(self, changes: DataFrame) -> None:
        """Take in ``changes`` (doc_id, op, text, ts): new filters and words of added and edited documents, none of deleted ones.

        The stopwords stay as they were learned, and words are admitted as in the index as it is: those
        that other documents have, and new ones.
        """
        last = cut(last_changes(changes.select("doc_id", "op", "text", "ts")))
        tokens = cut(tokenized(bounded(last.where(F.col("op") != "delete").select("doc_id", "text"), self.config, self.config.text_bound(self.documents))))
        texts = preprocessed(tokens, self.config, self.common[0])
        own = legacy_terms(tokens, self.config, self.common[0]) if self.legacy else document_terms(texts, self.config.capped_pairs)
        kept = self.filters.join(last, "doc_id", "left_anti")
        words = postings.remove_documents(self.words, last)
        self.__dict__["filters"] = cut(kept.unionByName(build_filters(own, self.bits, self.config.hashes).select(kept.columns)))
        self.__dict__["words"] = cut(words.unionByName(postings.document_words(tokens).select(words.columns)))

    def stop(self) -> None:
        """Forget all that was computed."""
        for name in ("documents", "bits", "texts", "tokens", "common", "filtered", "terms", "filters", "words"):
            self.__dict__.pop(name, None)
