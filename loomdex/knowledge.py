"""The public query interface: one object over the tables, each method a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loomdex.operators import context as C
from loomdex.operators.search import SearchParams, read_index, search, write_index
from loomdex.schema import SPEC_TYPES
from loomdex.session import read_table


@dataclass
class KnowledgeBase:
    """``index``: (postings, corpus statistics) of a persisted index, None to read the texts."""

    documents: DataFrame
    refs: DataFrame
    mentions: DataFrame
    specs: DataFrame
    change_log: DataFrame | None = None
    sync_state: DataFrame | None = None
    index: tuple[DataFrame, DataFrame] | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str, index_path: str | None = None) -> KnowledgeBase:
        """Tables as Parquet below ``path``; ``created_at`` may be text."""
        from loomdex.plans.knowledge import docs

        tables = {n: read_table(spark, path, t) for n, t in (("refs", "refs"), ("mentions", "concept_mention"), ("specs", "specs"), ("change_log", "change_log"), ("sync_state", "sync_state"))}
        index = read_index(spark, index_path) if index_path else None
        return cls(docs(spark, path), **tables, index=index)

    def build_index(self, path: str) -> KnowledgeBase:
        """Writes the index below ``path`` and searches through it from now on."""
        write_index(self.documents, path)
        self.index = read_index(self.documents.sparkSession, path)
        return self

    def search(self, query: str = "", **params) -> DataFrame:
        return search(self.documents, SearchParams(query=query, **params), self.mentions, self.index)

    def document(self, doc_id: str) -> DataFrame:
        return C.document_context(self.documents, self.refs, self.mentions, [doc_id.removeprefix("/")])

    def edges(self, doc_id: str) -> DataFrame:
        """References from and to a document."""
        return C.document_edges(self.refs, [doc_id.removeprefix("/")])

    def references(self, entity: str, ref_type: str | None = None, limit: int = 50) -> DataFrame:
        return C.references_to(self.refs, entity, ref_type, limit)

    def spec(self, source_type: str, number: int) -> DataFrame:
        if source_type not in SPEC_TYPES:
            raise ValueError(f"no such kind of specification: {source_type}")
        return C.lookup_spec(self.specs, self.refs, self.mentions, source_type, number)

    def spec_edges(self, source_type: str, number: int) -> DataFrame:
        """References from and to a specification."""
        return C.spec_edges(self.specs, self.refs, [(source_type, number)])

    def timeline(self, concept: str, after: str | None = None, before: str | None = None) -> DataFrame:
        return C.timeline(self.documents, self.mentions, concept, after, before)

    def find_commit(self, query: str, repo: str | None = None) -> DataFrame:
        return C.find_commit(self.documents, query, repo, self.index)

    def stats(self) -> DataFrame:
        return C.stats_by_type(self.documents)

    def health(self) -> DataFrame:
        return C.health(self.documents)

    def sync_states(self, source_id: str | None = None) -> DataFrame:
        return C.sync_states(self.sync_state, source_id)

    def changes(self, since: int, limit: int = 1000) -> DataFrame:
        return C.changes_since(self.change_log, since, limit)

    def to_enrich(self, source_type: str) -> DataFrame:
        """(id, body, source_repo) of the documents of a type, for re-enrichment."""
        return self.documents.where(self.documents.source_type == source_type).select("id", "body", "source_repo")
