"""One object for the whole life of an index: crawl, list, search, read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlpit.functions.paths import is_safe_path
from marlpit.operators.reading import list_sources, read_requests
from marlpit.operators.retrieval import TOP_K
from marlpit.plans.crawl import Indexing, crawl
from marlpit.plans.search import search
from marlpit.sources.registry import checked_registry, local_sources
from marlpit.sources.store import IndexStore
from marlpit.sources.tree import open_paths, scan_tree


class DocumentIndex:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        registry: DataFrame,
        indexing: Indexing,
        data_dir: str = "data",
    ):
        """`data_dir` holds the checked-out trees of git sources."""
        self.store = IndexStore(spark, root)
        self.registry = checked_registry(registry)
        self.indexing = indexing
        self.data_dir = data_dir

    def crawl(
        self,
        documents: DataFrame | None = None,
        *,
        only_local: bool = False,
        commits: DataFrame | None = None,
        source_errors: DataFrame | None = None,
    ) -> DataFrame:
        """Crawl a documents table or, without one, the trees of the registry."""
        registry = local_sources(self.registry) if only_local else self.registry
        scanned = scan_tree(registry, self.data_dir) if documents is None else documents
        return crawl(
            self.store,
            registry,
            scanned,
            self.indexing,
            commits=commits,
            source_errors=source_errors,
        )

    def list_sources(self) -> DataFrame:
        return list_sources(self.registry, self.store.status(), self.store.chunk_counts())

    def search(
        self, questions: DataFrame, k: int = TOP_K, source_ids: list[str] | None = None
    ) -> DataFrame:
        """Answer questions (query_id, text); sources no longer registered count too."""
        return search(
            questions,
            self.store.chunks(self.indexing.model),
            self.indexing.model,
            embedder=self.indexing.embedder,
            source_ids=source_ids,
            k=k,
        )

    def read(self, requests: DataFrame, documents: DataFrame | None = None) -> DataFrame:
        """Read whole documents or line ranges from a table or from the trees.

        The registry's globs limit indexing only. From trees only the files
        that are asked for are opened.
        """
        if documents is None:
            wanted = requests.select("source_id", "path").where(is_safe_path(F.col("path"))).distinct()
            documents = open_paths(wanted, self.registry, self.data_dir)
        return read_requests(requests, self.registry, documents)
