"""One object for the questions a caller asks most, each answered by a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sparql
from .functions import html
from .operators import extraction, graphs, knowledge, quads, registry, snapshots, vocabulary


class Engine:
    """Tables of a store and a vocabulary: quads, graphs, concepts, entities, observations and decisions, as far as a question needs them."""

    def __init__(self, **tables: DataFrame):
        self.tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(f"the engine was given no table {name}") from None

    def pages(self, rows: DataFrame) -> DataFrame:
        """Pages (url, html) read: title, headings, text, links."""
        return html.pages(rows)

    def page_graph(self, pages: DataFrame, key: str = "url", text: str = "text") -> DataFrame:
        """The relations that pages state about the vocabulary."""
        return extraction.triples(pages, key, vocabulary.vocabulary(self.concepts), text=text)

    def site_keys(self) -> DataFrame:
        """What each site's observed keys are."""
        e = self.entities
        forms = e.select("id", registry.key(F.col("preflabel")).alias("form")).unionByName(e.select("id", F.explode("aliases").alias("a")).select("id", registry.key(F.col("a.form")).alias("form")))
        return registry.resolve_keys(registry.forms_by_key(self.observations), forms, vocabulary.vocabulary(self.concepts).select("form", "concept_id"))

    def align(self, pages: DataFrame, key: str, text: str = "text") -> DataFrame:
        """How much of each vertical's vocabulary texts cover."""
        return vocabulary.coverage(vocabulary.occurrences(pages, [key], vocabulary.vocabulary(self.concepts), text), key, self.concepts)

    def classify(self, pages: DataFrame, key: str, text: str = "text") -> DataFrame:
        found = vocabulary.occurrences(pages, [key], vocabulary.vocabulary(self.concepts), text)
        return vocabulary.classify(vocabulary.evidence(found, key, distinctive=True), key)

    def history(self, domain: str, limit: int = 50) -> DataFrame:
        """The newest runs of a domain, at most 200."""
        if not domain:
            raise ValueError("a domain is needed")
        return quads.list_runs(self.graphs, self.quads, domain, max(1, min(limit, 200)))

    def changes(self) -> DataFrame:
        return snapshots.run_changes(self.quads, self.graphs)

    def matrix(self, budget: int) -> DataFrame:
        companies = quads.companies_of_runs(self.graphs, self.quads, budget)
        states = quads.concept_states(self.quads, companies.where(F.col("run").isNotNull()).select("run").distinct())
        concepts = self.concepts.select("vertical_id", F.concat(F.lit("https://onto.example/concept/"), "id").alias("concept"))
        return quads.coverage_matrix(concepts, companies, states)

    def proposals(self) -> DataFrame:
        return registry.proposals(self.observations, registry.decisions(self.decisions))

    def hubs(self, edges: DataFrame, n: int = 8) -> DataFrame:
        """The most central nodes of a graph."""
        return graphs.pagerank(edges).orderBy(F.desc("rank"), "node").limit(n)

    def governance(self) -> DataFrame:
        return knowledge.governance(self.concepts)

    def ask(self, text: str) -> DataFrame:
        """A SPARQL SELECT query over the store."""
        return sparql.select(self.quads, text)
