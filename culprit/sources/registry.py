"""Named graphs with their stores, indexes and preset traces."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from culprit.operators.graph import stats_by
from culprit.sources.graph_store import read_graph, read_index


@dataclass(frozen=True)
class Entry:
    """A registered graph: label, store, index if there is one, and preset traces by key."""

    label: str
    path: str
    index: str | None = None
    presets: dict[str, str] = field(default_factory=dict)


class Registry:
    """Graphs by key; the first is the default, which an unknown key gives too."""

    def __init__(self, entries: dict[str, Entry]):
        if not entries:
            raise ValueError("a registry needs a graph")
        self.entries = entries

    def entry(self, key: str | None = None) -> Entry:
        return self.entries.get(key or "", next(iter(self.entries.values())))

    def load(self, spark: SparkSession, key: str | None = None) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame] | None]:
        """Nodes, edges and index."""
        e = self.entry(key)
        return *read_graph(spark, e.path), read_index(spark, e.index) if e.index else None

    def stats(self, spark: SparkSession) -> DataFrame:
        """``graph_key, nodes, edges``."""
        return stats_by({k: read_graph(spark, e.path) for k, e in self.entries.items()})

    def preset(self, trace: str) -> str | None:
        """The first preset by key whose text holds the trace or is held by it, of any graph."""
        hits = sorted(k for e in self.entries.values() for k, text in e.presets.items() if text in trace or trace in text)
        return hits[0] if hits else None
