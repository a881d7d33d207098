"""The engine as one object: a graph, and questions to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillgraph.plans import chat
from quillgraph.sources import tables as T


@dataclass
class Engine:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str) -> Engine:
        from pyspark.sql import functions as F

        return cls(T.nodes(spark, sf_dir), T.edges(spark, sf_dir).withColumn("props", F.lit(None).cast("map<string,string>")))

    def query(self, text: str) -> DataFrame | None:
        """Rows of a read; writes are refused here (use `run`)."""
        intent = chat.parse(text)
        if intent is None or intent.type != "read":
            return None
        return chat.execute(chat.plan(intent), self.nodes, self.edges).rows

    def run(self, text: str) -> str:
        """Execute anything the grammar knows; the graph becomes the new snapshot."""
        intent = chat.parse(text)
        if intent is None:
            return "not understood; try: " + ", ".join(self.suggest(text))
        outcome = chat.execute(chat.plan(intent), self.nodes, self.edges)
        self.nodes, self.edges = outcome.nodes, outcome.edges
        return chat.answer(outcome)

    def suggest(self, text: str) -> list[str]:
        """Commands of the first word, or all."""
        known = ["show <Type> id <id>", "update <Type> id <id> <property> <value>", "delete <Type> id <id>", "create <Type> <name>", "who <RELATION> <Type> <name>"]
        first = (text.split() or [""])[0].lower()
        return [k for k in known if k.startswith(first)] or known
