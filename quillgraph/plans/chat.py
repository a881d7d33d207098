"""Questions as typed plans: intent, plan, execution and answer, without any free-form query text.

The language model of a deployment may replace `parse`; the offline one reads the command grammar
    show|update|delete <Type> id <id> [property value]
    create|add <Type> <name>
    who|what|show <RELATION> <Type> <name>
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import state

# Patterns of the command grammar.
COMMAND = r"(?i)^\s*(show|find|update|delete)\s+([A-Za-z]+)\s+id\s+(\S+)(?:\s+(\w+))?(?:\s+(.+?))?\s*$"
CREATE = r"(?i)^\s*(create|add)\s+([A-Za-z]+)\s+(.+?)\s*$"
QUESTION = r"(?i)^\s*(who|what|show)\s+([A-Za-z_]+)\s+([A-Za-z]+)\s+(.+?)\s*\??\s*$"


@dataclass
class Intent:
    type: str  # read or write
    operation: str  # find, relate, create, update, delete
    entity_type: str = ""
    target_id: str | None = None
    relationship: str | None = None
    properties: dict[str, str] = field(default_factory=dict)
    filters: dict[str, str] = field(default_factory=dict)


def parse(text: str) -> Intent | None:
    """The intent of a command, or None if it needs to be asked again."""
    if m := re.match(COMMAND, text):
        op = m[1].lower()
        if op == "update":
            return Intent("write", "update", m[2], m[3], properties={m[4]: m[5]} if m[4] and m[5] else {})
        return Intent("write" if op == "delete" else "read", "delete" if op == "delete" else "find", m[2], m[3])
    if m := re.match(CREATE, text):
        return Intent("write", "create", m[2], properties={"name": m[3]})
    if m := re.match(QUESTION, text):
        return Intent("read", "relate", m[3], relationship=m[2].upper(), filters={"name": m[4]})
    return None


def intents(text: Column) -> Column:
    """The same grammar over a column: struct<operation, entity_type, target_id>; null fields where nothing fits."""

    def group(pattern: str, k: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))

    op = F.lower(F.coalesce(group(COMMAND, 1), group(CREATE, 1), group(QUESTION, 1)))
    kind = F.when(op.isin("create", "add"), "create").when(op.isin("who", "what"), "relate").when(op.isin("update", "delete"), op).when(op.isNotNull(), "find")
    return F.struct(kind.alias("operation"), F.coalesce(group(COMMAND, 2), group(CREATE, 2), group(QUESTION, 3)).alias("entity_type"), group(COMMAND, 3).alias("target_id"))


@dataclass
class Step:
    """One step of a plan. required: values that must be given before a write; if_empty: what to suggest then."""

    kind: str
    description: str
    intent: Intent
    write: bool = False
    required: list[str] = field(default_factory=list)
    if_empty: str = ""


def plan(intent: Intent) -> list[Step]:
    if intent.operation == "find":
        return [Step("find", f"{intent.entity_type} {intent.target_id}", intent, if_empty="list ids of this type")]
    if intent.operation == "relate":
        return [Step("relate", f"{intent.relationship} of {intent.filters}", intent, if_empty="try another relation of this type")]
    required = {"create": ["name"], "update": ["property", "value"], "delete": []}[intent.operation]
    missing = required if intent.operation == "create" and "name" not in intent.properties or intent.operation == "update" and not intent.properties else []
    exists = [] if intent.operation == "create" else [Step("find", "the target exists", intent)]
    return [*exists, Step(intent.operation, f"{intent.operation} {intent.entity_type}", intent, True, missing)]


def having(nodes: DataFrame, intent: Intent) -> DataFrame:
    out = nodes.where(F.lower("label") == intent.entity_type.lower()) if intent.entity_type else nodes
    if intent.target_id is not None:
        out = out.where(F.col("id").isin(intent.target_id, f"{intent.entity_type}_{intent.target_id}"))
    for k, v in intent.filters.items():
        out = out.where(F.lower(F.col("name") if k == "name" else F.col("props")[k]) == v.lower())
    return out


def related(nodes: DataFrame, edges: DataFrame, intent: Intent) -> DataFrame:
    """type, id, name of everything at the other end of the relation, either way, each once."""
    start = having(nodes, intent).select(F.col("id").alias("start"))
    e = edges.where(F.upper("type") == intent.relationship) if intent.relationship else edges
    out = e.join(start, F.col("src") == F.col("start")).select("type", F.col("dst").alias("id"))
    back = e.join(start, F.col("dst") == F.col("start")).select("type", F.col("src").alias("id"))
    return out.unionByName(back).distinct().join(nodes.select("id", "name"), "id").select("type", "id", "name")


@dataclass
class Outcome:
    rows: DataFrame | None
    nodes: DataFrame
    edges: DataFrame
    message: str


def execute(steps: list[Step], nodes: DataFrame, edges: DataFrame, confirm: Callable[[Step], bool] = lambda s: True) -> Outcome:
    """Reads return rows; writes return new snapshots of nodes and edges. Nothing is written to a target that is not there."""
    rows: DataFrame | None = None
    for s in steps:
        if not confirm(s):
            return Outcome(rows, nodes, edges, "cancelled")
        i = s.intent
        if s.required:
            return Outcome(None, nodes, edges, "needs " + ", ".join(s.required))
        if s.kind == "find":
            rows = having(nodes, i)
            if rows.isEmpty():
                return Outcome(rows, nodes, edges, "nothing found" + (f"; {s.if_empty}" if s.if_empty else ""))
        elif s.kind == "relate":
            rows = related(nodes, edges, i)
        elif s.kind == "create":
            made = nodes.sparkSession.createDataFrame([(f"{i.entity_type}_{i.properties['name']}", i.entity_type, i.properties["name"], i.properties)], "id string, label string, name string, props map<string,string>")
            nodes = state.upsert_nodes(nodes, made)
        elif s.kind == "update":
            new = F.create_map(*[F.lit(x) for kv in i.properties.items() for x in kv])
            change = having(nodes, i).select("id", "label", F.lit(i.properties.get("name")).cast("string").alias("n"), "name", new.alias("props"))
            nodes = state.upsert_nodes(nodes, change.select("id", "label", F.coalesce("n", "name").alias("name"), "props"))
        elif s.kind == "delete":
            nodes, edges = state.delete_nodes(nodes, edges, having(nodes, i).select("id"))
    return Outcome(rows, nodes, edges, "done")


def answer(outcome: Outcome, limit: int = 10) -> str:
    """A few rows as text, with ids, and what to ask next."""
    if outcome.rows is None:
        return outcome.message
    own = [c for c in outcome.rows.columns if c in ("type", "id", "name")]
    shown = [" ".join(str(x) for x in r) for r in outcome.rows.select(*own).orderBy(*own).limit(limit).collect()]
    return "\n".join([outcome.message, *shown, "Ask: show <Type> id <id>"])


def taxonomy_context(frames: dict[str, DataFrame]) -> str:
    """The taxonomy as text for a model: types, their properties and relations."""
    props = {}
    for r in frames["props"].collect():  # a few dozen rows
        props.setdefault(r["type"], []).append(f"{r['prop']} ({r['prop_type']}{', required' if r['required'] else ''})")
    rels = {}
    for r in frames["rels"].collect():
        rels.setdefault(r["src_type"], []).append(f"{r['rel']} -> {r['dst_type']} ({r['cardinality']})")
    return "\n".join(f"{t}: {', '.join(sorted(props.get(t, [])))}; {', '.join(sorted(rels.get(t, [])))}" for t in sorted(props))


def repl(nodes: DataFrame, edges: DataFrame, read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> None:
    """Until `exit`."""
    while (line := read("> ")).strip().lower() != "exit":
        intent = parse(line)
        if intent is None:
            write("Say that another way: show <Type> id <id>, create <Type> <name>, who <RELATION> <Type> <name>")
            continue
        outcome = execute(plan(intent), nodes, edges)
        nodes, edges = outcome.nodes, outcome.edges
        write(answer(outcome))
