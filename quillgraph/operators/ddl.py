"""Declared constraints and indexes of typed nodes: checks as rows, indexes as layout.

A schema is a mapping (from YAML): type -> {properties: [{name, type, required, unique, indexed, enum}]}, and under
`indexes` composite ones: [{label, properties}]. Constraints compile to one pass of checks over the nodes;
an index compiles to a table of the nodes of its label that is sorted by its properties, each a column, so that a
lookup reads the partition of the label and, by the ranges that Parquet keeps, the files and row groups of the
value. Applying a schema replaces what was declared before.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.taxonomy import valid_value


@dataclass(frozen=True)
class Constraint:
    label: str
    prop: str
    kind: str  # required, unique, type or enum
    of: tuple[str, ...] = ()


@dataclass(frozen=True)
class Index:
    label: str
    props: tuple[str, ...]

    @property
    def name(self) -> str:
        return "_".join([self.label, *self.props, "idx"]).lower().replace(" ", "_")


#: Names of types in a schema, as the types that values are held against; others take anything.
_TYPES = {"integer": "Integer", "float": "Float", "number": "Number", "boolean": "Boolean", "date": "Date", "datetime": "DateTime", "url": "URL", "email": "Email"}


def declared(schema: dict) -> tuple[list[Constraint], list[Index]]:
    """The constraints and indexes of a schema; a property that is indexed twice has one index."""
    constraints, indexes = [], []
    for label, body in schema.items():
        if not isinstance(body, dict):
            continue
        for p in body.get("properties") or []:
            name = p["name"]
            constraints += [Constraint(label, name, k) for k in ("required", "unique") if p.get(k)]
            if str(p.get("type", "")).lower() in _TYPES:
                constraints.append(Constraint(label, name, "type", (_TYPES[str(p["type"]).lower()],)))
            if p.get("enum"):
                constraints.append(Constraint(label, name, "enum", tuple(map(str, p["enum"]))))
            if p.get("indexed") or p.get("unique"):
                indexes.append(Index(label, (name,)))
    indexes += [Index(x["label"], tuple(x["properties"])) for x in schema.get("indexes") or []]
    return constraints, list(dict.fromkeys(indexes))


def _value(prop: str) -> Column:
    v = F.col("props")[prop]
    return F.when(F.trim(v) != "", v)


def violations(nodes: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """id, label, property, problem (missing, not_unique, wrong_type, not_allowed), value of every violation of nodes (id, label, props).

    What a row alone tells is found in one pass; of a unique property the values that several ids have are counted before the shuffle,
    and their rows found by a join. A blank value counts as none, and of those without a value only `required` is violated.
    """
    own, unique = [], []
    for c in constraints:
        v, at = _value(c.prop), F.col("label") == c.label
        if c.kind == "unique":
            unique.append(F.when(at & v.isNotNull(), F.struct(F.lit(c.prop).alias("property"), v.alias("value"))))
            continue
        bad, problem = {
            "required": (v.isNull(), "missing"),
            "type": (~valid_value(F.lit(c.of[0]) if c.of else F.lit(""), v), "wrong_type"),
            "enum": (~v.isin(list(c.of)), "not_allowed"),
        }[c.kind]
        own.append(F.when(at & F.coalesce(bad, F.lit(False)), F.struct(F.lit(c.prop).alias("property"), F.lit(problem).alias("problem"), v.alias("value"))))
    out = []
    if own:
        out.append(nodes.select("id", "label", F.inline(F.array_compact(F.array(*own)))))
    if unique:
        held = nodes.select("id", "label", F.inline(F.array_compact(F.array(*unique))))
        key = ["label", "property", "value"]
        often = held.groupBy(*key).agg((F.min("id") != F.max("id")).alias("twice")).where("twice").drop("twice")
        out.append(held.join(often, key).select("id", "label", "property", F.lit("not_unique").alias("problem"), "value"))
    if not out:
        return nodes.sparkSession.createDataFrame([], "id string, label string, property string, problem string, value string")
    return reduce(DataFrame.unionByName, out)


def build(nodes: DataFrame, indexes: list[Index], folder: str) -> None:
    """Write the indexes: of each, id and name by label and sorted by its properties (as columns p0, p1, ...), dealt by ranges of them."""
    for index in indexes:
        columns = [_value(p).alias(f"p{n}") for n, p in enumerate(index.props)]
        rows = nodes.where(F.col("label") == index.label).select("label", *columns, "id", "name").where("p0 is not null")
        order = [f"p{n}" for n in range(len(index.props))] + ["id"]
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("label").parquet(f"{folder}/{index.name}")


def drop(spark: SparkSession, indexes: list[Index], folder: str) -> None:
    for index in indexes:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{index.name}")
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def lookup(spark: SparkSession, indexes: list[Index], folder: str, label: str, **props: str) -> DataFrame:
    """id, name of the nodes of a label with the given properties, by the index that has the most of them first; KeyError without one."""

    def covers(i: Index) -> int:
        n = 0
        while n < len(i.props) and i.props[n] in props:
            n += 1
        return n

    fit = [i for i in indexes if i.label == label and set(props) <= set(i.props) and covers(i) == len(props)]
    if not fit:
        raise KeyError(f"no index on {label} ({', '.join(props)})")
    index = min(fit, key=lambda i: len(i.props))
    schema = ", ".join([*(f"p{n} string" for n in range(len(index.props))), "id string", "name string", "label string"])
    rows = spark.read.schema(schema).parquet(f"{folder}/{index.name}").where(F.col("label") == label)
    for p, v in props.items():
        rows = rows.where(F.col(f"p{index.props.index(p)}") == v)
    return rows.select("id", "name")
