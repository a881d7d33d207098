"""The taxonomy as three small DataFrames, and validation of nodes, relations and values against it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Properties of each type (type, property, tier, type of the value, required, enumeration).
PROPERTIES = [
    ("Person", "name", "core", "String", True, None),
    ("Person", "created_at", "core", "DateTime", True, None),
    ("Person", "updated_at", "core", "DateTime", True, None),
    ("Location", "name", "core", "String", True, None),
    ("Location", "created_at", "core", "DateTime", True, None),
    ("Location", "updated_at", "core", "DateTime", True, None),
    ("Item", "name", "core", "String", True, None),
    ("Item", "item_type", "core", "String", True, None),
    ("Item", "created_at", "core", "DateTime", True, None),
    ("Item", "updated_at", "core", "DateTime", True, None),
    ("DigitalItem", "name", "core", "String", True, None),
    ("DigitalItem", "content_type", "core", "String", True, None),
    ("DigitalItem", "created_at", "core", "DateTime", True, None),
    ("DigitalItem", "updated_at", "core", "DateTime", True, None),
    ("Activity", "name", "core", "String", True, None),
    ("Activity", "activity_type", "core", "String", True, None),
    ("Activity", "created_at", "core", "DateTime", True, None),
    ("Activity", "updated_at", "core", "DateTime", True, None),
    ("Collection", "name", "core", "String", True, None),
    ("Collection", "collection_type", "core", "String", True, None),
    ("Collection", "created_at", "core", "DateTime", True, None),
    ("Collection", "updated_at", "core", "DateTime", True, None),
    ("Information", "title", "core", "String", True, None),
    ("Information", "content", "core", "Text", True, None),
    ("Information", "created_at", "core", "DateTime", True, None),
    ("Information", "updated_at", "core", "DateTime", True, None),
    ("Person", "first_name", "standard", "String", False, None),
    ("Person", "last_name", "standard", "String", False, None),
    ("Person", "email", "standard", "Email", False, None),
    ("Person", "phone", "standard", "String", False, None),
    ("Person", "relationship", "standard", "String", False, None),
    ("Person", "notes", "standard", "Text", False, None),
    ("Location", "address", "standard", "String", False, None),
    ("Location", "city", "standard", "String", False, None),
    ("Location", "state", "standard", "String", False, None),
    ("Location", "country", "standard", "String", False, None),
    ("Location", "postal_code", "standard", "String", False, None),
    ("Location", "location_type", "standard", "String", False, None),
    ("Location", "coordinates", "standard", "String", False, None),
    ("Item", "description", "standard", "Text", False, None),
    ("Item", "value", "standard", "Number", False, None),
    ("Item", "purchase_date", "standard", "Date", False, None),
    ("Item", "purchase_price", "standard", "Number", False, None),
    ("Item", "condition", "standard", "String", False, None),
    ("Item", "status", "standard", "String", False, None),
    ("Item", "physical_location", "standard", "String", False, None),
    ("DigitalItem", "description", "standard", "Text", False, None),
    ("DigitalItem", "file_path", "standard", "String", False, None),
    ("DigitalItem", "file_size", "standard", "Number", False, None),
    ("DigitalItem", "url", "standard", "String", False, None),
    ("DigitalItem", "mime_type", "standard", "String", False, None),
    ("DigitalItem", "date_created", "standard", "DateTime", False, None),
    ("DigitalItem", "source", "standard", "String", False, None),
    ("Activity", "description", "standard", "Text", False, None),
    ("Activity", "start_date", "standard", "DateTime", False, None),
    ("Activity", "end_date", "standard", "DateTime", False, None),
    ("Activity", "status", "standard", "String", False, None),
    ("Activity", "priority", "standard", "String", False, None),
    ("Activity", "completion_percentage", "standard", "Number", False, None),
    ("Collection", "description", "standard", "Text", False, None),
    ("Collection", "item_count", "standard", "Number", False, None),
    ("Collection", "is_ordered", "standard", "Boolean", False, None),
    ("Collection", "is_public", "standard", "Boolean", False, None),
    ("Information", "content_type", "standard", "String", False, None),
    ("Information", "source", "standard", "String", False, None),
    ("Information", "tags", "standard", "Array", False, None),
    ("Information", "importance", "standard", "String", False, None),
    ("Information", "is_private", "standard", "Boolean", False, None),
]
# Relations (type, relation, target type, cardinality, symmetric).
RELATIONS = [
    ("Person", "KNOWS", "Person", "many", True),
    ("Person", "LIVES_AT", "Location", "many", False),
    ("Person", "WORKS_AT", "Location", "many", False),
    ("Person", "OWNS", "Item", "many", False),
    ("Person", "OWNS", "DigitalItem", "many", False),
    ("Person", "PARTICIPATES_IN", "Activity", "many", False),
    ("Location", "CONTAINS", "Location", "many", False),
    ("Location", "NEAR", "Location", "many", True),
    ("Location", "HOSTS", "Activity", "many", False),
    ("Item", "OWNED_BY", "Person", "many", False),
    ("Item", "LOCATED_AT", "Location", "one", False),
    ("Item", "RELATED_TO", "Item", "many", True),
    ("Item", "RELATED_TO", "DigitalItem", "many", True),
    ("Item", "USED_IN", "Activity", "many", False),
    ("Item", "PART_OF", "Collection", "many", False),
    ("Item", "DOCUMENTED_BY", "DigitalItem", "many", False),
    ("DigitalItem", "CREATED_BY", "Person", "one", False),
    ("DigitalItem", "OWNED_BY", "Person", "many", False),
    ("DigitalItem", "STORED_AT", "Location", "many", False),
    ("DigitalItem", "DOCUMENTS", "Item", "many", False),
    ("DigitalItem", "DOCUMENTS", "Person", "many", False),
    ("DigitalItem", "DOCUMENTS", "Location", "many", False),
    ("DigitalItem", "DOCUMENTS", "Activity", "many", False),
    ("DigitalItem", "RELATED_TO", "DigitalItem", "many", True),
    ("DigitalItem", "RELATED_TO", "Item", "many", True),
    ("DigitalItem", "PART_OF", "Collection", "many", False),
    ("DigitalItem", "VERSION_OF", "DigitalItem", "one", False),
    ("Activity", "ASSIGNED_TO", "Person", "many", False),
    ("Activity", "INVOLVES", "Person", "many", False),
    ("Activity", "TAKES_PLACE_AT", "Location", "one", False),
    ("Activity", "USES", "Item", "many", False),
    ("Activity", "USES", "DigitalItem", "many", False),
    ("Activity", "DEPENDS_ON", "Activity", "many", False),
    ("Activity", "PART_OF", "Activity", "one", False),
    ("Collection", "CONTAINS", "Item", "many", False),
    ("Collection", "CONTAINS", "DigitalItem", "many", False),
    ("Collection", "CONTAINS", "Activity", "many", False),
    ("Collection", "CONTAINS", "Information", "many", False),
    ("Collection", "OWNED_BY", "Person", "many", False),
    ("Collection", "RELATED_TO", "Collection", "many", True),
    ("Information", "CREATED_BY", "Person", "one", False),
    ("Information", "ABOUT", "Person", "many", False),
    ("Information", "ABOUT", "Location", "many", False),
    ("Information", "ABOUT", "Item", "many", False),
    ("Information", "ABOUT", "DigitalItem", "many", False),
    ("Information", "ABOUT", "Activity", "many", False),
    ("Information", "REFERENCES", "Information", "many", False),
    ("Information", "TAGGED_WITH", "Collection", "many", False),
]

PROPS = "type string, prop string, tier string, prop_type string, required boolean, enum array<string>"
RELS = "src_type string, rel string, dst_type string, cardinality string, symmetric boolean"


def frames(spark: SparkSession) -> dict[str, DataFrame]:
    """types, props and rels of the built-in taxonomy; a few dozen rows each."""
    types = sorted({(p[0], None) for p in PROPERTIES})
    return {"types": spark.createDataFrame(types, "type string, parent string"), "props": spark.createDataFrame(PROPERTIES, PROPS), "rels": spark.createDataFrame(RELATIONS, RELS)}


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The same frames from YAML files, one mapping of types each (core_, standard_ and plain properties, relations, extends)."""
    import yaml

    types, props, rels = [], [], []
    for path in sorted(Path(folder).glob("*.yml")):
        for kind, body in (yaml.safe_load(path.read_text()) or {}).items():
            if not isinstance(body, dict) or not any(k in body for k in ("core_properties", "standard_properties", "properties", "relations")):
                continue
            types.append((kind, body.get("extends")))
            for section, tier in (("core_properties", "core"), ("standard_properties", "standard"), ("properties", "standard")):
                for p, x in (body.get(section) or {}).items():
                    x = x if isinstance(x, dict) else {"type": x}
                    props.append((kind, p, tier, x.get("type", "String"), bool(x.get("required")), x.get("enum")))
            for r, x in (body.get("relations") or {}).items():
                to = x["to"] if isinstance(x["to"], list) else [x["to"]]
                rels += [(kind, r, t, x.get("cardinality", "one"), bool(x.get("symmetric"))) for t in to]
    return {"types": spark.createDataFrame(types, "type string, parent string"), "props": spark.createDataFrame(props, PROPS), "rels": spark.createDataFrame(rels, RELS)}


def violations(nodes: DataFrame, types: DataFrame, rules: DataFrame) -> DataFrame:
    """id, problem, property: required properties that are missing and values outside an enumeration; rules of ancestors count."""
    from quillgraph.operators.graph import ancestors

    up = ancestors(types).unionByName(types.select("type", F.col("type").alias("ancestor")))
    inherited = up.join(rules.withColumnRenamed("type", "ancestor"), "ancestor").select("type", "prop", "required", "enum")
    x = nodes.join(inherited, "type").withColumn("value", F.col("props")[F.col("prop")])
    blank = F.col("value").isNull() | (F.trim("value") == "")
    problem = F.when(F.col("required") & blank, "missing_required").when(~blank & F.col("enum").isNotNull() & ~F.array_contains("enum", F.col("value")), "not_allowed")
    return x.withColumn("problem", problem).where("problem is not null").select("id", "problem", F.col("prop").alias("property"))


def suggest(asked: DataFrame, rels: DataFrame) -> DataFrame:
    """relation, suggestion (the known name in any case), valid (the exact name is known)."""
    known = rels.select(F.col("rel").alias("suggestion"), F.upper("rel").alias("key")).distinct()
    return asked.withColumn("key", F.upper("relation")).join(known, "key", "left").select("relation", "suggestion", (F.coalesce("suggestion", F.lit("")) == F.col("relation")).alias("valid"))


def valid_value(kind: Column, value: Column) -> Column:
    """Whether a string is a value of a type; types of any other name take anything."""
    number, whole = value.rlike(r"^[+-]?\d+(\.\d+)?$"), value.rlike(r"^[+-]?\d+$")
    day = value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNotNull()
    moment = F.try_to_timestamp(value).isNotNull()
    return (
        F.when(kind == "Integer", whole)
        .when(kind.isin("Float", "Number"), number)
        .when(kind == "Boolean", F.lower(value).isin("true", "false"))
        .when(kind == "Date", day)
        .when(kind == "DateTime", moment)
        .when(kind == "Email", value.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))
        .when(kind == "URL", value.rlike(r"^https?://\S+$"))
        .when(kind == "Duration", value.rlike(r"^P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+S)?)?$"))
        .otherwise(F.lit(True))
    )
