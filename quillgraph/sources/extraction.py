"""Extraction documents: reading, unwrapping and checking {entities, relationships}; files and seeds."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "struct<type: string, id: string, name: string, properties: map<string, string>, confidence: double, source_text: string, suggested_type: string>"
RELATION = (
    "struct<type: string, source: string, source_type: string, source_id: string, target: string, target_type: string, target_id: string, "
    "properties: map<string, string>, confidence: double, source_text: string, suggested_relationship: string>"
)
BODY = f"entities: array<{ENTITY}>, relationships: array<{RELATION}>"
SCHEMA = f"extraction_result struct<{BODY}>, {BODY.replace(': array', ' array')}"
#: Largest attached file in bytes.
MAX_FILE = 4 << 20
# Extensions of images.
IMAGES = ["jpg", "jpeg", "png", "gif", "webp"]


def parse(doc: Column) -> Column:
    """struct<entities, relationships> of a JSON document, inside `extraction_result` or not."""
    x = F.from_json(doc, SCHEMA)
    return F.struct(*[F.coalesce(x["extraction_result"][k], x[k]).alias(k) for k in ("entities", "relationships")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, entities, relationships of one JSON file or of all *.json below a folder; files that are no JSON are skipped."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    docs = (reader if path.endswith(".json") else reader.option("pathGlobFilter", "*.json")).text(path)
    x = docs.select(F.input_file_name().alias("file"), parse(F.col("value")).alias("x"))
    return x.where("x.entities is not null or x.relationships is not null").select("file", "x.*")


def entity_name(e: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(e["name"]), F.lit("")), e["properties"]["name"])


def ready(x: Column) -> Column:
    """Something to import, and every entity with a type and relation with type, source and target."""
    some = (F.coalesce(F.size(x["entities"]), F.lit(0)) > 0) | (F.coalesce(F.size(x["relationships"]), F.lit(0)) > 0)
    typed = F.coalesce(F.forall(x["entities"], lambda e: e["type"].isNotNull()), F.lit(True))
    ends = F.coalesce(F.forall(x["relationships"], lambda r: r["type"].isNotNull() & F.coalesce(r["source"], r["source_id"]).isNotNull() & F.coalesce(r["target"], r["target_id"]).isNotNull()), F.lit(True))
    return some & typed & ends


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def entity_problems(e: Column) -> Column:
    """Path and message of each fault; id or name will do."""
    return F.array_compact(F.array(F.when(_blank(e["type"]), "type: required"), F.when(_blank(F.coalesce(e["id"], e["name"])), "id: required"), F.when(~F.coalesce(e["confidence"], F.lit(0.5)).between(0, 1), "confidence: not in 0..1")))


def relation_problems(r: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(_blank(r["type"]), "type: required"),
            F.when(_blank(F.coalesce(r["source_id"], r["source"])), "source: required"),
            F.when(_blank(F.coalesce(r["target_id"], r["target"])), "target: required"),
            F.when(~F.coalesce(r["confidence"], F.lit(0.5)).between(0, 1), "confidence: not in 0..1"),
        )
    )


def split_suggested(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (one a row, as e) with a known type, and those with a suggested one."""
    e = x.select("file", F.explode("entities").alias("e"))
    return e.where("e.suggested_type is null"), e.where("e.suggested_type is not null")


def attachments(spark: SparkSession, path: str, max_bytes: int = MAX_FILE) -> DataFrame:
    """path, length, content and kind (image or text) of files up to the size limit. The limit prunes before contents are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= max_bytes)
    ext = F.lower(F.substring_index("path", ".", -1))
    return df.select("path", "length", "content", F.when(ext.isin(IMAGES), "image").otherwise("text").alias("kind"))


def seed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a YAML seed: groups of {id, labels, properties} and relationships {type, from, to, properties}."""
    import json

    import yaml

    data = yaml.safe_load(Path(path).read_text())

    def text(v: object) -> str | None:
        return v if v is None or isinstance(v, str) else json.dumps(v, default=str)

    nodes, edges = [], []
    for group, rows in data.items():
        for r in rows or []:
            props = {k: text(v) for k, v in (r.get("properties") or {}).items()}
            if "from" in r:
                to = r["to"] if isinstance(r["to"], list) else [r["to"]]
                edges += [(r["from"], t, r["type"], props) for t in to]
            else:
                nodes.append((r["id"], (r.get("labels") or [group])[0], props.get("name") or props.get("title") or r["id"], props))
    return spark.createDataFrame(nodes, "id string, label string, name string, props map<string,string>"), spark.createDataFrame(edges, "src string, dst string, type string, props map<string,string>")


def save_fixture(df: DataFrame, folder: str) -> str:
    """Write a one-row extraction as JSON under extraction_<time>_<md5>; returns the path."""
    row = df.select(F.to_json(F.struct("*")).alias("j"), F.date_format(F.current_timestamp(), "yyyyMMddHHmmss").alias("t")).select("j", F.concat(F.lit("extraction_"), "t", F.lit("_"), F.substring(F.md5("j"), 1, 8)).alias("name")).first()
    path = f"{folder}/{row['name']}.json"
    df.sparkSession.createDataFrame([(row["j"],)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path
